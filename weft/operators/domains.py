"""Domain discovery: from columns of terms to strong domains.

columns -> terms -> equivalence classes (terms in exactly the same columns) ->
similarities of classes -> signature blocks -> robust signatures -> expanded
columns -> local domains -> strong domains -> export.

A class's terms stay rows (class, term); arrays only hold columns and classes,
whose number depends on the number of columns, not of values.  What is done in
Python is one class's list of similar classes at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import infer
from weft.functions.metrics import jaccard, log_jaccard, threshold
from weft.functions.text import term
from weft.operators.drops import common_column_blocks, kept_blocks, signature_blocks, steepest_drop
from weft.operators.graph import components
from weft.session import cut

EQ = "eq long"


def column_terms(cells: DataFrame) -> DataFrame:
    """column_id, term, n: upper-case squeezed values and how often they occur; blanks are left out.

    column_id numbers the columns in the order of dataset and place; the number
    of columns is that of the schema, so that their list is small.
    """
    names = cells.select("dataset", "column", "ordinal").distinct()
    ids = names.withColumn("column_id", F.row_number().over(W.orderBy("dataset", "ordinal")) - 1)
    return cells.join(F.broadcast(ids), ["dataset", "column", "ordinal"]).select("column_id", term(F.col("value")).alias("term")).where("term <> ''").groupBy("column_id", "term").agg(F.count(F.lit(1)).alias("n"))


def text_columns(terms: DataFrame, least: str = "GT0.5") -> DataFrame:
    """column_id, share of the distinct terms that are text, for the columns where it passes."""
    share = terms.groupBy("column_id").agg(F.avg((infer.plain_type(F.col("term")) == "text").cast("int")).alias("share"))
    return share.where(threshold(least)(F.col("share"))).select("column_id", F.round("share", 6).alias("share"))


def short_columns(terms: DataFrame, most: int, least: str) -> DataFrame:
    """column_id of the columns where the share of terms of at most so many signs passes."""
    share = terms.groupBy("column_id").agg(F.avg((F.length("term") <= most).cast("int")).alias("share"))
    return share.where(threshold(least)(F.col("share"))).select("column_id", F.round("share", 6).alias("share"))


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Adds the rank (from 0) of a unique value over all rows: range-partitioned, so that no task sorts them all."""
    r = cut(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    sizes = r.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition.
    before = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__off")
    return r.join(F.broadcast(before), "__p").withColumn(out, F.col("__off") + F.row_number().over(W.partitionBy("__p").orderBy(order)) - 1).drop("__p", "__off")


def term_index(terms: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """term_id (rank of the term), term, columns (array of column_id and n, in order)."""
    if columns is not None:
        terms = terms.join(F.broadcast(columns.select("column_id")), "column_id", "left_semi")
    t = terms.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("column_id", "n"))).alias("columns"))
    return numbered(t, "term", "term_id").select("term_id", "term", "columns")


def equivalence_classes(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes: eq (its smallest term), columns (array of column_id and summed n), n_terms; members: eq, term_id)."""
    i = cut(index.select("term_id", "columns", F.transform("columns", lambda c: c["column_id"]).alias("key")))
    heads = i.groupBy("key").agg(F.min("term_id").alias("eq"), F.count(F.lit(1)).alias("n_terms"))
    sums = i.select("key", F.explode("columns").alias("c")).groupBy("key", "c.column_id").agg(F.sum("c.n").alias("n"))
    sums = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("column_id", "n"))).alias("columns"))
    heads = heads.join(sums, "key")
    return heads.select("eq", "columns", "n_terms"), i.join(heads.select("key", "eq"), "key").select("eq", "term_id")


def weights(classes: DataFrame) -> DataFrame:
    """eq, column_id, n, w: term frequency (half plus half of n over the column's largest) times inverse column frequency."""
    c = classes.select("eq", F.size("columns").alias("k"), F.explode("columns").alias("c")).select("eq", "k", "c.column_id", "c.n")
    total = c.select("column_id").distinct().count()
    most = F.max("n").over(W.partitionBy("column_id"))
    return c.select("eq", "column_id", "n", ((0.5 + 0.5 * F.col("n") / most) * F.log(F.lit(float(max(1, total))) / F.col("k"))).alias("w"))


def similarities(classes: DataFrame, how: str = "JI") -> DataFrame:
    """a, b, sim for all ordered pairs of classes that share a column: JI, LOGJI or TF-ICF (weighted Jaccard, sum of minima over sum of maxima)."""
    if how == "TF-ICF":
        w = weights(classes)
        tot = w.groupBy("eq").agg(F.sum("w").alias("t"))
        w = w.join(tot, "eq")
        o = w.selectExpr("eq a", "t ta", "column_id", "w wa").join(w.selectExpr("eq b", "t tb", "column_id", "w wb"), "column_id").where("a <> b").groupBy("a", "b", "ta", "tb").agg(F.sum(F.least("wa", "wb")).alias("m"))
        return o.select("a", "b", F.coalesce(F.try_divide("m", F.col("ta") + F.col("tb") - F.col("m")), F.lit(0.0)).alias("sim")).where("sim > 0")
    c = classes.select("eq", F.size("columns").alias("k"), F.explode("columns").alias("c")).select("eq", "k", "c.column_id")
    o = c.selectExpr("eq a", "k ka", "column_id").join(c.selectExpr("eq b", "k kb", "column_id"), "column_id").where("a <> b").groupBy("a", "b", "ka", "kb").agg(F.count(F.lit(1)).alias("o"))
    f = {"JI": jaccard, "LOGJI": log_jaccard}[how]
    return o.select("a", "b", f(F.col("ka"), F.col("kb"), F.col("o")).alias("sim"))


def ranked(sims: DataFrame) -> DataFrame:
    """eq, other, sim, rank: the context signature, most similar first (ties: the smaller class)."""
    return sims.select(F.col("a").alias("eq"), F.col("b").alias("other"), "sim").withColumn("rank", F.row_number().over(W.partitionBy("eq").orderBy(F.desc("sim"), "other")))


def blocks(sims: DataFrame, least: float = 0.0, full: bool = True, ignore_last: bool = False, ignore_minor: bool = True) -> DataFrame:
    """eq, block_no (from 0), other, sim: the members of each class's signature blocks."""

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values(["sim", "b"], ascending=[False, True])
        out = [(r["a"].iloc[0], k, o, s) for k, (i, j) in enumerate(signature_blocks(r["sim"].tolist(), least, full, ignore_last, ignore_minor)) for o, s in zip(r["b"].iloc[i:j], r["sim"].iloc[i:j])]
        return pd.DataFrame(out, columns=["eq", "block_no", "other", "sim"])

    return sims.select("a", "b", "sim").groupBy("a").applyInPandas(part, "eq long, block_no int, other long, sim double")


def robust(block: DataFrame, classes: DataFrame, how: str = "LIBERAL") -> DataFrame:
    """The blocks that a robust signature keeps: LIBERAL, IGNORE-LAST or COMMON-COLUMN."""
    size = classes.select(F.col("eq").alias("other"), "n_terms", F.transform("columns", lambda c: c["column_id"]).alias("cols"))
    b = block.join(size, "other").join(classes.select("eq", F.transform("columns", lambda c: c["column_id"]).alias("own")), "eq")
    sizes = b.groupBy("eq", "block_no").agg(F.sum("n_terms").alias("n"), F.collect_list("cols").alias("cols"), F.first("own").alias("own"))

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values("block_no")
        if how == "COMMON-COLUMN":
            k = common_column_blocks(set(r["own"].iloc[0]), [[set(m) for m in c] for c in r["cols"]])
        else:
            k = kept_blocks(r["n"].tolist(), how)
        return pd.DataFrame({"eq": [r["eq"].iloc[0]], "kept": [k]})

    kept = sizes.groupBy("eq").applyInPandas(keep, "eq long, kept int")
    return block.join(kept, "eq").where("block_no < kept").select("eq", "block_no", "other", "sim")


def trimmed(signature: DataFrame, columns: DataFrame, classes: DataFrame, how: str = "CENTRIST") -> DataFrame:
    """column_id, eq, other: the parts of robust signatures that count in a column.

    CONSERVATIVE: the first block; LIBERAL: all; CENTRIST: the blocks by the
    share of their terms that are in the column, cut at the steepest drop.
    columns: column_id, eq.
    """
    base = columns.select("column_id", "eq").join(signature, "eq")
    if how == "CONSERVATIVE":
        return base.where("block_no = 0").select("column_id", "eq", "other")
    if how == "LIBERAL":
        return base.select("column_id", "eq", "other")
    own = columns.select("column_id", F.col("eq").alias("other"), F.lit(1).alias("in"))
    n = classes.select(F.col("eq").alias("other"), "n_terms")
    s = base.join(n, "other").join(own, ["column_id", "other"], "left")
    score = s.groupBy("column_id", "eq", "block_no").agg((F.sum(F.when(F.col("in") == 1, F.col("n_terms")).otherwise(0)) / F.sum("n_terms")).alias("score"))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values(["score", "block_no"], ascending=[False, True])
        v = r["score"].tolist()
        end = steepest_drop(v, 0, -1.0, False, False)[0]
        r = r.iloc[:end]
        return r[r["score"] > 0][["column_id", "eq", "block_no"]]

    kept = score.groupBy("column_id", "eq").applyInPandas(pick, "column_id int, eq long, block_no int")
    return base.join(kept, ["column_id", "eq", "block_no"]).select("column_id", "eq", "other")


def expand(signature: DataFrame, classes: DataFrame, least: float = 0.25, decrease: float = 0.05, iterations: int = 5, how: str = "CENTRIST") -> DataFrame:
    """column_id, eq, round (0 for the column's own classes): columns with the classes that their signatures support.

    In round i a class comes in if the terms of the own classes whose signature
    has it are more than least - i * decrease of the own terms, and the terms of
    all classes in the column whose signature has it more than least (not
    decreased) of all.
    """
    size = classes.select("eq", "n_terms")
    own = classes.select("eq", F.explode("columns").alias("c")).select(F.col("c.column_id").alias("column_id"), "eq").distinct()
    state = cut(own.withColumn("round", F.lit(0)))
    for i in range(iterations):
        sig = trimmed(signature, state.select("column_id", "eq"), classes, how)
        tot = state.join(size, "eq").groupBy("column_id").agg(F.sum(F.when(F.col("round") == 0, F.col("n_terms"))).alias("own_n"), F.sum("n_terms").alias("all_n"))
        sup = sig.join(state.select("column_id", F.col("eq").alias("other"), F.lit(1).alias("in")), ["column_id", "other"], "left_anti")
        sup = sup.join(state.select("column_id", "eq", "round"), ["column_id", "eq"]).join(size, "eq").groupBy("column_id", "other").agg(F.coalesce(F.sum(F.when(F.col("round") == 0, F.col("n_terms"))), F.lit(0)).alias("o"), F.sum("n_terms").alias("a"))
        first = round(least - i * decrease, 12)
        new = sup.join(tot, "column_id").where((F.round(F.col("o") / F.col("own_n"), 12) > first) & (F.round(F.col("a") / F.col("all_n"), 12) > least)).select("column_id", F.col("other").alias("eq"), F.lit(i + 1).alias("round"))
        new = cut(new)
        if new.isEmpty():
            break
        state = cut(state.unionByName(new))
    return state


def local_domains(expanded: DataFrame, signature: DataFrame, classes: DataFrame, how: str = "CENTRIST") -> DataFrame:
    """domain_id, column_id, eq: connected classes of each (expanded) column.

    Classes are linked if one's trimmed signature has the other.  A component
    is a domain if it holds a class of the column itself and more than one
    class or term.  Equal domains of several columns are one (domain_id is its
    smallest column and class).
    """
    sig = trimmed(signature, expanded.select("column_id", "eq"), classes, how)
    inside = sig.join(expanded.select("column_id", F.col("eq").alias("other")), ["column_id", "other"], "left_semi")
    node = lambda c: F.concat_ws(":", F.lpad(F.col("column_id").cast("string"), 9, "0"), F.lpad(F.col(c).cast("string"), 18, "0"))
    comp = components(inside.select(node("eq").alias("a"), node("other").alias("b")), expanded.select(node("eq").alias("node")))
    m = expanded.join(classes.select("eq", "n_terms"), "eq").withColumn("node", node("eq")).join(comp, "node")
    good = m.groupBy("component").agg(F.max((F.col("round") == 0).cast("int")).alias("own"), F.count(F.lit(1)).alias("k"), F.sum("n_terms").alias("t")).where("own = 1 and (k > 1 or t > 1)")
    m = m.join(good.select("component"), "component", "left_semi")
    # Equal sets of classes are one domain: told by an order-free hash of the members and their number.
    key = m.groupBy("component").agg(F.sum(F.xxhash64("eq").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("k"))
    same = key.groupBy("h", "k").agg(F.min("component").alias("domain_id"))
    return m.join(key, "component").join(same, ["h", "k"]).select("domain_id", "column_id", "eq").distinct()


def domain_overlap(domains: DataFrame, classes: DataFrame) -> DataFrame:
    """a < b, sim: Jaccard of the domains by the terms of their classes."""
    d = domains.select("domain_id", "eq").distinct().join(classes.select("eq", "n_terms"), "eq")
    s = d.groupBy("domain_id").agg(F.sum("n_terms").alias("n"))
    d = d.join(s, "domain_id")
    o = d.selectExpr("domain_id a", "n na", "eq", "n_terms").join(d.selectExpr("domain_id b", "n nb", "eq"), "eq").where("a < b").groupBy("a", "b", "na", "nb").agg(F.sum("n_terms").alias("o"))
    return o.select("a", "b", jaccard(F.col("na"), F.col("nb"), F.col("o")).alias("sim"))


def strong_domains(domains: DataFrame, classes: DataFrame, overlap: str = "GT0.5", support: str = "GT0.1", fraction: float = 0.25) -> DataFrame:
    """strong_id, domain_id: groups of overlapping local domains that enough columns support.

    A domain's frequency is the number of other columns among its own and those
    of the domains that pass support; it is strong if the columns of the
    domains that pass overlap are at least floor(frequency * fraction) + 1 of them.
    """
    sims = cut(domain_overlap(domains, classes))
    cols = domains.select("domain_id", "column_id").distinct()
    both = sims.unionByName(sims.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))

    def others(spec: str, out: str) -> DataFrame:
        near = both.where(threshold(spec)(F.col("sim"))).select(F.col("a").alias("domain_id"), "b")
        c = near.join(cols.withColumnRenamed("domain_id", "b"), "b").select("domain_id", "column_id").unionByName(cols).distinct()
        return c.groupBy("domain_id").agg((F.count(F.lit(1)) - 1).alias(out))

    d = others(support, "freq").join(others(overlap, "near"), "domain_id").where(F.col("near") >= F.floor(F.col("freq") * fraction) + 1).select("domain_id")
    d = cut(d)
    e = sims.where(threshold(overlap)(F.col("sim"))).join(d.withColumnRenamed("domain_id", "a"), "a", "left_semi").join(d.withColumnRenamed("domain_id", "b"), "b", "left_semi")
    return components(e.select("a", "b"), d).select(F.col("component").alias("strong_id"), F.col("node").alias("domain_id"))


def strong_weights(strong: DataFrame, domains: DataFrame) -> DataFrame:
    """strong_id, eq, weight: in how much of the strong domain's columns the class is."""
    m = strong.join(domains, "domain_id")
    total = m.groupBy("strong_id").agg(F.countDistinct("column_id").alias("c"))
    return m.groupBy("strong_id", "eq").agg(F.countDistinct("column_id").alias("k")).join(total, "strong_id").select("strong_id", "eq", F.round(F.col("k") / F.col("c"), 6).alias("weight"))


def exported(weighted: DataFrame, members: DataFrame, index: DataFrame) -> DataFrame:
    """strong_id, block_no, weight, term: the terms of strong domains in blocks of falling weight, parted at steepest drops."""

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values(["weight", "eq"], ascending=[False, True])
        bl = signature_blocks(r["weight"].tolist(), 0.0, True, True)
        out = [(r["strong_id"].iloc[0], k, e, w) for k, (i, j) in enumerate(bl) for e, w in zip(r["eq"].iloc[i:j], r["weight"].iloc[i:j])]
        return pd.DataFrame(out, columns=["strong_id", "block_no", "eq", "weight"])

    b = weighted.groupBy("strong_id").applyInPandas(part, "strong_id string, block_no int, eq long, weight double")
    return b.join(members, "eq").join(index.select("term_id", "term"), "term_id").select("strong_id", "block_no", "weight", "term")


def otsu(sims: DataFrame, bins: int = 100) -> DataFrame:
    """bin, threshold of the greatest variance between the classes that a cut of the similarity histogram makes (ties: the lowest)."""
    h = sims.select(F.least(F.floor(F.col("sim") * bins), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    # At most bins rows.
    w = W.orderBy("bin")
    h = h.withColumn("lo", F.sum("n").over(w)).withColumn("lo_s", F.sum(F.col("n") * F.col("bin")).over(w)).withColumn("all", F.sum("n").over(W.partitionBy())).withColumn("all_s", F.sum(F.col("n") * F.col("bin")).over(W.partitionBy()))
    hi = F.col("all") - F.col("lo")
    var = F.col("lo") * hi * F.pow(F.col("lo_s") / F.col("lo") - F.try_divide(F.col("all_s") - F.col("lo_s"), hi), F.lit(2.0))
    return h.withColumn("v", F.coalesce(var, F.lit(-1.0))).orderBy(F.desc("v"), "bin").limit(1).select("bin", F.round((F.col("bin") + 1) / bins, 6).alias("threshold"))


def best_match(domains: DataFrame, truth: DataFrame) -> DataFrame:
    """truth_id, domain_id, precision, recall, f1 of the best domain for each true set (ties: the smaller domain).

    domains: domain_id, term; truth: truth_id, term.  A true set that shares no
    term with a domain is left out.
    """
    d, t = domains.select("domain_id", "term").distinct(), truth.select("truth_id", "term").distinct()
    dn, tn = d.groupBy("domain_id").agg(F.count(F.lit(1)).alias("dn")), t.groupBy("truth_id").agg(F.count(F.lit(1)).alias("tn"))
    o = d.join(t, "term").groupBy("domain_id", "truth_id").agg(F.count(F.lit(1)).alias("o")).join(dn, "domain_id").join(tn, "truth_id")
    p, r = F.col("o") / F.col("dn"), F.col("o") / F.col("tn")
    s = o.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * p * r / (p + r))
    rank = F.row_number().over(W.partitionBy("truth_id").orderBy(F.desc("f1"), "domain_id"))
    return s.withColumn("k", rank).where("k = 1").select("truth_id", "domain_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
