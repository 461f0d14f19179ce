"""Duplicate records: blocks, candidate pairs, similarity, clusters, golden records.

Equal records are merged before pairs are made, so that copies cost nothing;
candidates come from an equi-join on block keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import metrics, text
from weft.operators.graph import components
from weft.session import cut, exact_quantile, grouped_quantiles

#: Records in a part of a block, records and pairs that are work for one task, and most tasks.
PART, WORK, TASKS = 500, 100_000, 2000
#: Records of a similarity above this are one.
SIMILAR = 0.8


def id_block(c: Column) -> Column:
    """First ten signs of an identifier; "no_id" without one."""
    return F.coalesce(F.substring(c, 1, 10), F.lit("no_id"))


def text_block(c: Column) -> Column:
    """First three words joined by "_", thirty signs at most; "no_text" without text."""
    words = F.filter(F.split(c, text.SPACE), lambda w: w != "")
    return F.when(F.coalesce(c, F.lit("")) == "", "no_text").otherwise(F.substring(F.array_join(F.slice(words, 1, 3), "_"), 1, 30))


def number_blocks(df: DataFrame, column: str, out: str) -> DataFrame:
    """low, medium or high by the exact quartiles of a column, "nan" for null; equal quartiles give one block, "medium"."""
    q = {"a": exact_quantile(df, column, 0.25), "b": exact_quantile(df, column, 0.75)}
    c = F.col(column)
    if q["a"] is None or q["a"] == q["b"]:
        return df.withColumn(out, F.when(c.isNull(), "nan").otherwise("medium"))
    return df.withColumn(out, F.when(c.isNull(), "nan").when(c <= q["a"], "low").when(c <= q["b"], "medium").otherwise("high"))


def candidate_pairs(records: DataFrame, key: str, blocks: list[str]) -> DataFrame:
    """a < b, block_key: pairs that share a block, each once, with the first blocking that has it.

    Only blocks of more than one record are joined; the placeholders of missing
    values are no block.
    """
    order = {b: i for i, b in enumerate(blocks)}
    flat = records.select(F.col(key).alias("k"), F.explode(F.array(*[F.struct(F.lit(order[b]).alias("i"), F.lit(b).alias("name"), F.col(b).alias("v")) for b in blocks])).alias("x")).select("k", "x.*").where("v is not null and v not in ('no_id', 'no_text', 'nan')")
    many = flat.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "v")
    flat = flat.join(many, ["i", "v"], "left_semi")
    p = flat.selectExpr("k a", "i", "name", "v").join(flat.selectExpr("k b", "i", "v"), ["i", "v"]).where("a < b")
    return p.groupBy("a", "b").agg(F.min_by("name", "i").alias("block_key"))


def with_sides(pairs: DataFrame, records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs a, b with the columns of both records, as c_a and c_b."""
    side = lambda s: records.select(F.col(key).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[c for c in pairs.columns if c not in ("a", "b")], *[f"{c}_{s}" for c in columns for s in "ab"])


def paired(records: DataFrame, key: str, blocks: list[str], columns: list[str]) -> DataFrame:
    """The pairs of candidate_pairs with the columns of both records, as c_a and c_b, in one join.

    Records carry their columns and blocks into the join, so that a pair is made
    by the first blocking that has it only and nothing is looked up by pair.  A
    block of more than PART records is dealt out to parts, and the pairs of two
    parts are the work of one task.  Keys that stand for several records
    (which the join of candidate_pairs mixes) take the two joins.
    """
    records = records.where(F.col(key).isNotNull())
    if not records.groupBy(key).count().where("count > 1").isEmpty():
        return with_sides(candidate_pairs(records, key, blocks), records, key, columns).drop("block_key")
    known = [F.when(~F.col(b).isin("no_id", "no_text", "nan"), F.col(b)).alias(f"__v{i}") for i, b in enumerate(blocks)]
    rows = records.select(F.col(key).alias("__k"), *columns, *known)
    flat = rows.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), F.col(f"__v{i}").alias("__v")) for i in range(len(blocks))])).alias("x")).select("*", "x.*").drop("x").where("__v is not null")
    many = cut(flat.groupBy("__i", "__v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    tasks = 1 + int((many.agg(F.sum("n") + F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0) / WORK)
    parts = many.select("__i", "__v", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    flat = flat.join(parts, ["__i", "__v"]).withColumn("__p", F.pmod(F.xxhash64("__k"), "parts").cast("int"))
    on = ["__i", "__v", "__p", "__q"]
    # The number is stated, as the planner goes by the bytes read, not by the pairs made of them.
    side = lambda s, p, q: flat.select("__i", "__v", p.alias("__p"), q.alias("__q"), *[F.col(c).alias(f"{c}_{s}") for c in ["__k", *columns, *[f"__v{i}" for i in range(len(blocks) - 1)]]]).repartition(min(TASKS, tasks), *on)
    x = side("x", F.col("__p"), F.explode(F.sequence("__p", F.col("parts") - 1)))
    y = side("y", F.explode(F.sequence(F.lit(0), "__p")), F.col("__p"))
    p = x.join(y, on).where("__p < __q or __k_x < __k_y")
    for i in range(len(blocks) - 1):
        p = p.where((F.col("__i") <= i) | ~F.coalesce(F.col(f"__v{i}_x") == F.col(f"__v{i}_y"), F.lit(False)))
    ordered = F.col("__k_x") < F.col("__k_y")
    both = lambda c, a, b: [F.when(ordered, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")).alias(a), F.when(ordered, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")).alias(b)]
    return p.select(*both("__k", "a", "b"), *[e for c in columns for e in both(c, f"{c}_a", f"{c}_b")])


def similar_pairs(records: DataFrame, key: str, blocks: list[str], texts: dict[str, float], numbers: dict[str, float], above: float | None = None) -> DataFrame:
    """a, b, sim of the candidate pairs: the weighted mean of the columns' similarities; a column that is null or empty on either side does not count.

    With above, only pairs of a similarity above it: texts of a pair whose
    numbers are so far apart that equal texts would not do are not compared.
    """
    words = {f"{c}__words": F.array_distinct(F.split(c, " ")) for c in texts}
    p = paired(records.withColumns(words), key, blocks, [*texts, *words, *numbers])
    for c in numbers:
        p = p.withColumn(f"__{c}", metrics.numeric_similarity(F.col(f"{c}_a"), F.col(f"{c}_b")))
    ok = {c: F.coalesce((F.col(f"{c}_a") != "") & (F.col(f"{c}_b") != ""), F.lit(False)) for c in texts}

    def mean(of) -> Column:
        total, weight = F.lit(0.0), F.lit(0.0)
        for c, w in {**texts, **numbers}.items():
            total = total + F.coalesce(of(c) * w, F.lit(0.0))
            weight = weight + F.when(of(c).isNotNull(), w).otherwise(0.0)
        return F.coalesce(F.try_divide(total, weight), F.lit(0.0))

    if above is not None:
        p = p.where(mean(lambda c: F.when(ok[c], 1.0) if c in texts else F.col(f"__{c}")) > above - 1e-6)
    for c in texts:
        p = p.withColumn(f"__{c}", F.when(ok[c], metrics.text_similarity(F.col(f"{c}_a"), F.col(f"{c}_b"), F.col(f"{c}__words_a"), F.col(f"{c}__words_b"), metrics.set_jaccard)))
    p = p.select("a", "b", F.round(mean(lambda c: F.col(f"__{c}")), 6).alias("sim"))
    return p if above is None else p.where(F.col("sim") > above)


def clusters(pairs: DataFrame, records: DataFrame, key: str, least: float = SIMILAR) -> DataFrame:
    """node, component of the pairs above least; records without a partner are their own."""
    return components(pairs.where(F.col("sim") > least).select("a", "b"), records.select(key))


def golden_records(df: DataFrame, group: str, order: str, numbers: list[str], texts: list[str]) -> DataFrame:
    """One record per group: source_records, medians of numbers, of texts the longest of more than three signs, else the first that is not blank (ties: the first in order)."""
    of = lambda c: F.trim(F.col(c))
    long_ = lambda c: F.max_by(of(c), F.when(F.length(of(c)) > 3, F.struct(F.length(of(c)), -F.col(order))))
    first = lambda c: F.min_by(of(c), F.when(of(c) != "", F.col(order)))
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("source_records"), *[F.coalesce(long_(c), first(c)).alias(c) for c in texts])
    for c in numbers:
        m = grouped_quantiles(df, [group], c, 0.5, c).withColumnRenamed(group, "__g")
        out = out.join(m, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    return out


def minhash_pairs(df: DataFrame, key: str, column: str, distance: float = 0.5, tables: int = 16) -> DataFrame:
    """a < b, distance: pairs of texts whose three-letter shingles are near by MinHash buckets, with the exact Jaccard distance."""
    from pyspark.ml.feature import HashingTF, MinHashLSH

    d = df.where(F.length(column) >= 3).select(F.col(key).alias("k"), F.transform(F.sequence(F.lit(1), F.length(column) - 2), lambda i: F.substring(F.col(column), i, 3)).alias("s"))
    v = HashingTF(inputCol="s", outputCol="v", numFeatures=1 << 18, binary=True).transform(d).select("k", "v")
    m = MinHashLSH(inputCol="v", outputCol="h", numHashTables=tables, seed=7).fit(v)
    return m.approxSimilarityJoin(v, v, distance, "distance").select(F.col("datasetA.k").alias("a"), F.col("datasetB.k").alias("b"), F.round("distance", 6).alias("distance")).where("a < b")


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")
