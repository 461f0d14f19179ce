"""Problem 3: matching records of two systems without a shared key.

The records of both systems are nodes of a graph, with the weighted tokens of
``lines`` (words, stated and completed model codes) as attributes; records of
equal variant and attributes are one node.  The candidate graph joins nodes of
the two systems that have the same variant and share a rare attribute; rare are
the tokens that tell most of a product, chosen before the join.  An edge weighs what the
shared rare attributes weigh, over the weight of the lighter end.

Meta-blocking keeps the edges that are nearly as heavy as the heaviest edge of
either end.  Then similarity spreads: edges are neighbours if their ends have
the same rarest attributes, or the same second rarest, as other variants of one
product line do; every edge is drawn towards the means of its two groups of
neighbours, round after round until no edge moves by more than STILL.  A round
shrinks the moves by PULL, so that the rounds end.

Agreement of brand, price and weight enters the confidence.

Nulls: records without key or title, or with no telling token, match nothing; a
missing brand, price or weight neither helps nor harms.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.lines import blocks, gathered, learn, members, parse, tokens, weighted
from weft.llm.titles import Lexicon
from weft.session import cut, release, table, written

#: Share of the greatest worth that a telling attribute has at least, and share of the records in which a token is frequent.
TELLING, FREQUENT = 0.35, 0.0001
#: Share of the heaviest edge of a node that an edge must weigh to be kept.
KEEP = 0.45
#: Part of a similarity that comes from the neighbouring edges, and the move at which the rounds end.
PULL, STILL = 0.3, 0.001
#: Rounds after which a call fails.
GUARD = 50
#: Least similarity, and least confidence, of a match.
LEAST, SURE = 0.36, 0.33
#: Most edits between two codes one of which may be mistyped.
TYPED = 2


def records(modern: DataFrame, third: DataFrame) -> DataFrame:
    """Both systems' listings: key (with the side before it), title, model, side, brand, price, weight (means of logarithms over the listing's rows)."""
    number = lambda c: F.regexp_extract(F.col(c), r"^\s*\$?\s*([0-9]{1,9}\.[0-9]{1,2})(?![0-9])", 1).try_cast("double")
    log = lambda c: F.avg(F.when(c > 0, F.log(c))).cast("float")
    code = F.regexp_extract("specifications", r'"(?:mpn|part_number|model)": ?"([A-Za-z]{2,4}[- ]?[0-9]{3,5})"', 1)
    a = modern.select(F.lit("a").alias("side"), F.col("asin").alias("key"), "title", "updated_at", "row_no", F.when(code != "", code).alias("model"), F.col("brand"), F.col("current_price").alias("p"), F.col("weight_kg").alias("w"))
    b = third.select(F.lit("b").alias("side"), F.col("item_code").alias("key"), F.col("item_name").alias("title"), "updated_at", "row_no", F.lit(None).cast("string").alias("model"), F.col("brand_name").alias("brand"), number("retail_price").alias("p"), (F.expr("try_cast(item_weight as double)") * 0.45359237).alias("w"))
    rows = a.unionByName(b).where(F.col("key").isNotNull() & (F.trim("key") != "") & F.col("title").isNotNull() & (F.trim("title") != ""))
    last = F.max_by(F.struct("title", "brand"), F.struct("updated_at", "row_no")).alias("x")
    # The key comes first, as rows are sorted by the first column's beginning.
    rows = rows.groupBy("key", "side").agg(last, F.max("model").alias("model"), log(F.col("p")).alias("price"), log(F.col("w")).alias("weight"))
    return rows.select(F.concat_ws(":", "side", "key").alias("key"), "x.title", "model", "side", F.regexp_replace(F.lower("x.brand"), "[^a-z0-9]+", "").alias("brand"), "price", "weight")


def attributes(member: DataFrame, stat: DataFrame, base: float) -> DataFrame:
    """node, block, t (w and h of its telling tokens, the rarest first), total; records without one are left out.

    A token that is frequent and not telling is taken out first, by a broadcast
    of at most 1 / FREQUENT tokens for each word of a title.
    """
    telling = TELLING * math.log(1 / base) ** 2
    rows = member.where("node is not null and code <> ''").count()
    dull = stat.where((F.col("w") < telling) & (F.col("n") >= FREQUENT * F.lit(float(max(1, rows))))).select("h")
    flat = tokens(member.where("node is not null"), "node", "block").join(F.broadcast(dull), "h", "left_anti")
    return gathered(weighted(flat, stat, base).where(F.col("w") >= telling), "node", "block")


def graph(found: DataFrame, keep: float = KEEP) -> DataFrame:
    """Edges x (node of side a), y (node of side b), attr (similarity of their attributes), k1, k2 (groups of neighbours), after meta-blocking.

    found: node (zero or more: side a), block, t, total (``attributes``).
    """
    place = lambda i: F.coalesce(F.get("t", F.lit(i))["h"], F.lit(0)).alias(f"p{i}")
    flat = found.select("node", F.col("total").cast("float").alias("total"), "block", place(0), place(1), F.explode("t").alias("x")).select("node", "total", "p0", "p1", F.xxhash64("block", "x.h").alias("h"), "x.w")
    side = lambda d, c: d.select("h", F.col("w").alias(f"w{c}"), F.col("node").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in ("total", "p0", "p1")])
    edges = side(flat.where("node >= 0"), "x").join(side(flat.where("node < 0"), "y").drop("wy"), "h").select("x", "y", "wx", F.least("total_x", "total_y").alias("least"), F.xxhash64("p0_x", "p0_y").alias("k1"), F.xxhash64("p1_x", "p1_y").alias("k2"))
    edges = cut(edges.groupBy("x", "y", "least", "k1", "k2").agg(F.sum("wx").alias("shared")).select("x", "y", "k1", "k2", (F.col("shared") / F.col("least")).alias("attr")))
    # Meta-blocking: reciprocal weighted node pruning.
    top = lambda c: edges.groupBy(c).agg(F.max("attr").alias(f"top_{c}"))
    return cut(edges.join(top("x"), "x").join(top("y"), "y").where((F.col("attr") >= keep * F.col("top_x")) & (F.col("attr") >= keep * F.col("top_y"))).drop("top_x", "top_y"))


def spread(edges: DataFrame, pull: float = PULL, still: float = STILL, guard: int = GUARD) -> DataFrame:
    """graph() edges -> x, y, sim at the fixed point of the propagation; edges with the same groups and attr move alike and are one row of the rounds."""
    cells = cut(edges.groupBy("k1", "k2", F.round("attr", 6).alias("attr")).agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("sim", F.col("attr")))
    for _ in range(guard):
        mean = lambda k: cells.groupBy(k).agg((F.sum(F.col("n") * F.col("sim")) / F.sum("n")).alias(f"mean_{k}"))
        now = cells.join(mean("k1"), "k1").join(mean("k2"), "k2")
        after = (1 - pull) * F.col("attr") + pull / 2 * (F.col("mean_k1") + F.col("mean_k2"))
        now = cut(now.select("k1", "k2", "attr", "n", after.alias("sim"), F.abs(after - F.col("sim")).alias("move")))
        most = now.agg(F.max("move").alias("m")).first()["m"]
        cells = now.drop("move")
        if most is None or most <= still:
            return edges.withColumn("attr", F.round("attr", 6)).join(cells.select("k1", "k2", "attr", "sim"), ["k1", "k2", "attr"]).select("x", "y", "sim")
    raise RuntimeError(f"similarities still move after {guard} rounds")


def links(modern: DataFrame, third: DataFrame, lexicon: Lexicon | None = None, least: float = LEAST, sure: float = SURE) -> DataFrame:
    """asin, item_code, confidence of every matching pair."""
    if lexicon is None:
        lexicon = learn(modern.select("title").unionByName(third.select(F.col("item_name").alias("title"))))
    since = written()
    member, stat, base = members(blocks(cut(parse(records(modern, third), lexicon, ("side", "brand", "price", "weight")))))
    release(since, member, stat)
    # A node's sign tells its side.
    half = F.shiftrightunsigned("set_id", 1)
    member = member.withColumn("node", F.when(F.col("side") == "a", half).otherwise(-half - 1))
    found = attributes(member, stat, base)
    release(since, member, found)
    pruned = graph(found)
    release(since, member, pruned)
    edges = spread(pruned).where(F.col("sim") >= least)
    end = lambda s, c: member.where(F.col("side") == s).select(F.col("node").alias(c), F.substring("key", 3, 1 << 20).alias(f"key_{s}"), *[F.col(v).alias(f"{v}_{s}") for v in ("code", "brand", "price", "weight")])
    # Two stated codes that differ by more than a slip are different products, whatever else they share.
    typed = (F.col("code_a") == "") | (F.col("code_b") == "") | (F.levenshtein("code_a", "code_b") <= TYPED)
    both = end("a", "x").join(edges, "x").join(end("b", "y"), "y").where(typed)
    close = lambda c, scale: F.coalesce(F.exp(-F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) / scale), F.lit(0.5))
    brand = F.when(F.col("brand_a").isNull() | F.col("brand_b").isNull(), 0.5).when((F.levenshtein("brand_a", "brand_b") <= 2) | F.contains("brand_a", "brand_b") | F.contains("brand_b", "brand_a"), 1.0).otherwise(0.3)
    confidence = F.round(0.7 * F.col("sim") + 0.1 * close("price", 0.5) + 0.1 * close("weight", 0.3) + 0.1 * brand, 4)
    return both.select(F.col("key_a").alias("asin"), F.col("key_b").alias("item_code"), confidence.alias("confidence")).where(F.col("confidence") >= sure)


def p3_links(spark, folder):
    return links(table(spark, folder, "modern_products"), table(spark, folder, "third_system_products"))


def p3_found(spark, folder):
    return p3_links(spark, folder).select("asin", "item_code")
