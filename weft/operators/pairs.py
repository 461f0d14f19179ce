"""Pairs of distinct strings.

The inputs are columns of strings; they are made distinct first, so that the
work depends on the number of different strings, not of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.metrics import levenshtein_similarity
from weft.session import cut

#: Strings in a tile of every_pair, and most tasks for all pairs of tiles.
TILE, TASKS = 500, 2000


def block_pairs(values: DataFrame, column: str, block: Column) -> DataFrame:
    """a < b of one block, each pair once; null values and blocks have no pairs."""
    v = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), block.alias("k")).where("k is not null")
    return v.select(F.col("v").alias("a"), "k").join(v.select(F.col("v").alias("b"), "k"), "k").where("a < b").select("a", "b").distinct()


def every_pair(values: DataFrame) -> DataFrame:
    """All pairs a < b of the distinct strings: for small vocabularies such as column or category names.

    The strings are dealt out to tiles, so that the pairs of two tiles are the
    work of one task.
    """
    v = cut(values.where("v is not null").select("v").distinct())
    tiles = max(1, -(-v.count() // TILE))
    v = v.select("v", F.pmod(F.xxhash64("v"), F.lit(tiles)).cast("int").alias("t"))
    # The number is stated, as the planner would make one task of rows so few.
    dealt = lambda c, p, q: v.select(F.col("v").alias(c), p.alias("p"), q.alias("q")).repartition(min(TASKS, tiles * (tiles + 1) // 2), "p", "q")
    x = dealt("x", F.col("t"), F.explode(F.sequence(F.col("t"), F.lit(tiles - 1))))
    y = dealt("y", F.explode(F.sequence(F.lit(0), F.col("t"))), F.col("t"))
    pairs = x.hint("shuffle_hash").join(y, ["p", "q"]).where("p < q and x <> y or x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_strings(values: DataFrame, least: float) -> DataFrame:
    """a < b with Levenshtein similarity of at least least (> 0).

    Two strings of similarity s differ by at most (1 - s) of the longer length,
    so that their lengths do too, and one of k + 1 equal parts of the shorter
    stands in the other unchanged, at most k places off (k edits).  Strings are
    joined on length, part and place, and the distance is then computed.
    """
    v = values.where("v is not null and v <> ''").select("v").distinct().withColumn("n", F.length("v"))
    edits = lambda n: F.floor(n * (1 - least) + F.lit(1e-9)).cast("int")
    # The shorter string of n signs allows k edits for a partner of m >= n signs.
    probe = v.select(F.col("v").alias("x"), F.col("n"), F.explode(F.sequence(F.col("n"), F.floor(F.col("n") / least + F.lit(1e-9)).cast("int"))).alias("m")).withColumn("k", edits(F.col("m")))
    parts = F.least(F.col("k") + 1, F.col("n"))
    probe = probe.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    start = F.floor(F.col("i") * F.col("n") / F.col("parts")).cast("int")
    end = F.floor((F.col("i") + 1) * F.col("n") / F.col("parts")).cast("int")
    probe = probe.select("x", "m", "k", F.substring("x", start + 1, end - start).alias("g"), start.alias("s"))
    probe = probe.withColumn("p", F.explode(F.sequence(F.greatest(F.lit(0), F.col("s") - F.col("k")), F.least(F.col("s") + F.col("k"), F.col("m") - F.length("g"))))).drop("s", "k")
    sizes = probe.select("m", F.length("g").alias("len")).distinct()
    index = v.select(F.col("v").alias("y"), F.col("n").alias("m")).join(sizes, "m").select("y", "m", "len", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("len"))).alias("p")).select("y", "m", "p", F.substring("y", F.col("p") + 1, F.col("len")).alias("g"))
    found = probe.join(index, ["m", "p", "g"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return found.withColumn("sim", levenshtein_similarity(F.col("a"), F.col("b"), least)).where("sim is not null").select("a", "b", F.round("sim", 6).alias("sim"))


def token_pairs(values: DataFrame) -> DataFrame:
    """a < b with at least one word in common, and the Jaccard similarity of their words: an inverted index, no all-pairs comparison."""
    v = values.where("v is not null").select("v").distinct().withColumn("t", F.array_distinct(F.split("v", " ")))
    w = v.select("v", F.size("t").alias("n"), F.explode("t").alias("w"))
    c = w.selectExpr("v a", "n na", "w").join(w.selectExpr("v b", "n nb", "w"), "w").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("o"))
    return c.select("a", "b", (F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).alias("sim"))
