"""Problem 9: mixing sources to target weights.

Sizes are tokens of a public tokenizer.  The mix is as large as the shares
allow: its size T is the largest with share * T <= max_repeats * size for every
source that has text.  Source s then gives share * T tokens: each document as
often as the whole passes fit, and once more those that come first in a fixed
pseudo-random order of the source, until the share is filled (the document on
the edge is taken, so that a source is over by less than one document).

The source's tokens form a stream that is cut into blocks of one size.  Pfair
scheduling orders the blocks: block k of a source of weight w is released at
slot floor(k / w) and due at slot ceil((k + 1) / w); in every slot the released
block with the earliest deadline is taken (ties: the heavier source, then the
name).  After any number of slots a source is less than one block off its
weight.  The number of slots is a parameter, so that the schedule is small
whatever the size of the corpus.

Defined results: null, empty and blank-only texts without tokens have no size
and no place in the mix; sources without target, or with a share of null or 0,
have none either; a target without text is reported with actual share 0 and
the others share the mix by their weights; max_repeats null counts as 1 and
below 1 as 0, which takes the source out of the mix.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.encoding import token_count
from weft.session import cut, running_total, table

#: Slots of the schedule, and so the most rows that are broadcast.
SLOTS = 20_000
SPAN = 1 << 62


def pfair(weights: dict[str, float], slots: int) -> list[tuple[int, str, int]]:
    """(slot, source, block of the source) for every slot.

    Weights are scaled to add up to 1.  Exact fractions keep releases and
    deadlines free of rounding.
    """
    total = sum(Fraction(w).limit_denominator(10**9) for w in weights.values() if w > 0)
    share = {s: Fraction(w).limit_denominator(10**9) / total for s, w in weights.items() if w > 0}
    if not share:
        return []
    waiting = [(0, s, 0) for s in share]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((k + 1) / share[s]), -share[s], s, k))
        if not ready:
            # Rounding of windows leaves no slot idle while weights add up to 1; kept for a single source of weight 1.
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((k + 1) / share[s]), -share[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        out.append((slot, s, k))
        heapq.heappush(waiting, (math.floor((k + 1) / share[s]), s, k + 1))
    return out


def sized(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, source, tokens of the documents whose source is a target; targets is a small fixed table."""
    names = [r["source"] for r in targets.select("source").where("source is not null and target_share > 0").distinct().collect()]
    docs = documents.where(F.col("source").isin(names) & F.col("doc_id").isNotNull()).select("doc_id", "source", token_count(F.col("text")).alias("tokens"))
    return docs.where("tokens > 0")


def plan(sizes: DataFrame, targets: DataFrame) -> tuple[list[dict], float]:
    """A row for each target (source, share, max_repeats, size, docs, budget), and the size of the mix."""
    have = {r["source"]: r for r in sizes.groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("docs"), F.max("tokens").alias("longest")).collect()}
    rows = []
    for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").collect():
        h = have.get(r["source"])
        rows.append({"source": r["source"], "target": float(r["share"] or 0.0), "cap": max(0, 1 if r["cap"] is None else int(r["cap"])), "size": int(h["size"]) if h else 0, "docs": int(h["docs"]) if h else 0})
    live = [r for r in rows if r["target"] > 0 and r["size"] > 0 and r["cap"] > 0]
    total = sum(r["target"] for r in live)
    mix = min((r["cap"] * r["size"] * total / r["target"] for r in live), default=0.0)
    for r in rows:
        r["weight"] = r["target"] / total if r in live else 0.0
        r["budget"] = math.floor(r["weight"] * mix + 1e-6)
    return rows, mix


def ranges(rows: list[dict]) -> int:
    """Hash ranges of the prefix sums: at most about half a million documents of a source in each."""
    return max(256, max((r["docs"] for r in rows), default=0) // 500_000)


def mix(documents: DataFrame, targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, copy (from 1), tokens, slot, place (order inside the slot's block: tokens of the source before the row).

    Rows in the order of slot and place are the mix.
    """
    sizes = cut(sized(documents, targets))
    rows, total = plan(sizes, targets)
    spark = documents.sparkSession
    live = [r for r in rows if r["budget"] > 0]
    schema = "source string, size long, budget long"
    small = F.broadcast(spark.createDataFrame([(r["source"], r["size"], r["budget"]) for r in live], schema))
    order = F.xxhash64("source", "doc_id").bitwiseAND(F.lit(SPAN - 1))
    docs = running_total(sizes.join(small, "source"), ["source"], order, "tokens", "before", ranges(rows))
    # The mix of a source is its stream, passed again and again, up to its budget.
    copies = F.sequence(F.lit(0), F.floor((F.col("budget") - F.col("before") - 1) / F.col("size")))
    taken = docs.where("before < budget").select("doc_id", "source", "tokens", "before", "size", "budget", F.explode(copies).alias("k"))
    taken = taken.withColumn("place", F.col("before") + F.col("k") * F.col("size"))
    block = max(1, math.ceil(total / max(1, slots)))
    times = spark.createDataFrame(pfair({r["source"]: r["budget"] for r in live}, slots) or [], "slot int, source string, block int")
    last = times.groupBy("source").agg(F.max("block").alias("last"))
    taken = taken.join(F.broadcast(last), "source").withColumn("block", F.least(F.floor(F.col("place") / block).cast("int"), F.col("last")))
    out = taken.join(F.broadcast(times), ["source", "block"])
    return out.select("doc_id", "source", (F.col("k") + 1).cast("int").alias("copy"), "tokens", "slot", "place")


def shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: source, target_share, actual_share, tokens (in the mix), available (tokens of the source), documents, copies, most_copies, max_repeats."""
    sizes = cut(sized(documents, targets))
    rows, _ = plan(sizes, targets)
    live = [(r["source"], r["size"], r["budget"]) for r in rows if r["budget"] > 0]
    spark = documents.sparkSession
    order = F.xxhash64("source", "doc_id").bitwiseAND(F.lit(SPAN - 1))
    small = F.broadcast(spark.createDataFrame(live, "source string, size long, budget long"))
    docs = running_total(sizes.join(small, "source"), ["source"], order, "tokens", "before", ranges(rows))
    n = F.greatest(F.lit(0), F.floor((F.col("budget") - F.col("before") - 1) / F.col("size")) + 1)
    got = docs.withColumn("n", n).groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).cast("long").alias("tokens"), F.sum("n").cast("long").alias("copies"), F.max("n").cast("int").alias("most_copies"))
    want = spark.createDataFrame([(r["source"], r["target"], r["cap"], r["size"], r["docs"]) for r in rows], "source string, target_share double, max_repeats int, available long, documents long")
    got = want.join(F.broadcast(got), "source", "left").na.fill(0, ["tokens", "copies", "most_copies"])
    return got.withColumn("actual_share", F.round(F.coalesce(F.try_divide("tokens", F.sum("tokens").over(W.partitionBy(F.lit(1)))), F.lit(0.0)), 6)).select("source", "target_share", "actual_share", "tokens", "available", "documents", "copies", "most_copies", "max_repeats")


def p9_mix(spark, folder):
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark, folder):
    return shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
