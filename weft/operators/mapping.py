"""Further ways to map columns and align clusterings, over column profiles."""

from __future__ import annotations

import time
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import metrics
from weft.functions.text import name_tokens, run_pattern
from weft.operators.matching import pairs_of_columns, upgma, value_overlap

RATIOS = ["alpha_ratio", "digit_ratio", "special_ratio", "space_ratio", "unique_ratio"]


def pattern_similarity() -> Column:
    """Mean closeness of the ratios of two columns' profiles."""
    return sum((1 - F.abs(F.col(f"{r}_a") - F.col(f"{r}_b")) for r in RATIOS), F.lit(0.0)) / len(RATIOS)


def data_driven(columns: DataFrame, samples: DataFrame | None = None, least: float = 0.4) -> DataFrame:
    """a, column_a, b, column_b, sim: reciprocal best matches by 0.8 name, 0.05 type, 0.05 pattern, 0.1 value overlap.

    samples: dataset, column, values (array); columns without samples overlap 0.
    """
    c = columns if samples is None else columns.join(samples, ["dataset", "column"], "left")
    if samples is None:
        c = c.withColumn("values", F.array().cast("array<string>"))
    p = pairs_of_columns(c)
    name = metrics.array_jaccard(name_tokens(F.col("column_a")), name_tokens(F.col("column_b"))) * 0.5 + 0.5 * metrics.difflib_ratio(F.lower("column_a"), F.lower("column_b"))
    overlap = value_overlap(F.coalesce("values_a", F.array().cast("array<string>")), F.coalesce("values_b", F.array().cast("array<string>")))
    p = p.withColumn("sim", F.round(0.8 * name + 0.05 * metrics.type_compatibility(F.col("type_a"), F.col("type_b")) + 0.05 * pattern_similarity() + 0.1 * overlap, 6)).where(F.col("sim") >= least)
    wa = W.partitionBy("a", "column_a", "b").orderBy(F.desc("sim"), "ordinal_b")
    wb = W.partitionBy("b", "column_b", "a").orderBy(F.desc("sim"), "ordinal_a")
    return p.withColumn("ka", F.row_number().over(wa)).withColumn("kb", F.row_number().over(wb)).where("ka = 1 and kb = 1").select("a", "column_a", "b", "column_b", "sim")


def closest(columns: DataFrame, k: int = 3, least: float = 0.3) -> DataFrame:
    """a, column_a, rank, b, column_b, sim: the k most similar columns of other tables of every column."""
    p = pairs_of_columns(columns)
    sim = F.round(0.5 * metrics.difflib_ratio(F.lower("column_a"), F.lower("column_b")) + 0.3 * metrics.array_jaccard(name_tokens(F.col("column_a")), name_tokens(F.col("column_b"))) + 0.2 * metrics.type_compatibility(F.col("type_a"), F.col("type_b"), 0.85, 0.2, 0.1), 6)
    p = p.withColumn("sim", sim).where(F.col("sim") >= least).select("a", "column_a", "b", "column_b", "sim")
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("column_b").alias("column_a"), F.col("a").alias("b"), F.col("column_a").alias("column_b"), "sim"))
    w = W.partitionBy("a", "column_a").orderBy(F.desc("sim"), "b", "column_b")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def column_clusters(columns: DataFrame, least: float = 0.5) -> list[list[str]]:
    """Average-linkage clusters of columns by 0.3 name, 0.2 type, 0.25 pattern, 0.15 uniqueness, 0.1 length of the table; cut at least."""
    p = pairs_of_columns(columns)
    width = columns.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    p = p.join(width.selectExpr("dataset a", "n na"), "a").join(width.selectExpr("dataset b", "n nb"), "b")
    context = 1 - F.abs(F.col("na") - F.col("nb")) / F.greatest("na", "nb")
    sim = 0.3 * metrics.difflib_ratio(F.lower("column_a"), F.lower("column_b")) + 0.2 * metrics.type_compatibility(F.col("type_a"), F.col("type_b")) + 0.25 * pattern_similarity() + 0.15 * (1 - F.abs(F.col("unique_ratio_a") - F.col("unique_ratio_b"))) + 0.1 * context
    rows = p.select(F.concat_ws(".", "a", "column_a").alias("x"), F.concat_ws(".", "b", "column_b").alias("y"), sim.alias("s")).collect()
    names = [r[0] for r in columns.select(F.concat_ws(".", "dataset", "column")).collect()]
    return upgma(names, {(r["x"], r["y"]): r["s"] for r in rows}, least)


def golden_name(names: list[str]) -> str:
    """The shortest name of the largest group of names with equally many "_" (ties: fewer "_", then the order of names)."""
    by: dict[int, list[str]] = {}
    for n in names:
        by.setdefault(n.count("_"), []).append(n)
    group = by[min(by, key=lambda k: (-len(by[k]), k))]
    return min(group, key=lambda n: (len(n), n))


def dominant_names(columns: DataFrame) -> DataFrame:
    """kind, part, n, share: first and last words of a fifth of the columns, neighbours of a tenth, and run patterns borne more than once."""
    t = columns.select("column", name_tokens(F.col("column")).alias("t"))
    n = F.lit(float(max(1, columns.count())))
    two = F.when(F.size("t") >= 2, F.concat_ws("_", F.element_at("t", -2), F.element_at("t", -1)))
    parts = t.select(F.explode(F.array(F.struct(F.lit("prefix").alias("kind"), F.element_at("t", 1).alias("part")), F.struct(F.lit("suffix").alias("kind"), F.element_at("t", -1).alias("part")), F.struct(F.lit("compound").alias("kind"), two.alias("part")), F.struct(F.lit("pattern").alias("kind"), run_pattern(F.col("column")).alias("part")))).alias("x")).select("x.*").where("part is not null")
    g = parts.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / n, 6))
    return g.where(((F.col("kind").isin("prefix", "suffix")) & (F.col("share") > 0.2)) | ((F.col("kind") == "compound") & (F.col("share") > 0.1)) | ((F.col("kind") == "pattern") & (F.col("n") > 1)))


def alignment(first: list[list[str]], second: list[list[str]]) -> tuple[float, str]:
    """Mean best Jaccard of two clusterings' clusters, and which way of grouping it speaks for."""
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    s = float(np.mean([max((j(a, b) for b in second), default=0.0) for a in first])) if first else 0.0
    return s, "aligned" if s >= 0.7 else "different"


def insights(confidences: list[float]) -> list[str]:
    """What a mapping's confidences say: how many are high (0.8) or medium (0.6), and whether they need a look."""
    if not confidences:
        return ["nothing is mapped"]
    high, medium = sum(c >= 0.8 for c in confidences), sum(0.6 <= c < 0.8 for c in confidences)
    out = [f"{high} of {len(confidences)} mappings are sure, {medium} likely"]
    if high + medium < len(confidences):
        out.append(f"{len(confidences) - high - medium} mappings need a look")
    return out


class Telemetry:
    """Milliseconds of named stages."""

    def __init__(self):
        self.ms: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield self
        finally:
            self.ms[name] = self.ms.get(name, 0.0) + 1000 * (time.perf_counter() - began)
