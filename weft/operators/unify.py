"""Bringing tables of one entity under one schema and merging them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Synonyms of the types that a harmonised column can have.
TYPES = {"int": "bigint", "integer": "bigint", "bigint": "bigint", "float": "double", "double": "double", "numeric": "double", "str": "string", "string": "string", "object": "string", "datetime": "timestamp", "timestamp": "timestamp", "date": "timestamp", "bool": "boolean", "boolean": "boolean"}
# Wordings of true.
TRUE = ("true", "yes", "y", "1", "t")
#: Pairs of types that go together without conversion.
COMPATIBLE = {("int", "bigint"), ("bigint", "int"), ("float", "double"), ("double", "float"), ("string", "varchar"), ("varchar", "string")}


def needs_conversion(have: str, want: str) -> bool:
    """Whether a column of one type must be converted to hold another."""
    return have != want and (have, want) not in COMPATIBLE


def convert(c: Column, have: str, want: str) -> Column:
    """A column of type have as one of the synonyms in TYPES; what does not fit becomes null.

    Texts are true if they say so and false otherwise; a null stays null.
    """
    want = TYPES.get(want, want)
    if want == "boolean":
        return F.lower(F.trim(c)).isin(*TRUE) if have == "string" else c.try_cast("boolean")
    if want == "timestamp" and have == "string":
        return F.try_to_timestamp(c)
    if want == "bigint" and have == "string":
        return F.round(c.try_cast("double")).try_cast("bigint")
    return c.try_cast(want)


@dataclass
class Plan:
    """How a table becomes one of the golden schema: renames (old to new), types (golden name to type)."""

    types: dict[str, str]
    renames: dict[str, str] = field(default_factory=dict)
    source: str = "unknown"
    cluster: int = 0


def harmonise(df: DataFrame, plan: Plan) -> DataFrame:
    """Golden columns in order (absent ones null, all of the golden types), _source_file, _cluster_id, then the unmapped columns."""
    df = df.withColumnsRenamed({a: b for a, b in plan.renames.items() if a in df.columns})
    kinds = dict(df.dtypes)
    golden = [(convert(F.col(f"`{c}`"), kinds[c], t) if c in kinds else F.lit(None).cast(TYPES.get(t, t))).alias(c) for c, t in plan.types.items()]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in plan.types]
    return df.select(*golden, F.lit(plan.source).alias("_source_file"), F.lit(plan.cluster).alias("_cluster_id"), *rest)


def horizontal(tables: list[DataFrame]) -> DataFrame:
    """All rows under all columns, absent ones null, columns in the order of their names."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out.select(*[f"`{c}`" for c in sorted(out.columns)])


def merge_key(tables: list[DataFrame], golden: list[str]) -> str | None:
    """The first golden column that all tables have."""
    return next((c for c in golden if all(c in t.columns for t in tables)), None)


def vertical(tables: list[DataFrame], key: str) -> DataFrame:
    """Full outer joins on the key, one after the other; columns that clash bear the number of their table."""
    seen: dict[str, int] = {}
    for t in tables:
        for c in t.columns:
            seen[c] = seen.get(c, 0) + 1
    named = [t.select(*[F.col(c).alias(c if c == key or seen[c] == 1 else f"{c}_{i}") for c in t.columns]) for i, t in enumerate(tables)]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), named)


def coalesced(df: DataFrame, names: list[str]) -> DataFrame:
    """One column for name, name_0, name_1, ...: the first that is not null."""
    out = df
    for n in names:
        parts = [c for c in df.columns if c == n or (c.startswith(f"{n}_") and c[len(n) + 1 :].isdigit())]
        if parts:
            out = out.withColumn(f"__{n}", F.coalesce(*[F.col(c) for c in sorted(parts)])).drop(*parts).withColumnRenamed(f"__{n}", n)
    return out


def hybrid(tables: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """All rows under all columns, and of the rows with one key the first of the first table; rows without key are one."""
    tagged = [t.withColumn("__t", F.lit(i)) for i, t in enumerate(tables)]
    out = horizontal(tagged)
    first = F.row_number().over(W.partitionBy(key).orderBy("__t", *order))
    return out.withColumn("__k", first).where("__k = 1").drop("__k", "__t")


@dataclass
class Strategy:
    """How the tables of a cluster are merged, and why."""

    cluster: int
    kind: str
    key: str | None
    confidence: float
    reasons: list[str]


def choose_strategy(cluster: int, overlap: float, keys: list[list[str]], confidence: float = 0.0) -> Strategy:
    """Horizontal above 0.7 of common columns, vertical below 0.3, else hybrid; the key is the candidate of most tables, if of more than one (ties: the name)."""
    kind = "horizontal" if overlap > 0.7 else "vertical" if overlap < 0.3 else "hybrid"
    reasons = [f"column overlap {overlap:.2f}"]
    key = None
    if kind != "horizontal":
        count: dict[str, int] = {}
        for ks in keys:
            for k in set(ks):
                count[k] = count.get(k, 0) + 1
        best = min(count, key=lambda k: (-count[k], k), default=None)
        if best is not None and count[best] > 1:
            key = best
            reasons.append(f"key {best} in {count[best]} tables")
    return Strategy(cluster, kind, key, confidence, reasons)


def merge(tables: list[DataFrame], strategy: Strategy, order: list[str]) -> DataFrame:
    """Merges as the strategy says; without a key, vertical and hybrid merges put rows below each other."""
    if strategy.kind == "vertical" and strategy.key:
        return vertical(tables, strategy.key)
    if strategy.kind == "hybrid" and strategy.key:
        return hybrid(tables, strategy.key, order)
    return horizontal(tables)
