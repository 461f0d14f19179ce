"""Problem 6: weights recorded in several units, brought to kilograms.

Text is read by the unit grammar of ``functions.units``.  A bare number could
be in any unit: its unit is the one with the best score, the logarithm of the
unit's prior in the column less the squared distance, on a logarithmic scale,
from what the item should weigh.  What it should weigh comes, in this order, from
  1. weights of the same listing, in any table, that state their unit;
  2. listings that share a model code or a pair of neighbouring title words
     whose own weights agree closely (a product line);
  3. the bare weights of the same listing: the weight that explains them best,
     given how often each column's numbers are in each unit.
If no unit comes within TOLERANCE of what is expected, the column's own unit
stands.

Defined results: null, zero, negative and unreadable weights have no unit and
no kilograms; rows of a null key are judged by their own text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.units import weight
from weft.session import cut, table

# Kilograms of a unit.
KG = {"g": 1e-3, "kg": 1.0, "oz": 0.028349523125, "lb": 0.45359237}
#: Prior of a unit other than the column's own, and width of the distance.
PRIOR, WIDTH = 0.02, 0.12
#: Logarithm of the probability of a number that no unit explains.
FLOOR = -9.0
#: Logarithmic distance within which a unit explains a weight.
TOLERANCE = 0.4
#: A token's weights agree if their quartiles are this close (logarithm), and there are so many.
SPREAD, PEERS = 0.16, 3


@F.pandas_udf(T.StructType([T.StructField("v", T.DoubleType()), T.StructField("unit", T.StringType())]))
def read_weight(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """(number, unit) of weights in text; unit "" for bare numbers, "lb oz" counts in pounds; null if unreadable."""
    memo: dict = {}
    for s in texts:
        out = []
        for t in s:
            hit = memo.get(t, memo)
            if hit is memo:
                hit = weight(t) if t else None
                if len(memo) < 200_000:
                    memo[t] = hit
            out.append(hit or (None, None))
        yield pd.DataFrame(out, columns=["v", "unit"])


def in_kg(value: Column, unit: Column) -> Column:
    """Kilograms of a value; null for an unknown unit."""
    out = F.when(unit == "lb oz", value * KG["lb"])
    for u, f in KG.items():
        out = out.when(unit == u, value * f)
    return out


def tokens(title: Column) -> Column:
    """Model codes and pairs of neighbouring words of a title."""
    low = F.lower(title)
    codes = F.transform(F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9])([a-z]{3}[- ]?[0-9]{4})(?![a-z0-9])"), 1), lambda c: F.regexp_replace(c, "[- ]", ""))
    words = F.filter(F.split(F.regexp_replace(low, r"[a-z]*[0-9][a-z0-9.,]*", " "), r"[^\p{L}']+"), lambda w: F.length(w) >= 3)
    pairs = F.when(F.size(words) >= 2, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(codes, pairs))


def priors(seen: list[tuple[str, str, str, int]], least: float) -> dict[tuple[str, str], dict[str, float]]:
    """Prior of each unit in each (table, own unit), from counts; a hundred made-up rows stand for the plain prior."""
    out: dict = {}
    for t, own, u, n in seen:
        out.setdefault((t, own), {})[u] = n
    for (t, own), n in out.items():
        total = sum(n.values()) + 100
        out[t, own] = {u: (n.get(u, 0) + 100 * (1 - 3 * least if u == own else least)) / total for u in KG}
    return out


def _prior(prior: dict | None, unit: str) -> Column:
    out = F.when(F.col("own") == unit, 1 - 3 * PRIOR).otherwise(PRIOR)
    for (t, own), p in (prior or {}).items():
        out = F.when((F.col("table_name") == t) & (F.col("own") == own), F.lit(p[unit])).otherwise(out)
    return out


def _best(v: Column, own: Column, x: Column, prior: dict | None) -> Column:
    """struct(s, u, d): the unit u that explains v best if ln(kg) should be x, its score and its distance."""
    # "lb oz" is written as text only, so that a bare number is in one of the four units.
    far = {u: F.log(v * F.lit(f)) - x for u, f in KG.items()}
    return F.greatest(*[F.struct((F.log(_prior(prior, u)) - d * d / (2 * WIDTH * WIDTH)).alias("s"), F.lit(u).alias("u"), F.abs(d).alias("d")) for u, d in far.items()])


def judged(rows: DataFrame, stated: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Units of weights.

    rows: table_name, row_no, key, title, v (number), unit (stated, or "" for a
    bare number, or null), own (the column's unit).  stated: key, kg of weights
    elsewhere that state their unit.
    -> table_name, row_no, unit, kg (null where there is no weight).
    """
    # One title of each listing, as hashes of its tokens; the rows themselves go on without.
    titles = rows.where("key is not null and title is not null").groupBy("key").agg(F.min("title").alias("title")).select("key", F.transform(tokens(F.col("title")), lambda t: F.xxhash64(t)).alias("ts"))
    rows = cut(rows.drop("title"))
    good = rows.where("v > 0 and unit is not null and key is not null")
    by_text = good.where("unit <> ''").select("key", in_kg(F.col("v"), F.col("unit")).alias("kg")).unionByName(stated.where("kg > 0 and key is not null").select("key", "kg"))
    strong = by_text.where("kg > 0").groupBy("key").agg(F.avg(F.log("kg")).alias("strong"), F.stddev_pop(F.log("kg")).alias("sd"))
    strong = strong.where("coalesce(sd, 0) < 0.3").select("key", "strong")
    # How often each column's bare numbers are in each unit, from listings that state a weight elsewhere.
    sure = good.where("unit = ''").join(strong, "key").select("table_name", "own", _best(F.col("v"), F.col("own"), F.col("strong"), None).alias("b"))
    seen = sure.where(F.col("b.d") <= tolerance).groupBy("table_name", "own", F.col("b.u").alias("u")).agg(F.count(F.lit(1)).alias("n")).collect()
    prior = priors([(r["table_name"], r["own"], r["u"], r["n"]) for r in seen], PRIOR)
    # Bare weights of a listing: every unit of every number votes for a place on the logarithmic scale; two grids, so that no border parts equal weights.
    bare = good.where("unit = ''").groupBy("key", "table_name", "own", "v").agg(F.count(F.lit(1)).alias("n"))
    votes = F.explode(F.array(*[F.struct(F.log(F.col("v") * f).alias("x"), (F.log(_prior(prior, u)) - FLOOR).alias("w")) for u, f in KG.items()]))
    bare = bare.select("key", "n", votes.alias("c")).select("key", "c.x", (F.col("n") * F.col("c.w")).alias("w"), F.explode(F.array(F.lit(0), F.lit(1))).alias("grid"))
    place = bare.groupBy("key", "grid", F.floor(F.col("x") / 0.2 + 0.5 * F.col("grid")).alias("p")).agg(F.sum("w").alias("w"), F.avg("x").alias("x"))
    weak = place.groupBy("key").agg(F.max_by("x", F.struct("w", (-F.col("x")).alias("o"))).alias("weak"))
    known = cut(weak.join(strong, "key", "full").join(titles, "key", "full").withColumn("id", F.xxhash64("key")))
    flat = known.select("id", "strong", F.coalesce("strong", "weak").alias("x"), F.explode("ts").alias("t"))
    q = F.percentile_approx("x", [0.25, 0.5, 0.75], 1000)
    agreed = flat.where("x is not null").groupBy("t").agg(F.count(F.lit(1)).alias("n"), q.alias("q")).where((F.col("n") >= PEERS) & (F.col("q")[2] - F.col("q")[0] <= SPREAD)).select("t", "n", F.col("q")[1].alias("mid"), (F.col("q")[2] - F.col("q")[0]).alias("wide"))
    # Written, so that the shuffle of all tokens behind it can go.
    agreed = cut(agreed)
    line = flat.where("strong is null").select("id", "t").join(agreed, "t").groupBy("id").agg(F.max_by("mid", F.struct(F.least("n", F.lit(20)), -F.col("wide"), "t")).alias("line"))
    expected = known.join(line, "id", "left").select("key", F.coalesce("strong", "line", "weak").alias("x"), "weak")
    out = rows.join(expected, "key", "left")
    best = _best(F.col("v"), F.col("own"), F.col("x"), prior)
    other = _best(F.col("v"), F.col("own"), F.col("weak"), prior)
    guess = F.when(best["d"] <= tolerance, best["u"]).when(other["d"] <= tolerance, other["u"]).otherwise(F.col("own"))
    unit = F.when((F.col("v") > 0) & F.col("unit").isNotNull(), F.when(F.col("unit") == "", guess).otherwise(F.col("unit")))
    out = out.select("table_name", "row_no", "own", F.col("v").alias("v"), unit.alias("unit"))
    return out.select("table_name", "row_no", "own", "unit", F.round(in_kg(F.col("v"), F.col("unit")), 6).alias("kg"))


def catalogue_weights(modern: DataFrame, third: DataFrame, legacy: DataFrame) -> DataFrame:
    """judged() over the weight columns of the three systems."""
    bare = lambda c: [F.when(~F.isnan(c), F.col(c)).alias("v"), F.when(F.col(c).isNotNull(), F.lit("")).alias("unit")]
    a = modern.select(F.lit("modern_products").alias("table_name"), "row_no", F.col("asin").alias("key"), "title", *bare("weight_kg"), F.lit("kg").alias("own"))
    b = third.select(F.lit("third_system_products").alias("table_name"), "row_no", F.col("item_code").alias("key"), F.col("item_name").alias("title"), read_weight("item_weight").alias("r")).select("table_name", "row_no", "key", "title", "r.v", "r.unit", F.lit("lb").alias("own"))
    c = legacy.select(F.lit("cluster_2_unified").alias("table_name"), "row_no", F.col("product_sku").alias("key"), F.col("product_name").alias("title"), *bare("weight_lbs"), F.lit("lb").alias("own"))
    spec = F.regexp_extract("specifications", r'"weight": ?"([^"]*)"', 1)
    stated = modern.where(spec != "").select(F.col("asin").alias("key"), read_weight(spec).alias("r")).select("key", in_kg(F.col("r.v"), F.col("r.unit")).alias("kg"))
    return judged(a.unionByName(b).unionByName(c), stated)


def p6_weights(spark, folder):
    return catalogue_weights(table(spark, folder, "modern_products"), table(spark, folder, "third_system_products"), table(spark, folder, "cluster_2_unified"))


def p6_found(spark, folder):
    return p6_weights(spark, folder).where("unit <> own").select("table_name", "row_no", "unit")
