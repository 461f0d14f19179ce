"""Problem 4: profile of every column and load, and the loads in which a column departs from its usual state.

Columns are unpivoted to (column, load, value) and counted.  The counts are
range-sorted by column and value; what each range holds of each load gives the
prefix counts of the ranges, with which every range computes its part of the
loads' cumulative curves by itself: exact quantiles, exact distinct counts and,
as the greatest gap of any two curves, exact Kolmogorov-Smirnov distances
between all loads.

Values of numeric columns are themselves; of text columns that hold numbers
(``numbers``) the number in the text; of other text their length.  A value is
odd if it does not have the column's most frequent shape.

A load departs if its median distance to the other loads is beyond what chance
and a margin allow, or if a share (of nulls, unreadable, odd, negative, zero or
of its most frequent value) is far from the median of the loads.

Defined results: NaN counts as null; a load with no readable value has no
quantiles and no distances; a column with fewer than three loads has no usual
state, and no load departs; rows with null load are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.session import cut, table

#: Margin and multiple of the chance distance beyond which a distance departs.
MARGIN, CHANCE = 0.06, 1.7
#: The same for shares.
SHARE_MARGIN, SHARE_CHANCE = 0.06, 6.0
QUANTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
#: Most pairs of loads whose distances are held in one array, and most cells of the curves that are held at once.
PAIRS, CELLS = 1 << 18, 1 << 20


def text_number(text: Column) -> Column:
    """The number in a text such as "$12.50", "12,50" or "12.50 USD"; null if it holds none."""
    bare = F.regexp_extract(text, r"^\s*[$€£]?\s*(-?[0-9][0-9.,]*)\s*(?:[A-Za-z]{3})?\s*$", 1)
    return F.regexp_replace(F.regexp_replace(bare, r",(?=[0-9]{3}(?:[.]|$))", ""), ",", ".").try_cast("double")


def shape(text: Column) -> Column:
    """Digits as 9 and letters as a, runs of them once; of a shape over 24 signs its first 24 and a hash of the whole."""
    whole = F.regexp_replace(F.regexp_replace(text, r"[0-9]+", "9"), r"\p{L}+", "a")
    return F.when(F.length(whole) > 24, F.concat(F.substring(whole, 1, 24), F.xxhash64(whole).cast("string"))).otherwise(whole)


def unpivot(df: DataFrame, name: str, load: str, columns: list[str] | None = None, numbers: list[str] = ()) -> DataFrame:
    """table_name, column_name, load_no, raw (as text), value (double or null) for every cell."""
    columns = [c for c in (columns or df.columns) if c != load]
    kinds = dict(df.dtypes)
    cells = []
    for c in columns:
        if kinds[c] in ("double", "float"):
            v, raw = F.when(~F.isnan(c), F.col(c).cast("double")), F.when(~F.isnan(c), F.col(c).cast("string"))
        elif kinds[c] in ("tinyint", "smallint", "int", "bigint") or kinds[c].startswith("decimal"):
            v, raw = F.col(c).cast("double"), F.col(c).cast("string")
        elif kinds[c].startswith("timestamp") or kinds[c] == "date":
            v, raw = F.unix_micros(F.col(c).cast("timestamp")).cast("double"), F.col(c).cast("string")
        elif kinds[c] == "string" and c in numbers:
            v, raw = text_number(F.col(c)), F.col(c)
        else:
            raw = F.col(c).cast("string") if kinds[c] != "binary" else F.base64(c)
            v = F.length(raw).cast("double")
        cells.append(F.struct(F.lit(c).alias("column_name"), raw.alias("raw"), v.alias("value"), F.lit(kinds[c] == "string").alias("is_text")))
    return df.where(F.col(load).isNotNull()).select(F.lit(name).alias("table_name"), F.col(load).cast("int").alias("load_no"), F.explode(F.array(*cells)).alias("x")).select("table_name", "x.column_name", "load_no", "x.raw", "x.value", "x.is_text")


def profile(cells: DataFrame) -> DataFrame:
    """unpivot() rows -> one row per table, column and load with the profile; see the module's head for its meaning."""
    key = ["table_name", "column_name"]
    # Everything that counts cells, before any sort: equal cells of a load are one row from here on.
    counts = cut(cells.groupBy(*key, "load_no", "raw", "value", "is_text").agg(F.count(F.lit(1)).alias("n")))
    # Shapes of text; of numbers only the sign of an error is looked at, by the shares below.
    shaped = counts.where("is_text and raw is not null").groupBy(*key, "load_no", shape(F.col("raw")).alias("shape")).agg(F.sum("n").alias("n"))
    usual = shaped.groupBy(*key, "shape").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.max_by("shape", F.struct("n", "shape")).alias("usual"))
    odd = shaped.join(usual, key).where("shape <> usual").groupBy(*key, "load_no").agg(F.sum("n").alias("odd"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    base = counts.groupBy(*key, "load_no").agg(F.sum("n").alias("rows"), of(F.col("raw").isNull()).alias("nulls"), of(F.col("raw").isNotNull() & F.col("value").isNull()).alias("unreadable"), of(F.col("value") < 0).alias("negative"), of(F.col("value") == 0).alias("zero"), F.coalesce(F.max(F.when(F.col("raw").isNotNull(), F.col("n"))), F.lit(0)).alias("top"), F.count("raw").alias("distinct_values"))
    base = base.join(odd, [*key, "load_no"], "left").na.fill(0, ["odd"])
    curves = _curves(counts.where("value is not null").groupBy(*key, "load_no", "value").agg(F.sum("n").alias("n")))
    ks = curves.where("kind = 'ks'").select(*key, F.col("a").alias("load_no"), F.col("d").alias("ks"), F.col("m").alias("other"))
    ks = ks.groupBy(*key, "load_no").agg(F.median("ks").alias("ks"), F.median(F.sqrt(1 / F.col("other"))).alias("noise"), F.count(F.lit(1)).alias("others"))
    q = curves.where("kind = 'q'").groupBy(*key, F.col("a").alias("load_no")).agg(*[F.max(F.when(F.col("b") == i, F.col("d"))).alias(f"q{int(100 * p):02d}") for i, p in enumerate(QUANTILES)], F.max("m").alias("readable"))
    out = base.join(q, [*key, "load_no"], "left").join(ks, [*key, "load_no"], "left")
    return _judge(out, key)


def _curves(counts: DataFrame) -> DataFrame:
    """table_name, column_name, kind, a, b, d, m: distances (kind ks: d of loads a and b; m rows of b) and quantiles (kind q: d is quantile number b of load a; m its rows)."""
    key = ["table_name", "column_name"]
    ranged = cut(counts.repartitionByRange(*key, "value").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy(*key, "part", "load_no").agg(F.sum("n").alias("n"))
    every = sums.groupBy(*key, "load_no").agg(F.sum("n").alias("total"))
    # Prefix counts: rows of each load in the ranges before; a load without rows in a range still has its prefix there.
    grid = sums.select(*key, "part").distinct().join(every, key).join(sums, [*key, "part", "load_no"], "left")
    before = W.partitionBy(*key, "load_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    grid = cut(grid.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*key, "part", "load_no", "total", "before"))
    # The loads of a column are dealt into blocks, so that an array of distances stays small whatever their number; up to 512 loads are one block.
    blocks = every.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) * F.count(F.lit(1)) / F.lit(PAIRS)).cast("int").alias("blocks"))
    dealt = lambda d: d.join(F.broadcast(blocks.withColumn("blocks", F.col("blocks") + 0)), key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def part(rows: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(head):
            head = head.sort_values("load_no")
            loads, total, prefix = head["load_no"].to_numpy(), head["total"].to_numpy(float), head["before"].to_numpy(float)
            values, at = np.unique(rows["value"].to_numpy(float), return_inverse=True)
            n = len(loads)
            mine = np.array_split(np.arange(n), head["blocks"].iloc[0])[head["block"].iloc[0]]
            place = np.searchsorted(loads, rows["load_no"].to_numpy())
            run = prefix.copy()
            apart = lambda r: np.abs(r / total - (r / total)[mine, None])
            best = apart(run)
            order = np.lexsort((place, at))
            at, place, count = at[order], place[order], rows["n"].to_numpy(float)[order]
            want = np.array(QUANTILES)
            size = max(1, CELLS // n)
            # Curves in blocks of values, so that memory stays small.
            for lo in range(0, len(values), size):
                hi = min(lo + size, len(values))
                i, j = np.searchsorted(at, [lo, hi])
                step = np.zeros((hi - lo + 1, n))
                step[0] = run
                np.add.at(step, (at[i:j] - lo + 1, place[i:j]), count[i:j])
                cum = np.cumsum(step, axis=0)
                f = cum / total
                by = np.argsort(place[i:j], kind="stable")
                ends = np.searchsorted(place[i:j][by], np.append(mine, mine[-1] + 1))
                for k, a in enumerate(mine):
                    jumps = at[i:j][by[ends[k] : ends[k + 1]]] - lo + 1
                    if not len(jumps):
                        continue
                    # Between two steps of a its curve is level and the others only rise: the greatest gap is at a step of a or just before it, or at an end of the range.
                    g = f[np.unique(np.concatenate([jumps - 1, jumps]))]
                    best[k] = np.maximum(best[k], np.abs(g - g[:, a : a + 1]).max(axis=0))
                    # The smallest value whose count reaches the rank.
                    for q, r in enumerate(np.maximum(1, np.ceil(want * total[a] - 1e-9))):
                        if run[a] < r <= cum[-1, a]:
                            out.append(("q", loads[a], [q], [values[lo + int(np.searchsorted(cum[1:, a], r))]], [total[a]]))
                run = cum[-1]
            best = np.maximum(best, apart(run))
            for k, a in enumerate(mine):
                other = np.arange(n) != a
                out.append(("ks", loads[a], loads[other], best[k, other], total[other]))
        got = pd.DataFrame(out, columns=["kind", "a", "b", "d", "m"])
        got.insert(0, "column_name", head["column_name"].iloc[0] if len(head) else None)
        got.insert(0, "table_name", head["table_name"].iloc[0] if len(head) else None)
        return got

    by = [*key, "part", "block"]
    got = dealt(ranged).groupBy(*by).cogroup(dealt(grid).groupBy(*by)).applyInPandas(part, "table_name string, column_name string, kind string, a int, b array<int>, d array<double>, m array<double>")
    # A load's row of distances is one row until it is where they are compared.
    got = got.repartition(*key, "kind", "a").select(*key, "kind", "a", F.explode(F.arrays_zip("b", "d", "m")).alias("x")).select(*key, "kind", "a", "x.b", "x.d", "x.m")
    return cut(got.groupBy(*key, "kind", "a", "b").agg(F.max("d").alias("d"), F.max("m").alias("m")))


def _judge(out: DataFrame, key: list[str]) -> DataFrame:
    w = W.partitionBy(*key)
    loads = F.count(F.lit(1)).over(w)
    shares = {"null_share": F.col("nulls") / F.col("rows")}
    filled = F.col("rows") - F.col("nulls")
    for s, c in (("unreadable_share", "unreadable"), ("odd_share", "odd"), ("negative_share", "negative"), ("zero_share", "zero"), ("top_share", "top")):
        shares[s] = F.coalesce(F.try_divide(F.col(c), filled), F.lit(0.0))
    for s, c in shares.items():
        out = out.withColumn(s, c)
    far = F.lit(False)
    for s in shares:
        n = F.greatest(F.lit(1), F.col("rows") if s == "null_share" else filled)
        mid = F.median(s).over(w)
        room = SHARE_MARGIN + SHARE_CHANCE * F.sqrt(F.greatest(mid * (1 - mid), F.lit(0.0)) / n)
        far = far | (F.abs(F.col(s) - mid) > room)
    gap = F.coalesce(F.col("ks") > MARGIN + CHANCE * F.sqrt(F.col("noise") * F.col("noise") + 1 / F.col("readable")), F.lit(False))
    empty = F.col("readable").isNull() & (F.count("readable").over(w) > 0)
    out = out.withColumn("departs", (loads >= 3) & (far | gap | empty))
    rounded = [F.round(s, 6).alias(s) for s in shares]
    return out.select(*key, "load_no", F.col("rows").cast("long").alias("rows"), *rounded, F.col("distinct_values").cast("long").alias("distinct_values"), *[f"q{int(100 * p):02d}" for p in QUANTILES], F.round("ks", 6).alias("ks"), "departs")


def p4_profile(spark, folder):
    a = unpivot(table(spark, folder, "modern_products"), "modern_products", "load_no")
    b = unpivot(table(spark, folder, "third_system_products"), "third_system_products", "load_no", numbers=["retail_price"])
    return profile(a.unionByName(b))


def p4_found(spark, folder):
    a = unpivot(table(spark, folder, "modern_products"), "modern_products", "load_no", ["current_price", "stock_quantity"])
    b = unpivot(table(spark, folder, "third_system_products"), "third_system_products", "load_no", ["retail_price"], numbers=["retail_price"])
    return profile(a.unionByName(b)).where("departs").select("table_name", "column_name", "load_no")
