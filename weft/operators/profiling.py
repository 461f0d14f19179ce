"""Profiles of columns: one long frame of cells, one aggregation for all columns of all tables.

A cell is (dataset, column, ordinal, value as text).  Aggregates combine on the
map side; exact distinct counts come from an aggregation to distinct values
that the other figures are then computed from, so that repeated values are
looked at once.  Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import infer
from weft.functions.text import SEPARATORS, value_shape  # noqa: F401


def cells(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """dataset, column, ordinal, value for every cell; null stays null."""
    columns = columns or df.columns
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)]))
    return df.select(F.lit(dataset).alias("dataset"), x.alias("x")).select("dataset", "x.column", "x.ordinal", "x.value")


def all_cells(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [cells(t, n) for n, t in tables.items()])


def counted(cell: DataFrame) -> DataFrame:
    """Distinct values with their counts n: what every profile is computed from."""
    return cell.groupBy("dataset", "column", "ordinal", "value").agg(F.count(F.lit(1)).alias("n"))


KEY = ["dataset", "column"]


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _chars(v: Column, keep: str) -> Column:
    """How many signs of v are in the class keep."""
    return F.length(F.regexp_replace(v, f"[^{keep}]", ""))


def column_profile(cell: DataFrame) -> DataFrame:
    """Counts, ratios of letters, digits, blanks and other signs, and lengths of the trimmed non-empty values."""
    c = counted(cell).withColumn("v", F.trim("value")).withColumn("v", F.when(F.col("v") != "", F.col("v"))).withColumn("len", F.length("v"))
    n = F.col("n")
    parts = {"alpha": _chars(F.col("v"), r"\p{L}"), "digit": _chars(F.col("v"), r"\p{Nd}"), "space": _chars(F.col("v"), r" \t\n\r\f\x0B")}
    g = c.groupBy(*KEY).agg(
        F.sum("n").alias("n"), _sum(F.when(F.col("value").isNotNull(), n)).alias("n_nonnull"), F.count("value").alias("n_distinct"), _sum(F.when(F.col("v").isNotNull(), n)).alias("m"), F.countDistinct("v").alias("m_distinct"), _sum(F.col("len") * n).alias("chars"), _sum(F.col("len") * F.col("len") * n).alias("squares"),
        F.min("len").alias("min_length"), F.max("len").alias("max_length"), *[_sum(x * n).alias(k) for k, x in parts.items()],
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    mean = F.try_divide(F.col("chars"), F.col("m"))
    return g.select(
        *KEY, "n", "n_nonnull", "n_distinct", ratio(F.col("m_distinct"), F.col("m")).alias("unique_ratio"), *[ratio(F.col(k), F.col("chars")).alias(f"{k}_ratio") for k in parts], ratio(F.col("chars") - F.col("alpha") - F.col("digit") - F.col("space"), F.col("chars")).alias("special_ratio"),
        F.round(mean, 6).alias("mean_length"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("squares"), F.col("m")) - mean * mean)), 6).alias("std_length"), "min_length", "max_length",
    )


def inferred_types(cell: DataFrame, simple: bool = False) -> DataFrame:
    """dataset, column, type."""
    return cell.groupBy(*KEY).agg(infer.inferred_type(F.col("value"), simple).alias("type"))


def length_histogram(cell: DataFrame) -> DataFrame:
    return cell.where("value is not null").groupBy(*KEY, F.length("value").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def pattern_groups(cell: DataFrame, share: float = 0.01, cover: float = 0.9, most: int = 5) -> DataFrame:
    """The dominant groups of value shapes of each column.

    A group is all shapes of one length with the same numbers of digits,
    letters, other signs and separators.  Groups come in order of size (ties:
    the key) until the groups of at least share cover enough, or are so many.
    """
    s = counted(cell).where("value is not null and value <> ''").withColumn("shape", value_shape(F.col("value"))).groupBy(*KEY, "shape").agg(F.sum("n").alias("n"))
    of = lambda ch: F.length("shape") - F.length(F.translate("shape", ch, ""))
    d, letters, other = of("D"), of("L"), of("S")
    key = F.concat(F.lit("len"), F.length("shape"), F.lit("_D"), d, F.lit("_L"), letters, F.lit("_S"), other, F.lit("_sep"), F.length("shape") - d - letters - other)
    g = s.groupBy(*KEY, key.alias("group_key")).agg(F.sum("n").alias("n"), F.max_by("shape", F.struct("n", "shape")).alias("example"))
    w = W.partitionBy(*KEY)
    # Groups of less than the least share can neither be kept nor count towards the cover, so that at most 1 / share are ranked.
    g = g.withColumn("frequency", F.col("n") / F.sum("n").over(w)).where(F.col("frequency") >= share)
    o = w.orderBy(F.desc("n"), "group_key")
    g = g.withColumn("rank", F.row_number().over(o)).withColumn("before", F.coalesce(F.sum("frequency").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    return g.where((F.col("before") < cover) & (F.col("rank") <= most)).select(*KEY, "group_key", "n", F.round("frequency", 6).alias("frequency"), "rank")


def pattern_lengths(cell: DataFrame) -> DataFrame:
    """Mean, median, population deviation, least and greatest length of the shapes of each column."""
    v = cell.where("value is not null and value <> ''").withColumn("len", F.length("value"))
    return v.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_values"), F.countDistinct(value_shape(F.col("value"))).alias("unique_patterns"), F.round(F.avg("len"), 6).alias("mean"), F.median("len").alias("median"), F.round(F.stddev_pop("len"), 6).alias("std"), F.min("len").alias("min"), F.max("len").alias("max"))


def samples(df: DataFrame, order: str, columns: list[str], k: int = 20) -> DataFrame:
    """column, position, value: the first k non-null values of each column in the order of a key."""
    c = df.select(F.col(order).alias("__o"), F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("value")) for x in columns])).alias("x")).select("__o", "x.column", "x.value").where("value is not null")
    return c.withColumn("position", F.row_number().over(W.partitionBy("column").orderBy("__o"))).where(F.col("position") <= k).select("column", "position", "value")


def structure_report(df: DataFrame, dataset: str) -> DataFrame:
    """dataset, rows, columns, missing share, duplicate rows, columns more than half empty."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    nulls = [_sum(F.when(F.col(c).isNull(), F.col("__n"))) for c in df.columns]
    a = groups.agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("kinds"), *[x.alias(f"__{i}") for i, x in enumerate(nulls)])
    missing = sum((F.col(f"__{i}") for i in range(len(nulls))), F.lit(0))
    half = sum(((F.col(f"__{i}") > 0.5 * F.col("rows")).cast("int") for i in range(len(nulls))), F.lit(0))
    return a.select(F.lit(dataset).alias("dataset"), F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.round(F.coalesce(F.try_divide(missing, F.col("rows") * len(df.columns)), F.lit(0.0)), 6).alias("missing_share"), (F.coalesce("rows", F.lit(0)) - F.col("kinds")).alias("duplicate_rows"), half.alias("half_empty_columns"))


def quality_report(df: DataFrame, dataset: str) -> DataFrame:
    """column, nulls, distinct, blanks ('' counts twice, other blanks once), zeros and negatives of numeric columns, zero-heavy flag."""
    kinds = dict(df.dtypes)
    numeric = [c for c in df.columns if kinds[c] in ("int", "bigint", "double", "float", "smallint")]
    num = F.create_map(*[y for c in df.columns for y in (F.lit(c), F.lit(c in numeric))])
    c = counted(cells(df, dataset)).withColumn("num", num[F.col("column")])
    v, n = F.col("value").try_cast("double"), F.col("n")
    g = c.groupBy("column").agg(F.sum("n").alias("rows"), _sum(F.when(F.col("value").isNull(), n)).alias("nulls"), F.count("value").alias("distinct"), (_sum(F.when(~F.col("num") & (F.trim("value") == ""), n)) + _sum(F.when(~F.col("num") & (F.col("value") == ""), n))).alias("blanks"), _sum(F.when(F.col("num") & (v == 0), n)).alias("zeros"), _sum(F.when(F.col("num") & (v < 0), n)).alias("negatives"))
    return g.withColumn("mostly_zero", F.col("zeros") > 0.5 * F.col("rows")).select(F.lit(dataset).alias("dataset"), "*").drop("rows")


def candidate_keys(df: DataFrame, unique: float = 0.95, nulls: float = 0.05) -> DataFrame:
    """column, unique_ratio of the columns other than text that could be a key."""
    columns = [c for c, t in df.dtypes if t != "string"]
    c = counted(cells(df, "", columns))
    g = c.groupBy("column").agg(F.sum("n").alias("rows"), _sum(F.when(F.col("value").isNull(), F.col("n"))).alias("nulls"), F.count("value").alias("d"))
    return g.where((F.col("d") > unique * F.col("rows")) & (F.col("nulls") < nulls * F.col("rows"))).select("column", F.round(F.col("d") / F.col("rows"), 6).alias("unique_ratio"))


# Words in the names of columns that hold times.
TIME_WORDS = ("date", "time", "timestamp", "year", "month", "day", "hour")


def temporal_columns(df: DataFrame) -> list[str]:
    """Columns with a time word in the name or a time type."""
    return [c for c, t in df.dtypes if any(w in c.lower() for w in TIME_WORDS) or t.startswith(("timestamp", "date"))]


def assessment(df: DataFrame, dataset: str) -> DataFrame:
    """column, dtype, null_percent, n_unique, temporal, candidate_key over the whole table."""
    keys = [r["column"] for r in candidate_keys(df).limit(len(df.columns)).collect()]
    times = temporal_columns(df)
    kinds = F.create_map(*[y for c, t in df.dtypes for y in (F.lit(c), F.lit(t))])
    g = counted(cells(df, dataset)).groupBy(*KEY).agg(F.round(100.0 * _sum(F.when(F.col("value").isNull(), F.col("n"))) / F.sum("n"), 6).alias("null_percent"), F.count("value").alias("n_unique"))
    return g.select(*KEY, kinds[F.col("column")].alias("dtype"), "null_percent", "n_unique", F.col("column").isin(times).alias("temporal"), F.col("column").isin(keys).alias("candidate_key"))


def column_overlap(tables: dict[str, DataFrame]) -> DataFrame:
    """left, right, jaccard of the tables' column names: metadata only, no rows are read."""
    spark = next(iter(tables.values())).sparkSession
    out = []
    names = sorted(tables)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = {c.lower() for c in tables[a].columns}, {c.lower() for c in tables[b].columns}
            out.append((a, b, round(len(x & y) / len(x | y), 6)))
    return spark.createDataFrame(out, "`left` string, `right` string, jaccard double")


def schema_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """dataset, column, dtype, and how many types the column name has among the tables."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, c, t) for n, df in sorted(tables.items()) for c, t in df.dtypes]
    kinds: dict = {}
    for _, c, t in rows:
        kinds.setdefault(c, set()).add(t)
    return spark.createDataFrame([(n, c, t, len(kinds[c])) for n, c, t in rows], "dataset string, column string, dtype string, types int")


def bucket_histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """bucket (from 1), n: equal widths between the least and greatest value; the greatest is in the last bucket."""
    v = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return v.select(F.lit(1).alias("bucket"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (hi - lo) / buckets or 1.0
    return v.groupBy(F.least(F.lit(buckets), (F.floor((F.col("v") - lo) / width) + 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
