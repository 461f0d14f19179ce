"""Session helpers: reading tables, cutting lineage, prefix sums over hot groups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    It is the session's spark.checkpoint.dir; only where none is set (local
    tests) is a temporary one made.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        known = tempfile.mkdtemp(prefix="weft-checkpoint-")
        sc.setCheckpointDir(known)
        atexit.register(shutil.rmtree, known, ignore_errors=True)
    return known.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to a table in the shared folder and read again.

    That cuts the lineage, survives the loss of executors and gives the planner
    true sizes.  The table is deleted by release(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weft-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if not _written:
        atexit.register(sweep)
    _written.append((spark, path))
    collect(spark)
    return spark.read.schema(schema).parquet(path)


def collect(spark: SparkSession, pause: float | None = None) -> None:
    """The shuffles behind a written table are of no use any more; Spark removes their files when the driver collects its garbage."""
    if time.monotonic() - _collected[0] > (PAUSE if pause is None else pause):
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def written() -> int:
    """How many tables of cut() there are, for release()."""
    return len(_written)


def release(since: int, *keep: DataFrame) -> None:
    """Deletes the tables that cut() has written since then, but for those that the frames keep read, and has the driver collect its garbage."""
    kept = {f.rsplit("/", 2)[-2] for df in keep for f in df.inputFiles()}
    mine, _written[since:] = _written[since:], []
    for spark, path in mine:
        if path.rsplit("/", 1)[-1] in kept:
            _written.append((spark, path))
        else:
            remove(spark, path)
    if mine:
        collect(mine[0][0], pause=0)


_written: list = []
_collected = [0.0]
#: Seconds between two collections of the driver's garbage.
PAUSE = 3.0


def sweep() -> None:
    """Deletes the tables that cut() wrote."""
    while _written:
        remove(*_written.pop())


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def running_total(df: DataFrame, group: list[str], order: Column, value: str, out: str, buckets: int = 256) -> DataFrame:
    """Adds the sum of value over the rows of the group that come before the row.

    order is a non-negative long spread evenly over 0..2^62 (a hash); ties are
    the caller's to rule out.  A group is cut into order ranges, so that a hot
    one is summed by many tasks: range sums first, then offsets, then rows.
    Null values count as 0.
    """
    step = (1 << 62) // buckets
    rows = df.withColumn("__o", order).withColumn("__b", F.least(F.floor(F.col("__o") / F.lit(step)), F.lit(buckets - 1)).cast("int"))
    sums = rows.groupBy(*group, "__b").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__s"))
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*group, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"))
    inside = W.partitionBy(*group, "__b").orderBy("__o").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside), F.lit(0)))
    return rows.join(offsets, [*group, "__b"]).withColumn(out, F.col("__off") + F.col("__in")).drop("__b", "__o", "__off", "__in")


def grouped_quantiles(df: DataFrame, group: list[str], value: str, q: float, out: str) -> DataFrame:
    """group, out: the exact quantile of a numeric column in each group, between two values linearly.

    Equal values are counted first; the counts are then added up in order, in
    a window that streams and spills, so that no group is held in memory.
    Nulls do not count; a group of nulls has no row.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    run = n.withColumn("__to", F.sum("__n").over(w.orderBy("__v"))).withColumn("__all", F.sum("__n").over(w))
    at = q * (F.col("__all") - 1)
    lo, hi = F.floor(at), F.ceil(at)
    inside = lambda r: (F.col("__to") - F.col("__n") <= r) & (r < F.col("__to"))
    low, high = F.max(F.when(inside(lo), F.col("__v"))), F.max(F.when(inside(hi), F.col("__v")))
    frac = F.max(at - lo)
    return run.where(inside(lo) | inside(hi)).groupBy(*group).agg((low + (high - low) * frac).alias(out))


def exact_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """The exact quantile of a column over all rows; None without values.

    Value counts are range-partitioned; only the ranges' sums are put in order
    by one task.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    r = cut(n.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    sums = r.groupBy("p").agg(F.sum("n").alias("s"))
    off = sums.select("p", (F.sum("s").over(W.orderBy("p")) - F.col("s")).alias("off"), F.sum("s").over(W.partitionBy(F.lit(0))).alias("all"))
    rows = r.join(F.broadcast(off), "p").withColumn("to", F.col("off") + F.sum("n").over(W.partitionBy("p").orderBy("v")))
    at = q * (F.col("all") - 1)
    inside = lambda k: (F.col("to") - F.col("n") <= k) & (k < F.col("to"))
    found = rows.agg(F.max(F.when(inside(F.floor(at)), F.col("v"))).alias("a"), F.max(F.when(inside(F.ceil(at)), F.col("v"))).alias("b"), F.max(at - F.floor(at)).alias("f")).first()
    return None if found["a"] is None else found["a"] + (found["b"] - found["a"]) * found["f"]
