"""Sinks: tables, golden records, column files, profiles, audit logs and domains."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet, or CSV with a header; as many files as the frame has partitions."""
    w = df.write.mode("overwrite")
    w.csv(path, header=True) if form == "csv" else w.format(form).save(path)


def write_golden(df: DataFrame, path: str, helpers: tuple[str, ...] = ("_clean", "_original", "block_")) -> None:
    """Golden records as CSV: helper columns dropped, numbers with two decimals."""
    kinds = dict(df.dtypes)
    keep = [c for c in df.columns if not c.endswith(helpers[:2]) and not c.startswith(helpers[2])]
    df.select(*[F.format_string("%.2f", c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in keep]).write.mode("overwrite").csv(path, header=True)


def write_column_files(terms: DataFrame, path: str) -> None:
    """One folder of gzipped lines (term, count) for each column of column_terms()."""
    terms.select("column_id", F.concat_ws("\t", "term", F.col("n").cast("string")).alias("line")).write.mode("overwrite").partitionBy("column_id").text(path, compression="gzip")


def write_profiles(profile: DataFrame, path: str) -> None:
    """Column profiles as one JSON file by dataset and column; one row a column, so that they fit the driver."""
    out: dict = {}
    for r in profile.toLocalIterator():
        d = r.asDict(recursive=True)
        out.setdefault(d.pop("dataset"), {})[d.pop("column")] = d
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, sort_keys=True, default=str)


def audit_log(name: str, inputs: dict[str, DataFrame], output: DataFrame, mapped: dict[str, list[str]]) -> dict:
    """What went into a merge and what came out: rows and columns of each input and of the output, and the mapped columns."""
    return {"cluster": name, "inputs": {n: {"rows": t.count(), "columns": t.columns, "mapped": mapped.get(n, [])} for n, t in inputs.items()}, "output_rows": output.count(), "output_columns": output.columns}


def domain_json(exported: DataFrame, chunk: int = 1000) -> DataFrame:
    """strong_id, block_no, weight, chunk_no, terms (JSON array of chunk terms in order), term_count (of the block).

    All terms of a block, in as many rows as that takes, numbered from 0.
    """
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("strong_id", "block_no").orderBy("term"))
    n = exported.groupBy("strong_id", "block_no").agg(F.count(F.lit(1)).alias("term_count"))
    t = exported.withColumn("chunk_no", F.floor((k - 1) / chunk).cast("long")).groupBy("strong_id", "block_no", "weight", "chunk_no").agg(F.to_json(F.array_sort(F.collect_list("term"))).alias("terms"))
    return t.join(n, ["strong_id", "block_no"])
