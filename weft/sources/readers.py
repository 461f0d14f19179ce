"""Sources: directories of CSV, JSON, Excel and Parquet files, as frames.

Text encodings are tried in turn on the bytes of one file's beginning, which is
at most HEAD bytes; the rows themselves are read by Spark.  Nothing is sampled
unless a caller asks for a sample.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.text import column_name

HEAD = 1 << 20
# Encodings in the order in which they are tried; the second never fails.
ENCODINGS = ("utf-8", "iso-8859-1")


def files(folder: str, endings: tuple[str, ...] = (".csv", ".json", ".parquet", ".xlsx", ".tsv")) -> dict[str, str]:
    """Path of every file below a folder by its base name; of equal names the last path in order counts."""
    return {p.name: str(p) for p in sorted(Path(folder).rglob("*")) if p.suffix.lower() in endings}


def encoding(path: str) -> str:
    """The first encoding that the file's beginning is valid in."""
    with open(path, "rb") as f:
        head = f.read(HEAD)
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    for e in ENCODINGS:
        try:
            head[: len(head) - 4 if len(head) == HEAD else None].decode(e)
            return e
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1]


def read_csv(spark: SparkSession, path: str, sep: str = ",", text: bool = False, clean_names: bool = False) -> DataFrame:
    """A CSV file with a header; text keeps every column a string."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=not text, encoding=encoding(path) if os.path.isfile(path) else "utf-8", multiLine=True, escape='"')
    return cleaned(df) if clean_names else df


def cleaned(df: DataFrame) -> DataFrame:
    """Column names fit for a table, numbered where they clash."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        n = column_name(c)
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*out)


def flattened(df: DataFrame) -> DataFrame:
    """Members of structs as columns with dotted names, at any depth."""
    cols, deeper = [], False
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            deeper = True
            cols += [F.col(f"`{f.name}`").getField(k.name).alias(f"{f.name}.{k.name}") for k in f.dataType.fields]
        else:
            cols.append(F.col(f"`{f.name}`"))
    out = df.select(*cols)
    return flattened(out) if deeper else out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, one object, or an object per line, flattened."""
    df = spark.read.json(path, multiLine=True)
    if df.columns == ["_corrupt_record"]:
        df = spark.read.json(path)
    else:
        with open(path, "rb") if os.path.isfile(path) else open(os.devnull, "rb") as f:
            head = f.read(HEAD).lstrip()
        if head[:1] == b"{" and b"\n{" in head:
            df = spark.read.json(path)
    return flattened(df)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook; needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ImportError("reading Excel files needs openpyxl") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def read_any(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A file by its ending; rows limits it to a sample where a caller wants one."""
    end = Path(path).suffix.lower()
    df = {".csv": lambda: read_csv(spark, path), ".tsv": lambda: read_csv(spark, path, "\t"), ".json": lambda: read_json(spark, path), ".jsonl": lambda: flattened(spark.read.json(path)), ".parquet": lambda: spark.read.parquet(path), ".xlsx": lambda: read_excel(spark, path), ".xls": lambda: read_excel(spark, path)}
    if end not in df:
        raise ValueError(f"no reader for {end!r}")
    out = df[end]()
    return out if rows is None else out.limit(rows)


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """file, column, ordinal, type of every file below a folder: schemas only."""
    out = [(n, c, i, t) for n, p in files(folder).items() for i, (c, t) in enumerate(read_any(spark, p).dtypes)]
    return spark.createDataFrame(out, "file string, column string, ordinal int, type string")


def column_files(spark: SparkSession, path: str) -> DataFrame:
    """column_id, term, n from files of one column, named <id>.<name>...: lines of value, value and count, or id, value and count between tabs."""
    rows = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([0-9]+)\.[^/]*$", 1).cast("int").alias("column_id"), F.split("value", "\t").alias("p"))
    n = F.size("p")
    return rows.select("column_id", F.when(n == 3, F.col("p")[1]).otherwise(F.col("p")[0]).alias("term"), F.coalesce(F.when(n == 3, F.get("p", F.lit(2))).when(n == 2, F.get("p", F.lit(1))).try_cast("long"), F.lit(1)).alias("n"))


def read_profiles(path: str) -> dict:
    """Profiles that write_profiles wrote."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
