"""Problem 8: encoding texts with a public byte-level BPE.

Each worker builds one tiktoken encoding from a local rank file.  Texts longer
than CHUNK characters are split where the pre-splitting pattern always splits,
so that the ids of the parts are the ids of the whole: before white space that
follows a character that is not, and between a letter or other sign and a
digit.  Decoding joins the tokens' raw bytes, which gives the text back
whatever token ends inside a character.

Null and empty texts both give an empty list; strings that look like control
tokens are ordinary text.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import table

#: Where the rank files lie; a parameter of every function here.
FOLDER = os.environ.get("WEFT_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 20_000
#: White space after something else; a digit after a letter.
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[^\W\d_])(?=[0-9])")


@lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, name: str = NAME):
    """The tiktoken encoding of a rank file, made once per process."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = CHUNK) -> list[str]:
    """The text cut at safe boundaries into parts of about size characters; a run without any stays whole."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if m is None:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def encode(text: str | None, folder: str = FOLDER, name: str = NAME) -> list[int]:
    """Ids of one text."""
    if not text:
        return []
    e = encoder(folder, name)
    ids: list[int] = []
    for p in parts(text):
        ids += e.encode_ordinary(p)
    return ids


def decode(ids: list[int] | None, folder: str = FOLDER, name: str = NAME) -> str:
    """The text of ids, from the tokens' raw bytes."""
    e = encoder(folder, name)
    return b"".join(e.decode_single_token_bytes(i) for i in ids or []).decode("utf-8", "replace")


def with_ids(df: DataFrame, text: str = "text", out: str = "ids", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """Adds the ids of a text column; rows stay where they are (no shuffle)."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([encode(t, folder, name) for t in s], dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def token_count(column: Column, folder: str = FOLDER, name: str = NAME) -> Column:
    """Number of ids of a text column; 0 for null."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([len(encode(t, folder, name)) for t in s], dtype="int64")

    return count(column)


def p8_ids(spark, folder):
    return with_ids(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")
