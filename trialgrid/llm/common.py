"""Helpers the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words of a text, and the white space between them (Java and SQL regular expressions).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns `source` as `target` for each `target=source`, by position.

    Other columns of `df` never matter, not even ones that repeat a name or
    differ from it only in case: the first exact match is taken."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    missing = [c for c in names.values() if c not in at]
    if missing:
        raise ValueError(f"no column {missing[0]!r}")
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{at[c]}").alias(target) for target, c in names.items()])


def word_count(text: Column) -> Column:
    """Number of words of `text` (null: 0) without building an array of them:
    every word and the space around it become one character."""
    one_each = F.regexp_replace(text, f"{SPACE}*{WORD}{SPACE}*", "x")
    return F.when(text.rlike(WORD), F.length(one_each)).otherwise(F.lit(0)).cast("bigint")


def hex_fraction(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a fraction from 0 to below 1."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """`work` for mapInArrow, whose worker gives back the memory that Arrow and the
    C library keep for later when a task ends: workers stay while other stages run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:  # glibc only
                trim(0)
    return run
