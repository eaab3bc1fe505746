"""A Bloom filter of fixed size that keeps most rows of a large table out of a join's shuffle.

The filter has `BITS` bits whatever the data (so the broadcast has a proven
bound); with many more ids than that it lets every row through and the join
alone decides. It never loses a row of the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _places(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.int64).view(np.uint64)[:, None] + np.uint64(1)) * _FACTORS
    return ((x ^ (x >> np.uint64(32))) * _FACTORS[::-1] >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def sieve(ids: DataFrame) -> Broadcast:
    """The filter of a table of one column of whole numbers."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(_places(batch.column(0).drop_null().to_numpy(zero_copy_only=False)))
            at = np.unique(found >> 6)
            bits = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(bits, np.searchsorted(at, found >> 6), np.uint64(1) << (found & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = ids.mapInArrow(words, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    table = np.zeros(BITS // 64, np.uint64)  # at most BITS / 64 rows
    if rows:
        table[[r[0] for r in rows]] = np.array([r[1] for r in rows], np.int64).view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(table)


def sifted(rows: DataFrame, at: int, filter_of: Broadcast, inside: bool = True) -> DataFrame:
    """The rows whose id (column number `at`) may be in the filter, or the
    others; rows without an id are among the others."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filter_of.value
        for batch in batches:
            ids = batch.column(at)
            places = _places(ids.fill_null(0).to_numpy(zero_copy_only=False))
            hit = ((table[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            hit &= ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit if inside else ~hit))

    return rows.mapInArrow(sift, rows.schema)
