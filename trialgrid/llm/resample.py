"""Target-distribution importance resampling.

Every document is weighed by how much likelier its features are in the target
texts than in the corpus, and a share of the documents is drawn without
replacement by the highest sum of that weight and a noise drawn from the
document's id (Gumbel noise, so the draw follows the weights).

Features are all runs of one to `max_words` consecutive words, repeats
counted, hashed by CRC-32 into `n_buckets` buckets. The texts are cut and
hashed as byte arrays: one step of the checksum runs over the k-th bytes of
all words of a block at once. A block holds `BLOCK_BYTES` of texts; a longer
text is cut between words, the last words of a piece being read again with the
next one. Counts leave a task as one row per bucket, so the only thing that
meets the driver is the table of gains, one number per bucket.

The cutoff is found without sorting the corpus: a mergeable quantile sketch
(KLL) of all scores names a bracket around the wanted rank, exact counts
above and inside it confirm the bracket or widen it, and only the rows of the
bracket are ranked. The drawn rows are then numbered range by range, with the
sketch's quantiles as frozen borders, so that nothing depends on how rows
fall into partitions and a lost task can be run again.

Defined cases: a null text is an empty one; a text without words has weight 0;
a null id has an empty text in the noise's key and comes last among ties; rows
that repeat an id and a score share the places at the cutoff in any order (the
number drawn is exact); empty tables draw nothing; other columns never matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.llm.common import pick
from trialgrid.session import written

N_BUCKETS = 10_000
MAX_WORDS = 2
MIN_WORDS = 20
SHARE_PERCENT = 25
SEED = 7
BLOCK_BYTES = 1 << 22
#: Bytes of a word that are hashed in step with the other words; the few longer ones go on alone.
STEPS = 64
#: Size of the quantile sketch (rank error about 0.1 %) and half the first bracket's width, in ranks.
SKETCH_K, BRACKET = 4096, 0.004
#: Rows per range when drawn rows are numbered, and the most ranges.
RANGE_ROWS, MOST_RANGES = 200_000, 512

#: Words are made of ASCII letters (after lower-casing A-Z), digits and all other characters above ASCII.
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
_IN_WORD = ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | (_BYTES >= 0x80)
_ALL = np.uint32(0xFFFFFFFF)


def _step_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_STEP = _step_table()


def _feed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The checksum states after the bytes data[start:end] of each row."""
    state, lengths = state.copy(), ends - starts
    live = np.flatnonzero(lengths)
    for k in range(STEPS):
        if not live.size:
            return state
        now = state[live]
        state[live] = _STEP[(now ^ data[starts[live] + k]) & 255] ^ (now >> 8)
        live = live[lengths[live] > k + 1]
    for i in live:
        rest = data[starts[i] + STEPS:ends[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i] ^ _ALL)) ^ 0xFFFFFFFF
    return state


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes; none crosses an edge."""
    word = _IN_WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _runs(data, starts, ends, doc, known, max_words, n_buckets):
    """(doc, bucket) of every run of one to `max_words` words whose last word is not among the first `known`."""
    docs, buckets = [], []
    state = _feed(np.full(len(starts), _ALL), data, starts, ends)
    for size in range(1, max_words + 1):
        if size > 1:  # extend the runs by a space and the next word of the same document
            fits = doc[:-1][:len(state) - 1] == doc[size - 1:]
            state = np.where(fits, state[:-1], 0).astype(np.uint32)
            state = _feed(_STEP[(state ^ 0x20) & 255] ^ (state >> 8), data, starts[size - 1:], ends[size - 1:])
        else:
            fits = np.ones(len(state), bool)
        keep = fits & (np.arange(len(state)) + size - 1 >= known)
        docs.append(doc[:len(state)][keep])
        buckets.append(((state ^ _ALL) % np.uint32(n_buckets))[keep])
        if len(state) < 2:
            break
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


def hashed_runs(texts: pa.Array, max_words: int = MAX_WORDS, n_buckets: int = N_BUCKETS,
                block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document numbers, buckets, words per document) of all runs of words, a block of texts at a time."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    n, at = len(texts), 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1)
        begin, end = int(offsets[at]), int(offsets[upto])
        if end - begin <= block_bytes:
            data = _LOWER[raw[begin:end]]
            edges = offsets[at:upto + 1] - begin
            starts, ends = _words(data, edges)
            doc = np.searchsorted(edges, starts, side="right") - 1 + at
            if len(starts):
                yield *_runs(data, starts, ends, doc, 0, max_words, n_buckets), np.bincount(doc, minlength=n)
        else:  # one long text, in pieces that end between words
            cut, known = begin, 0
            while cut < end:
                limit = min(cut + block_bytes, end)
                while limit < end and _IN_WORD[_LOWER[raw[limit - 1]]]:
                    limit += 1
                data = _LOWER[raw[begin:limit]]
                starts, ends = _words(data, np.array([0, len(data)]))
                if len(starts) > known:
                    doc = np.full(len(starts), at)
                    words = np.zeros(n, np.int64)
                    words[at] = len(starts) - known
                    yield *_runs(data, starts, ends, doc, known, max_words, n_buckets), words
                known = min(len(starts), max_words - 1)
                begin, cut = (begin + int(starts[-known]) if known else limit), limit
        at = upto


def feature_counts(texts: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS,
                   n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, buckets, _ in hashed_runs(batch.column(0), max_words, n_buckets):
                total += np.bincount(buckets, minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = pick(texts, text=text_col).select(F.col("text").cast("string")).mapInArrow(count, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from the counts of both sides: the
    floored thousandths of the log of how much likelier the bucket is in the
    target, with one more feature counted in every bucket of each side."""
    s, t = source.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = (source.sparkSession.range(n_buckets).withColumnRenamed("id", "bucket")
            .join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"]))
    everything = Window.partitionBy()  # one row per bucket
    total = {c: F.sum(c).over(everything).cast("double") + F.lit(float(n_buckets)) for c in ("s", "t")}
    one = F.lit(1.0)
    ratio = ((F.col("t") + one) * total["s"]) / ((F.col("s") + one) * total["t"])
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("bigint").alias("gain"))


def weigh(documents: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          max_words: int = MAX_WORDS) -> DataFrame:
    """(id, n_words, n_features, weight) of every document; weight is the floored mean of its features' gains."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, sums = (np.zeros(n, np.int64) for _ in range(3))
            for doc, buckets, n_words in hashed_runs(batch.column(1), max_words, len(gains)):
                first = int(doc.min()) if len(doc) else 0
                words += n_words
                found = np.bincount(doc - first)
                features[first:first + len(found)] += found
                # whole numbers far below 2 ** 53, so their sum in doubles is exact
                sums[first:first + len(found)] += np.bincount(doc - first, weights=gains[buckets]).astype(np.int64)
            weight = np.floor_divide(sums, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))],
                                             ["id", "n_words", "n_features", "weight"])

    rows = pick(documents, id=id_col, text=text_col).select(F.col("id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(add_up, "id bigint, n_words bigint, n_features bigint, weight bigint")


def noisy_score(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """`weighed` with `score`: weight plus the floored thousandths of Gumbel noise, drawn from seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + F.floor(noise).cast("bigint"))


def _numbered(rows: DataFrame, borders: list[float]) -> DataFrame:
    """`rows` with `place`: 1, 2, 3 .. by falling score, then rising id (nulls last)."""
    span = F.size(F.filter(F.array(*map(F.lit, borders)).cast("array<double>"), lambda b: b > F.col("score"))).cast("int")
    spanned = rows.withColumn("_span", span)
    sizes = spanned.groupBy("_span").agg(F.count(F.lit(1)).alias("n"))  # one row per range at most
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_span").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return (spanned.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(offsets), "_span")
            .withColumn("place", (F.col("_before") + F.col("_at")).cast("bigint")).drop("_span", "_at", "_before"))


def _quantiles(sketch: DataFrame, shares: list[float]) -> list[float]:
    """The sketch's values at these shares of the rows, from below."""
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias(f"q{i}") for i, s in enumerate(shares)]
    return list(sketch.select(*at).first())


def bracket_cutoff(scored: DataFrame, sketch: DataFrame, n: int, k: int,
                   bracket: float = BRACKET) -> tuple[int, int | None, int]:
    """(score, id) of the k-th row of `scored` (n rows) by falling score, then
    rising id, and how many brackets were tried. Outside the bracket rows are
    only counted."""
    middle, tries, half = 1.0 - k / n, 0, bracket
    while True:
        low, high = max(0.0, middle - half), min(1.0, middle + half)
        at = _quantiles(sketch, [low, high])
        low_value = at[0] if low > 0 else float("-inf")
        high_value = at[1] if high < 1 else float("inf")
        tries += 1
        over = F.col("score") > F.lit(high_value)
        inside = ~over & (F.col("score") >= F.lit(low_value))
        n_over, n_inside = scored.agg(F.count_if(over), F.count_if(inside)).first()
        if n_over < k <= n_over + n_inside:
            break
        half *= 4
    found = _numbered(scored.where(inside), _borders(sketch, n_inside, low, high)).where(F.col("place") == k - n_over).first()
    return found["score"], found["id"], tries


def _borders(sketch: DataFrame, n: int, low: float = 0.0, high: float = 1.0) -> list[float]:
    pieces = max(2, min(MOST_RANGES, n // RANGE_ROWS + 1))
    return _quantiles(sketch, [low + (high - low) * i / pieces for i in range(1, pieces)])


def draw(scored: DataFrame, min_words: int = MIN_WORDS, share_percent: int = SHARE_PERCENT,
         bracket: float = BRACKET) -> DataFrame:
    """`scored` (id, n_words, score, ..) with `rank`: 1, 2, 3 .. for the rows
    drawn among those of at least `min_words` words, null for all others.
    `scored` is read several times: give a written table."""
    able = scored.where(F.col("n_words") >= min_words)
    sketch = written(able.agg(F.count(F.lit(1)).alias("n"),
                              F.kll_sketch_agg_double(F.col("score").cast("double"), SKETCH_K).alias("sketch")), "scores")
    n = sketch.first()["n"]
    k = share_percent * n // 100
    none = F.lit(None).cast("bigint")
    if k == 0:
        return scored.withColumn("rank", none)
    score, last, _ = bracket_cutoff(able, sketch, n, k, bracket)
    tied = F.lit(True) if last is None else F.coalesce(F.col("id") <= F.lit(last), F.lit(False))
    above = (F.col("n_words") >= min_words) & ((F.col("score") > F.lit(score)) | ((F.col("score") == F.lit(score)) & tied))
    numbered = _numbered(scored.where(above), _borders(sketch, k, 1.0 - k / n, 1.0))
    drawn = numbered.withColumn("rank", F.when(F.col("place") <= k, F.col("place"))).drop("place")
    return drawn.unionByName(scored.where(~above).withColumn("rank", none))


def resample(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", seed: int = SEED, min_words: int = MIN_WORDS,
             share_percent: int = SHARE_PERCENT, max_words: int = MAX_WORDS, n_buckets: int = N_BUCKETS) -> DataFrame:
    """Every document's id with n_words, n_features, weight, score and rank (null: not drawn)."""
    gains = bucket_gains(feature_counts(documents, text_col, max_words, n_buckets),
                         feature_counts(target, target_text_col, max_words, n_buckets), n_buckets)
    table = np.zeros(n_buckets, np.int64)
    for bucket, gain in gains.collect():  # `n_buckets` rows, whatever the corpus
        table[bucket] = gain
    scored = written(noisy_score(weigh(documents, table, id_col, text_col, max_words), seed), "weights", "zstd")
    return draw(scored, min_words, share_percent).withColumnRenamed("id", id_col)


def drawn_documents(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of `documents`, whole; ids must tell the rows apart."""
    ranks = resample(documents, target, id_col, **options).where(F.col("rank").isNotNull())
    names = list(documents.columns)
    at = names.index(id_col)
    rows = documents.toDF(*[f"_{i}" for i in range(len(names))])
    return rows.join(ranks.select(F.col(id_col).alias("drawn")), F.col(f"_{at}") == F.col("drawn"), "left_semi").toDF(*names)
