"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct shingles of five words. Documents stand in
bands of sizes so that those that can reach the similarity stand in one band or
in two that follow each other. For each such pair of bands the shingles are
dealt by hash into parts, and each part is XOR-ed into a 64-bit parity sketch.
A shingle that only one of two sets has changes one part, so two sets with at
most D such shingles (3/4 similarity: a seventh of both sizes together) agree
in all but D of m parts. By the pigeonhole principle, in its prefix form, two
documents then share one of their first D + 1 sketches in any fixed order; the
order puts sketches of the most shingles first, as those are the rarest.

Tasks pack the sketches of many documents into one row per range of sketches,
each range is sorted in one task with arrays, and every list of documents that
share a sketch comes out once as a star around its smallest id. Stars are
checked by a second parity sketch, of four to eight bits per shingle: its Hamming
distance bounds the symmetric difference from below, and what it leaves is
verified on the exact sets. The links are joined to components, and only pairs
of a list that are still in different components remain; they go through the
same two checks. So all links between components are found without listing the pairs
of a group of copies.

Defined cases: a null or empty text, or one without words, has an empty set and
no links; with fewer words than a shingle the whole sequence is the shingle;
repeated rows share their id and so their component, and each is in the result;
rows with a null id are in the result with a null component and take no part;
an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import pick, tidied
from trialgrid.llm.components import components
from trialgrid.llm.sieve import sieve, sifted
from trialgrid.session import written

SHINGLE = 5
FLUSH_KEYS = 2_000_000
PACKED_KEYS = 250_000
NOTED_LISTS = 1_000_000
DOCS_PER_RANGE = 512
LEAST_BITS = 512
CACHED_WORDS = 50_000
KEY_BITS = 40

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                  np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Shingles:
    """Sets of 64-bit shingle hashes of texts."""

    def __init__(self):
        self.words = _Words()

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles. A-Z are lower-cased; words end at ASCII white space."""
        words = text.encode().lower().split() if text else []
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        size = min(n, SHINGLE)
        mixed = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            mixed = (mixed ^ hashes[k:n - size + 1 + k]) * _STEPS[k]
            mixed ^= mixed >> np.uint64(29)
        return np.unique(_mix(mixed))


class Bands:
    """Bands of sizes, and for each the greatest difference and the number of parts."""

    def __init__(self):
        self.lows = [1]

    def of(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(4 * self.lows[-1] // 3 + 1)
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def shape(self, band: int) -> tuple[int, int]:
        """(difference, parts) for pairs whose smaller set is in the band."""
        largest = self.lows[band + 1] - 1
        difference = (largest + 4 * largest // 3) // 7
        return difference, (3 * difference + 1) // 2 + 17 if difference else 1


def sketches(shingles: np.ndarray, band: int, difference: int, parts: int) -> np.ndarray:
    """The first `difference + 1` part sketches of a set, most shingles first."""
    part = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascends, as the shingles do
    part = part.astype(np.int64)
    counts = np.bincount(part, minlength=parts)
    filled = np.flatnonzero(counts)
    parity = np.zeros(parts, np.uint64)
    parity[filled] = np.bitwise_xor.reduceat(shingles, np.concatenate([[0], np.cumsum(counts[filled])[:-1]]))
    salt = _mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32))
    keys = _mix(parity ^ salt)
    return keys[np.lexsort((keys, -counts))[:difference + 1]]


def sketch_bits(size: int) -> int:
    """Bits of the sketch of a set: the power of two from four times its size on."""
    return max(LEAST_BITS, 1 << max(0, 4 * size - 1).bit_length())


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit."""
    bits = sketch_bits(len(shingles))
    ones = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (last axis) on fewer bits: the parities of a bit's preimages, XOR-ed."""
    return np.bitwise_xor.reduce(sketch.reshape(*sketch.shape[:-1], -1, words), axis=-2)


def may_link(one: tuple[int, bytes], two: tuple[int, bytes]) -> bool:
    """False if sizes, or the Hamming distance of the sketches as a lower bound
    of the symmetric difference, rule out the similarity."""
    if 4 * min(one[0], two[0]) < 3 * max(one[0], two[0]):
        return False
    a, b = np.frombuffer(one[1], np.uint64), np.frombuffer(two[1], np.uint64)
    words = min(len(a), len(b))
    return 7 * int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum()) <= one[0] + two[0]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, for sorted distinct shingles."""
    if not len(a) or not len(b):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= 75 * (len(a) + len(b) - common)


# ---------------------------------------------------------------- sketch join

PACKED = pa.schema([("span", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("base", pa.int64()),
                    ("width", pa.int32()), ("bits", pa.list_(pa.binary()))])
PACKED_DDL = "span bigint, keys binary, ids binary, base bigint, width int, bits array<binary>"
#: What the spans below 0 hold: sizes and bit sketches of documents, and links of equal sets met in one task.
SIZES, EQUAL = -1, -2
FOUND = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("members", pa.int64()), ("center", pa.int64()),
                   ("doc_id", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
FOUND_DDL = "kind int, bucket bigint, members bigint, center bigint, doc_id bigint, n bigint, bits binary"
KIND_SIZE, KIND_EQUAL, KIND_STAR = 0, 1, 2


def _pack(ids: np.ndarray) -> tuple[bytes, int, int]:
    """Ids as differences from the smallest, in the fewest of 1, 2, 4 or 8 bytes."""
    base = int(ids.min(initial=0)) if len(ids) else 0
    apart = (ids - base).view(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(ids) or int(apart.max()) < 1 << 8 * w)
    return apart.astype(f"<u{width}").tobytes(), base, width


def _unpack(data: bytes, base: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}").astype(np.uint64).view(np.int64) + base


def _key_bytes(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8].tobytes()


def _keys(data: bytes) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8).reshape(-1, KEY_BITS // 8)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :KEY_BITS // 8] = narrow
    return wide.view("<u8").ravel()


class _Sketches:
    """Sketches of many documents until they are packed, in arrays that are allocated once."""

    def __init__(self):
        most = FLUSH_KEYS + PACKED_KEYS  # room for the document that fills them
        self.keys, self.owner = np.empty(most, np.uint64), np.empty(most, np.int32)
        self.ids: list[int] = []
        self.total = 0

    def add(self, doc_id: int, keys: np.ndarray) -> None:
        upto = self.total + len(keys)
        if upto > len(self.keys):
            self.keys, self.owner = (np.concatenate([x[:self.total], np.empty(upto - self.total, x.dtype)])
                                     for x in (self.keys, self.owner))
        self.keys[self.total:upto], self.owner[self.total:upto] = keys, len(self.ids)
        self.ids.append(doc_id)
        self.total = upto

    def packed(self, n_spans: int) -> Iterator[tuple]:
        """One row per span, the sketches in the order in which they came; then all are forgotten."""
        key, owner, ids = self.keys[:self.total], self.owner[:self.total], np.array(self.ids, np.int64)
        span = np.empty(self.total, np.int32)
        for low in range(0, self.total, PACKED_KEYS):
            some = slice(low, low + PACKED_KEYS)
            span[some] = ((key[some] >> np.uint64(40)) * np.uint64(n_spans)) >> np.uint64(24)
        order = np.argsort(span, kind="stable").astype(np.int32)
        span = span[order]
        at = np.flatnonzero(np.diff(span, prepend=-1))
        for low, high in zip(at.tolist(), [*at[1:].tolist(), len(span)], strict=True):
            own = order[low:high]
            yield int(span[low]), _key_bytes(key[own]), *_pack(ids[owner[own]]), None
        self.ids, self.total = [], 0


def _packed_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of PACKED rows of about `PACKED_KEYS` sketches each."""
    out, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(PACKED)], schema=PACKED)

    for row in rows:
        out.append(row)
        size += len(row[2]) // row[4]
        if size >= PACKED_KEYS:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _emit_sketches(n_spans: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, bands, found = Shingles(), Bands(), _Sketches()
        first_of, equal, sizes = {}, [], []

        def packed():
            yield from found.packed(n_spans)
            spread = len(sizes) and (sizes[0][0] + len(sizes)) % 1024
            # ids and what belongs to them, one after the other
            for kind, rows in ((SIZES, sizes), (EQUAL, equal)):
                if rows:
                    a, b = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
                    bits = [r[2] for r in rows] if kind == SIZES else None
                    yield kind - 2 * spread, b.astype("<i8").tobytes(), *_pack(a), bits

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = make.of(text)
                sizes.append((doc_id, len(own), bit_sketch(own)))
                if len(own):
                    digest = xxhash.xxh3_128_digest(own.tobytes())
                    first = first_of.setdefault(digest, doc_id)
                    if first != doc_id:
                        equal.append((doc_id, first))
                    else:
                        band = bands.of(len(own))
                        for j in (band, band - 1):
                            if j >= 0:
                                found.add(doc_id, sketches(own, j, *bands.shape(j)))
                if found.total >= FLUSH_KEYS or len(sizes) >= 10_000:
                    yield from _packed_batches(packed())
                    first_of, equal, sizes = {}, [], []
        if sizes:
            yield from _packed_batches(packed())

    return emit


def _stars(key: np.ndarray, ids: np.ndarray, span: int, seen: set[int]) -> list[tuple]:
    """Stars of all lists of two or more documents that share a sketch, each list once."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    same = (key[1:] == key[:-1]) & (ids[1:] == ids[:-1])
    keep = np.concatenate([[True], ~same])
    key, ids = key[keep], ids[keep]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(at, len(key)))
    many = count > 1
    if not many.any():
        return []
    signature = _mix(np.add.reduceat(_mix(ids.view(np.uint64) + _STEPS[0]), at) + _STEPS[1] * count.astype(np.uint64))
    out = []
    for low, n, mark in zip(at[many].tolist(), count[many].tolist(), signature[many].tolist(), strict=True):
        if mark not in seen:
            seen.add(mark)
            out.append((span << KEY_BITS | int(key[low]), n, ids[low:low + n]))
    return out


def _join_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one span follow each other."""
    seen: set[int] = set()
    span, keys, ids = None, [], []

    def stars():
        if len(seen) > NOTED_LISTS:
            seen.clear()
        found = _stars(np.concatenate(keys), np.concatenate(ids), span, seen)
        if found:
            n = np.array([f[1] - 1 for f in found])
            columns = [np.full(n.sum(), KIND_STAR, np.int32), np.repeat([f[0] for f in found], n), np.repeat(n + 1, n),
                       np.repeat([f[2][0] for f in found], n), np.concatenate([f[2][1:] for f in found]), np.zeros(n.sum(), np.int64),
                       [None] * int(n.sum())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, FOUND, strict=True)], schema=FOUND)

    for batch in batches:
        for row_span, data, packed, base, width, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = _unpack(packed, base, width)
            if row_span < 0:
                other, equal = np.frombuffer(data, "<i8"), row_span % 2 == 0
                zero = np.zeros(len(own), np.int64)
                columns = [np.full(len(own), KIND_EQUAL if equal else KIND_SIZE, np.int32), zero, zero, other if equal else zero,
                           own, zero if equal else other, bits or [None] * len(own)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, FOUND, strict=True)], schema=FOUND)
                continue
            if row_span != span:
                if keys:
                    yield from stars()
                span, keys, ids = row_span, [], []
            keys.append(_keys(data))
            ids.append(own)
    if keys:
        yield from stars()


# ---------------------------------------------------------------- verification

LINKS_DDL = "a bigint, b bigint"
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Each task holds the sets
    of one a and meets its partners one by one."""
    wanted = pairs.select("a", F.col("b").alias("doc_id"), F.lit(1).alias("place")).unionAll(
        pairs.select("a", F.col("a").alias("doc_id"), F.lit(0).alias("place")).distinct())
    ids = wanted.select("doc_id").distinct()
    rows = wanted.join(sifted(texts, 0, sieve(ids)), "doc_id").select("a", "place", "doc_id", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, center, sets = Shingles(), None, []
        for batch in batches:
            links = []
            for a, place, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != center:
                    center, sets = a, []
                own = make.of(text)
                if place == 0:
                    sets.append(own)
                elif any(linked(s, own) for s in sets):
                    links.append((a, doc_id))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], schema=LINKS)

    return (rows.repartition("a").sortWithinPartitions("a", "place").select("a", "place", "doc_id", "text")
            .mapInArrow(tidied(check), LINKS_DDL).distinct())


def _near_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, doc_id) that the sketches don't rule out. A center's own rows come first."""
    center, own = None, []
    for batch in batches:
        pairs = []
        for a, place, doc_id, n, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if a != center:
                center, own = a, []
            if place == 0:
                own.append((n, bits))
            elif any(may_link(x, (n, bits)) for x in own):
                pairs.append((a, doc_id))
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=LINKS)


def _sketched(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs (a, b) that the full sketches don't rule out."""
    ends = pairs.select("a", F.col("b").alias("doc_id"), F.lit(1).alias("place")).unionAll(
        pairs.select("a", F.col("a").alias("doc_id"), F.lit(0).alias("place")).distinct())
    ends = ends.join(sketched, "doc_id").repartition("a").sortWithinPartitions("a", "place")
    return ends.select("a", "place", "doc_id", "n", "bits").mapInArrow(tidied(_near_stars), LINKS_DDL).distinct()


#: About as many documents around one center make a block; a task compares two blocks at a time.
BLOCK_ROWS = 2048
MOST_NOTED = 8192
PAIRS_PER_BATCH = 100_000


class _Family:
    """The documents of all lists around one center, or of two blocks of them, and the pairs among them
    (of two blocks: one of each) that the sketches don't rule out."""

    def __init__(self, members: list[tuple], across: bool):
        ids, block, label, n, bits, buckets = zip(*members, strict=True)
        self.ids, self.block, self.label, self.n = (np.array(x, np.int64) for x in (ids, block, label, n))
        self.across = across
        self.words = np.array([len(b) // 8 for b in bits])
        self.place = np.zeros(len(ids), np.int64)
        self.tables = {}
        for w in set(self.words.tolist()):
            own = np.flatnonzero(self.words == w)
            self.place[own] = np.arange(len(own))
            self.tables[w] = np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(-1, w)
        # the center, which comes without lists, is in all of them
        centers = [i for i, own in enumerate(buckets) if own is None]
        self.lists: dict[int, list] = {}
        for i, own in enumerate(buckets):
            for bucket in own or ():
                self.lists.setdefault(bucket, list(centers)).append(i)

    def pairs(self) -> Iterator[tuple[int, int]]:
        noted = np.zeros((len(self.ids),) * 2, bool) if len(self.ids) <= MOST_NOTED else None
        for members in self.lists.values():
            own = np.array(sorted(members))
            for k, i in enumerate(own[:-1].tolist()):
                rest = own[k + 1:]
                rest = rest[(self.label[rest] != self.label[i])
                            & (4 * np.minimum(self.n[rest], self.n[i]) >= 3 * np.maximum(self.n[rest], self.n[i]))]
                if self.across:
                    rest = rest[self.block[rest] != self.block[i]]
                if noted is not None:
                    rest = rest[~noted[i, rest]]
                    noted[i, rest] = True
                # similar sets have sketches of the same length, or of one and its double
                w = int(self.words[i])
                mine = self.tables[w][self.place[i]]
                for w2 in {w // 2, w, 2 * w} & self.tables.keys():
                    some = rest[self.words[rest] == w2]
                    if len(some):
                        short = min(w, w2)
                        apart = np.bitwise_count(fold(self.tables[w2][self.place[some]], short) ^ fold(mine, short))
                        near = 7 * apart.sum(axis=1, dtype=np.int64) <= self.n[some] + self.n[i]
                        for j in some[near].tolist():
                            a, b = int(self.ids[i]), int(self.ids[j])
                            yield (a, b) if a < b else (b, a)


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of documents of one list, in different components, that their sketches don't rule out."""
    group, members = None, []

    def tables():
        found = _Family(members, group[1] != group[2]).pairs()
        while some := list(itertools.islice(found, PAIRS_PER_BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in some], pa.int64()) for i in (0, 1)], schema=LINKS)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != group:
                if len(members) > 1:
                    yield from tables()
                group, members = row[:3], []
            members.append(row[3:])
    if len(members) > 1:
        yield from tables()


def _in_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """The members (center, doc_id, ...) with the pairs of blocks (low, high) they are compared in: one
    pair of equal blocks around most centers; around those of many documents (sizes: center, members)
    each member meets every block, in a group of its own."""
    large = written(sizes.where(F.col("members") > BLOCK_ROWS)
                    .select("center", F.ceil(F.col("members") / BLOCK_ROWS).cast("int").alias("blocks")), "jaccard-large")
    # broadcast: a row stands for BLOCK_ROWS rows of `members` at least
    dealt = members.join(F.broadcast(large), "center", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `documents`: doc_id, n_shingles, component_id."""
    given = pick(documents, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), "text")
    texts = given.where("doc_id IS NOT NULL")
    n_spans = min(1 << 22, max(64, documents.count() // DOCS_PER_RANGE))
    packed = texts.mapInArrow(tidied(_emit_sketches(n_spans)), PACKED_DDL)
    found = written(packed.repartition("span").sortWithinPartitions("span").mapInArrow(tidied(_join_sketches), FOUND_DDL),
                    "jaccard-found")

    stars = found.where(F.col("kind") == KIND_STAR)
    equal = found.where(F.col("kind") == KIND_EQUAL).select(F.col("center").alias("a"), F.col("doc_id").alias("b"))
    sketched = found.where(F.col("kind") == KIND_SIZE).select("doc_id", "n", "bits")
    star_pairs = written(stars.select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct(), "jaccard-pairs")
    first_pairs = written(_sketched(star_pairs, sketched), "jaccard-pairs")
    links = written(_verify(first_pairs, texts).unionAll(equal), "jaccard-links")
    label = components(links)

    # lists of three or more, around centers with documents in other components: each document once per center, with its lists
    label_of = lambda c: label.select(F.col("id").alias(f"id_{c}"), F.col("component").alias(f"label_{c}"))
    labelled = (star_pairs.join(label_of("a"), F.col("a") == F.col("id_a"), "left")
                .join(label_of("b"), F.col("b") == F.col("id_b"), "left")
                .select("a", "b", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label_b")))
    split = written(labelled.where("label_a <> label_b").select(F.col("a").alias("center"), F.col("label_a").alias("label"))
                    .distinct(), "jaccard-centers")
    lists = (stars.where("members > 2").select("center", "doc_id", "bucket").join(split.select("center"), "center", "left_semi")
             .groupBy("center", "doc_id").agg(F.collect_set("bucket").alias("buckets"))
             .join(label_of("d"), F.col("doc_id") == F.col("id_d"), "left")
             .select("center", "doc_id", F.coalesce("label_d", "doc_id").alias("label"), "buckets"))
    members = lists.unionAll(split.select("center", F.col("center").alias("doc_id"), "label",
                                          F.lit(None).cast("array<bigint>").alias("buckets")))
    sizes = (star_pairs.join(split.select(F.col("center").alias("a")), "a", "left_semi").groupBy(F.col("a").alias("center"))
             .agg(F.count(F.lit(1)).alias("members")))
    members = (_in_blocks(members.join(sketched, "doc_id"), sizes).repartition("center", "low", "high")
               .sortWithinPartitions("center", "low", "high", "doc_id")
               .select("center", "low", "high", "doc_id", "block", "label", "n", "bits", "buckets"))
    more_pairs = members.mapInArrow(tidied(_near_pairs), LINKS_DDL).distinct().join(star_pairs, ["a", "b"], "left_anti")
    more = written(_verify(written(more_pairs, "jaccard-pairs"), texts), "jaccard-links")

    final = components(links.unionAll(more))
    sizes = found.where(F.col("kind") == KIND_SIZE).select("doc_id", F.col("n").alias("n_shingles"))
    result = sizes.join(final, sizes["doc_id"] == final["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    without_id = given.where("doc_id IS NULL").mapInArrow(tidied(_count_shingles), "doc_id bigint, n_shingles bigint")
    return result.unionAll(without_id.select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id")))


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Shingles()
    for batch in batches:
        n = [len(make.of(text)) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_shingles"])


def representatives(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `documents` without near duplicates: of each component the
    document with the smallest id, once. Rows without an id or without words stay."""
    components_of = written(near_duplicates(documents, id_col, text_col), "jaccard-components")
    names = documents.columns
    numbered = documents.toDF(*[f"c{i}" for i in range(len(names))])
    at = F.col(f"c{names.index(id_col)}")
    gone = components_of.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    filter_of, place = sieve(gone), names.index(id_col)
    kept = (sifted(numbered, place, filter_of).join(gone, at == F.col("_gone"), "left_anti")
            .unionAll(sifted(numbered, place, filter_of, inside=False)))
    repeated = written(components_of.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_again")).count()
                       .where("count > 1").select("_again"), "jaccard-repeated")
    if not repeated.isEmpty():
        once = kept.join(repeated, at == F.col("_again"), "left_semi").dropDuplicates([f"c{names.index(id_col)}"])
        kept = kept.join(repeated, at == F.col("_again"), "left_anti").unionAll(once)
    return kept.toDF(*names)
