"""Removal of repeated 100-byte strings, by suffix arrays built with a difference cover.

A byte goes if it lies in a 100-byte string of its document that also starts
earlier (smaller doc_id, or same document at an earlier byte).

Only strings that occur twice need sorting, and equal strings choose equal
anchors: of the `GRAM`-byte grams in a window of 100 bytes the one with the least
hash. So anchors are shuffled by the hash of their gram, and from each class
comes what can matter. An anchor whose whole surroundings (all bytes that a
window with this anchor can reach) are those of an earlier anchor is repeated
whole. The first of each kind of surroundings stays, if its class has several
kinds: they are shuffled by what windows share beside the gram to the left or
right, which then stands as one symbol, and each task sorts the suffixes of its
surroundings with the difference cover modulo 3: triples at positions 1 and 2 modulo 3 are sorted and named, the string
of names is sorted the same way until names are unique, the remaining suffixes
are sorted by their first symbol and the rank behind it and merged in. Suffixes
next to each other that agree in 100 bytes form a class, in which all but the
earliest start are marked. A gram with `HOT_ROWS` surroundings or more (a passage that
many otherwise different documents hold) would make one side of any size: its
windows are listed one by one and grouped by their bytes, spread over all tasks.

The suffix arrays stand on the surroundings and not on the whole corpus at once:
recursing over all bytes would shuffle every byte's position with its names
several times over. See the README for figures.

Surroundings and what windows share are told apart by 64-bit hashes (polynomials over
bytes from a fixed random table, then mixed): as for random functions, two of m different strings
meet with a probability of about m * m / 2 ** 65, 3e-4 for 10 ** 8; inside a side bytes are compared.
Of a gram's hash 48 bits are shuffled: grams that meet in them only send more surroundings to be sorted.

Defined cases: a null or empty text has no bytes; rows that repeat a doc_id are
taken as one document; documents without an id come before all others; texts
under 100 bytes lose nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import pick, tidied
from trialgrid.llm.sieve import sieve, sifted
from trialgrid.session import written

WINDOW, GRAM = 100, 32
REACH = WINDOW - GRAM  # bytes that a window can reach before its anchor
HALF = REACH // 2
SORT_BYTES = 1 << 19
HOT_ROWS = 1 << 13
NO_ID = -(1 << 63)
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any substring of a text, from sums of powers modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _powers(BASE, n), dtype=np.uint64)])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mix((self.sums[high] - self.sums[low]) * self.back[low] + (high - low).astype(np.uint64))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """The least or greatest of every `width` values in a row, by doubling."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    if done < width:
        x = best(x[:len(x) - (width - done)], x[width - done:])
    return x


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, hash of the surroundings, place, bytes before, bytes from the place on) of a text's anchors."""
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hashes = Hashes(data)
    at = np.arange(n - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    least = _sliding(grams, REACH + 1, np.minimum)  # per window of 100 bytes
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    place = np.flatnonzero(_sliding(padded, REACH + 1, np.maximum) == grams)
    before, behind = np.minimum(place, REACH), np.minimum(n - place, WINDOW)
    around = hashes.of(place - before, place + behind) ^ _mix((before * 1000 + behind).astype(np.uint64))
    return grams[place], around, place, before, behind


# ---------------------------------------------------------------- suffix arrays

def _packed(*columns: np.ndarray) -> np.ndarray | None:
    """One number per row, in the rows' order, if the columns are small enough."""
    width = 63 // len(columns)
    if len(columns[0]) and max(int(c.max()) for c in columns) >= 1 << width:
        return None
    out = columns[0].copy()
    for c in columns[1:]:
        out = (out << width) | c
    return out


def _order(*columns: np.ndarray) -> np.ndarray:
    key = _packed(*columns)
    return np.lexsort(columns[::-1]) if key is None else np.argsort(key)


def _names(*columns: np.ndarray) -> np.ndarray:
    """Names from 1 on: equal rows of the columns share one, in their order."""
    order = _order(*columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of whole numbers from 1 on, with the difference cover modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text, np.zeros(3, np.int64)])
    # with a place behind the end where n is 1 modulo 3, so that each rest-0 suffix has its rest-1 neighbour
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    names = _names(s[sample], s[sample + 1], s[sample + 2])
    if names.max() < len(sample):
        order = suffix_array(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    in_order = np.empty(len(sample), np.int64)
    in_order[names - 1] = sample
    in_order = in_order[in_order < n]
    rest = np.arange(0, n, 3)
    rest = rest[_order(s[rest], rank[rest + 1])]
    # a rest-0 suffix compares with one of rest 1 by a symbol and a rank, with one of rest 2 by two symbols and a rank
    before = np.zeros(len(rest), np.int64)
    for k in (1, 2):
        others = in_order[in_order % 3 == k]
        columns = [np.concatenate([s[rest + i], s[others + i]]) for i in range(k)]
        columns.append(np.concatenate([rank[rest + k], rank[others + k]]))
        key = _packed(*columns)
        key = _names(*columns) if key is None else key
        before += np.searchsorted(key[len(rest):], key[:len(rest)])
    out, at = np.empty(n, np.int64), before + np.arange(len(rest))
    sampled = np.ones(n, bool)
    sampled[at] = False
    out[at], out[sampled] = rest, in_order
    return out


def repeated_starts(lefts: list[bytes], rights: list[bytes], sides: np.ndarray, documents: np.ndarray,
                    starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of all 100-byte strings in the surroundings that also
    start earlier in them. What all surroundings of a side (numbered from 0)
    share stands between left and right as one symbol, so a window is `HALF` + 1 symbols."""
    before, sizes = (np.array([len(x) for x in lefts]), np.array([len(a) + len(b) for a, b in zip(lefts, rights, strict=True)]) + 2)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(x for a, b in zip(lefts, rights, strict=True) for x in (a, b"\0", b, b"\0")), np.uint8)
    symbols = data.astype(np.int64) + 1 + len(lefts) + int(sides.max()) + 1
    middle = ends - sizes + before
    symbols[middle] = 1 + len(lefts) + sides
    symbols[ends - 1] = np.arange(1, len(lefts) + 1)  # every end is a symbol of its own
    order = suffix_array(symbols)
    owner = np.repeat(np.arange(len(lefts)), sizes)[order]
    whole = ends[owner] - 1 - order > HALF
    order, owner = order[whole], owner[whole]
    if len(order) < 2:
        return documents[:0], starts[:0]
    ahead, side = (middle[owner] - order), sides[owner]
    windows = np.lib.stride_tricks.sliding_window_view(data, HALF + 1)
    same = (side[1:] == side[:-1]) & (ahead[1:] == ahead[:-1])
    for low in range(0, len(same), 100_000):
        at = np.flatnonzero(same[low:low + 100_000]) + low
        same[at] = (windows[order[at]] == windows[order[at + 1]]).all(axis=1)
    group = np.concatenate([[0], np.cumsum(~same)])
    # only classes of two or more can hold a repeat
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    group, document = group[many], documents[owner[many]]
    start = starts[owner[many]] + before[owner[many]] - ahead[many]
    by = np.lexsort((start, document, group))
    group, document, start = group[by], document[by], start[by]
    if not len(group):
        return document, start
    head = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (document != document[first]) | (start != start[first])
    return document[later], start[later]


# ---------------------------------------------------------------- Spark

#: An anchor as it is shuffled: what differs from row to row stands together, and what hardly does is one number.
#: key: 48 bits of the gram's hash, the low 16 of the place; rest: the place's other bits, 16 of before, 1 for later, 15 of behind.
ANCHORS_DDL = "key bigint, around bigint, doc bigint, rest bigint"
ANCHORS = pa.schema([("key", pa.int64()), ("around", pa.int64()), ("doc", pa.int64()), ("rest", pa.int64())])
LATER = 1 << 15
TOGETHER = 500_000  # anchors of a task that are compared before the shuffle


def _later(gram: np.ndarray, around: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which anchors have the surroundings of an earlier one among these."""
    by = np.argsort(gram * np.uint64(BASE) ^ around, kind="stable")
    same = (gram[by][1:] == gram[by][:-1]) & (around[by][1:] == around[by][:-1])
    later = np.zeros(len(gram), bool)
    if not same.any():
        return later
    group = np.concatenate([[0], np.cumsum(~same)])
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    at, group = by[many], group[many]
    order = np.lexsort((place[at], doc[at], group))
    at, group = at[order], group[order]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    first = at[np.flatnonzero(head)[np.cumsum(head) - 1]]
    later[at] = (doc[at] != doc[first]) | (place[at] != place[first])
    return later


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, total = [], 0

        def table(rows=rows):
            gram, around, doc, place, before, behind = (np.concatenate(c) for c in zip(*rows, strict=True))
            gram = gram >> np.uint64(16) << np.uint64(16)
            later = _later(gram, around, doc, place)  # needs no hashes any more
            gram[later], around[later] = 0, 0
            key = gram | (place & 0xFFFF).astype(np.uint64)
            rest = (place >> 16 << 32) | (before << 16) | np.where(later, LATER, 0) | behind
            arrays = [key.view(np.int64), around.view(np.int64), doc, rest]
            out = pa.RecordBatch.from_arrays([pa.array(a, t.type) for a, t in zip(arrays, ANCHORS, strict=True)], schema=ANCHORS)
            rows.clear()
            return out

        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            gram, around, place, before, behind = anchors(np.frombuffer((text or "").encode(), np.uint8))
            if len(gram):
                rows.append((gram, around, np.full(len(gram), doc, np.int64), place, before, behind))
                total += len(gram)
            if total > TOGETHER:
                yield table()
                total = 0
        if rows:
            yield table()


MARKS_DDL = "whole boolean, gram bigint, doc bigint, place int, before int, behind int"
MARKS = pa.schema([("whole", pa.bool_()), ("gram", pa.int64()), ("doc", pa.int64()), ("place", pa.int32()),
                   ("before", pa.int32()), ("behind", pa.int32())])


def _mark_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, surroundings, document and place. Out come anchors
    whose surroundings are an earlier one's (whole), and the first of each kind where a class has several.
    Anchors known to be later ones lie anywhere and go through as they are."""
    held = None  # the last first-of-its-kind row, and whether it is out already
    for batch in batches:
        later = pc.less(batch.column(5), 0)
        known = batch.filter(later)
        if known.num_rows:
            reach = pc.subtract(pa.scalar(-1, pa.int32()), known.column(5))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(known.num_rows, bool)), *known.columns[0:1], *known.columns[2:5], reach], schema=MARKS)
        batch = batch.filter(pc.invert(later))
        if not batch.num_rows:
            continue
        gram, around, doc, place, before, behind = (c.to_numpy() for c in batch.columns)
        if held is not None:
            gram, around, doc, place, before, behind = (np.concatenate([[h], c]) for h, c in zip(
                held[0], (gram, around, doc, place, before, behind), strict=True))
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])
        first = np.flatnonzero(new)
        own = first[np.cumsum(new) - 1]
        whole = ~new & ((doc != doc[own]) | (place != place[own]))
        several = gram[first[1:]] == gram[first[:-1]]
        kinds = np.zeros(len(gram), bool)
        kinds[first[1:][several]] = True
        kinds[first[:-1][several]] = True
        if held is not None and held[1]:
            kinds[0] = False
        last = int(first[-1])
        out = bool(kinds[last]) or (held is not None and last == 0 and held[1])
        held = (tuple(c[last] for c in (gram, around, doc, place, before, behind)), out)
        chosen = np.flatnonzero(whole | kinds)
        if len(chosen):
            yield pa.RecordBatch.from_arrays([pa.array(a, t.type) for a, t in zip(
                (whole[chosen], np.where(whole[chosen], 0, gram[chosen]), doc[chosen], place[chosen], before[chosen], behind[chosen]), MARKS, strict=True)], schema=MARKS)


AROUND_DDL = "side bigint, doc bigint, start bigint, left binary, right binary"
AROUND = pa.schema([("side", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
SHARED = GRAM + HALF


def _emit_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window with an anchor reaches `HALF` bytes behind its gram, or as
    far before it. So per anchor twice: the hash of what such windows share, and the `HALF` bytes on both sides of that."""
    for batch in batches:
        rows = []
        for doc, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            hashes, n = Hashes(np.frombuffer(data, np.uint8)), len(data)
            for kind, shift in enumerate((0, -HALF)):
                low = np.array(places, np.int64) + shift
                low = low[(low >= 0) & (low + SHARED <= n)]
                low = low[np.minimum(low, HALF) + np.minimum(n - low - SHARED, HALF) >= HALF]
                sides = _mix(hashes.of(low, low + SHARED) + np.uint64(kind)).view(np.int64)
                rows += [(side, doc, max(0, p - HALF), data[max(0, p - HALF):p], data[p + SHARED:p + SHARED + HALF])
                         for side, p in zip(sides.tolist(), low.tolist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(AROUND)], schema=AROUND)


SPANS_DDL = "doc bigint, low bigint, high bigint"
SPANS = pa.schema([("doc", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _runs(document: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts that follow each other as one span of bytes."""
    by = np.lexsort((start, document))
    document, start = document[by], start[by]
    cut = np.flatnonzero(np.concatenate([[True], (document[1:] != document[:-1]) | (start[1:] > start[:-1] + WINDOW)]))
    last = np.concatenate([cut[1:], [len(start)]]) - 1
    return document[cut], start[cut], start[last] + WINDOW


def _sort_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one side follow each other; several sides are sorted in one run."""
    rows, size, current, count, number = [], 0, None, 0, -1

    def spans():
        side, documents, starts, lefts, rights = zip(*rows, strict=True)
        found = repeated_starts(lefts, rights, *(np.array(x, np.int64) for x in (side, documents, starts)))
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in _runs(*found)], schema=SPANS)

    for batch in batches:
        for side, doc, start, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if side != current:
                if count == 1:  # alone under its side: nothing to compare with
                    size -= SHARED + len(rows.pop()[3])
                    number -= 1
                if size >= SORT_BYTES:
                    yield from spans()
                    rows, size, number = [], 0, -1
                current, count, number = side, 0, number + 1
            rows.append((number, doc, start, left, right))
            size += SHARED + len(left)
            count += 1
    if count == 1:
        rows.pop()
    if rows:
        yield from spans()


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                  ("kept_sha256", pa.string())])
KEPT_DDL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(data: bytes, spans: list) -> tuple[list[bytes], int, int]:
    """What is left of a text, the number of bytes removed, and of runs of them."""
    left, at, removed, runs = [], 0, 0, 0
    for low, high in sorted(spans):
        if low > at or not runs:
            left.append(data[at:low])
            runs += 1
            removed += high - low
        else:
            removed += max(0, high - at)
        at = max(at, high)
    left.append(data[at:])
    return left, removed, runs


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode()
            left, removed, runs = _cut(data, [(s["low"], s["high"]) for s in spans or ()])
            rows.append((None if doc == NO_ID else doc, len(data), removed, runs, hashlib.sha256(b"".join(left)).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(KEPT)], schema=KEPT)


def _surroundings(texts: DataFrame, first: DataFrame) -> DataFrame:
    """The surroundings of the anchors `first` (doc, place), twice each, by side."""
    # lists take up more than their rows are estimated by: never broadcast them
    kinds = first.groupBy("doc").agg(F.collect_list("place").alias("places")).withColumnRenamed("doc", "_doc").hint("merge")
    near = sifted(texts, 0, sieve(kinds.select("_doc"))).join(kinds, F.col("doc") == F.col("_doc")).select("doc", "text", "places")
    return near.mapInArrow(tidied(_emit_surroundings), AROUND_DDL)


def _sorted_spans(texts: DataFrame, first: DataFrame) -> DataFrame:
    around = _surroundings(texts, first).repartition("side").sortWithinPartitions("side", "doc", "start")
    return written(around.mapInArrow(tidied(_sort_surroundings), SPANS_DDL), "suffix-spans", tidy=True)


def _hot_spans(texts: DataFrame, first: DataFrame) -> DataFrame:
    """The same for anchors of hot grams. A window is what its side shares and, by its place, the
    bytes to the left and right of that: equal windows are found by an aggregation, and all but
    the earliest by a join with one row per repeated window. A window that very many rows hold makes the
    other side of that join skewed: Spark splits such partitions, and nothing is copied beforehand."""
    around = written(_surroundings(texts, first), "suffix-around", tidy=True)
    before, ahead = F.octet_length("left"), F.col("ahead")
    windows = (around.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(HALF))))
               .where((before >= ahead) & (F.octet_length("right") >= HALF - ahead))
               .select("side", "ahead", "doc", "start", (F.col("start") + before - ahead).alias("low"),
                       F.concat(F.substring("left", before - ahead + 1, ahead),
                                F.substring("right", F.lit(1), HALF - ahead)).alias("wings")))
    window = ["side", "ahead", "wings"]
    at = F.struct("doc", "low")
    repeated = (windows.groupBy(*window).agg(F.min(at).alias("earliest"), F.max(at).alias("latest"))
                .where("earliest < latest").select(*window, "earliest"))
    # a row's windows are many times the bytes they are estimated by, and `repeated` is made of them: never broadcast either
    later = windows.hint("merge").join(repeated, window).where(at > F.col("earliest"))
    # windows of one row overlap, so what they cover is one span
    return written(later.groupBy("side", "doc", "start").agg(F.min("low").alias("low"), (F.max("low") + WINDOW).alias("high"))
                   .select("doc", "low", "high"), "suffix-spans", tidy=True)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc, spans): the bytes to remove of each document that has any; spans may overlap. texts: (doc, text)."""
    # anchors already known to be repeats needn't meet their class: a hot gram's rows are spread
    key, rest, later = F.col("key"), F.col("rest"), F.col("rest").bitwiseAND(LATER) != 0
    gram, behind = key.bitwiseAND(-0x10000), rest.bitwiseAND(LATER - 1)
    dealt = texts.mapInArrow(tidied(_emit_anchors), ANCHORS_DDL).repartition(
        F.when(later, F.xxhash64("doc", "key", "rest")).otherwise(gram))
    found = dealt.select(
        gram.alias("gram"), "around", "doc",
        F.shiftleft(F.shiftright(rest, 32), 16).bitwiseOR(key.bitwiseAND(0xFFFF)).cast("int").alias("place"),
        F.shiftright(rest, 16).bitwiseAND(0xFFFF).cast("int").alias("before"),
        F.when(later, -1 - behind).otherwise(behind).cast("int").alias("behind")
    ).sortWithinPartitions("gram", "around", "doc", "place")
    marks = written(found.mapInArrow(tidied(_mark_classes), MARKS_DDL), "suffix-marks", tidy=True)
    first = marks.where("NOT whole").select("gram", "doc", "place")
    hot = written(first.groupBy("gram").count().where(F.col("count") >= HOT_ROWS).select("gram"), "suffix-hot", tidy=True)
    if hot.isEmpty():
        found_spans = _sorted_spans(texts, first)
    else:
        found_spans = _sorted_spans(texts, first.join(hot, "gram", "left_anti")).unionAll(
            _hot_spans(texts, first.join(hot, "gram", "left_semi")))
    whole = marks.where("whole").where(F.col("before") + F.col("behind") >= WINDOW).select(
        "doc", (F.col("place") - F.col("before")).cast("bigint").alias("low"),
        (F.col("place") + F.col("behind")).cast("bigint").alias("high"))
    return whole.unionAll(found_spans).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def suffix_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `documents`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = pick(documents, doc=id_col, text=text_col).select(
        F.coalesce(F.col("doc").cast("bigint"), F.lit(NO_ID)).alias("doc"), "text")
    # lists of spans take up many times the bytes of their file: never broadcast them
    spans = written(repeated_spans(texts), "suffix-removed", tidy=True).withColumnRenamed("doc", "_doc").hint("merge")
    filter_of = sieve(spans.select("_doc"))
    touched = sifted(texts, 0, filter_of).join(spans, F.col("doc") == F.col("_doc"), "left").select("doc", "text", "spans")
    rest = sifted(texts, 0, filter_of, inside=False).withColumn(
        "spans", F.lit(None).cast("array<struct<low:bigint,high:bigint>>"))
    return touched.mapInArrow(tidied(_digest), KEPT_DDL).unionAll(rest.mapInArrow(tidied(_digest), KEPT_DDL))
