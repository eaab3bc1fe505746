"""The Jaccard join against brute force over all pairs."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trialgrid.llm import jaccard as J


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """{doc_id: component} by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a and b and 100 * common >= 75 * (len(a) + len(b) - common):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passage = say(60)
    texts = [None, "", " \n\t", "one", "one two three four five", "ONE two three four five", "one two three four five six"]
    while len(texts) < n:
        base = say(rng.choice([3, 5, 6, 8, 9, 12, 20, 60, 200, 500]))
        if rng.random() < .3:
            base = base + passage + say(rng.choice([0, 30, 300]))
        texts.append(" ".join(base))
        while rng.random() < .7:  # chains of edits, so that components are not stars
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                at = rng.randrange(len(base))
                base[at:at + 1] = rng.choice([[], [rng.choice(words)], [base[at], rng.choice(words)]])
                base = base or ["x"]
            texts.append(" ".join(base))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(3))
def test_components_against_brute_force(spark, seed):
    rows = [(i * 10 ** 10 if seed == 1 else i, t) for i, t in corpus(seed)]
    rows += [rows[10], rows[11], (None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id bigint, text string, TEXT string, n int").repartition(7)
    got = J.near_duplicates(df).collect()
    want = brute(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sorted(
        (i is None, i or 0, len(shingles(t))) for i, t in rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert len(set(want.values())) < len(want) - 20


def test_empty_table(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_every_similar_pair_shares_a_sketch():
    rng, bands = np.random.default_rng(5), J.Bands()
    for _ in range(400):
        a = int(rng.integers(1, 300))
        base = rng.integers(0, 2 ** 63, 2 * a + 5).astype(np.uint64)
        drop = int(rng.integers(0, a // 7 + 1))
        one, two = np.unique(base[:a]), np.unique(base[drop:a + int(rng.integers(0, a // 7 + 1))])
        if J.linked(one, two):
            low = min(bands.of(len(one)), bands.of(len(two)))
            assert max(bands.of(len(one)), bands.of(len(two))) <= low + 1
            shape = bands.shape(low)
            assert set(J.sketches(one, low, *shape)) & set(J.sketches(two, low, *shape))
            assert J.may_link(*[(len(s), J.bit_sketch(s)) for s in (one, two)])
            bits = [np.frombuffer(J.bit_sketch(s), np.uint64) for s in (one, two)]
            short = min(map(len, bits))
            apart = np.bitwise_count(J.fold(bits[0], short) ^ J.fold(bits[1], short)).sum()
            assert apart <= len(np.setxor1d(one, two))


def test_sketches_are_packed_in_little_memory(monkeypatch):
    """Batches of few sketches, and not many bytes a sketch while they are packed: a task shares
    its executor's memory with others."""
    monkeypatch.setattr(J, "FLUSH_KEYS", 400_000)
    monkeypatch.setattr(J, "PACKED_KEYS", 20_000, raising=False)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(map(str, rng.integers(0, 1000, 300)))) for i in range(4000)]
    given = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])],
                                       names=["doc_id", "text"])
    n, sizes = {}, []
    tracemalloc.start()
    try:
        for batch in J._emit_sketches(200)(iter([given])):
            own = [J._unpack(ids, base, width) for span, _, ids, base, width, _ in
                   zip(*(c.to_pylist() for c in batch.columns), strict=True) if span >= 0]
            sizes.append(sum(map(len, own)))
            for i in itertools.chain.from_iterable(x.tolist() for x in own):
                n[i] = n.get(i, 0) + 1
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) > 800_000 and max(sizes) < 40_000  # a batch ends with the span that fills it
    assert peak < 26_000_000, peak
    make, bands = J.Shingles(), J.Bands()
    for i, text in rows:
        own = make.of(text)
        band = bands.of(len(own))
        assert n[i] == sum(len(J.sketches(own, j, *bands.shape(j))) for j in (band, band - 1))
