"""Decontamination against brute force: all BM25 scores, then shingle cover of the whole text."""

import math
import random
import tracemalloc
from collections import Counter

import pytest

from trialgrid.llm import decontaminate as D


def brute(texts, items, threshold, least):
    """(place of text, place of item) pairs, scoring every passage against every chunk."""
    split = [D.split_item(t) for t in items]
    chunks = [(k, w[a:a + D.CHUNK]) for k, (w, _) in enumerate(split) for a in range(0, len(w), D.CHUNK)]
    df = Counter(w for _, c in chunks for w in set(c))
    mean = sum(len(c) for _, c in chunks) / max(1, len(chunks))

    def impact(w, chunk):
        n = chunk.count(w)
        return (math.log(1 + (len(chunks) - df[w] + .5) / (df[w] + .5)) * n * (D.K1 + 1)
                / (n + D.K1 * (1 - D.B + D.B * len(chunk) / mean)))

    out = set()
    for i, text in enumerate(texts):
        words = D.words_of(text)
        near = set()
        for a in range(0, len(words), D.CHUNK):
            passage = set(words[a:a + 2 * D.CHUNK])
            for k, c in chunks:
                if sum(impact(w, c) for w in set(c) & passage) / sum(impact(w, c) for w in set(c)) >= threshold - 1e-9:
                    near.add(k)
        for k in near:
            own, n = split[k]
            size = min(5, len(own))
            found = {tuple(words[j:j + size]) for j in range(len(words) - size + 1)}
            marks = [0] * len(own)
            for j in range(len(own) - size + 1):
                if tuple(own[j:j + size]) in found:
                    marks[j:j + size] = [1] * size
            q, a = marks[:n] or marks, marks[n:] or marks
            if min(sum(q) / len(q), sum(a) / len(a)) >= least:
                out.add((i, k))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    items = [say(rng.choice([3, 8, 20, 40, 64, 65, 150, 300])) for _ in range(25)] + ["", None, "the"]
    texts = [None, "", "the"]
    for _ in range(40):
        text = say(rng.choice([5, 60, 200, 500]))
        if rng.random() < .6:
            leak = (rng.choice(items) or "").split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                if leak:
                    leak[rng.randrange(len(leak))] = "changed"
            text += " " + " ".join(leak).upper() + "\n" + say(rng.choice([0, 10, 90]))
        texts.append(text)
    return texts, items


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed, monkeypatch):
    texts, items = corpus(seed)
    if seed % 2:
        monkeypatch.setattr(D, "SHARD_CHARS", 1500)
        monkeypatch.setattr(D, "BATCH_WORDS", 700)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, Text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()}
    want = brute(texts, items, .5, .75)
    assert got == want and len(want) > 10
    kept = {r.doc_id for r in D.clean_documents(docs.toDF("doc_id", "text", "other"), bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}


def test_answer_column_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h x y z"), (1, "a b c d e f g h x y z"), (2, "a b c d e f g h")],
                                 "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h", "x y z")], "item_id bigint, text string, reply string")
    assert [r.doc_id for r in D.find_leaks(docs, bench, answer_col="reply").collect()] == [1, 1]
    assert D.find_leaks(docs, bench.limit(0)).collect() == []
    assert D.find_leaks(docs.limit(0), bench).collect() == []
    assert D.clean_documents(docs, bench.limit(0)).count() == 3


def test_clean_documents_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "p", 1, 2), (2, "z z z", "p", 3, 4), (None, None, None, None, None)],
                                 "doc_id bigint, text string, x string, y int, z int").toDF("doc_id", "text", "TEXT", "q", "q")
    bench = spark.createDataFrame([(7, "a b c d e f g h")], "item_id bigint, text string")
    kept = D.clean_documents(docs, bench)
    assert kept.columns == ["doc_id", "text", "TEXT", "q", "q"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(2, "z z z", "p", 3, 4), (None,) * 5], key=str)


def test_bounds_of_a_batch_take_little_memory():
    """The bounds of many passages are summed in place, for few words at a time."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    items = [(k, [rng.choice(words) for _ in range(60)], 60) for k in range(400)]
    frequency = Counter(w for _, own, _ in items for w in set(own))
    index = D.Index(items, frequency, 400, 60.0, .5)
    texts = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(250)]
    texts[7] += " " + " ".join(items[5][1])
    tracemalloc.start()
    try:
        found = index.leaks(texts, .75)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(i, k) for i, own in enumerate(found) for k, *_ in own] == [(7, 5)]
    assert peak < 90_000_000, peak
