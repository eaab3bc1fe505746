"""Importance resampling: hashed runs of words, gains, cutoff and ranks against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialgrid.llm import resample as R
from trialgrid.session import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def runs(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, lower)
    return len(words), [zlib.crc32(f.encode()) % R.N_BUCKETS for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


texts = st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "B", "9", " ", ".", "é", "中", "\n", "x" * 70, "É"]),
                                               max_size=30).map("".join)), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(texts, st.sampled_from([1, 3, 16, 1 << 20]))
def test_runs_of_words(given_texts, block):
    column = pa.array(["before", *given_texts], pa.string())[1:]
    got, words = [[] for _ in given_texts], np.zeros(len(given_texts), int)
    for doc, bucket, n in R.hashed_runs(column, block_bytes=block):
        words += n
        for d, b in zip(doc, bucket, strict=True):
            got[d].append(b)
    assert [(n, sorted(b)) for n, b in zip(words, got)] == [(n, sorted(b)) for n, b in map(runs, given_texts)]


def test_three_words(spark):
    column = pa.array(["a b c d", "e"])
    found = [list(zip(d.tolist(), b.tolist())) for d, b, _ in R.hashed_runs(column, max_words=3, block_bytes=4)]
    want = [(0, f) for f in ("a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d")] + [(1, "e")]
    assert sorted(sum(found, [])) == sorted((d, zlib.crc32(f.encode()) % R.N_BUCKETS) for d, f in want)


def plain(docs, target):
    """{row number: (n_features, weight, score)} and the drawn rows in order."""
    parts = [runs(t) for _, t in docs]
    s, t = np.zeros(R.N_BUCKETS), np.zeros(R.N_BUCKETS)
    for _, buckets in parts:
        np.add.at(s, buckets, 1)
    for text in target:
        np.add.at(t, runs(text)[1], 1)
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (s.sum() + R.N_BUCKETS)) / ((s[b] + 1) * (t.sum() + R.N_BUCKETS))))
            for b in range(R.N_BUCKETS)]
    rows = []
    for (doc_id, _), (n_words, buckets) in zip(docs, parts):
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, n_words, len(buckets), weight, score))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, able[:25 * len(able) // 100]


def test_against_plain(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "X9"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 30, 200])))) for i in range(400)]
    docs += [(None, " ".join(vocabulary[:40])), (1000, None), (1001, ""), (1002, "... \n"), (1003, " ".join(vocabulary * 3000)), (7, docs[7][1])]
    target = [" ".join(rng.choices(vocabulary[:50], k=60)) for _ in range(20)] + [None]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, TEXT string").repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(df, bench).collect()
    rows, drawn = plain(docs, target)
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted([(r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got], key=key) == sorted(rows, key=key)
    ranked = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank is not None)
    assert ranked == [(k + 1, d[0], d[4]) for k, d in enumerate(drawn)]
    once = [d for k, d in enumerate(docs) if d[0] is not None and k < len(docs) - 1]
    kept = R.drawn_documents(spark.createDataFrame([(*d, "x") for d in once], "doc_id bigint, text string, TEXT string"), bench)
    assert kept.columns == ["doc_id", "text", "TEXT"]
    assert sorted(tuple(r) for r in kept.collect()) == sorted((d[0], dict(once)[d[0]], "x") for d in plain(once, target)[1])


def test_nothing_to_draw(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.resample(empty, empty).collect() == []
    short = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert {(r.doc_id, r.rank) for r in R.resample(short, empty).collect()} == {(1, None), (2, None)}


@pytest.mark.parametrize("bracket", [1e-9, 0.004, 1.0])
@pytest.mark.parametrize("scores", ["id", "id % 7", "0"])
def test_cutoff_and_ranks(spark, bracket, scores):
    """Ties of every size, brackets that miss and brackets that hold everything."""
    scored = written(spark.range(5000).select("id", F.lit(20).cast("bigint").alias("n_words"), F.expr(scores).cast("bigint").alias("score")), "t")
    got = {r["id"]: r["rank"] for r in R.draw(scored, bracket=bracket).collect()}
    order = sorted(range(5000), key=lambda i: (-{"id": i, "id % 7": i % 7, "0": 0}[scores], i))
    assert [got[i] for i in order] == [*range(1, 1251), *[None] * 3750]


def test_a_bracket_that_misses_is_widened(spark):
    scored = written(spark.range(5000).select("id", F.lit(20).cast("bigint").alias("n_words"), F.col("id").alias("score")), "t")
    low = scored.where("id < 100").agg(F.kll_sketch_agg_double(F.col("score").cast("double"), 64).alias("sketch"))
    score, last, tries = R.bracket_cutoff(scored, written(low, "t"), 5000, 1250)  # a sketch of other rows altogether
    assert (score, last) == (3750, 3750) and tries > 1


def test_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 50)
    scored = written(spark.range(5000).select("id", F.lit(30).cast("bigint").alias("n_words"), (F.col("id") * 37 % 1009).alias("score")), "t")
    got = {r["id"]: r["rank"] for r in R.draw(scored).collect()}
    order = sorted(range(5000), key=lambda i: (-(i * 37 % 1009), i))
    assert [got[i] for i in order] == [*range(1, 1251), *[None] * 3750]
