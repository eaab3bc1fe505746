"""Suffix dedup against brute force over all 100-byte strings; the suffix array against sorting."""

import hashlib
import random

import numpy as np
import pytest

from trialgrid.llm import suffixdedup as S


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in [*range(0, 40), 200, 999, 1000, 1001]:
        for top in (1, 2, 4, 300):
            text = rng.integers(1, top + 1, n)
            assert S.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def brute(rows):
    """{doc_id: (n_bytes, n_removed, n_spans, digest)}."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            part = data[k:k + 100]
            if part in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(part)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()
    return out


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    pool = [say(n) for n in (50, 99, 100, 101, 130, 180, 400, 1500)] + ["xy" * 90, "q" * 250, " \t"]
    rows = [(None, pool[6]), (70, None), (71, ""), (72, pool[2]), (73, pool[2]), (74, pool[1]), (75, pool[1])]
    for i in range(45):
        text = ""
        for _ in range(rng.randrange(6)):
            part = rng.choice(pool)
            if rng.random() < .5 and len(part) > 3:  # a piece, or an edit
                a, b = sorted(rng.sample(range(len(part)), 2))
                part = rng.choice([part[a:b], part[:a] + "#" + part[a:], part[:a] + part[b:]])
            text += part + rng.choice(["", say(3), say(120)])
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, TEXT string, doc int").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in S.suffix_dedup(df).collect()}
    want = brute(rows)
    assert got == want and sum(v[1] > 0 for v in want.values()) > 15


def test_repeated_rows_and_empty_table(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")
    assert {tuple(r)[:3] for r in S.suffix_dedup(df).collect()} == {(1, 400, brute([(1, text)])[1][1])}
    assert S.suffix_dedup(df.limit(0)).collect() == []


def test_places_beyond_16_bits(spark):
    """An anchor's place is shuffled in two parts: repeats far into a long text are found where they are."""
    draw = random.Random(5)
    far = "".join(draw.choice("abcdefgh ") for _ in range(70_000))
    passage = "".join(draw.choice("ijklmnop ") for _ in range(150))
    rows = [(1, far + passage), (2, passage + far[:300]), (3, far[66_000:66_120] + "!")]
    found = {r.doc_id: r for r in S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1].n_removed, found[2].n_removed, found[3].n_removed) == (0, 450, 120)
    assert (found[2].n_spans, found[3].n_spans) == (1, 1)
