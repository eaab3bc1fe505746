"""Mixing against a plain version, the hypergeometric draw, the tree's quotas."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trialgrid.llm import mixing as M


def targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """{source: target} by giving out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    left = float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in full]
        level = (left - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        target = {s: most * sizes[s] if s in full else level * weight[s] for s in order}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def brute(rows, seed=20):
    """{doc_id: copies} for rows (doc_id, text, source)."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    by_source = defaultdict(list)
    for i, _, s in rows:
        by_source[s].append(i)
    sizes = {s: sum(size[i] for i in ids) for s, ids in by_source.items()}
    copies = {}
    for s, target in targets(sizes).items():
        name = lambda i: hashlib.md5(f"{seed}|{'null' if i is None else i}".encode()).hexdigest()
        before, passes = 0, math.floor(target / sizes[s]) if sizes[s] else 0
        for i in sorted(by_source[s], key=lambda i: (name(i), i)):
            copies[i] = passes + (before + size[i] / 2 < target - passes * sizes[s])
            before += size[i]
    return copies


def test_against_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_BUCKET", 4)
    monkeypatch.setattr(M, "LEAST_BLOCK_WORDS", 300)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rows += [(900, None, "src1"), (901, " ", None), (902, "a b c " * 40, None), (903, "", "only empty")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, SOURCE string, size int")
    mixed = M.mix(df, n_shards=5)
    drawn = mixed.collect()
    copies, size = brute(rows), {i: len((t or "").split()) for i, t, _ in rows}
    got = {r.doc_id: r for r in M.taken(mixed).collect()}
    assert {i: r.taken for i, r in got.items()} == {i: copies[i] * size[i] for i in copies}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    want = targets(sizes)
    for i, _, s in rows:
        assert got[i].size == size[i] and got[i].source_size == sizes[s] and math.isclose(got[i].target, want[s])
    # every copy has one shard, a block goes to one shard as a whole, and first passes don't lie in the low shards only
    given = [r for r in drawn if r.copy is not None]
    assert all(r.shard is not None and 0 <= r.shard < 5 for r in given) and len(given) == sum(copies.values())
    owner = {}
    for r in given:
        assert owner.setdefault((r.source, r.block), r.shard) == r.shard
    big = max(sizes, key=lambda s: want[s])
    assert len({r.shard for r in given if r.source == big and r.copy == 0}) > 2
    shares = {(q.source_key, q.shard): q.quota for q in M.split_quotas(spark.createDataFrame(
        [("-" if s is None else f"={s}", math.ceil(want[s] / 300)) for s in sizes if want[s] > 0], "source_key string, quota bigint"), 5, 20).collect()}
    used = Counter(("-" if s is None else f"={s}", shard) for (s, _), shard in owner.items())
    assert all(n <= shares[k] for k, n in used.items())  # a long document may reach over blocks in which none begins
    again = {(r.doc_id, r.copy, r.shard, r.rank) for r in M.mix(df.repartition(3), n_shards=5).collect()}
    assert again == {(r.doc_id, r.copy, r.shard, r.rank) for r in drawn}


def test_mixed_documents_and_repeated_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (3, "f " * 50, "t"), (4, None, None), (5, "g h", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Counter(tuple(r) for r in M.mixed_documents(df, n_shards=3).collect())
    assert set(got) <= set(rows) and max(got.values()) <= 6 and got[rows[0]] % 2 == 0
    taken = M.taken(M.mix(df)).collect()
    assert len(taken) == len(rows) and all(r.taken <= 3 * r.size for r in taken)
    assert M.taken(M.mix(df.limit(0))).collect() == [] and M.mixed_documents(df.limit(0)).collect() == []


def test_hypergeometric(spark):
    cases = [(10, 4, 3), (10, 10, 3), (10, 0, 3), (50, 20, 25), (7, 7, 7), (1000, 3, 500), (200000, 90000, 100000), (5, 3, 0)]
    for total, marked, draws in cases:
        df = spark.range(400).select(((F.col("id") + 0.5) / 400).alias("u"))
        got = [r[0] for r in df.select(M.hypergeometric(F.lit(total), F.lit(marked), F.lit(draws), F.col("u"))).collect()]
        low, high = max(0, draws + marked - total), min(draws, marked)
        assert all(low <= k <= high for k in got)
        if total <= 1000:
            ways = [math.comb(marked, k) * math.comb(total - marked, draws - k) for k in range(low, high + 1)]
            below, want = 0, []
            for k, w in zip(range(low, high + 1), ways):
                want += [k] * (round((below + w) / sum(ways) * 400) - round(below / sum(ways) * 400))
                below += w
            assert sum(a != b for a, b in zip(sorted(got), want)) <= 2
        else:
            assert abs(sum(got) / 400 - draws * marked / total) < 1


@pytest.mark.parametrize("n_shards", [1, 2, 7, 16])
def test_tree_quotas(spark, n_shards):
    quotas = {"a": 1000, "b": 37, "c": 1, "d": 512}
    df = spark.createDataFrame(list(quotas.items()), "source_key string, quota bigint")
    rows = M.split_quotas(df, n_shards, 3).collect()
    assert {r.shard for r in rows} == set(range(n_shards))
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r.source_key] += r.quota
        by_shard[r.shard] += r.quota
    assert dict(by_source) == quotas and max(by_shard.values()) - min(by_shard.values()) <= math.ceil(math.log2(n_shards)) + 1
