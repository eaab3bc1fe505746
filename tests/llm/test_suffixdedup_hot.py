"""Suffix dedup where many otherwise different documents hold one passage."""

import random

from tests.llm.test_suffixdedup import brute
from trialgrid.llm import suffixdedup as S


def test_hot_windows_are_listed_but_not_copied(spark, monkeypatch):
    plans, write = [], S.written

    def kept(df, name, **options):
        if name == "suffix-spans":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name, **options)

    monkeypatch.setattr(S, "written", kept)
    body = "".join(chr(97 + i * i % 23) for i in range(68))
    texts = spark.createDataFrame([(i, "x" * i + body * 2 + "y" * (9 - i)) for i in range(9)], "doc bigint, text string")
    found = S._hot_spans(texts, spark.createDataFrame([(i, i) for i in range(9)], "doc bigint, place int"))
    assert {r.doc for r in found.collect()} == set(range(1, 9))
    assert plans[0].count("Generate ") == 2  # the windows, once for each side of the join


def test_windows_and_lists_are_not_broadcast(spark, monkeypatch):
    plans, write = [], S.written

    def kept(df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, **options)

    monkeypatch.setattr(S, "written", kept)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    body = "".join(chr(97 + i * i % 23) for i in range(68))
    rows = [(i, "x" * i + body * 2 + "y" * (9 - i)) for i in range(9)]
    first = spark.createDataFrame([(i, i) for i in range(9)], "doc bigint, place int")
    texts = S.written(spark.createDataFrame(rows, "doc bigint, text string"), "texts")  # a file: Spark takes it to be tiny
    S._hot_spans(texts, S.written(first, "first"))
    plans.append(S.suffix_dedup(texts, id_col="doc")._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in plan for plan in plans) >= 3
    assert not any("BroadcastHashJoin" in plan for plan in plans)


def test_hot_side_is_spread(spark, monkeypatch):
    most, sort = 40, S._sort_surroundings

    def bounded(batches):
        def counted():
            side, n = None, 0
            for batch in batches:
                for own in batch.column(0).to_pylist():
                    side, n = (side, n + 1) if own == side else (own, 1)
                    if n > most:
                        raise ValueError("a whole hot side in one task")
                yield batch
        return sort(counted())

    monkeypatch.setattr(S, "HOT_ROWS", most, raising=False)
    monkeypatch.setattr(S, "_sort_surroundings", bounded)
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    passage, edges, pair = say(300), [say(30) for _ in range(3)], say(200)
    rows = []
    for i in range(150):
        middle = rng.choice([passage, passage, passage[40:], passage[:-25]])
        left, right = (rng.choice(["", say(3), say(90), say(20) + rng.choice(edges)]) for _ in range(2))
        rows.append((i, left + middle + right[::-1] + (pair if i % 30 == 0 else "")))
    rows += [(None, say(5) + passage), (200, passage + passage), (201, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r[0]: tuple(r[1:]) for r in S.suffix_dedup(df).collect()} == brute(rows)
