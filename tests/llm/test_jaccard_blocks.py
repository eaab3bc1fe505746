"""The Jaccard join where many documents of different components share a passage."""

import random

from tests.llm.test_jaccard import brute
from trialgrid.llm import jaccard as J


def test_large_lists_are_compared_in_blocks(spark, monkeypatch):
    most, compare = 16, J._near_pairs

    def bounded(batches):
        def counted():
            group, n = None, 0
            for batch in batches:
                keys = [c for c in ("center", "low", "high") if c in batch.schema.names]
                for own in zip(*(batch.column(c).to_pylist() for c in keys), strict=True):
                    group, n = (group, n + 1) if own == group else (own, 1)
                    if n > 4 * most:
                        raise ValueError("a whole list in one task")
                yield batch
        return compare(counted())

    monkeypatch.setattr(J, "BLOCK_ROWS", most, raising=False)
    monkeypatch.setattr(J, "_near_pairs", bounded)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passage, texts = say(64), []
    for _ in range(220):  # about 58 percent of a text is the passage: too little for a link
        texts.append(say(12) + passage + say(12))
    for base in rng.sample(texts, 60):  # chains of links that the least document doesn't belong to
        for _ in range(2):
            base = base[:2] + say(3) + base[5:] if rng.random() < .5 else base[:-4] + say(4)
            texts.append(base)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in J.near_duplicates(df).collect()} == want
    assert 40 < len(set(want.values())) < len(rows) - 40
