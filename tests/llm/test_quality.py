"""Quality rules: counts by plain Python, the estimate by numpy, edge rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from trialgrid.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def vector(text):
    n, chars, symbols, dup, repeat = counts(text)
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    w = max(n, 1)
    return [math.log(w), chars / w, math.log(1 + 10 * symbols / w), dup / max(lines, 1), repeat / w]


def brute(rows):
    """{doc_id: kept} with the estimate computed by numpy, group by group."""
    stats = {i: (np.round(np.array(vector(t)) * 1000), lang, source) for i, t, lang, source in rows}
    failed = {i: counts(t)[0] < 10 or 100 * counts(t)[4] > 20 * counts(t)[0] for i, t, *_ in rows}
    pairs = Counter((lang, s) for i, (_, lang, s) in stats.items() if not failed[i])
    small = Counter()
    for (lang, _), n in pairs.items():
        small[lang] += n if n < Q.MIN_ROWS else 0
    group_of = lambda lang, s: (lang, s) if pairs[lang, s] >= Q.MIN_ROWS else lang if small[lang] >= Q.MIN_ROWS else "rest"
    groups = defaultdict(list)
    for i, (_, lang, s) in stats.items():
        if not failed[i]:
            groups[group_of(lang, s)].append(i)
    floors = np.diag(np.array(Q.FLOORS) ** 2)
    kept = {i: not failed[i] for i in stats}
    for ids in groups.values():
        if len(ids) < Q.MIN_ROWS:
            continue
        x = np.array([stats[i][0] for i in ids]) / 1000

        def quantile(q):
            return np.sort(x, axis=0)[math.ceil(q * len(x)) - 1]

        center, spread = quantile(.5), np.maximum((quantile(.75) - quantile(.25)) / 1.349, Q.FLOORS)
        scatter = np.diag(spread ** 2)
        for step in range(Q.STEPS + 1):
            apart = x - center
            d = np.einsum("ij,jk,ik->i", apart, np.linalg.inv(scatter), apart)
            if step == Q.STEPS:
                near, factor = d <= Q._chi2_quantile(.975, 5), Q._consistency(.975)
            else:
                bins = np.floor(np.log(d + 1e-6) * Q.BINS_PER_E)
                near = bins <= min(b for b in bins if (bins <= b).sum() >= len(x) * Q.COVERED)
                factor = Q._consistency(Q.COVERED)
            center = x[near].mean(axis=0)
            scatter = np.cov(x[near].T, bias=True) * factor + floors
        apart = x - center
        d = np.einsum("ij,jk,ik->i", apart, np.linalg.inv(scatter), apart)
        for i, far in zip(ids, d > Q.CUTOFF):
            kept[i] = not far
    return kept


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" "] * 8 + ["\n"]) for _ in range(n))
    rows = [(900, None, "en", "a"), (901, "", None, None), (902, "one two", "en", None), (903, "a b c d e " * 9, "en", "a"),
            (904, "w " * 4000, "en", "a"), (905, "\t\n \x0b", "en", "a")]
    for i in range(400):
        text = say(rng.choice([5, 9, 10, 11, 40, 120, 400]))
        kind = rng.random()
        if kind < .06:
            text = " ".join(w + "***" for w in text.split())
        elif kind < .1:
            text += "\n" + "\n".join(text.split("\n")[:4])
        elif kind < .13:
            text = text.replace(" ", "")
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "b", None])))
    return rows


def test_against_numpy(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id bigint, text string, lang string, source string, TEXT string, n_words int")
    got = {r.doc_id: r for r in Q.quality_rules(df).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        n = counts(text)
        assert tuple(got[i][c] for c in Q.COUNTS) == n
        assert got[i].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    want = brute(rows)
    assert {i: r.kept for i, r in got.items()} == want
    assert 10 < sum(not k and not got[i].base_failed for i, k in want.items()) < 100
    whole = Q.kept_documents(df.toDF("doc_id", "text", "lang", "source", "other", "n"))
    assert sorted(r.doc_id for r in whole.collect()) == sorted(i for i, k in want.items() if k)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k", "en", "s")] * 2 + [(None, "x", "en", "s")],
                               "doc_id bigint, text string, lang string, source string")
    assert sorted(str(r.kept) for r in Q.quality_rules(df).collect()) == ["False", "True", "True"]
    assert Q.quality_rules(df.limit(0)).collect() == [] and Q.kept_documents(df.limit(0)).collect() == []
