"""Language identification: sums over all segmentations by brute force, expected counts, held-out accuracy."""

import numpy as np
import pytest

from trialgrid.llm import langid as L

PIECES = ["", L.MARK, "a", "b", "ab", "aba", L.MARK + "a", L.MARK + "ab", "bab", "babab", "é"]


def segmentations(text, known):
    """Lists of piece numbers, each spelling the text; a letter without a piece is the unknown piece."""
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        piece = known.get(text[:k], L.UNKNOWN if k == 1 else None)
        if piece is not None:
            yield from ([piece, *rest] for rest in segmentations(text[k:], known))


@pytest.fixture(scope="module")
def model():
    p = np.random.default_rng(1).random((len(PIECES), 3))
    return L.Model(L.Pieces(PIECES), p / p.sum(axis=0), ["x", "y", "z"], np.log([.2, .3, .5]))


WORDS = ["a", "ab", "abab", "babab", "q", "aqb", "éa", "ababababa", "zz", "bbbb", "𝒳ab"]


def test_forward_sums_all_segmentations(model):
    known = {p: i for i, p in enumerate(PIECES) if p}
    got = model.log_probabilities(WORDS)
    for word, row in zip(WORDS, got):
        want = sum(np.prod([model.p[i] for i in s], axis=0) for s in segmentations(L.MARK + word, known))
        assert np.allclose(row, np.log(want))


def test_long_words_go_the_same_way(model):
    words = ["ab" * 12, "aqé" * 8]
    assert np.allclose([model._long(w) for w in words], model.log_probabilities(words))
    assert np.isfinite(model.log_probabilities(["ab" * 4000])).all()


def test_expected_counts(model):
    known = {p: i for i, p in enumerate(PIECES) if p}
    for language in range(3):
        want = np.zeros(len(PIECES))
        for n, word in enumerate(WORDS, 1):
            each = [(s, np.prod(model.p[s, language])) for s in segmentations(L.MARK + word, known)]
            for s, weight in each:
                for piece in s:
                    want[piece] += n * weight / sum(w for _, w in each)
        got = model.expected(WORDS, language, np.arange(1.0, len(WORDS) + 1))
        assert np.allclose(got, want)


def test_score_is_the_posterior(model):
    (lang, score), = model.predict(["ab ab q"])
    raw = model.prior + model.log_probabilities(["ab", "ab", "q"]).sum(axis=0)
    assert lang == model.languages[int(raw.argmax())] and np.isclose(score, np.exp(raw.max()) / np.exp(raw).sum())


def test_held_out_accuracy_and_rule(spark, sf_dir):
    import zlib
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in L.language_id(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert rows.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    right = [rows[i].lang_pred == lang for i, lang in truth.items() if rows[i].held_out]
    assert len(right) > 20 and sum(right) / len(right) > .95


def test_edge_rows(spark):
    rows = [(1, "der und die das", "de", 0), (3, "the of and", "en", 0), (3, "the of and", "en", 0), (None, "der die", None, 1),
            (4, None, "de", 0), (5, "", "en", 0), (6, "12 -- !", "en", 0), (7, "the " * 20000, "en", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, held_out int")
    got = L.language_id(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[4].lang_pred == by[5].lang_pred == by[6].lang_pred == "und" and by[6].score == 0.0
    assert by[7].lang_pred == "en" and 0 <= by[7].score <= 1
    assert L.language_id(df.limit(0)).collect() == []
    none = df.withColumn("lang", df.lang.substr(1, 0)).where("doc_id = 99")
    assert L.predict(df, L.learn(none)).first().lang_pred == "und"
