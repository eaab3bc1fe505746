"""The pipeline on the small tables: every stage against a brute-force version on its own input."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_mixing import brute as brute_mix
from trialgrid.llm import quality, tokens
from trialgrid.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, docs, sf_dir), "stage"))
        docs = kept[-1]
    assert all(df.columns == COLUMNS for df in kept[:-1])
    first, second, third, fourth = ([tuple(r) for r in df.collect()] for df in kept[:-1])

    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(given).collect()}
    assert sorted(first) == sorted(tuple(r) for r in given.collect() if verdict[r.doc_id])
    assert 0.5 * len(verdict) < len(first) < len(verdict)

    component = brute_components([(r[0], r[1]) for r in first])
    assert sorted(second) == sorted(r for r in first if component[r[0]] == r[0]) and len(second) < len(first)

    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {i for i, _ in brute_leaks([r[1] for r in second], items, .5, .75)}
    assert sorted(third) == sorted(r for i, r in enumerate(second) if i not in leaks) and leaks

    copies = brute_mix([(r[0], r[1], r[3]) for r in third])
    assert sorted(fourth) == sorted(r for r in third for _ in range(copies[r[0]]))

    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    want, start = [], 0
    for doc_id, text, *_ in sorted(fourth):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in kept[-1].collect()) == sorted(want)


def test_registered(spark):
    from trialgrid.llm.queries import LLM_QUERIES
    assert LLM_QUERIES["pipeline"] is corpus_pipeline.run
    assert sorted(n.split("_")[0] for n in LLM_QUERIES) == sorted(["pipeline", *(f"op{k}" for k in range(1, 14))])
