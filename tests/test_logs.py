"""The log source: small files packed, a large array cut into ranges, every record once, bad files named."""

import json
import os
import random

import pytest
from pyspark.sql import types as T

from trialgrid.schemas import METRIC_SCHEMA, PROBE_SCHEMA
from trialgrid.sources import files, logs

SCHEMA = T.StructType([T.StructField("no", T.LongType()), T.StructField("name", T.StringType()), T.StructField(
    "parts", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("x", T.DoubleType())])))])


def record(k, rng):
    name = rng.choice(["", "é中", 'a "quoted" {"no": 7} one', "back\\slash", "brace } ] ,{", "\n\t", "x" * rng.choice([1, 500])])
    return {"no": k, "name": name, "parts": [{"kind": rng.choice("IPB"), "x": 1.5 * i} for i in range(rng.randint(0, 4))]}


def put(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return os.path.join(folder, name)


@pytest.mark.parametrize("dump", ["array", "array indent", "ascii array", "lines"])
@pytest.mark.parametrize("range_bytes", [1 << 30, 5000, 700, 90])
def test_every_record_once(spark, tmpdir_path, dump, range_bytes):
    rng = random.Random(4)
    rows = [record(k, rng) for k in range(300)]
    if dump == "lines":
        text = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
    else:
        text = json.dumps(rows, ensure_ascii=dump.startswith("ascii"), indent=2 if dump.endswith("indent") else None)
    path = put(tmpdir_path, "logs.json", text)
    size = os.path.getsize(path)
    found = []
    for task in logs.plan([(path, size)], range_bytes):
        for _, start, end in task.ranges:
            with logs.open_file(path) as file:
                found += list(logs.records(file, path, start, end))
    assert [r for _, r in found] == rows
    raw = open(path, "rb").read()
    assert all(raw[offset:offset + 1] == b"{" for offset, _ in found)


def test_chunks_smaller_than_records(tmpdir_path, monkeypatch):
    monkeypatch.setattr(logs, "CHUNK", 50)
    monkeypatch.setattr(logs, "HEAD_BYTES", 40)
    rng = random.Random(9)
    rows = [record(k, rng) for k in range(60)]
    path = put(tmpdir_path, "logs.json", json.dumps(rows, ensure_ascii=False))
    size = os.path.getsize(path)
    found = []
    for task in logs.plan([(path, size)], 400):
        for _, start, end in task.ranges:
            with logs.open_file(path) as file:
                found += [r for _, r in logs.records(file, path, start, end)]
    assert found == rows


def test_many_small_files_in_few_tasks(spark, tmpdir_path):
    for k in range(1200):
        put(tmpdir_path, f"c{k}_ffprobe.json", json.dumps({"format": {"duration": "1.0", "size": k, "bit_rate": "8"}, "extra": [1]}))
    put(tmpdir_path, "empty_ffprobe.json", "")
    df = files.read_probe_logs(spark, tmpdir_path + "/*_ffprobe.json")
    assert len(logs.plan(logs.list_files(tmpdir_path + "/*_ffprobe.json"))) == 3
    rows = df.collect()
    assert sorted(int(r.format.size) for r in rows) == list(range(1200)) and rows[0].path.startswith("file:")
    assert {r.path.rsplit("/", 1)[1] for r in rows} == {f"c{k}_ffprobe.json" for k in range(1200)}


def test_a_large_array_in_many_tasks(spark, tmpdir_path):
    rng = random.Random(1)
    rows = [record(k, rng) for k in range(3000)]
    put(tmpdir_path, "big.json", json.dumps(rows))
    df = logs.read_logs(spark, tmpdir_path + "/big.json", SCHEMA, range_bytes=20_000)
    assert df.rdd.getNumPartitions() > 10
    got = {r.no: r for r in df.collect()}
    assert len(got) == 3000 and all(got[r["no"]].name == r["name"] and [p.kind for p in got[r["no"]].parts] == [p["kind"] for p in r["parts"]]
                                    for r in rows)


def test_bad_files_are_named(spark, tmpdir_path):
    good = json.dumps({"version": "v", "pooled_metrics": {"vmaf": {"min": 1, "harmonic_mean": 2.5}}})
    put(tmpdir_path, "a_vmaf.json", good)
    row = files.read_metric_logs(spark, tmpdir_path).first()
    assert row.pooled_metrics.vmaf.min == 1.0 and row.offset == 0
    for bad in (good[:-1], good + "]x", "12", "[" + good, "[" + good + '] {"version": 1}', '{"a" 1}'):
        folder = os.path.join(tmpdir_path, str(abs(hash(bad))))
        os.makedirs(folder)
        put(folder, "b_vmaf.json", bad)
        with pytest.raises(Exception, match="b_vmaf.json"):
            files.read_metric_logs(spark, folder).collect()


def test_a_nested_lookalike_fails(tmpdir_path):
    """An object with the record's first key inside a record: the read fails, it doesn't give wrong rows."""
    rows = [{"no": k, "in": [{"no": 1000 + j} for j in range(40)]} for k in range(40)]
    path = put(tmpdir_path, "l.json", json.dumps(rows))
    size = os.path.getsize(path)
    with pytest.raises(logs.BadLog, match="l.json"):
        for task in logs.plan([(path, size)], 300):
            for _, start, end in task.ranges:
                with logs.open_file(path) as file:
                    list(logs.records(file, path, start, end))


def test_listing(tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "a/b"))
    for name in ("a/x.json", "a/b/y.json", "a/b/z.txt", "a/_SUCCESS", "a/.hidden"):
        put(tmpdir_path, name, "{}")
    rel = lambda p: sorted(f.removeprefix(f"file:{tmpdir_path}/") for f, _ in logs.list_files(p))
    assert rel(f"{tmpdir_path}/a/*.json") == ["a/x.json"] and rel(f"{tmpdir_path}/a/*/?.json") == ["a/b/y.json"]
    assert rel(f"file:{tmpdir_path}/a") == ["a/b/y.json", "a/b/z.txt", "a/x.json"] and rel(f"{tmpdir_path}/a/x.json") == ["a/x.json"]
    assert rel(f"{tmpdir_path}/none") == []
