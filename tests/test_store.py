"""The table of current rows: upserts by bucket, atomic publish, dead and rival commits, repeated tokens."""

import os

import pytest
from pyspark.sql import functions as F

from trialgrid.sources import files, store

SCHEMA = "id string, no bigint, enc_sec double"


def commit(spark, path, rows, **options):
    return files.commit_current(spark.createDataFrame(rows, SCHEMA), path, ["no"], n_buckets=8, **options)


def current(spark, path):
    rows = files.read_current(spark, path, spark.createDataFrame([], SCHEMA).schema).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_commits_keep_the_last_result_of_an_id(spark, tmpdir_path):
    assert current(spark, tmpdir_path) == []
    commit(spark, tmpdir_path, [("a", 0, 1.0), ("b", 0, 1.0), ("b", 1, 2.0), (None, 0, 5.0)])
    commit(spark, tmpdir_path, [("b", 0, 9.0), ("c", 2, 3.0), ("c", 2, 3.0)])
    commit(spark, tmpdir_path, [])
    assert current(spark, tmpdir_path) == [("a", 0, 1.0), ("b", 1, 2.0), ("c", 2, 3.0), (None, 0, 5.0)]


def test_only_touched_buckets_are_written(spark, tmpdir_path):
    many = [(f"t{k}", 0, 1.0) for k in range(200)]
    commit(spark, tmpdir_path, many)
    before = store.read_manifest(spark, tmpdir_path)
    commit(spark, tmpdir_path, [("t7", 1, 2.0)])
    after = store.read_manifest(spark, tmpdir_path)
    assert len(before["buckets"]) == 8 and len(after["rewritten"]) == 1
    assert sum(before["buckets"][b] != after["buckets"][b] for b in before["buckets"]) == 1
    assert len(current(spark, tmpdir_path)) == 200 and ("t7", 1, 2.0) in current(spark, tmpdir_path)


def test_a_commit_that_dies_changes_nothing(spark, tmpdir_path, monkeypatch):
    commit(spark, tmpdir_path, [("a", 0, 1.0), ("b", 0, 1.0)])
    publish = store.publish

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(store, "publish", dies)
    with pytest.raises(RuntimeError, match="killed"):
        commit(spark, tmpdir_path, [("a", 1, 7.0)])
    assert current(spark, tmpdir_path) == [("a", 0, 1.0), ("b", 0, 1.0)]  # its files are there, but no manifest names them
    monkeypatch.setattr(store, "publish", publish)
    commit(spark, tmpdir_path, [("a", 1, 7.0)])
    assert current(spark, tmpdir_path) == [("a", 1, 7.0), ("b", 0, 1.0)]
    named = {f for v in store._versions(spark, tmpdir_path) for f in store._read_manifest(spark, tmpdir_path, v)["buckets"].values()}
    assert set(os.listdir(f"{tmpdir_path}/data")) == named  # the dead commit's folder went with the next one


def test_of_two_rivals_one_wins(spark, tmpdir_path):
    commit(spark, tmpdir_path, [("a", 0, 1.0)])
    manifest = store.read_manifest(spark, tmpdir_path)
    with pytest.raises(store.CommitConflict):
        store.publish(spark, tmpdir_path, manifest)
    assert store.read_manifest(spark, tmpdir_path) == manifest
    assert not [f for f in os.listdir(f"{tmpdir_path}/manifests") if f.startswith(".") and not f.endswith(".crc")]


def test_a_repeated_token_does_nothing(spark, tmpdir_path):
    assert commit(spark, tmpdir_path, [("a", 0, 1.0)], token={"feed": "f", "epoch": 0})
    assert not commit(spark, tmpdir_path, [("a", 9, 9.0)], token={"feed": "f", "epoch": 0})
    assert current(spark, tmpdir_path) == [("a", 0, 1.0)]


def test_old_versions_go(spark, tmpdir_path):
    for k in range(5):
        commit(spark, tmpdir_path, [("a", k, float(k))])
    assert len(store._versions(spark, tmpdir_path)) == store.KEPT_VERSIONS
    assert len(os.listdir(f"{tmpdir_path}/data")) <= store.KEPT_VERSIONS
    assert current(spark, tmpdir_path) == [("a", 4, 4.0)]


def test_buckets_follow_the_rows(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 20)
    commit(spark, tmpdir_path, [(f"t{k}", 0, 1.0) for k in range(400)])
    commit(spark, tmpdir_path, [("t7", 1, 2.0)])
    manifest = store.read_manifest(spark, tmpdir_path)
    assert manifest["n_buckets"] == 64 and sum(manifest["sizes"].values()) == 400
    commit(spark, tmpdir_path, [("t8", 1, 2.0)])
    assert len(store.read_manifest(spark, tmpdir_path)["rewritten"]) == 1
    assert len(current(spark, tmpdir_path)) == 400 and {("t7", 1, 2.0), ("t8", 1, 2.0)} <= set(current(spark, tmpdir_path))


def test_a_merge_may_empty_a_bucket(spark, tmpdir_path):
    rows = spark.createDataFrame([("a", 0, 1.0)], SCHEMA)
    store.upsert(rows, tmpdir_path, ["id"], lambda both: both)
    store.upsert(rows, tmpdir_path, ["id"], lambda both: both.where(F.lit(False)))
    assert current(spark, tmpdir_path) == [] and store.read_manifest(spark, tmpdir_path)["buckets"] == {}


def test_a_first_commit_is_as_wide_as_its_rows(spark, tmpdir_path, monkeypatch):
    """All rows at once go into enough buckets; an empty commit after it moves none of them."""
    monkeypatch.setattr(store, "BUCKET_ROWS", 20)
    commit(spark, tmpdir_path, [(f"t{k}", 0, 1.0) for k in range(400)])
    first = store.read_manifest(spark, tmpdir_path)
    assert first["n_buckets"] == 64 and len(current(spark, tmpdir_path)) == 400
    store.upsert(spark.createDataFrame([], SCHEMA), tmpdir_path, ["id"], lambda both: both)
    assert store.read_manifest(spark, tmpdir_path)["buckets"] == first["buckets"]


def test_buckets_of_a_manifest_without_a_hash_are_found(spark, tmpdir_path, monkeypatch):
    with monkeypatch.context() as old:
        # what rows were dealt by before manifests named it
        old.setattr(store, "_bucket_of", lambda key, n, hashed=None: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))
        commit(spark, tmpdir_path, [(f"t{k}", 0, 1.0) for k in range(50)])
    manifest = store.read_manifest(spark, tmpdir_path)
    del manifest["hash"]
    store.publish(spark, tmpdir_path, {**manifest, "version": manifest["version"] + 1})
    commit(spark, tmpdir_path, [("t7", 1, 2.0)])
    found = current(spark, tmpdir_path)
    assert len(found) == 50 and ("t7", 1, 2.0) in found
