"""What writing leaves on disk: shuffle files of a write go with it, large commits are done in lots, state is compressed."""

import os
import time

import pytest
from pyspark.sql import functions as F

from trialgrid.sources import files, store


def shuffled_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
    return {b for b in blocks if b.startswith("shuffle_")}


def left_by(spark, run):
    before = shuffled_files(spark)
    out = run()
    for _ in range(20):  # they go in the background
        if not (left := shuffled_files(spark) - before):
            break
        time.sleep(0.1)
    return left, out


def test_a_commit_leaves_no_shuffle_files(spark, tmpdir_path):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id")).repartition(3, "id")
    left, _ = left_by(spark, lambda: files.commit_results(rows, tmpdir_path + "/r"))
    assert not left and spark.read.parquet(tmpdir_path + "/r").count() == 1000


@pytest.mark.parametrize("first", [600, 40])  # so many rows that the buckets are right at once, or grow with the second commit
def test_large_commits_are_done_in_lots(spark, tmpdir_path, monkeypatch, first):
    monkeypatch.setattr(store, "LOT_ROWS", 100)
    monkeypatch.setattr(store, "BUCKET_ROWS", 64)
    merged, latest = [], files.grid.latest_by_id

    def counted(both, order):
        merged.append(both.count())
        return latest(both, order)

    monkeypatch.setattr(files.grid, "latest_by_id", counted)
    say = lambda low, high, no: spark.range(low, high).select(
        F.when(F.col("id") % 50 > 0, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("id"), F.lit(no).cast("long").alias("no"), F.col("id").cast("double").alias("x"))
    for no, (low, high) in enumerate([(0, first), (20, 700), (300, 400)]):
        begun = len(merged)
        files.commit_current(say(low, high, no), tmpdir_path, ["no", "x"], n_buckets=8)
    lots = merged[begun:]
    assert len(lots) >= 4 and max(lots) <= 2 * sum(lots) / len(lots)
    got = sorted((tuple(r) for r in files.read_current(spark, tmpdir_path, say(0, 1, 0).schema).collect()), key=str)
    want = {}
    for no, (low, high) in enumerate([(0, first), (20, 700), (300, 400)]):
        for k in range(low, high):
            want[f"t{k}" if k % 50 else None] = (no, float(k))
    assert got == sorted(((k, *v) for k, v in want.items()), key=str)


def test_no_version_but_the_last_is_kept_if_asked(spark, tmpdir_path):
    rows = spark.createDataFrame([("a", 1)], "id string, no long")
    for _ in range(3):
        files.commit_current(rows, tmpdir_path, ["no"], n_buckets=2, keep=1)
    assert len(store._versions(spark, tmpdir_path)) == 1 and files.read_current(spark, tmpdir_path, rows.schema).count() == 1


def test_state_of_ids_is_compressed(spark, tmpdir_path):
    from trialgrid.streaming import live
    name, seen = "spark.sql.streaming.stateStore.rocksdb.compression", []
    spark.range(20).select(F.col("id").cast("string").alias("id")).write.parquet(tmpdir_path + "/in")
    before, upsert = spark.conf.get(name, None), store.upsert

    def looked(rows, *args, **options):
        seen.append(rows.sparkSession.conf.get(name, None))
        assert store.SLICE in rows.columns
        return upsert(rows, *args, **options)

    store.upsert = looked
    try:
        stream = live.stream_files(spark, tmpdir_path + "/in", spark.read.parquet(tmpdir_path + "/in").schema)
        assert live.dedupe_results(stream, tmpdir_path + "/out", tmpdir_path + "/ck").count() == 20
    finally:
        store.upsert = upsert
    assert set(seen) == {"zstd"} and spark.conf.get(name, None) == before


def test_saving_leaves_no_shuffle_files(spark, tmpdir_path):
    from trialgrid.operators import grid
    cells = spark.range(500).select(F.col("id").cast("string").alias("id")).repartition(3, "id").distinct()
    left, said = left_by(spark, lambda: grid.save_trials(cells, cells.union(cells), tmpdir_path + "/s", new_config=False))
    assert said == "written" and not left
    left, said = left_by(spark, lambda: grid.save_trials(cells, cells, tmpdir_path + "/s", new_config=False))
    assert said == "unchanged" and not left


def test_landed_tables_go_with_the_block(spark, sf_dir):
    from trialgrid.operators import probe
    from trialgrid.schemas import TRIAL_COLUMNS
    from trialgrid.sources import tables
    li, part, clips = (tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "part"), tables.base_probes_from_tables(spark, sf_dir))
    lines, fields, flat = tables.trial_lines(li, part), tables.trial_columns(), tables.trials_from_tables(spark, sf_dir).select(*TRIAL_COLUMNS)
    rows = lambda df: sorted(map(str, df.collect()))
    with probe.landing(spark):
        left, moved = left_by(spark, lambda: (
            probe.land_trials(lines, clips, 3, fields), probe.land_probes(li, 3, tables.out_probe_columns()),
            probe.land_metrics(li, 3, tables.metric_log_columns()), probe.land_runs(lines, 3, tables.run_columns(fields))))
        assert not left
        plain = (probe.land_trials(flat, clips, 3), probe.land_probes(tables.out_probes_from_tables(spark, sf_dir), 3),
                 probe.land_metrics(tables.metric_logs_from_tables(spark, sf_dir), 3), probe.land_runs(tables.runs_from_trials(flat), 3))
        for a, b in zip(moved, plain, strict=True):
            assert a.columns == b.columns and rows(a) == rows(b)
            plan = a.groupBy("stem").count()._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan
        names = [t.name for t in spark.catalog.listTables() if t.name.startswith("landed_")]
    assert len(names) >= 8 and sum(spark.catalog.tableExists(n) for n in names) == len(names) - 8


def test_reports_are_compressed_and_hold_nothing_twice(spark, sf_dir, tmpdir_path):
    import glob

    from trialgrid.operators import reports
    from trialgrid.sources import tables
    trials = tables.trials_from_tables(spark, sf_dir)
    rows, keys = reports.ordered_rows(trials, ["id", "enc_sec", "outfile_size_kbyte"])
    assert len(rows.columns) == len(reports.FLAT_COLUMNS) + 1 and keys[1:] == ["enc_sec", "outfile_size_kbyte"]  # nothing twice
    out = files.write_reports(trials, tmpdir_path + "/data.json", ["id", "enc_sec", "outfile_size_kbyte"])
    for kind, path in out.items():
        parts = glob.glob(path + "/part-*")
        assert parts and all(p.endswith(".csv.gz") for p in parts)
        assert files.read_report(spark, path, kind).columns[0] == "index"
    wide = files.read_report(spark, out["all"], "all")
    assert wide.count() == trials.count() and "id" not in wide.columns


def test_long_reports_are_written_in_lots(spark, sf_dir, tmpdir_path, monkeypatch):
    from trialgrid.operators import index, reports
    from trialgrid.sources import tables
    trials, order = tables.trials_from_tables(spark, sf_dir), ["id", "enc_sec", "outfile_size_kbyte"]
    monkeypatch.setattr(index, "ROWS_PER_RANGE", 500)
    monkeypatch.setattr(files, "LOT_RANGES", 4)
    sizes, write = [], files._write_report

    def counted(rows, path, mode="overwrite", whole=True):
        write(rows, path, mode, whole)
        sizes.append((path, mode, os.path.exists(f"{path}/_SUCCESS"), files.read_report(spark, path, "all").count() if path.endswith("_all.csv") else 0))

    monkeypatch.setattr(files, "_write_report", counted)
    out = files.write_reports(trials, tmpdir_path + "/data.json", order)
    lots, n = [s for s in sizes if s[0] == out["all"]], trials.count()
    assert len(lots) >= 3 and lots[-1][2:] == (True, n) and not any(s[2] for s in lots[:-1])
    assert max(b[3] - a[3] for a, b in zip([(0, 0, 0, 0), *lots], lots)) < n * 0.6
    seen = lambda df: sorted(map(str, df.select([F.col(c).cast("string") for c in df.columns]).collect()))
    flat = reports.flat_report(trials, order)
    assert seen(files.read_report(spark, out["all"], "all").select(flat.columns)) == seen(flat)
    assert os.path.exists(out["type"] + "/_SUCCESS")
