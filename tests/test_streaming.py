"""Live feed and re-deliveries: equal to a full recompute, batches cost what they bring, fresh checkpoints, bounded state."""

import os

import pytest
from pyspark.sql import functions as F

from trialgrid.operators import chart, grid
from trialgrid.sources import store, tables
from trialgrid.streaming import live

BY, ORDER = ["codec", "ref_type"], ["l_shipdate", "enc_sec", "outfile_size_kbyte"]


def norm(df):
    return sorted(tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in df.collect())


def test_stream_equals_batch(spark, tmpdir_path):
    # sf0.01: trial ids are unique there (sf0.001 holds one repeated line key,
    # which the stream rightly counts once and the batch twice).
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("sf0.01 not present")
    part = tables.table(spark, sf_dir, "part")
    li_schema = tables.table(spark, sf_dir, "lineitem").schema
    stream = live.stream_files(spark, sf_dir, li_schema, glob="lineitem.parquet")
    codecs = ["PROMO", "STANDARD"]
    got = live.live_chart_groups(spark, stream, lambda li: tables.trials_from_frames(li, part), BY, codecs,
                                 os.path.join(tmpdir_path, "feed"), os.path.join(tmpdir_path, "ck"), order=["enc_sec"])
    batch = chart.chart_groups(chart.codec_filter(chart.chart_rows(tables.trials_from_tables(spark, sf_dir),
                                                                   index=False), codecs), BY)
    assert norm(got) == norm(batch.select(*got.columns))


class Feed:
    """A folder of result files and the feed kept from it."""

    def __init__(self, spark, sf_dir, folder):
        self.spark, self.folder = spark, folder
        self.part, self.li = tables.table(spark, sf_dir, "part"), tables.table(spark, sf_dir, "lineitem")
        self.src, self.out = os.path.join(folder, "src"), os.path.join(folder, "out")
        self.li.limit(0).coalesce(1).write.parquet(self.src)

    def trials(self, lines):
        return tables.trials_from_frames(lines, self.part, keep_keys=True)

    def deliver(self, lines):
        lines.coalesce(1).write.mode("append").parquet(self.src)

    def refresh(self, checkpoint="ck", **options):
        stream = live.stream_files(self.spark, self.src, self.li.schema, max_files=1)
        return live.live_chart_groups(self.spark, stream, self.trials, BY, None, self.out,
                                      os.path.join(self.folder, checkpoint), order=ORDER, **options)

    def recomputed(self):
        lines = self.spark.read.schema(self.li.schema).parquet(self.src)
        trials = self.trials(lines)
        latest = grid.latest_by_id(trials, [*ORDER, *sorted(set(trials.columns) - {"id", *ORDER})])
        return chart.chart_groups(chart.chart_rows(latest.select(*trials.columns), index=False), BY)


@pytest.fixture()
def feed(spark, sf_dir, tmpdir_path):
    return Feed(spark, sf_dir, tmpdir_path)


def test_replaced_results_are_taken_back(feed):
    """Means follow, and a maximum sinks when the row that held it is replaced."""
    assert feed.refresh().collect() == []
    some = feed.li.where("l_orderkey < 60").dropDuplicates(tables.KEYS).cache()
    feed.deliver(some.withColumn("l_quantity", F.lit(50.0)).withColumn("l_shipdate", F.date_sub("l_shipdate", 5)))
    first = feed.refresh()
    assert norm(first) == norm(feed.recomputed().select(*first.columns)) and first.agg(F.max("stream_frames_p")).first()[0] == 50
    feed.deliver(some.withColumn("l_quantity", F.lit(7.0)))  # later results of the same trials
    feed.deliver(some.where("l_orderkey < 20").withColumn("l_quantity", F.lit(99.0)).withColumn("l_shipdate", F.date_sub("l_shipdate", 9)))
    got = feed.refresh()
    assert norm(got) == norm(feed.recomputed().select(*got.columns)) and got.agg(F.max("stream_frames_p")).first()[0] == 7
    assert norm(feed.refresh()) == norm(got)  # nothing new: the feed stays


def test_a_fresh_checkpoint_replaces_the_feed(feed, spark):
    """Epochs start at 0 again; neither an old version nor an old sum may show."""
    lines = feed.li.dropDuplicates(tables.KEYS)
    for low, high in ((0, 40), (40, 80), (80, 120)):
        feed.deliver(lines.where(f"l_orderkey > {low} and l_orderkey <= {high}"))
    feed.refresh()  # four batches
    feed.deliver(lines.where("l_orderkey > 120 and l_orderkey <= 160").withColumn("l_quantity", F.lit(100.0)))
    got = feed.refresh("another")
    assert norm(got) == norm(feed.recomputed().select(*got.columns)) and got.agg(F.max("stream_frames_p")).first()[0] == 100
    feed.deliver(lines.where("l_orderkey > 160 and l_orderkey <= 200"))
    with pytest.raises(Exception, match="doesn't hold the feed of this checkpoint"):
        feed.refresh("ck")  # the old checkpoint goes on at its epoch, but the path is another feed's now
    assert all(len(store._versions(spark, f"{feed.out}/{s}")) <= store.KEPT_VERSIONS for s in ("groups", "results"))


def test_a_batch_costs_its_own_rows(feed, spark, monkeypatch):
    """What a batch merges and rewrites depends on its rows and groups, not on the results before it."""
    merged = []
    upsert = store.upsert

    def counted(rows, *args, **options):
        merged.append(rows.count())
        return upsert(rows, *args, **options)

    monkeypatch.setattr(store, "upsert", counted)
    monkeypatch.setattr(store, "BUCKET_ROWS", 50)
    lines = feed.li.dropDuplicates(tables.KEYS)
    for which in ("l_orderkey > 100", "l_orderkey = 1", "l_orderkey = 2"):  # with the second one the buckets grow
        feed.deliver(lines.where(which))
    feed.refresh()
    n_lines = lines.where("l_orderkey = 2").count()
    assert max(merged) > 5000 and merged[-1] == n_lines and merged[-2] <= n_lines * 11  # a row, seven means, three values each at most
    manifest = store.read_manifest(spark, f"{feed.out}/results")
    assert manifest["n_buckets"] > 64 and len(manifest["rewritten"]) <= n_lines
    assert max(manifest["sizes"].values()) < 100


def test_a_batch_that_dies_between_the_stores(feed, spark, monkeypatch):
    """The aggregates are published, the results are not: the batch is tried again and counts once."""
    lines = feed.li.dropDuplicates(tables.KEYS)
    feed.deliver(lines.where("l_orderkey <= 60"))
    feed.refresh()
    publish = store.publish

    def dies(spark, path, manifest):
        if path.endswith("results"):
            raise RuntimeError("killed")
        publish(spark, path, manifest)

    feed.deliver(lines.where("l_orderkey <= 100").withColumn("l_quantity", F.lit(3.0)).withColumn("l_shipdate", F.date_add("l_shipdate", 3)))
    monkeypatch.setattr(store, "publish", dies)
    with pytest.raises(Exception, match="killed"):
        feed.refresh()
    monkeypatch.setattr(store, "publish", publish)
    got = feed.refresh()
    assert norm(got) == norm(feed.recomputed().select(*got.columns))


def test_periodic_refresh(feed):
    """The running query keeps the feed fresh by itself."""
    lines = feed.li.dropDuplicates(tables.KEYS)
    feed.deliver(lines.where("l_orderkey <= 20"))
    query = feed.refresh(available_now=False)
    try:
        query.processAllAvailable()
        schema = chart.chart_rows(feed.trials(feed.li), index=False).schema
        got = live.read_feed(feed.spark, feed.out, schema, BY)
        assert norm(got) == norm(feed.recomputed().select(*got.columns))
        feed.deliver(lines.where("l_orderkey > 20 and l_orderkey <= 50"))
        query.processAllAvailable()
        got = live.read_feed(feed.spark, feed.out, schema, BY)
        assert norm(got) == norm(feed.recomputed().select(*got.columns))
    finally:
        query.stop()


def test_redelivered_results_count_once(spark, tmpdir_path):
    """Ten batches an hour apart: the state holds what came within the span, later copies are settled by the store."""
    src, schema = os.path.join(tmpdir_path, "in"), "id string, codec string, hour bigint"
    os.makedirs(src)
    stream = live.stream_files(spark, src, spark.createDataFrame([], schema).schema, max_files=1)

    for hour in range(10):
        rows = [(f"t{hour}-{k}", "ab"[k % 2], hour) for k in range(20)]
        rows += [("t0-0", "a", hour), (f"t{max(0, hour - 1)}-1", "b", hour)]  # one from the start, one from the hour before
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    query = live.dedupe_results(stream, os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck"),
                                arrived=F.timestamp_seconds((F.col("hour") + 1000) * 3600), within="2 hours", available_now=False)
    try:
        query.processAllAvailable()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"] and p["numInputRows"]]
    finally:
        query.stop()
    out = store.read_current(spark, os.path.join(tmpdir_path, "out"), spark.createDataFrame([], schema).schema)
    assert {r.codec: r["count"] for r in out.groupBy("codec").count().collect()} == {"a": 100, "b": 100}
    assert out.where("id = 't0-0'").first().hour == 0  # the first delivery stays
    assert len(held) == 10 and max(held) <= 22 * 5  # not the 200 ids of all batches


def test_first_changes_are_those_from_nothing(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", None, "y"), (None, 2, None)], "id string, n int, v string")
    plain = live.latest_changes(spark.createDataFrame([], rows.schema), rows, "id", ["n"])
    first = live.first_changes(rows, "id", ["n"])
    assert first.columns == plain.columns
    assert sorted(map(str, first.collect())) == sorted(map(str, plain.collect()))
