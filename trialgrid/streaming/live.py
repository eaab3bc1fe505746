"""Live chart feed with Structured Streaming.

The reference polls its data file every 10 s and, when it changed, reloads
everything and replaces the chart feed. Here results arrive as append-only
files and a batch costs what it brings:

1. the latest result per trial id lies in a bucketed store (`sources.store`).
   A batch looks its own ids up there, in the buckets they fall into, whose
   size is bounded, and works out its changes: a new result with sign +1 and
   the result it replaces with sign -1;
2. the changes are summed by group and merged into a small store of
   retractable aggregates: rows, non-null counts and exact decimal sums per
   mean series, and a count per value of the max series, so that the maximum
   is known again when the row that held it is replaced;
3. both stores publish a manifest together with the batch's token (feed id and
   epoch), first the aggregates, then the results. A batch that is tried again
   finds its token in the stores that have it and goes on from there; the
   changes it works out are the same, as the results come last.

The feed is read from the aggregates, so readers see the state before a batch
or after it. A feed id lies in the checkpoint: a fresh checkpoint reads the
source from its start and replaces what `out_path` held in the step that
publishes its first batch; an old checkpoint on another feed's path is an
error. Versions that no one needs are removed after each batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialgrid.operators import chart, grid
from trialgrid.session import scratch_table
from trialgrid.sources import store

REFRESH_SECONDS = 10
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State is mostly ids, hexadecimal texts that LZ4 leaves as they are.
STATE_CONF = {STATE_STORE: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.compression": "zstd"}
#: Sums are exact: doubles count as their shortest decimal text, to twelve places.
EXACT = "decimal(38,12)"


def live_groups(rows: DataFrame, by: list[str], codecs: list[str] | None = None) -> DataFrame:
    """Codec filter + chart groups of one snapshot."""
    return chart.chart_groups(chart.codec_filter(rows, codecs), by)


def _run(stream: DataFrame, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None], available_now: bool):
    """Start a query that hands every micro-batch to `each`; its state is kept
    in RocksDB, off the heap. `available_now` drains what is there and stops
    (tests, catch-up); otherwise a 10 s processing-time trigger runs on."""
    spark = stream.sparkSession
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
        writer = (writer.trigger(availableNow=True) if available_now
                  else writer.trigger(processingTime=f"{REFRESH_SECONDS} seconds"))
        query = writer.start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    if available_now:
        query.awaitTermination()
    return query


def stream_files(spark: SparkSession, directory: str, schema, glob: str | None = None,
                 fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(directory)


def _feed_id(spark: SparkSession, checkpoint: str) -> str:
    """The id kept in the checkpoint; a fresh checkpoint gets a new one."""
    _, fs, Path = store._files(spark, checkpoint)
    place = Path(checkpoint, "feed-id")
    if not fs.exists(place):
        stream = fs.create(place, False)
        stream.write(bytearray(uuid.uuid4().hex.encode()))
        stream.close()
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _is_first(spark: SparkSession, out_path: str, feed: str, epoch: int) -> bool:
    """Whether this batch starts a new feed at `out_path`."""
    manifest = store.read_manifest(spark, out_path)
    if manifest is not None and (manifest["token"] or {}).get("feed") == feed:
        return False
    if epoch > 0:
        raise RuntimeError(f"{out_path} doesn't hold the feed of this checkpoint")
    return True


# --- changes of the latest results --------------------------------------------

def latest_changes(before: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(sign, columns of `rows`): the latest result per `key` by `order` with +1
    where `rows` bring it, and with -1 the one in `before` that it replaces.
    Nulls come first in `order`; among equals the other columns decide; a
    result that is there already changes nothing."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    found = before.join(rows.select(key), key, "left_semi").withColumn("_old", F.lit(1)).unionByName(rows.withColumn("_old", F.lit(0)))
    row = F.struct(*order, *rest)
    best = F.max(F.struct(*order, *rest, "_old")).alias("best")
    replaced = F.max(F.when(F.col("_old") == 1, row)).alias("replaced")
    of = found.groupBy(key).agg(best, replaced).where("best._old = 0")
    now = F.struct(F.lit(1).alias("sign"), *[F.col(f"best.{c}").alias(c) for c in (*order, *rest)])
    was = F.when(F.col("replaced").isNotNull(), F.struct(F.lit(-1).alias("sign"), *[F.col(f"replaced.{c}").alias(c) for c in (*order, *rest)]))
    return of.select(key, F.explode(F.array_compact(F.array(now, was))).alias("x")).select("x.sign", key, *[f"x.{c}" for c in (*order, *rest)])


def first_changes(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`latest_changes` of `rows` with one result per `key`, while there are none before them."""
    return rows.select(F.lit(1).alias("sign"), key, *order, *[c for c in rows.columns if c not in (key, *order)])


# --- retractable aggregates ---------------------------------------------------

def _parts(changes: DataFrame, by: list[str]) -> DataFrame:
    """(by.., series, value, n, total) of signed chart rows: the group's rows
    (series ''), count and sum of a mean series, count of a value of a max series."""
    exact = [F.struct(F.lit(c).alias("series"), F.lit(None).cast("bigint").alias("value"),
                      F.col(c).isNotNull().cast("int").alias("one"), F.col(c).cast("decimal(28,12)").alias("x"))
             for c in chart.MEAN_SERIES]
    counted = [F.struct(F.lit(c).alias("series"), F.col(c).cast("bigint").alias("value"),
                        F.col(c).isNotNull().cast("int").alias("one"), F.lit(None).cast("decimal(28,12)").alias("x"))
               for c in chart.MAX_SERIES]
    row = F.struct(F.lit("").alias("series"), F.lit(None).cast("bigint").alias("value"), F.lit(1).alias("one"),
                   F.lit(None).cast("decimal(28,12)").alias("x"))
    one_each = changes.dropna(subset=by).select(*by, "sign", F.explode(F.array(row, *exact, *counted)).alias("p")).where("p.one = 1")
    signed = F.when(F.col("sign") > 0, F.col("p.x")).otherwise(-F.col("p.x"))
    return one_each.groupBy(*by, F.col("p.series").alias("series"), F.col("p.value").alias("value")).agg(
        F.sum(F.col("sign").cast("bigint")).alias("n"), F.sum(signed).cast(EXACT).alias("total"))


def _merged(by: list[str]) -> Callable[[DataFrame], DataFrame]:
    def merge(parts: DataFrame) -> DataFrame:
        return (parts.groupBy(*by, "series", "value").agg(F.sum("n").alias("n"), F.sum("total").cast(EXACT).alias("total"))
                .where("n <> 0"))
    return merge


def _feed(parts: DataFrame, by: list[str]) -> DataFrame:
    """Chart groups (the columns and order of `chart.chart_groups`) from merged parts."""
    of = lambda c: F.col("series") == F.lit(c)
    means = [F.max(F.when(of(c), F.col("total").cast("double") / F.col("n").cast("double"))).alias(c) for c in chart.MEAN_SERIES]
    tops = [F.max(F.when(of(c) & (F.col("n") > 0), F.col("value"))).alias(c) for c in chart.MAX_SERIES]
    rows = F.max(F.when(of(""), F.col("n"))).alias("_rows")
    label = F.concat_ws("_", *[F.col(k).cast("string") for k in by]).alias("group")
    return (parts.groupBy(*by).agg(rows, *means, *tops).where("_rows > 0")
            .select(*by, *chart.MEAN_SERIES, *chart.MAX_SERIES, label).orderBy(*by))


def parts_schema(rows: T.StructType, by: list[str]) -> T.StructType:
    return T.StructType([*[T.StructField(c, rows[c].dataType) for c in by], T.StructField("series", T.StringType()),
                         T.StructField("value", T.LongType()), T.StructField("n", T.LongType()),
                         T.StructField("total", T.DecimalType(38, 12))])


def read_feed(spark: SparkSession, out_path: str, rows: T.StructType, by: list[str]) -> DataFrame:
    """The chart groups as last published under `out_path` (`rows`: schema of the chart rows); empty while there are none."""
    return _feed(store.read_current(spark, f"{out_path.rstrip('/')}/groups", parts_schema(rows, by)), by)


def live_chart_groups(spark: SparkSession, source: DataFrame, to_trials: Callable[[DataFrame], DataFrame],
                      by: list[str], codecs: list[str] | None, out_path: str, checkpoint: str,
                      order: list[str], available_now: bool = True) -> DataFrame:
    """Source rows -> trials -> latest result per id by `order` -> chart groups,
    kept fresh under `out_path`. Returns the feed, or the running query."""
    trials = to_trials(source)
    spark = source.sparkSession
    chart_cols = chart.chart_rows(trials, index=False)
    numbered = [f"_o{i}" for i in range(len(order))]
    needed = sorted({"codec", *by, *chart.MEAN_SERIES, *chart.MAX_SERIES}, key=chart_cols.columns.index)
    stream = trials.select("id", *[F.col(c).alias(n) for n, c in zip(numbered, order, strict=True)], *chart.chart_columns())
    feed, results, groups = _feed_id(spark, checkpoint), f"{out_path.rstrip('/')}/results", f"{out_path.rstrip('/')}/groups"
    last = lambda both: grid.latest_by_id(both, [*numbered, *needed])

    def merge(batch: DataFrame, epoch: int) -> None:
        fresh, token = _is_first(spark, groups, feed, epoch), {"feed": feed, "epoch": epoch}
        fresh_results = _is_first(spark, results, feed, epoch)
        with scratch_table(last(batch.select("id", *numbered, *needed)).select("id", *numbered, *needed), "results") as rows:
            if fresh_results:  # nothing there that could be replaced
                found = nullcontext(first_changes(rows, "id", numbered))
            else:
                found = scratch_table(latest_changes(store.read_touched(rows, results, ["id"]), rows, "id", numbered), "changes")
            with found as changes:
                with scratch_table(_parts(chart.codec_filter(changes, codecs), by), "parts") as parts:
                    store.upsert(parts, groups, by, _merged(by), token=token, fresh=fresh)
                store.upsert(changes.where("sign > 0").drop("sign"), results, ["id"], last, token=token, fresh=fresh_results)
        for path in (groups, results):
            store.vacuum(spark, path)

    query = _run(stream, "append", checkpoint, merge, available_now)
    return read_feed(spark, out_path, chart_cols.schema, by) if available_now else query


# --- re-deliveries ------------------------------------------------------------

def dedupe_results(stream: DataFrame, out_path: str, checkpoint: str, key: str = "id", arrived: Column | None = None,
                   within: str = "1 hour", n_buckets: int = store.DEFAULT_BUCKETS, available_now: bool = True):
    """Results of a known trial count once, however late they come again.

    Copies that arrive within `within` of each other are dropped in the stream:
    the state holds the keys of that span only. `arrived` is the time of
    arrival (default: the batch's), so no row is ever too late. What passes is
    merged into a bucketed store, where a key that is already committed stays
    as it is; that settles copies that come later. Returns the committed rows,
    or the running query."""
    spark = stream.sparkSession
    columns = stream.columns
    timed = stream.withColumn("_arrived", F.current_timestamp() if arrived is None else arrived)
    fewer = timed.withWatermark("_arrived", within).dropDuplicatesWithinWatermark([key])
    feed = _feed_id(spark, checkpoint)

    def commit(batch: DataFrame, epoch: int) -> None:
        fresh = _is_first(spark, out_path, feed, epoch)
        rest = [c for c in columns if c != key]

        def first(both: DataFrame) -> DataFrame:
            kept = F.min(F.struct("_epoch", *rest)).alias("kept")
            return both.groupBy(key).agg(kept).select(key, "kept.*")

        results = batch.select(*columns).withColumn("_epoch", F.lit(epoch).cast("bigint"))
        with scratch_table(store.sliced(results, [key]), "results", by=[store.SLICE]) as rows:
            store.upsert(rows, out_path, [key], first, n_buckets, {"feed": feed, "epoch": epoch}, fresh)
        store.vacuum(spark, out_path)

    query = _run(fewer, "append", checkpoint, commit, available_now)
    if not available_now:
        return query
    schema = T.StructType([*stream.schema.fields, T.StructField("_epoch", T.LongType())])
    return store.read_current(spark, out_path, schema).drop("_epoch")
