"""Registered queries: one `(spark, sf_dir) -> DataFrame` per operator.

Each builds its inputs from the driver's tables (so its work grows with
them) and runs a library operator over them, whole. Double outputs are
rounded to 6 places (`ROUND_DIGITS`) in both this catalog and the SQL oracle:
two engines sum in different orders, and the compare hashes exact values.
Arrays are returned as joined text for the same reason.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialgrid.functions import command, ids, metrics, paths, timefmt
from trialgrid.operators import chart, frames, grid, probe, progress, reports, select, summary
from trialgrid.session import scratch_path
from trialgrid.schemas import METRIC_SCHEMA, TRIAL_COLUMNS
from trialgrid.sources import files, logs, tables
from trialgrid.sources.trials import nest_trials
from trialgrid.streaming import live

ROUND_DIGITS = 6

# Fixed parameters of the registered queries.
CHART_SELECTION = ["PROMO", "STANDARD"]
CHART_BY = ["codec", "ref_type"]
BASELINE_OPTIONS = "-q 1"
NO_EFFECT_EPS = dict(size_pct_eps=1.0, vmaf_eps=2.0, ssim_eps=0.01, comp_eps=0.05)
PATTERN_CODEC = "PROMO"
PATTERN_TYPE = "all"
#: A task that writes a file per log writes about so many.
LOG_FILES_PER_TASK = 500


def rounded(df: DataFrame, digits: int = ROUND_DIGITS) -> DataFrame:
    return df.select(*[metrics.sql_round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _trials(spark, d, keep_keys=False):
    return tables.trials_from_tables(spark, d, keep_keys)


def _type_report(spark, d, index=True):
    return reports.report_by_type(_trials(spark, d), index=index)


# --- reports and summaries --------------------------------------------------

# Trial order of the flat reports: id, then measurements as tie-breakers (two
# lines may share all four keys).
TRIAL_ORDER = ["id", "enc_sec", "outfile_size_kbyte"]


def q_flat_report(spark, d):
    return rounded(reports.flat_report(_trials(spark, d), TRIAL_ORDER))


def q_type_report(spark, d):
    return rounded(_type_report(spark, d))


def q_option_report(spark, d):
    return rounded(reports.report_by_option(_trials(spark, d)))


def q_quality_gate(spark, d):
    return rounded(summary.quality_gate(_type_report(spark, d, index=False)))


def q_summary_by_ref(spark, d):
    return rounded(summary.summary_by_ref(_type_report(spark, d, index=False)))


def q_summary_by_codec(spark, d):
    return rounded(summary.summary_by_codec(_type_report(spark, d, index=False)))


def q_avg_of_avg(spark, d):
    t = _trials(spark, d)
    return rounded(summary.avg_of_avg(t, reports.report_by_type(t, index=False)))


def q_score(spark, d):
    """Per-row score `pt` of the per-ref-type report."""
    r = _type_report(spark, d, index=False)
    return rounded(r.select(*reports.TYPE_KEYS, metrics.score(
        F.col("vmaf_min"), F.col("vmaf_mean"), F.col("ssim_mean"), F.col("comp_ratio_persent")).alias("pt")))


# --- chart feed ---------------------------------------------------------------

def _chart_rows(spark, d, index=False):
    return chart.chart_rows(_trials(spark, d), order=TRIAL_ORDER, index=index)


def _groups(spark, d):
    return chart.chart_groups(_chart_rows(spark, d), CHART_BY)


def q_chart_rows(spark, d):
    return rounded(_chart_rows(spark, d, index=True))


def q_codec_filter(spark, d):
    return rounded(chart.codec_filter(_chart_rows(spark, d), CHART_SELECTION))


def q_codec_domain(spark, d):
    return chart.codec_domain(_chart_rows(spark, d))


def q_chart_groups(spark, d):
    return rounded(_groups(spark, d))


def q_chart_feed(spark, d):
    return rounded(chart.chart_feed(_groups(spark, d)))


def q_chart_factors(spark, d):
    return chart.chart_factors(_groups(spark, d))


def q_axis_max(spark, d):
    return rounded(chart.chart_axes(_groups(spark, d)))


def q_chart_stack(spark, d):
    """Long form of the stacked frame series (B, P, I from the bottom)."""
    return chart.frame_stack(_groups(spark, d))


# --- sources and sinks (round trips through the shared checkpoint folder) -----------

def q_report_roundtrip(spark, d):
    """S5 + S2: write the three report CSVs, read the per-ref-type one back
    with its declared schema."""
    out = files.write_reports(_trials(spark, d), scratch_path(spark, "reports") + "/data.json")
    return rounded(files.read_report(spark, out["type"], "type"))


def q_reports_written(spark, d):
    """S5 + S2: all three report files, each read back with its declared schema."""
    out = files.write_reports(_trials(spark, d), scratch_path(spark, "reports") + "/data.json", TRIAL_ORDER)
    read = [files.read_report(spark, out[k], k).select(F.lit(k).alias("kind"), "*") for k in ("all", "type", "option")]
    return rounded(read[0].unionByName(read[1], allowMissingColumns=True).unionByName(read[2], allowMissingColumns=True))


def q_has_trials(spark, d):
    """What the guard says of the committed trials, of an empty file and of none."""
    path = scratch_path(spark, "trials")
    trials = nest_trials(_trials(spark, d))
    files.commit_results(trials, path + "/some")
    files.commit_results(trials.limit(0), path + "/empty")
    found = [(name, files.has_trials(spark, f"{path}/{name}")) for name in ("some", "empty", "none")]
    return spark.createDataFrame(found, "name string, has_trials boolean")


def q_saved_trials(spark, d):
    """The known cells and the new ones saved by the three-way rule, then saved again unchanged; read back."""
    path, (now, known) = scratch_path(spark, "saved"), _grids(spark, d)
    old = known.select("id", "config")
    both = old.unionByName(grid.new_trials(now, known, "opt_key").select("id", "config"))
    said = [grid.save_trials(old, both, path, new_config=False)]
    saved = grid.read_saved(both, path)
    said.append(grid.save_trials(saved, grid.unique_by_id(saved), path, new_config=False))
    return saved.withColumn("said", F.lit(" ".join(said)))


def q_probe_log_files(spark, d):
    """S3 + S11: one probe log file per supplier, read by the log source, their frames
    counted and stripped, what is left written and read back."""
    path = scratch_path(spark, "probe-files")
    suppliers = tables.table(spark, d, "supplier").count()
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suppliers // LOG_FILES_PER_TASK))
    # A file takes longer than its few bytes tell AQE: the number is given, by a hash of the key,
    # as by the key itself the join has dealt the rows already and its small tasks are merged.
    (tables.supplier_probe_logs(spark, d).repartition(n_tasks, F.xxhash64("s_suppkey"))
     .write.partitionBy("s_suppkey").option("maxRecordsPerFile", 1).json(path + "/logs"))
    read = files.read_probe_logs(spark, path + "/logs")
    counted = read.withColumn("n_frames", F.size("frames").cast("bigint")).withColumn(
        "n_i_frames", F.size(F.filter("frames", lambda f: f["pict_type"] == F.lit("I"))).cast("bigint"))
    files.write_probe_logs(probe.strip_frames(counted), path + "/stripped")
    back = spark.read.parquet(path + "/stripped")
    return back.select(F.regexp_extract("path", r"s_suppkey=(\d+)/", 1).cast("bigint").alias("s_suppkey"),
                       F.col("format.size").alias("size"), F.col("format.bit_rate").alias("bit_rate"),
                       F.get("streams", F.lit(0))["refs"].alias("refs"), "n_frames", "n_i_frames",
                       F.array_contains(F.lit(back.columns), "frames").alias("has_frames"))


def q_metric_log_files(spark, d):
    """The quality-score logs of all lines in files of many records, read by the log source in byte ranges."""
    path = scratch_path(spark, "metric-files")
    tables.metric_logs_from_tables(spark, d).withColumnRenamed("path", "stem").write.json(path)
    read = logs.read_logs(spark, path, T.StructType([T.StructField("stem", T.StringType()), *METRIC_SCHEMA.fields]),
                          range_bytes=4 << 20)
    pooled = "pooled_metrics."
    return rounded(read.select("stem", "version", *[F.col(f"{pooled}{m}.{x}").alias(f"{n}_{x}") for m, n in
                                                    (("float_ssim", "ssim"), ("vmaf", "vmaf")) for x in ("min", "max", "mean", "harmonic_mean")]))


def q_trial_records(spark, d):
    """S8 + S1: commit trials as nested records (append-only Parquet), read
    them back and flatten; every leaf is compared."""
    path = scratch_path(spark, "trials")
    files.commit_results(nest_trials(_trials(spark, d)), path)
    return rounded(files.read_trials(spark, path, fmt="parquet"))


def q_current_trials(spark, d):
    """All trials committed once, then the open ones and the returned ones
    again with other measurements; the state after the three commits."""
    path = scratch_path(spark, "current")
    trials = _trials(spark, d).select("id", "codec", "type", "ref_type", "outfile_options", "outfile_hash", "enc_sec",
                                      "outfile_size_kbyte")
    deliveries = [F.lit(True), F.col("ref_type") == F.lit("O"), F.col("type") == F.lit("R")]
    for no, which in enumerate(deliveries):
        results = (trials.where(which).withColumn("commit_no", F.lit(no).cast("bigint"))
                   .withColumn("enc_sec", F.col("enc_sec") + F.lit(float(no))))
        # nobody else reads this store: no version before the last is needed
        files.commit_current(results, path, ["commit_no", "enc_sec", "outfile_size_kbyte"], n_buckets=16, keep=1)
    return rounded(files.read_current(spark, path, results.schema))


def q_file_hashes(spark, d):
    """One clip file per nation holding its suppliers' names (one line
    each, in key order), hashed whole with the binaryFile source; the file
    count is fixed and each file grows with the data. Every nation is written
    by one task in key order, so the bytes (and hashes) are deterministic."""
    path = scratch_path(spark, "clips")
    (tables.table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name")
     .repartition(25, "s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
     .drop("s_suppkey").write.partitionBy("s_nationkey").mode("overwrite").text(path))
    h = files.hash_files(spark, path + "/*/*.txt")
    key = F.regexp_extract(F.col("path"), r"s_nationkey=(\d+)/", 1).cast("int")
    return h.select(key.alias("s_nationkey"), "sha256")


def q_probe_logs(spark, d):
    """S3 + S11: output probe logs without their frames, landed as JSON
    Lines and read back with the declared schema; numbers stay text."""
    path = scratch_path(spark, "probes")
    files.write_probe_log_lines(probe.strip_frames(tables.out_probes_from_tables(spark, d)), path)
    back = files.read_probe_log_lines(spark, path)
    return back.select("path", F.col("format.duration").alias("duration"), F.col("format.size").alias("size"),
                       F.col("format.bit_rate").alias("bit_rate"),
                       F.col("streams")[0]["has_b_frames"].alias("has_b_frames"),
                       F.col("streams")[0]["refs"].alias("refs"), F.size("streams").cast("bigint").alias("n_streams"))


# --- grid ------------------------------------------------------------------------

def _grid(spark, d, previous=False):
    return grid.expand_grid(tables.patterns_from_tables(spark, d, previous),
                            tables.references_from_tables(spark, d))


def _grids(spark, d):
    """The sweeps' grid and that of their earlier version, dealt alike by the key of the option id."""
    refs, now = tables.references_from_tables(spark, d), tables.patterns_from_tables(spark, d)
    sizes = grid.written_sizes(now, refs)
    n_tasks = grid.tasks_for(spark, sizes.agg(F.sum("cells")).first()[0] or 0)
    return (grid.expand_grid(now, refs, sizes=sizes, opt_key=True, n_tasks=n_tasks),
            grid.expand_grid(tables.patterns_from_tables(spark, d, previous=True), refs, opt_key=True, n_tasks=n_tasks))


def _grid_cols(df):
    return df.select("config", "pattern_no", "preset_no", "option_no", "ref_no", "id", "id_opt",
                     "codec", "type", "preset", "out_option", "ref_name", "outfile_filename")


def q_param_grid(spark, d):
    return _grid_cols(_grid(spark, d))


def q_grid_size(spark, d):
    """Number of grid cells per sweep."""
    return grid.grid_sizes(tables.patterns_from_tables(spark, d), tables.references_from_tables(spark, d)).select("config", "cells")


def q_new_trials(spark, d):
    new, old = _grids(spark, d)
    return _grid_cols(grid.new_trials(new, old, "opt_key"))


def q_append_trials(spark, d):
    now, old = _grids(spark, d)
    new = grid.new_trials(now, old, "opt_key")
    order = ["config", "pattern_no", "preset_no", "option_no", "ref_no"]
    out = grid.append_trials(old.select("id", *order), new.select("id", *order), order, order)
    return out.select("src", "id", *[F.col(f"ord.{c}").alias(c) for c in order])


def q_pattern_filter(spark, d):
    p = grid.filter_patterns(tables.patterns_from_tables(spark, d), PATTERN_CODEC, PATTERN_TYPE)
    return p.select("config", "pattern_no", "codec", "type", "comments",
                    F.array_join("presets", "|").alias("presets"),
                    F.array_join("outfile.options", "|").alias("options"))


def q_sequence_grid(spark, d):
    prefixes = tables.table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("-c:v "), F.col("p_type"), F.lit(" -tag p"),
                              F.col("p_partkey").cast("string")).alias("prefix"))
    return grid.sequence_grid(prefixes).select("p_partkey", "qp_i", "qp_p", "qp_b", "option")


def q_latest_by_id(spark, d):
    """Latest record per option id (many trials share one), by ship date then keys."""
    t = _trials(spark, d, keep_keys=True).select(
        F.col("id_opt").alias("id"), "l_shipdate", *tables.KEYS, F.col("outfile_size_kbyte").alias("size"))
    return grid.latest_by_id(t, ["l_shipdate", *tables.KEYS]).drop("l_shipdate")


def q_trial_ids(spark, d):
    g = _grid(spark, d)
    return g.select("config", "pattern_no", "preset_no", "option_no", "ref_no", "id_opt", "id",
                    "outfile_filename")


def q_pending_trials(spark, d):
    t = grid.pending(_trials(spark, d))
    return t.select("id", "codec", "type", "outfile_options", "ref_name")


def q_completeness(spark, d):
    return progress.completeness(_trials(spark, d))


def q_progress_eta(spark, d):
    return rounded(progress.progress_eta(_trials(spark, d)))


# --- scalar functions ----------------------------------------------------------

def q_format_seconds(spark, d):
    li = tables.table(spark, d, "lineitem")
    secs = F.floor(F.col("l_extendedprice")).cast("bigint")
    return li.select(*tables.KEYS, secs.alias("seconds"),
                     timefmt.format_seconds(secs).alias("text"))


def q_hms(spark, d):
    li = tables.table(spark, d, "lineitem")
    x = F.col("l_extendedprice") * F.lit(1.5)
    return rounded(li.select(*tables.KEYS, x.alias("seconds"), timefmt.hms(x).alias("hms")))


def q_path_rewrite(spark, d):
    t = _trials(spark, d, keep_keys=True)
    datafile = F.concat(F.lit("cfg/"), F.col("codec"), F.lit(".json/data"), F.col("id").substr(1, 12),
                        F.lit(".json"))
    return t.select(*tables.KEYS,
                    paths.with_side_suffix(F.col("infile_filename"), probe.PROBE_SUFFIX).alias("probe_path"),
                    paths.replace_first(datafile, F.lit(".json"), F.lit("_all.csv")).alias("report_first"),
                    paths.replace_all(datafile, ".json", "_gby_type.csv").alias("report_all"))


def _option_text(spark, d):
    li = tables.table(spark, d, "lineitem")
    return li.select(*tables.KEYS, F.concat(
        F.lit(" "), F.col("l_returnflag"), F.lit("  -q "), F.col("l_linenumber").cast("string"),
        F.lit("\t-b  "), F.col("l_linestatus"), F.lit(" ")).alias("options"))


def q_option_tokens(spark, d):
    o = _option_text(spark, d)
    tok = command.option_tokens(F.col("options"))
    return o.select(*tables.KEYS, F.array_join(tok, "|").alias("tokens"), F.size(tok).cast("bigint").alias("n_tokens"))


def q_command_line(spark, d):
    t = _trials(spark, d)
    hw = F.when(F.col("codec") == F.lit("PROMO"), F.lit("-hwaccel qsv")).otherwise(F.lit(""))
    pre = F.when(F.col("type") == F.lit("N"), F.lit("none")).otherwise(F.col("preset"))
    line = F.array_join(command.command_tokens(
        F.col("threads"), hw, F.col("infile_option"), F.col("infile_filename"), F.col("outfile_options"),
        F.col("codec"), pre, F.col("outfile_filename")), " ")
    return t.select("id", line.alias("commandline"))


# --- frames, probes, references ----------------------------------------------

def _frames(spark, d):
    return tables.frames_from_tables(spark, d)


def _segments(spark, d):
    fr = _frames(spark, d)
    return frames.gop_segments(fr, ["ts", "event_id"], frames.time_chunk(fr, "ts"))


def q_frame_counts(spark, d):
    return frames.frame_counts(_frames(spark, d))


def q_gop_segments(spark, d):
    return _segments(spark, d)


def q_first_gop(spark, d):
    return frames.first_gop(_segments(spark, d))


def q_pool_scores(spark, d):
    return rounded(frames.pool_scores(tables.frame_scores_from_tables(spark, d)))


def q_base_probe_join(spark, d):
    j = probe.base_probe_join(_trials(spark, d), tables.base_probes_from_tables(spark, d))
    return rounded(j.select("id", "base_probe_path", "base_duration", "base_size"))


def _frame_info(spark, d):
    fr = _frames(spark, d)
    return frames.frame_info(fr, ["ts", "event_id"], frames.time_chunk(fr, "ts"))


def q_enrich_trials(spark, d):
    fields = tables.trial_columns()
    out = probe.enrich_trials(
        tables.trial_lines(tables.table(spark, d, "lineitem"), tables.table(spark, d, "part")), tables.base_probes_from_tables(spark, d), tables.out_probes_from_tables(spark, d),
        tables.metric_logs_from_tables(spark, d), _frame_info(spark, d),
        frames_key=F.concat(F.lit("u/"), F.col("l_suppkey").cast("string")),
        encode_seconds=fields["enc_sec"], columns=fields)
    return rounded(out)


def q_enriched_records(spark, d):
    """J6 + F1: whole nested records from landed trials and logs, committed and read back; every leaf is compared."""
    lines, logged = tables.trial_lines(tables.table(spark, d, "lineitem"), tables.table(spark, d, "part")), tables.table(spark, d, "lineitem")
    fields = tables.trial_columns()
    framed = lines.withColumn("file", F.concat(F.lit("u/"), F.col("l_suppkey").cast("string"))).join(_frame_info(spark, d), "file")
    path = scratch_path(spark, "records")
    with probe.landing(spark):
        records = probe.record_results(
            probe.land_trials(lines, tables.base_probes_from_tables(spark, d), columns=fields),
            probe.land_probes(logged, columns=tables.out_probe_columns()), probe.land_metrics(logged, columns=tables.metric_log_columns()),
            probe.land_frames(framed, columns={"file": fields["outfile_filename"]}),
            probe.land_runs(lines, columns=tables.run_columns(fields)))
        files.commit_results(records, path)
    return rounded(files.read_trials(spark, path, fmt="parquet"))


def q_verify_references(spark, d):
    return probe.verify_references(tables.references_from_suppliers(spark, d),
                                   tables.file_hashes_from_suppliers(spark, d),
                                   tables.ref_probes_from_suppliers(spark, d))


def q_missing_references(spark, d):
    return probe.missing_references(tables.references_from_suppliers(spark, d),
                                    tables.file_hashes_from_suppliers(spark, d),
                                    tables.ref_probes_from_suppliers(spark, d),
                                    tables.default_refs_from_suppliers(spark, d))


# --- selection procedures ------------------------------------------------------

def q_threshold_candidates(spark, d):
    return rounded(select.threshold_candidates(_type_report(spark, d, index=False)))


def q_best_candidate(spark, d):
    return rounded(select.best_candidate(_type_report(spark, d, index=False)))


def _deltas(spark, d):
    return select.baseline_delta(_type_report(spark, d, index=False), BASELINE_OPTIONS)


def q_baseline_delta(spark, d):
    return rounded(_deltas(spark, d))


def q_no_effect(spark, d):
    return rounded(select.no_effect(_deltas(spark, d), **NO_EFFECT_EPS))


# Of two results of a trial the later one counts; measurements break ties.
LIVE_ORDER = ["l_shipdate", "enc_sec", "outfile_size_kbyte"]


# --- streaming -------------------------------------------------------------------

def _scratch(spark) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return scratch_path(spark, "live")


def _lineitem_stream(spark, d):
    li = tables.table(spark, d, "lineitem")
    return live.stream_files(spark, d, li.schema, glob="lineitem.parquet")


def q_stream_chart_groups(spark, d):
    part = tables.table(spark, d, "part")
    work = _scratch(spark)
    out = live.live_chart_groups(
        spark, _lineitem_stream(spark, d), lambda li: tables.trials_from_frames(li, part, keep_keys=True),
        CHART_BY, None, os.path.join(work, "live"), os.path.join(work, "ckpt"), order=LIVE_ORDER)
    return rounded(out)


def q_stream_dedupe(spark, d):
    """Trials per codec after de-duplicating re-delivered results by id."""
    part = tables.table(spark, d, "part")
    work = _scratch(spark)
    trials = tables.trials_from_frames(_lineitem_stream(spark, d), part).select("id", "codec")
    once = live.dedupe_results(trials, os.path.join(work, "results"), os.path.join(work, "ckpt"))
    return once.groupBy("codec").agg(F.count(F.lit(1)).alias("trials"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
