"""Driver tables -> the trial shape (and the other fixtures the operators read).

The driver hands us TPC-H-like Parquet tables. A trial is one `lineitem` row
joined to its `part`: the part gives the codec and the clip, the line gives
the measurements. The join is left to Catalyst/AQE (broadcast only when the
runtime size of `part` is under the threshold, a sort-merge join otherwise),
and every field is a projection, so column pruning reaches the Parquet scan:
a report that reads five fields reads only their source columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.functions import ids, timefmt
from trialgrid.schemas import TRIAL_COLUMNS

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Fixed values of the fixture mapping.
PRESET = "medium"
THREADS = "4"
CLIP_SECONDS = 120.0
METRIC_VERSION = "2.3.1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def key_text(*cols: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _d(x) -> Column:
    return F.lit(float(x))


def trials_from_tables(spark: SparkSession, sf_dir: str, keep_keys: bool = False) -> DataFrame:
    """`lineitem JOIN part` as the flat trial table (plus the four line keys
    and the ship date when `keep_keys`)."""
    return trials_from_frames(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), keep_keys)


def trials_from_frames(li: DataFrame, part: DataFrame, keep_keys: bool = False) -> DataFrame:
    """Same mapping from given DataFrames (batch or streaming `lineitem`).
    Returns the flat trial table (schemas.TRIAL_COLUMNS); every column is an
    independent expression, so a job computes only the columns it reads."""
    cols = trial_columns()
    out = [cols[c].alias(c) for c in TRIAL_COLUMNS]
    if keep_keys:
        out += [F.col(c) for c in KEYS] + [F.col("l_shipdate")]
    return trial_lines(li, part).select(*out)


def trial_lines(li: DataFrame, part: DataFrame) -> DataFrame:
    """One row per trial, as the source columns that `trial_columns` reads."""
    return li.join(part, li.l_partkey == part.p_partkey, "inner")


def trial_columns() -> dict[str, Column]:
    """Every trial field as an expression over `trial_lines`. A job that moves
    its rows moves fewer bytes as source columns than as ids and paths."""
    tid = F.sha2(key_text(*KEYS), 256)
    lq, ln = F.col("l_quantity"), F.col("l_linenumber")
    codec, typ = F.col("p_type"), F.col("l_returnflag")
    options = F.concat(F.lit("-q "), ln.cast("string"))
    frames_i, frames_p, frames_b = ln.cast("bigint"), lq.cast("bigint"), F.col("p_size").cast("bigint")
    total = frames_i + frames_p + frames_b
    k = F.when(F.col("l_linestatus") == "F", F.lit(2)).otherwise(F.lit(1))
    probe_sec = F.col("l_tax") * _d(100)
    vmaf_sec = F.col("l_discount") * _d(1000)

    return {
        "id": tid,
        "id_opt": ids.option_hash(codec, typ, F.lit(PRESET), options, F.lit(THREADS), F.lit(""), F.lit("")),
        "codec": codec,
        "type": typ,
        "comments": F.col("p_name"),
        "preset": F.lit(PRESET),
        "threads": F.lit(THREADS),
        "ref_name": F.col("p_brand"),
        "ref_type": F.col("l_linestatus"),
        "infile_filename": F.concat(F.lit("clips/o"), F.col("l_orderkey").cast("string"), F.lit(".m2ts")),
        "infile_duration": _d(CLIP_SECONDS),
        "infile_size_kbyte": F.col("p_retailprice") * _d(100),
        "infile_option": F.lit(""),
        "outfile_filename": F.concat(F.lit("t/"), F.concat_ws("_", *[F.col(c).cast("string") for c in KEYS])),
        "outfile_options": options,
        "outfile_hash": F.when(lq < _d(5), F.lit("")).otherwise(tid),
        "outfile_bit_rate_kbs": F.col("l_extendedprice") / _d(15),
        "outfile_duration": _d(CLIP_SECONDS),
        "outfile_size_kbyte": F.col("l_extendedprice"),
        "gop": F.col("p_size").cast("bigint"),
        "has_b_frames": (ln % 6).cast("bigint"),
        "refs": (F.lit(1) + F.col("l_suppkey") % 8).cast("bigint"),
        "fI": frames_i, "fP": frames_p, "fB": frames_b, "fT": total,
        "commandline": F.lit(""),
        "hwaccels": F.lit(""),
        "enc_sec": lq,
        "enc_time": timefmt.hms(lq),
        "enc_fps": total.cast("double") / lq,
        "enc_speed": _d(CLIP_SECONDS) / lq,
        "comp_ratio_persent": _d(1) - F.col("l_discount") * (F.lit(2) + k * ln).cast("double"),
        "probe_sec": probe_sec,
        "probe_time": timefmt.hms(probe_sec),
        "vmaf_sec": vmaf_sec,
        "vmaf_time": timefmt.hms(vmaf_sec),
        "vmaf_version": F.lit(METRIC_VERSION),
        "vmaf_commandline": F.lit(""),
        "ssim_min": _d(1) - F.col("l_tax"),
        "ssim_max": _d(1),
        "ssim_amean": _d(1) - F.col("l_tax") / _d(10),
        "ssim_mean": _d(1) - F.col("l_tax") / _d(5),
        "vmaf_min": _d(60) + lq / _d(2),
        "vmaf_max": _d(100),
        "vmaf_amean": _d(91) + _d(1.5) * ln.cast("double"),
        "vmaf_mean": _d(90) + _d(1.5) * ln.cast("double"),
    }


# ---------------------------------------------------------------------------
# Grid fixtures: every region runs its own sweep (config). Its reference clips
# are its nations; its patterns are the parts its suppliers ship (one pattern
# per part and region), so the grid grows with `lineitem`/`part`.

def references_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("r_name").alias("config"), F.col("n_nationkey").cast("bigint").alias("ref_no"),
                    F.col("n_name").alias("name"),
                    F.when(F.col("n_nationkey") % 2 == 0, F.lit("Anime")).otherwise(F.lit("Nature")).alias("type"),
                    F.concat(F.lit("./videos/source/"), F.col("n_name"), F.lit(".m2ts")).alias("basefile"),
                    F.sha2(F.col("n_name"), 256).alias("basehash")))


def pattern_options(partkey: Column, previous: bool = False) -> Column:
    first = F.concat(F.lit("-crf 23 -tag p"), partkey.cast("string"))
    if previous:
        return F.array(first)
    return F.array(first, F.concat(F.lit("-crf 28 -tag p"), partkey.cast("string")))


def patterns_from_tables(spark: SparkSession, sf_dir: str, previous: bool = False) -> DataFrame:
    """Patterns of each sweep. `previous=True` gives the sweep's earlier
    version (presets medium + veryslow, first option only) whose cells are the
    already-known trials."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    n, r, p = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), table(spark, sf_dir, "part")
    shipped = (li.select("l_partkey", "l_suppkey")
               .join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
               .join(n.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
               .select("l_partkey", "n_regionkey").distinct())
    pk = F.col("p_partkey")
    presets = (F.array(F.lit("medium"), F.lit("veryslow")) if previous else
               F.when(F.col("p_size") > 25, F.array(F.lit("slow"), F.lit("medium")))
               .otherwise(F.array(F.lit("medium"))))
    return (shipped.join(p, F.col("l_partkey") == pk)
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_name").alias("config"), pk.alias("pattern_no"),
                    F.col("p_type").alias("codec"), F.col("p_brand").alias("type"),
                    F.col("p_name").alias("comments"), presets.alias("presets"),
                    F.struct(F.lit("").alias("option")).alias("infile"),
                    F.struct(pattern_options(pk, previous).alias("options")).alias("outfile"),
                    F.lit("").alias("hwaccels")))


# ---------------------------------------------------------------------------
# Side-car log fixtures. Numbers arrive as text, as in the prober's output.

def _bytes_text(x: Column) -> Column:
    return F.round(x).cast("bigint").cast("string")


def stem_of(*cols: str) -> Column:
    return F.concat(F.lit("t/"), F.concat_ws("_", *[F.col(c).cast("string") for c in cols]))


def base_probes_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip probe log per order: `clips/o<key>_ffprobe.json`."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("clips/o"), F.col("o_orderkey").cast("string"), F.lit("_ffprobe.json")).alias("path"),
        F.struct(F.lit("120.0").alias("duration"),
                 _bytes_text(F.col("o_totalprice") * _d(1000)).alias("size"),
                 F.lit("").alias("bit_rate")).alias("format"))


def _as(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def out_probe_columns() -> dict[str, Column]:
    """The fields of an output's probe log as expressions over `lineitem`."""
    return {
        "path": F.concat(stem_of(*KEYS), F.lit("_ffprobe.json")),
        "format": F.struct((_d(CLIP_SECONDS) - F.col("l_discount")).cast("string").alias("duration"),
                           _bytes_text(F.col("l_extendedprice") * _d(1024)).alias("size"),
                           _bytes_text(F.col("l_extendedprice") * _d(1024 * 8) / _d(CLIP_SECONDS)).alias("bit_rate")),
        "streams": F.array(F.struct((F.col("l_linenumber") % 3).cast("bigint").alias("has_b_frames"),
                                    (F.lit(1) + F.col("l_suppkey") % 4).cast("bigint").alias("refs")))}


def out_probes_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_as(out_probe_columns()))


def run_columns(of: dict[str, Column]) -> dict[str, Column]:
    """What the runner reports of each finished output, from the trial's fields."""
    stem = of["outfile_filename"]
    return {"stem": stem, "hash": of["outfile_hash"], "commandline": F.concat(F.lit("enc "), stem), "encode_seconds": of["enc_sec"],
            "probe_seconds": of["probe_sec"], "vmaf_seconds": of["vmaf_sec"], "vmaf_commandline": F.concat(F.lit("vmaf "), stem)}


def runs_from_trials(trials: DataFrame) -> DataFrame:
    """The runner's reports of flat trials."""
    return trials.select(*_as(run_columns({c: F.col(c) for c in TRIAL_COLUMNS})))


def supplier_probe_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probe log per supplier, frames included: a frame per line that the
    supplier ships, every tenth from the first on an I frame."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    shipped = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    pict = lambda i: F.when(i % 10 == 0, F.lit("I")).when(i % 2 == 0, F.lit("P")).otherwise(F.lit("B"))
    frames = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.struct(pict(i).alias("pict_type")))
    none = F.array().cast("array<struct<pict_type:string>>")
    return s.join(shipped, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.col("s_suppkey"),
        F.struct(F.lit("120.0").alias("duration"), _bytes_text(F.abs(F.col("s_acctbal")) * _d(1024)).alias("size"),
                 _bytes_text(F.abs(F.col("s_acctbal"))).alias("bit_rate")).alias("format"),
        F.array(F.struct((F.col("s_suppkey") % 3).cast("bigint").alias("has_b_frames"),
                         (F.lit(1) + F.col("s_suppkey") % 4).cast("bigint").alias("refs"))).alias("streams"),
        F.when(F.col("n") > 0, frames).otherwise(none).alias("frames"))


def metric_log_columns() -> dict[str, Column]:
    """The fields of an output's quality-score log as expressions over `lineitem`."""
    lq, ln = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return {
        "path": F.concat(stem_of(*KEYS), F.lit("_vmaf.json")),
        "version": F.lit(METRIC_VERSION),
        "pooled_metrics": F.struct(
            F.struct((_d(1) - F.col("l_tax")).alias("min"), _d(1).alias("max"),
                     (_d(1) - F.col("l_tax") / _d(10)).alias("mean"),
                     (_d(1) - F.col("l_tax") / _d(5)).alias("harmonic_mean")).alias("float_ssim"),
            F.struct((_d(60) + lq / _d(2)).alias("min"), _d(100).alias("max"),
                     (_d(91) + _d(1.5) * ln).alias("mean"),
                     (_d(90) + _d(1.5) * ln).alias("harmonic_mean")).alias("vmaf"))}


def metric_logs_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_as(metric_log_columns()))


# Event type -> picture type of the frame fixture.
PICT_OF_EVENT = {"signup": "I", "purchase": "P", "view": "B"}
OTHER_PICT = "?"


def frames_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame sequences: one file per user, frames ordered by (ts, event_id).
    Segment jobs chunk them with `operators.frames.time_chunk` on `ts`."""
    e = table(spark, sf_dir, "events")
    pict = F.lit(OTHER_PICT)
    for ev, pt in reversed(list(PICT_OF_EVENT.items())):
        pict = F.when(F.col("event_type") == F.lit(ev), F.lit(pt)).otherwise(pict)
    return e.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("file"),
                    F.col("ts"), F.col("event_id"), pict.alias("pict_type"))


def frame_scores_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("file"),
                    F.col("event_id").alias("frame_no"), F.col("event_type").alias("metric"),
                    F.col("value").alias("score"))


def references_from_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("name"),
                    F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("type"),
                    F.concat(F.lit("refs/"), F.col("s_name"), F.lit(".m2ts")).alias("basefile"),
                    F.sha2(F.col("s_name"), 256).alias("basehash"))


def file_hashes_from_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip files present for suppliers with a positive balance; the file is
    corrupted (other hash) when the balance is under 2000."""
    s = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > _d(0))
    good = F.sha2(F.col("s_name"), 256)
    bad = F.sha2(F.concat(F.col("s_name"), F.lit("#")), 256)
    return s.select(F.concat(F.lit("refs/"), F.col("s_name"), F.lit(".m2ts")).alias("path"),
                    F.when(F.col("s_acctbal") < _d(2000), bad).otherwise(good).alias("sha256"))


def ref_probes_from_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe logs already present for suppliers with a balance over 8000."""
    s = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > _d(8000))
    return s.select(F.concat(F.lit("refs/"), F.col("s_name"), F.lit("_ffprobe.json")).alias("path"))


def default_refs_from_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloadable defaults: suppliers with a balance under 5000."""
    return references_from_suppliers(spark, sf_dir).join(
        table(spark, sf_dir, "supplier").where(F.col("s_acctbal") < _d(5000)).select(F.col("s_name").alias("name")),
        "name", "left_semi")
