"""Declared schemas. Nothing is inferred: CSV inference turns `preset` into a
number for "6" but text for "medium", and `enc_time` into a timestamp, so
every read passes one of these."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L = T.StringType(), T.DoubleType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


POOLED = _struct(("min", D), ("max", D), ("mean", D), ("harmonic_mean", D))
FRAMES = _struct(("I", L), ("P", L), ("B", L), ("total", L))
STREAM = _struct(("gop", L), ("has_b_frames", L), ("refs", L), ("frames", FRAMES))

# One trial = one encode of one reference clip with one option set.
TRIAL_SCHEMA = _struct(
    ("id", S), ("id_opt", S), ("codec", S), ("type", S), ("comments", S),
    ("preset", S), ("threads", S),
    ("infile", _struct(("name", S), ("type", S), ("filename", S), ("duration", D),
                       ("size_kbyte", D), ("option", S))),
    ("outfile", _struct(("filename", S), ("options", S), ("hash", S), ("bit_rate_kbs", D),
                        ("duration", D), ("size_kbyte", D), ("stream", STREAM))),
    ("commandline", S), ("hwaccels", S),
    ("results", _struct(
        ("encode", _struct(("second", D), ("time", S), ("fps", D), ("speed", D))),
        ("compression_ratio_persent", D),
        ("probe", _struct(("second", D), ("time", S))),
        ("vmaf", _struct(("second", D), ("time", S), ("version", S), ("commandline", S),
                         ("pooled_metrics", _struct(("float_ssim", POOLED), ("vmaf", POOLED))))),
    )),
)

PATTERN_SCHEMA = _struct(
    ("codec", S), ("type", S), ("comments", S), ("presets", T.ArrayType(S)),
    ("infile", _struct(("option", S))),
    ("outfile", _struct(("options", T.ArrayType(S)))),
    ("hwaccels", S),
)

REFERENCE_SCHEMA = _struct(("name", S), ("type", S), ("basefile", S), ("basehash", S))

PROBE_SCHEMA = _struct(
    ("format", _struct(("duration", S), ("size", S), ("bit_rate", S))),
    ("streams", T.ArrayType(_struct(("has_b_frames", L), ("refs", L)))),
    ("frames", T.ArrayType(_struct(("pict_type", S)))),
)

METRIC_SCHEMA = _struct(
    ("version", S),
    ("pooled_metrics", _struct(("float_ssim", POOLED), ("vmaf", POOLED))),
)

FRAME_SCHEMA = _struct(("file", S), ("frame_no", L), ("pict_type", S))
FRAME_SCORE_SCHEMA = _struct(("file", S), ("frame_no", L), ("metric", S), ("score", D))
FILE_HASH_SCHEMA = _struct(("path", S), ("sha256", S))

# Report tables as written to CSV (column order is the reference's).
_FLAT_COLS = [
    ("index", L), ("codec", S), ("type", S), ("preset", S), ("threads", S),
    ("gop", L), ("has_b_frames", L), ("refs", L), ("fI", L), ("fP", L), ("fB", L), ("fT", L),
    ("ref_name", S), ("ref_type", S), ("infile_option", S), ("outfile_filename", S),
    ("outfile_size_kbyte", D), ("outfile_bit_rate_kbs", D), ("outfile_options", S),
    ("enc_sec", D), ("enc_time", S), ("comp_ratio_persent", D), ("enc_speed", D),
    ("ssim_min", D), ("ssim_mean", D), ("vmaf_min", D), ("vmaf_mean", D),
]
FLAT_REPORT_SCHEMA = _struct(*_FLAT_COLS)
_TYPE_COLS = [c for c in _FLAT_COLS
              if c[0] not in ("ref_name", "infile_option", "outfile_filename", "enc_time")]
TYPE_REPORT_SCHEMA = _struct(*_TYPE_COLS)
OPTION_REPORT_SCHEMA = _struct(*[c for c in _TYPE_COLS if c[0] != "ref_type"])


# The flat trial table every operator works on: one column per leaf of
# TRIAL_SCHEMA (output name -> nested path). Nested records are flattened once
# at the source, which lets Parquet nested-column pruning read only the leaves
# a job uses; building nested structs first would defeat pruning.
TRIAL_FIELDS = [
    ("id", "id"), ("id_opt", "id_opt"), ("codec", "codec"), ("type", "type"),
    ("comments", "comments"), ("preset", "preset"), ("threads", "threads"),
    ("ref_name", "infile.name"), ("ref_type", "infile.type"), ("infile_filename", "infile.filename"),
    ("infile_duration", "infile.duration"), ("infile_size_kbyte", "infile.size_kbyte"),
    ("infile_option", "infile.option"),
    ("outfile_filename", "outfile.filename"), ("outfile_options", "outfile.options"),
    ("outfile_hash", "outfile.hash"), ("outfile_bit_rate_kbs", "outfile.bit_rate_kbs"),
    ("outfile_duration", "outfile.duration"), ("outfile_size_kbyte", "outfile.size_kbyte"),
    ("gop", "outfile.stream.gop"), ("has_b_frames", "outfile.stream.has_b_frames"),
    ("refs", "outfile.stream.refs"), ("fI", "outfile.stream.frames.I"),
    ("fP", "outfile.stream.frames.P"), ("fB", "outfile.stream.frames.B"),
    ("fT", "outfile.stream.frames.total"),
    ("commandline", "commandline"), ("hwaccels", "hwaccels"),
    ("enc_sec", "results.encode.second"), ("enc_time", "results.encode.time"),
    ("enc_fps", "results.encode.fps"), ("enc_speed", "results.encode.speed"),
    ("comp_ratio_persent", "results.compression_ratio_persent"),
    ("probe_sec", "results.probe.second"), ("probe_time", "results.probe.time"),
    ("vmaf_sec", "results.vmaf.second"), ("vmaf_time", "results.vmaf.time"),
    ("vmaf_version", "results.vmaf.version"), ("vmaf_commandline", "results.vmaf.commandline"),
    ("ssim_min", "results.vmaf.pooled_metrics.float_ssim.min"),
    ("ssim_max", "results.vmaf.pooled_metrics.float_ssim.max"),
    ("ssim_amean", "results.vmaf.pooled_metrics.float_ssim.mean"),
    ("ssim_mean", "results.vmaf.pooled_metrics.float_ssim.harmonic_mean"),
    ("vmaf_min", "results.vmaf.pooled_metrics.vmaf.min"),
    ("vmaf_max", "results.vmaf.pooled_metrics.vmaf.max"),
    ("vmaf_amean", "results.vmaf.pooled_metrics.vmaf.mean"),
    ("vmaf_mean", "results.vmaf.pooled_metrics.vmaf.harmonic_mean"),
]
TRIAL_COLUMNS = [n for n, _ in TRIAL_FIELDS]
