"""Flat and grouped reports (P1, A1, A2) over trials.

The flat report is a pure projection. The grouped reports take MAX of the
stream facts and AVG of sizes, rates, seconds and scores; Spark plans them as
partial (map-side) + final hash aggregation, so a hot group is pre-aggregated
in every task before the shuffle and never lands whole in one task.
`ssim_mean` / `vmaf_mean` are the *harmonic* means of the pooled scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.functions.metrics import exact_avg
from trialgrid.operators.index import materialize, with_index

# Flat report columns (reference order); names are columns of the flat trial
# table. `ssim_mean` / `vmaf_mean` hold the harmonic means.
FLAT_COLUMNS = ["codec", "type", "preset", "threads", "gop", "has_b_frames", "refs",
                "fI", "fP", "fB", "fT", "ref_name", "ref_type", "infile_option", "outfile_filename",
                "outfile_size_kbyte", "outfile_bit_rate_kbs", "outfile_options", "enc_sec", "enc_time",
                "comp_ratio_persent", "enc_speed", "ssim_min", "ssim_mean", "vmaf_min", "vmaf_mean"]

MAX_COLS = ["gop", "has_b_frames", "refs", "fI", "fP", "fB", "fT"]
AVG_COLS = ["outfile_size_kbyte", "outfile_bit_rate_kbs", "enc_sec", "comp_ratio_persent",
            "enc_speed", "ssim_min", "ssim_mean", "vmaf_min", "vmaf_mean"]
TYPE_KEYS = ["codec", "type", "preset", "threads", "ref_type", "outfile_options"]
OPTION_KEYS = ["codec", "type", "preset", "threads", "outfile_options"]

# Output column order of the grouped reports (reference order).
TYPE_COLUMNS = ["index", "codec", "type", "preset", "threads", *MAX_COLS, "ref_type",
                "outfile_size_kbyte", "outfile_bit_rate_kbs", "outfile_options",
                "enc_sec", "comp_ratio_persent", "enc_speed",
                "ssim_min", "ssim_mean", "vmaf_min", "vmaf_mean"]
OPTION_COLUMNS = [c for c in TYPE_COLUMNS if c != "ref_type"]


def report_rows(trials: DataFrame) -> DataFrame:
    """26-column flat projection of trials, without the index."""
    return trials.select(*FLAT_COLUMNS)


def ordered_rows(trials: DataFrame, order: list[str] | str = "id") -> tuple[DataFrame, list[str]]:
    """The flat projection, beside it the order columns that it hasn't, and the names of all order columns."""
    order = [order] if isinstance(order, str) else list(order)
    keys = [c if c in FLAT_COLUMNS else f"_tg_o{i}" for i, c in enumerate(order)]
    return trials.select(*[F.col(c).alias(k) for c, k in zip(order, keys) if c != k], *FLAT_COLUMNS), keys


def flat_report(trials: DataFrame, order: list[str] | str = "id") -> DataFrame:
    """Flat report with a dense `index` in trial order (`order` columns of the
    trial table; give a total order for reproducible labels)."""
    rows, keys = ordered_rows(trials, order)
    return with_index(rows, keys).select("index", *FLAT_COLUMNS)


def _grouped(trials: DataFrame, keys: list[str]) -> DataFrame:
    aggs = [F.max(c).alias(c) for c in MAX_COLS] + [exact_avg(F.col(c)).alias(c) for c in AVG_COLS]
    return trials.groupBy(*keys).agg(*aggs)


def numbered_groups(groups: DataFrame, kind: str) -> DataFrame:
    """A grouped report (kind "type" or "option") with its index, in key order.
    The groups are written once: they are few, and their aggregation is not."""
    keys, cols = (TYPE_KEYS, TYPE_COLUMNS) if kind == "type" else (OPTION_KEYS, OPTION_COLUMNS)
    return with_index(materialize(groups, "groups"), keys, nulls_last=True).select(*cols)


def report_by_type(trials: DataFrame, index: bool = True) -> DataFrame:
    """Per (codec, type, preset, threads, ref_type, outfile_options)."""
    g = _grouped(trials, TYPE_KEYS)
    if not index:
        return g.select(*[c for c in TYPE_COLUMNS if c != "index"])
    return numbered_groups(g, "type")


def report_by_option(trials: DataFrame, index: bool = True) -> DataFrame:
    """Per (codec, type, preset, threads, outfile_options): a mean over trials,
    not over ref types."""
    g = _grouped(trials, OPTION_KEYS)
    if not index:
        return g.select(*[c for c in OPTION_COLUMNS if c != "index"])
    return numbered_groups(g, "option")
