"""Chart feed.

The reference loads the whole data file, filters by codec and groups it in
pandas. Here each step is a DataFrame operator; the grouping is a partial +
final hash aggregation and only the grouped feed (one row per group) is meant
to leave the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.functions.metrics import exact_avg
from trialgrid.operators.index import with_index

# The chart's projection (output name -> flat trial column);
# size and rate are divided by 1000 again.
CHART_FIELDS = [
    ("codec", "codec"), ("type", "type"), ("preset", "preset"), ("threads", "threads"),
    ("ref_name", "ref_name"), ("ref_type", "ref_type"), ("infile_option", "infile_option"),
    ("outfile_filename", "outfile_filename"),
    ("outfile_size_kbyte", None), ("outfile_bit_rate_kbs", None),
    ("outfile_options", "outfile_options"),
    ("stream_gop", "gop"), ("stream_has_b_frames", "has_b_frames"),
    ("stream_refs", "refs"), ("stream_frames_i", "fI"),
    ("stream_frames_p", "fP"), ("stream_frames_b", "fB"),
    ("enc_sec", "enc_sec"), ("enc_time", "enc_time"),
    ("comp_ratio_persent", "comp_ratio_persent"), ("enc_speed", "enc_speed"),
    ("ssim_min", "ssim_min"), ("ssim_mean", "ssim_mean"),
    ("vmaf_min", "vmaf_min"), ("vmaf_mean", "vmaf_mean"),
]
# The group-by choices the chart offers, and its initial selection.
GROUP_KEYS = ["codec", "type", "preset", "threads", "ref_name", "ref_type",
              "infile_option", "outfile_options"]
INITIAL_GROUPS = ["codec", "type", "preset", "threads", "ref_type", "outfile_options"]
MEAN_SERIES = ["outfile_bit_rate_kbs", "outfile_size_kbyte", "vmaf_mean", "vmaf_min",
               "stream_gop", "stream_has_b_frames", "stream_refs"]
MAX_SERIES = ["stream_frames_i", "stream_frames_p", "stream_frames_b"]
FEED_COLUMNS = ["group", *MEAN_SERIES, *MAX_SERIES]
# Stack order of the frame bars (bottom to top) and their labels.
FRAME_STACK = [("stream_frames_b", "B-Frame"), ("stream_frames_p", "P-Frame"),
               ("stream_frames_i", "I-Frame")]
AXIS_HEADROOM = 1.1
MIN_WINDOW = 10


def _chart_col(name, src):
    if name == "outfile_size_kbyte":
        return (F.col("outfile_size_kbyte") / F.lit(1000.0)).alias(name)
    if name == "outfile_bit_rate_kbs":
        return (F.col("outfile_bit_rate_kbs") / F.lit(1000.0)).alias(name)
    return F.col(src).alias(name)


def chart_columns() -> list:
    """The chart projection as expressions over the flat trial table."""
    return [_chart_col(n, s) for n, s in CHART_FIELDS]


def chart_rows(trials: DataFrame, order: list[str] | str = "id", index: bool = True) -> DataFrame:
    """26-column chart projection; size and rate divided by 1000 again (the
    names are kept, the unit becomes MiB-ish / Mibit/s as in the reference)."""
    cols = chart_columns()
    if not index:
        return trials.select(*cols)
    order = [order] if isinstance(order, str) else list(order)
    keys = [f"_tg_o{i}" for i in range(len(order))]
    return with_index(trials.select(*[F.col(c).alias(k) for c, k in zip(order, keys)], *cols), keys).drop(*keys)


def codec_filter(rows: DataFrame, codecs: list[str] | None) -> DataFrame:
    """Keep the selected codecs; an empty selection means no filter."""
    return rows.where(F.col("codec").isin(list(codecs))) if codecs else rows


def codec_domain(rows: DataFrame) -> DataFrame:
    """Sorted distinct codecs (the filter's options and default selection)."""
    return rows.select("codec").where(F.col("codec").isNotNull()).distinct().orderBy("codec")


def chart_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Group by any subset of GROUP_KEYS: mean of 7 series (NULLs skipped),
    max of the frame counts, a `group` label (keys joined with `_`). Rows with
    a NULL key are dropped and the output is sorted by the keys."""
    if not by:
        raise ValueError("chart_groups needs at least one group key")
    bad = [k for k in by if k not in GROUP_KEYS]
    if bad:
        raise ValueError(f"not a chart group key: {bad}")
    kept = rows.dropna(subset=list(by))
    g = kept.groupBy(*by).agg(*[exact_avg(F.col(c)).alias(c) for c in MEAN_SERIES],
                              *[F.max(c).alias(c) for c in MAX_SERIES])
    label = F.concat_ws("_", *[F.col(k).cast("string") for k in by]).alias("group")
    return g.select(*by, *MEAN_SERIES, *MAX_SERIES, label).orderBy(*by)


def chart_feed(groups: DataFrame) -> DataFrame:
    """The 11 series handed to the charts."""
    return groups.select(*FEED_COLUMNS)


def frame_stack(groups: DataFrame) -> DataFrame:
    """Long form of the stacked frame bars: (group, layer, frame_type, frames)."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("layer"), F.lit(label).alias("frame_type"),
                 F.col(c).cast("bigint").alias("frames"))
        for i, (c, label) in enumerate(FRAME_STACK)]))
    return groups.select("group", stacked.alias("s")).select("group", "s.*")


def chart_factors(groups: DataFrame) -> DataFrame:
    """Sorted unique group labels (the x axis)."""
    return groups.select("group").distinct().orderBy("group")


def chart_axes(groups: DataFrame, refreshed: bool = True) -> DataFrame:
    """One row: the bit-rate axis end (max x 1.1; 1 when there are no groups,
    times 1.1 only on refresh) and the initial x window max(10, n - 1)."""
    top = F.max("outfile_bit_rate_kbs")
    empty_end = F.lit(AXIS_HEADROOM) if refreshed else F.lit(1.0)
    return groups.agg(
        F.when(top.isNull(), empty_end).otherwise(top * F.lit(AXIS_HEADROOM)).alias("axis_max"),
        F.greatest(F.lit(MIN_WINDOW).cast("bigint"), F.count(F.lit(1)) - 1).alias("initial_window"),
        F.count(F.lit(1)).alias("n_groups"),
    )
