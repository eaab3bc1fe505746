"""Summaries over the per-ref-type report.

Both summaries average *group means* of the per-ref-type report, so every
ref type weighs the same whatever its trial count; the quality gate runs on
report rows *before* grouping, so a summary row may average only the ref
types that passed. Never rewrite them as one GROUP BY over raw trials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.functions.metrics import exact_avg, score, sql_round, text

# The quality gate (inclusive bounds) and the top-k of the
# per-ref summary.
GATE_COMP_MIN = 0.60
GATE_SSIM_MIN = 0.99
GATE_VMAF_MIN = 93.00
GATE_VMAF_MAX = 100.00
SUMMARY_BY_REF_LIMIT = 8

SUMMARY_AVGS = ["outfile_size_kbyte", "outfile_bit_rate_kbs", "enc_sec", "comp_ratio_persent",
                "ssim_mean", "vmaf_min", "vmaf_mean"]
FRAME_MIX = "I/P/B frames"


def gate_condition(comp: float = GATE_COMP_MIN, ssim: float = GATE_SSIM_MIN,
                   vmaf_lo: float = GATE_VMAF_MIN, vmaf_hi: float = GATE_VMAF_MAX,
                   comp_col="comp_ratio_persent", ssim_col="ssim_mean", vmaf_col="vmaf_mean"):
    return ((F.col(comp_col) >= F.lit(float(comp))) & (F.col(ssim_col) >= F.lit(float(ssim)))
            & (F.col(vmaf_col) >= F.lit(float(vmaf_lo))) & (F.col(vmaf_col) <= F.lit(float(vmaf_hi))))


def quality_gate(report: DataFrame, comp: float = GATE_COMP_MIN, ssim: float = GATE_SSIM_MIN,
                 vmaf_lo: float = GATE_VMAF_MIN, vmaf_hi: float = GATE_VMAF_MAX) -> DataFrame:
    """Rows of a report passing all four inclusive bounds."""
    return report.where(gate_condition(comp, ssim, vmaf_lo, vmaf_hi))


def _r3(c):
    return sql_round(c, 3)


def summary_by_ref(report_by_type: DataFrame, limit: int = SUMMARY_BY_REF_LIMIT) -> DataFrame:
    """Per (ref_type, outfile_options): rounded means; top `limit` by option
    text descending (ref_type breaks ties). No gate."""
    g = report_by_type.groupBy("ref_type", "outfile_options").agg(
        *[_r3(exact_avg(F.col(c))).alias(c) for c in SUMMARY_AVGS])
    return (g.select("ref_type", *SUMMARY_AVGS, "outfile_options")
            .orderBy(F.col("outfile_options").desc_nulls_last(), F.col("ref_type").asc_nulls_last())
            .limit(limit))


def summary_by_codec(report_by_type: DataFrame, gated: bool = True, **gate) -> DataFrame:
    """Gate, then per (codec, outfile_options): rounded means, score `pt`,
    gop, `bf` (avg has_b_frames + 1 when above 1, else 0), refs and the frame
    mix text; ordered by `pt` descending (best score last)."""
    src = quality_gate(report_by_type, **gate) if gated else report_by_type
    avg_b = F.avg("has_b_frames")
    g = src.groupBy("codec", "outfile_options").agg(
        *[_r3(exact_avg(F.col(c))).alias(c) for c in SUMMARY_AVGS],
        _r3(exact_avg(score(F.col("vmaf_min"), F.col("vmaf_mean"), F.col("ssim_mean"),
                            F.col("comp_ratio_persent")))).alias("pt"),
        _r3(F.avg("gop")).alias("gop"),
        F.when(avg_b > F.lit(1.0), _r3(avg_b + F.lit(1.0))).otherwise(F.lit(0.0)).alias("bf"),
        _r3(F.avg("refs")).alias("refs"),
        F.concat(text(_r3(F.avg("fI"))), F.lit(" / "), text(_r3(F.avg("fP"))), F.lit(" / "),
                 text(_r3(F.avg("fB")))).alias(FRAME_MIX),
    )
    return (g.select("codec", *SUMMARY_AVGS, "pt", "gop", "bf", "refs", FRAME_MIX, "outfile_options")
            .orderBy(F.col("pt").desc_nulls_last(), F.col("codec").asc_nulls_last(),
                     F.col("outfile_options").asc_nulls_last()))


def avg_of_avg(trials: DataFrame, report_by_type: DataFrame) -> DataFrame:
    """The two-level contract made visible: per (codec, outfile_options) the
    gated mean of ref-type means (what the summary reports) next to the gated
    plain mean over trials, and how many ref types passed the gate."""
    two = (quality_gate(report_by_type).groupBy("codec", "outfile_options")
           .agg(_r3(exact_avg(F.col("outfile_size_kbyte"))).alias("two_level_size_kbyte"),
                F.count(F.lit(1)).alias("ref_types_passed")))
    raw = (trials.where(gate_condition())
        .groupBy("codec", "outfile_options")
        .agg(_r3(exact_avg(F.col("outfile_size_kbyte"))).alias("one_level_size_kbyte"),
             F.count(F.lit(1)).alias("trials_passed")))
    return two.join(raw, ["codec", "outfile_options"], "full_outer")


def show_summary(df: DataFrame, page: int = 1000) -> int:
    """Console table (S10): every row, a page at a time; returns how many.

    The best option sets stand last, so nothing is cut off. Rows come from
    `toLocalIterator`, one partition at a time."""
    shown, rows = 0, []

    def put() -> None:
        cells = [["" if v is None else str(v) for v in r] for r in rows]
        widths = [max(map(len, column)) for column in zip(df.columns, *cells)]
        for line in ([df.columns] if not shown else []) + cells:
            print(" | ".join(v.ljust(w) for v, w in zip(line, widths)).rstrip())

    for row in df.toLocalIterator():
        rows.append(row)
        if len(rows) == page:
            put()
            shown, rows = shown + len(rows), []
    if rows or not shown:
        put()
    return shown + len(rows)
