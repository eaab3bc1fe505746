"""Documented selection procedures (D1-D4) as table jobs over the
per-ref-type report.

Picks per group use `min(struct(...))` aggregates rather than a
`row_number()` window: the aggregate is partial + final, so a group holding a
third of all rows is reduced inside every task before the shuffle instead of
being sorted whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The documented quality floors and the compression band.
VMAF_MIN_FLOOR = 70.0
VMAF_MEAN_FLOOR = 93.0
COMPRESSION_BAND = 0.03

GROUP = ["codec", "type", "ref_type"]
PICK_FIELDS = ["outfile_options", "preset", "threads", "outfile_size_kbyte",
               "comp_ratio_persent", "vmaf_min", "vmaf_mean"]
METRICS = ["outfile_size_kbyte", "outfile_bit_rate_kbs", "comp_ratio_persent",
           "ssim_mean", "vmaf_min", "vmaf_mean"]


def eligible(report: DataFrame, vmin: float = VMAF_MIN_FLOOR, vmean: float = VMAF_MEAN_FLOOR) -> DataFrame:
    return report.where((F.col("vmaf_min") >= F.lit(float(vmin))) & (F.col("vmaf_mean") >= F.lit(float(vmean))))


def threshold_candidates(report: DataFrame, vmin: float = VMAF_MIN_FLOOR,
                         vmean: float = VMAF_MEAN_FLOOR) -> DataFrame:
    """Per (codec, type, ref_type): the smallest file among option sets that
    meet both VMAF floors (ties: option text, preset, threads)."""
    pick = F.min(F.struct(*[F.col(c) for c in ["outfile_size_kbyte", "outfile_options", "preset",
                                              "threads", "comp_ratio_persent", "vmaf_min",
                                              "vmaf_mean"]])).alias("p")
    return (eligible(report, vmin, vmean).groupBy(*GROUP).agg(pick, F.count(F.lit(1)).alias("eligible"))
            .select(*GROUP, *[F.col(f"p.{c}").alias(c) for c in PICK_FIELDS], "eligible"))


def best_candidate(report: DataFrame, band: float = COMPRESSION_BAND, vmin: float = VMAF_MIN_FLOOR,
                   vmean: float = VMAF_MEAN_FLOOR) -> DataFrame:
    """Among eligible option sets of a group, those whose compression is within
    `band` of the group's best compression; of these the highest vmaf_mean
    (ties: smaller file, then option text). The band is taken relative to the
    best compression of the group (the procedure leaves the anchor open)."""
    el = eligible(report, vmin, vmean)
    best = el.groupBy(*GROUP).agg(F.max("comp_ratio_persent").alias("best_comp"))
    near = el.join(best, GROUP).where(F.col("comp_ratio_persent") >= F.col("best_comp") - F.lit(float(band)))
    pick = F.min(F.struct((-F.col("vmaf_mean")).alias("neg_vmaf"), *[F.col(c) for c in [
        "outfile_size_kbyte", "outfile_options", "preset", "threads", "comp_ratio_persent",
        "vmaf_min", "vmaf_mean"]])).alias("p")
    return (near.groupBy(*GROUP).agg(pick, F.first("best_comp").alias("best_comp"),
                                     F.count(F.lit(1)).alias("in_band"))
            .select(*GROUP, *[F.col(f"p.{c}").alias(c) for c in PICK_FIELDS], "best_comp", "in_band"))


def baseline_delta(report: DataFrame, baseline_options: str) -> DataFrame:
    """Each option set against the baseline option set of the same codec,
    type, preset, threads and ref type: metric differences and the size change
    in percent. The baseline side holds one row per group."""
    keys = ["codec", "type", "preset", "threads", "ref_type"]
    base = (report.where(F.col("outfile_options") == F.lit(baseline_options))
            .select(*keys, *[F.col(m).alias(f"base_{m}") for m in METRICS]))
    j = report.where(F.col("outfile_options") != F.lit(baseline_options)).join(base, keys)
    deltas = [(F.col(m) - F.col(f"base_{m}")).alias(f"d_{m}") for m in METRICS]
    pct = (F.lit(100.0) * (F.col("outfile_size_kbyte") / F.col("base_outfile_size_kbyte") - F.lit(1.0))
           ).alias("size_change_pct")
    return j.select(*keys, "outfile_options", F.lit(baseline_options).alias("baseline_options"),
                    *deltas, pct)


def no_effect(deltas: DataFrame, size_pct_eps: float, vmaf_eps: float, ssim_eps: float,
              comp_eps: float) -> DataFrame:
    """Option sets whose every metric equals the baseline within the epsilons
    ("no change" findings)."""
    cond = ((F.abs("size_change_pct") <= F.lit(float(size_pct_eps)))
            & (F.greatest(F.abs("d_vmaf_min"), F.abs("d_vmaf_mean")) <= F.lit(float(vmaf_eps)))
            & (F.abs("d_ssim_mean") <= F.lit(float(ssim_eps)))
            & (F.abs("d_comp_ratio_persent") <= F.lit(float(comp_eps))))
    return deltas.where(cond)
