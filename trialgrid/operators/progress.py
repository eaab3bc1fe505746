"""Run progress.

`progress_eta` replaces a global `lag() OVER (ORDER BY ...)` (one task) by the
dense distributed index, whose ranges hand the lap of their last row on to the
range after them: one shuffle numbers the rows and finds their predecessors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.functions.timefmt import format_seconds
from trialgrid.operators.index import with_index


def completeness(trials: DataFrame) -> DataFrame:
    """Trials with a result hash vs all trials; archiving is allowed only when
    they are equal."""
    done = F.count_if(F.col("outfile_hash") != F.lit(""))
    total = F.count(F.lit(1))
    return trials.agg(done.alias("completed"), total.alias("total"),
                      (done == total).alias("archive_ok"))


def lap_seconds(trials: DataFrame) -> DataFrame:
    return trials.select(
        "id", (F.col("enc_sec") + F.col("probe_sec") + F.col("vmaf_sec")).alias("lap"))


def progress_eta(trials: DataFrame, order: str = "id") -> DataFrame:
    """Per trial in run order: position `i/N`, fraction done, lap = previous
    trial's encode + probe + metric seconds (0 for the first), and
    ETA = lap x (N - index0), with their "DDd, HHhMMmSSs" texts."""
    n = trials.count()
    # The lap breaks ties between trials sharing an order key.
    laps = lap_seconds(trials.withColumnRenamed(order, "id") if order != "id" else trials)
    j = with_index(laps, ["id", "lap"], name="idx", carry="lap")
    lap = F.coalesce(F.col("prev_lap"), F.lit(0.0))
    lap_whole = F.floor(lap).cast("bigint")
    place = F.col("idx") + F.lit(1)
    eta = F.floor(lap * (F.lit(n) - F.col("idx")).cast("double")).cast("bigint")
    return j.select(
        F.col("idx").alias("index"), "id",
        F.concat(F.when(place < F.lit(1000), F.lpad(place.cast("string"), 4, "0")).otherwise(place.cast("string")),
                 F.lit(f"/{n:04d}")).alias("position"),
        ((F.col("idx") + F.lit(1)).cast("double") / F.lit(float(n))).alias("fraction"),
        lap_whole.alias("lap_seconds"), format_seconds(lap_whole).alias("lap_text"),
        eta.alias("eta_seconds"), format_seconds(eta).alias("eta_text"))
