"""Duration texts (F7, F8), pure column arithmetic: zone-free and codegen'd."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole_seconds(seconds) -> Column:
    # Truncate the fraction (the reference formats whole seconds).
    return F.floor(F.col(seconds) if isinstance(seconds, str) else seconds).cast("bigint")


def _two(x: Column) -> Column:
    """`%02d` of a number that isn't negative, without a formatter."""
    text = x.cast("string")
    return F.when(x < F.lit(10), F.concat(F.lit("0"), text)).otherwise(text)


def format_seconds(seconds) -> Column:
    """`3661` -> `00d, 01h01m01s` (days, hours, minutes, seconds by integer division)."""
    s = _whole_seconds(seconds)
    days, hours = F.floor(s / 86400).cast("bigint"), F.floor((s % 86400) / 3600).cast("bigint")
    minutes, rest = F.floor((s % 3600) / 60).cast("bigint"), (s % 60).cast("bigint")
    plain = F.concat(_two(days), F.lit("d, "), _two(hours), F.lit("h"), _two(minutes), F.lit("m"), _two(rest), F.lit("s"))
    return F.when(s >= F.lit(0), plain).otherwise(F.format_string("%02dd, %02dh%02dm%02ds", days, hours, minutes, rest))


def hms(seconds) -> Column:
    """UTC clock text `HH:MM:SS` of a duration; fraction truncated, wraps at 24 h."""
    s = _whole_seconds(seconds)
    hours, minutes, rest = (F.floor(s / 3600) % 24).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint"), (s % 60).cast("bigint")
    digits = (F.lit(1000000) + hours * 10000 + minutes * 100 + rest).cast("string")  # 1HHMMSS
    plain = F.concat(F.substring(digits, 2, 2), F.lit(":"), F.substring(digits, 4, 2), F.lit(":"), F.substring(digits, 6, 2))
    return F.when(s >= F.lit(0), plain).otherwise(F.format_string("%02d:%02d:%02d", hours, minutes, rest))
