"""Per-trial derived metrics (F1, F14, F15) and summary expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def kib(text_bytes: Column) -> Column:
    """`int(size) / 1024` of a byte count that arrives as text (ANSI cast: bad text fails)."""
    return text_bytes.cast("bigint").cast("double") / F.lit(1024.0)


def as_double(text: Column) -> Column:
    return text.cast("double")


def ratio(num: Column, den: Column, safe: bool = False) -> Column:
    """num / den; a zero divisor fails like the reference unless `safe`
    (then NULL, via try_divide)."""
    return F.try_divide(num, den) if safe else num / den


def fps(total_frames: Column, encode_seconds: Column, safe: bool = False) -> Column:
    return ratio(total_frames.cast("double"), encode_seconds, safe)


def speed(out_duration: Column, encode_seconds: Column, safe: bool = False) -> Column:
    return ratio(out_duration, encode_seconds, safe)


def compression(out_size_bytes: Column, base_size_bytes: Column, safe: bool = False) -> Column:
    """1 - output size / input size: a fraction, negative when the output grew."""
    return F.lit(1.0) - ratio(out_size_bytes.cast("double"), base_size_bytes.cast("double"), safe)


def score(vmaf_min: Column, vmaf_mean: Column, ssim_mean: Column, comp: Column) -> Column:
    """Quality-size score `pt` of one row; lower is better quality."""
    return (F.lit(200.0) - (vmaf_min + vmaf_mean)) + (F.lit(2.0) - (ssim_mean + comp))


def text(x: Column) -> Column:
    """Number as text for concatenation, in plain digits at any size (a double's
    own text turns to powers of ten from 1e7 up and below 1e-3): at least one
    and at most three decimals, as after ROUND(x, 3). NULL becomes '' (SQL
    CONCAT skips NULL)."""
    plain = F.regexp_replace(x.cast("decimal(38,3)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.coalesce(plain, F.lit(""))


def sql_round(x: Column, digits: int) -> Column:
    """ROUND(x, digits): half away from zero on the decimal text of the double."""
    return F.round(x, digits)


_PART = 1 << 26
#: Whole parts below this leave room for 78 bits of fraction in 38 digits.
_ROOM = 300_000_000_000_000


def exact_sum(x: Column) -> Column:
    """Aggregate: the sum of doubles, the same in every order of the rows and
    with every partitioning. A finite value is split into its whole part and
    three times 26 bits of its fraction (towards zero, so that what is left is
    exact); these are added as whole numbers, and the result is rounded once.
    (From 3e14 on, the sum of whole parts leaves 52 bits for fractions.) With a
    NaN, an infinite value or one from 2^53 up it is the plain sum."""
    x = x.cast("double")
    fits = F.abs(x) < F.lit(float(1 << 53))  # false for NaN, which is larger than any number
    parts, rest = [], x
    for _ in range(4):
        cut = rest.cast("bigint")
        parts.append(F.sum(F.when(fits, cut)))
        rest = (rest - cut) * F.lit(float(_PART))
    whole, high, low, lowest = parts
    unit = lambda k: F.lit(Decimal(_PART ** k)).cast(f"decimal({len(str(_PART ** k))},0)")
    of = lambda part, digits: part.cast(f"decimal({digits},0)")
    fine = of(whole, 15) * unit(3) + of(high, 20) * unit(2) + of(low, 20) * unit(1) + of(lowest, 20)
    coarse = of(whole, 20) * unit(2) + of(high, 20) * unit(1) + of(low, 20)
    return (F.when(F.count_if(~fits) > 0, F.sum(x)).when(F.abs(whole) < F.lit(_ROOM), fine.cast("double") / F.lit(float(_PART ** 3)))
            .otherwise(coarse.cast("double") / F.lit(float(_PART ** 2))))


def exact_avg(x: Column) -> Column:
    """Aggregate: the mean of doubles, from `exact_sum`."""
    return F.try_divide(exact_sum(x), F.count(x).cast("double"))
