"""Dense 0-based row index under a total order (W1), without a one-task window.

`row_number() OVER (ORDER BY k)` puts every row into one task. Instead:
1. a mergeable quantile sketch (KLL) of the first order column gives splitters
   that cut the rows into ranges of about equal size; they are frozen as
   literals, so a row's range is a pure function of the row;
2. exact counts per range (a partial aggregate, one row per range) are
   prefix-summed into offsets;
3. rows are numbered inside their range (one shuffle by range);
   index = offset of the range + position inside it.
Nothing is written in between, and a lost executor's rows get the same labels
when they are computed again. Numbers, dates and timestamps go into the sketch
as they are. A text goes in as the number that its bytes spell after the
prefix all values share, so any text order is cut evenly, hashed ids or
`id1, id2, ..`. Rows that tie in the first column (up to seven bytes after the
shared prefix) lie in one range.

Ties in the whole order get an arbitrary position; pass a total order for
reproducible labels.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialgrid.session import written

SKETCH_K = 2048
ROWS_PER_RANGE = 1 << 18
MOST_RANGES = 4096
PREFIX_BYTES = 7


def _order(names: list[str], nulls_last: bool) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_last() if nulls_last else F.col(f"`{c}`").asc_nulls_first() for c in names]


def _text_number(c: Column, shared: int) -> Column:
    digits = F.hex(F.substring(F.encode(c, "UTF-8"), shared + 1, PREFIX_BYTES))
    return F.conv(F.rpad(digits, 2 * PREFIX_BYTES, "0"), 16, 10).cast("double")


def _shared(low: str | None, high: str | None) -> int:
    """Bytes that all texts from `low` to `high` begin with."""
    return len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))


def _as_number(df: DataFrame, name: str) -> Column:
    """A number that never falls as the column rises."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        low, high = df.agg(F.min(c), F.max(c)).first()
        return _text_number(c, _shared(low, high))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    raise TypeError(f"can't order by {name}: {kind.simpleString()}")


def _sketch(number: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(number, SKETCH_K).alias("sketch")]


def _quantiles(spark: SparkSession, sketch: Row) -> list[float]:
    if not sketch["n"] or sketch["sketch"] is None:
        return []
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = min(MOST_RANGES, max(least, -(-sketch["n"] // ROWS_PER_RANGE)))
    one = spark.createDataFrame([(sketch["sketch"],)], "sketch binary")
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)]) if pieces > 1 else None
    if shares is None:
        return []
    return sorted(set(one.select(F.kll_sketch_get_quantile_double("sketch", shares)).first()[0]))


def _splitters(df: DataFrame, number: Column) -> list[float]:
    """Values that cut the rows into ranges of about equal size."""
    return _quantiles(df.sparkSession, df.agg(*_sketch(number)).first())


def _number_and_splitters(df: DataFrame, name: str) -> tuple[Column, list[float]]:
    """The column's number and its splitters. Texts are read once, for prefix
    and sketch, and once more only if they share a prefix."""
    if isinstance(df.schema[name].dataType, T.StringType):
        c = F.col(f"`{name}`")
        number = _text_number(c, 0)
        found = df.agg(*_sketch(number), F.min(c).alias("low"), F.max(c).alias("high")).first()
        shared = _shared(found["low"], found["high"])
        if not shared:
            return number, _quantiles(df.sparkSession, found)
        number = _text_number(c, shared)
    else:
        number = _as_number(df, name)
    return number, _splitters(df, number)


def _range_of(number: Column, splitters: list[float], nulls_last: bool) -> Column:
    """How many splitters are at most `number`: a search tree of literals."""
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(number < F.lit(splitters[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    at_null = F.lit(len(splitters) if nulls_last else 0)
    return F.when(number.isNull(), at_null).otherwise(search(0, len(splitters)))


RANGE = "_range"


def with_ranges(df: DataFrame, by: str, nulls_last: bool = False) -> tuple[DataFrame, int]:
    """`df` with the number of the range of `by` that a row lies in, as the last column, and how many ranges there are."""
    number, splitters = _number_and_splitters(df, by)
    # a column of its own: the search tree names it once per level, and it isn't cheap
    ranged = df.withColumn("_number", number).withColumn(RANGE, _range_of(F.col("_number"), splitters, nulls_last)).drop("_number")
    return ranged, len(splitters) + 1


def with_index(df: DataFrame, order: list[str], name: str = "index", nulls_last: bool = False, carry: str | None = None) -> DataFrame:
    """`df` with a dense 0-based `name` under ascending `order` (column names)
    as its first column. With `carry`, `prev_<carry>` holds that column of the
    row before (null for the first): inside a range by a window, for a range's
    first row from the last row of the range before it, one row per range."""
    ranged, _ = with_ranges(df, order[0], nulls_last)
    return numbered(ranged, ranged, order, name, nulls_last, carry)


def numbered(rows: DataFrame, ranged: DataFrame, order: list[str], name: str = "index", nulls_last: bool = False, carry: str | None = None) -> DataFrame:
    """`with_index` for the `rows` of whole ranges of a table `ranged` that has its ranges already."""
    keys = _order(order, nulls_last)
    inside = Window.partitionBy(RANGE).orderBy(*keys)
    facts = [F.count(F.lit(1)).alias("_n")]
    placed = rows.withColumn("_at", F.row_number().over(inside))
    if carry:
        placed = placed.withColumn("_lag", F.lag(F.col(carry)).over(inside))
        # the range's last row: what sorts last under `order`
        rank = F.struct(*[p for c in order for p in ((F.col(f"`{c}`").isNull() == F.lit(nulls_last)).alias(f"n_{c}"), F.col(f"`{c}`").alias(f"v_{c}"))])
        facts.append(F.max_by(F.struct(F.col(carry).alias("v")), rank).alias("_last"))
    per_range = ranged.groupBy(RANGE).agg(*facts)  # one row per range, MOST_RANGES at most
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offset = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if carry:
        offset.append(F.lag("_last").over(Window.orderBy(RANGE)).getField("v").alias("_carried"))
    joined = placed.join(F.broadcast(per_range.select(RANGE, *offset)), RANGE)
    out = joined.withColumn(name, (F.col("_off") + F.col("_at") - 1).cast("bigint"))
    if carry:
        out = out.withColumn(f"prev_{carry}", F.when(F.col("_at") == 1, F.col("_carried")).otherwise(F.col("_lag")))
    wanted = [c for c in rows.columns if c not in (name, RANGE)]
    return out.select(name, *[f"`{c}`" for c in wanted], *([f"prev_{carry}"] if carry else []))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a fresh folder under the shared checkpoint folder and
    read it back: a lineage cut that survives lost executors."""
    return written(df, name, compression="zstd", tidy=True)
