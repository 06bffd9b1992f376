"""Running totals that survive a group holding most of the rows.

A window over a whole group runs in one task. Here a group is cut into ordered
buckets: bucket totals come from a map-side aggregate, their prefix sum is a
window over few rows, and only rows of one bucket meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import div
from ..session import hint_small, work_table

BUCKET_ROWS = 1 << 20
RANGE = "_range"
PLACE = "_place"


def rows_before() -> tuple:
    return Window.unboundedPreceding, -1


def rows_to_here() -> tuple:
    return Window.unboundedPreceding, 0


def sequence_bucket(sequence: Column, rows: int = BUCKET_ROWS) -> Column:
    """Bucket of a sequence number that is unique in its group."""
    return div(sequence, rows)


def digits_bucket(sequence: Column, dropped: int = 6) -> Column:
    """Bucket of a sequence number given as text of any length: its length and its leading digits.

    Buckets order as the numbers do, and hold a million of them at most.
    """
    digits = F.ltrim(sequence.cast("string"), F.lit("0"))
    size = F.length(digits)
    return F.concat(F.lpad(size.cast("string"), 4, "0"), F.lit(":"), F.substr(digits, F.lit(1), F.greatest(size - dropped, F.lit(0))))


def digits_order(sequence: Column) -> list[Column]:
    """Columns that order sequence numbers given as text as the numbers do."""
    digits = F.ltrim(sequence.cast("string"), F.lit("0"))
    return [F.length(digits), digits]


def with_running_total(
    df: DataFrame,
    group: list[str],
    bucket: list[str],
    order: list[str],
    value: Column,
    name: str,
    only: DataFrame | None = None,
) -> DataFrame:
    """Add the inclusive running total of ``value`` per ``group`` in ``bucket + order``.

    ``group`` and ``bucket`` columns must not be null. ``order`` has to be total
    inside a bucket. ``only`` (distinct ``group + bucket``) names the buckets
    whose rows are wanted; rows of the others are counted but not moved.
    """
    keys = [*group, *bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    across = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(*rows_before())
    before = totals.select(*keys, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*rows_to_here())
    rows = df if only is None else df.join(hint_small(only), keys, "left_semi")
    return (
        rows.join(before, keys)
        .withColumn(name, F.col("_before") + F.sum(value).over(inside))
        .drop("_before")
    )


def with_previous(df: DataFrame, group: list[str], bucket: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``value`` of the preceding row of each ``group`` in ``bucket + order``; null for the first.

    A bucket's first row takes the last value of the bucket before it.
    """
    keys = [*group, *bucket]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*group).orderBy(*bucket)
    entering = last.select(*keys, F.lag("_last").over(across).alias("_entering"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.join(entering, keys)
        .withColumn("_row", F.row_number().over(inside))
        .withColumn(name, F.when(F.col("_row") == 1, F.col(f"_entering.{value}")).otherwise(F.lag(value).over(inside)))
        .drop("_row", "_entering")
    )


def in_ranges(rows: DataFrame, order: list[str], count: int = 0) -> DataFrame:
    """Rows with the number of the range of ``order`` they lie in, written once so that it stays.

    Rows that are equal in ``order`` share a range, and ranges follow each other. Where the
    ``count`` of the rows is known, ranges hold a quarter of a bucket at most, as far as the
    sample tells.
    """
    return work_table(rows.repartitionByRange(range_count(rows, count), *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def range_count(rows: DataFrame, count: int = 0) -> int:
    """Ranges that ``count`` rows are cut into: as many as shuffles have partitions, or more so that none gets too large."""
    return max(_partitions(rows), count * 4 // BUCKET_ROWS)


def gathered(rows: DataFrame, part: str, parts: int, count: int) -> DataFrame:
    """``count`` rows moved to few tasks by their range, the column ``part`` of ``parts``: a quarter of a bucket each, neighbours together."""
    tasks = min(parts, max(1, count * 4 // BUCKET_ROWS))
    return rows.repartitionById(tasks, div(F.col(part) * tasks, parts).cast("int"))


def in_places(rows: DataFrame, order: list[str], kept: list[str], path: str, count: int = 0) -> DataFrame:
    """The ``kept`` columns of rows cut into ranges of ``order`` and sorted there, with range and place, written to ``path``.

    The rows of a range that are equal in the first columns of ``order`` have places without gaps.
    """
    cut = rows.repartitionByRange(range_count(rows, count), *order).sortWithinPartitions(*order)
    cut = cut.withColumns({RANGE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()}).select(*kept, RANGE, PLACE)
    return _written(cut, path)


def with_number(placed: DataFrame, group: list[str], name: str, facts: DataFrame, path: str) -> DataFrame:
    """Add the number from one of every row of its ``group``, the first columns of the order of :func:`in_places`.

    Columns of ``facts``, a row a group, come with it. Only the rows of ranges and groups are counted,
    which ``path`` keeps: one for each range, and one more for each group. No row is moved or sorted for its number.
    """
    ranges = placed.groupBy(*group, RANGE).agg(F.count("*").alias("_rows"), F.min(PLACE).alias("_first"))
    across = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(*rows_before())
    before = F.coalesce(F.sum("_rows").over(across), F.lit(0))
    shifts = ranges.select(*group, RANGE, (before - F.col("_first") + 1).alias("_shift"))
    numbered = placed.join(_written(shifts.join(facts, group), path), [*group, RANGE])
    return numbered.withColumn(name, F.col(PLACE) + F.col("_shift")).drop(RANGE, PLACE, "_shift")


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
