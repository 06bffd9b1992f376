"""Sets of sequence numbers as intervals that grow together as gaps close.

A number of any length is cut into its leading digits (``head``) and its last six, and an
interval never leaves its head. So a group has a million numbers at most, whatever a shard
has delivered, and a shard without gaps takes a row for a million of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import digits_bucket, rows_before, rows_to_here

TAIL_DIGITS = 6
KEYS = ["shard", "head"]


def _number(sequence: Column) -> Column:
    return sequence.rlike(r"^\d+$")


def numbered(records: DataFrame) -> DataFrame:
    """Adds ``head`` and ``tail`` of ``sequence``; other texts are heads of their own."""
    sequence = F.col("sequence").cast("string")
    tail = F.right(F.ltrim(sequence, F.lit("0")), F.lit(TAIL_DIGITS)).try_cast("bigint")
    return records.withColumns({
        "head": F.when(_number(sequence), digits_head(sequence)).otherwise(F.concat(F.lit("text:"), F.coalesce(sequence, F.lit("")))),
        "tail": F.when(_number(sequence), F.coalesce(tail, F.lit(0))).otherwise(F.lit(0)).cast("bigint"),
    })


def digits_head(sequence: Column) -> Column:
    """Leading digits and length. Numbers of up to six digits share a head, as their tails tell them apart."""
    digits = F.ltrim(sequence, F.lit("0"))
    return F.when(F.length(digits) <= TAIL_DIGITS, F.lit("")).otherwise(digits_bucket(sequence, TAIL_DIGITS))


def intervals(rows: DataFrame) -> DataFrame:
    """``shard, head, low, high, first_ms, last_ms``: the fewest intervals with the numbers of ``rows``.

    ``rows``: the same columns; intervals that overlap or touch become one.
    """
    order = Window.partitionBy(*KEYS).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(*rows_before()))
    marked = rows.withColumn("_new", F.when(F.col("low") <= reach + 1, 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(*rows_to_here())))
    return marked.groupBy(*KEYS, "_run").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms")
    ).drop("_run")


def of_records(records: DataFrame) -> DataFrame:
    """The intervals of records (shard, sequence, arrival_ms)."""
    points = numbered(records).select(
        "shard", "head", F.col("tail").alias("low"), F.col("tail").alias("high"),
        F.col("arrival_ms").alias("first_ms"), F.col("arrival_ms").alias("last_ms"),
    )
    return intervals(points)


def unknown(records: DataFrame, known: DataFrame) -> DataFrame:
    """The keys (shard, sequence) of records whose number lies in no interval of ``known``.

    Records and intervals are laid side by side; none is paired with another.
    """
    points = numbered(records.select("shard", "sequence").distinct()).select("shard", "head", "sequence", F.col("tail").alias("low"), F.lit(None).cast("bigint").alias("high"))
    spans = known.select("shard", "head", F.lit(None).cast("string").alias("sequence"), "low", "high")
    # Of equal lows the interval comes first.
    order = Window.partitionBy(*KEYS).orderBy("low", F.col("high").isNull()).rowsBetween(*rows_to_here())
    laid = points.unionByName(spans).withColumn("_reach", F.max("high").over(order))
    return laid.filter(F.col("high").isNull() & ~F.coalesce(F.col("_reach") >= F.col("low"), F.lit(False))).select("shard", "sequence")
