"""Batch clocks, event positions and the manifest of written chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, positions
from ..functions.times import div
from .running import (
    BUCKET_ROWS, digits_bucket, digits_order, rows_before, rows_to_here, sequence_bucket, with_running_total,
)

ROW_VERSION = 2


def first_deliveries(batches: DataFrame) -> DataFrame:
    """A batch delivered again under the same sequence counts once."""
    return batches.dropDuplicates(["shard", "sequence"])


def batch_clock(batches: DataFrame, previous: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Strictly increasing ``clock`` per shard from ``value`` in ``sequence`` order.

    The rule is "the value if it is later than the last clock, else the last
    clock plus one". Over ``n`` batches that is ``max(value_j - j) + i``, and a
    bucket of batches acts on the clock entering it as ``max(clock + n, local)``,
    so buckets combine by a prefix maximum. ``previous`` (shard, clock) carries
    the clock over from an earlier run.
    """
    if dict(batches.dtypes)["sequence"] == "string":
        # A provider's numbers have dozens of digits, more than any number type holds.
        bucket, order = digits_bucket(F.col("sequence")), digits_order(F.col("sequence"))
    else:
        bucket, order = sequence_bucket(F.col("sequence"), bucket_rows), [F.col("sequence")]
    rows = batches.withColumn("_bucket", bucket)
    inside = Window.partitionBy("shard", "_bucket").orderBy(*order)
    to_here = inside.rowsBetween(*rows_to_here())
    rows = rows.withColumn("_i", F.row_number().over(inside).cast("bigint"))
    rows = rows.withColumn("_lead", F.max(F.col("value") - F.col("_i")).over(to_here))

    buckets = rows.groupBy("shard", "_bucket").agg(F.max("_i").alias("_n"), F.max("_lead").alias("_best"))
    across = Window.partitionBy("shard").orderBy("_bucket")
    buckets = buckets.withColumn("_done", F.sum("_n").over(across.rowsBetween(*rows_to_here())) - F.col("_n"))
    # In shard-wide numbering a bucket's best lead is lowered by the rows before it.
    carried = F.max(F.col("_best") - F.col("_done")).over(across.rowsBetween(*rows_before()))
    if previous is not None:
        buckets = buckets.join(previous.select("shard", F.col("clock").alias("_previous")), "shard", "left")
        carried = F.greatest(carried, F.col("_previous"))
    buckets = buckets.select("shard", "_bucket", (carried + F.col("_done")).alias("_entry"))

    clock = F.col("_i") + F.greatest(F.col("_lead"), F.col("_entry"))
    return (
        rows.join(buckets, ["shard", "_bucket"])
        .withColumn("clock", clock)
        .drop("_bucket", "_i", "_lead", "_entry")
    )


def with_counter(
    df: DataFrame, batch: tuple[str, ...] = ("shard", "batch"), bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Zero-based ``counter`` across all queues of a batch, in queue and ``seq`` order.

    ``seq`` has to be unique within a batch and queue.
    """
    bucketed = df.withColumn("_bucket", sequence_bucket(F.col("seq"), bucket_rows))
    numbered = with_running_total(
        bucketed, list(batch), ["queue", "_bucket"], ["seq"], F.lit(1).cast("bigint"), "counter"
    )
    return numbered.withColumn("counter", F.col("counter") - 1).drop("_bucket")


def with_positions(df: DataFrame, batch_ms: str = "arrival_ms", bucket_ms: Column | None = None) -> DataFrame:
    """Position of every counted event; ``bucket_ms`` replaces the time bucket (snapshots)."""
    return df.withColumn("eid", positions.position(F.col(batch_ms), F.col("counter"), bucket_ms))


def special_positions(df: DataFrame, batch_ms: str = "arrival_ms") -> DataFrame:
    """Start and end of live, snapshot and archive rows.

    Snapshot rows take the bucket of ``snapshot_ms``; archive rows keep the
    ``archive_start`` and ``archive_end`` they arrived with.
    """
    archive, snapshot = names.is_archive(F.col("queue")), names.is_snapshot(F.col("queue"))
    bucket_ms = F.when(snapshot, F.col("snapshot_ms")).otherwise(F.col(batch_ms))
    own = positions.position(F.col(batch_ms), F.col("counter"), bucket_ms)
    return df.withColumn("start", F.when(archive, F.col("archive_start")).otherwise(own)).withColumn(
        "end", F.when(archive, F.col("archive_end")).otherwise(own)
    )


def chunk_manifest(
    numbered: DataFrame, chunk_rows: int, batch: tuple[str, ...] = ("shard", "batch"), batch_ms: str = "arrival_ms"
) -> DataFrame:
    """One row per chunk of a batch and queue: first and last position, records, size, expiry.

    Chunks are runs of ``chunk_rows`` counters. The aggregate runs on numbers
    and the positions are built from its few result rows.
    """
    chunks = numbered.groupBy(
        *batch, "queue", div(F.col("counter"), chunk_rows).alias("chunk")
    ).agg(
        F.min("counter").alias("_first"),
        F.max("counter").alias("_last"),
        F.min(batch_ms).alias("_ms"),
        F.min("ttl").alias("ttl"),
        F.count("*").alias("records"),
        F.sum(F.length("payload")).alias("size"),
    )
    return chunks.select(
        *batch,
        "queue",
        "chunk",
        positions.position(F.col("_ms"), F.col("_first")).alias("start"),
        positions.position(F.col("_ms"), F.col("_last")).alias("end"),
        "records",
        "size",
        "ttl",
        F.lit(ROW_VERSION).alias("v"),
    )


def batch_queue_totals(
    df: DataFrame,
    keep: Column,
    batch: tuple[str, ...] = ("shard", "batch"),
    arrival: str = "ms",
) -> DataFrame:
    """Per batch and queue: kept records, their size and the counter range they get.

    Everything about a batch except the events themselves follows from these
    totals, so a catalog refresh needs one map-side aggregate over the scan and
    no numbering of rows. The batch clock is the first arrival of *all* rows.
    """
    totals = df.groupBy(*batch, "queue").agg(
        F.min(arrival).alias("_first_ms"),
        F.count_if(keep).alias("records"),
        F.coalesce(F.sum(F.when(keep, F.length("payload"))), F.lit(0)).alias("chars"),
    )
    whole = Window.partitionBy(*batch)
    ordered = whole.orderBy("queue").rowsBetween(*rows_to_here())
    return (
        totals.withColumn("batch_ms", F.min("_first_ms").over(whole))
        .withColumn("last_counter", F.sum("records").over(ordered) - 1)
        .filter(F.col("records") > 0)
        .drop("_first_ms")
    )
