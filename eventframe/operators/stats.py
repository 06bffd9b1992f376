"""Aggregates over numbered events: queue marks, producers, sizes, subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, positions

ROW_VERSION = 2


def high_water_of_totals(totals: DataFrame) -> DataFrame:
    """Last position, records and size per queue from batch totals."""
    marks = totals.groupBy("queue").agg(
        F.max(positions.key(F.col("batch_ms"), F.col("last_counter"))).alias("_key"),
        F.sum("records").alias("records"),
        F.sum("chars").alias("chars"),
    )
    return marks.select("queue", positions.from_key(F.col("_key")).alias("max_eid"), "records", "chars")


def high_water(numbered: DataFrame, batch_ms: str = "arrival_ms", now_ms: int | None = None) -> DataFrame:
    """Queue-state rows of a batch of numbered events: last position, time, row version."""
    marks = numbered.groupBy("queue").agg(
        F.max(positions.key(F.col(batch_ms), F.col("counter"))).alias("_key"),
        F.max(batch_ms).alias("_ms"),
    )
    return marks.select(
        "queue",
        positions.from_key(F.col("_key")).alias("max_eid"),
        (F.col("_ms") if now_ms is None else F.lit(now_ms).cast("bigint")).alias("timestamp"),
        F.lit(ROW_VERSION).alias("v"),
    )


def archive_ends(special: DataFrame) -> DataFrame:
    """Last archived position of every live queue.

    Archive chunks are few, so ordering them by a text aggregate is cheap here.
    """
    return (
        special.filter(names.is_archive(F.col("queue")))
        .groupBy(names.parent_of(F.col("queue")).alias("queue"))
        .agg(F.max_by("end", "seq").alias("archive_end"))
    )


def snapshot_markers(commands: DataFrame) -> DataFrame:
    """Start bucket and continuation bucket of the last registered snapshot."""
    last = commands.groupBy(names.canonical(F.col("event")).alias("queue")).agg(
        F.max_by("start_ms", "seq").alias("_start"), F.max_by("next_ms", "seq").alias("_next")
    )
    return last.select(
        "queue",
        F.concat(F.lit("_snapshot/"), positions.bucket(F.col("_start"))).alias("snapshot_start"),
        positions.bucket(F.col("_next")).alias("snapshot_next"),
    )


def _lane(rows: DataFrame) -> Column | None:
    return F.col("lane") if "lane" in rows.columns else None


def producer_stats(numbered: DataFrame, batch: tuple[str, ...] = ("shard", "batch")) -> DataFrame:
    """Per batch, bot and queue: events written and the last event's times and counter."""
    return numbered.groupBy(*batch, "id", "queue").agg(
        F.count("*").alias("units"),
        F.max_by("source_ms", "counter").alias("start"),
        F.max_by("write_ms", "counter").alias("end"),
        F.max("counter").alias("checkpoint"),
        F.min("arrival_ms").alias("batch_ms"),
    )


def write_checkpoints(stats: DataFrame) -> DataFrame:
    """Write-checkpoint rows of producer statistics."""
    batch_columns = [c for c in ("shard", "batch") if c in stats.columns]
    return stats.select(
        *batch_columns,
        "id",
        "queue",
        positions.position(F.col("batch_ms"), F.col("checkpoint"), lane=_lane(stats)).alias("checkpoint"),
        F.col("start").alias("source_timestamp"),
        F.col("end").alias("started_timestamp"),
        F.col("batch_ms").alias("ended_timestamp"),
        F.col("units").alias("records"),
    )


def last_write_checkpoints(stats: DataFrame) -> DataFrame:
    """Write checkpoint of the last batch per bot and queue.

    Everything aggregated is a number; the position text is built per result row.
    """
    rank = positions.key(F.col("batch_ms"), F.col("checkpoint"), lane=_lane(stats))
    last = stats.groupBy("id", "queue").agg(
        F.max(rank).alias("_key"),
        F.max_by("start", rank).alias("source_timestamp"),
        F.max_by("end", rank).alias("started_timestamp"),
        F.max("batch_ms").alias("ended_timestamp"),
        F.max_by("units", rank).alias("records"),
    )
    return last.select(
        "id", "queue", positions.from_key(F.col("_key")).alias("checkpoint"),
        "source_timestamp", "started_timestamp", "ended_timestamp", "records",
    )


def size_by_bot(df: DataFrame, event_json: Column) -> DataFrame:
    """Characters of serialised events per bot."""
    return df.groupBy("id").agg(F.sum(F.length(event_json)).alias("chars"))


def size_by_batch(records: DataFrame) -> DataFrame:
    """Characters of encoded records per shard and batch."""
    return records.groupBy("shard", "batch").agg(F.sum(F.length("data")).alias("chars"))


def queue_sizes(
    sizes: DataFrame, shard: str | None = None, min_batch: int | None = None, min_queue: int = 100_000
) -> DataFrame:
    """Rows (date, queue, thousands) of parsed size lines above the thresholds."""
    if shard is not None:
        sizes = sizes.filter(F.col("shard") == shard)
    if min_batch is not None:
        sizes = sizes.filter(F.col("bytes") >= min_batch)
    return sizes.filter(F.col("queue_bytes") >= min_queue).select(
        # Halves round up, also where round-half-even would not.
        "date", "queue", F.floor(F.col("queue_bytes") / 1000 + 0.5).cast("bigint").alias("thousands")
    )


def size_pivot(rows: DataFrame, queues: list[str]) -> DataFrame:
    """Date by queue, summed; naming the queues saves a pass over the data."""
    return rows.groupBy("date").pivot("queue", queues).agg(F.sum("thousands"))


def read_stats(events: DataFrame) -> DataFrame:
    """What one read of a queue saw: units and the last event's position and times."""
    last = F.struct("write_ms", "source_ms")
    rank = positions.key(F.col("arrival_ms"), F.col("counter"))
    return events.agg(
        F.count("*").alias("units"),
        F.max(rank).alias("_key"),
        F.max_by(last["source_ms"], rank).alias("source_timestamp"),
        F.max_by(last["write_ms"], rank).alias("ended_timestamp"),
        F.max_by(last["write_ms"], rank).alias("started_timestamp"),
    ).select(
        "units", positions.from_key(F.col("_key")).alias("eid"),
        "source_timestamp", "ended_timestamp", "started_timestamp",
    )


def subscriber_catalog(positions_read: DataFrame, queues: DataFrame) -> DataFrame:
    """Subscribers per queue, the furthest-back position and how many lag.

    A bot lags when it has read less than the queue holds and has not reached
    the position it was asked to read. ``positions_read``: id, queue,
    checkpoint, requested. Both sides hold one row per bot or queue.
    """
    joined = positions_read.join(queues.select("queue", "max_eid"), "queue", "left")
    position = F.coalesce("checkpoint", F.lit(positions.START))
    reached = F.coalesce(F.col("checkpoint") >= F.col("requested"), F.lit(False))
    behind = F.coalesce(position < F.col("max_eid"), F.lit(False)) & ~reached
    return joined.groupBy("queue").agg(
        F.count_distinct("id").alias("subscribers"),
        F.min(position).alias("oldest_position"),
        F.count_if(behind).alias("behind"),
        F.max("max_eid").alias("max_eid"),
    )
