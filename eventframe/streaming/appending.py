"""Numbering and storing one micro-batch together with its state.

Events and the snapshots of clock, queues, bots and positions are staged, one commit
makes them all current, then the events' folders are moved to their queues. A crash
before the commit leaves nothing that anybody sees, one after it is repaired by
whoever comes next.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, positions
from ..functions.times import div
from ..operators import merges, stats
from ..operators.normalize import TTL_SECONDS, expiry
from ..operators.numbering import ROW_VERSION
from ..operators.running import (  # noqa: F401 (in_ranges: for callers that cut rows themselves)
    RANGE, gathered, in_places, in_ranges, range_count, with_number, with_running_total,
)
from ..schemas import BOT_STATE, CLOCK_STATE, POSITION_STATE, QUEUE_STATE
from ..session import work_dir
from ..sources import folders
from ..sources.queues import DataFile, QueueStore
from ..sources.state import Head, StaleVersion

EVENT_COLUMNS = {
    "s3": "struct<bucket:string,key:string>", "snapshot_ms": "bigint", "archive_start": "string",
    "archive_end": "string", "creator": "string",
}

# The range of a row that has its number from one.
PART = "_part"


class Batch(NamedTuple):
    """A stored batch: its name and files."""

    name: str
    files: list[DataFile]

    @property
    def records(self) -> int:
        return sum(f.records for f in self.files)


class Appender:
    """Writes the micro-batches of one job; state tables belong to that job alone."""

    def __init__(
        self, store: QueueStore, job: str, ttl_seconds: int = TTL_SECONDS, max_records_per_file: int = 1_000_000
    ):
        self.store, self.job, self.state = store, job, store.job(job)
        self.ttl_seconds, self.max_records_per_file = ttl_seconds, max_records_per_file

    def done(self, version: int) -> bool:
        head = self.state.head()
        return head is not None and head.version >= version

    def append(
        self,
        events: DataFrame,
        firsts: DataFrame,
        version: int,
        bucket: list[str],
        order: list[str],
        markers: DataFrame | None = None,
        read: DataFrame | None = None,
        more: Mapping[str, tuple[T.StructType, DataFrame]] | None = None,
    ) -> Batch | None:
        """Store a batch; None if the version was stored before.

        ``events``: shard, id, queue, payload, write_ms, source_ms and optional
        columns of ``EVENT_COLUMNS``; ``bucket + order`` is their order within a
        shard and queue. ``firsts``: shard, sequence, value of the first record.
        ``markers``: snapshot marks. ``read``: positions the job has read up to.
        ``more``: further tables of the job, replaced in the same commit.
        Raises ``StaleVersion`` if another writer of the job's name made the version
        meanwhile; nothing of this batch is stored then.
        """
        self.store.recover()
        head = self.state.head()
        if head is not None and head.version >= version:
            return None
        for name, kind in EVENT_COLUMNS.items():
            if name not in events.columns:
                events = events.withColumn(name, F.lit(None).cast(kind))
        batch = f"{self.job}-{version}-{uuid.uuid4().hex[:12]}"
        # A row per shard of the job.
        counted = events.groupBy("shard").agg(F.count("*").alias("_events"))
        found = counted.collect()
        counts, count = self.store.spark.createDataFrame(found, counted.schema), sum(r["_events"] for r in found)
        tables = {"clock": self._stage("clock", CLOCK_STATE, self._clocks(firsts, counts, head), version)}
        clocks = self._staged(tables, "clock", CLOCK_STATE).filter(F.col("start").isNotNull()).select("shard", "start", "lane")
        places = work_dir(self.store.spark, "places")
        numbered = self._numbered(events, clocks, bucket, order, places, count)
        try:
            # Rows of places go to their files range by range: gathered by queue and day, few tasks would have them all.
            placed = PART in numbered.columns
            rows = gathered(numbered, PART, range_count(events, count), count) if placed else numbered
            files = self.store.stage(rows, self.job, batch, self.max_records_per_file, placed)
            tables["queues"] = self._stage("queues", QUEUE_STATE, self._queue_state(numbered, markers, head), version)
            tables["bots"] = self._stage("bots", BOT_STATE, self._bot_state(numbered, head), version)
            if read is not None:
                current = self.state.load("positions", POSITION_STATE, head)
                tables["positions"] = self._stage(
                    "positions", POSITION_STATE, merges.upsert(current, read, merges.CHECKPOINT_KEYS), version
                )
            for name, (schema, rows) in (more or {}).items():
                tables[name] = self._stage(name, schema, rows, version)
        finally:
            numbered.unpersist()
            folders.delete(self.store.spark, places)
        try:
            self.state.commit(version, tables, head, batch)
        except StaleVersion:
            self.store.drop_staged(self.job, batch)
            raise
        self.store.publish(self.job, batch)
        return Batch(batch, files)

    def _stage(self, table: str, schema: T.StructType, rows: DataFrame, version: int) -> str:
        return self.state.stage(table, schema, rows, version)

    def _staged(self, tables: dict[str, str], table: str, schema: T.StructType) -> DataFrame:
        return self.state.load(table, schema, Head(0, tables))

    def _clocks(self, firsts: DataFrame, counts: DataFrame, head: Head | None) -> DataFrame:
        """Clock per shard with the last millisecond the batch will use, and the shard's lane."""
        spark = self.store.spark
        before = self.state.load("clock", CLOCK_STATE, head)
        # A row per shard of the job.
        lanes = {r["shard"]: r["lane"] for r in before.select("shard", "lane").collect()}
        for row in firsts.select("shard").collect():
            if row["shard"] not in lanes:
                lanes[row["shard"]] = self.store.lane(f"{self.job}/{row['shard']}")
        known = spark.createDataFrame(list(lanes.items()), "shard string, lane int")
        previous = before.select("shard", F.col("clock").alias("_old"), F.col("sequence").alias("_seq"))
        rows = firsts.join(counts, "shard", "left").join(previous, "shard", "full_outer").join(known, "shard", "left")
        # One batch per shard: its first arrival, or one past the last clock.
        rows = rows.withColumn("start", F.when(F.col("value").isNotNull(), F.greatest("value", F.col("_old") + 1)))
        # Counters past seven digits move on to the next millisecond.
        extra = div(F.greatest(F.coalesce("_events", F.lit(1)) - 1, F.lit(0)), positions.COUNTER_SIZE)
        return rows.select(
            "shard",
            F.coalesce(F.col("start") + extra, F.col("_old")).alias("clock"),
            F.coalesce("sequence", "_seq").alias("sequence"),
            "start", "lane",
        )

    def _numbered(
        self, events: DataFrame, clocks: DataFrame, bucket: list[str], order: list[str], places: str, count: int
    ) -> DataFrame:
        """``count`` events with their positions. ``places`` is a folder that keeps what they are numbered by."""
        # Nearly all events have the first millisecond of their batch: its text is made once a shard.
        clocks = clocks.withColumn("_prefix", positions.batch_prefix(F.col("start")))
        if RANGE in bucket:
            rows = with_running_total(events, ["shard"], ["queue", *bucket], order, F.lit(1).cast("bigint"), "_n")
            return self._positioned(rows.join(clocks, "shard")).persist(StorageLevel.MEMORY_AND_DISK)
        # Buckets may be nearly as many as the rows (seconds of a long time) or as few as one: ranges are neither.
        known = events.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in ("shard", "queue", *bucket)))
        kept = ["shard", "id", "queue", "payload", "write_ms", "source_ms", *EVENT_COLUMNS]
        placed = in_places(known, ["shard", "queue", *bucket, *order], kept, f"{places}/rows", count).withColumn(PART, F.col(RANGE))
        return self._positioned(with_number(placed, ["shard"], "_n", clocks, f"{places}/numbers"))

    def _positioned(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_n", F.col("_n") - 1)
        rows = rows.withColumn("batch_ms", F.col("start") + div(F.col("_n"), positions.COUNTER_SIZE))
        rows = rows.withColumn("counter", F.col("_n") % positions.COUNTER_SIZE)
        archive, snapshot = names.is_archive(F.col("queue")), names.is_snapshot(F.col("queue"))
        bucket_ms = F.when(snapshot, F.coalesce("snapshot_ms", "batch_ms")).otherwise(F.col("batch_ms"))
        first = (F.col("batch_ms") == F.col("start")) & (bucket_ms == F.col("start"))
        prefix = F.when(first, F.col("_prefix")).otherwise(positions.batch_prefix(F.col("batch_ms"), bucket_ms))
        own = positions.behind(prefix, F.col("counter"), F.col("lane"))
        return (
            rows.withColumn("bucket_ms", bucket_ms)
            .withColumn("eid", F.when(archive, F.coalesce("archive_end", own)).otherwise(own))
            .withColumn("ttl", F.when(~archive, expiry(F.col("batch_ms"), self.ttl_seconds)))
            .withColumn("v", F.lit(ROW_VERSION))
            .drop("_n", "start", "_prefix")
        )

    def _queue_state(self, numbered: DataFrame, markers: DataFrame | None, head: Head | None) -> DataFrame:
        rank = positions.key(F.col("batch_ms"), F.col("counter"), F.col("bucket_ms"), F.col("lane"))
        archive = names.is_archive(F.col("queue"))
        # Few times and many counters: a key is made of the highest counter of each, not of every row.
        highest = numbered.filter(~archive).groupBy("queue", "batch_ms", "bucket_ms", "lane").agg(F.max("counter").alias("counter"))
        marks = highest.groupBy("queue").agg(
            F.max(rank).alias("_key"), F.max("batch_ms").alias("timestamp")
        ).select("queue", positions.from_key(F.col("_key")).alias("max_eid"), "timestamp")
        archived = numbered.filter(archive).groupBy("queue").agg(
            F.max("eid").alias("max_eid"), F.max("batch_ms").alias("timestamp")
        )
        changed = marks.unionByName(archived).withColumn("v", F.lit(ROW_VERSION))
        ends = archived.select(names.parent_of(F.col("queue")).alias("queue"), F.col("max_eid").alias("archive_end"))
        before = self.state.load("queues", QUEUE_STATE, head)
        state = merges.upsert(before, changed, ["queue"], highest=("max_eid", "timestamp"))
        state = merges.upsert(state, ends, ["queue"], highest=("archive_end",))
        return state if markers is None else merges.upsert(state, markers, ["queue"])

    def _bot_state(self, numbered: DataFrame, head: Head | None) -> DataFrame:
        produced = numbered.filter(F.col("id").isNotNull()).withColumn("arrival_ms", F.col("batch_ms"))
        last = stats.last_write_checkpoints(stats.producer_stats(produced, ("shard", "lane")))
        return merges.merge_write_checkpoints(self.state.load("bots", BOT_STATE, head), last)


def queue_states(store: QueueStore) -> DataFrame:
    """Queue state over all jobs: the latest mark of each column's kind.

    Every job keeps its own table, so jobs never overwrite each other.
    """
    spark: SparkSession = store.spark
    heads = [(store.job(job), store.job(job).head()) for job in folders.children(spark, f"{store.root}/state")]
    tables = [job.load("queues", QUEUE_STATE, head) for job, head in heads if head and "queues" in head.tables]
    if not tables:
        return spark.createDataFrame([], QUEUE_STATE)
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    # Both marks of a snapshot come from the job whose snapshot began last.
    snapshot = F.max(F.when(F.col("snapshot_start").isNotNull(), F.struct("snapshot_start", "snapshot_next")))
    merged = rows.groupBy("queue").agg(
        F.max("max_eid").alias("max_eid"), F.max("timestamp").alias("timestamp"), F.max("v").alias("v"),
        F.max("archive_end").alias("archive_end"), snapshot.alias("_snapshot"),
        # The setting of the job that has written last.
        F.max(F.when(F.col("skip_archive").isNotNull(), F.struct("timestamp", "skip_archive"))).alias("_skip"),
    )
    return merged.select(
        "queue", "max_eid", "timestamp", "v", "archive_end", F.col("_snapshot.snapshot_start").alias("snapshot_start"),
        F.col("_snapshot.snapshot_next").alias("snapshot_next"), F.col("_skip.skip_archive").alias("skip_archive"),
    )


def bot_rows(rows: DataFrame, bot: str, queue: Column | str, now_ms: int) -> DataFrame:
    """Event rows of one producer: its name, queue and times filled in."""
    target = F.lit(names.canonical_text(queue)) if isinstance(queue, str) else queue
    now = F.lit(now_ms).cast("bigint")
    source = F.coalesce("source_ms", now) if "source_ms" in rows.columns else now
    return (
        rows.withColumn("source_ms", source).withColumn("write_ms", now)
        .withColumn("id", F.lit(bot)).withColumn("queue", target).withColumn("shard", F.lit(bot))
    )


def bot_clock(spark: SparkSession, bot: str, now_ms: int) -> DataFrame:
    """First record of a producer's own batch."""
    return spark.range(1).select(
        F.lit(bot).alias("shard"), F.lit(str(now_ms)).alias("sequence"), F.lit(now_ms).cast("bigint").alias("value")
    )


def write_events(store: QueueStore, bot: str, queue: str, events: DataFrame, order: list[str], now_ms: int) -> int:
    """Write events (payload, and ``order`` columns) to a queue; returns how many were written.

    If another writer of the name makes the next version first, the rows are
    numbered again after its own.
    """
    appender = Appender(store, f"write-{bot}")
    rows = bot_rows(events, bot, queue, now_ms)
    while True:
        head = appender.state.head()
        version = 0 if head is None else head.version + 1
        try:
            if batch := appender.append(rows, bot_clock(store.spark, bot, now_ms), version, [], order):
                return batch.records
        except StaleVersion:
            # The winner's version is complete: read it, and come behind it.
            continue
