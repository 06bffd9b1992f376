"""Which queues to archive and how their events form archive chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, positions
from ..functions.times import div
from ..session import hint_small

# Fixed value: minutes of one archive chunk.
CHUNK_MINUTES = 20


def archive_candidates(queues: DataFrame, today: str) -> DataFrame:
    """Live queues with events past their archive, stalest first.

    ``today`` is the day prefix ``z/yyyy/MM/dd``; a queue archived into today
    is done until tomorrow.
    """
    return open_queues(queues, today).filter(F.col("archive_end") != F.col("max_eid")).orderBy("archive_end", "queue")


def open_queues(queues: DataFrame, today: str) -> DataFrame:
    """Live queues that may be archived today, whether or not their last position is past their archive."""
    end = F.coalesce("archive_end", F.lit(positions.START))
    side = names.is_archive(F.col("queue")) | names.is_snapshot(F.col("queue"))
    return (
        queues.filter(~F.coalesce("skip_archive", F.lit(False)) & ~side & F.col("max_eid").isNotNull())
        .withColumn("archive_end", end)
        .filter(F.lit(today) > F.col("archive_end"))
    )


def to_archive(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Events past the archive end of their queue, for all candidates at once.

    On stored events the days between a queue's archive end and its last
    position join by folder, so days archived before are not read.
    """
    ends = candidates.select("queue", "archive_end")
    if "date" not in events.columns:
        return _past_end(events.join(hint_small(ends), "queue"))
    days = F.sequence(
        F.try_to_date(positions.day_of(F.col("archive_end"))), F.try_to_date(positions.day_of(F.col("max_eid")))
    )
    known = F.try_to_date(positions.day_of(F.col("archive_end"))).isNotNull() & F.try_to_date(
        positions.day_of(F.col("max_eid"))
    ).isNotNull()
    dated = candidates.filter(known).select("queue", "archive_end", F.explode(days.cast("array<string>")).alias("date"))
    fresh = candidates.filter(~known).select("queue", "archive_end")
    some = _past_end(events.join(hint_small(dated), ["queue", "date"])).select(*events.columns)
    rest = _past_end(events.join(hint_small(fresh), "queue")).select(*events.columns)
    return some.unionByName(rest)


def _past_end(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("eid") > F.col("archive_end")).drop("archive_end")


def chunk_start(ms: Column, minutes: int = CHUNK_MINUTES) -> Column:
    size = minutes * 60_000
    return div(ms, size) * size


def archive_chunks(events: DataFrame, ms: str = "arrival_ms", minutes: int = CHUNK_MINUTES) -> DataFrame:
    """Manifest of the archive queue: one row per queue and chunk of time."""
    lane = F.col("lane") if "lane" in events.columns else None
    rank = positions.key(F.col(ms), F.col("counter"), lane=lane)
    chunks = events.groupBy("queue", chunk_start(F.col(ms), minutes).alias("chunk_ms")).agg(
        F.min(rank).alias("_first"),
        F.max(rank).alias("_last"),
        F.count("*").alias("records"),
        F.sum(F.length("payload")).alias("size"),
    )
    return chunks.select(
        names.archive_of(F.col("queue")).alias("queue"),
        "chunk_ms",
        positions.from_key(F.col("_first")).alias("start"),
        positions.from_key(F.col("_last")).alias("end"),
        "records",
        "size",
    )


def as_archive_rows(events: DataFrame) -> DataFrame:
    """The same events under the archive queue; archived rows never expire."""
    rows = events.withColumn("queue", names.archive_of(F.col("queue")))
    return rows.withColumn("ttl", F.lit(None).cast("bigint")) if "ttl" in rows.columns else rows
