"""Filters, names and defaults applied to decoded envelopes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.times import div, parse_ms

# Retention and backlog limits.
TTL_SECONDS = 604_800
BACKLOG_SECONDS = 3
BACKLOG_RECORDS = 100
SNAPSHOT_COMMAND = "registerSnapshot"

# JSON texts that count as "no payload": null, false, zero and the empty string.
_EMPTY_JSON = r'^\s*(null|false|""|-?0(\.0+)?([eE][+-]?\d+)?)?\s*$'


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def has_payload(payload: Column) -> Column:
    return F.coalesce(~payload.rlike(_EMPTY_JSON), F.lit(False))


def is_valid_bus_event(df: DataFrame) -> Column:
    """An event needs a queue, and either producer and payload or a chunk pointer."""
    inline = has_text(F.col("id")) & has_payload(F.col("payload"))
    if "s3" in df.columns:
        inline = inline | F.col("s3").isNotNull()
    return has_text(F.col("event")) & inline


def valid_bus_events(df: DataFrame) -> DataFrame:
    return df.filter(is_valid_bus_event(df))


def valid_file_events(df: DataFrame) -> DataFrame:
    """Lines of backfill files are dropped only when both names are missing."""
    return df.filter(has_text(F.col("id")) | has_text(F.col("event")))


def control_rows(df: DataFrame) -> DataFrame:
    """Command rows; they never reach a queue."""
    return df.filter(has_text(F.col("cmd")))


def data_rows(df: DataFrame) -> DataFrame:
    return df.filter(~has_text(F.col("cmd")))


def snapshot_commands(df: DataFrame) -> DataFrame:
    """The one command that has an effect; other commands are dropped."""
    return df.filter(F.col("cmd") == SNAPSHOT_COMMAND)


def without_listed(
    df: DataFrame, queues: Iterable[str] | DataFrame = (), bots: Iterable[str] | DataFrame = ()
) -> DataFrame:
    """Drop events of listed queues (any spelling of the name) and listed bots.

    Name lists are job settings and become literals. A list kept in a table is
    an anti join, whose strategy follows from the table's measured size.
    """
    if isinstance(queues, DataFrame):
        listed = queues.select(names.canonical(F.col(queues.columns[0])).alias("_queue")).distinct()
        df = df.join(listed, names.canonical(df["event"]) == listed["_queue"], "left_anti")
    elif queues := sorted({names.canonical_text(q) for q in queues}):
        df = df.filter(~F.coalesce(names.canonical(F.col("event")).isin(queues), F.lit(False)))
    if isinstance(bots, DataFrame):
        listed = bots.select(F.col(bots.columns[0]).alias("_bot")).distinct()
        df = df.join(listed, df["id"] == listed["_bot"], "left_anti")
    elif bots := sorted(set(bots)):
        df = df.filter(~F.coalesce(F.col("id").isin(bots), F.lit(False)))
    return df


def with_queue(df: DataFrame) -> DataFrame:
    """Canonical queue; archive and snapshot events go to their side queues."""
    queue = names.canonical(F.col("event"))
    if "archive" in df.columns:
        snapshot = F.coalesce(F.col("snapshot"), F.lit(False)) if "snapshot" in df.columns else F.lit(False)
        queue = (
            F.when(F.coalesce(F.col("archive"), F.lit(False)), names.archive_of(queue))
            .when(snapshot, names.snapshot_of(queue))
            .otherwise(queue)
        )
    return df.withColumn("queue", queue)


def with_times(df: DataFrame, now_ms: int | Column) -> DataFrame:
    """Default write time to ``now_ms`` and origin time to the write time.

    Zero counts as missing, as does a text that is not a date.
    """
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms).cast("bigint")
    source = F.col("source_ms")
    if df.schema["source_ms"].dataType.typeName() == "string":
        source = parse_ms(source)
    return df.withColumn("write_ms", F.coalesce(F.nullif(F.col("write_ms"), F.lit(0)), now)).withColumn(
        "source_ms", F.coalesce(F.nullif(source, F.lit(0)), F.col("write_ms"))
    )


def expiry(batch_ms: Column, ttl_seconds: int = TTL_SECONDS) -> Column:
    """Expiry in epoch seconds."""
    return div(batch_ms + F.lit(ttl_seconds * 1000).cast("bigint"), 1000)


def with_ttl(df: DataFrame, batch_ms: str = "arrival_ms", ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Archive rows never expire."""
    return df.withColumn("ttl", F.when(~names.is_archive(F.col("queue")), expiry(F.col(batch_ms), ttl_seconds)))


def retained(df: DataFrame, now_s: int) -> DataFrame:
    """Rows that have not expired at ``now_s``."""
    return df.filter(F.col("ttl").isNull() | (F.col("ttl") > now_s))


def with_creator(df: DataFrame, creator: str) -> DataFrame:
    return df.withColumn("creator", F.lit(creator))


def batch_backlog(df: DataFrame, now_ms: int, batch: list[str]) -> DataFrame:
    """One row per batch: is it late or large enough for bulk files?"""
    return df.groupBy(*batch).agg(
        F.count("*").alias("records"), F.min("arrival_ms").alias("first_ms")
    ).withColumn(
        "bulk",
        (F.lit(now_ms) - F.col("first_ms") > BACKLOG_SECONDS * 1000) | (F.col("records") > BACKLOG_RECORDS),
    )
