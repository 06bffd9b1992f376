"""Queue names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name prefix and suffixes of queues.
QUEUE_PREFIX = "queue:"
ARCHIVE_SUFFIX = "/_archive"
SNAPSHOT_SUFFIX = "/_snapshot"
SYSTEM_PREFIX = "system."


def canonical(name: Column) -> Column:
    """``queue:x`` and ``x`` are one queue."""
    return F.regexp_replace(name, f"^{QUEUE_PREFIX}", "")


def canonical_text(name: str) -> str:
    return name.removeprefix(QUEUE_PREFIX)


def archive_of(queue: Column) -> Column:
    return F.concat(queue, F.lit(ARCHIVE_SUFFIX))


def snapshot_of(queue: Column) -> Column:
    return F.concat(queue, F.lit(SNAPSHOT_SUFFIX))


def parent_of(queue: Column) -> Column:
    """The live queue an archive or snapshot queue belongs to."""
    return F.regexp_replace(queue, f"({ARCHIVE_SUFFIX}|{SNAPSHOT_SUFFIX})$", "")


def is_archive(queue: Column) -> Column:
    return queue.endswith(ARCHIVE_SUFFIX)


def is_snapshot(queue: Column) -> Column:
    return queue.endswith(SNAPSHOT_SUFFIX)


def system_name(name: Column) -> Column:
    """Names without a dot get the system prefix."""
    return F.when(name.contains("."), name).otherwise(F.concat(F.lit(SYSTEM_PREFIX), name))
