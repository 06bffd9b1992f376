"""Which bots a change of queues wakes up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import canonical

# Queue columns that hold a position, old and new.
VERSION_COLUMNS = [
    "kinesis_number", "s3_kinesis_number", "initial_kinesis_number", "s3_new_kinesis_number", "eid", "max_eid",
]


def queue_version(image: Column, fields: list[str] = VERSION_COLUMNS) -> Column:
    """Greatest known position of a queue document; missing ones are skipped."""
    return F.greatest(*[image[f] for f in fields])


def moved_queues(changes: DataFrame) -> DataFrame:
    """Last new version per queue among changes (seq, new, old) that moved it.

    Deletes have no new document. Map-side combine keeps one row per queue and
    task, however hot a queue is.
    """
    fields = [f for f in VERSION_COLUMNS if f in changes.schema["new"].dataType.names]
    rows = changes.filter(F.col("new").isNotNull()).select(
        "seq",
        canonical(F.col("new.event")).alias("queue"),
        queue_version(F.col("new"), fields).alias("version"),
        queue_version(F.col("old"), fields).alias("_was"),
    )
    rows = rows.filter(~F.col("version").eqNullSafe(F.col("_was")))
    return rows.groupBy("queue").agg(F.max_by("version", "seq").alias("version"))


def subscriptions(bots: DataFrame) -> DataFrame:
    """(queue, id) for every trigger of a bot that is not archived."""
    active = bots.filter(~F.coalesce("archived", F.lit(False)))
    return active.select("id", F.explode("triggers").alias("_t")).select(
        canonical(F.col("_t")).alias("queue"), "id"
    ).distinct()


def trigger_rows(changes: DataFrame, bots: DataFrame) -> DataFrame:
    """(id, queue, version) to request of each bot; one row per moved queue joins in."""
    return subscriptions(bots).join(moved_queues(changes), "queue").select("id", "queue", "version")
