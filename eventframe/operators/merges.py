"""Keyed state tables: each merge is state full-outer-joined with its changes.

Changes hold one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: name part of a function address.
FUNCTION_ADDRESS = r"^arn:aws:lambda:.*?:\d+:function:(.*)$"


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], highest: tuple[str, ...] = ()) -> DataFrame:
    """Set the supplied columns of each key; null means "not supplied".

    Columns named ``highest`` only ever grow.
    """
    old, new = state.alias("old"), changes.alias("new")
    columns = [c for c in state.columns if c not in keys]
    columns += [c for c in changes.columns if c not in keys and c not in columns]

    def merged(c: str) -> Column:
        sides = [F.col(f"new.`{c}`")] if c in changes.columns else []
        sides += [F.col(f"old.`{c}`")] if c in state.columns else []
        grows = c in highest and len(sides) == 2
        return (F.greatest(*sides) if grows else F.coalesce(*sides)).alias(c)

    return old.join(new, keys, "full_outer").select(*keys, *[merged(c) for c in columns])


def checkpoint_requests(requests: DataFrame, now_ms: int) -> DataFrame:
    """Normal form of checkpoint requests.

    A position or origin time on the attached event wins; units fall back to
    records, then one; missing times become now. A request forces unless it
    says anything about forcing.
    """
    now = F.lit(now_ms).cast("bigint")

    def nonzero(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(0).cast("bigint"))

    def nonempty(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    return requests.select(
        "id",
        "queue",
        F.coalesce(nonempty("type"), F.lit("read")).alias("type"),
        "seq",
        F.coalesce(nonempty("event_eid"), F.col("eid")).alias("eid"),
        F.coalesce(nonzero("units"), F.col("records"), F.lit(1)).alias("units"),
        F.col("force").isNull().alias("force"),
        "expected",
        F.coalesce(nonzero("event_source_timestamp"), nonzero("source_timestamp"), now).alias("source_timestamp"),
        F.coalesce(nonzero("started_timestamp"), now).alias("started_timestamp"),
        F.coalesce(nonzero("ended_timestamp"), now).alias("ended_timestamp"),
    )


CHECKPOINT_VALUES = ["eid", "units", "source_timestamp", "started_timestamp", "ended_timestamp"]
CHECKPOINT_KEYS = ["id", "queue", "type"]


def compare_and_set(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply one request per (id, queue, type); ``accepted`` tells its outcome.

    A request is accepted when it forces or when the stored position is the one
    it expects. A rejected request leaves the stored row and is still reported.
    Keys without a request keep their row, with ``accepted`` null.
    """
    old, new = state.alias("old"), requests.alias("new")
    joined = old.join(new, CHECKPOINT_KEYS, "full_outer")
    asked = F.col("new.seq").isNotNull()
    accepted = F.when(asked, F.col("new.force") | F.col("old.eid").eqNullSafe(F.col("new.expected")))
    set_new = F.coalesce(accepted, F.lit(False))
    return joined.select(
        *CHECKPOINT_KEYS,
        *[F.when(set_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in CHECKPOINT_VALUES],
        accepted.alias("accepted"),
        F.when(asked, F.col("new.eid")).alias("asked"),
    )


def last_requests(requests: DataFrame) -> DataFrame:
    """Last request per key in ``seq`` order; earlier ones are superseded."""
    values = [c for c in requests.columns if c not in CHECKPOINT_KEYS]
    last = requests.groupBy(*CHECKPOINT_KEYS).agg(F.max_by(F.struct(*values), "seq").alias("_last"))
    return last.select(*CHECKPOINT_KEYS, "_last.*")


def register_bots(state: DataFrame, registrations: DataFrame) -> DataFrame:
    """Upsert bots; ``paused`` is set only when a bot is first seen and defaults to true."""
    named = registrations.withColumn("id", F.regexp_replace("id", FUNCTION_ADDRESS, "$1"))
    first = F.coalesce(F.col("old.paused"), F.col("new.paused"), F.lit(True)).alias("paused")
    columns = [c for c in named.columns if c not in ("id", "paused")]
    return (
        state.alias("old")
        .join(named.alias("new"), "id", "full_outer")
        .select("id", first, *[F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in columns])
    )


def merged_map(old: Column, new: Column) -> Column:
    """Entries of both maps; the new value wins."""
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(
        F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))
    )


def merge_requested(state: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """Merge requested versions into the stored ones; a new version is stamped with the time.

    ``state``: id, queue, version, requested_ms; ``requests``: id, queue, version.
    One row per bot and queue instead of a map per bot, so no bot has to fit a task.
    """
    asked = requests.withColumn("requested_ms", F.lit(now_ms).cast("bigint"))
    return upsert(state, asked, ["id", "queue"])


def trigger_times(state: DataFrame) -> DataFrame:
    """When each bot was last asked to run."""
    return state.groupBy("id").agg(F.max("requested_ms").alias("trigger"))


def merge_documents(state: DataFrame, documents: DataFrame) -> DataFrame:
    """Merge documents by id: map entries and set columns of the new one win."""
    columns = [c for c in state.columns if c != "id"]

    def merged(c: str) -> Column:
        old, new = F.col(f"old.{c}"), F.col(f"new.{c}")
        is_map = state.schema[c].dataType.typeName() == "map"
        return (merged_map(old, new) if is_map else F.coalesce(new, old)).alias(c)

    return state.alias("old").join(documents.alias("new"), "id", "full_outer").select("id", *[merged(c) for c in columns])


def merge_write_checkpoints(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace the write checkpoints of the bots and queues in ``rows``; one row per bot and queue."""
    return upsert(state, rows, ["id", "queue"])
