"""Facts about bots, read off pairs of old and new bot documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: bots that write the feed are not part of it.
MONITOR_BOT = "cron_monitor"


def watched(changes: DataFrame, monitor_bot: str = MONITOR_BOT) -> DataFrame:
    """Changes of all bots but the monitor's own and those that opt out."""
    new = F.col("new")
    muted = F.lit(False)
    if "ignoreMonitor" in changes.schema["new"].dataType.names:
        muted = F.coalesce(new["ignoreMonitor"], F.lit(False))
    return changes.filter(~new["id"].eqNullSafe(monitor_bot) & ~muted & new.isNotNull())


def _nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0).cast("bigint"))


def _entries(now: Column, was: Column, kind: str, instance: bool) -> Column:
    """Map entries of a document as (kind, key, instance now/was, checkpoint now/was)."""

    def entry(e):
        pair = (e["value"], F.try_element_at(was, e["key"]))
        none = F.lit(None)
        sides = [*pair, none.cast(_CHECKPOINT), none.cast(_CHECKPOINT)] if instance else [
            none.cast(_INSTANCE), none.cast(_INSTANCE), *pair
        ]
        names = ("i_now", "i_was", "c_now", "c_was")
        return F.struct(
            F.lit(kind).alias("kind"), e["key"].alias("key"),
            *[s.cast(t).alias(n) for s, n, t in zip(sides, names, (_INSTANCE, _INSTANCE, _CHECKPOINT, _CHECKPOINT))],
        )

    return F.coalesce(F.transform(F.map_entries(now), entry), F.array().cast(_ENTRY))


_INSTANCE = "struct<invokeTime:bigint,startTime:bigint,completedTime:bigint,status:string>"
_CHECKPOINT = (
    "struct<checkpoint:string,records:bigint,source_timestamp:bigint,started_timestamp:bigint,ended_timestamp:bigint>"
)
_ENTRY = (
    f"array<struct<kind:string,key:string,i_now:{_INSTANCE},i_was:{_INSTANCE},c_now:{_CHECKPOINT},c_was:{_CHECKPOINT}>>"
)


def facts(changes: DataFrame, kinds: tuple[str, ...] = ("instance", "read", "write")) -> DataFrame:
    """Facts of the given kinds; ``changes``: new, old, changed_ms.

    ``instance``: a first completion is reported as ``completed``; any other
    change of an instance's start time is a ``started``. ``read`` and
    ``write``: one fact per queue whose checkpoint moved; missing times become
    the time of the change, missing units stay null. All kinds come out of one
    pass over the changes.
    """
    parts = []
    if "instance" in kinds:
        parts.append(_entries(F.col("new.instances"), F.col("old.instances"), "instance", True))
    for kind in ("read", "write"):
        if kind in kinds:
            now, was = F.col(f"new.checkpoints.{kind}"), F.col(f"old.checkpoints.{kind}")
            parts.append(_entries(now, was, kind, False))
    rows = changes.select(
        F.col("new.id").alias("id"), "changed_ms", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("_e")
    ).select("id", "changed_ms", "_e.*")

    changed, kind = F.col("changed_ms"), F.col("kind")
    is_instance = kind == "instance"
    done = is_instance & _nonzero(F.col("i_now.completedTime")).isNotNull() & F.col("i_was.completedTime").isNull()
    begun = (
        is_instance & _nonzero(F.col("i_now.invokeTime")).isNotNull()
        & ~F.col("i_was.invokeTime").eqNullSafe(F.col("i_now.invokeTime"))
    )
    moved = ~is_instance & F.col("c_now").isNotNull() & ~F.col("c_was.checkpoint").eqNullSafe(F.col("c_now.checkpoint"))

    def time(name: str) -> Column:
        return F.coalesce(_nonzero(F.col(f"c_now.{name}_timestamp")), changed)

    rows = rows.withColumn("type", F.when(done, "completed").when(begun, "started").when(moved, kind))
    completed = F.col("type") == "completed"
    return rows.filter(F.col("type").isNotNull()).select(
        "id",
        "type",
        F.when(completed, F.col("i_now.completedTime")).when(~is_instance, time("ended")).alias("ts"),
        F.when(completed, F.coalesce(_nonzero(F.col("i_was.invokeTime")), changed))
        .when(is_instance, F.col("i_now.invokeTime")).otherwise(time("started")).alias("start"),
        F.when(completed, F.coalesce(F.col("i_now.status") == "error", F.lit(False))).alias("is_error"),
        F.when(kind == "read", F.col("key")).alias("from"),
        F.when(kind == "write", F.col("key")).alias("to"),
        F.col("c_now.checkpoint").alias("checkpoint"),
        F.col("c_now.records").alias("units"),
        F.when(~is_instance, time("source")).alias("source_ts"),
    )


def instance_facts(changes: DataFrame) -> DataFrame:
    return facts(changes, ("instance",)).select("id", "type", "ts", "start", "is_error")


def checkpoint_facts(changes: DataFrame) -> DataFrame:
    return facts(changes, ("read", "write")).drop("is_error")


def monitor_feed(changes: DataFrame, monitor_bot: str = MONITOR_BOT) -> DataFrame:
    """Every fact about the watched bots."""
    return facts(watched(changes, monitor_bot))
