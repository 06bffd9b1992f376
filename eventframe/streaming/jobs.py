"""Jobs that move events between files, queues and state tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import names, positions
from ..operators import archive, merges, monitor, normalize, triggers
from ..operators.running import RANGE, in_ranges
from ..operators.stats import ROW_VERSION
from ..schemas import BOT_IMAGE, CLOCK_STATE, POSITION_STATE, QUEUE_IMAGE, QUEUE_STATE, REQUEST_STATE, STORED
from ..session import hint_small, work_table
from ..sources import changes as feed
from ..sources import files, folders
from ..sources import records as rec
from ..sources.files import PAGE, plain_path
from ..sources.queues import DataFile, QueueStore, archive_then_live, batch_job, batch_version, expand_chunks
from .appending import Appender, Batch, bot_clock, bot_rows, queue_states, write_events
from .ingest import now_ms

# Up to which version of each job a queue's batches are archived.
BATCH_STATE = T.StructType([
    T.StructField("queue", T.StringType()), T.StructField("job", T.StringType()), T.StructField("version", T.LongType()),
])

# Who marks backfilled events, and the queue of monitoring facts.
BACKFILL_CREATOR = "firehose"
MONITOR_QUEUE = "monitor"


def start_batches(store: QueueStore, rows: DataFrame, job: str, work: Callable, **trigger) -> StreamingQuery:
    """Run ``work(batch, version)`` over a stream under the job's own checkpoint."""
    return (
        rows.writeStream.queryName(f"{job}-{store.root.rsplit('/', 1)[-1]}")
        .option("checkpointLocation", store.checkpoint_path(job))
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(work)
        .start()
    )


def drain(query: StreamingQuery, seconds: float) -> bool:
    """Wait for a query to finish what there is; stop it at the time limit.

    Work cut off by the limit is not committed and runs first next time.
    """
    finished = bool(query.awaitTermination(seconds))
    if not finished:
        query.stop()
    return finished


def stream_file_lines(spark: SparkSession, folder: str, max_files: int = PAGE) -> DataFrame:
    """Lines of the files that arrive below a folder, with their place in it."""
    lines = (
        spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").text(folder)
    )
    return lines.select(
        F.col("value").alias("data"),
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def backfill(
    store: QueueStore, lines: DataFrame, bot: str, clock: Callable[[], int] = now_ms, **trigger
) -> StreamingQuery:
    """Load files of event lines into their queues as they arrive."""

    def work(batch: DataFrame, version: int) -> None:
        appender = Appender(store, bot)
        if appender.done(version):
            return
        now = clock()
        read = batch.agg(F.max("file").alias("eid"), F.count_distinct("file").alias("units"))
        rows = batch.withColumn("row", F.monotonically_increasing_id())
        load_lines(appender, rows, version, now, ["file", "block"], position_row(read, bot, "files", now))

    return start_batches(store, lines, bot, work, **trigger)


def load_lines(
    appender: Appender, lines: DataFrame, version: int, now: int, bucket: list[str], read: DataFrame
) -> None:
    """Decode, check and store lines of event files (``data`` and the columns of ``bucket``, ``row``)."""
    store, bot = appender.store, appender.job
    flat = rec.flat_lines(rec.parsed_lines(rec.decoded_texts(lines, raw=True))).persist(StorageLevel.MEMORY_AND_DISK)
    good, bad = rec.good_and_bad(flat)
    try:
        rows = normalize.valid_file_events(good)
        nameless = rows.filter(~normalize.has_text(F.col("event"))).select("file", "id", "payload")
        bad.select("file", "json", "problem").unionByName(
            nameless.withColumn("problem", F.lit("no queue")), allowMissingColumns=True
        ).write.mode("overwrite").parquet(f"{store.root}/quarantine/{bot}/batch={version}")
        events = rows.filter(normalize.has_text(F.col("event"))).withColumn("queue", names.canonical(F.col("event")))
        events = normalize.with_creator(normalize.with_times(events, now), BACKFILL_CREATOR)
        events = events.withColumn("shard", F.lit(bot)).drop("start", "end", "eid")
        appender.append(events, bot_clock(store.spark, bot, now), version, bucket, ["row", "line"], read=read)
    finally:
        flat.unpersist()


def discover_files(store: QueueStore, folder: str, bot: str = "file-finder", clock: Callable[[], int] = now_ms) -> int:
    """Write the load commands for all new files below a folder, from one listing; returns how many files they name.

    The cursor moves after the commands are written, so a crash between the two
    repeats commands and loses none.
    """
    table = store.state(f"{bot}/positions", POSITION_STATE)
    saved = table.load().select("eid").first()
    cursor = saved["eid"] if saved else ""
    commands = work_table(files.load_commands(files.listing(store.spark, folder, cursor), folder, cursor), "commands")
    done = commands.agg(F.max("cursor").alias("eid"), F.sum("files").alias("units"))
    named = done.first()["units"]
    if named:
        now = clock()
        write_events(store, bot, files.COMMAND_QUEUE, commands.select("payload", "page"), ["page"], now)
        version = 0 if table.version() is None else table.version() + 1
        table.commit(position_row(done, bot, folder, now), version)
    return named or 0


def run_load_commands(
    store: QueueStore, folder: str, bot: str, clock: Callable[[], int] = now_ms, max_files: int = 1, **trigger
) -> StreamingQuery:
    """Load the files named by load commands, in command and list order."""

    def work(batch: DataFrame, version: int) -> None:
        appender = Appender(store, bot)
        if appender.done(version):
            return
        now = clock()
        wanted = files.command_files(batch.select(F.col("eid").alias("command"), "payload"))
        lines = files.lines_of(store.spark, wanted, folder).withColumnsRenamed({"text": "data", "key": "file"})
        read = read_position(batch, bot, files.COMMAND_QUEUE, now)
        load_lines(appender, lines, version, now, ["command", "pos", "block"], read)

    return start_batches(store, store.stream(files.COMMAND_QUEUE, max_files), bot, work, **trigger)


def position_row(read: DataFrame, bot: str, queue: str, now: int) -> DataFrame:
    """Checkpoint row of a bot from ``eid`` and ``units``."""
    return read.select(
        F.lit(bot).alias("id"), F.lit(queue).alias("queue"), F.lit("read").alias("type"), "eid", "units",
        *[F.lit(now).cast("bigint").alias(f"{c}_timestamp") for c in ("source", "started", "ended")],
    )


def copy_queue(
    store: QueueStore,
    bot: str,
    source: str,
    destination: str,
    change: Callable[[DataFrame], DataFrame] | None = None,
    target: QueueStore | None = None,
    clock: Callable[[], int] = now_ms,
    max_files: int = 1000,
    **trigger,
) -> StreamingQuery:
    """Replicate a queue, or map its events with ``change``, under the bot's own position.

    ``change`` gets and returns event rows; it may add, drop or rewrite them but
    keeps ``eid``, the source position. ``target`` may be another store.
    """
    into = target or store
    earliest = copy_archived(store, bot, source, destination, change, into, clock)

    def work(batch: DataFrame, version: int) -> None:
        if not Appender(into, bot).done(version):
            # A micro-batch comes with every column that its stream has, however few are asked for. So
            # it has the names of its files alone, at most ``max_files``, and what is needed is read from them.
            found = [DataFile.of(unquote(r["file"])) for r in batch.distinct().collect()]
            rows = store.read_files(source, found)
            copy_rows(store, rows, Appender(into, bot), version, source, destination, change, max(clock(), earliest))

    names_only = store.stream(source, max_files).select(F.col("_metadata.file_path").alias("file"))
    return start_batches(into, names_only, bot, work, **trigger)


def copy_rows(
    store: QueueStore, batch: DataFrame, appender: Appender, version: int, source: str, destination: str,
    change: Callable[[DataFrame], DataFrame] | None, now: int, bot: str | None = None,
) -> Batch | None:
    """Store one batch of another queue's rows, the events of chunks in place of pointers to them."""
    bot = bot or appender.job
    rows = batch.select(*[f.name for f in STORED])
    chunked = not rows.filter(F.col("s3").isNotNull()).isEmpty()
    if chunked:
        rows = work_table(expand_chunks(store.spark, rows, store.chunks).select("eid", "payload", "source_ms"), "chunk-events")
    rows = rows.select("eid", "payload", "source_ms")
    read = read_position(rows, bot, source, now)
    changed = change(rows) if change else rows
    events = bot_rows(changed, bot, destination, now).withColumn("from_eid", F.col("eid"))
    if chunked:
        # A counter has all events of its chunk: ranges of positions cut them.
        events = in_ranges(events.drop("eid"), ["from_eid"], rows.count())
        return appender.append(events, bot_clock(store.spark, bot, now), version, [RANGE], ["from_eid"], read=read)
    return appender.append(events.drop("eid"), bot_clock(store.spark, bot, now), version, ["from_eid"], [], read=read)


def copy_archived(
    store: QueueStore, bot: str, source: str, destination: str, change: Callable[[DataFrame], DataFrame] | None,
    into: QueueStore, clock: Callable[[], int],
) -> int:
    """Copy the days that retention dropped before the bot read them; returns the first millisecond after the copy.

    They come from the archive, a day at a time, under a state of their own beside the stream's.
    """
    name, job = names.canonical_text(source), f"{bot}.archived"
    appender = Appender(into, job)
    kept = store.retained_from(name)
    read = [r["eid"] for j in (bot, job) for r in into.state(f"{j}/positions", POSITION_STATE).load().filter(F.col("queue") == name).collect()]
    start = max(read, default=None)
    archived = f"{name}{names.ARCHIVE_SUFFIX}"
    live = store.queue(name).select("eid", "date")
    for day in [d for d in store.days(archived, start) if d < kept]:
        # What was written to the day after it was dropped is there for the stream.
        rows = store.queue(archived).filter(F.col("date") == day).join(live.filter(F.col("date") == day), "eid", "left_anti")
        rows = (rows if start is None else rows.filter(F.col("eid") > start)).withColumn("queue", F.lit(name))
        if not rows.isEmpty():
            head = appender.state.head()
            copy_rows(store, rows, appender, 0 if head is None else head.version + 1, source, destination, change, clock(), bot)
    clocks = into.state(f"{job}/clock", CLOCK_STATE).load().agg(F.max("clock")).first()[0]
    return 0 if clocks is None else clocks + 1


def read_position(batch: DataFrame, bot: str, queue: str, now: int) -> DataFrame:
    """Checkpoint row of a bot that has read a batch; no row for an empty batch."""
    last = batch.agg(
        F.max("eid").alias("eid"), F.count("*").alias("units"), F.max("source_ms").alias("source_timestamp")
    ).filter(F.col("units") > 0)
    return last.select(
        F.lit(bot).alias("id"), F.lit(names.canonical_text(queue)).alias("queue"), F.lit("read").alias("type"),
        "eid", "units", "source_timestamp",
        F.lit(now).cast("bigint").alias("started_timestamp"), F.lit(now).cast("bigint").alias("ended_timestamp"),
    )


def positions_of(store: QueueStore, bot: str) -> DataFrame:
    """Where a bot is in the queues it reads."""
    return store.state(f"{bot}/positions", POSITION_STATE).load()


def watch_bots(
    store: QueueStore, change_rows: DataFrame, bot: str = monitor.MONITOR_BOT, clock: Callable[[], int] = now_ms,
    **trigger,
) -> StreamingQuery:
    """Write monitoring facts about changed bots to the monitor queue."""

    def work(batch: DataFrame, version: int) -> None:
        appender = Appender(store, bot)
        if appender.done(version):
            return
        now = clock()
        facts = monitor.monitor_feed(feed.typed_changes(batch, BOT_IMAGE), bot)
        payload = F.to_json(F.struct(*[F.col(c) for c in facts.columns]))
        rows = facts.select(payload.alias("payload"), F.col("start").alias("source_ms"))
        # Facts are distinct texts, which also orders them.
        rows = rows.withColumn("part", F.xxhash64("payload") % 64)
        events = bot_rows(rows, bot, MONITOR_QUEUE, now)
        appender.append(events, bot_clock(store.spark, bot, now), version, ["part"], ["payload"])

    return start_batches(store, change_rows, bot, work, **trigger)


def trigger_bots(
    store: QueueStore, change_rows: DataFrame, bots: Callable[[], DataFrame], job: str = "triggers",
    clock: Callable[[], int] = now_ms, **trigger,
) -> StreamingQuery:
    """Request the new positions of changed queues from the bots they trigger.

    ``bots`` is read again for every batch.
    """
    table = store.state(f"{job}/requests", REQUEST_STATE)

    def work(batch: DataFrame, version: int) -> None:
        current = table.version()
        if current is not None and current >= version:
            return
        rows = triggers.trigger_rows(feed.typed_changes(batch, QUEUE_IMAGE), bots())
        table.commit(merges.merge_requested(table.load(), rows, clock()), version)

    return start_batches(store, change_rows, job, work, **trigger)


def roll_up(store: QueueStore, today: str, job: str = "archive", seconds: float | None = None, queues: int = 100) -> DataFrame:
    """Archive the candidate queues; returns the manifest of what was archived.

    Events past each queue's archive end are written, in order, to its archive queue; archive
    ends and what was archived change in the same commit. What another writer later adds
    behind the end is archived next time. With ``seconds`` the stalest ``queues`` queues are
    taken at a time, each time in a commit of its own, and no more once half of the time is
    over: a run that stops, or dies, goes on with the rest next time.
    """
    if seconds is None:
        return _roll_up(store, today, job, None)
    began, manifest = time.monotonic(), _roll_up(store, today, job, queues)
    while time.monotonic() - began < seconds / 2:
        more = _roll_up(store, today, job, queues)
        if more.isEmpty():
            break
        manifest = manifest.unionByName(more)
    return manifest


def _roll_up(store: QueueStore, today: str, job: str, most: int | None) -> DataFrame:
    store.recover()
    spark, state, head = store.spark, store.job(job), store.job(job).head()
    version = 0 if head is None else head.version + 1
    done = state.load("batches", BATCH_STATE, head)
    # Queue and batch are names of folders: no file is opened to find the new batches.
    found = spark.createDataFrame(store.batches(), "queue string, batch string")
    fresh = found.withColumns({"job": batch_job(F.col("batch")), "version": batch_version(F.col("batch"))})
    upto = done.select("queue", "job", F.col("version").alias("_upto"))
    fresh = fresh.join(upto, ["queue", "job"], "left").filter(F.col("_upto").isNull() | (F.col("version") > F.col("_upto")))
    fresh = work_table(fresh.drop("_upto"), "batches")
    known = done.select("queue").distinct()
    states = queue_states(store)
    first = archive.archive_candidates(states, today).join(known, "queue", "left_anti").select("queue", "archive_end", "max_eid")
    again = archive.open_queues(states, today).join(known, "queue", "left_semi").join(fresh, "queue", "left_semi")
    taken = first.withColumn("late", F.lit(False)).unionByName(again.select(*first.columns).withColumn("late", F.lit(True)))
    taken = work_table(taken if most is None else taken.orderBy("archive_end", "queue").limit(most), "archived-queues")
    batches = fresh.join(taken.select("queue"), "queue", "left_semi")
    events, columns = store.events(), [f.name for f in STORED]
    new = archive.to_archive(events, taken.filter(~F.col("late")).drop("late")).join(hint_small(batches.select("queue", "batch")), ["queue", "batch"], "left_semi")
    late = events.join(hint_small(batches.join(taken.filter("late"), "queue", "left_semi").select("queue", "batch")), ["queue", "batch"], "left_semi")
    batch = f"{job}-{version}-{uuid.uuid4().hex[:12]}"
    store.stage_sorted(archive.as_archive_rows(new.select(*columns).unionByName(late.select(*columns))), job, batch)
    written = store.staged(job, batch).withColumn("queue", names.parent_of(F.col("queue")))
    manifest = work_table(archive.archive_chunks(written, "batch_ms"), "manifest")
    ends = manifest.groupBy("queue").agg(F.max("end").alias("max_eid"))
    parents = ends.select(names.parent_of(F.col("queue")).alias("queue"), F.col("max_eid").alias("archive_end"))
    rows = ends.withColumn("v", F.lit(ROW_VERSION)).unionByName(parents, allowMissingColumns=True)
    marks = merges.upsert(state.load("queues", QUEUE_STATE, head), rows, ["queue"], highest=("max_eid", "archive_end"))
    # A row per queue and job: versions of a job become visible in order.
    memory = done.unionByName(batches.select("queue", "job", "version")).groupBy("queue", "job").agg(F.max("version").alias("version"))
    tables = {
        "queues": state.stage("queues", QUEUE_STATE, marks, version),
        "batches": state.stage("batches", BATCH_STATE, memory, version),
    }
    state.commit(version, tables, head, batch)
    store.publish(job, batch)
    return manifest


def expire(store: QueueStore, now_s: int) -> DataFrame:
    """The store's events that are still retained."""
    return normalize.retained(store.events(), now_s)


def drop_expired_days(store: QueueStore, now_s: int, ttl_seconds: int = normalize.TTL_SECONDS) -> list[str]:
    """Delete the day folders whose every event has expired; returns what was deleted.

    Only folder names are read. Archives stay, and so do snapshots, whose days
    are not the days of their expiry.
    """
    end = datetime.fromtimestamp(now_s - ttl_seconds, UTC).strftime("%Y-%m-%d")
    dropped = []
    for folder in folders.children(store.spark, store.events_path):
        queue = unquote(folder.removeprefix("queue="))
        if folder.startswith("queue=") and not queue.endswith((names.ARCHIVE_SUFFIX, names.SNAPSHOT_SUFFIX)):
            dropped += [f"{folder}/date={day}" for day in store.drop_days(queue, end)]
    return dropped


def whole_history(store: QueueStore) -> DataFrame:
    """Archived and live events of every queue, each once."""
    return archive_then_live(store.events(), queue_states(store), store.state("archive/batches", BATCH_STATE).load())
