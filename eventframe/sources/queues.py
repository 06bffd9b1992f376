"""The queue store: events as Parquet by queue and day, read by position."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, positions
from ..operators.running import RANGE, in_ranges, rows_to_here
from ..schemas import STORED
from ..session import hint_small, work_table
from . import folders
from .files import lines_of
from .records import envelopes, parsed_lines
from .state import JobState, StateTable

# Fixed value: bytes of one read unless the caller says otherwise.
READ_BYTES = 1024 * 1024

# Characters of a position that leave the last three digits of its counter open.
_THOUSAND = 37

# Up to so many events one task finds the first ones; more are cut by ranges.
SMALL_PAGE = 10_000

# Columns of the files below one queue's folder.
_FOLDER = T.StructType([f for f in STORED if f.name != "queue"])

# Characters that partition folder names hold in escaped form.
_ESCAPED = set("\"#%'*/:=?\\{}[]^\x7f") | {chr(i) for i in range(1, 32)}


def partition_name(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)


@dataclass(frozen=True)
class DataFile:
    """A file of a queue and what its name tells: first and last position, rows, payload bytes, pointers among the rows."""

    path: str
    first: str
    last: str
    records: int
    size: int
    pointers: int

    @staticmethod
    def name(first: str, last: str, records: int, size: int, pointers: int, number: int) -> str:
        return f"{_coded(first)}~{_coded(last)}~{records}~{size}~{pointers}~{number}.parquet"

    @staticmethod
    def of(path: str) -> DataFile:
        first, last, *counts = path.rsplit("/", 1)[1].removesuffix(".parquet").split("~")
        records, size, pointers, _ = map(int, counts)
        return DataFile(path, _decoded(first), _decoded(last), records, size, pointers)


def _coded(eid: str) -> str:
    """A position as part of a file name."""
    return "".join("_" if c == "/" else c if c.isascii() and (c.isalnum() or c == "-") else f"+{ord(c):06x}" for c in eid)


def _decoded(name: str) -> str:
    return re.sub(r"\+([0-9a-f]{6})", lambda m: chr(int(m[1], 16)), name.replace("_", "/"))


# What a job calls its batches: its name, the version, and a token of the attempt.
_BATCH = r"^(.*)-(\d+)-[0-9a-f]{12}$"


def batch_job(batch: Column) -> Column:
    """The job of a batch; a batch without one is its own."""
    return F.when(batch.rlike(_BATCH), F.regexp_extract(batch, _BATCH, 1)).otherwise(batch)


def batch_version(batch: Column) -> Column:
    return F.when(batch.rlike(_BATCH), F.regexp_extract(batch, _BATCH, 2).try_cast("bigint")).otherwise(F.lit(0)).cast("bigint")


class QueueStore:
    """A folder holding events, state tables and stream checkpoints.

    Events of a batch are staged first. Once the batch is committed its folders are moved to
    their queues, each queue's day at once, so no reader sees a part of a batch's day, or
    events whose batch was never committed. A move that a crash has cut off is finished by
    the next reader or writer.
    """

    def __init__(self, spark: SparkSession, root: str, chunks: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.events_path = f"{self.root}/events"
        # Where chunks lie whose pointers name no folder.
        self.chunks = chunks or f"{self.root}/chunks"

    def checkpoint_path(self, name: str) -> str:
        return f"{self.root}/checkpoints/{partition_name(name)}"

    def job(self, name: str) -> JobState:
        return JobState(self.spark, f"{self.root}/state/{name}")

    def state(self, name: str, schema: T.StructType) -> StateTable:
        """A table of a job's state, named ``job/table``."""
        job, _, table = name.rpartition("/")
        return StateTable(self.spark, f"{self.root}/state/{job}", schema, table=table)

    def lane(self, owner: str) -> int:
        """The lane of a producer's shard: a number of the store that nobody else gets."""
        known = f"{self.root}/lanes/owners/{partition_name(owner)}"
        found = folders.read_text(self.spark, known)
        if found is not None:
            return int(found)
        taken = [n for n in folders.children(self.spark, f"{self.root}/lanes") if n.isdigit()]
        number = len(taken)
        while not folders.create(self.spark, f"{self.root}/lanes/{number:06d}", owner):
            number += 1
        if number >= positions.LANES:
            raise ValueError(f"{self.root}: no lane is left")
        # Whoever asks for the same owner at the same time gets the lane that was noted first.
        folders.create(self.spark, known, str(number))
        return int(folders.read_text(self.spark, known))

    def _queue_path(self, name: str) -> str:
        return f"{self.events_path}/queue={partition_name(names.canonical_text(name))}"

    def events(self) -> DataFrame:
        """All stored events."""
        self.recover()
        if not folders.exists(self.spark, self.events_path):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(self.events_path)

    def queue(self, name: str) -> DataFrame:
        """Stored events of one queue; no other queue's folder is listed."""
        self.recover()
        path = self._queue_path(name)
        if not folders.exists(self.spark, path):
            return self.spark.createDataFrame([], STORED)
        rows = self.spark.read.schema(_FOLDER).parquet(path)
        return rows.withColumn("queue", F.lit(names.canonical_text(name)))

    def stream(self, queue: str, max_files: int = 1000) -> DataFrame:
        """New events of one queue; only that queue's folder is listed."""
        self.recover()
        name = names.canonical_text(queue)
        rows = self.spark.readStream.schema(_FOLDER).option("maxFilesPerTrigger", max_files).parquet(self._queue_path(name))
        return rows.withColumn("queue", F.lit(name))

    def days(self, queue: str, start: str | None = None) -> list[str]:
        """A queue's days that can hold positions from ``start`` on, oldest first."""
        first = positions.first_day(start) or ""
        found = folders.children(self.spark, self._queue_path(queue))
        return [d.removeprefix("date=") for d in found if d.startswith("date=") and d.removeprefix("date=") >= first]

    def retained_from(self, queue: str) -> str:
        """The first day that no retention has dropped from a queue; empty if none was dropped."""
        return max(folders.children(self.spark, f"{self.root}/retained/{partition_name(names.canonical_text(queue))}"), default="")

    def drop_days(self, queue: str, before: str) -> list[str]:
        """Delete a queue's days before one day. Readers that are behind take them from the archive from now on."""
        name = names.canonical_text(queue)
        dropped = [d for d in self.days(name) if d < before]
        if dropped:
            folders.create(self.spark, f"{self.root}/retained/{partition_name(name)}/{before}")
        for day in dropped:
            folders.delete(self.spark, f"{self._queue_path(name)}/date={day}")
        return dropped

    def history(self, queue: str, start: str | None = None) -> Iterator[list[DataFile]]:
        """Files of a queue that can hold positions from ``start`` on, day by day; only folders are listed.

        Days that retention has dropped come from the queue's archive, together with what was
        written to them since; all others from the live queue.
        """
        name = names.canonical_text(queue)
        archived, kept = f"{name}{names.ARCHIVE_SUFFIX}", self.retained_from(name)
        old = {d for d in self.days(archived, start) if d < kept} if kept else set()
        for day in sorted({*self.days(name, start), *old}):
            places = [name, archived] if day in old else [name]
            paths = [p for q in places for p in folders.files(self.spark, f"{self._queue_path(q)}/date={day}")]
            yield [f for f in map(DataFile.of, paths) if start is None or f.last >= start]

    def page_files(self, queue: str, start: str | None = None, limit: int | None = None, size: int | None = None) -> list[DataFile]:
        """The files that hold the next ``limit`` events, or ``size`` bytes and an event, after ``start``.

        Files that lie wholly after ``start`` count with all their events. Once those that end
        by some position are enough, the page ends there, and later days are not listed.
        """
        # The pointer row of a position inside a chunk comes before it.
        begin = positions.pointer_text(start)
        seen: list[DataFile] = []
        for files in self.history(queue, begin):
            seen.extend(files)
            records = total = 0
            for file in sorted(seen, key=lambda f: f.last):
                if start is None or file.first > start:
                    records, total = records + file.records, total + file.size
                if (limit is not None and records >= limit) or (size is not None and total > size and records):
                    return [f for f in seen if f.first <= file.last]
        return seen

    def batches(self) -> list[tuple[str, str]]:
        """Live queues and their batches, from the names of folders."""
        found = set()
        for folder in folders.children(self.spark, self.events_path):
            queue = unquote(folder.removeprefix("queue="))
            if folder.startswith("queue=") and not queue.endswith((names.ARCHIVE_SUFFIX, names.SNAPSHOT_SUFFIX)):
                for day in self.days(queue):
                    parts = folders.children(self.spark, f"{self.events_path}/{folder}/date={day}")
                    found |= {(queue, unquote(p.removeprefix("batch="))) for p in parts if p.startswith("batch=")}
        return sorted(found)

    def manifest(self, queue: str) -> DataFrame:
        """The chunks of a queue: where each begins and ends, its events, bytes and batch. No file is opened."""
        self.recover()
        name = names.canonical_text(queue)
        rows = [
            (name, f.first, f.last, f.records, f.size, unquote(re.search(r"/batch=([^/]*)/", f.path)[1]))
            for files in self.files(name) for f in files
        ]
        return self.spark.createDataFrame(rows, "queue string, start string, end string, records bigint, size bigint, batch string")

    def files(self, queue: str) -> Iterator[list[DataFile]]:
        """A live queue's files day by day."""
        for day in self.days(queue):
            yield [DataFile.of(p) for p in folders.files(self.spark, f"{self._queue_path(queue)}/date={day}")]

    def read_files(self, queue: str, files: list[DataFile]) -> DataFrame:
        """The rows of files of a queue and its archive; a row that lies in both comes once."""
        name = names.canonical_text(queue)
        if not files:
            return self.spark.createDataFrame([], STORED)
        rows = self.spark.read.schema(STORED).option("basePath", self.events_path).parquet(*sorted(f.path for f in files))
        archive = f"{self._queue_path(f'{name}{names.ARCHIVE_SUFFIX}')}/"
        if any(archive.removeprefix("file:") in f.path for f in files):
            rows = rows.dropDuplicates(["eid"])
        return rows.withColumn("queue", F.lit(name))

    def page(self, queue: str, start: str | None = None, limit: int | None = None, size: int | None = None) -> DataFrame:
        """The next events of a queue after ``start``, at most ``limit`` and ``size`` bytes of them, in order.

        The plan names the files of the page and no others. Days that were dropped come from
        the archive. Events of chunks that rows point to have positions inside the row's own,
        so a page may end within a chunk.
        """
        self.recover()
        files = self.page_files(queue, start, limit, size)
        rows = after(self.read_files(queue, files), queue, positions.pointer_text(start), inclusive=True)
        if any(f.pointers for f in files):
            rows = expand_chunks(self.spark, rows, self.chunks)
        if start:
            rows = rows.filter(F.col("eid") > start)
        if limit is not None and limit <= SMALL_PAGE:
            rows, limit = rows.orderBy("eid").limit(limit), None
        if limit is not None or size is not None:
            rows = first_rows(work_table(rows, "page-rows"), limit, size)
        return rows.orderBy("eid")

    def append(self, rows: DataFrame, batch: str, max_records_per_file: int = 0) -> None:
        """Write events of one batch that belongs to no job; the same batch written again replaces itself."""
        self.stage(rows, "", batch, max_records_per_file)
        self.publish("", batch, replace=True)

    def append_sorted(self, rows: DataFrame, batch: str) -> None:
        """As ``append``, for data that is read often: an hour of a queue lies together and in order."""
        self.stage_sorted(rows, "", batch)
        self.publish("", batch, replace=True)

    def _staged(self, job: str, batch: str) -> str:
        # A name for events without a job that no job has.
        return f"{self.root}/staged/{partition_name(job) or '-'}/{partition_name(batch)}"

    def stage(self, rows: DataFrame, job: str, batch: str, max_records_per_file: int = 0, placed: bool = False) -> list[DataFile]:
        """Write a batch's events where no reader looks; returns its files.

        Rebalancing gathers the rows of a queue and day into files of the
        advised size and splits those of a hot queue over several tasks. Rows that
        are ``placed`` lie together by queue and order: their tasks write them as they are.
        """
        stored = _stored(rows, batch)
        return self._write(stored if placed else stored.hint("rebalance", "queue", "date"), job, batch, max_records_per_file)

    def stage_sorted(self, rows: DataFrame, job: str, batch: str) -> list[DataFile]:
        """As ``stage``, gathered by queue and hour.

        Reads by position skip the files and row groups of other hours. Unlike range
        partitioning this needs no sampling pass over the rows.
        """
        gathered = _stored(rows, batch).withColumn("_hour", F.substring("eid", 1, 15)).hint("rebalance", "queue", "_hour")
        return self._write(gathered.drop("_hour"), job, batch)

    def staged(self, job: str, batch: str) -> DataFrame:
        """The events of a staged batch."""
        return self.spark.read.schema(STORED).parquet(self._staged(job, batch))

    def _write(self, rows: DataFrame, job: str, batch: str, max_records_per_file: int = 0) -> list[DataFile]:
        path = self._staged(job, batch)
        (
            # In the order of the folders, which the writer would sort by otherwise.
            rows.sortWithinPartitions("queue", "date", "batch", "eid")
            .write.mode("overwrite")
            .option("maxRecordsPerFile", max_records_per_file)
            .partitionBy("queue", "date", "batch")
            .parquet(path)
        )
        spans = _spans(self.staged(job, batch))
        written: list[DataFile] = []
        for number, row in enumerate(spans.toLocalIterator()):
            folder, _, _ = unquote(row["file"]).rpartition("/")
            name = DataFile.name(row["first"], row["last"], row["records"], row["size"] or 0, row["pointers"], number)
            folders.move(self.spark, unquote(row["file"]), f"{folder}/{name}")
            written.append(DataFile.of(f"{folder}/{name}"))
        return written

    def publish(self, job: str, batch: str, replace: bool = False) -> None:
        """Move a staged batch's folders to their queues, older days first; what was moved before stays."""
        path = self._staged(job, batch)
        for queue in folders.children(self.spark, path):
            for day in folders.children(self.spark, f"{path}/{queue}") if queue.startswith("queue=") else ():
                for part in folders.children(self.spark, f"{path}/{queue}/{day}"):
                    target = f"{self.events_path}/{queue}/{day}/{part}"
                    if replace:
                        folders.delete(self.spark, target)
                    folders.move(self.spark, f"{path}/{queue}/{day}/{part}", target)
        folders.delete(self.spark, path)

    def recover(self) -> None:
        """Finish the moves of committed batches that a crash has cut off."""
        for job in folders.children(self.spark, f"{self.root}/staged"):
            if job == "-":
                continue
            waiting = folders.children(self.spark, f"{self.root}/staged/{job}")
            head = self.job(unquote(job)).head() if waiting else None
            if head and head.batch and partition_name(head.batch) in waiting:
                self.publish(unquote(job), head.batch)

    def drop_staged(self, job: str, batch: str) -> None:
        folders.delete(self.spark, self._staged(job, batch))


def _spans(rows: DataFrame) -> DataFrame:
    """One row per file: first and last position, rows, bytes, pointers. Only positions and sizes are read.

    The least and greatest text of a group come out of a sort of its rows. So beginnings of
    positions are counted first, by hash, and only the outermost of a file are looked into.
    """
    rows = rows.select(
        F.col("_metadata.file_path").alias("file"), F.substring("eid", 1, _THOUSAND).alias("begin"), "eid", "size", F.col("s3.key").alias("key")
    )
    parts = rows.groupBy("file", "begin").agg(F.count("*").alias("records"), F.sum("size").alias("size"), F.count("key").alias("pointers"))
    files = parts.groupBy("file").agg(
        F.min("begin").alias("low"), F.max("begin").alias("high"),
        F.sum("records").alias("records"), F.sum("size").alias("size"), F.sum("pointers").alias("pointers"),
    )
    outer = rows.select("file", "begin", "eid").join(F.broadcast(files), "file").filter(F.col("begin").isin(F.col("low"), F.col("high")))
    return outer.groupBy("file", "records", "size", "pointers").agg(F.min("eid").alias("first"), F.max("eid").alias("last"))


def _stored(rows: DataFrame, batch: str) -> DataFrame:
    """Rows with the columns of the store."""
    given = {"date": positions.day_of(F.col("eid")), "batch": F.lit(batch), "size": event_bytes()}
    empty = {"lane": F.lit(0), "archive_start": F.lit(None)}
    given |= {name: value for name, value in empty.items() if name not in rows.columns}
    return rows.withColumns(given).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STORED])


def after(
    events: DataFrame, queue: str, start: str | None = None, until: str | None = None, inclusive: bool = False
) -> DataFrame:
    """Events of one queue after ``start`` (or from it on, if ``inclusive``), up to ``until`` (inclusive).

    The queue and the first day are partition filters; the position range
    reaches the Parquet statistics.
    """
    rows = events.filter(F.col("queue") == names.canonical_text(queue))
    if "date" in events.columns:
        if first := positions.first_day(start):
            rows = rows.filter(F.col("date") >= first)
        if until and (last := positions.first_day(until)) and len(last) == len("yyyy-MM-dd"):
            rows = rows.filter(F.col("date") <= last)
    if start:
        rows = rows.filter(F.col("eid") >= start if inclusive else F.col("eid") > start)
    return rows.filter(F.col("eid") <= until) if until else rows


def read(events: DataFrame, queue: str, start: str | None = None, limit: int | None = None) -> DataFrame:
    """Events of a queue in position order, at most ``limit`` of them."""
    rows = after(events, queue, start).orderBy("eid")
    return rows if limit is None else rows.limit(limit)


def event_bytes() -> Column:
    return F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint")


def capped(rows: DataFrame, size: int = READ_BYTES) -> DataFrame:
    """The longest run of first events, in position order, whose payloads fit ``size`` bytes.

    The first event is always among them, so that one larger than ``size`` stops no reader.
    Minutes are totalled first, which tells the minute that crosses the limit.
    It bounds the positions to read, and only rows up to it are put in ranges.
    """
    sized = rows.select(F.substring("eid", 1, 19).alias("_minute"), event_bytes().alias("_bytes"))
    # One row per minute of the queue's life: a few million in ten years.
    in_order = Window.partitionBy(F.lit(0)).orderBy("_minute").rowsBetween(*rows_to_here())
    minutes = sized.groupBy("_minute").agg(F.sum("_bytes").alias("_sum"))
    minutes = minutes.withColumn("_before", F.sum("_sum").over(in_order) - F.col("_sum"))
    reached = minutes.filter((F.col("_before") < size) | (F.col("_before") == 0))
    last = reached.agg(F.max("_minute")).first()[0]
    if last is None:
        return rows.limit(0)
    # The character after "/" closes the range of positions of that minute.
    return first_rows(rows.filter(F.col("eid") < last[:-1] + "0"), size=size)


def first_rows(rows: DataFrame, limit: int | None = None, size: int | None = None) -> DataFrame:
    """The first rows in position order: at most ``limit`` of them, and the first one or ``size`` bytes of payloads.

    Positions are cut into ranges, whose totals tell the range in which the limit lies. Only
    there are rows counted one by one, so no task holds more than a range. Rows past the
    last position that belongs to the page are left out by a filter.
    """
    ranges = in_ranges(rows.select("eid", event_bytes().alias("_bytes")), ["eid"])
    totals = ranges.groupBy(RANGE).agg(F.count("*").alias("records"), F.sum("_bytes").alias("total")).orderBy(RANGE).collect()
    records = total = 0
    for cut in totals:
        if (limit is not None and records + cut["records"] > limit) or (size is not None and total + cut["total"] > size):
            break
        records, total = records + cut["records"], total + cut["total"]
    else:
        return rows
    keep, in_order = F.lit(True), Window.partitionBy(RANGE).orderBy("eid").rowsBetween(*rows_to_here())
    if limit is not None:
        keep = keep & (F.count("*").over(in_order) + records <= limit)
    if size is not None:
        first = ranges.agg(F.min("eid")).first()[0]
        keep = keep & ((F.sum("_bytes").over(in_order) + total <= size) | (F.col("eid") == first))
    inside = ranges.filter(F.col(RANGE) == cut[RANGE]).select("eid", keep.alias("_keep"))
    end = inside.filter(~F.col("_keep")).agg(F.min("eid")).first()[0]
    if end is None:
        # The range holds nothing but the first event, which is larger than ``size``.
        end = ranges.filter(F.col(RANGE) > cut[RANGE]).agg(F.min("eid")).first()[0]
        return rows if end is None else rows.filter(F.col("eid") < end)
    before = rows.filter(F.col("eid") < end)
    # Rows of one position that the limit divides.
    shared = inside.filter(F.col("_keep") & (F.col("eid") == end)).count()
    return before.unionByName(rows.filter(F.col("eid") == end).limit(shared)) if shared else before


# Characters of a position that name its day, hour and second.
_LEVELS = {"_day": 12, "_hour": 15, "_second": 29}


def unread(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """How many events each subscriber has yet to read.

    No event is paired with a subscriber. Events are counted by second, those by hour and
    day; what lies before a checkpoint is the days before its own, the hours before its own
    in that day, and so on. Each level is opened only where a checkpoint lies, down to the
    events of its second. ``subscribers``: id, queue, checkpoint (null: has read nothing).
    """
    marks = subscribers.select("id", "queue", F.coalesce("checkpoint", F.lit(positions.START)).alias("eid"))
    parts = {name: F.substring("eid", 1, size) for name, size in _LEVELS.items()}
    marks = work_table(marks.withColumns(parts), "checkpoints")
    seconds = events.withColumns(parts).groupBy("queue", *_LEVELS).agg(F.count("*").alias("_n"))
    seconds = work_table(seconds, "seconds")
    found, parent = marks, ["queue"]
    for level in _LEVELS:
        found = found.join(_before(seconds, marks, parent, level), [*parent, level], "left")
        parent = [*parent, level]
    # Within a second the events themselves; one at the very position of a checkpoint has been read.
    open_seconds = marks.select(*parent).distinct()
    rows = events.withColumns(parts).join(hint_small(open_seconds), parent, "left_semi").select(*parent, "eid")
    rows = rows.withColumns({"id": F.lit(None).cast("string"), "_n": F.lit(1).cast("bigint"), "_mark": F.lit(False)})
    laid = rows.unionByName(marks.select(*parent, "eid", "id").withColumns({"_n": F.lit(0).cast("bigint"), "_mark": F.lit(True)}))
    in_order = Window.partitionBy(*parent).orderBy("eid", "_mark").rowsBetween(*rows_to_here())
    inner = laid.withColumn("_here", F.sum("_n").over(in_order)).filter("_mark").select(*parent, "eid", "id", "_here").distinct()
    counted = found.join(inner, [*parent, "eid", "id"])
    totals = seconds.groupBy("queue").agg(F.sum("_n").alias("_all"))
    read = F.col("_here")
    for level in _LEVELS:
        read = read + F.coalesce(f"_before{level}", F.lit(0))
    return counted.join(totals, "queue", "left").select(
        "id", "queue", F.col("eid").alias("position"), (F.coalesce("_all", F.lit(0)) - read).alias("unread")
    )


def _before(seconds: DataFrame, marks: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Per distinct checkpoint key of a level: the events of its parent before it."""
    keys = marks.select(*parent, level).distinct()
    inside = seconds if parent == ["queue"] else seconds.join(hint_small(marks.select(*parent).distinct()), parent, "left_semi")
    sums = inside.groupBy(*parent, level).agg(F.sum("_n").alias("_n")).withColumn("_mark", F.lit(False))
    laid = sums.unionByName(keys.withColumns({"_n": F.lit(0).cast("bigint"), "_mark": F.lit(True)}))
    laid = laid.groupBy(*parent, level).agg(F.sum("_n").alias("_n"), F.bool_or("_mark").alias("_mark"))
    in_order = Window.partitionBy(*parent).orderBy(level).rowsBetween(*rows_to_here())
    before = laid.withColumn(f"_before{level}", F.sum("_n").over(in_order) - F.col("_n"))
    return before.filter("_mark").select(*parent, level, f"_before{level}")


def archive_then_live(events: DataFrame, queues: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """Every queue from its beginning: archived events up to the archive end, then live ones.

    ``archived`` (queue, job, version) tells up to which version each job's batches of a queue
    are in the archive. Queues that it knows keep the live events of all other batches, also
    those that were written behind the archive end; of other queues the live events past the
    end are kept.
    """
    ends = hint_small(queues.select("queue", F.coalesce("archive_end", F.lit(positions.START)).alias("_end")))
    live = events.filter(~names.is_archive(F.col("queue")) & ~names.is_snapshot(F.col("queue")))
    live = live.join(ends, "queue", "left")
    keep = F.col("_end").isNull() | (F.col("eid") > F.col("_end"))
    if archived is not None:
        known = archived.select("queue").distinct().withColumn("_known", F.lit(True))
        live = live.withColumns({"_job": batch_job(F.col("batch")), "_version": batch_version(F.col("batch"))})
        live = live.join(hint_small(known), "queue", "left")
        upto = archived.select("queue", F.col("job").alias("_job"), F.col("version").alias("_upto"))
        live = live.join(hint_small(upto), ["queue", "_job"], "left")
        keep = F.when(F.col("_known"), F.coalesce(F.col("_version") > F.col("_upto"), F.lit(True))).otherwise(keep)
    live = live.filter(keep).select(*events.columns, "_end")
    old = events.filter(names.is_archive(F.col("queue"))).withColumn("queue", names.parent_of(F.col("queue")))
    old = old.join(ends, "queue").filter(F.col("eid") <= F.col("_end"))
    return old.withColumn("part", F.lit("archive")).unionByName(live.withColumn("part", F.lit("live"))).drop("_end")


def snapshot_then_tail(events: DataFrame, queues: DataFrame) -> DataFrame:
    """Every queue from its last snapshot: the snapshot's events, then live ones from where it ends."""
    marks = hint_small(
        queues.filter(F.col("snapshot_start").isNotNull()).select(
            "queue", F.replace("snapshot_start", F.lit("_snapshot/"), F.lit("")).alias("_from"),
            F.col("snapshot_next").alias("_next"),
        )
    )
    base = events.filter(names.is_snapshot(F.col("queue"))).withColumn("queue", names.parent_of(F.col("queue")))
    base = base.join(marks, "queue").filter(F.col("eid").startswith(F.col("_from")))
    live = events.filter(~names.is_archive(F.col("queue")) & ~names.is_snapshot(F.col("queue")))
    live = live.join(marks, "queue").filter(F.col("eid") >= F.col("_next"))
    return (
        base.withColumn("part", F.lit("snapshot")).unionByName(live.withColumn("part", F.lit("live")))
        .drop("_from", "_next")
    )


def expand_pointers(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Replace rows that point to a chunk file by the events in it.

    ``rows``: queue, eid, id, payload, write_ms, source_ms, s3.
    """
    columns = ["queue", "eid", "id", "payload", "write_ms", "source_ms"]
    inline = rows.filter(F.col("s3").isNull()).select(*columns)
    pointers = rows.filter(F.col("s3").isNotNull()).select("queue", F.col("s3.key").alias("key"))
    lines = lines_of(spark, pointers, root).select("queue", "text")
    chunk = envelopes(parsed_lines(lines)).withColumn("source_ms", F.col("source_ms").try_cast("bigint"))
    return inline.unionByName(chunk.select(*columns))


def expand_chunks(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Stored rows with every pointer replaced by the events of its chunk.

    The n-th line's event has the pointer's position with ``.n`` behind it. Lines that are no
    event count as lines. All other columns are the pointer's, but for payload, size, producer and times.
    """
    pointers = rows.filter(F.col("s3").isNotNull()).withColumnRenamed("id", "_producer")
    named = pointers.drop("payload", "size").withColumns({"bucket": F.col("s3.bucket"), "key": F.col("s3.key")})
    lines = lines_of(spark, named, root)
    in_order = Window.partitionBy("eid").orderBy("block", "row")
    lines = lines.withColumn("_line", F.row_number().over(in_order) - 1)
    taken = {"eid": "_at", "write_ms": "_write", "source_ms": "_source", "creator": "_creator", "queue": "_queue"}
    events = envelopes(parsed_lines(lines.withColumnsRenamed(taken).drop("block", "row", "bucket", "key", "s3")))
    events = events.withColumns({
        "eid": positions.inside(F.col("_at"), F.col("_line")), "queue": F.col("_queue"), "size": event_bytes(),
        "id": F.coalesce("id", "_producer"), "write_ms": F.coalesce("write_ms", "_write"),
        "source_ms": F.coalesce(F.col("source_ms").try_cast("bigint"), F.col("write_ms"), "_source"),
        "creator": F.coalesce("creator", "_creator"), "s3": F.lit(None).cast("struct<bucket:string,key:string>"),
    })
    return rows.filter(F.col("s3").isNull()).unionByName(events.select(*rows.columns))
