"""Bus ingest: encoded records to numbered events, queue marks and bot checkpoints."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.times import div, parse_ms
from ..operators import intervals, normalize, runlog, stats
from ..session import work_dir, work_table
from ..sources import folders
from ..sources import records as rec
from ..sources.queues import QueueStore
from .appending import Appender, Batch


# Numbers of a shard that were delivered; see ``operators.intervals``.
DELIVERY = T.StructType([
    T.StructField("shard", T.StringType()),
    T.StructField("head", T.StringType()),
    T.StructField("low", T.LongType()),
    T.StructField("high", T.LongType()),
    T.StructField("first_ms", T.LongType()),
    T.StructField("last_ms", T.LongType()),
    T.StructField("batch", T.LongType()),
])
# After so many batches their deliveries become one table.
MERGED_BATCHES = 50


def now_ms() -> int:
    return int(time.time() * 1000)


class Ingest:
    """Settings and per-batch work of an ingest job."""

    def __init__(
        self,
        store: QueueStore,
        job: str = "ingest",
        skip_queues: Iterable[str] = (),
        skip_bots: Iterable[str] = (),
        clock: Callable[[], int] = now_ms,
        bulk_records_per_file: int = 5_000_000,
        log_sizes: bool = False,
    ):
        self.store, self.job, self.clock = store, job, clock
        self.skip_queues, self.skip_bots = list(skip_queues), list(skip_bots)
        self.bulk_records_per_file, self.log_sizes = bulk_records_per_file, log_sizes

    def run_batch(self, records: DataFrame, version: int) -> None:
        """One micro-batch. Records arrive per shard; a shard's records form one batch."""
        appender = Appender(self.store, self.job)
        if appender.done(version):
            return
        began = self.clock()
        records = self._first_deliveries(records, version).persist(StorageLevel.MEMORY_AND_DISK)
        lines = rec.flat_lines(rec.parsed_lines(rec.decoded_texts(records))).persist(StorageLevel.MEMORY_AND_DISK)
        rows, bad = rec.good_and_bad(lines)
        try:
            keys = records.select("shard", "sequence", "arrival_ms")
            intervals.of_records(keys).write.mode("overwrite").parquet(f"{self._deliveries()}/batch={version}")
            bad.write.mode("overwrite").parquet(f"{self.store.root}/quarantine/{self.job}/batch={version}")
            self._choose_file_size(appender, keys)
            markers = self._markers(rows)
            valid = normalize.valid_bus_events(normalize.data_rows(rows))
            valid = normalize.without_listed(valid, self.skip_queues, self.skip_bots)
            if self.log_sizes:
                # Sizes are those of events as they came, before defaults.
                sizes = stats.size_by_bot(valid, rec.event_json(valid))
                sizes.write.mode("overwrite").parquet(f"{self.store.root}/sizes/{self.job}/batch={version}")
            events = normalize.with_times(normalize.with_queue(valid), self.clock())
            events = (
                events.withColumn("second", div(F.col("arrival_ms"), 1000))
                .withColumn("digits", F.length("sequence"))
                .withColumnRenamed("start", "archive_start").withColumnRenamed("end", "archive_end")
            )
            firsts = records.groupBy("shard").agg(
                F.min_by("sequence", F.struct("arrival_ms", F.length("sequence"), "sequence")).alias("sequence"),
                F.min("arrival_ms").alias("value"), F.count("*").alias("records"), F.sum(F.length("data")).alias("chars"),
            )
            # One row a shard: what arrived, as it came.
            arrived = work_table(firsts, "arrivals")
            arrived.select("shard", "records", "chars").write.mode("overwrite").parquet(
                f"{self.store.root}/arrivals-of/{self.job}/batch={version}"
            )
            stored = appender.append(
                events, arrived, version, ["second"], ["arrival_ms", "digits", "sequence", "line"], markers=markers
            )
            self._log_run(stored, version, began)
            self._merge_deliveries(version)
        finally:
            lines.unpersist()
            records.unpersist()

    def _log_run(self, stored: Batch | None, version: int, began: int) -> None:
        """One line about the batch: its times, and its events as units."""
        took = max(self.clock() - began, 0)
        run = {
            "identifier": self.job, "id": self.job, "options": None, "runs": 1, "start": began, "end": began + took,
            "units": stored.records if stored else 0, "duration": float(took), "min_duration": float(took), "max_duration": float(took),
            "consumption": 0, "errors": 0, "completions": 1,
        }
        kinds = ", ".join(f"{k} {'string' if k in ('identifier', 'id', 'options') else 'double' if 'duration' in k else 'bigint'}" for k in run)
        rows = self.store.spark.createDataFrame([tuple(run.values())], kinds)
        lines = runlog.run_lines(rows).select("line")
        lines.write.mode("overwrite").text(f"{self.store.root}/runs/{self.job}/batch={version}")

    def _deliveries(self) -> str:
        return f"{self.store.root}/deliveries/{self.job}"

    def _first_deliveries(self, records: DataFrame, version: int) -> DataFrame:
        """The records that no earlier batch has stored, each once.

        A record that is delivered again keeps its shard, sequence and arrival, so only
        what arrived in this batch's span is compared, however late the batch is.
        """
        fresh = records.dropDuplicates(["shard", "sequence"])
        if not folders.exists(self.store.spark, self._deliveries()):
            return fresh
        first, last = records.agg(F.min("arrival_ms"), F.max("arrival_ms")).first()
        known = self._delivered().filter(
            (F.col("batch") < version) & (F.col("first_ms") <= last) & (F.col("last_ms") >= first)
        )
        return fresh.join(intervals.unknown(fresh, known), ["shard", "sequence"], "left_semi").select(*records.columns)

    def _delivered(self) -> DataFrame:
        return self.store.spark.read.schema(DELIVERY).parquet(self._deliveries())

    def _merge_deliveries(self, version: int) -> None:
        """Put the deliveries of earlier batches together. A crash in between leaves some of them twice, which changes nothing."""
        spark, kept = self.store.spark, folders.children(self.store.spark, self._deliveries())
        if len(kept) <= MERGED_BATCHES:
            return
        # The last of them stays as it is: a batch that runs again replaces its own.
        old = sorted((n for n in kept if n.startswith("batch=")), key=lambda n: int(n.removeprefix("batch=")))[:-1]
        newest = int(old[-1].removeprefix("batch="))
        rows = intervals.intervals(self._delivered().filter(F.col("batch") <= newest).drop("batch"))
        path = work_dir(spark, "deliveries")
        rows.write.parquet(path)
        # Beside the newest of them, before the others go.
        for file in folders.files(spark, path):
            folders.move(spark, file, f"{self._deliveries()}/{old[-1]}/{file.rsplit('/', 1)[1]}")
        for name in old[:-1]:
            folders.delete(spark, f"{self._deliveries()}/{name}")

    def _choose_file_size(self, appender: Appender, records: DataFrame) -> None:
        """A late or large batch is cut into files of bounded size."""
        backlog = normalize.batch_backlog(records, self.clock(), ["shard"])
        bulk = backlog.agg(F.bool_or("bulk")).first()[0]
        appender.max_records_per_file = self.bulk_records_per_file if bulk else 0

    @staticmethod
    def _markers(rows: DataFrame) -> DataFrame:
        commands = normalize.snapshot_commands(rows).select(
            "event",
            parse_ms(F.col("start")).alias("start_ms"),
            parse_ms(F.col("next")).alias("next_ms"),
            F.struct("arrival_ms", "sequence", "line").alias("seq"),
        )
        return stats.snapshot_markers(commands)

    def start(self, records: DataFrame, **trigger) -> StreamingQuery:
        """Run over a record stream; by default over what there is, then stop."""
        return (
            records.writeStream.queryName(f"{self.job}-{self.store.root.rsplit('/', 1)[-1]}")
            .option("checkpointLocation", self.store.checkpoint_path(self.job))
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(self.run_batch)
            .start()
        )
