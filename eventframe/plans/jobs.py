"""Streaming jobs run to their end over the given tables, and what they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.times import DAY_MS, div
from ..schemas import BOT_STATE, QUEUE_STATE, REQUEST_STATE
from ..session import work_dir, work_table
from ..sources import changes as feed
from ..sources import files
from ..sources import records as rec
from ..sources.queues import QueueStore, after
from ..streaming import jobs
from ..streaming.appending import queue_states, write_events
from ..streaming.ingest import Ingest
from ..streaming.subscriber import Subscriber
from . import views
from .changing import _FANOUT, _FEED, change_records, queue_change_records
from .registry import query
from .views import NOW_MS, table

# Time given to the drain that is bounded; all other runs wait for their end.
DRAIN_SECONDS = 86_400.0
# Rows of one file of a job's input. A micro-batch takes a number of files, and costs seconds whatever they hold.
FILE_ROWS = 2_000_000


def clock() -> int:
    return NOW_MS


def finish(stream) -> None:
    stream.awaitTermination()


def file_count(spark: SparkSession, sf_dir: str, name: str, least: int) -> int:
    """Input files for a table's rows: ``least`` of them, and more once they would be large."""
    return max(least, table(spark, sf_dir, name).count() // FILE_ROWS)


def ingested(spark: SparkSession, sf_dir: str) -> QueueStore:
    """All events as encoded records, ingested as a stream in several micro-batches."""
    store = QueueStore(spark, work_dir(spark, "ingest"))
    arrivals = f"{store.root}/arrivals"
    # Written first: the ranges come from a sample, which would encode every record once more.
    records = work_table(views.encoded(spark, sf_dir, foreign=False).drop("pair"), "records")
    records.repartitionByRange(file_count(spark, sf_dir, "events", 6), "arrival_ms").write.json(arrivals)
    finish(Ingest(store, clock=clock).start(rec.stream_records(spark, arrivals, max_files=3)))
    return store


_INGESTED = """
    SELECT regexp_replace(event, '^queue:', '')
           || CASE WHEN archive THEN '/_archive' WHEN snapshot THEN '/_snapshot' ELSE '' END AS queue, *
    FROM base WHERE cmd IS NULL AND payload IS NOT NULL"""


@query("stream_ingest", f"""
    SELECT queue, count(*) AS records, CAST(sum(length(replace(payload, ' ', ''))) AS BIGINT) AS chars,
           CAST(sum(coalesce(write_ms, {NOW_MS})) AS BIGINT) AS write_sum,
           CAST(sum(coalesce(source_ms, write_ms, {NOW_MS})) AS BIGINT) AS source_sum
    FROM ({_INGESTED}) GROUP BY queue""", ("base",))
def stream_ingest(spark, sf_dir):
    """Bus ingest as a stream; what the queues hold at the end."""
    return ingested(spark, sf_dir).events().groupBy("queue").agg(
        F.count("*").alias("records"), F.sum(F.length("payload")).alias("chars"),
        F.sum("write_ms").alias("write_sum"), F.sum("source_ms").alias("source_sum"),
    )


@query("stream_ingest_state", f"""
    SELECT queue, TRUE AS marked, count(*) AS positions, CAST(2 AS INTEGER) AS v
    FROM ({_INGESTED}) WHERE NOT archive GROUP BY queue""", ("base",))
def stream_ingest_state(spark, sf_dir):
    """Queue state after a streamed ingest agrees with the stored events, and positions are distinct."""
    store = ingested(spark, sf_dir)
    held = store.events().filter(~names.is_archive(F.col("queue"))).groupBy("queue").agg(
        F.max("eid").alias("last"), F.count_distinct("eid").alias("positions")
    )
    marks = store.state("ingest/queues", QUEUE_STATE).load().select("queue", "max_eid", "v")
    return held.join(marks, "queue").select("queue", (F.col("last") == F.col("max_eid")).alias("marked"), "positions", "v")


@query("stream_ingest_bots", f"""
    SELECT DISTINCT id, queue FROM ({_INGESTED})""", ("base",))
def stream_ingest_bots(spark, sf_dir):
    """Write checkpoints a streamed ingest leaves: one per bot and queue."""
    bots = ingested(spark, sf_dir).state("ingest/bots", BOT_STATE).load()
    return bots.filter(F.col("checkpoint").isNotNull()).select("id", "queue")


@query("ingest_manifest", f"""
    SELECT queue, count(*) AS records, CAST(sum(octet_length(encode(replace(payload, ' ', '')))) AS BIGINT) AS size, TRUE AS spans
    FROM ({_INGESTED}) GROUP BY queue""", ("base",))
def ingest_manifest(spark, sf_dir):
    """The chunks that a streamed ingest wrote, from their names: events, bytes, and whether the spans hold the queue's ends."""
    store = ingested(spark, sf_dir)
    held = store.events().groupBy("queue").agg(F.min("eid").alias("first"), F.max("eid").alias("last"))
    chunks = None
    for queue in [r["queue"] for r in held.select("queue").collect()]:
        rows = store.manifest(queue)
        chunks = rows if chunks is None else chunks.unionByName(rows)
    summed = chunks.groupBy("queue").agg(
        F.sum("records").alias("records"), F.sum("size").alias("size"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    spans = (F.col("start") == F.col("first")) & (F.col("end") == F.col("last"))
    return summed.join(held, "queue").select("queue", "records", "size", spans.alias("spans"))


@query("ingest_runs", f"""
    SELECT (SELECT count(*) FROM ({_INGESTED})) AS units, TRUE AS sized""", ("base",))
def ingest_runs(spark, sf_dir):
    """Run lines of a streamed ingest: their units are the stored events; and every record's size is counted."""
    store = ingested(spark, sf_dir)
    lines = spark.read.text(f"{store.root}/runs/ingest").select(F.split("value", ":").alias("cells"))
    arrived = spark.read.parquet(f"{store.root}/arrivals-of/ingest").agg(F.sum("records").alias("records"), F.sum("chars").alias("chars"))
    given = spark.read.json(f"{store.root}/arrivals").agg(F.count("*").alias("given"), F.sum(F.length("data")).alias("length"))
    read, known = arrived.first(), given.first()
    units = lines.agg(F.sum(F.col("cells")[5].cast("bigint")).alias("units"))
    return units.withColumn("sized", F.lit(tuple(read) == tuple(known)))


@query("file_backfill", f"""
    SELECT regexp_replace(event, '^queue:', '') AS queue, 'firehose' AS creator, count(*) AS records,
           CAST(sum(coalesce(write_ms, {NOW_MS})) AS BIGINT) AS write_sum, count(payload) AS payloads
    FROM base WHERE (seq // 2) % 7 <> 0 AND (seq // 2) % 11 <> 0 GROUP BY 1""", ("base",))
def file_backfill(spark, sf_dir):
    """Files of encoded lines loaded into their queues; unknown texts are quarantined."""
    store = QueueStore(spark, work_dir(spark, "backfill"))
    folder = f"{store.root}/firehose"
    lines = views.encoded(spark, sf_dir).select(div(F.col("pair"), 20_000).alias("part"), "data")
    # A part in one task, and so in one file: the files grow with the rows, not with rows times tasks.
    lines.repartition(file_count(spark, sf_dir, "events", 4), "part").write.partitionBy("part").text(folder)
    finish(jobs.backfill(store, jobs.stream_file_lines(spark, folder), "loader", clock=clock))
    return store.events().groupBy("queue", "creator").agg(
        F.count("*").alias("records"), F.sum("write_ms").alias("write_sum"), F.count("payload").alias("payloads")
    )


@query("command_backfill", f"""
    SELECT regexp_replace(event, '^queue:', '') AS queue, count(*) AS records,
           CAST(sum(coalesce(write_ms, {NOW_MS})) AS BIGINT) AS write_sum,
           (SELECT CAST(ceil(count(DISTINCT seq // 2 % 120) / 100) AS BIGINT) FROM base) AS commands
    FROM base GROUP BY 1""", ("base",))
def command_backfill(spark, sf_dir):
    """Files found page by page, named in load commands, and loaded from them in order."""
    store = QueueStore(spark, work_dir(spark, "commands"))
    inbox = f"{store.root}/inbox"
    lines = views.encoded(spark, sf_dir, foreign=False).select((F.col("pair") % 120).alias("part"), "data")
    lines.repartition(file_count(spark, sf_dir, "events", 4), "part").write.partitionBy("part").text(f"{inbox}/firehose")
    while jobs.discover_files(store, inbox, clock=clock):
        continue
    finish(jobs.run_load_commands(store, inbox, "loader", clock=clock))
    loaded = store.events().filter(F.col("creator") == jobs.BACKFILL_CREATOR)
    return loaded.groupBy("queue").agg(
        F.count("*").alias("records"), F.sum("write_ms").alias("write_sum")
    ).withColumn("commands", F.lit(store.queue(files.COMMAND_QUEUE).count()).cast("bigint"))


def ordered(spark: SparkSession, sf_dir: str) -> QueueStore:
    """A queue of all orders, written by one bot."""
    store = QueueStore(spark, work_dir(spark, "orders"))
    key = F.col("o_orderkey")
    payload = F.to_json(F.struct(key.alias("a"), (key % 100 + 1).alias("b")))
    rows = table(spark, sf_dir, "orders").select(payload.alias("payload"), div(key, 4096).alias("stretch"), "o_orderkey")
    write_events(store, "writer", "orders", rows, ["stretch", "o_orderkey"], NOW_MS)
    return store


@query("replicate_queue", """
    SELECT 'orders-copy' AS queue, 'copier' AS id, '{"a":' || o_orderkey || ',"b":' || (o_orderkey % 100 + 1) || '}' AS payload,
           row_number() OVER (ORDER BY o_orderkey) - 1 AS counter
    FROM orders""")
def replicate_queue(spark, sf_dir):
    """A queue copied in order into another store."""
    store, target = ordered(spark, sf_dir), QueueStore(spark, work_dir(spark, "copy"))
    finish(jobs.copy_queue(store, "copier", "orders", "queue:orders-copy", target=target, clock=clock))
    return target.events().select("queue", "id", "payload", "counter")


@query("replicate_position", f"""
    SELECT 'copier' AS id, 'orders' AS queue, 'read' AS type, count(*) AS units,
           {views.sql_position(str(NOW_MS), '(count(*) - 1)')} AS eid
    FROM orders""")
def replicate_position(spark, sf_dir):
    """The position a replication leaves behind."""
    store = ordered(spark, sf_dir)
    finish(jobs.copy_queue(store, "copier", "orders", "orders-copy", clock=clock))
    return jobs.positions_of(store, "copier").select("id", "queue", "type", "units", "eid")


@query("map_enrich", """
    SELECT o_orderkey AS a, o_orderkey % 100 + 1 AS b, o_orderkey + o_orderkey % 100 + 1 AS c,
           CAST(o_orderkey % 100 + 1 AS DOUBLE) / nullif(o_orderkey, 0) AS d
    FROM orders""")
def map_enrich(spark, sf_dir):
    """Events read, given two computed fields, and written to the next queue."""
    store = ordered(spark, sf_dir)

    def change(rows: DataFrame) -> DataFrame:
        parsed = rows.withColumn("p", F.from_json("payload", "a bigint, b bigint"))
        fields = ["p.a AS a", "p.b AS b", "p.a + p.b AS c", "p.b / nullif(p.a, 0) AS d"]
        return parsed.withColumn("payload", F.to_json(F.struct(*[F.expr(f) for f in fields]))).drop("p")

    finish(jobs.copy_queue(store, "mapper", "orders", "orders-mapped", change, clock=clock))
    mapped = after(store.events(), "orders-mapped")
    return mapped.select(F.from_json("payload", "a bigint, b bigint, c bigint, d double").alias("p")).select("p.*")


@query("monitor_job", _FEED, ("changes",))
def monitor_job(spark, sf_dir):
    """Change records streamed into the monitor queue."""
    store = QueueStore(spark, work_dir(spark, "monitor"))
    arrivals = f"{store.root}/changes"
    change_records(spark, sf_dir).repartition(file_count(spark, sf_dir, "events", 4)).write.json(arrivals)
    finish(jobs.watch_bots(store, feed.stream_changes(spark, arrivals, max_files=2), "bot-7", clock=clock))
    kind = (
        "id string, type string, ts bigint, start bigint, is_error boolean, `from` string, `to` string, "
        "checkpoint string, units bigint, source_ts bigint"
    )
    rows = after(store.events(), jobs.MONITOR_QUEUE).select(F.from_json("payload", kind).alias("p")).select("p.*")
    return rows.withColumnsRenamed({"start": "start_ms", "from": "from_queue", "to": "to_queue"})


@query("trigger_job", f"""
    SELECT id, queue, version, CAST({NOW_MS} AS BIGINT) AS requested_ms FROM ({_FANOUT})""", ("base", "bots"))
def trigger_job(spark, sf_dir):
    """Queue changes streamed into the requested positions of the bots they trigger."""
    store = QueueStore(spark, work_dir(spark, "triggers"))
    arrivals = f"{store.root}/changes"
    records = queue_change_records(spark, sf_dir)
    records.repartitionByRange(file_count(spark, sf_dir, "events", 2), "dynamodb.SequenceNumber").sortWithinPartitions("dynamodb.SequenceNumber").write.json(arrivals)
    stream = feed.stream_changes(spark, arrivals, max_files=100)
    finish(jobs.trigger_bots(store, stream, lambda: views.bots(spark, sf_dir), clock=clock))
    requests = store.state("triggers/requests", REQUEST_STATE).load()
    return requests.select("id", "queue", "version", "requested_ms")


@query("archive_job", """
    SELECT queue, count(*) AS records, min(seq) AS first_record, max(seq) AS last_record
    FROM (SELECT 'orders' AS queue, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders) GROUP BY queue""")
def archive_job(spark, sf_dir):
    """A store rolled up into its archive queues, then read as one history without overlap."""
    store = ordered(spark, sf_dir)
    jobs.roll_up(store, "z/2024/02/02")
    history = jobs.whole_history(store).filter("part = 'archive'")
    return history.groupBy("queue").agg(
        F.count("*").alias("records"), F.min("counter").alias("first_record"), F.max("counter").alias("last_record")
    )


@query("archive_state", f"""
    SELECT * FROM (WITH m AS (SELECT {views.sql_position(str(NOW_MS), '(count(*) - 1)')} AS eid FROM orders)
    SELECT 'orders' AS queue, eid AS max_eid, eid AS archive_end FROM m
    UNION ALL SELECT 'orders/_archive', eid, NULL FROM m)""")
def archive_state(spark, sf_dir):
    """Queue state after a roll-up; a second roll-up finds nothing to do."""
    store = ordered(spark, sf_dir)
    jobs.roll_up(store, "z/2024/02/02")
    jobs.roll_up(store, "z/2024/02/02")
    return queue_states(store).select("queue", "max_eid", "archive_end")


@query("stored_retention", """
    SELECT 'a second before' AS moment, count(*) AS kept FROM orders UNION ALL SELECT 'at expiry', 0""")
def stored_retention(spark, sf_dir):
    """Stored events a second before and at their expiry."""
    store = ordered(spark, sf_dir)
    end = NOW_MS // 1000 + 604_800
    moments = {"a second before": end - 1, "at expiry": end}
    early, late = (
        jobs.expire(store, s).agg(F.count("*").alias("kept")).withColumn("moment", F.lit(m)) for m, s in moments.items()
    )
    return early.unionByName(late)


@query("independent_subscribers", """
    SELECT 'reader-' || n AS id, 'orders' AS queue, count(*) AS units FROM orders, (SELECT unnest([1, 2]) AS n) GROUP BY n""")
def independent_subscribers(spark, sf_dir):
    """Two bots read one queue, each under its own position."""
    store = ordered(spark, sf_dir)
    for bot in ("reader-1", "reader-2"):
        finish(jobs.copy_queue(store, bot, "orders", f"{bot}-out", clock=clock))
    first, second = (jobs.positions_of(store, b) for b in ("reader-1", "reader-2"))
    return first.unionByName(second).select("id", "queue", "units")


@query("bounded_drain", "SELECT count(*) AS copied, TRUE AS finished FROM orders")
def bounded_drain(spark, sf_dir):
    """A job with a time limit; it reports whether it got through."""
    store = ordered(spark, sf_dir)
    finished = jobs.drain(jobs.copy_queue(store, "copier", "orders", "drained", clock=clock), DRAIN_SECONDS)
    copied = after(store.events(), "drained").agg(F.count("*").alias("copied"))
    return copied.withColumn("finished", F.lit(finished))


def halves(spark: SparkSession, sf_dir: str) -> QueueStore:
    """A queue of all orders, written by two bots in one millisecond."""
    store = QueueStore(spark, work_dir(spark, "halves"))
    key = F.col("o_orderkey")
    for half in range(2):
        rows = table(spark, sf_dir, "orders").filter(key % 2 == half)
        rows = rows.select(F.to_json(F.struct(key.alias("a"))).alias("payload"), div(key, 4096).alias("stretch"), key)
        write_events(store, f"writer-{half}", "orders", rows, ["stretch", "o_orderkey"], NOW_MS)
    return store


def pages(store: QueueStore, bot: str, queue: str, **page) -> DataFrame:
    """A queue read to its end in pages, each behind the bot's checkpoint; every page's rows, as they were read."""
    reader, number = Subscriber(store, bot), 0
    read = work_dir(store.spark, "pages")
    while True:
        rows = work_table(reader.read(queue, **page), "page")
        last = rows.agg(F.max("eid")).first()[0]
        if last is None:
            return store.spark.read.parquet(read)
        rows.withColumn("page", F.lit(number)).write.mode("append").parquet(read)
        reader.checkpoint(queue, eid=last, now=NOW_MS)
        number += 1


@query("shared_millisecond", f"""
    SELECT id, payload, {views.sql_position(str(NOW_MS), 'counter')} || CASE WHEN half = 1 THEN '-000001' ELSE '' END AS eid,
           CAST((row_number() OVER (ORDER BY counter, half) - 1) // (SELECT ceil(count(*) / 3)::BIGINT FROM orders) AS INTEGER) AS page
    FROM (SELECT 'writer-' || (o_orderkey % 2) AS id, o_orderkey % 2 AS half, '{{"a":' || o_orderkey || '}}' AS payload,
                 row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) - 1 AS counter FROM orders)""")
def shared_millisecond(spark, sf_dir):
    """Events that two bots wrote in one millisecond, read in three pages that cut between equal times."""
    store = halves(spark, sf_dir)
    third = -(-table(spark, sf_dir, "orders").count() // 3)
    return pages(store, "reader", "orders", limit=third, size=1 << 60).select("id", "payload", "eid", "page")


@query("past_retention", """
    SELECT o_orderkey AS a, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS copies, 1 AS pages FROM orders""")
def past_retention(spark, sf_dir):
    """Orders written on three days, archived, the first days dropped: pages and a copy still have each once."""
    store = QueueStore(spark, work_dir(spark, "retention"))
    key = F.col("o_orderkey")
    for day in range(3):
        rows = table(spark, sf_dir, "orders").filter(key % 3 == day).select(F.to_json(F.struct(key.alias("a"))).alias("payload"), key)
        write_events(store, "writer", "orders", rows, ["o_orderkey"], NOW_MS + day * DAY_MS)
    jobs.roll_up(store, "z/2024/03/01")
    jobs.drop_expired_days(store, NOW_MS // 1000 + 604_800 + 2 * 86_400)
    finish(jobs.copy_queue(store, "copier", "orders", "copy", _but_the_first_third, clock=lambda: NOW_MS + 9 * DAY_MS))
    number = F.get_json_object("payload", "$.a").cast("bigint").alias("a")
    read = pages(store, "reader", "orders", limit=(1 << 31) - 1, size=1 << 60).groupBy(number).agg(F.count("*").alias("pages"))
    copied = store.queue("copy").groupBy(number).agg(F.count("*").alias("copies"))
    return read.join(copied, "a", "left").select("a", F.coalesce("copies", F.lit(0)).cast("int").alias("copies"), F.col("pages").cast("int").alias("pages"))


def _but_the_first_third(rows: DataFrame) -> DataFrame:
    return rows.filter(F.get_json_object("payload", "$.a").cast("bigint") % 3 != 0)


@query("chunk_pages", """
    SELECT 'page' AS reader, o_orderkey AS a, o_orderkey // 512 AS chunk, count(*) AS times FROM orders GROUP BY ALL
    UNION ALL SELECT 'copy', o_orderkey, o_orderkey // 512, 1 FROM orders""")
def chunk_pages(spark, sf_dir):
    """Orders in chunk files with a pointer row each, read in pages that end inside chunks, and copied."""
    store = QueueStore(spark, work_dir(spark, "chunked"))
    key = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select(
        div(key, 512).alias("chunk"), key,
        F.to_json(F.struct(F.lit("writer").alias("id"), F.lit("orders").alias("event"), F.struct(key.alias("a")).alias("payload"))).alias("line"),
    )
    lines = lines.repartition("chunk").sortWithinPartitions("chunk", "o_orderkey")
    lines.select("chunk", "line").write.partitionBy("chunk").text(store.chunks)
    found = files.listing(spark, store.chunks).filter(F.col("key").endswith(".txt"))
    number = F.regexp_extract("key", "chunk=([0-9]+)/", 1).cast("bigint")
    pointers = found.select(F.struct(F.lit("chunks").alias("bucket"), "key").alias("s3"), F.lit(None).cast("string").alias("payload"), number.alias("n"))
    write_events(store, "writer", "orders", pointers, ["n"], NOW_MS)
    finish(jobs.copy_queue(store, "copier", "orders", "copy", clock=lambda: NOW_MS + 1))
    half = table(spark, sf_dir, "orders").count() // 2 + 1
    a = F.get_json_object("payload", "$.a").cast("bigint").alias("a")
    read = pages(store, "reader", "orders", limit=half, size=1 << 60).select(F.lit("page").alias("reader"), a)
    copied = store.queue("copy").select(F.lit("copy").alias("reader"), a)
    return read.unionByName(copied).groupBy("reader", "a", div(F.col("a"), 512).alias("chunk")).agg(F.count("*").alias("times"))
