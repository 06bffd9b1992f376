"""Queue reads, file discovery, stored queues, archives and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, positions
from ..functions.times import DAY_MS, div, utc_day
from ..operators import archive, normalize, numbering, stats
from ..schemas import POSITION_STATE
from ..session import work_dir, work_table
from ..sources import files, queues
from ..sources.queues import QueueStore
from ..sources.records import event_json
from ..sources.state import StateTable
from ..streaming.appending import write_events
from . import views
from .registry import query
from .views import HALF_MS, NOW_MS, sql_bucket, sql_position, table

_START = "z/2024/01/16/"
_CURSOR = "firehose/2024/01/14/000100"


def store_of(spark, sf_dir) -> QueueStore:
    """The numbered events as a stored set of queues."""
    store = QueueStore(spark, work_dir(spark, "queues"))
    rows = normalize.with_ttl(views.numbered(spark, sf_dir)).withColumn("batch_ms", F.col("arrival_ms"))
    rows = rows.withColumns({
        "creator": F.lit(None).cast("string"),
        "s3": F.lit(None).cast("struct<bucket:string,key:string>"),
        "v": F.lit(numbering.ROW_VERSION),
    })
    store.append_sorted(rows, "load")
    return store


@query("read_after", f"""
    SELECT eid, id, payload FROM stored WHERE queue = 'click' AND eid > '{_START}'""", ("stored",))
def read_after(spark, sf_dir):
    """A stored queue from a position on; the days before are not listed."""
    return queues.after(store_of(spark, sf_dir).queue("queue:click"), "queue:click", _START).select("eid", "id", "payload")


@query("read_between", f"""
    SELECT eid, id, payload FROM stored
    WHERE queue = 'view' AND eid > '{_START}' AND eid <= 'z/2024/01/20/12/'""", ("stored",))
def read_between(spark, sf_dir):
    rows = queues.after(store_of(spark, sf_dir).queue("view"), "view", _START, "z/2024/01/20/12/")
    return rows.select("eid", "id", "payload")


@query("read_limit", f"""
    SELECT eid, id, payload FROM stored WHERE queue = 'view' AND eid > '{_START}' ORDER BY eid LIMIT 250""", ("stored",))
def read_limit(spark, sf_dir):
    return queues.read(views.numbered(spark, sf_dir), "view", _START, limit=250).select("eid", "id", "payload")


@query("read_bytes", f"""
    SELECT eid, payload FROM (
      SELECT *, sum(octet_length(encode(payload))) OVER (ORDER BY eid ROWS UNBOUNDED PRECEDING) AS size
      FROM stored WHERE queue = 'signup' AND eid > '{_START}')
    WHERE size <= 4000""", ("stored",))
def read_bytes(spark, sf_dir):
    rows = queues.after(work_table(views.numbered(spark, sf_dir), "numbered"), "signup", _START)
    return queues.capped(rows, 4000).select("eid", "payload")


@query("page_limit", f"""
    SELECT eid, id, payload FROM stored WHERE queue = 'view' AND eid > '{_START}' ORDER BY eid LIMIT 250""", ("stored",))
def page_limit(spark, sf_dir):
    """A page of a stored queue; only the files that hold it are read."""
    return store_of(spark, sf_dir).page("queue:view", _START, limit=250).select("eid", "id", "payload")


@query("page_bytes", f"""
    SELECT eid, payload FROM (
      SELECT *, sum(octet_length(encode(payload))) OVER (ORDER BY eid ROWS UNBOUNDED PRECEDING) AS size
      FROM stored WHERE queue = 'signup' AND eid > '{_START}')
    WHERE size <= 4000""", ("stored",))
def page_bytes(spark, sf_dir):
    """As many events of a stored queue as fit a number of bytes."""
    return store_of(spark, sf_dir).page("signup", _START, size=4000).select("eid", "payload")


@query("replay_from_start", "SELECT eid, id, payload FROM stored WHERE queue = 'purchase'", ("stored",))
def replay_from_start(spark, sf_dir):
    """A whole queue again, from the first position."""
    rows = queues.after(store_of(spark, sf_dir).events(), "purchase", positions.START)
    return rows.select("eid", "id", "payload")


@query("file_cursor", f"""
    SELECT key, bytes FROM files WHERE key > '{_CURSOR}' AND starts_with(key, 'firehose/')
    ORDER BY key LIMIT 100""", ("files",))
def file_cursor(spark, sf_dir):
    return files.next_files(views.files(spark, sf_dir), _CURSOR)


@query("load_commands", f"""
    SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS INTEGER) AS pos, 'bus' AS bucket, key, max(key) OVER () AS cursor
    FROM (SELECT key FROM files WHERE key > '{_CURSOR}' ORDER BY key LIMIT 100)""", ("files",))
def load_commands(spark, sf_dir):
    """A page of files as one load command, expanded again to its files."""
    command = files.load_command(files.next_files(views.files(spark, sf_dir), _CURSOR), "bus")
    return files.command_files(command).select("pos", "bucket", "key", "cursor")


@query("folder_listing", """
    SELECT 'day=' || strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS folder,
           CAST(sum(length(payload) + 1) AS BIGINT) AS bytes
    FROM stored GROUP BY 1""", ("stored",))
def folder_listing(spark, sf_dir):
    """Keys and sizes of files on disk; contents are not read."""
    root = work_dir(spark, "listing")
    days = views.numbered(spark, sf_dir).select(utc_day(F.col("ms")).alias("day"), "payload")
    days.write.partitionBy("day").text(root)
    return files.listing(spark, root).groupBy(F.split_part("key", F.lit("/"), F.lit(1)).alias("folder")).agg(
        F.sum("bytes").alias("bytes")
    )


@query("pointer_events", """
    SELECT queue, eid, id, replace(payload, ' ', '') AS payload, write_ms FROM stored""", ("stored",))
def pointer_events(spark, sf_dir):
    """Queues of which every second batch was written as chunk files with a pointer row each."""
    rows = views.numbered(spark, sf_dir)
    inline = rows.filter("batch % 2 = 0")
    chunked = rows.filter("batch % 2 = 1")
    root = work_dir(spark, "chunks")
    named = chunked.withColumn("event", F.col("queue"))
    lines = named.select("queue", event_json(named).alias("json"))
    lines.write.partitionBy("queue").option("compression", "gzip").text(root)
    written = files.listing(spark, root).select(
        F.regexp_extract("key", "queue=([^/]+)/", 1).alias("queue"), F.struct(F.lit("bus").alias("bucket"), "key").alias("s3")
    )
    pointers = inline.select("queue", "eid", "id", "payload", "write_ms", "source_ms").unionByName(
        written, allowMissingColumns=True
    )
    expanded = queues.expand_pointers(spark, pointers, root)
    return expanded.select("queue", "eid", "id", F.regexp_replace("payload", " ", "").alias("payload"), "write_ms")


def _marks(rows):
    """Queue state: the archive ends mid-month, a snapshot starts and ends after it."""
    cut = F.max_by("eid", F.when(F.col("arrival_ms") < HALF_MS, positions.key(F.col("arrival_ms"), F.col("counter"))))
    half = F.lit(HALF_MS).cast("bigint")
    return rows.groupBy("queue").agg(cut.alias("archive_end")).withColumns({
        "snapshot_start": F.concat(F.lit("_snapshot/"), positions.bucket(half)),
        "snapshot_next": positions.bucket(half + 5 * DAY_MS),
    })


@query("archive_live_read", f"""
    SELECT * FROM (WITH ends AS (SELECT queue, max(eid) FILTER (arrival_ms < {HALF_MS}) AS archive_end FROM stored GROUP BY queue)
    SELECT queue, eid, id, CASE WHEN eid <= archive_end THEN 'archive' ELSE 'live' END AS part
    FROM stored JOIN ends USING (queue))""", ("stored",))
def archive_live_read(spark, sf_dir):
    """Events archived up to a position and all live ones, each read once."""
    rows = views.numbered(spark, sf_dir).select("queue", "eid", "id", "arrival_ms", "counter")
    rows = work_table(rows, "numbered")
    both = rows.unionByName(archive.as_archive_rows(rows.filter(F.col("arrival_ms") < HALF_MS)))
    return queues.archive_then_live(both, _marks(rows)).select("queue", "eid", "id", "part")


@query("snapshot_tail", f"""
    SELECT queue, {sql_bucket(str(HALF_MS))} || split_part(eid, '/', 7) AS eid, id, 'snapshot' AS part FROM stored
    WHERE arrival_ms < {HALF_MS + 5 * DAY_MS}
    UNION ALL
    SELECT queue, eid, id, 'live' FROM stored WHERE eid >= {sql_bucket(str(HALF_MS + 5 * DAY_MS))}""", ("stored",))
def snapshot_tail(spark, sf_dir):
    """A snapshot of everything before a point, then the live events from there."""
    rows = work_table(views.numbered(spark, sf_dir).drop("payload"), "numbered")
    half = F.lit(HALF_MS).cast("bigint")
    taken = rows.filter(F.col("arrival_ms") < HALF_MS + 5 * DAY_MS).withColumn("queue", names.snapshot_of(F.col("queue")))
    taken = numbering.with_positions(taken, bucket_ms=half)
    both = rows.select("queue", "eid", "id").unionByName(taken.select("queue", "eid", "id"))
    return queues.snapshot_then_tail(both, _marks(rows)).select("queue", "eid", "id", "part")


@query("subscriber_backlog", f"""
    SELECT b.id, b.queue, position, count(s.eid) AS unread
    FROM (SELECT DISTINCT id, queue, {sql_position('(1706572800000 - k % 700 * 3600000)', '0')} AS position
          FROM (SELECT id, unnest([t1, t2]) AS queue, CAST(substr(id, 5) AS BIGINT) AS k FROM bots WHERE NOT archived)) b
    LEFT JOIN stored s ON s.queue = b.queue AND s.eid > position GROUP BY 1, 2, 3""", ("stored", "bots"))
def subscriber_backlog(spark, sf_dir):
    """How far every bot is behind on the queues it listens to; each has its own position."""
    bots = views.bots(spark, sf_dir).filter("NOT archived")
    number = F.substring_index("id", "-", -1).cast("bigint")
    position = positions.position(F.lit(1_706_572_800_000) - number % 700 * 3_600_000, F.lit(0))
    subscribers = bots.select("id", F.explode(F.array_distinct("triggers")).alias("queue"), position.alias("checkpoint"))
    return queues.unread(work_table(views.numbered(spark, sf_dir).select("queue", "eid"), "numbered"), subscribers)


@query("subscriber_catalog", f"""
    SELECT * FROM (WITH last AS (SELECT id, queue, arg_max(pos, ev_day) AS pos, arg_max(ended_ms, ev_day) AS ended_ms,
                         arg_max(started_ms, ev_day) AS started_ms FROM daily GROUP BY id, queue),
         seen AS (SELECT id, queue, CASE WHEN pos % 7 <> 0 THEN {sql_position('ended_ms - pos % 5 * 3600000', 'pos')} END AS checkpoint,
                         CASE WHEN pos % 2 = 0 THEN {sql_position('started_ms', 'pos')} END AS requested FROM last),
         marks AS (SELECT queue, max(eid) AS max_eid FROM stored GROUP BY queue)
    SELECT queue, count(DISTINCT id) AS subscribers, min(coalesce(checkpoint, 'z/0')) AS oldest_position,
           count(*) FILTER (coalesce(checkpoint, 'z/0') < max_eid AND NOT coalesce(checkpoint >= requested, FALSE)) AS behind,
           max(max_eid) AS max_eid
    FROM seen JOIN marks USING (queue) GROUP BY queue)""", ("daily", "stored"))
def subscriber_catalog(spark, sf_dir):
    day = F.col("ev_day")
    last = views.daily(spark, sf_dir).groupBy("id", "queue").agg(
        *[F.max_by(c, day).alias(c) for c in ("pos", "ended_ms", "started_ms")]
    )
    seen = last.select(
        "id", "queue",
        F.when(F.col("pos") % 7 != 0, positions.position(F.col("ended_ms") - F.col("pos") % 5 * 3_600_000, F.col("pos"))).alias("checkpoint"),
        F.when(F.col("pos") % 2 == 0, positions.position(F.col("started_ms"), F.col("pos"))).alias("requested"),
    )
    return stats.subscriber_catalog(seen, stats.high_water(views.numbered(spark, sf_dir)))


def _queue_documents(spark, sf_dir):
    key = F.col("c_custkey")
    ms = F.lit(1_704_067_200_000) + key * 60_000
    own = positions.position(ms, key)
    suffix = F.when(key % 10 == 1, names.ARCHIVE_SUFFIX).when(key % 10 == 2, names.SNAPSHOT_SUFFIX).otherwise("")
    end = (
        F.when(key % 3 == 0, F.lit(None)).when(key % 7 == 0, own).when(key % 11 == 0, "z/2024/01/02")
        .otherwise(positions.position(ms - (key % 5) * DAY_MS, key))
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("q"), key.cast("string"), suffix).alias("queue"),
        F.when(key % 13 != 0, own).alias("max_eid"),
        end.alias("archive_end"),
        F.when(key % 17 == 0, F.lit(True)).alias("skip_archive"),
    )


@query("archive_candidates", f"""
    SELECT queue, max_eid, coalesce(archive_end, 'z/0') AS archive_end FROM (
      SELECT 'q' || c_custkey AS queue, c_custkey AS k, own AS max_eid,
             CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN own
                  WHEN c_custkey % 11 = 0 THEN 'z/2024/01/02'
                  ELSE {sql_position('(ms - c_custkey % 5 * 86400000)', 'c_custkey')} END AS archive_end
      FROM (SELECT *, {sql_position('ms', 'c_custkey')} AS own
            FROM (SELECT c_custkey, 1704067200000 + c_custkey * 60000 AS ms FROM customer)))
    WHERE k % 10 NOT IN (1, 2) AND k % 13 <> 0 AND k % 17 <> 0 AND coalesce(archive_end, 'z/0') <> max_eid
      AND 'z/2024/01/02' > coalesce(archive_end, 'z/0')""")
def archive_candidates(spark, sf_dir):
    rows = archive.archive_candidates(_queue_documents(spark, sf_dir), "z/2024/01/02")
    return rows.select("queue", "max_eid", "archive_end")


@query("archive_chunks", f"""
    SELECT queue || '/_archive' AS queue, arrival_ms // 1200000 * 1200000 AS chunk_ms, min(eid) AS start_eid,
           max(eid) AS end_eid, count(*) AS records, CAST(sum(length(payload)) AS BIGINT) AS size
    FROM stored GROUP BY 1, 2""", ("stored",))
def archive_chunks(spark, sf_dir):
    rows = archive.archive_chunks(views.numbered(spark, sf_dir))
    return rows.withColumnsRenamed({"start": "start_eid", "end": "end_eid"})


@query("archive_write", """
    SELECT queue || '/_archive' AS queue, eid, id, payload FROM stored WHERE eid > 'z/2024/01/16/'""", ("stored",))
def archive_write(spark, sf_dir):
    """Events past the archive end, written range-sorted to the archive queues and read back."""
    store = QueueStore(spark, work_dir(spark, "archive"))
    rows = views.numbered(spark, sf_dir)
    ends = rows.groupBy("queue").agg(F.lit(_START).alias("archive_end"))
    chosen = archive.to_archive(rows, ends).withColumns({
        "batch_ms": F.col("arrival_ms"), "ttl": F.lit(None).cast("bigint"), "v": F.lit(numbering.ROW_VERSION),
        "creator": F.lit(None).cast("string"), "s3": F.lit(None).cast("struct<bucket:string,key:string>"),
    })
    store.append_sorted(archive.as_archive_rows(chosen), "archive-0")
    return store.events().select("queue", "eid", "id", "payload")


@query("queue_write", f"""
    SELECT {sql_position(str(NOW_MS), 'seq')} AS eid, 'writer' AS id, 'orders' AS queue,
           '{{"order":' || o_orderkey || '}}' AS payload, CAST({NOW_MS // 1000 + 604800} AS BIGINT) AS ttl
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders)""")
def queue_write(spark, sf_dir):
    """All orders written to a queue by one bot, read back from the store."""
    store = QueueStore(spark, work_dir(spark, "write"))
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit('{"order":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("payload"),
        div(F.col("o_orderkey"), 4096).alias("stretch"), "o_orderkey",
    )
    write_events(store, "writer", "queue:orders", rows, ["stretch", "o_orderkey"], NOW_MS)
    return store.events().select("eid", "id", "queue", "payload", "ttl")


@query("state_scan", """
    SELECT id, queue, max(pos) AS units FROM daily GROUP BY id, queue""", ("daily",))
def state_scan(spark, sf_dir):
    """A position table saved twice; a version written again changes nothing."""
    state = StateTable(spark, work_dir(spark, "state"), POSITION_STATE)
    rows = views.daily(spark, sf_dir).groupBy("id", "queue").agg(F.max("pos").alias("units"))
    full = rows.withColumns({
        f.name: F.lit(None).cast(f.dataType) for f in POSITION_STATE if f.name not in ("id", "queue", "units")
    })
    state.commit(full.withColumn("units", F.lit(0).cast("bigint")), 0)
    state.commit(full, 1)
    state.commit(full.withColumn("units", F.lit(-1).cast("bigint")), 1)
    return state.load().select("id", "queue", "units")


@query("cursor_save", """
    SELECT max(key) AS eid, count(*) AS units
    FROM (SELECT key FROM files ORDER BY key LIMIT 200)""", ("files",))
def cursor_save(spark, sf_dir):
    """Two pages of files taken in turn; the cursor moves only after each page."""
    found, state = views.files(spark, sf_dir), StateTable(spark, work_dir(spark, "cursor"), POSITION_STATE)
    for version in range(2):
        saved = state.load().select("eid", "units").first()
        cursor, units = (saved["eid"], saved["units"]) if saved else ("", 0)
        page = files.cursor_after(files.next_files(found, cursor), cursor)
        after = page.select(
            F.lit("loader").alias("id"), F.lit("files").alias("queue"), F.lit("read").alias("type"),
            F.col("cursor").alias("eid"), (F.col("files") + units).alias("units"),
            *[F.lit(NOW_MS).cast("bigint").alias(f"{c}_timestamp") for c in ("source", "started", "ended")],
        )
        state.commit(after, version)
    return state.load().select("eid", "units")
