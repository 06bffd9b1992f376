"""Clocks, positions, manifests and the statistics of an ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import positions
from ..functions.times import DAY_MS, div, utc_day
from ..operators import normalize, numbering, runlog, stats
from ..sources import logs
from . import views
from .registry import query
from .views import EVENT_TYPES, HALF_MS, NOW_MS, sql_bucket, sql_position

_CLOCK = """
    SELECT shard, sequence, value,
           i + max(value - i) OVER (PARTITION BY shard ORDER BY sequence) AS clock
    FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY sequence) AS i FROM batches)"""


@query("batch_clock", _CLOCK, ("batches",))
def batch_clock(spark, sf_dir):
    return numbering.batch_clock(views.batches(spark, sf_dir))


@query("batch_clock_replayed", _CLOCK, ("batches",))
def batch_clock_replayed(spark, sf_dir):
    """Every batch delivered twice; small buckets exercise the carry between them."""
    rows = views.batches(spark, sf_dir)
    return numbering.batch_clock(numbering.first_deliveries(rows.unionByName(rows)), bucket_rows=8)


@query("batch_clock_resumed", _CLOCK, ("batches",))
def batch_clock_resumed(spark, sf_dir):
    """The first half of the batches, then the rest from the clock the first half left."""
    rows = views.batches(spark, sf_dir)
    middle = rows.agg(F.max("sequence")).first()[0] // 2
    first = numbering.batch_clock(rows.filter(F.col("sequence") <= middle))
    left = first.groupBy("shard").agg(F.max("clock").alias("clock"))
    rest = numbering.batch_clock(rows.filter(F.col("sequence") > middle), left, bucket_rows=16)
    return first.unionByName(rest)


@query("event_positions", "SELECT seq, shard, batch, queue, eid FROM stored", ("stored",))
def event_positions(spark, sf_dir):
    return views.numbered(spark, sf_dir).select("seq", "shard", "batch", "queue", "eid")


def _special(spark, sf_dir):
    rows = normalize.with_queue(views.envelope(spark, sf_dir).filter(F.col("cmd").isNull()))
    rows = rows.withColumns({
        "snapshot_ms": div(F.col("ms"), DAY_MS) * DAY_MS,
        "archive_start": positions.position(F.col("ms"), F.lit(0)),
        "archive_end": positions.position(F.col("ms"), F.col("seq") % 1000),
    })
    return numbering.special_positions(numbering.with_counter(rows))


_SPECIAL = f"""
    SELECT seq, event, queue, CASE WHEN archive THEN {sql_position('ms', '0')} ELSE own END AS start_eid,
           CASE WHEN archive THEN {sql_position('ms', 'seq % 1000')} ELSE own END AS end_eid
    FROM (SELECT *, CASE WHEN snapshot AND NOT archive
                         THEN {sql_position('arrival_ms', 'counter', f'ms // {DAY_MS} * {DAY_MS}')}
                         ELSE {sql_position('arrival_ms', 'counter')} END AS own
          FROM (SELECT *, row_number() OVER (PARTITION BY shard, batch ORDER BY queue, seq) - 1 AS counter
                FROM (SELECT *, regexp_replace(event, '^queue:', '') || CASE WHEN archive THEN '/_archive'
                             WHEN snapshot THEN '/_snapshot' ELSE '' END AS queue
                      FROM envelope WHERE cmd IS NULL)))"""


@query("special_positions", f"SELECT seq, queue, start_eid, end_eid FROM ({_SPECIAL})", ("envelope",))
def special_positions(spark, sf_dir):
    """Positions of live, snapshot and archive rows side by side."""
    return _special(spark, sf_dir).select("seq", "queue", F.col("start").alias("start_eid"), F.col("end").alias("end_eid"))


@query("archive_ends", f"""
    SELECT regexp_replace(queue, '/_archive$', '') AS queue, arg_max(end_eid, seq) AS archive_end
    FROM ({_SPECIAL}) WHERE queue LIKE '%/\\_archive' ESCAPE '\\' GROUP BY 1""", ("envelope",))
def archive_ends(spark, sf_dir):
    return stats.archive_ends(_special(spark, sf_dir))


@query("snapshot_markers", f"""
    SELECT regexp_replace(event, '^queue:', '') AS queue,
           '_snapshot/' || {sql_bucket('arg_max(ms, seq)')} AS snapshot_start,
           {sql_bucket('arg_max(ms, seq) + 3600000')} AS snapshot_next
    FROM base WHERE cmd = 'registerSnapshot' GROUP BY 1""", ("base",))
def snapshot_markers(spark, sf_dir):
    rows = normalize.snapshot_commands(views.base_events(spark, sf_dir))
    return stats.snapshot_markers(rows.withColumns({"start_ms": F.col("ms"), "next_ms": F.col("ms") + 3_600_000}))


@query("chunk_manifest", f"""
    SELECT shard, batch, queue, counter // 16 AS chunk, min(eid) AS start_eid, max(eid) AS end_eid,
           count(*) AS records, CAST(sum(length(payload)) AS BIGINT) AS size,
           min((arrival_ms + 604800000) // 1000) AS ttl, CAST(2 AS INTEGER) AS v
    FROM stored GROUP BY 1, 2, 3, 4""", ("stored",))
def chunk_manifest(spark, sf_dir):
    rows = normalize.with_ttl(views.numbered(spark, sf_dir))
    manifest = numbering.chunk_manifest(rows, chunk_rows=16)
    return manifest.withColumnsRenamed({"start": "start_eid", "end": "end_eid"})


@query("queue_marks", """
    SELECT queue, max(eid) AS max_eid, max(arrival_ms) AS timestamp, CAST(2 AS INTEGER) AS v
    FROM stored GROUP BY queue""", ("stored",))
def queue_marks(spark, sf_dir):
    return stats.high_water(views.numbered(spark, sf_dir))


@query("producer_stats", """
    SELECT shard, batch, id, queue, count(*) AS units, arg_max(source_ms, counter) AS start_ms,
           arg_max(write_ms, counter) AS end_ms, max(counter) AS checkpoint, min(arrival_ms) AS batch_ms
    FROM stored GROUP BY 1, 2, 3, 4""", ("stored",))
def producer_stats(spark, sf_dir):
    return stats.producer_stats(views.numbered(spark, sf_dir)).withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


@query("write_checkpoints", """
    SELECT shard, batch, id, queue, max(eid) AS checkpoint, arg_max(source_ms, counter) AS source_timestamp,
           arg_max(write_ms, counter) AS started_timestamp, min(arrival_ms) AS ended_timestamp, count(*) AS records
    FROM stored GROUP BY 1, 2, 3, 4""", ("stored",))
def write_checkpoints(spark, sf_dir):
    return stats.write_checkpoints(stats.producer_stats(views.numbered(spark, sf_dir)))


@query("size_by_bot", """
    SELECT id, CAST(sum(length(json)) AS BIGINT) AS chars FROM json_rows GROUP BY id""", ("json_rows",))
def size_by_bot(spark, sf_dir):
    return stats.size_by_bot(views.json_rows(spark, sf_dir), F.col("json"))


@query("size_by_batch", """
    SELECT shard, batch, CAST(sum(4 * ((octet_length(encode(json)) + 2) // 3)) AS BIGINT) AS chars
    FROM json_rows GROUP BY shard, batch""", ("json_rows",))
def size_by_batch(spark, sf_dir):
    rows = views.json_rows(spark, sf_dir)
    return stats.size_by_batch(rows.withColumn("data", views.pack_plain(F.col("json"))))


def _size_lines(spark, sf_dir):
    rows = views.base_events(spark, sf_dir)
    sizes = rows.groupBy(utc_day(F.col("ms")).alias("date"), "shard", F.col("event").alias("name")).agg(
        F.sum("ms").alias("chars")
    )
    return logs.size_lines(sizes.withColumn("name", F.regexp_replace("name", "^queue:", "re-")))


_SIZES = f"""
    SELECT strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS date, right('000000000000' || shard, 12) AS shard,
           regexp_replace(event, '^queue:', 're-') AS queue, CAST(sum(ms) AS BIGINT) AS queue_bytes
    FROM base GROUP BY 1, 2, 3"""


@query("size_log", f"""
    SELECT date, shard, CAST(sum(queue_bytes) OVER (PARTITION BY date, shard) AS BIGINT) AS bytes, queue, queue_bytes
    FROM ({_SIZES})""", ("base",))
def size_log(spark, sf_dir):
    """Size lines written and read back."""
    return logs.parse_size_lines(_size_lines(spark, sf_dir))


@query("size_pivot", f"""
    SELECT date, {', '.join(f"CAST(sum(CASE WHEN queue = '{q}' THEN (queue_bytes + 500) // 1000 END) AS BIGINT) AS {q}" for q in EVENT_TYPES)}
    FROM ({_SIZES}) WHERE shard = '000000000001' AND queue_bytes >= 100000 GROUP BY date""", ("base",))
def size_pivot(spark, sf_dir):
    rows = logs.parse_size_lines(_size_lines(spark, sf_dir))
    return stats.size_pivot(stats.queue_sizes(rows, shard="000000000001", min_queue=100_000), EVENT_TYPES)


def _runs(spark, sf_dir):
    rows = views.base_events(spark, sf_dir)
    seq = F.col("seq")
    return rows.select(
        "id",
        F.when(seq % 3 == 0, F.regexp_replace("event", "^queue:", "")).alias("key"),
        F.col("ms").alias("start"),
        (F.col("ms") + seq % 500).alias("end"),
        (seq % 10).alias("units"),
        (seq % 500).alias("duration"),
        (seq % 4).alias("consumption"),
        (seq % 7 == 0).alias("is_error"),
        F.when(seq % 2 == 0, seq % 3).alias("completions"),
    )


_ROLLUP = """
    SELECT id || coalesce('-' || key, '') AS identifier, count(*) AS runs,
           CAST(sum(coalesce(completions, 0)) AS BIGINT) AS completions, max(start_ms) AS start_ms, max(end_ms) AS end_ms,
           CAST(sum(units) AS BIGINT) AS units, CAST(sum(duration) AS BIGINT) AS duration,
           min(duration) AS min_duration, max(duration) AS max_duration,
           CAST(sum(consumption) AS BIGINT) AS consumption, count(*) FILTER (is_error) AS errors, min(id) AS id
    FROM (SELECT id, CASE WHEN seq % 3 = 0 THEN regexp_replace(event, '^queue:', '') END AS key, ms AS start_ms,
                 ms + seq % 500 AS end_ms, seq % 10 AS units, seq % 500 AS duration, seq % 4 AS consumption,
                 seq % 7 = 0 AS is_error, CASE WHEN seq % 2 = 0 THEN seq % 3 END AS completions
          FROM base)
    GROUP BY 1"""


@query("run_rollup", _ROLLUP, ("base",))
def run_rollup(spark, sf_dir):
    rows = runlog.run_rollup(_runs(spark, sf_dir))
    return rows.withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


@query("run_lines", f"""
    SELECT identifier, CASE WHEN identifier = id THEN '[RUNLOG]:v1:' || concat_ws(':', runs, start_ms, end_ms, units,
               duration, min_duration, max_duration, consumption, errors, id)
           ELSE '[RUNLOG]:v2:{{"p":[' || concat_ws(',', runs, start_ms, end_ms, units, duration, min_duration,
               max_duration, consumption, errors, '"' || id || '"', completions) || '],"e":{{"key":"'
               || substr(identifier, length(id) + 2) || '"}}}}' END AS line
    FROM ({_ROLLUP})""", ("base",))
def run_lines(spark, sf_dir):
    rows = runlog.run_rollup(_runs(spark, sf_dir))
    key = F.substring("identifier", F.length("id") + 2, F.length("identifier"))
    options = F.when(F.col("identifier") != F.col("id"), F.to_json(F.struct(key.alias("key"))))
    return runlog.run_lines(rows.withColumn("options", options))


def _system_sql(kind: str) -> str:
    return f"""
    SELECT seq, id, event, '[RUNLOG]:v2:{{"p":[1,' || coalesce(source_ms, {NOW_MS}) || ',' || coalesce(write_ms, {NOW_MS})
           || ',' || (seq % 10) || ',' || concat_ws(',', d, d, d) || ',0,' || (seq % 3) || ',"run:{kind}:system.'
           || event || '"],"e":{{"key":"' || id || '"}}}}' AS line
    FROM (SELECT *, coalesce(write_ms, {NOW_MS}) - ms AS d FROM base)"""


def _system(spark, sf_dir, kind: str):
    runs = views.base_events(spark, sf_dir).select(
        "seq", "id", "event", (F.col("seq") % 10).alias("units"), "source_ms", F.col("ms").alias("exec_start"),
        F.col("write_ms").alias("exec_end"), (F.col("seq") % 3).alias("errors"),
    )
    return runlog.system_rows(runs, kind, NOW_MS, keep=["seq"])


@query("system_reads", _system_sql("getEvents"), ("base",))
def system_reads(spark, sf_dir):
    return _system(spark, sf_dir, runlog.READ_ROW)


@query("system_writes", _system_sql("kinesisWriteEvents"), ("base",))
def system_writes(spark, sf_dir):
    return _system(spark, sf_dir, runlog.WRITE_ROW)


@query("read_stats", f"""
    SELECT count(*) AS units, max(eid) AS eid, arg_max(source_ms, eid) AS source_timestamp,
           arg_max(write_ms, eid) AS ended_timestamp, arg_max(write_ms, eid) AS started_timestamp
    FROM stored WHERE queue = 'click' AND eid > {sql_position(str(HALF_MS), '0')}""", ("stored",))
def read_stats(spark, sf_dir):
    """A read of one queue from mid-month on."""
    rows = views.numbered(spark, sf_dir)
    start = positions.position(F.lit(HALF_MS).cast("bigint"), F.lit(0))
    return stats.read_stats(rows.filter((F.col("queue") == "click") & (F.col("eid") > start)))

