"""Event-bus rows derived from the given tables, in Spark and in SQL.

Every view keeps all rows of its table. Remainders of ids only spread
attributes (a missing payload, an archive mark) over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import positions
from ..functions.encoding import pack_gzip, pack_plain, pack_zlib, pack_zlib_best
from ..functions.times import DAY_MS, column_ms, div, two_digits, utc_day
from ..operators import normalize, numbering
from ..sources.records import event_json

# The time that stands for "now" in every query: 2024-02-01 UTC.
NOW_MS = 1_706_745_600_000
# Middle of the events' month: 2024-01-16 UTC.
HALF_MS = 1_705_363_200_000
# Archives and snapshots of the record stream are taken every ten days.
SPAN_MS = 10 * DAY_MS
BATCH_SPAN = 400
SHARDS = 4
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def sql_position(ms: str, counter: str, bucket: str | None = None) -> str:
    return (
        f"(strftime(make_timestamp(({bucket or ms}) * 1000), 'z/%Y/%m/%d/%H/%M/') || ({ms})"
        f" || '-' || right('0000000' || ({counter}), 7))"
    )


def sql_bucket(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), 'z/%Y/%m/%d/%H/%M/')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a millisecond column and envelope fields, before arrival times."""
    events = table(spark, sf_dir, "events")
    seq = F.col("event_id")
    kind = F.col("event_type")

    def every(n: int) -> Column:
        return seq % n == 0

    ms = F.col("ms")
    return events.withColumn("ms", column_ms(events, "ts")).select(
        seq.alias("seq"),
        (seq % SHARDS).alias("shard"),
        div(seq, BATCH_SPAN).alias("batch"),
        F.concat(F.lit("bot-"), (F.col("user_id") % 10).cast("string")).alias("id"),
        F.when(seq % 5 == 0, F.concat(F.lit("queue:"), kind)).otherwise(kind).alias("event"),
        F.when(~every(17), F.col("props")).alias("payload"),
        F.when(every(97), normalize.SNAPSHOT_COMMAND).alias("cmd"),
        every(29).alias("archive"),
        every(31).alias("snapshot"),
        F.when(~every(11), ms + (seq % 7) * 1000).alias("write_ms"),
        F.when(~every(13), ms).alias("source_ms"),
        "ms",
        "user_id",
        "value",
    )


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes with the arrival time of their batch."""
    rows = base_events(spark, sf_dir)
    arrivals = rows.groupBy("shard", "batch").agg(F.min("ms").alias("arrival_ms"))
    return rows.join(arrivals, ["shard", "batch"])


def is_live(rows: DataFrame) -> Column:
    """Valid events that go to a live queue."""
    return (
        F.col("cmd").isNull() & normalize.is_valid_bus_event(rows) & ~F.col("archive") & ~F.col("snapshot")
    )


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live events with queue, times, counter and position."""
    rows = envelope(spark, sf_dir)
    live = rows.filter(is_live(rows)).drop("archive", "snapshot", "cmd")
    live = normalize.with_times(normalize.with_queue(live), NOW_MS)
    return numbering.with_positions(numbering.with_counter(live))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose arrival is told in days and at times goes back."""
    firsts = base_events(spark, sf_dir).groupBy("shard", "batch").agg(F.min("ms").alias("_ms"))
    value = (div(F.col("_ms"), DAY_MS) - F.col("batch") % 3) * DAY_MS
    return firsts.select("shard", F.col("batch").alias("sequence"), value.alias("value"))


def bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    kinds = F.array(*[F.lit(k) for k in EVENT_TYPES])
    first = (F.col("s_suppkey") % 5 + 1).cast("int")
    second = ((F.col("s_suppkey") * 3 + 1) % 5 + 1).cast("int")
    return suppliers.select(
        F.concat(F.lit("bot-"), F.col("s_suppkey").cast("string")).alias("id"),
        F.array(F.element_at(kinds, first), F.element_at(kinds, second)).alias("triggers"),
        (F.col("s_acctbal") < 0).alias("archived"),
        (F.col("s_nationkey") % 2 == 0).alias("paused"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bot wrote to each queue per day."""
    events = table(spark, sf_dir, "events")
    rows = events.withColumn("ms", column_ms(events, "ts"))
    return rows.groupBy(
        F.concat(F.lit("bot-"), (F.col("user_id") % 10).cast("string")).alias("id"),
        F.col("event_type").alias("queue"),
        div(F.col("ms"), DAY_MS).alias("ev_day"),
    ).agg(
        F.max("event_id").alias("pos"),
        F.count("*").alias("records"),
        F.min("ms").alias("started_ms"),
        F.max("ms").alias("ended_ms"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily values with the day before; a key has one row per day."""
    rows = daily(spark, sf_dir).withColumns({
        "completed_ms": F.when(F.col("records") % 2 == 0, F.col("ended_ms")),
        "status": F.when(F.col("records") % 3 == 0, "error").otherwise("complete"),
        "invoke_ms": F.col("started_ms"),
    })
    window = Window.partitionBy("id", "queue").orderBy("ev_day")
    return rows.withColumns({
        f"old_{c}": F.lag(f"{c}").over(window) for c in ("pos", "records", "invoke_ms", "completed_ms", "started_ms", "ended_ms")
    }).withColumn("first", F.row_number().over(window) == 1)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    name = F.right(F.concat(F.lit("000000"), F.col("page_id").cast("string")), F.lit(6))
    return pages.select(
        F.concat(F.lit("firehose/2024/01/"), two_digits(F.col("page_id") % 28 + 1), F.lit("/"), name).alias("key"),
        F.octet_length("html").cast("bigint").alias("bytes"),
    )


def iso_text(ms: Column) -> Column:
    second = div(ms, 1000)
    clock = [two_digits(div(second, 3600) % 24), two_digits(div(second, 60) % 60), two_digits(second % 60)]
    return F.concat(utc_day(ms), F.lit("T"), F.concat_ws(":", *clock))


def rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes with every kind of missing or empty value."""
    rows = base_events(spark, sf_dir)
    seq = F.col("seq")

    def every(n: int) -> Column:
        return seq % n == 0

    payload = (
        F.when(every(17), F.lit(None)).when(every(37), "null").when(every(41), "0").when(every(43), '""')
        .when(every(47), "{}").when(every(53), "false").when(every(61), "[]").when(every(67), "0.5")
        .otherwise(F.col("payload"))
    )
    pointer = F.struct(F.lit("bus").alias("bucket"), F.concat(F.lit("chunk/"), seq.cast("string")).alias("key"))
    return rows.select(
        "seq",
        F.when(every(19), F.lit(None)).when(every(71), "").otherwise(F.col("id")).alias("id"),
        F.when(every(23), F.lit(None)).otherwise(F.col("event")).alias("event"),
        payload.alias("payload"),
        F.when(every(59), pointer).alias("s3"),
        F.when(every(89), "other").otherwise(F.col("cmd")).alias("cmd"),
    )


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines."""
    rows = base_events(spark, sf_dir)
    span = div(F.col("ms"), SPAN_MS) * SPAN_MS
    # The texts of archive rows share their beginning: generated code that grows too long is not compiled.
    rows = rows.withColumns({
        "snapshot_ms": F.when(F.col("snapshot"), span),
        "_begin": F.when(F.col("archive"), positions.batch_prefix(span)),
    })
    rows = rows.withColumns({
        "start": F.when(
            F.col("cmd").isNotNull() | F.col("archive"),
            F.when(F.col("archive"), positions.behind(F.col("_begin"), F.lit(0))).otherwise(F.col("ms").cast("string")),
        ),
        "next": F.when(F.col("cmd").isNotNull(), (F.col("ms") + 3_600_000).cast("string")),
        "end": F.when(F.col("archive"), positions.behind(F.col("_begin"), F.col("seq") % 1000)),
        "archive": F.when(F.col("archive"), F.lit(True)),
    }).drop("_begin")
    return rows.withColumn("json", event_json(rows))


def encoded(spark: SparkSession, sf_dir: str, foreign: bool = True) -> DataFrame:
    """Records of two events each, in all encodings; ``foreign`` adds unknown ones."""
    lines = json_rows(spark, sf_dir).withColumn("pair", div(F.col("seq"), 2))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("seq", "json"))), lambda e: e["json"])
    records = lines.groupBy("pair").agg(
        F.array_join(in_order, "\n").alias("text"), F.min("ms").alias("arrival_ms")
    )
    kind = F.col("pair") % 3
    data = (
        F.when(kind == 0, pack_gzip(F.when(kind == 0, F.col("text"))))
        .when(kind == 1, pack_zlib(F.when(kind == 1, F.col("text")))).otherwise(pack_plain(F.col("text")))
    )
    if foreign:
        data = (
            F.when(F.col("pair") % 7 == 0, pack_zlib_best(F.when(F.col("pair") % 7 == 0, F.col("text"))))
            .when(F.col("pair") % 11 == 0, F.concat(F.lit("#"), F.col("pair").cast("string")))
            .otherwise(data)
        )
    return records.select(
        (F.col("pair") % SHARDS).cast("string").alias("shard"),
        F.lpad(F.col("pair").cast("string"), 12, "0").alias("sequence"),
        "arrival_ms",
        data.alias("data"),
        "pair",
    )


_SPAN = f"(ms // {SPAN_MS} * {SPAN_MS})"
_QUEUE = "regexp_replace(event, '^queue:', '')"

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "base": ((), f"""
        SELECT event_id AS seq, event_id % {SHARDS} AS shard, event_id // {BATCH_SPAN} AS batch,
               'bot-' || (user_id % 10) AS id,
               CASE WHEN event_id % 5 = 0 THEN 'queue:' || event_type ELSE event_type END AS event,
               CASE WHEN event_id % 17 <> 0 THEN props END AS payload,
               CASE WHEN event_id % 97 = 0 THEN 'registerSnapshot' END AS cmd,
               event_id % 29 = 0 AS archive, event_id % 31 = 0 AS snapshot,
               CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) // 1000 + (event_id % 7) * 1000 END AS write_ms,
               CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) // 1000 END AS source_ms,
               epoch_us(ts) // 1000 AS ms, user_id, value
        FROM events"""),
    "envelope": (("base",), """
        SELECT *, min(ms) OVER (PARTITION BY shard, batch) AS arrival_ms FROM base"""),
    "numbered": (("envelope",), f"""
        SELECT seq, shard, batch, id, event, {_QUEUE} AS queue, payload, ms, arrival_ms, user_id, value,
               coalesce(write_ms, {NOW_MS}) AS write_ms,
               coalesce(source_ms, write_ms, {NOW_MS}) AS source_ms,
               row_number() OVER (PARTITION BY shard, batch ORDER BY {_QUEUE}, seq) - 1 AS counter
        FROM envelope WHERE cmd IS NULL AND payload IS NOT NULL AND NOT archive AND NOT snapshot"""),
    "stored": (("numbered",), f"""
        SELECT *, {sql_position('arrival_ms', 'counter')} AS eid FROM numbered"""),
    "batches": (("base",), f"""
        SELECT shard, batch AS sequence, (min(ms) // {DAY_MS} - batch % 3) * {DAY_MS} AS value
        FROM base GROUP BY shard, batch"""),
    "bots": ((), f"""
        SELECT 'bot-' || s_suppkey AS id,
               [{', '.join(repr(k) for k in EVENT_TYPES)}][s_suppkey % 5 + 1] AS t1,
               [{', '.join(repr(k) for k in EVENT_TYPES)}][(s_suppkey * 3 + 1) % 5 + 1] AS t2,
               s_acctbal < 0 AS archived, s_nationkey % 2 = 0 AS paused
        FROM supplier"""),
    "daily": ((), f"""
        SELECT 'bot-' || (user_id % 10) AS id, event_type AS queue, (epoch_us(ts) // 1000) // {DAY_MS} AS ev_day,
               max(event_id) AS pos, count(*) AS records,
               min(epoch_us(ts) // 1000) AS started_ms, max(epoch_us(ts) // 1000) AS ended_ms
        FROM events GROUP BY 1, 2, 3"""),
    "changes": (("daily",), """
        SELECT *, lag(pos) OVER w AS old_pos, lag(records) OVER w AS old_records,
               lag(invoke_ms) OVER w AS old_invoke_ms, lag(completed_ms) OVER w AS old_completed_ms,
               lag(started_ms) OVER w AS old_started_ms, lag(ended_ms) OVER w AS old_ended_ms,
               row_number() OVER w = 1 AS first
        FROM (SELECT *, started_ms AS invoke_ms, CASE WHEN records % 2 = 0 THEN ended_ms END AS completed_ms,
                     CASE WHEN records % 3 = 0 THEN 'error' ELSE 'complete' END AS status FROM daily)
        WINDOW w AS (PARTITION BY id, queue ORDER BY ev_day)"""),
    "files": ((), """
        SELECT 'firehose/2024/01/' || right('0' || (page_id % 28 + 1), 2) || '/'
               || right('000000' || page_id, 6) AS key,
               CAST(octet_length(encode(html)) AS BIGINT) AS bytes
        FROM pages"""),
    "rough": (("base",), """
        SELECT seq, CASE WHEN seq % 19 = 0 THEN NULL WHEN seq % 71 = 0 THEN '' ELSE id END AS id,
               CASE WHEN seq % 23 = 0 THEN NULL ELSE event END AS event,
               CASE WHEN seq % 17 = 0 THEN NULL WHEN seq % 37 = 0 THEN 'null' WHEN seq % 41 = 0 THEN '0'
                    WHEN seq % 43 = 0 THEN '""' WHEN seq % 47 = 0 THEN '{}' WHEN seq % 53 = 0 THEN 'false'
                    WHEN seq % 61 = 0 THEN '[]' WHEN seq % 67 = 0 THEN '0.5' ELSE payload END AS payload,
               CASE WHEN seq % 59 = 0 THEN 'chunk/' || seq END AS s3_key,
               CASE WHEN seq % 89 = 0 THEN 'other' ELSE cmd END AS cmd
        FROM base"""),
    "json_rows": (("base",), f"""
        SELECT *, '{{"id":"' || id || '","event":"' || event || '"'
               || coalesce(',"payload":' || payload, '') || coalesce(',"timestamp":' || write_ms, '')
               || coalesce(',"event_source_timestamp":' || source_ms, '')
               || coalesce(',"_cmd":"' || cmd || '"', '')
               || CASE WHEN archive THEN ',"start":"' || {sql_position(_SPAN, '0')} || '"'
                       WHEN cmd IS NOT NULL THEN ',"start":"' || ms || '"' ELSE '' END
               || CASE WHEN cmd IS NOT NULL THEN ',"next":"' || (ms + 3600000) || '"' ELSE '' END
               || CASE WHEN archive THEN ',"end":"' || {sql_position(_SPAN, 'seq % 1000')} || '","archive":true' ELSE '' END
               || CASE WHEN snapshot THEN ',"snapshot":' || {_SPAN} ELSE '' END || '}}' AS json
        FROM base"""),
}


def sql_with(names: tuple[str, ...], sql: str) -> str:
    """``sql`` preceded by the named views and the views they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in SQL_VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return sql
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in ordered)
    return f"WITH {views}\n{sql}"
