"""Filters, names, defaults, expiry, decoding and typing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions.typed import image_json, parsed_image, plain_image, typed_json, typed_list, typed_map
from ..operators import normalize, numbering, stats
from ..sources import records as rec
from . import views
from .registry import query
from .views import NOW_MS, table

_VALID = """coalesce(length(event), 0) > 0
    AND ((coalesce(length(id), 0) > 0
          AND coalesce(payload NOT IN ('null', '0', '""', 'false'), FALSE)) OR s3_key IS NOT NULL)"""


@query("ingest_max_eid", """
    SELECT queue, max(eid) AS max_eid, count(*) AS records, CAST(sum(length(payload)) AS BIGINT) AS chars
    FROM stored GROUP BY queue""", ("stored",))
def ingest_max_eid(spark, sf_dir):
    """Queue catalog of an ingest: one aggregate over the scan, the rest on its totals."""
    rows = views.base_events(spark, sf_dir)
    rows = rows.withColumn("queue", names.canonical(F.col("event")))
    return stats.high_water_of_totals(numbering.batch_queue_totals(rows, views.is_live(rows)))


@query("validity", f"SELECT seq, id, event, payload FROM rough WHERE {_VALID}", ("rough",))
def validity(spark, sf_dir):
    return normalize.valid_bus_events(views.rough(spark, sf_dir)).select("seq", "id", "event", "payload")


@query("file_validity", """
    SELECT seq, id, event FROM rough WHERE coalesce(length(event), 0) > 0 OR coalesce(length(id), 0) > 0""", ("rough",))
def file_validity(spark, sf_dir):
    return normalize.valid_file_events(views.rough(spark, sf_dir)).select("seq", "id", "event")


@query("control_rows", """
    SELECT seq, CASE WHEN cmd IS NULL THEN 'data' WHEN cmd = 'registerSnapshot' THEN 'snapshot' END AS route
    FROM rough WHERE cmd IS NULL OR cmd = 'registerSnapshot'""", ("rough",))
def control_rows(spark, sf_dir):
    rows = views.rough(spark, sf_dir)
    data = normalize.data_rows(rows).select("seq", F.lit("data").alias("route"))
    marks = normalize.snapshot_commands(normalize.control_rows(rows)).select("seq", F.lit("snapshot").alias("route"))
    return data.unionByName(marks)


@query("skip_lists", """
    SELECT seq, id, event FROM base
    WHERE regexp_replace(event, '^queue:', '') NOT IN ('click', 'error') AND id <> 'bot-3'""", ("base",))
def skip_lists(spark, sf_dir):
    rows = views.base_events(spark, sf_dir).select("seq", "id", "event")
    return normalize.without_listed(rows, ["queue:click", "error"], ["bot-3"])


@query("skip_tables", """
    SELECT seq, id, event FROM base WHERE id NOT IN (SELECT id FROM bots WHERE archived)""", ("base", "bots"))
def skip_tables(spark, sf_dir):
    rows = views.base_events(spark, sf_dir).select("seq", "id", "event")
    return normalize.without_listed(rows, bots=views.bots(spark, sf_dir).filter("archived").select("id"))


@query("queue_names", """
    SELECT seq, regexp_replace(event, '^queue:', '')
           || CASE WHEN archive THEN '/_archive' WHEN snapshot THEN '/_snapshot' ELSE '' END AS queue,
           regexp_replace(event, '^queue:', '') AS parent
    FROM base""", ("base",))
def queue_names(spark, sf_dir):
    rows = normalize.with_queue(views.base_events(spark, sf_dir))
    return rows.select("seq", "queue", names.parent_of(F.col("queue")).alias("parent"))


@query("default_times", f"""
    SELECT seq, coalesce(write_ms, {NOW_MS}) AS write_ms,
           CASE WHEN seq % 13 = 0 THEN coalesce(write_ms, {NOW_MS})
                WHEN seq % 5 IN (1, 2) THEN ms // 1000 * 1000
                WHEN seq % 5 = 3 THEN ms // 1000 * 1000 - 7200000 ELSE ms END AS source_ms
    FROM base""", ("base",))
def default_times(spark, sf_dir):
    rows = views.base_events(spark, sf_dir)
    text, form = views.iso_text(F.col("ms")), F.col("seq") % 5
    origin = (
        F.when(form == 1, text).when(form == 2, F.concat(text, F.lit("Z")))
        .when(form == 3, F.concat(text, F.lit("+02:00"))).otherwise(F.col("ms").cast("string"))
    )
    rows = rows.withColumn("source_ms", F.when(F.col("source_ms").isNotNull(), origin))
    return normalize.with_times(rows, NOW_MS).select("seq", "write_ms", "source_ms")


_QUEUE_SQL = """regexp_replace(event, '^queue:', '')
    || CASE WHEN archive THEN '/_archive' WHEN snapshot THEN '/_snapshot' ELSE '' END"""


@query("expiry", f"""
    SELECT seq, {_QUEUE_SQL} AS queue,
           CASE WHEN NOT archive THEN (arrival_ms + 604800000) // 1000 END AS ttl
    FROM envelope""", ("envelope",))
def expiry(spark, sf_dir):
    rows = normalize.with_ttl(normalize.with_queue(views.envelope(spark, sf_dir)))
    return rows.select("seq", "queue", "ttl")


@query("retention", f"""
    SELECT seq, {_QUEUE_SQL} AS queue FROM envelope
    WHERE archive OR (arrival_ms + 604800000) // 1000 > {NOW_MS // 1000}""", ("envelope",))
def retention(spark, sf_dir):
    rows = normalize.with_ttl(normalize.with_queue(views.envelope(spark, sf_dir)))
    return normalize.retained(rows, NOW_MS // 1000).select("seq", "queue")


@query("creator_tag", "SELECT seq, id, 'firehose' AS creator FROM base", ("base",))
def creator_tag(spark, sf_dir):
    return normalize.with_creator(views.base_events(spark, sf_dir), "firehose").select("seq", "id", "creator")


@query("backlog_flag", f"""
    SELECT shard, batch, count(*) AS records, min(arrival_ms) AS first_ms,
           1706572800000 - min(arrival_ms) > 3000 OR count(*) > 100 AS bulk
    FROM envelope GROUP BY shard, batch""", ("envelope",))
def backlog_flag(spark, sf_dir):
    # Seen from 2024-01-30, when the last batches are still fresh.
    return normalize.batch_backlog(views.envelope(spark, sf_dir), 1_706_572_800_000, ["shard", "batch"])


_KIND = """CASE WHEN v IS NULL OR v = 'null' THEN 'null' WHEN regexp_full_match(v, '\\d+(\\.\\d*)?') THEN 'number'
    WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN v = 'undefined' THEN 'absent' ELSE 'text' END"""


@query("infer_types", f"""
    WITH texts AS (
      SELECT doc_id, unnest(['source', 'lang', 'length', 'ratio', 'signed', 'flag', 'gap']) AS name,
             unnest([source, CASE WHEN doc_id % 7 = 0 THEN 'undefined' ELSE lang END,
                     CAST(n_chars AS VARCHAR), n_chars || '.', '-' || n_chars,
                     CASE WHEN doc_id % 2 = 0 THEN 'TRUE' ELSE 'false' END,
                     CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '1e3' END]) AS v
      FROM documents)
    SELECT doc_id, name, kind, CASE WHEN kind = 'number' THEN CAST(v AS DOUBLE) END AS number,
           CASE WHEN kind = 'boolean' THEN lower(v) = 'true' END AS flag, CASE WHEN kind = 'text' THEN v END AS text
    FROM (SELECT *, {_KIND} AS kind FROM texts) WHERE kind <> 'absent'""")
def infer_types(spark, sf_dir):
    doc, chars = F.col("doc_id"), F.col("n_chars").cast("string")
    texts = F.create_map(
        F.lit("source"), F.col("source"),
        F.lit("lang"), F.when(doc % 7 == 0, "undefined").otherwise(F.col("lang")),
        F.lit("length"), chars,
        F.lit("ratio"), F.concat(chars, F.lit(".")),
        F.lit("signed"), F.concat(F.lit("-"), chars),
        F.lit("flag"), F.when(doc % 2 == 0, "TRUE").otherwise("false"),
        F.lit("gap"), F.when(doc % 3 == 0, "null").otherwise("1e3"),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(typed_map(texts)).alias("name", "v"))
    return rows.select("doc_id", "name", "v.kind", "v.number", "v.flag", "v.text")


@query("infer_list_types", f"""
    WITH texts AS (
      SELECT event_id, pos, CASE pos WHEN 0 THEN event_type WHEN 1 THEN CAST(user_id AS VARCHAR)
             ELSE regexp_extract(props, ': (\\d+)', 1) END AS v
      FROM events, (SELECT unnest([0, 1, 2]) AS pos))
    SELECT event_id, CAST(pos AS INTEGER) AS pos, {_KIND} AS kind,
           CASE WHEN {_KIND} = 'number' THEN CAST(v AS DOUBLE) END AS number
    FROM texts""")
def infer_list_types(spark, sf_dir):
    items = F.array("event_type", F.col("user_id").cast("string"), F.regexp_extract("props", r": (\d+)", 1))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(typed_list(items)).alias("pos", "v"))
    return rows.select("event_id", "pos", "v.kind", "v.number")


@query("infer_nested", """
    SELECT doc_id, '{"facts":[' || n_chars || ',"-' || n_chars || '",{"long":' || (n_chars > 500) || '}],'
           || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '"gap":{"of":null},' END
           || '"id":' || doc_id || ',"lang":"' || lang || '"}' AS typed
    FROM documents""")
def infer_nested(spark, sf_dir):
    """Documents' facts as nested texts, typed at every depth; absent values leave their object."""
    doc, chars = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    facts = F.to_json(F.struct(F.struct(F.when(F.col("n_chars") > 500, "TRUE").otherwise("False").alias("long")).alias("x")))
    nested = F.concat(
        F.lit('{"id":"00'), doc, F.lit('.","facts":["'), chars, F.lit('","-'), chars, F.lit('",'), F.get_json_object(facts, "$.x"),
        F.lit('],"gap":'), F.when(F.col("doc_id") % 3 == 0, '"undefined"').otherwise('{"of":"null"}'),
        F.lit(',"none":"undefined","lang":"'), F.col("lang"), F.lit('"}'),
    )
    return table(spark, sf_dir, "documents").select("doc_id", typed_json(nested).alias("typed"))


@query("record_source", """
    SELECT 'shardId-' || shard AS shard, right('000000000000' || seq, 12) AS sequence, ms AS arrival_ms,
           4 * ((CAST(octet_length(encode(json)) AS BIGINT) + 2) // 3) AS chars
    FROM json_rows""", ("json_rows",))
def record_source(spark, sf_dir):
    """Delivered records written as JSON text and read back as shard, sequence, arrival, data."""
    rows = views.json_rows(spark, sf_dir)
    sequence = F.lpad(F.col("seq").cast("string"), 12, "0")
    delivered = F.struct(
        F.concat(F.lit("shardId-"), F.col("shard").cast("string"), F.lit(":"), sequence).alias("eventID"),
        F.struct(
            views.pack_plain(F.col("json")).alias("data"),
            sequence.alias("sequenceNumber"),
            (F.col("ms") / 1000).alias("approximateArrivalTimestamp"),
        ).alias("kinesis"),
    )
    texts = rows.select(F.to_json(delivered).alias("text"))
    records = rec.delivered_records(texts.select(rec.parse_delivered(F.col("text")).alias("r")).select("r.*"))
    return records.select("shard", "sequence", "arrival_ms", F.length("data").cast("bigint").alias("chars"))


_DECODED = """
    SELECT seq // 2 AS pair, CAST(seq % 2 AS INTEGER) AS line, id, event, replace(payload, ' ', '') AS payload,
           write_ms, CAST(source_ms AS VARCHAR) AS source_ms, cmd, archive, snapshot
    FROM base"""


@query("decode_records", f"{_DECODED} WHERE (seq // 2) % 7 <> 0 AND (seq // 2) % 11 <> 0", ("base",))
def decode_records(spark, sf_dir):
    """Encoded records, decoded on the bus path: unknown encodings are dropped."""
    rows = rec.envelopes(rec.parsed_lines(rec.decoded_texts(views.encoded(spark, sf_dir))))
    return rows.select(
        "pair", "line", "id", "event", "payload", "write_ms", "source_ms", "cmd", "archive", "snapshot"
    )


@query("decode_raw_lines", """
    SELECT seq // 2 AS pair, CASE WHEN (seq // 2) % 7 = 0 OR (seq // 2) % 11 = 0 THEN 'not json' END AS problem,
           CASE WHEN (seq // 2) % 7 = 0 OR (seq // 2) % 11 = 0 THEN 1 ELSE count(*) END AS lines
    FROM base GROUP BY 1, 2""", ("base",))
def decode_raw_lines(spark, sf_dir):
    """The file path keeps unknown texts as they are; they end up among the bad lines."""
    parsed = rec.parsed_lines(rec.decoded_texts(views.encoded(spark, sf_dir), raw=True))
    good = rec.envelopes(parsed).select("pair", F.lit(None).cast("string").alias("problem"))
    return good.unionByName(rec.bad_lines(parsed).select("pair", "problem")).groupBy("pair", "problem").agg(
        F.count("*").alias("lines")
    )


@query("broken_lines", """
    SELECT seq, 'not json' AS problem FROM json_rows WHERE seq % 3 = 0""", ("json_rows",))
def broken_lines(spark, sf_dir):
    """Lines cut before their end are quarantined, blank ones give nothing."""
    rows = views.json_rows(spark, sf_dir)
    cut = F.when(F.col("seq") % 3 == 0, F.substring("json", F.lit(1), F.length("json") - 1)).otherwise(F.col("json"))
    texts = rows.select("seq", F.concat(F.lit("\n  \n"), cut, F.lit("\n")).alias("text"))
    return rec.bad_lines(rec.parsed_lines(texts)).select("seq", "problem")


_DOCUMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("paused", T.BooleanType()),
    T.StructField("records", T.LongType()),
    T.StructField("triggers", T.ArrayType(T.StringType())),
    T.StructField("read", T.MapType(T.StringType(), T.StructType([
        T.StructField("checkpoint", T.StringType()), T.StructField("ended", T.LongType()),
    ]))),
])


@query("typed_attributes", """
    SELECT id, queue, ev_day, records % 2 = 0 AS paused, records, queue AS first_trigger,
           CAST(pos AS VARCHAR) AS checkpoint, CASE WHEN records % 5 <> 0 THEN ended_ms END AS ended
    FROM daily""", ("daily",))
def typed_attributes(spark, sf_dir):
    """Documents to typed-attribute JSON and back."""
    rows = views.daily(spark, sf_dir)
    checkpoint = F.struct(
        F.col("pos").cast("string").alias("checkpoint"),
        F.when(F.col("records") % 5 != 0, F.col("ended_ms")).alias("ended"),
    )
    document = F.struct(
        "id", (F.col("records") % 2 == 0).alias("paused"), "records", F.array("queue").alias("triggers"),
        F.create_map(F.col("queue"), checkpoint).alias("read"),
    )
    texts = rows.select("ev_day", image_json(document, _DOCUMENT).alias("text"))
    parsed = texts.select("ev_day", parsed_image(F.col("text"), _DOCUMENT).alias("_d"))
    parsed = parsed.select("ev_day", plain_image(F.col("_d"), _DOCUMENT).alias("d"))
    return parsed.select("ev_day", "d", F.explode("d.read").alias("queue", "cp")).select(
        "d.id", "queue", "ev_day", "d.paused", "d.records", F.element_at("d.triggers", 1).alias("first_trigger"),
        "cp.checkpoint", "cp.ended",
    )
