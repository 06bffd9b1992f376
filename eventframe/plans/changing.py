"""Change feeds, monitoring, triggers, routes, state merges and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import positions
from ..functions.times import div
from ..functions.typed import image_json
from ..operators import merges, monitor, routing, stats, triggers, validate
from ..schemas import BOT_IMAGE, CHANGE, QUEUE_IMAGE
from ..sources import changes as feed
from . import views
from .registry import query
from .views import EVENT_TYPES, HALF_MS, NOW_MS, sql_position, table


def _checkpoint(prefix: str = ""):
    name = (lambda c: F.col(f"{prefix}{c}"))
    return F.struct(
        name("pos").cast("string").alias("checkpoint"),
        F.when(name("records") % 4 != 0, name("records")).alias("records"),
        F.when(name("records") % 5 != 0, name("started_ms") - 1000).alias("source_timestamp"),
        F.when(name("records") % 6 != 0, name("started_ms")).alias("started_timestamp"),
        F.when(name("records") % 7 != 0, name("ended_ms")).alias("ended_timestamp"),
    )


def bot_changes(spark, sf_dir):
    """Old and new bot documents per bot, queue and day."""
    rows = views.changes(spark, sf_dir)

    def document(prefix: str):
        name = (lambda c: F.col(f"{prefix}{c}"))
        instance = F.struct(
            F.when(F.lit(prefix == "") | F.col("old_records").isNotNull(), name("invoke_ms")).alias("invokeTime"),
            F.lit(None).cast("bigint").alias("startTime"),
            name("completed_ms").alias("completedTime"),
            F.col("status").alias("status"),
        )
        return F.struct(
            "id",
            F.lit(False).alias("archived"),
            F.lit(False).alias("paused"),
            (F.col("id") == "bot-4").alias("ignoreMonitor"),
            F.array("queue").alias("triggers"),
            F.lit(None).cast("bigint").alias("trigger"),
            name("invoke_ms").alias("invokeTime"),
            F.lit(None).cast("map<string,string>").alias("requested_kinesis"),
            F.struct(
                F.create_map(F.col("queue"), _checkpoint(prefix)).alias("read"),
                F.when(F.col("pos") % 2 == 0, F.create_map(F.concat("queue", F.lit("-out")), _checkpoint(prefix))).alias("write"),
            ).alias("checkpoints"),
            F.create_map(F.lit("0"), instance).alias("instances"),
        )

    return rows.select(
        "id", "queue", "ev_day", document("").alias("new"), F.when(~F.col("first"), document("old_")).alias("old"),
        ((F.col("ev_day") + 1) * 86_400_000).alias("changed_ms"),
    )


_INSTANCE = """
    SELECT id, CASE WHEN done THEN 'completed' ELSE 'started' END AS type, CASE WHEN done THEN completed_ms END AS ts,
           CASE WHEN done THEN coalesce(old_invoke_ms, (ev_day + 1) * 86400000) ELSE invoke_ms END AS start_ms,
           CASE WHEN done THEN status = 'error' END AS is_error
    FROM (SELECT *, completed_ms IS NOT NULL AND old_completed_ms IS NULL AS done FROM changes)
    WHERE done OR old_invoke_ms IS DISTINCT FROM invoke_ms"""


def _checkpoint_sql(kind: str) -> str:
    queue = "queue" if kind == "read" else "queue || '-out'"
    moved = "old_pos IS DISTINCT FROM pos" + ("" if kind == "read" else " AND pos % 2 = 0")
    return f"""
    SELECT id, '{kind}' AS type, {queue} AS other, CAST(pos AS VARCHAR) AS checkpoint,
           CASE WHEN records % 7 <> 0 THEN ended_ms ELSE (ev_day + 1) * 86400000 END AS ts,
           CASE WHEN records % 4 <> 0 THEN records END AS units,
           CASE WHEN records % 6 <> 0 THEN started_ms ELSE (ev_day + 1) * 86400000 END AS start_ms,
           CASE WHEN records % 5 <> 0 THEN started_ms - 1000 ELSE (ev_day + 1) * 86400000 END AS source_ts
    FROM changes WHERE {moved}"""


@query("instance_facts", _INSTANCE, ("changes",))
def instance_facts(spark, sf_dir):
    return monitor.instance_facts(bot_changes(spark, sf_dir)).withColumnRenamed("start", "start_ms")


@query("checkpoint_facts", f"{_checkpoint_sql('read')} UNION ALL {_checkpoint_sql('write')}", ("changes",))
def checkpoint_facts(spark, sf_dir):
    rows = monitor.checkpoint_facts(bot_changes(spark, sf_dir))
    return rows.withColumn("other", F.coalesce("from", "to")).drop("from", "to").withColumnRenamed("start", "start_ms")


_FEED = f"""
    SELECT id, type, ts, start_ms, is_error, NULL AS from_queue, NULL AS to_queue, NULL AS checkpoint,
           CAST(NULL AS BIGINT) AS units, CAST(NULL AS BIGINT) AS source_ts
    FROM ({_INSTANCE}) WHERE id NOT IN ('bot-7', 'bot-4')
    UNION ALL
    SELECT id, type, ts, start_ms, NULL, other, NULL, checkpoint, units, source_ts
    FROM ({_checkpoint_sql('read')}) WHERE id NOT IN ('bot-7', 'bot-4')
    UNION ALL
    SELECT id, type, ts, start_ms, NULL, NULL, other, checkpoint, units, source_ts
    FROM ({_checkpoint_sql('write')}) WHERE id NOT IN ('bot-7', 'bot-4')"""


@query("monitor_feed", _FEED, ("changes",))
def monitor_feed(spark, sf_dir):
    """All facts; bot-7 plays the monitor itself, bot-4 opts out."""
    rows = monitor.monitor_feed(bot_changes(spark, sf_dir), "bot-7")
    return rows.withColumnsRenamed({"start": "start_ms", "from": "from_queue", "to": "to_queue"})


def change_records(spark, sf_dir):
    """Bot changes as change records with typed-attribute images."""
    rows = bot_changes(spark, sf_dir)
    return rows.select(
        F.when(F.col("old").isNull(), "INSERT").otherwise("MODIFY").alias("eventName"),
        F.struct(
            (F.col("changed_ms") / 1000).cast("bigint").alias("ApproximateCreationDateTime"),
            F.lpad(F.col("new.checkpoints.read")[F.col("queue")]["checkpoint"], 21, "0").alias("SequenceNumber"),
            F.to_json(F.struct("id")).alias("Keys"),
            image_json(F.col("new"), BOT_IMAGE).alias("NewImage"),
            F.when(F.col("old").isNotNull(), image_json(F.col("old"), BOT_IMAGE)).alias("OldImage"),
        ).alias("dynamodb"),
    )


@query("monitor_from_records", _FEED, ("changes",))
def monitor_from_records(spark, sf_dir):
    """The same facts from change records in their JSON form."""
    texts = change_records(spark, sf_dir).select(F.to_json(F.struct("*")).alias("text"))
    records = texts.select(F.from_json("text", CHANGE).alias("r")).select("r.*")
    rows = monitor.monitor_feed(feed.typed_changes(records, BOT_IMAGE), "bot-7")
    return rows.withColumnsRenamed({"start": "start_ms", "from": "from_queue", "to": "to_queue"})


def queue_changes(spark, sf_dir):
    """Versions of queue documents: one per queue and batch, in several generations of columns."""
    rows = views.base_events(spark, sf_dir).withColumn("queue", F.regexp_replace("event", "^queue:", ""))
    versions = rows.groupBy("queue", "batch").agg(F.max("ms").alias("ms"), F.max("seq").alias("seq"))
    own = positions.position(F.col("ms"), F.col("seq"))
    held = F.when(F.col("batch") % 3 == 0, positions.position(F.col("ms") - 3_600_000, F.lit(0)))
    document = F.struct(
        F.concat(F.lit("queue:"), "queue").alias("event"),
        held.alias("kinesis_number"),
        *[F.lit(None).cast("string").alias(c) for c in ("s3_kinesis_number", "initial_kinesis_number", "s3_new_kinesis_number")],
        F.when(F.col("batch") % 2 == 0, own).alias("eid"),
        F.when(F.col("batch") % 2 == 1, own).alias("max_eid"),
    )
    versions = versions.withColumn("stretch", div(F.col("batch"), 64))
    return feed.changes_of_versions(versions, ["queue"], ["stretch"], ["batch"], document)


_QUEUE_CHANGES = f"""
    SELECT queue, batch, {sql_position('ms', 'seq')} AS version,
           lag({sql_position('ms', 'seq')}) OVER (PARTITION BY queue ORDER BY batch) AS was
    FROM (SELECT regexp_replace(event, '^queue:', '') AS queue, batch, max(ms) AS ms, max(seq) AS seq
          FROM base GROUP BY 1, 2)"""


@query("queue_versions", _QUEUE_CHANGES, ("base",))
def queue_versions(spark, sf_dir):
    """Greatest position of old and new queue documents, whatever column holds it."""
    rows = queue_changes(spark, sf_dir)
    return rows.select(
        "queue", "batch", triggers.queue_version(F.col("new")).alias("version"),
        triggers.queue_version(F.col("old")).alias("was"),
    )


@query("change_feed", f"""
    SELECT queue, version, was, CASE WHEN was IS NULL THEN 'INSERT' ELSE 'MODIFY' END AS kind
    FROM ({_QUEUE_CHANGES})""", ("base",))
def change_feed(spark, sf_dir):
    """Queue changes as typed-attribute records, parsed back to documents."""
    records = queue_change_records(spark, sf_dir)
    rows = feed.typed_changes(records, QUEUE_IMAGE)
    return rows.select(
        F.regexp_replace("new.event", "^queue:", "").alias("queue"), triggers.queue_version(F.col("new")).alias("version"),
        triggers.queue_version(F.col("old")).alias("was"), "kind",
    )


def queue_change_records(spark, sf_dir):
    rows = queue_changes(spark, sf_dir)
    return rows.select(
        F.col("kind").alias("eventName"),
        F.struct(
            (F.col("ms") / 1000).cast("bigint").alias("ApproximateCreationDateTime"),
            F.lpad(F.col("batch").cast("string"), 21, "0").alias("SequenceNumber"),
            F.to_json(F.struct("queue")).alias("Keys"),
            image_json(F.col("new"), QUEUE_IMAGE).alias("NewImage"),
            F.when(F.col("old").isNotNull(), image_json(F.col("old"), QUEUE_IMAGE)).alias("OldImage"),
        ).alias("dynamodb"),
    )


_FANOUT = f"""
    SELECT DISTINCT b.id, queue, version
    FROM (SELECT queue, arg_max(version, batch) AS version FROM ({_QUEUE_CHANGES}) WHERE version IS DISTINCT FROM was GROUP BY queue)
    JOIN (SELECT id, unnest([t1, t2]) AS queue FROM bots WHERE NOT archived) b USING (queue)"""


@query("trigger_fanout", _FANOUT, ("base", "bots"))
def trigger_fanout(spark, sf_dir):
    rows = queue_changes(spark, sf_dir).withColumn("seq", F.col("batch"))
    return triggers.trigger_rows(rows, views.bots(spark, sf_dir))


def mapping_texts(spark, sf_dir):
    """A mapping text per supplier: a plain queue, and one with some parts given."""
    kinds = F.array(*[F.lit(k) for k in EVENT_TYPES])
    key, side = F.col("s_suppkey"), F.col("s_nationkey") % 2
    plain = F.element_at(kinds, (key % 5 + 1).cast("int"))
    given = F.element_at(kinds, ((key + 1) % 5 + 1).cast("int"))
    parts = F.concat_ws(
        ",",
        F.when(key % 2 == 0, F.concat(F.lit('"account":"'), (side + 10_000).cast("string"), F.lit('"'))),
        F.when(key % 3 == 0, F.concat(F.lit('"stack":"bus-'), side.cast("string"), F.lit('"'))),
        F.when(side == 1, F.concat(F.lit('"destination":"'), given, F.lit('-copy"'))),
    )
    mapping = F.concat(F.lit('["queue:'), plain, F.lit('", {"'), given, F.lit('":{'), parts, F.lit("}}]"))
    return table(spark, sf_dir, "supplier").select(key.alias("pos"), mapping.alias("mapping"))


def address_texts(spark, sf_dir):
    """A role address per supplier; some are malformed."""
    key = F.col("s_nationkey")
    service = F.when(F.col("s_suppkey") % 6 == 5, "arn:aws:rolez::").otherwise("arn:aws:iam::")
    address = F.concat(
        service, (key + 10_000).cast("string"), F.lit(":role/bus-"), (key % 3).cast("string"), F.lit("-BusRole-"),
        F.col("s_suppkey").cast("string"),
    )
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), address.alias("address"))


_DESTINATIONS = """
    SELECT CAST(10000 + s_nationkey AS VARCHAR) AS account, 'bus-' || (s_nationkey % 3) AS stack,
           arg_min('arn:aws:iam::' || (10000 + s_nationkey) || ':role/bus-' || (s_nationkey % 3) || '-BusRole-' || s_suppkey, s_suppkey) AS address,
           min(s_suppkey) AS pos
    FROM supplier WHERE s_suppkey % 6 <> 5 GROUP BY 1, 2"""
_KINDS = "[" + ", ".join(f"'{k}'" for k in EVENT_TYPES) + "]"
_ROUTES = f"""
    SELECT pos, entry_pos, source, coalesce(a, account) AS account, coalesce(s, stack) AS stack, destination
    FROM (SELECT s_suppkey AS pos, CAST(0 AS INTEGER) AS entry_pos, 'queue:' || {_KINDS}[s_suppkey % 5 + 1] AS source,
                 NULL AS a, NULL AS s, 'queue:' || {_KINDS}[s_suppkey % 5 + 1] AS destination FROM supplier
          UNION ALL
          SELECT s_suppkey, 1, {_KINDS}[(s_suppkey + 1) % 5 + 1],
                 CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey % 2 + 10000 AS VARCHAR) END,
                 CASE WHEN s_suppkey % 3 = 0 THEN 'bus-' || (s_nationkey % 2) END,
                 {_KINDS}[(s_suppkey + 1) % 5 + 1] || CASE WHEN s_nationkey % 2 = 1 THEN '-copy' ELSE '' END FROM supplier),
         (SELECT account, stack FROM ({_DESTINATIONS}) ORDER BY pos LIMIT 1)"""


def _routes(spark, sf_dir):
    found = routing.destinations(address_texts(spark, sf_dir), "BusRole")
    return routing.routes(mapping_texts(spark, sf_dir), *routing.default_destination(found)), found


@query("destination_dedupe", _DESTINATIONS)
def destination_dedupe(spark, sf_dir):
    return routing.destinations(address_texts(spark, sf_dir), "BusRole")


@query("route_table", _ROUTES)
def route_table(spark, sf_dir):
    return _routes(spark, sf_dir)[0]


@query("route_events", f"""
    SELECT seq, s.queue, account, stack, destination
    FROM stored s JOIN (SELECT DISTINCT account, stack, destination, regexp_replace(source, '^queue:', '') AS queue
                        FROM ({_ROUTES})) r
      ON r.queue = s.queue""", ("stored",))
def route_events(spark, sf_dir):
    routes, _ = _routes(spark, sf_dir)
    return routing.route_events(views.numbered(spark, sf_dir).select("seq", "queue"), routes)


@query("route_check", f"""
    SELECT account, stack, 'route without destination' AS problem
    FROM (SELECT DISTINCT account, stack FROM ({_ROUTES})) WHERE (account, stack) NOT IN (SELECT (account, stack) FROM ({_DESTINATIONS}))
    UNION ALL
    SELECT account, stack, 'destination without route'
    FROM ({_DESTINATIONS}) WHERE (account, stack) NOT IN (SELECT (account, stack) FROM ({_ROUTES}))""")
def route_check(spark, sf_dir):
    return routing.unmatched(*_routes(spark, sf_dir))


@query("replication_bots", f"""
    SELECT 'replicate-' || source || '-to-' || account || '-' || stack || '-' || destination AS id, source, destination
    FROM ({_ROUTES})""")
def replication_bots(spark, sf_dir):
    return routing.replication_bots(_routes(spark, sf_dir)[0]).select("id", "source", "destination")


@query("drop_keys", """
    SELECT s_suppkey, 'Bot' || s_nationkey AS key, s_name AS value FROM supplier
    UNION ALL SELECT s_suppkey, 'LeftOver', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def drop_keys(spark, sf_dir):
    items = F.create_map(
        F.lit("ServiceToken"), F.lit("t"), F.concat(F.lit("Bot"), F.col("s_nationkey").cast("string")), F.col("s_name"),
        F.lit("Version"), F.lit("1.0"), F.lit("LeftOver"), F.col("s_nationkey").cast("string"),
    )
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", items.alias("items"))
    return routing.registry_items(rows, ["ServiceToken", "Version"])


def _halves(spark, sf_dir):
    """Per user and queue: the state mid-month and what the second half changes."""
    rows = views.base_events(spark, sf_dir).withColumn("queue", F.regexp_replace("event", "^queue:", ""))
    key = [F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id"), F.col("queue")]

    def summary(part):
        return part.groupBy(*key).agg(F.max("ms").alias("ms"), F.max("seq").alias("seq"), F.count("*").alias("n"))

    return summary(rows.filter(F.col("ms") < HALF_MS)), summary(rows.filter(F.col("ms") >= HALF_MS))


def _halves_sql(condition: str) -> str:
    return f"""SELECT 'user-' || user_id AS id, regexp_replace(event, '^queue:', '') AS queue, max(ms) AS ms,
        max(seq) AS seq, count(*) AS n FROM base WHERE ms {condition} {HALF_MS} GROUP BY 1, 2"""


_OLD, _NEW = _halves_sql("<"), _halves_sql(">=")


@query("upsert_state", f"""
    SELECT id, queue, coalesce(CASE WHEN n.seq % 3 <> 0 THEN {sql_position('n.ms', 'n.seq')} END, {sql_position('o.ms', 'o.seq')}) AS max_eid,
           coalesce(n.ms, o.ms) AS timestamp, {sql_position('o.ms', '0')} AS archive_end,
           CASE WHEN n.seq % 2 = 0 THEN n.n END AS snapshot_rows
    FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (id, queue)""", ("base",))
def upsert_state(spark, sf_dir):
    """Changes set the columns they carry and leave the others."""
    old, new = _halves(spark, sf_dir)
    own = positions.position(F.col("ms"), F.col("seq"))
    state = old.select("id", "queue", own.alias("max_eid"), F.col("ms").alias("timestamp"),
                       positions.position(F.col("ms"), F.lit(0)).alias("archive_end"))
    changed = new.select("id", "queue", F.when(F.col("seq") % 3 != 0, own).alias("max_eid"),
                         F.col("ms").alias("timestamp"), F.when(F.col("seq") % 2 == 0, F.col("n")).alias("snapshot_rows"))
    return merges.upsert(state, changed, ["id", "queue"])


def _requests(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    own = positions.position(F.col("ms"), F.col("seq"))
    state = old.select(
        "id", "queue", F.lit("read").alias("type"), own.alias("eid"), F.col("n").alias("units"),
        *[F.col("ms").alias(f"{c}_timestamp") for c in ("source", "started", "ended")],
    )
    before = old.select("id", "queue", own.alias("before"))
    asked = new.join(before, ["id", "queue"], "left").select(
        "id", "queue", F.lit("").alias("type"), "seq", own.alias("eid"),
        F.when(F.col("seq") % 5 == 0, positions.position(F.col("ms"), F.lit(1))).alias("event_eid"),
        F.when(F.col("seq") % 4 != 0, F.lit(0)).otherwise(F.col("n")).cast("bigint").alias("units"),
        F.when(F.col("seq") % 3 != 0, F.col("n") * 2).alias("records"),
        F.when(F.col("seq") % 2 == 0, F.lit(False)).alias("force"),
        F.when(F.col("seq") % 7 != 0, F.col("before")).otherwise("z/none").alias("expected"),
        F.lit(None).cast("bigint").alias("event_source_timestamp"),
        F.col("ms").alias("source_timestamp"),
        F.lit(0).cast("bigint").alias("started_timestamp"),
        F.lit(None).cast("bigint").alias("ended_timestamp"),
    )
    return state, merges.checkpoint_requests(asked, NOW_MS)


@query("cas_checkpoint", f"""
    SELECT id, queue, 'read' AS type, CASE WHEN accepted THEN new_eid ELSE old_eid END AS eid,
           CASE WHEN accepted THEN new_units ELSE o_n END AS units,
           CASE WHEN accepted THEN n_ms ELSE o_ms END AS source_timestamp,
           CASE WHEN accepted THEN {NOW_MS} ELSE o_ms END AS started_timestamp,
           CASE WHEN accepted THEN {NOW_MS} ELSE o_ms END AS ended_timestamp, accepted, new_eid AS asked
    FROM (SELECT *, CASE WHEN n_seq IS NOT NULL THEN n_seq % 2 <> 0
                         OR old_eid IS NOT DISTINCT FROM CASE WHEN n_seq % 7 <> 0 THEN old_eid ELSE 'z/none' END END AS accepted
          FROM (SELECT id, queue, o.n AS o_n, o.ms AS o_ms, n.ms AS n_ms, n.seq AS n_seq, {sql_position('o.ms', 'o.seq')} AS old_eid,
                       CASE WHEN n.seq % 5 = 0 THEN {sql_position('n.ms', '1')} ELSE {sql_position('n.ms', 'n.seq')} END AS new_eid,
                       coalesce(CASE WHEN n.seq % 4 = 0 THEN n.n END, CASE WHEN n.seq % 3 <> 0 THEN n.n * 2 END, 1) AS new_units
                FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (id, queue)))""", ("base",))
def cas_checkpoint(spark, sf_dir):
    return merges.compare_and_set(*_requests(spark, sf_dir))


@query("insert_once", """
    SELECT 'bot-' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 = 0 WHEN s_suppkey % 5 = 0 THEN FALSE ELSE TRUE END AS paused,
           CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 = 0 THEN 'old-' || s_name ELSE s_name END AS name
    FROM supplier""")
def insert_once(spark, sf_dir):
    """Registrations of all suppliers as bots; every third is known already."""
    rows, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    named = F.concat(F.lit("bot-"), key.cast("string"))
    state = rows.filter(key % 3 == 0).select(
        named.alias("id"), (key % 2 == 0).alias("paused"), F.concat(F.lit("old-"), "s_name").alias("name")
    )
    given = rows.select(
        F.when(key % 2 == 0, F.concat(F.lit("arn:aws:lambda:us-east-1:111:function:"), named)).otherwise(named).alias("id"),
        F.when(key % 5 == 0, F.lit(False)).alias("paused"),
        F.when((key % 3 != 0) | (key % 4 != 0), F.col("s_name")).alias("name"),
    )
    return merges.register_bots(state, given)


def _requested(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    version = F.col("seq").cast("string").alias("version")
    state = old.select("id", "queue", version, F.lit(1).cast("bigint").alias("requested_ms"))
    return merges.merge_requested(state, new.select("id", "queue", version), NOW_MS)


@query("requested_positions", f"""
    SELECT id, queue, CAST(coalesce(n.seq, o.seq) AS VARCHAR) AS version,
           CAST(CASE WHEN n.seq IS NOT NULL THEN {NOW_MS} ELSE 1 END AS BIGINT) AS requested_ms
    FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (id, queue)""", ("base",))
def requested_positions(spark, sf_dir):
    return _requested(spark, sf_dir)


@query("trigger_times", f"""
    SELECT id, CAST(CASE WHEN max(ms) >= {HALF_MS} THEN {NOW_MS} ELSE 1 END AS BIGINT) AS trigger
    FROM (SELECT 'user-' || user_id AS id, ms FROM base) GROUP BY id""", ("base",))
def trigger_times(spark, sf_dir):
    return merges.trigger_times(_requested(spark, sf_dir))


def _maps(part):
    """A map per user; there is one entry per event type."""
    return part.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("queue", F.col("seq").cast("string")))).alias("requested")
    )


@query("document_merge", f"""
    SELECT id, queue, CAST(coalesce(n.seq, o.seq) AS VARCHAR) AS version, coalesce(nl.label, ol.label) AS label
    FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (id, queue)
    LEFT JOIN (SELECT id, 'old' AS label FROM ({_OLD}) GROUP BY id) ol USING (id)
    LEFT JOIN (SELECT id, CASE WHEN max(seq) % 2 = 0 THEN 'new' END AS label FROM ({_NEW}) GROUP BY id) nl USING (id)""", ("base",))
def document_merge(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    label = F.when(F.max("seq") % 2 == 0, "new")
    labels = new.groupBy("id").agg(label.alias("label"))
    merged = merges.merge_documents(
        _maps(old).withColumn("label", F.lit("old")), _maps(new).join(labels, "id")
    )
    return merged.select("id", F.explode("requested").alias("queue", "version"), "label")


@query("merge_write_checkpoints", """
    SELECT id, queue, max(eid) AS checkpoint, arg_max(source_ms, eid) AS source_timestamp,
           arg_max(write_ms, eid) AS started_timestamp, max(arrival_ms) AS ended_timestamp,
           count(*) FILTER (part = last) AS records
    FROM (SELECT *, (batch, shard) AS part, max_by((batch, shard), eid) OVER (PARTITION BY id, queue) AS last FROM (
          SELECT *, eid FROM stored))
    GROUP BY id, queue""", ("stored",))
def merge_write_checkpoints(spark, sf_dir):
    """Write checkpoints of two halves of the batches, the later ones merged into the earlier."""
    rows = stats.producer_stats(views.numbered(spark, sf_dir))
    early, late = rows.filter(F.col("batch_ms") < HALF_MS), rows.filter(F.col("batch_ms") >= HALF_MS)
    return merges.merge_write_checkpoints(stats.last_write_checkpoints(early), stats.last_write_checkpoints(late))


@query("semver_check", """
    SELECT queue, version, CASE WHEN no_schema THEN 'no schema' ELSE 'version is not semver' END AS problem
    FROM (SELECT 'part-' || p_partkey AS queue, p_partkey % 9 = 0 AS no_schema,
                 CASE p_partkey % 4 WHEN 0 THEN p_size || '.0' WHEN 1 THEN p_size || '.' || (p_partkey % 50) || '.0'
                      WHEN 2 THEN '0' || p_size || '.1.2' ELSE p_size || '.0.1-beta.' || p_partkey || '+b1' END AS version
          FROM part)
    WHERE no_schema OR split_part(version, '.', 3) = '' OR starts_with(version, '0')""")
def semver_check(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    version = (
        F.when(key % 4 == 0, F.concat(size, F.lit(".0")))
        .when(key % 4 == 1, F.concat(size, F.lit("."), (key % 50).cast("string"), F.lit(".0")))
        .when(key % 4 == 2, F.concat(F.lit("0"), size, F.lit(".1.2")))
        .otherwise(F.concat(size, F.lit(".0.1-beta."), key.cast("string"), F.lit("+b1")))
    )
    registry = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), key.cast("string")).alias("queue"), version.alias("version"),
        F.when(key % 9 != 0, "{}").alias("schema"),
    )
    return validate.registry_problems(registry).select("queue", "version", "problem")


CUSTOMER_SCHEMA = {"$ref": "defs.json#/definitions/customer"}
CUSTOMER_DEFINITIONS = {"definitions": {"customer": {
    "type": ["object"],
    "properties": {
        "key": {"type": ["integer"]},
        "name": {"type": "string"},
        "balance": {"type": ["number"]},
        "segment": {"type": ["string"], "nullable": True},
        "place": {
            "type": ["object"],
            "properties": {"nation": {"type": ["integer"]}, "lat": {"type": ["number"]}},
            "required": ["nation", "lat"],
        },
    },
    "required": ["key", "name", "balance", "segment", "place"],
}}}

_PAYLOAD = """
    SELECT c_custkey AS k, CASE WHEN c_custkey % 29 = 0 THEN 'oops{' WHEN c_custkey % 31 = 0 THEN '[1]' ELSE
        '{"key":' || CASE WHEN c_custkey % 11 = 0 THEN '"' || c_custkey || '"' WHEN c_custkey % 13 = 0 THEN c_custkey || '.5' ELSE c_custkey || '' END
        || CASE WHEN c_custkey % 7 <> 0 THEN ',"name":"' || c_name || '"' ELSE '' END
        || ',"balance":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE CAST(c_nationkey AS VARCHAR) || '.25' END
        || ',"segment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END
        || ',"place":' || CASE WHEN c_custkey % 17 = 0 THEN '"there"' WHEN c_custkey % 4 = 0 THEN '{"nation":' || c_nationkey || '}'
                               ELSE '{"nation":' || c_nationkey || ',"lat":' || (c_nationkey / 2) || '}' END || '}' END AS payload
    FROM customer"""


@query("payload_validate", f"""
    SELECT * FROM (WITH p AS ({_PAYLOAD}), j AS (SELECT k, CASE WHEN json_valid(payload) THEN json(payload) END AS d FROM p),
         o AS (SELECT * FROM j WHERE json_type(d) = 'OBJECT')
    SELECT k, '$' AS path, 'not json' AS problem FROM j WHERE d IS NULL
    UNION ALL SELECT k, '$', 'wrong type' FROM j WHERE json_type(d) <> 'OBJECT'
    UNION ALL SELECT k, '$[''key'']', 'wrong type' FROM o WHERE json_type(d, '$.key') NOT IN ('UBIGINT', 'BIGINT')
    UNION ALL SELECT k, '$[''name'']', 'missing' FROM o WHERE NOT json_exists(d, '$.name')
    UNION ALL SELECT k, '$[''balance'']', 'null not allowed' FROM o WHERE json_type(d, '$.balance') = 'NULL'
    UNION ALL SELECT k, '$[''place'']', 'wrong type' FROM o WHERE json_type(d, '$.place') <> 'OBJECT'
    UNION ALL SELECT k, '$[''place''][''lat'']', 'missing' FROM o
              WHERE json_type(d, '$.place') = 'OBJECT' AND NOT json_exists(d, '$.place.lat'))""")
def payload_validate(spark, sf_dir):
    """One row per failed check of the customers' payloads."""
    rows = validate.with_violations(customer_payloads(spark, sf_dir), CUSTOMER_SCHEMA, CUSTOMER_DEFINITIONS)
    return validate.violations(rows, "k")


def customer_payloads(spark, sf_dir):
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    text = key.cast("string")
    number = (
        F.when(key % 11 == 0, F.concat(F.lit('"'), text, F.lit('"'))).when(key % 13 == 0, F.concat(text, F.lit(".5")))
        .otherwise(text)
    )
    place = (
        F.when(key % 17 == 0, '"there"').when(key % 4 == 0, F.concat(F.lit('{"nation":'), nation, F.lit("}")))
        .otherwise(F.concat(F.lit('{"nation":'), nation, F.lit(',"lat":'), (F.col("c_nationkey") / 2).cast("string"), F.lit("}")))
    )
    document = F.concat(
        F.lit('{"key":'), number,
        F.when(key % 7 != 0, F.concat(F.lit(',"name":"'), "c_name", F.lit('"'))).otherwise(""),
        F.lit(',"balance":'), F.when(key % 5 == 0, "null").otherwise(F.concat(nation, F.lit(".25"))),
        F.lit(',"segment":'), F.when(key % 3 == 0, "null").otherwise(F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))),
        F.lit(',"place":'), place, F.lit("}"),
    )
    payload = F.when(key % 29 == 0, "oops{").when(key % 31 == 0, "[1]").otherwise(document)
    return table(spark, sf_dir, "customer").select(key.alias("k"), payload.alias("payload"))


@query("payload_good", f"""
    SELECT * FROM (WITH p AS ({_PAYLOAD}), j AS (SELECT k, CASE WHEN json_valid(payload) THEN json(payload) END AS d FROM p)
    SELECT k FROM j WHERE json_type(d) = 'OBJECT' AND json_type(d, '$.key') IN ('UBIGINT', 'BIGINT')
      AND json_exists(d, '$.name') AND json_type(d, '$.balance') <> 'NULL' AND json_type(d, '$.place') = 'OBJECT'
      AND json_exists(d, '$.place.lat'))""")
def payload_good(spark, sf_dir):
    rows = validate.with_violations(customer_payloads(spark, sf_dir), CUSTOMER_SCHEMA, CUSTOMER_DEFINITIONS)
    return validate.good_events(rows).select("k")

