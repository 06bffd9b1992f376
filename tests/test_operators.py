"""Operators against plain models on small rows, with hot keys and small buckets."""

from __future__ import annotations

import base64
import gzip
import json
import random
import re
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventframe.functions import names, positions, times
from eventframe.functions.typed import typed_json, typed_value
from eventframe.operators import archive, merges, monitor, normalize, numbering, routing, runlog, running, stats
from eventframe.operators import triggers, validate
from eventframe.plans.changing import CUSTOMER_DEFINITIONS, CUSTOMER_SCHEMA
from eventframe.schemas import BOT_IMAGE, CHANGE
from eventframe.session import work_dir
from eventframe.sources import changes as feed
from eventframe.sources import files, logs, queues
from eventframe.sources import records as rec


def sequential_clock(values, last=None):
    out = []
    for value in values:
        last = value if last is None or value > last else last + 1
        out.append(last)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 40), min_size=1, max_size=60), st.integers(1, 9), st.none() | st.integers(0, 60))
def test_batch_clock_is_the_sequential_rule(spark, values, bucket, last):
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "shard string, sequence long, value long")
    previous = None if last is None else spark.createDataFrame([("s", last)], "shard string, clock long")
    got = numbering.batch_clock(rows, previous, bucket_rows=bucket).orderBy("sequence")
    assert [r["clock"] for r in got.collect()] == sequential_clock(values, last)


def test_running_total_of_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 20}", i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, seq long, v long").withColumn("b", running.sequence_bucket(F.col("seq"), 64))
    got = {(r["g"], r["seq"]): r["t"] for r in running.with_running_total(df, ["g"], ["b"], ["seq"], F.col("v"), "t").collect()}
    sums, want = {}, {}
    for g, seq, v in rows:
        sums[g] = sums.get(g, 0) + v
        want[g, seq] = sums[g]
    assert got == want


def test_previous_value_across_buckets(spark):
    rows = [("hot" if i % 3 else "cold", i // 10, i, f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, b long, seq long, v string")
    got = {r["seq"]: r["p"] for r in running.with_previous(df, ["g"], ["b"], ["seq"], "v", "p").collect()}
    last, want = {}, {}
    for g, _, seq, v in rows:
        want[seq] = last.get(g)
        last[g] = v
    assert got == want


def test_counter_runs_across_queues_with_small_buckets(spark):
    rng = random.Random(7)
    rows = [(0, 0, rng.choice("abc"), i) for i in range(500)] + [(1, 0, "a", i) for i in range(20)]
    df = spark.createDataFrame(rows, "shard long, batch long, queue string, seq long")
    got = {(r["shard"], r["queue"], r["seq"]): r["counter"] for r in numbering.with_counter(df, bucket_rows=16).collect()}
    want = {}
    for shard in (0, 1):
        ordered = sorted((q, s) for sh, _, q, s in rows if sh == shard)
        want.update({(shard, q, s): n for n, (q, s) in enumerate(ordered)})
    assert got == want


def test_totals_and_numbered_rows_agree(spark):
    rows = [(i % 2, i // 50, "abc"[i % 3], i, i * 10, "x" * (i % 7), i % 5 > 0) for i in range(400)]
    df = spark.createDataFrame(rows, "shard long, batch long, queue string, seq long, ms long, payload string, keep boolean")
    totals = stats.high_water_of_totals(numbering.batch_queue_totals(df, F.col("keep")))
    arrivals = df.groupBy("shard", "batch").agg(F.min("ms").alias("arrival_ms"))
    numbered = numbering.with_counter(df.filter("keep").join(arrivals, ["shard", "batch"]))
    want = stats.high_water(numbered).select("queue", "max_eid")
    assert sorted(totals.select("queue", "max_eid").collect()) == sorted(want.collect())


def test_position_text_and_key(spark):
    rows = [(1706553709138, 14), (0, 0), (1709164800000, 9999999), (1499117519781, 12345678)]
    df = spark.createDataFrame(rows, "ms long, n long")
    k = positions.key(F.col("ms"), F.col("n"))
    got = df.select(positions.position(F.col("ms"), F.col("n")).alias("p"), positions.from_key(k).alias("q")).collect()
    assert got[0]["p"] == "z/2024/01/29/18/41/1706553709138-0000014"
    assert got[3]["p"].endswith("-2345678")
    assert all(r["p"] == r["q"] for r in got)


def test_position_order_is_key_order(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1_600_000_000_000, 1_800_000_000_000), rng.randint(0, 9_999_999)) for _ in range(300)]
    df = spark.createDataFrame(rows, "ms long, n long").select(
        positions.position(F.col("ms"), F.col("n")).alias("p"), positions.key(F.col("ms"), F.col("n")).alias("k")
    )
    got = df.collect()
    assert [r["p"] for r in sorted(got, key=lambda r: r["p"])] == [r["p"] for r in sorted(got, key=lambda r: r["k"])]


def test_first_day():
    assert positions.first_day("z/2024/01/29/18/41/1706553709138-0000014") == "2024-01-29"
    assert positions.first_day("z/2024/01") == "2024-01"
    assert positions.first_day("z/0") is None
    assert positions.first_day(None) is None


def test_parse_ms(spark):
    texts = ["1706553709138", "2024-01-29T18:41:49", "2024-01-29T18:41:49Z", "2024-01-29T20:41:49.138+02:00", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(times.parse_ms(F.col("t")).alias("ms"))
    assert [r["ms"] for r in df.collect()] == [1706553709138, 1706553709000, 1706553709000, 1706553709138, None, None]


def test_empty_payloads(spark):
    missing = [None, "", "null", "0", "-0", "0.0", "false", '""']
    present = ["{}", "[]", "1", "true", '"0"', '"a"', "0.5", "10"]
    df = spark.createDataFrame([(p,) for p in missing + present], "p string").select(normalize.has_payload(F.col("p")).alias("h"))
    assert [r["h"] for r in df.collect()] == [False] * len(missing) + [True] * len(present)


def encode(text, kind):
    data = text.encode()
    packed = {"gzip": gzip.compress, "zlib": zlib.compress, "best": lambda d: zlib.compress(d, 9), "plain": lambda d: d}[kind](data)
    return base64.b64encode(packed).decode()


def test_decode_keeps_or_drops_unknown(spark):
    line = '{"id":"cli","event":"q","payload":{"hello":"world","number":2345}}'
    rows = [(k, encode(line + "\n\n" + line, k)) for k in ("gzip", "zlib", "plain", "best")]
    rows += [("broken", "H4sIbroken"), ("other", "plain words")]
    df = spark.createDataFrame(rows, "kind string, data string")
    bus = {r["kind"]: r["text"] for r in rec.decoded_texts(df).collect()}
    assert set(bus) == {"gzip", "zlib", "plain", "broken"} and bus["broken"] is None
    raw = {r["kind"]: r["text"] for r in rec.decoded_texts(df, raw=True).collect()}
    assert raw["other"] == "plain words" and raw["best"] == rows[3][1]
    parsed = rec.parsed_lines(rec.decoded_texts(df))
    events = rec.envelopes(parsed).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in events} == {"gzip": 2, "zlib": 2, "plain": 2}
    assert [r["problem"] for r in rec.bad_lines(parsed).collect()] == ["not decoded"]


def test_payload_json_keeps_its_type(spark):
    payloads = ['"0"', "0", '{"b":1,"a":[true,null]}', '"x"', "null"]
    rows = [(i, f'{{"id":"a","event":"q","payload":{p}}}') for i, p in enumerate(payloads)]
    parsed = rec.parsed_lines(spark.createDataFrame(rows, "n long, text string"))
    got = {r["n"]: r["payload"] for r in rec.envelopes(parsed).select("n", "payload").collect()}
    assert [None if g is None else json.loads(g) for g in (got[i] for i in range(5))] == [json.loads(p) for p in payloads]
    valid = normalize.valid_bus_events(rec.envelopes(parsed)).select("n").collect()
    assert sorted(r["n"] for r in valid) == [0, 2, 3]


def test_kafka_and_delivered_records(spark):
    kafka = spark.sql("SELECT 'bus' AS topic, 3 AS partition, 42L AS offset, cast('eyJ9' as binary) AS value, timestamp_millis(1500) AS timestamp")
    assert tuple(rec.kafka_records(kafka).first()) == ("bus-3", "00000000000000000042", 1500, "eyJ9")
    text = '{"eventID":"shardId-000000000001:495","kinesis":{"data":"eyJ9","sequenceNumber":"495","approximateArrivalTimestamp":1706553709.138}}'
    rows = spark.createDataFrame([(text,)], "t string").select(rec.parse_delivered(F.col("t")).alias("r")).select("r.*")
    assert tuple(rec.delivered_records(rows).first()) == ("shardId-000000000001", "495", 1706553709138, "eyJ9")


def test_typed_values(spark):
    texts = ["12", "12.", "1.5", "-1", "1e3", "TRUE", "false", "null", "undefined", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(typed_value(F.col("t")).alias("v"))
    got = [(r["v"]["kind"], r["v"]["number"], r["v"]["flag"], r["v"]["text"]) for r in df.collect()]
    assert got == [
        ("number", 12.0, None, None), ("number", 12.0, None, None), ("number", 1.5, None, None), ("text", None, None, "-1"),
        ("text", None, None, "1e3"), ("boolean", None, True, None), ("boolean", None, False, None),
        ("null", None, None, None), ("absent", None, None, None), ("text", None, None, "x"), ("null", None, None, None),
    ]


def read_rows(spark, rng, count):
    rows = [(f"z/2024/01/01/00/{i // 40:02d}/{1704067200000 + i // 8 * 1000}-{i % 8:07d}", "x" * rng.randint(1, 30)) for i in range(count)]
    return sorted(rows), spark.createDataFrame(rows, "eid string, payload string")


@pytest.mark.parametrize("size", [0, 1, 17, 400, 999, 100_000])
def test_capped_read(spark, size):
    rows, df = read_rows(spark, random.Random(size), 300)
    want, total = [], 0
    for eid, payload in rows:
        total += len(payload)
        if total > size and want:  # the first event comes whatever its size
            break
        want.append(eid)
    assert sorted(r["eid"] for r in queues.capped(df, size).collect()) == want


def test_unread_counts(spark):
    rows, df = read_rows(spark, random.Random(1), 200)
    events = df.withColumn("queue", F.lit("q"))
    marks = [("a", "q", rows[0][0]), ("b", "q", rows[150][0]), ("c", "q", None), ("d", "q", "z/2030"), ("e", "none", None)]
    got = queues.unread(events, spark.createDataFrame(marks, "id string, queue string, checkpoint string"))
    assert {r["id"]: r["unread"] for r in got.collect()} == {"a": 199, "b": 49, "c": 200, "d": 0, "e": 0}


def test_file_pages(spark):
    keys = [f"firehose/{i:04d}" for i in range(250)] + ["other/1", "firehose"]
    df = spark.createDataFrame([(k, 1) for k in keys], "key string, bytes long")
    cursor, seen = "", []
    for _ in range(5):
        page = files.next_files(df, cursor)
        seen += [r["key"] for r in page.collect()]
        cursor = files.cursor_after(page, cursor).first()["cursor"]
    assert seen == sorted(k for k in keys if k.startswith("firehose/")) and cursor == "firehose/0249"
    assert files.load_command(files.next_files(df, cursor), "bus").count() == 0


def test_size_lines(spark):
    text = "START size: shardId-000000000001 250500 { 'a': 100499, b: 99999, c: 150500 }"
    lines = spark.createDataFrame([("2024-01-01", text), ("2024-01-01", "nothing")], "date string, line string")
    rows = logs.parse_size_lines(lines)
    assert {(r["queue"], r["queue_bytes"], r["bytes"]) for r in rows.collect()} == {
        ("a", 100499, 250500), ("b", 99999, 250500), ("c", 150500, 250500)
    }
    pivot = stats.size_pivot(stats.queue_sizes(rows), ["a", "b", "c"]).first()
    assert tuple(pivot) == ("2024-01-01", 100, None, 151)


ARNS = ["arn:aws:iam::700700:role/north-BusRole-K1", "arn:aws:iam::800800:role/south-BusRole-K2"]
MISMATCH = "routes and destinations name different accounts or stacks"


def route(spark, mapping, arns):
    mappings = spark.createDataFrame([(0, mapping)], "pos long, mapping string")
    addresses = spark.createDataFrame(list(enumerate(arns)), "pos long, address string")
    return routing.checked_routes(mappings, addresses, "BusRole")


def routes_of(*names, **settings):
    return [{name: settings} if settings else name for name in names]


@pytest.mark.parametrize("count, mapping, want", [
    (2, [{"paid": {"account": "800800", "stack": "south", "destination": "paid-copy"}}, {"sent": {"account": "700700", "stack": "north", "destination": "sent-copy"}}],
     {("paid", "800800", "south", "paid-copy", 1), ("sent", "700700", "north", "sent-copy", 0)}),
    (2, [{"paid": {"account": "800800", "stack": "south"}}, {"sent": {"account": "700700", "stack": "north"}}],
     {("paid", "800800", "south", "paid", 1), ("sent", "700700", "north", "sent", 0)}),
    (1, [*routes_of("paid", stack="north"), *routes_of("sent", account="700700")],
     {(q, "700700", "north", q, 0) for q in ("paid", "sent")}),
    (1, routes_of("paid", "sent"), {(q, "700700", "north", q, 0) for q in ("paid", "sent")}),
])
def test_routes(spark, count, mapping, want):
    rows = route(spark, json.dumps(mapping), ARNS[:count])
    got = {(r["source"], r["account"], r["stack"], r["destination"], ARNS.index(r["address"])) for r in rows.collect()}
    assert got == want
    ids = {r["id"] for r in routing.replication_bots(rows).collect()}
    assert ids == {f"replicate-{s}-to-{a}-{k}-{d}" for s, a, k, d, _ in want}


@pytest.mark.parametrize("arns, mapping, message", [
    (["arn:aws:box::700700:role/north-BusRole-K1", "arn:aws:iam::800800:role/south-OtherRole-K2"], '["paid"]', "no destination is the address of a role"),
    (ARNS, '[{"paid": {"account": ]', "the replication mapping cannot be read as JSON"),
    (ARNS, '{"paid": {"account": "800800"}}', "the replication mapping is not a list"),
    (ARNS, '[{"paid": {"account": "800800", "stack": "south"}}]', MISMATCH),
    (ARNS[:1], '["paid", {"sent": {"account": "800800", "stack": "south"}}]', MISMATCH),
])
def test_bad_routes(spark, arns, mapping, message):
    with pytest.raises(routing.RouteError, match=message):
        route(spark, mapping, arns)


def bot_record(old_invoke, new_invoke):
    """A changed bot whose second instance was invoked at another time than before."""
    def typed(value):
        if isinstance(value, dict):
            return {"M": {k: typed(v) for k, v in value.items()}}
        return {"N": str(value)} if isinstance(value, int) else {"BOOL": value} if isinstance(value, bool) else {"S": value}

    def image(invoke, done):
        place = {"checkpoint": "z/2024/03/04/05/06/1709528760000-0000007", "records": 3, "source_timestamp": 1709528750000,
                 "started_timestamp": 1709528761000, "ended_timestamp": 1709528762000}
        doc = {"id": "copier", "checkpoints": {"read": {"in": place}, "write": {"out": place}},
               "instances": {"first": {"completedTime": done, "status": "complete"},
                             "second": {"completedTime": done - 5, "invokeTime": int(invoke), "status": "complete"}}}
        return {k: typed(v) for k, v in doc.items()} | {"archived": {"BOOL": False}, "tags": {"NULL": True}}

    return json.dumps({"eventName": "MODIFY", "dynamodb": {
        "ApproximateCreationDateTime": 1709528800, "SequenceNumber": "41", "Keys": {"id": {"S": "copier"}},
        "NewImage": image(new_invoke, 1709528790000), "OldImage": image(old_invoke, 1709528700000)}})


def test_monitor_record_gives_one_start(spark):
    texts = spark.createDataFrame([(bot_record("1709528600000", "1709528795000"),)], "t string")
    rows = texts.select(F.from_json("t", CHANGE).alias("r")).select("r.*")
    facts = monitor.monitor_feed(feed.typed_changes(rows, BOT_IMAGE)).collect()
    assert [(f["id"], f["type"], f["start"], f["ts"]) for f in facts] == [("copier", "started", 1709528795000, None)]


def test_monitor_skips_deletes_and_muted(spark):
    record = json.loads(bot_record("1", "2"))
    del record["dynamodb"]["NewImage"]
    rows = spark.createDataFrame([(json.dumps(record),)], "t string").select(F.from_json("t", CHANGE).alias("r")).select("r.*")
    assert monitor.monitor_feed(feed.typed_changes(rows, BOT_IMAGE)).count() == 0
    muted = spark.createDataFrame([(bot_record("1", "2"),)], "t string").select(F.from_json("t", CHANGE).alias("r")).select("r.*")
    assert monitor.monitor_feed(feed.typed_changes(muted, BOT_IMAGE), "copier").count() == 0


def test_triggers_skip_deletes_and_unmoved(spark):
    image = "struct<event:string,max_eid:string,eid:string>"
    rows = spark.sql(f"""
        SELECT * FROM VALUES
          (1L, cast(named_struct('event','queue:a','max_eid','z/2','eid',null) AS {image}), cast(named_struct('event','a','max_eid','z/1','eid',null) AS {image})),
          (2L, cast(named_struct('event','a','max_eid','z/3','eid','z/1') AS {image}), cast(named_struct('event','a','max_eid','z/2','eid',null) AS {image})),
          (3L, cast(named_struct('event','b','max_eid','z/3','eid',null) AS {image}), cast(named_struct('event','b','max_eid',null,'eid','z/3') AS {image})),
          (4L, cast(null AS {image}), cast(named_struct('event','a','max_eid','z/9','eid',null) AS {image})),
          (5L, cast(named_struct('event','c','max_eid','z/5','eid',null) AS {image}), cast(null AS {image}))
        AS t(seq, new, old)""")
    bots = spark.createDataFrame(
        [("x", ["queue:a", "b"], False), ("y", ["a"], True), ("w", ["c", "queue:c"], None), ("v", None, False)],
        "id string, triggers array<string>, archived boolean",
    )
    got = {tuple(r) for r in triggers.trigger_rows(rows, bots).collect()}
    assert got == {("x", "a", "z/3"), ("w", "c", "z/5")}


def test_archive_candidates_order(spark):
    rows = [("a", "z/2024/01/01/9", "z/2024/01/01/1", None), ("b", "z/2024/01/01/9", None, False), ("c", "z/5", "z/5", None),
            ("d/_archive", "z/5", None, None), ("e", "z/5", None, True), ("f", None, None, None), ("g", "z/9", "z/2024/01/02", None)]
    df = spark.createDataFrame(rows, "queue string, max_eid string, archive_end string, skip_archive boolean")
    got = archive.archive_candidates(df, "z/2024/01/02").collect()
    assert [(r["queue"], r["archive_end"]) for r in got] == [("b", "z/0"), ("a", "z/2024/01/01/1")]


def test_checkpoint_request_defaults(spark):
    schema = ("id string, queue string, type string, seq long, eid string, event_eid string, units long, records long, force boolean, "
              "expected string, event_source_timestamp long, source_timestamp long, started_timestamp long, ended_timestamp long")
    rows = [("b", "q", None, 1, "z/1", None, None, None, None, None, None, None, None, None),
            ("b", "r", "write", 2, "z/1", "z/2", 0, 7, True, "z/0", 5, 6, 0, 8)]
    got = [r.asDict() for r in merges.checkpoint_requests(spark.createDataFrame(rows, schema), 99).orderBy("seq").collect()]
    assert (got[0]["type"], got[0]["units"], got[0]["force"], got[0]["source_timestamp"]) == ("read", 1, True, 99)
    # Saying anything about forcing turns it off.
    assert (got[1]["eid"], got[1]["units"], got[1]["force"], got[1]["source_timestamp"], got[1]["started_timestamp"]) == ("z/2", 7, False, 5, 99)


def test_last_requests_keep_one_per_key(spark):
    df = spark.createDataFrame([("b", "q", "read", 1, "z/1"), ("b", "q", "read", 2, None), ("c", "q", "read", 1, "z/1")],
                               "id string, queue string, type string, seq long, eid string")
    assert {(r["id"], r["seq"], r["eid"]) for r in merges.last_requests(df).collect()} == {("b", 2, None), ("c", 1, "z/1")}


def test_run_lines_round_halves_up(spark):
    rows = [("a", None, 1, 2, 3, 10, 0, 0, 0, False), ("a", None, 5, 1, 4, 11, 2, 1, 0, True)]
    runs = spark.createDataFrame(rows, "id string, key string, start long, end long, units long, duration long, consumption long, completions long, x long, is_error boolean")
    rollup = runlog.run_rollup(runs).withColumn("duration", F.col("duration") + 0.5).withColumn("options", F.lit('{"k":1}'))
    line = runlog.run_lines(rollup, marker="[M]").first()["line"]
    assert line == '[M]:v2:{"p":[2,5,2,7,22,10,11,2,1,"a",1],"e":{"k":1}}'
    plain = runlog.run_lines(runlog.run_rollup(runs).withColumn("options", F.lit(None).cast("string")), marker="[M]").first()["line"]
    assert plain == "[M]:v1:2:5:2:7:21:10:11:2:1:a"


def test_log_lines_are_written(spark):
    path = work_dir(spark, "log")
    lines = spark.createDataFrame([("a",), ("b",)], "line string")
    logs.write_lines(lines, path)
    logs.write_lines(lines.limit(0), path, runlog.error_line("[M]"))
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["[M]:ERROR", "a", "b"]


def test_system_rows(spark):
    runs = spark.createDataFrame([("bot", "q", 4, 10, 20, 50), ("bot", "a.q", 1, None, None, None)],
                                 "id string, event string, units long, source_ms long, exec_start long, exec_end long")
    got = [r["line"] for r in runlog.system_rows(runs, runlog.READ_ROW, 100, "[M]", "ns").collect()]
    assert got[0] == '[M]:v2:{"p":[1,10,50,4,30,30,30,0,0,"ns:getEvents:system.q"],"e":{"key":"bot"}}'
    assert got[1] == '[M]:v2:{"p":[1,100,100,1,0,0,0,0,0,"ns:getEvents:a.q"],"e":{"key":"bot"}}'


def test_payload_checks(spark):
    good = {"key": 1, "name": "n", "balance": 1.5, "segment": None, "place": {"nation": 2, "lat": 1}}
    cases = [
        (good, set()), ({**good, "key": 1.0}, set()), ({**good, "key": 1.5}, {("$['key']", "wrong type")}),
        ({**good, "name": None}, {("$['name']", "null not allowed")}), ({**good, "place": None}, {("$['place']", "null not allowed")}),
        ({k: v for k, v in good.items() if k != "place"}, {("$['place']", "missing")}),
        ({**good, "place": {"lat": "x"}}, {("$['place']['nation']", "missing"), ("$['place']['lat']", "wrong type")}),
    ]
    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(cases)] + [(100, "[1]"), (101, "{oops")]
    df = validate.with_violations(spark.createDataFrame(rows, "n long, payload string"), CUSTOMER_SCHEMA, CUSTOMER_DEFINITIONS)
    got = {}
    for r in validate.violations(df, "n").collect():
        got.setdefault(r["n"], set()).add((r["path"], r["problem"]))
    assert got == {**{i: w for i, (_, w) in enumerate(cases) if w}, 100: {("$", "wrong type")}, 101: {("$", "not json")}}
    assert {r["n"] for r in validate.good_events(df).collect()} == {0, 1}


def test_registry_is_checked(spark):
    df = spark.createDataFrame([("q", "1.0.0", "{}"), ("r", "1.0", "{}")], "queue string, version string, schema string")
    with pytest.raises(validate.SchemaError, match="queue r, version 1.0"):
        validate.require_valid(df)
    assert validate.require_valid(df.filter("queue = 'q'")).count() == 1


def test_names(spark):
    row = spark.range(1).select(
        names.canonical(F.lit("queue:a.b")).alias("a"), names.parent_of(F.lit("a/_archive")).alias("b"),
        names.system_name(F.lit("x")).alias("c"), names.system_name(F.lit("a.x")).alias("d"),
    ).first()
    assert tuple(row) == ("a.b", "a", "system.x", "a.x")


def test_query_session_zone_does_not_matter(spark, sf_dir):
    import __spark_entry__ as entry

    want = sorted(map(tuple, entry.queries()["ingest_max_eid"](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(map(tuple, entry.queries()["ingest_max_eid"](spark, sf_dir).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


def typed_by_rule(node):
    """A value of ``absent`` leaves its object; elsewhere it is None."""
    if isinstance(node, list):
        return [None if (v := typed_by_rule(x)) is ... else v for x in node]
    if isinstance(node, dict):
        return {k: v for k, x in node.items() if (v := typed_by_rule(x)) is not ...}
    if isinstance(node, str):
        if re.fullmatch(r"[0-9]+(?:\.[0-9]*)?", node):
            return float(node)
        if node.lower() in ("true", "false"):
            return node.lower() == "true"
        return {"null": None, "undefined": ...}.get(node, node)
    return node


def test_texts_of_any_depth_are_typed(spark):
    rnd = random.Random(5)
    texts = ["1", "007", "0", "00.50", "5.", "1e3", "-1", "true", "FALSE", "True ", "null", "undefined", "", "a,", "x\"1\",", ',"k":"undefined"',
             '","1","', "\\", '\\"', "{", "[\"1\"]", "null,", "line\nbreak \"2\"", "é中😀", ":", '":"', "1\n"]

    def node(depth):
        kind = rnd.randrange(5) if depth else 0
        if kind == 1:
            return [node(depth - 1) for _ in range(rnd.randrange(4))]
        if kind in (2, 3):
            return {rnd.choice([*texts, "k", "l", "m"]): node(depth - 1) for _ in range(rnd.randrange(5))}
        return rnd.choice([*texts, *texts, 3, 2.5, None, True])

    nodes = [node(5) for _ in range(600)] + [{"a": "undefined", "b": "undefined", "c": {"d": "undefined"}}, ["undefined"], "12", {"x": "\\n" * 20_000 + "1"}]
    rows = spark.createDataFrame([(i, json.dumps(n)) for i, n in enumerate(nodes)] + [(-1, "no json"), (-2, None)], "i int, t string")
    got = {r[0]: r[1] for r in rows.select("i", typed_json(F.col("t"))).collect()}
    assert got[-1] is None and got[-2] is None
    for i, n in enumerate(nodes):
        wanted = typed_by_rule(n)
        assert json.loads(got[i]) == (None if wanted is ... else wanted), n
