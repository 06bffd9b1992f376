"""Numbers of a batch come from ranges, and generated code stays short enough to be compiled."""

import json
import random

from pyspark.sql import functions as F

from eventframe.operators import running
from eventframe.plans import views
from eventframe.session import work_dir
from eventframe.sources import records as rec
from eventframe.sources.queues import QueueStore
from eventframe.streaming import appending, jobs
from eventframe.streaming.ingest import Ingest

NOW = 1_706_745_600_000


def test_places_give_every_row_its_number(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.choice("xyz"), rnd.choice([None, *range(400)]), n) for n in range(3000)]
    df = spark.createDataFrame(rows, "g string, q string, t long, n long").repartition(5)
    path = work_dir(spark, "places-test")
    placed = running.in_places(df, ["g", "q", "t", "n"], ["g", "n"], f"{path}/rows")
    assert placed.select(running.RANGE).distinct().count() > 1
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "g string, lane int")
    got = running.with_number(placed, ["g"], "number", facts, f"{path}/numbers")
    assert got.columns == ["g", "n", "lane", "number"]
    want = {}
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], -1 if r[2] is None else r[2], r[3]))
        want |= {r[3]: (g, i, "ab".index(g) + 1) for i, r in enumerate(mine, 1)}
    assert {r["n"]: (r["g"], r["number"], r["lane"]) for r in got.collect()} == want


def test_an_ingest_over_many_seconds_is_numbered_without_a_bucket_a_second(spark, tmp_path, monkeypatch):
    buckets = []
    monkeypatch.setattr(appending, "with_running_total", lambda *given: buckets.append(given))
    store = QueueStore(spark, str(tmp_path / "store"))
    line = F.to_json(F.struct(F.lit("bot").alias("id"), F.concat(F.lit("q"), F.col("id") % 2).alias("event"), F.struct(F.col("id").alias("n")).alias("payload")))
    given = spark.range(200).select(
        F.lit("s").alias("shard"), F.lpad(F.col("id").cast("string"), 12, "0").alias("sequence"),
        (NOW + F.col("id") * 1000).alias("arrival_ms"), F.regexp_replace(F.base64(F.encode(line, "utf-8")), r"\s", "").alias("data"),
    ).repartition(4)
    Ingest(store, clock=lambda: NOW).run_batch(given, 0)
    rows = store.events().orderBy("counter").collect()
    assert [json.loads(r["payload"])["n"] for r in rows] == [*range(0, 200, 2), *range(1, 200, 2)]
    assert [r["counter"] for r in rows] == list(range(200)) and not buckets


def numbers(spark, count):
    return spark.range(count).select(F.to_json(F.struct(F.col("id").alias("n"))).alias("payload"), F.col("id").alias("k"))


def in_order(store, queue):
    return [json.loads(r["payload"])["n"] for r in store.queue(queue).orderBy("eid").select("payload").collect()]


def test_a_large_batch_is_written_range_by_range(spark, tmp_path, monkeypatch):
    store = QueueStore(spark, str(tmp_path / "store"))
    assert appending.write_events(store, "bot", "small", numbers(spark, 900).repartition(8), ["k"], NOW) == 900
    assert [len(files) for files in store.files("small")] == [1]
    monkeypatch.setattr(running, "BUCKET_ROWS", 4000)
    assert appending.write_events(store, "bot", "large", numbers(spark, 20_000).repartition(8), ["k"], NOW) == 20_000
    assert jobs.drain(jobs.copy_queue(store, "copier", "large", "copy", clock=lambda: NOW + 5), 300)
    for queue in ("large", "copy"):
        files = sorted((f for found in store.files(queue) for f in found), key=lambda f: f.first)
        assert sum(f.records for f in files) == 20_000 and max(f.records for f in files) < 5000  # rows of one task
        assert all(a.last < b.first for a, b in zip(files, files[1:], strict=False))
        assert in_order(store, queue) == list(range(20_000))


def test_a_copy_reads_no_other_columns_of_its_files(spark, tmp_path, monkeypatch):
    store = QueueStore(spark, str(tmp_path / "store"))
    appending.write_events(store, "bot", "queue:a b/ü", numbers(spark, 300), ["k"], NOW)
    plans, copy = [], jobs.copy_rows

    def planned(store, rows, *rest):
        plans.append(rows.select("eid")._jdf.queryExecution().executedPlan().toString())
        return copy(store, rows, *rest)

    monkeypatch.setattr(jobs, "copy_rows", planned)
    for first in (0, 1000):
        if first:
            more = numbers(spark, 1300).filter(F.col("k") >= first)
            appending.write_events(store, "bot", "queue:a b/ü", more, ["k"], NOW + first)
        assert jobs.drain(jobs.copy_queue(store, "copier", "queue:a b/ü", "copy", clock=lambda: NOW + 5), 300)
    assert len(plans) == 2 and all("ReadSchema: struct<eid:string>" in p for p in plans)
    assert in_order(store, "copy") == [*range(300), *range(1000, 1300)]


def test_fields_of_a_line_come_back_whatever_they_hold(spark):
    texts = [None, "", "a", "{x}", "}", "[z]", ']"', 'a"b', "back\\slash", "\n\t\x01", "ü€", " "]
    rows = spark.createDataFrame([(t, u) for t in texts for u in texts], "id string, event string")
    rows = rows.withColumns({"payload": F.lit('{"k":"}"}'), "write_ms": F.when(F.col("id") == "a", F.lit(5))})
    read = rows.withColumn("e", F.from_json(rec.event_json(rows), "id string, event string, payload struct<k:string>, timestamp long"))
    same = F.col("e.id").eqNullSafe(F.col("id")) & F.col("e.event").eqNullSafe(F.col("event")) & (F.col("e.payload.k") == "}")
    assert read.filter(~same | ~F.col("e.timestamp").eqNullSafe(F.col("write_ms"))).isEmpty()


def test_the_code_that_makes_lines_is_short_enough_to_be_compiled(spark):
    lines = views.json_rows(spark, "/root/testdata/sf0.001").select("seq", "json")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    found = debug.codegenStringSeq(lines._jdf.queryExecution().executedPlan())
    sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
    assert sizes and max(sizes) <= 8000, sizes  # the JVM compiles no longer methods
