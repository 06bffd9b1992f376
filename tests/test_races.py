"""Several writers, late and repeated records, large events: nothing is lost."""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from eventframe.operators import intervals, numbering
from eventframe.schemas import BOT_STATE, QUEUE_STATE
from eventframe.session import work_dir
from eventframe.sources import files, folders, queues
from eventframe.sources import records as rec
from eventframe.sources.queues import DataFile, QueueStore
from eventframe.sources.state import JobState, StaleVersion, StateTable
from eventframe.streaming import appending, jobs
from eventframe.streaming.appending import queue_states, write_events
from eventframe.streaming.ingest import Ingest
from eventframe.streaming.subscriber import Subscriber

from tests.test_streaming import NOW, crash_at, event, record, records


@pytest.fixture
def store(spark):
    return QueueStore(spark, work_dir(spark, "races"))


def numbers(spark, count, first=0):
    ids = spark.range(first, first + count)
    return ids.select(F.to_json(F.struct(F.col("id").alias("n"))).alias("payload"), F.col("id").alias("k"))


def held(store, queue="q"):
    return sorted(r[0] for r in store.queue(queue).select(F.get_json_object("payload", "$.n").cast("int")).collect())


def test_a_stale_commit_is_refused(spark):
    table = StateTable(spark, work_dir(spark, "state"), QUEUE_STATE)
    rows = spark.createDataFrame([("q",)], "queue string").selectExpr("queue", *[f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in QUEUE_STATE if f.name != "queue"])
    assert table.swap(rows, None) == 0
    with pytest.raises(StaleVersion):
        table.swap(rows, None)
    assert table.swap(rows, 0) == 1
    with pytest.raises(StaleVersion):
        table.commit(rows, 0)
    table.commit(rows, 1)  # the current one again changes nothing
    assert table.version() == 1


def test_a_checkpoint_between_comparison_and_commit_wins(store, monkeypatch):
    first, second = Subscriber(store, "bot"), Subscriber(store, "bot")
    assert first.checkpoint("q", eid="z/1")
    swap, raced = StateTable.swap, []

    def interrupted(self, snapshot, expected):
        if not raced:
            raced.append(True)
            assert second.checkpoint("q", eid="z/2", expected="z/1", force=False)
        return swap(self, snapshot, expected)

    monkeypatch.setattr(StateTable, "swap", interrupted)
    assert not first.checkpoint("q", eid="z/3", expected="z/1", force=False)
    assert first.position("q") == "z/2"
    raced.clear()
    assert not first.checkpoint("q", eid="z/4", expected="z/0", force=False)


def test_one_of_many_makes_a_version(spark):
    """However many writers create a commit at once, one does."""
    path = work_dir(spark, "commits")
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda n: folders.create(spark, f"{path}/v1", str(n)), range(16)))
    assert made.count(True) == 1 and folders.read_text(spark, f"{path}/v1") == str(made.index(True))
    assert folders.children(spark, path) == ["v1"]


def test_stores_without_exclusive_creation_are_refused(spark, monkeypatch):
    monkeypatch.setattr(folders, "NOT_EXCLUSIVE", {"file"})
    with pytest.raises(ValueError):
        folders.create(spark, work_dir(spark, "refused"), "")


def test_writers_of_one_name_take_turns(spark, store, monkeypatch):
    """Another writer commits the version first: the rows are numbered again, behind its own."""
    commit, seen = JobState.commit, []

    def late(self, version, *rest):
        if not seen:
            seen.append(version)
            assert write_events(store, "bot", "q", numbers(spark, 4, 100), ["k"], NOW) == 4
        return commit(self, version, *rest)

    monkeypatch.setattr(JobState, "commit", late)
    assert write_events(store, "bot", "q", numbers(spark, 6), ["k"], NOW) == 6
    assert held(store) == [0, 1, 2, 3, 4, 5, 100, 101, 102, 103]
    assert store.queue("q").select("eid").distinct().count() == 10
    assert folders.files(spark, f"{store.root}/staged") == []


def agreed(store):
    """Marks and write checkpoints against the stored events."""
    rows = store.events().groupBy("queue").agg(F.max("eid").alias("last")).collect()
    marks = {r["queue"]: r["max_eid"] for r in queue_states(store).collect()}
    assert marks == {r["queue"]: r["last"] for r in rows}
    written = store.state("write-bot/bots", BOT_STATE).load().collect()
    assert {r["queue"]: r["checkpoint"] for r in written} == marks


@pytest.mark.parametrize("step", ["stage clock", "stage queues", "stage bots", "commit", "publish"])
def test_a_writer_of_other_rows_after_a_crash(spark, store, step, monkeypatch):
    with monkeypatch.context() as patch:
        crash_at(patch, step)
        with pytest.raises(RuntimeError):
            write_events(store, "bot", "q", numbers(spark, 6), ["k"], NOW)
    assert write_events(store, "bot", "other", numbers(spark, 5, 100), ["k"], NOW) == 5
    assert held(store) == ([0, 1, 2, 3, 4, 5] if step == "publish" else []) and held(store, "other") == [100, 101, 102, 103, 104]
    agreed(store)


def test_a_publication_that_was_cut_off_is_finished_by_a_reader(spark, store, monkeypatch):
    move, moved = folders.move, []

    def cut(session, source, target):
        if "/events/" in target and moved:
            raise RuntimeError("lost")
        if "/events/" in target:
            moved.append(target)
        return move(session, source, target)

    ingest = Ingest(store, clock=lambda: NOW)
    with monkeypatch.context() as patch:
        patch.setattr(folders, "move", cut)
        with pytest.raises(RuntimeError):
            ingest.run_batch(records(spark, record("s", 1, NOW, event(1), event(2, "b"), event(3, "c"))), 0)
    assert len(moved) == 1
    assert held(store, "a") == [1] and held(store, "b") == [2] and held(store, "c") == [3]
    assert folders.children(spark, f"{store.root}/staged/ingest") == []


def test_producers_and_shards_of_one_millisecond_have_positions_of_their_own(spark, store):
    for n, bot in enumerate(("one", "two")):
        assert write_events(store, bot, "q", numbers(spark, 5, 10 * n), ["k"], NOW) == 5
    batch = [record(s, 1, NOW, *[event(20 + 10 * n + i, "q") for i in range(3)]) for n, s in enumerate(("a", "b"))]
    Ingest(store, clock=lambda: NOW).run_batch(records(spark, *batch), 0)
    everything = [*range(5), *range(10, 15), *range(20, 23), *range(30, 33)]
    assert held(store) == everything and store.queue("q").select("eid").distinct().count() == len(everything)
    reader, seen = Subscriber(store, "reader"), []
    while page := reader.read("q", limit=3).collect():
        seen.extend(json.loads(r["payload"])["n"] for r in page)
        assert reader.checkpoint("q", eid=page[-1]["eid"])
    assert sorted(seen) == everything
    # Order: time, counter, lane; lanes do not change when a producer writes again.
    assert write_events(store, "one", "q", numbers(spark, 1, 99), ["k"], NOW) == 1
    lanes = {r[0]: r[1] for r in store.queue("q").groupBy("id").agg(F.collect_set("lane")).collect()}
    assert lanes["one"] == [0] and lanes["two"] == [1]
    assert queue_states(store).first()["max_eid"] == store.queue("q").agg(F.max("eid")).first()[0]


def test_a_page_names_its_own_files_only(spark, store):
    for n in range(6):
        write_events(store, "bot", "q", numbers(spark, 10, 10 * n), ["k"], NOW + n * 43_200_000)
    page = store.page("q", limit=12)
    assert [json.loads(r["payload"])["n"] for r in page.collect()] == list(range(12))
    assert len(page.inputFiles()) == 2
    last = page.collect()[-1]["eid"]
    second = store.page("q", last, limit=5)
    assert [json.loads(r["payload"])["n"] for r in second.collect()] == list(range(12, 17)) and len(second.inputFiles()) <= 2
    one = len('{"n":30}')
    sized = store.page("q", store.page("q", limit=30).collect()[-1]["eid"], size=3 * one)
    assert [json.loads(r["payload"])["n"] for r in sized.collect()] == [30, 31, 32] and len(sized.inputFiles()) <= 2
    assert store.page("q", "z/2030/").collect() == [] and store.page("none").collect() == []


@pytest.mark.parametrize("eid", ["z/2024/01/02/y", "z/a_b~c+d.é %2F"])
def test_file_names_tell_any_position(eid):
    name = DataFile.name(eid, eid, 1, 2, 3, 4)
    assert DataFile.of(f"hdfs://x/{name}") == DataFile(f"hdfs://x/{name}", eid, eid, 1, 2, 3)


def test_a_large_write_is_numbered_in_many_tasks_and_in_order(spark, store):
    ranged = appending.in_ranges(numbers(spark, 100_000).repartition(8), ["k"])
    assert ranged.select(appending.RANGE).distinct().count() > 1
    assert write_events(store, "bot", "q", numbers(spark, 20_000).repartition(8), ["k"], NOW) == 20_000
    rows = store.queue("q").select("eid", F.get_json_object("payload", "$.n").cast("int").alias("n")).orderBy("eid").collect()
    assert [r["n"] for r in rows] == list(range(20_000))


def test_a_copied_batch_of_one_millisecond_keeps_its_order(spark, store):
    write_events(store, "bot", "q", numbers(spark, 3000), ["k"], NOW)
    assert jobs.drain(jobs.copy_queue(store, "copier", "q", "copy", clock=lambda: NOW + 5), 300)
    rows = store.queue("copy").select("eid", F.get_json_object("payload", "$.n").cast("int").alias("n")).orderBy("eid").collect()
    assert [r["n"] for r in rows] == list(range(3000))


@pytest.mark.parametrize("merged", [50, 1])
def test_a_lagging_shard_is_stored_and_a_repeated_record_is_not(spark, store, monkeypatch, merged):
    monkeypatch.setattr("eventframe.streaming.ingest.MERGED_BATCHES", merged)
    ingest, hour = Ingest(store, clock=lambda: NOW), 3_600_000
    batches = [
        [record("a", 1, NOW, event(0))],
        [record("b", 1, NOW - 3 * hour, event(1)), record("a", 1, NOW, event(0))],
        [record("b", 2, NOW - 2 * hour, event(2)), record("b", 2, NOW - 2 * hour, event(2)), record("b", 1, NOW - 3 * hour, event(1))],
        [record("a", 2, NOW + 1, event(3)), record("b", 2, NOW - 2 * hour, event(2))],
    ]
    for version, batch in enumerate(batches):
        ingest.run_batch(records(spark, *batch), version)
        ingest.run_batch(records(spark, *batch), version)
    assert held(store, "a") == [0, 1, 2, 3]
    kept = len([n for n in folders.children(spark, f"{store.root}/deliveries/ingest") if n.startswith("batch=")])
    assert kept == (4 if merged == 50 else 2)


def test_an_event_larger_than_a_page_is_read(spark, store):
    rows = spark.range(3).select(F.repeat(F.lit("x"), 4000).alias("payload"), F.col("id").alias("k"))
    write_events(store, "bot", "q", rows, ["k"], NOW)
    reader, seen = Subscriber(store, "reader"), 0
    while page := reader.read("q", size=1000).collect():
        seen += len(page)
        assert len(page) == 1 and reader.checkpoint("q", eid=page[-1]["eid"])
    assert seen == 3


def test_clock_of_provider_sequence_numbers(spark):
    rnd = random.Random(3)
    sequences = sorted({rnd.randrange(10 ** rnd.choice([3, 20, 55, 56])) for _ in range(300)})
    values = [rnd.randrange(200) for _ in sequences]
    rows = spark.createDataFrame([("s", str(q), v) for q, v in zip(sequences, values)], "shard string, sequence string, value long")
    got = {r["sequence"]: r["clock"] for r in numbering.batch_clock(rows).collect()}
    last, wanted = None, {}
    for q, v in zip(sequences, values):
        last = v if last is None or v > last else last + 1
        wanted[str(q)] = last
    assert got == wanted


@pytest.mark.parametrize("bound", [10_000, 1])
def test_a_missing_file_is_an_error_and_buckets_count(spark, monkeypatch, bound):
    monkeypatch.setattr(files, "MAX_PATHS", bound)
    here, there = work_dir(spark, "here"), work_dir(spark, "there")
    for folder in (here, there):
        spark.createDataFrame([(folder,)], "t string").coalesce(1).write.text(f"{folder}/in")
    named = files.listing(spark, here).filter("key like '%.txt'").select("key")
    away = files.listing(spark, there).filter("key like '%.txt'").select("key", F.lit(there).alias("bucket"))
    wanted = named.withColumn("bucket", F.lit("plain-name")).unionByName(away)
    assert sorted(r["text"] for r in files.lines_of(spark, wanted, here).collect()) == sorted([here, there])
    gone = wanted.unionByName(spark.createDataFrame([("in/gone.txt", None)], "key string, bucket string"))
    with pytest.raises((FileNotFoundError, AnalysisException)):
        files.lines_of(spark, gone, here).collect()


@pytest.mark.parametrize("bound", [10_000, 4, 1])
def test_only_folders_of_named_files_are_read(spark, monkeypatch, bound):
    monkeypatch.setattr(files, "MAX_PATHS", bound)
    root, days = work_dir(spark, "inbox"), ["d1", "d1/h1", "d1-x", "d2", "d3/h1"]
    for day in days:
        for x in "ab":
            spark.createDataFrame([(f"{day} {x}",)], "t string").coalesce(1).write.mode("append").text(f"{root}/{day}")
    keys = files.listing(spark, root).filter("key like '%.txt'").filter("key like 'd1%' or key like 'd3%'").select("key")
    read = []
    holding = files._holding
    monkeypatch.setattr(files, "_holding", lambda wanted: read.extend(holding(wanted)) or read)
    lines = files.lines_of(spark, keys, root).collect()
    assert sorted(r["text"] for r in lines) == sorted(f"{d} {x}" for d in days if d != "d2" for x in "ab")
    # eight names in four folders, one of them inside another
    assert read == {10_000: [], 4: [f"{root}/{d}" for d in ("d1-x", "d1", "d3/h1")], 1: [root]}[bound]


def test_events_behind_the_archive_end_stay_in_the_history(spark, store):
    write_events(store, "bot", "q", numbers(spark, 3), ["k"], NOW)
    jobs.roll_up(store, "z/2024/03/01")
    write_events(store, "other", "q", numbers(spark, 3, 10), ["k"], NOW - 60_000)

    def history():
        rows = jobs.whole_history(store).select("part", F.get_json_object("payload", "$.n").cast("int").alias("n")).collect()
        return sorted((r["n"], r["part"]) for r in rows)

    assert history() == [(n, "archive") for n in range(3)] + [(n, "live") for n in (10, 11, 12)]
    jobs.roll_up(store, "z/2024/03/01")
    jobs.roll_up(store, "z/2024/03/01")
    assert history() == [(n, "archive") for n in (0, 1, 2, 10, 11, 12)]
    write_events(store, "bot", "q", numbers(spark, 1, 20), ["k"], NOW + 9)
    assert history()[-1] == (20, "live") and len(history()) == 7


def test_snapshot_marks_stay_in_pairs(spark, store):
    pairs = [("z/2024/01/20/", "z/2024/01/20/01/"), ("z/2024/01/10/", "z/2024/01/21/01/")]
    for n, (start, after) in enumerate(pairs):
        row = {"queue": "q", "snapshot_start": start, "snapshot_next": after, "skip_archive": n == 0, "timestamp": n}
        rows = spark.createDataFrame([tuple(row.get(f.name) for f in QUEUE_STATE)], QUEUE_STATE)
        store.state(f"job-{n}/queues", QUEUE_STATE).commit(rows, 0)
    found = queue_states(store).first()
    assert (found["snapshot_start"], found["snapshot_next"]) == pairs[0] and found["skip_archive"] is False


def by_number(rows):
    return [json.loads(r["payload"])["n"] for r in rows]


def through(store, bot="slow", **page):
    """A whole queue, page by page."""
    reader, seen = Subscriber(store, bot), []
    while page_rows := reader.read("q", **page).collect():
        seen += by_number(page_rows)
        assert reader.checkpoint("q", eid=page_rows[-1]["eid"])
    return seen


def test_readers_behind_the_retention_go_on_in_the_archive(spark, store):
    day = 86_400_000
    for n in range(4):
        write_events(store, "bot", "q", numbers(spark, 5, 10 * n), ["k"], NOW + n * day)
    jobs.roll_up(store, "z/2024/03/01")
    write_events(store, "bot", "q", numbers(spark, 5, 40), ["k"], NOW + 4 * day)
    reader = Subscriber(store, "half")
    assert reader.checkpoint("q", eid=reader.read("q", limit=7).collect()[-1]["eid"])
    assert len(jobs.drop_expired_days(store, NOW // 1000 + 604_800 + 2 * 86_400)) == 2
    # Something is written to a day that is gone, by a producer whose clock is late.
    write_events(store, "late", "q", numbers(spark, 2, 90), ["k"], NOW + 3_600_000)
    everything = [0, 1, 2, 3, 4, 90, 91, *range(10, 15), *range(20, 25), *range(30, 35), *range(40, 45)]
    assert through(store, limit=4) == everything
    assert through(store, "half", limit=4) == everything[everything.index(12):]
    jobs.roll_up(store, "z/2024/03/01")
    assert through(store, "again", size=20) == everything
    assert jobs.drain(jobs.copy_queue(store, "copier", "q", "copy", clock=lambda: NOW + 9 * day), 300)
    # Archived days first, then what the live queue holds.
    assert by_number(queues.read(store.queue("copy"), "copy").collect()) == [n for n in everything if n not in (90, 91, *range(20, 45))] + [
        90, 91, *range(20, 25), *range(30, 35), *range(40, 45)]
    assert jobs.drain(jobs.copy_queue(store, "copier", "q", "copy", clock=lambda: NOW + 9 * day), 300)
    assert store.queue("copy").count() == len(everything)


def test_pages_and_copies_read_the_chunks_that_rows_point_to(spark, store):
    chunk = f"{store.chunks}/c1"
    lines = [json.dumps(event(n, "q", timestamp=n + 1)) for n in range(100, 106)] + ["no event", json.dumps(event(106, "q"))]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(chunk)
    key = next(n for n in folders.children(spark, chunk) if n.endswith(".txt"))
    pointer = {"id": "bot", "event": "q", "s3": {"bucket": "chunks", "key": f"c1/{key}"}}
    batch = [record("s", 1, NOW, event(1, "q")), record("s", 2, NOW, pointer), record("s", 3, NOW, event(2, "q"))]
    Ingest(store, clock=lambda: NOW).run_batch(records(spark, *batch), 0)
    everything = [1, *range(100, 107), 2]
    for n in (1, 2, 3, 20):
        assert through(store, f"reader-{n}", limit=n) == everything
    assert through(store, "bytes", size=25) == everything
    inner = store.page("q", limit=3).collect()[1:]
    assert [r["eid"].rsplit("-", 1)[1] for r in inner] == ["0000001.000000000", "0000001.000000001"]
    assert [(r["write_ms"], r["size"], r["id"]) for r in inner] == [(101, 9, "bot-0"), (102, 9, "bot-1")]
    assert jobs.drain(jobs.copy_queue(store, "copier", "q", "copy", clock=lambda: NOW + 5), 300)
    assert by_number(queues.read(store.queue("copy"), "copy").collect()) == everything


@pytest.mark.parametrize("limit, size", [(700, None), (1400, 1 << 60), (None, 3000), (900, 5000), (None, 1), (5000, 1 << 60)])
def test_a_page_of_one_millisecond_is_cut_by_ranges(spark, store, monkeypatch, limit, size):
    monkeypatch.setattr(queues, "SMALL_PAGE", 0)
    write_events(store, "bot", "q", numbers(spark, 2000), ["k"], NOW)
    page = store.page("q", limit=limit, size=size)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Limit", "TakeOrdered", "Window"))  # each of them puts all rows into one task
    want, total = [], 0
    for n in range(2000):
        total += len(f'{{"n":{n}}}')
        if (limit is not None and n >= limit) or (size is not None and total > size and n):
            break
        want.append(n)
    assert [json.loads(r["payload"])["n"] for r in page.collect()] == want


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5])
def test_a_limit_between_rows_of_one_position(spark, limit):
    rows = spark.createDataFrame([("z/1", "a"), ("z/2", "b"), ("z/2", "c"), ("z/2", "d"), ("z/3", "e")], "eid string, payload string")
    found = sorted(r["eid"] for r in queues.first_rows(rows, limit=limit).collect())
    assert found == ["z/1", "z/2", "z/2", "z/2", "z/3"][:limit]


def test_events_of_chunks_are_copied_in_many_ranges(spark, store, monkeypatch):
    spark.range(2000).select(F.to_json(F.struct(F.lit("bot").alias("id"), F.lit("q").alias("event"), F.struct(F.col("id").alias("n")).alias("payload")))).coalesce(1).write.text(f"{store.chunks}/c1")
    key = next(n for n in folders.children(spark, f"{store.chunks}/c1") if n.endswith(".txt"))
    pointer = spark.sql(f"SELECT struct('chunks' AS bucket, 'c1/{key}' AS key) AS s3, CAST(NULL AS STRING) AS payload, 0 AS k")
    write_events(store, "bot", "q", pointer, ["k"], NOW)
    number, largest = appending.with_running_total, []

    def counted(df, group, bucket, *rest):
        largest.append(df.groupBy(*group, *bucket).count().agg(F.max("count")).first()[0])
        return number(df, group, bucket, *rest)

    monkeypatch.setattr(appending, "with_running_total", counted)
    assert jobs.drain(jobs.copy_queue(store, "copier", "q", "copy", clock=lambda: NOW + 5), 300)
    assert by_number(queues.read(store.queue("copy"), "copy").collect()) == list(range(2000))
    assert max(largest) < 1000  # rows that one task numbers


def test_spans_of_files_need_no_sort(spark, store):
    rows = [("z/2024/02/01/00/00/1706745600000-" + f"{n:07d}" + lane, 2) for n in range(0, 2500, 7) for lane in ("", "-000001", "-000001.000000003")]
    path = f"{store.root}/some"
    texts = rows + [("z", 1), ("z/2024/02/01/00/00/1706745600001-0000000", 3)]
    spark.createDataFrame(texts, "eid string, size long").withColumn("s3", F.when(F.col("size") == 3, F.struct(F.lit("b").alias("bucket"), F.lit("k").alias("key")))).repartition(3).write.parquet(path)
    read = spark.read.parquet(path)
    want = read.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("eid").alias("first"), F.max("eid").alias("last"), F.count("*").alias("records"), F.sum("size").alias("size"), F.count("s3.key").alias("pointers"))
    spans = queues._spans(read).select(*want.columns)
    assert sorted(spans.collect()) == sorted(want.collect()) and want.count() == 3
    # Every row goes through a hash aggregate; what is sorted are the counted beginnings and the outermost rows.
    assert "HashAggregate(keys=[file" in spans._jdf.queryExecution().sparkPlan().toString()


def test_flat_lines_are_the_envelopes_and_the_bad_lines(spark):
    texts = ['{"id":"b","event":"q","payload":{"n":1},"timestamp":5}\nno event\n\n{"id":"b","event":"q","payload":null}', None, "[1]", '{"id":"b"']
    parsed = rec.parsed_lines(spark.createDataFrame(list(enumerate(texts)), "n long, text string"))
    good, bad = rec.good_and_bad(rec.flat_lines(parsed))
    for got, want in ((good, rec.envelopes(parsed)), (bad, rec.bad_lines(parsed))):
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count()


def test_input_files_of_a_backfill_grow_with_the_rows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(100)
    copies = events.crossJoin(spark.range(0, 4).withColumnRenamed("id", "_c")).withColumn("event_id", F.col("event_id") % 10_000 + F.col("_c") * 40_000).drop("_c")
    copies.write.parquet(str(tmp_path / "events.parquet"))
    store, made = [], jobs.stream_file_lines

    def seen(spark, folder, *rest):
        store.append(len(folders.files(spark, folder)))
        return made(spark, folder, *rest)

    from eventframe.plans import jobs as plans
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(plans.jobs, "stream_file_lines", seen)
        plans.file_backfill(spark, str(tmp_path))
    assert store == [4]  # one a part, not one a part and task


def sequences(spark, rows):
    return spark.createDataFrame([(s, str(q), NOW + i) for i, (s, q) in enumerate(rows)], "shard string, sequence string, arrival_ms long")


def test_intervals_hold_what_was_delivered_and_close_their_gaps(spark):
    rnd = random.Random(11)
    big = 49_590_338_271_490_256_608_559_692_538_361_571_095_921_575_989_136_588_898
    dense = [("a", n) for n in range(999_900, 1_000_100)] + [("b", big + n) for n in range(300)]
    sparse = [("c", rnd.randrange(10**30)) for _ in range(50)] + [("d", f"shard-{n}") for n in range(5)] + [("e", 0), ("e", "007")]
    rnd.shuffle(dense)
    everything = dense + sparse
    memory = intervals.of_records(sequences(spark, everything[::2]))
    fresh = {tuple(r) for r in intervals.unknown(sequences(spark, everything + [("z", 5)]), memory).collect()}
    delivered = {(s, str(q)) for s, q in everything[::2]}
    assert fresh == {(s, str(q)) for s, q in everything} - delivered | {("z", "5")}
    whole = intervals.intervals(memory.unionByName(intervals.of_records(sequences(spark, everything))))
    counts = {r["shard"]: r["count"] for r in whole.groupBy("shard").count().collect()}
    # One for each million that the numbers touch.
    assert counts["a"] == 2 and counts["b"] <= 2 and counts["c"] == 50 and counts["d"] == 5 and counts["e"] == 2
    assert intervals.unknown(sequences(spark, everything), whole).count() == 0


def test_the_memory_of_many_batches_stays_small(spark):
    """A thousand batches of two shards, each with its own disorder; some numbers never come."""
    rnd = random.Random(12)
    rows = [(s, n) for s in ("a", "b") for n in range(20_000) if n % 4_000 != 7]
    rnd.shuffle(rows)
    memory = None
    for part in range(4):
        own = intervals.of_records(sequences(spark, rows[part::4]))
        memory = own if memory is None else intervals.intervals(memory.unionByName(own))
    assert memory.count() == 12


def test_an_archive_that_stops_at_its_time_goes_on_next_time(spark, store):
    for queue in "abcde":
        write_events(store, "bot", queue, numbers(spark, 3, ord(queue)), ["k"], NOW)
    done = [{r["queue"] for r in jobs.roll_up(store, "z/2024/03/01", seconds=0, queues=2).collect()} for _ in range(4)]
    assert [len(x) for x in done] == [2, 2, 1, 0] and done[0] == {"a/_archive", "b/_archive"}
    write_events(store, "late", "b", numbers(spark, 2, 500), ["k"], NOW - 60_000)
    assert {r["queue"] for r in jobs.roll_up(store, "z/2024/03/01", seconds=300).collect()} == {"b/_archive"}
    rows = jobs.whole_history(store).groupBy("part", "queue").count().collect()
    assert {(r["part"], r["queue"], r["count"]) for r in rows} == {("archive", q, 5 if q == "b" else 3) for q in "abcde"}
    # Two rows for the queue with two writers, however many batches there were.
    write_events(store, "late", "b", numbers(spark, 2, 600), ["k"], NOW - 50_000)
    jobs.roll_up(store, "z/2024/03/01")
    assert store.state("archive/batches", jobs.BATCH_STATE).load().count() == 6


def test_folders_before_the_cursor_are_not_listed(spark, monkeypatch):
    root = work_dir(spark, "listed")
    for day in ("01", "02", "03"):
        spark.createDataFrame([(day,)], "t string").coalesce(1).write.text(f"{root}/firehose/2024/{day}")
    every = sorted(r["key"] for r in files.listing(spark, root).collect())
    looked, entries = [], folders.entries
    monkeypatch.setattr(folders, "entries", lambda session, path: looked.append(path) or entries(session, path))
    cursor = next(k for k in every if "/02/" in k and k.endswith(".txt"))
    assert sorted(r["key"] for r in files.listing(spark, root, cursor).collect()) == [k for k in every if k > cursor]
    assert not any("/01" in p or "/03" in p for p in looked)
    assert files.listing(spark, root, "z").count() == 0
