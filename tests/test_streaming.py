"""Jobs over several runs: restarts, repeated batches, crashes between steps."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from eventframe.schemas import BOT_STATE, CLOCK_STATE, POSITION_STATE, QUEUE_STATE, RECORD
from eventframe.session import work_dir
from eventframe.sources import folders, queues
from eventframe.sources import records as rec
from eventframe.sources.queues import QueueStore
from eventframe.sources.state import JobState, StateTable
from eventframe.streaming import jobs
from eventframe.streaming.appending import queue_states, write_events
from eventframe.streaming.ingest import Ingest

NOW = 1_706_745_600_000


def record(shard, sequence, arrival, *events):
    data = base64.b64encode("\n".join(json.dumps(e, separators=(",", ":")) for e in events).encode()).decode()
    return (shard, f"{sequence:06d}", arrival, data)


def event(n, queue="a", **extra):
    return {"id": f"bot-{n % 2}", "event": queue, "payload": {"n": n}, **extra}


def records(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


@pytest.fixture
def store(spark):
    return QueueStore(spark, work_dir(spark, "test"))


def stored(store, queue=None):
    rows = store.events()
    rows = rows.filter(F.col("queue") == queue) if queue else rows
    return {r["eid"]: json.loads(r["payload"])["n"] for r in rows.collect()}


def test_positions_follow_queue_and_arrival(spark, store):
    batch = records(
        spark, record("s", 2, NOW + 5, event(3, "queue:b"), event(4)), record("s", 1, NOW, event(1), event(2, "b"))
    )
    Ingest(store, clock=lambda: NOW).run_batch(batch, 0)
    prefix = f"z/2024/02/01/00/00/{NOW}-"
    want = {f"{prefix}000000{i}": n for i, n in enumerate([1, 4, 2, 3])}
    assert stored(store) == want
    marks = {r["queue"]: r["max_eid"] for r in queue_states(store).collect()}
    assert marks == {"a": f"{prefix}0000001", "b": f"{prefix}0000003"}


def test_clock_moves_on_and_a_repeated_batch_changes_nothing(spark, store):
    ingest = Ingest(store, clock=lambda: NOW)
    first, second = records(spark, record("s", 1, NOW, event(1))), records(spark, record("s", 2, NOW - 50, event(2)))
    ingest.run_batch(first, 0)
    ingest.run_batch(second, 1)
    before = stored(store)
    assert before == {f"z/2024/02/01/00/00/{NOW}-0000000": 1, f"z/2024/02/01/00/00/{NOW + 1}-0000000": 2}
    ingest.run_batch(second, 1)
    assert stored(store) == before


@pytest.mark.parametrize("step", ["stage clock", "stage queues", "stage bots", "commit", "publish"])
def test_a_crash_before_the_end_of_a_batch_leaves_no_trace_in_the_end(spark, store, step, monkeypatch):
    ingest = Ingest(store, clock=lambda: NOW)
    ingest.run_batch(records(spark, record("s", 1, NOW, event(1))), 0)
    batch = records(spark, record("s", 2, NOW, event(2), event(3, "b")))
    with monkeypatch.context() as patch:
        crash_at(patch, step)
        with pytest.raises(RuntimeError, match="lost"):
            ingest.run_batch(batch, 1)
    # What was committed is seen whole, what was not isn't seen at all.
    assert sorted(stored(store).values()) == ([1, 2, 3] if step == "publish" else [1])
    ingest.run_batch(batch, 1)
    assert sorted(stored(store).values()) == [1, 2, 3]
    assert len(stored(store)) == 3
    clock = store.state("ingest/clock", CLOCK_STATE).load().first()
    assert clock["clock"] == NOW + 1 and clock["sequence"] == "000002"
    bots = store.state("ingest/bots", BOT_STATE).load()
    assert {(r["id"], r["queue"], r["records"]) for r in bots.collect()} == {("bot-1", "a", 1), ("bot-0", "a", 1), ("bot-1", "b", 1)}


def crash_at(patch, step):
    """The first time a writer comes to a step, it dies."""
    kind, _, table = step.partition(" ")
    plain = getattr(QueueStore if kind == "publish" else JobState, kind)

    def dies(self, *args, **named):
        if not table or args[0] == table:
            raise RuntimeError("lost")
        return plain(self, *args, **named)

    patch.setattr(QueueStore if kind == "publish" else JobState, kind, dies)


def test_commands_archives_snapshots_and_bad_lines(spark, store):
    batch = records(
        spark,
        record("s", 1, NOW, {"_cmd": "registerSnapshot", "event": "queue:a", "start": "2024-01-05T10:30:59Z", "next": NOW}),
        record("s", 2, NOW, event(1, snapshot="2024-01-05T10:30:00Z"), event(2, archive=True, start="z/2024/01/01/x", end="z/2024/01/02/y")),
        record("s", 3, NOW, event(3, "skipped"), {"id": "mute", "event": "a", "payload": {"n": 4}}, {"event": "a", "payload": 1}),
        ("s", "000004", NOW, base64.b64encode(b'{"id":').decode()),
    )
    Ingest(store, skip_queues=["queue:skipped"], skip_bots=["mute"], clock=lambda: NOW).run_batch(batch, 0)
    got = {(r["queue"], r["archive_start"], r["eid"], r["date"], r["ttl"]) for r in store.events().collect()}
    # The archive queue is numbered first, so the snapshot event has counter one.
    assert got == {
        ("a/_archive", "z/2024/01/01/x", "z/2024/01/02/y", "2024-01-02", None),
        ("a/_snapshot", None, f"z/2024/01/05/10/30/{NOW}-0000001", "2024-01-05", NOW // 1000 + 604_800),
    }
    marks = {r["queue"]: (r["archive_end"], r["snapshot_start"], r["snapshot_next"]) for r in queue_states(store).collect()}
    assert marks["a"] == ("z/2024/01/02/y", "_snapshot/z/2024/01/05/10/30/", "z/2024/02/01/00/00/")
    bad = spark.read.parquet(f"{store.root}/quarantine/ingest/batch=0")
    assert [r["problem"] for r in bad.collect()] == ["not json"]


def test_stream_restarts_where_it_stopped_and_drops_redelivered_records(spark, store):
    arrivals = f"{store.root}/arrivals"
    ingest = Ingest(store, clock=lambda: NOW)

    def run():
        assert jobs.drain(ingest.start(rec.stream_records(spark, arrivals)), 300)

    records(spark, *[record("s", i, NOW + i, event(i)) for i in range(5)]).coalesce(1).write.mode("append").json(arrivals)
    run()
    records(spark, *[record("s", i, NOW + i, event(i)) for i in range(3, 8)]).coalesce(1).write.mode("append").json(arrivals)
    run()
    run()
    held = stored(store, "a")
    assert [n for _, n in sorted(held.items())] == list(range(8))


def order_store(spark, store, count, now=NOW):
    rows = spark.range(count).select(F.to_json(F.struct(F.col("id").alias("n"))).alias("payload"), F.col("id").alias("k"))
    assert write_events(store, "writer", "queue:source", rows, ["k"], now) == count


def test_written_events_are_read_by_position(spark, store):
    order_store(spark, store, 10)
    first = queues.read(store.events(), "source", limit=2).collect()
    assert [json.loads(r["payload"])["n"] for r in first] == [0, 1]
    rest = queues.read(store.events(), "queue:source", start=first[-1]["eid"]).collect()
    assert [json.loads(r["payload"])["n"] for r in rest] == list(range(2, 10))
    order_store(spark, store, 3)
    assert store.events().select("eid").distinct().count() == 13


def test_copy_keeps_order_and_goes_on(spark, store):
    order_store(spark, store, 6)

    def change(rows):
        parsed = F.from_json("payload", "n bigint")
        return rows.withColumn("payload", F.to_json(F.struct((parsed["n"] * 10).alias("n"))))

    for _ in range(2):
        assert jobs.drain(jobs.copy_queue(store, "mapper", "source", "target", change, clock=lambda: NOW), 300)
    assert [n for _, n in sorted(stored(store, "target").items())] == [0, 10, 20, 30, 40, 50]
    order_store(spark, store, 2)
    assert jobs.drain(jobs.copy_queue(store, "mapper", "source", "target", change, clock=lambda: NOW), 300)
    assert [n for _, n in sorted(stored(store, "target").items())] == [0, 10, 20, 30, 40, 50, 0, 10]
    position = jobs.positions_of(store, "mapper").first()
    assert (position["queue"], position["type"], position["eid"]) == ("source", "read", f"z/2024/02/01/00/00/{NOW + 1}-0000001")


def test_backfill_reads_files_in_order(spark, store):
    folder = f"{store.root}/firehose"
    lines = [json.dumps(event(n, queue="queue:a", timestamp=n + 1)) for n in range(4)]
    lines += [json.dumps({"id": "x", "payload": {"n": 9}}), "no event", json.dumps({"payload": 1})]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(folder)
    assert jobs.drain(jobs.backfill(store, jobs.stream_file_lines(spark, folder), "loader", clock=lambda: NOW), 300)
    rows = queues.read(store.events(), "a").collect()
    assert [(json.loads(r["payload"])["n"], r["write_ms"], r["creator"]) for r in rows] == [(n, n + 1, "firehose") for n in range(4)]
    bad = spark.read.parquet(f"{store.root}/quarantine/loader/batch=0").collect()
    assert sorted(r["problem"] for r in bad) == ["no queue", "not json"]
    read = store.state("loader/positions", POSITION_STATE).load().first()
    assert (read["queue"], read["units"]) == ("files", 1)


def test_load_commands_follow_the_cursor(spark, store):
    inbox = f"{store.root}/inbox"
    for day, numbers in (("01", (0, 1)), ("02", (2,))):
        lines = [(json.dumps(event(n, timestamp=n + 1)),) for n in numbers]
        spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{inbox}/firehose/2024/01/{day}")
        assert jobs.discover_files(store, inbox, clock=lambda: NOW) == 1
        assert jobs.discover_files(store, inbox, clock=lambda: NOW) == 0
        assert jobs.drain(jobs.run_load_commands(store, inbox, "loader", clock=lambda: NOW), 300)
    assert [n for _, n in sorted(stored(store, "a").items())] == [0, 1, 2]
    assert jobs.positions_of(store, "loader").first()["queue"] == "commands.s3_bus_load"


def test_archive_rolls_up_only_what_is_new(spark, store):
    order_store(spark, store, 5)
    assert jobs.roll_up(store, "z/2024/02/02").count() == 1
    assert jobs.roll_up(store, "z/2024/02/02").count() == 0
    order_store(spark, store, 2, NOW + 86_400_000)
    assert jobs.roll_up(store, "z/2024/02/03").count() == 1
    history = jobs.whole_history(store)
    assert {(r["part"], r["count"]) for r in history.groupBy("part").count().collect()} == {("archive", 7)}
    order_store(spark, store, 1, NOW + 2 * 86_400_000)
    parts = {(r["part"], r["count"]) for r in jobs.whole_history(store).groupBy("part").count().collect()}
    assert parts == {("archive", 7), ("live", 1)}


def test_expired_days_are_dropped_but_archives_stay(spark, store):
    order_store(spark, store, 3)
    jobs.roll_up(store, "z/2024/02/02")
    second = NOW // 1000
    assert jobs.drop_expired_days(store, second + 604_800 + 86_399) == []
    assert jobs.drop_expired_days(store, second + 604_800 + 86_400) == ["queue=source/date=2024-02-01"]
    assert {r["queue"] for r in store.events().collect()} == {"source/_archive"}


def test_state_table_shows_whole_versions_only(spark):
    table = StateTable(spark, work_dir(spark, "state"), QUEUE_STATE, keep=2)
    empty = table.load()
    assert table.version() is None and empty.count() == 0
    for version in range(4):
        rows = spark.createDataFrame([("q", f"z/{version}")], "queue string, max_eid string")
        full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in QUEUE_STATE])
        staged = table.job.stage("rows", QUEUE_STATE, full, version)
        assert (table.version() or 0) == max(version - 1, 0)
        table.job.commit(version, {"rows": staged}, table.job.head())
    assert table.load().first()["max_eid"] == "z/3" and table.load(2).first()["max_eid"] == "z/2"
    assert [n[:12] for n in folders.children(spark, f"{table.job.path}/rows")] == ["000000000002", "000000000003"]


def test_counters_past_seven_digits_use_the_next_millisecond(spark, store, monkeypatch):
    monkeypatch.setattr("eventframe.functions.positions.COUNTER_SIZE", 4)
    batch = records(spark, record("s", 1, NOW, *[event(n) for n in range(10)]))
    Ingest(store, clock=lambda: NOW).run_batch(batch, 0)
    assert [n for _, n in sorted(stored(store).items())] == list(range(10))
    assert store.state("ingest/clock", CLOCK_STATE).load().first()["clock"] == NOW + 2
