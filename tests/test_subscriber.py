"""Step-by-step readers: a checkpoint per page, and one at the end."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventframe.session import work_dir
from eventframe.sources.queues import QueueStore
from eventframe.streaming.appending import write_events
from eventframe.streaming.subscriber import Subscriber

NOW = 1_706_745_600_000


@pytest.fixture(scope="module")
def store(spark):
    store = QueueStore(spark, work_dir(spark, "subscriber"))
    rows = spark.range(10).select(F.to_json(F.struct(F.col("id").alias("data"))).alias("payload"), F.col("id").alias("k"))
    assert write_events(store, "writer", "queue:first", rows, ["k"], NOW) == 10
    return store


def data(rows):
    return [json.loads(r["payload"])["data"] for r in rows]


def test_checkpoint_after_every_page(store):
    reader, seen = Subscriber(store, "pages"), []
    while page := reader.read("first", limit=4).collect():
        seen.append(data(page))
        assert reader.checkpoint("first", now=NOW, eid=page[-1]["eid"], units=len(page))
    assert seen == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    # A new reader begins at the beginning.
    assert data(Subscriber(store, "other").read("first", limit=1).collect()) == [0]


def test_one_checkpoint_at_the_end(store):
    reader, last, units = Subscriber(store, "end"), None, 0
    while page := reader.read("queue:first", limit=5, start=last).collect():
        last, units = page[-1]["eid"], units + len(page)
    assert reader.position("first") is None
    assert reader.checkpoint("first", now=NOW, eid=last, units=units)
    assert reader.position("first") == last and reader.read("first").count() == 0
    assert reader.table.load().first()["units"] == 10


def test_expected_position_and_size(store):
    reader = Subscriber(store, "careful")
    one = len('{"data":0}')
    assert data(reader.read("first", size=3 * one).collect()) == [0, 1, 2]
    first, second = (r["eid"] for r in reader.read("first", limit=2).collect())
    assert reader.checkpoint("first", eid=first)
    assert not reader.checkpoint("first", eid=second, force=False, expected="z/other")
    assert reader.position("first") == first
    assert reader.checkpoint("first", eid=second, force=False, expected=first)
    assert reader.position("first") == second
