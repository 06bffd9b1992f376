"""Reading a queue step by step: read a page, work on it, move the checkpoint."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import canonical_text
from ..operators import merges
from ..schemas import POSITION_STATE
from ..sources.queues import READ_BYTES, QueueStore
from ..sources.state import StaleVersion, StateTable
from .ingest import now_ms

REQUEST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("queue", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("eid", T.StringType()),
    T.StructField("event_eid", T.StringType()),
    T.StructField("units", T.LongType()),
    T.StructField("records", T.LongType()),
    T.StructField("force", T.BooleanType()),
    T.StructField("expected", T.StringType()),
    T.StructField("event_source_timestamp", T.LongType()),
    T.StructField("source_timestamp", T.LongType()),
    T.StructField("started_timestamp", T.LongType()),
    T.StructField("ended_timestamp", T.LongType()),
])


class Subscriber:
    """One bot's own place in the queues it reads."""

    def __init__(self, store: QueueStore, bot: str):
        self.store, self.bot = store, bot
        # Apart from the tables of a streaming job of the same name.
        self.table: StateTable = store.state(f"subscriber-{bot}/positions", POSITION_STATE)

    def position(self, queue: str, kind: str = "read") -> str | None:
        mine = (F.col("queue") == canonical_text(queue)) & (F.col("type") == kind)
        row = self.table.load().filter(mine).select("eid").first()
        return row["eid"] if row else None

    def read(
        self, queue: str, limit: int | None = None, size: int = READ_BYTES, start: str | None = None
    ) -> DataFrame:
        """The next events after the checkpoint, or after ``start``: at most ``limit`` of them and ``size`` bytes."""
        return self.store.page(queue, start or self.position(queue), limit, size)

    def checkpoint(self, queue: str, now: int | None = None, **request) -> bool:
        """Move the position; false when an expected position was not the stored one.

        ``request`` takes the columns of ``REQUEST``: ``eid``, ``units``,
        ``expected``, ``force`` and so on.
        """
        values = {"id": self.bot, "queue": canonical_text(queue), "seq": 0, **request}
        asked = self.store.spark.createDataFrame([tuple(values.get(f.name) for f in REQUEST)], REQUEST)
        requests = merges.checkpoint_requests(asked, now_ms() if now is None else now)
        while True:
            current = self.table.version()
            outcome = merges.compare_and_set(self.table.load(current), requests)
            accepted = outcome.filter(F.col("accepted").isNotNull()).select("accepted").first()["accepted"]
            if not accepted:
                return False
            try:
                self.table.swap(outcome.filter(F.col("eid").isNotNull()), current)
                return True
            except StaleVersion:
                # Another holder was faster: compare with what it has stored.
                time.sleep(0.1)
