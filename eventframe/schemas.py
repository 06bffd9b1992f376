"""Row types of records, events, state documents and the queue store."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("shard", T.StringType()),
    T.StructField("sequence", T.StringType()),
    T.StructField("arrival_ms", T.LongType()),
    T.StructField("data", T.StringType()),
])

# One record as the stream service hands it over.
DELIVERED_RECORD = T.StructType([
    T.StructField("eventID", T.StringType()),
    T.StructField("kinesis", T.StructType([
        T.StructField("data", T.StringType()),
        T.StructField("sequenceNumber", T.StringType()),
        T.StructField("approximateArrivalTimestamp", T.DoubleType()),
    ])),
])

POINTER = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("key", T.StringType())])

# Fields that may arrive as numbers, texts or flags are read as text; the
# payload keeps its JSON type.
EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("payload", T.VariantType()),
    T.StructField("s3", POINTER),
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_source_timestamp", T.StringType()),
    T.StructField("_cmd", T.StringType()),
    T.StructField("start", T.StringType()),
    T.StructField("next", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("archive", T.StringType()),
    T.StructField("snapshot", T.StringType()),
    T.StructField("creator", T.StringType()),
    T.StructField("eid", T.StringType()),
])

# Stored event; ``queue`` and ``date`` are partition columns and come last.
STORED = T.StructType([
    T.StructField("eid", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("s3", POINTER),
    T.StructField("write_ms", T.LongType()),
    T.StructField("source_ms", T.LongType()),
    T.StructField("batch_ms", T.LongType()),
    T.StructField("counter", T.LongType()),
    T.StructField("lane", T.IntegerType()),
    # Bytes of the payload, so that pages can be measured without reading it.
    T.StructField("size", T.LongType()),
    # Where the span of an archive row begins; its position is where the span ends.
    T.StructField("archive_start", T.StringType()),
    T.StructField("ttl", T.LongType()),
    T.StructField("creator", T.StringType()),
    T.StructField("v", T.IntegerType()),
    T.StructField("queue", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("batch", T.StringType()),
])

CHECKPOINT = T.StructType([
    T.StructField("checkpoint", T.StringType()),
    T.StructField("records", T.LongType()),
    T.StructField("source_timestamp", T.LongType()),
    T.StructField("started_timestamp", T.LongType()),
    T.StructField("ended_timestamp", T.LongType()),
])

INSTANCE = T.StructType([
    T.StructField("invokeTime", T.LongType()),
    T.StructField("startTime", T.LongType()),
    T.StructField("completedTime", T.LongType()),
    T.StructField("status", T.StringType()),
])

BOT_IMAGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("archived", T.BooleanType()),
    T.StructField("paused", T.BooleanType()),
    T.StructField("ignoreMonitor", T.BooleanType()),
    T.StructField("triggers", T.ArrayType(T.StringType())),
    T.StructField("trigger", T.LongType()),
    T.StructField("invokeTime", T.LongType()),
    T.StructField("requested_kinesis", T.MapType(T.StringType(), T.StringType())),
    T.StructField("checkpoints", T.StructType([
        T.StructField("read", T.MapType(T.StringType(), CHECKPOINT)),
        T.StructField("write", T.MapType(T.StringType(), CHECKPOINT)),
    ])),
    T.StructField("instances", T.MapType(T.StringType(), INSTANCE)),
])

QUEUE_IMAGE = T.StructType([
    T.StructField(n, T.StringType())
    for n in (
        "event", "kinesis_number", "s3_kinesis_number", "initial_kinesis_number", "s3_new_kinesis_number",
        "eid", "max_eid",
    )
])

# Images stay text until they are parsed with the schema of their table.
CHANGE = T.StructType([
    T.StructField("eventName", T.StringType()),
    T.StructField("dynamodb", T.StructType([
        T.StructField("ApproximateCreationDateTime", T.LongType()),
        T.StructField("SequenceNumber", T.StringType()),
        T.StructField("Keys", T.StringType()),
        T.StructField("NewImage", T.StringType()),
        T.StructField("OldImage", T.StringType()),
    ])),
])

LOAD_COMMAND = T.StructType([
    T.StructField("command", T.StringType()),
    T.StructField("files", T.ArrayType(POINTER)),
])

QUEUE_STATE = T.StructType([
    T.StructField("queue", T.StringType()),
    T.StructField("max_eid", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("v", T.IntegerType()),
    T.StructField("archive_end", T.StringType()),
    T.StructField("snapshot_start", T.StringType()),
    T.StructField("snapshot_next", T.StringType()),
    T.StructField("skip_archive", T.BooleanType()),
])

CLOCK_STATE = T.StructType([
    T.StructField("shard", T.StringType()),
    T.StructField("clock", T.LongType()),
    T.StructField("sequence", T.StringType()),
    # Clock the last batch began at; null for a shard that batch had nothing of.
    T.StructField("start", T.LongType()),
    T.StructField("lane", T.IntegerType()),
])

BOT_STATE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("queue", T.StringType()),
    T.StructField("checkpoint", T.StringType()),
    T.StructField("source_timestamp", T.LongType()),
    T.StructField("started_timestamp", T.LongType()),
    T.StructField("ended_timestamp", T.LongType()),
    T.StructField("records", T.LongType()),
])

REQUEST_STATE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("queue", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("requested_ms", T.LongType()),
])

POSITION_STATE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("queue", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("eid", T.StringType()),
    T.StructField("units", T.LongType()),
    T.StructField("source_timestamp", T.LongType()),
    T.StructField("started_timestamp", T.LongType()),
    T.StructField("ended_timestamp", T.LongType()),
])
