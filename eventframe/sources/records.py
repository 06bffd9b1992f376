"""Encoded records in, decoded event rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encoding import decoded, is_packed
from ..functions.times import parse_ms
from ..operators.normalize import has_payload
from ..schemas import DELIVERED_RECORD, EVENT, RECORD

CORRUPT = "_corrupt"


def stream_records(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Record files as a stream, oldest first."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", max_files).json(path)


def delivered_records(rows: DataFrame) -> DataFrame:
    """Records of the stream service's shape (``eventID`` is ``shard:sequence``)."""
    return rows.select(
        F.split_part("eventID", F.lit(":"), F.lit(1)).alias("shard"),
        F.col("kinesis.sequenceNumber").alias("sequence"),
        F.round(F.col("kinesis.approximateArrivalTimestamp") * 1000).cast("bigint").alias("arrival_ms"),
        F.col("kinesis.data").alias("data"),
    )


def parse_delivered(texts: Column) -> Column:
    return F.from_json(texts, DELIVERED_RECORD)


def kafka_records(rows: DataFrame) -> DataFrame:
    """Records of Spark's Kafka source, batch or stream."""
    return rows.select(
        F.concat_ws("-", "topic", "partition").alias("shard"),
        F.lpad(F.col("offset").cast("string"), 20, "0").alias("sequence"),
        F.unix_millis("timestamp").alias("arrival_ms"),
        F.col("value").cast("string").alias("data"),
    )


def kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int = 10_000_000) -> DataFrame:
    """A Kafka topic from its oldest record; needs Spark's Kafka connector."""
    rows = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    return kafka_records(rows)


def decoded_texts(records: DataFrame, raw: bool = False) -> DataFrame:
    """Add ``text``. Unknown encodings are dropped, or kept as they are when ``raw``.

    A packed record that cannot be inflated stays, with a null text.
    """
    rows = records.withColumn("text", decoded(F.col("data"), raw))
    return rows.filter(F.col("text").isNotNull() | is_packed(F.col("data"))).drop("data")


def parsed_lines(texts: DataFrame) -> DataFrame:
    """One row per non-blank line of a text: its number, ``json``, and the parsed ``_e``.

    Lines are parsed inside the array that is exploded, so later filters on the
    result see a column and not the parser again. Bad text goes to ``_corrupt``;
    a text that could not be decoded gives one row without ``json``.
    """
    schema = T.StructType([*EVENT.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    columns = [c for c in texts.columns if c != "text"]
    lines = F.transform(
        F.split("text", "\n"), lambda line: F.struct(line.alias("json"), F.from_json(line, schema, options).alias("_e"))
    )
    rows = texts.select(*columns, F.posexplode_outer(lines).alias("line", "_l"))
    rows = rows.select(*columns, "line", "_l.json", "_l._e")
    return rows.filter(F.col("json").isNull() | (F.trim("json") != ""))


def good_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("_e").isNotNull() & F.col(f"_e.{CORRUPT}").isNull())


def bad_lines(parsed: DataFrame) -> DataFrame:
    """Lines that are not a JSON object, and texts that could not be decoded."""
    return parsed.filter(_is_bad()).withColumn("problem", _problem()).drop("_e")


def _is_bad() -> Column:
    return F.col("_e").isNull() | F.col(f"_e.{CORRUPT}").isNotNull()


def _problem() -> Column:
    return F.when(F.col("json").isNull(), "not decoded").otherwise("not json")


def flat_lines(parsed: DataFrame) -> DataFrame:
    """All lines: with the columns of :func:`envelopes`, and ``json`` and ``problem`` of the bad ones.

    Rows of plain columns can be kept and read several times: no reader takes events apart
    or writes payloads as text again.
    """
    carried = [c for c in parsed.columns if c not in ("_e", "json")]
    kept = F.when(_is_bad(), F.col("json")).alias("json")
    return parsed.select(*carried, kept, F.when(_is_bad(), _problem()).alias("problem"), *_envelope_columns())


def good_and_bad(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What :func:`envelopes` and :func:`bad_lines` give, from flat lines."""
    carried = flat.columns[: flat.columns.index("json")]
    bad = flat.filter(F.col("problem").isNotNull()).select(*carried, "json", "problem")
    return flat.filter(F.col("problem").isNull()).drop("json", "problem"), bad


def envelopes(parsed: DataFrame) -> DataFrame:
    """Event rows: producer, queue as written, payload text, times, markers."""
    carried = [c for c in parsed.columns if c not in ("_e", "json")]
    return good_lines(parsed).select(*carried, *_envelope_columns())


def _envelope_columns() -> list[Column]:
    e = F.col("_e")
    return [
        e["id"].alias("id"),
        e["event"].alias("event"),
        F.to_json(e["payload"]).alias("payload"),
        F.when(e["s3"]["key"].isNotNull(), e["s3"]).alias("s3"),
        parse_ms(e["timestamp"]).alias("write_ms"),
        e["event_source_timestamp"].alias("source_ms"),
        e["_cmd"].alias("cmd"),
        e["start"].alias("start"),
        e["next"].alias("next"),
        e["end"].alias("end"),
        has_payload(e["archive"]).alias("archive"),
        has_payload(e["snapshot"]).alias("snapshot"),
        parse_ms(e["snapshot"]).alias("snapshot_ms"),
        e["creator"].alias("creator"),
        e["eid"].alias("eid"),
    ]


def event_json(df: DataFrame) -> Column:
    """Line of JSON that :func:`envelopes` reads back; payload goes in as it is."""
    fields = [
        ("id", "id", True), ("event", "event", True), ("payload", "payload", False),
        ("timestamp", "write_ms", False), ("event_source_timestamp", "source_ms", False),
        ("_cmd", "cmd", True), ("start", "start", True), ("next", "next", True), ("end", "end", True),
        ("archive", "archive", False), ("snapshot", "snapshot_ms", False), ("creator", "creator", True),
        ("eid", "eid", True),
    ]
    parts = []
    for name, column, quoted in fields:
        if column not in df.columns:
            continue
        value = F.col(column).cast("string")
        if quoted:
            # One field's object without its braces, written once: a generated method that grows too long is not compiled.
            text = F.btrim(F.to_json(F.struct(value.alias(name))), F.lit("{}"))
            parts.append(F.when(value.isNotNull(), text))
        else:
            parts.append(F.concat(F.lit(f'"{name}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
