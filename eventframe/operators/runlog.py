"""Run statistics and the text lines that report them.

The marker that opens every line and the name space of system rows belong to
the log reader, so callers pass them; the defaults are neutral.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import system_name

MARKER = "[RUNLOG]"
NAMESPACE = "run"

# Names of system rows after the name space.
READ_ROW = "getEvents"
WRITE_ROW = "kinesisWriteEvents"


def run_rollup(runs: DataFrame) -> DataFrame:
    """Totals per identifier, or per ``identifier-key`` where a key is given."""
    # Numbers first, per (id, key), so the pass over all runs is a hash aggregate.
    parts = runs.groupBy("id", "key").agg(
        F.count("*").alias("runs"),
        F.sum(F.coalesce("completions", F.lit(0))).alias("completions"),
        F.max("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("units").alias("units"),
        F.sum("duration").alias("duration"),
        F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"),
        F.sum("consumption").alias("consumption"),
        F.count_if("is_error").alias("errors"),
    )
    return parts.groupBy(F.concat_ws("-", "id", "key").alias("identifier")).agg(
        *[F.sum(c).alias(c) for c in ("runs", "completions", "units", "duration", "consumption", "errors")],
        *[F.max(c).alias(c) for c in ("start", "end", "max_duration")],
        F.min("min_duration").alias("min_duration"),
        F.min(F.regexp_replace("id", "\n", "")).alias("id"),
    )


def _nearest(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("bigint")


def _packed(cells: list[Column]) -> Column:
    """JSON array of numbers and texts."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(c, F.lit("null")) for c in cells]), F.lit("]"))


def _quoted(text: Column) -> Column:
    """JSON string of a text column."""
    return F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def run_lines(rollup: DataFrame, options: str = "options", marker: str = MARKER) -> DataFrame:
    """One line per identifier: colon-separated without options, packed JSON with them.

    ``options`` is a column of JSON text; null or ``{}`` means none.
    """
    plain = F.concat_ws(
        ":",
        F.lit(marker), F.lit("v1"),
        *[F.col(c).cast("string") for c in (
            "runs", "start", "end", "units", "duration", "min_duration", "max_duration", "consumption", "errors", "id",
        )],
    )
    cells = [
        *[F.col(c).cast("string") for c in ("runs", "start", "end", "units")],
        *[_nearest(F.col(c)).cast("string") for c in ("duration", "min_duration", "max_duration")],
        *[F.col(c).cast("string") for c in ("consumption", "errors")],
        _quoted(F.col("id")),
        F.col("completions").cast("string"),
    ]
    full = F.concat(F.lit(f'{marker}:v2:{{"p":'), _packed(cells), F.lit(',"e":'), F.col(options), F.lit("}"))
    has_options = F.col(options).isNotNull() & (F.col(options) != "{}")
    return rollup.select("identifier", F.when(has_options, full).otherwise(plain).alias("line"))


def error_line(marker: str = MARKER) -> str:
    """The line that closes the log of a failed run."""
    return f"{marker}:ERROR"


def system_rows(
    runs: DataFrame,
    kind: str,
    now_ms: int,
    marker: str = MARKER,
    namespace: str = NAMESPACE,
    keep: tuple[str, ...] | list[str] = (),
) -> DataFrame:
    """Packed line per system read or write; times default to ``now_ms``.

    Columns: id, event, units, and nullable source_ms, exec_start, exec_end,
    duration, runs, consumption, errors. Zero counts as missing.
    """
    now = F.lit(now_ms).cast("bigint")

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit(0)), default) if name in runs.columns else default

    start, end = given("source_ms", now), given("exec_end", now)
    duration = given("duration", end - given("exec_start", now))
    name = F.concat(F.lit(f"{namespace}:{kind}:"), system_name(F.col("event")))
    cells = [
        given("runs", F.lit(1)), start, end, F.col("units"), duration, duration, duration,
        given("consumption", F.lit(0)), given("errors", F.lit(0)),
    ]
    packed = _packed([*[c.cast("string") for c in cells], _quoted(name)])
    line = F.concat(F.lit(f'{marker}:v2:{{"p":'), packed, F.lit(',"e":{"key":'), _quoted(F.col("id")), F.lit("}}"))
    return runs.select(*keep, "id", "event", line.alias("line"))
