"""Event positions: ``z/yyyy/MM/dd/HH/mm/<ms>-<7 digits>``, compared bytewise.

Every producer and shard of a store has a lane. Positions of lane 0 have the form above, those
of others end in ``-<6 digits of the lane>``: the order is time, counter, lane, and two
producers never share a position. An event of a chunk that a row points to has the row's
position and ``.<9 digits>`` of its line.

A position also has a numeric key with the same order. Aggregating the key
keeps min/max in hash aggregates; min/max of strings would sort every row.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import div, two_digits, utc_day

# Position root and counter width.
ROOT = "z/"
START = "z/0"
COUNTER_DIGITS = 7
COUNTER_SIZE = 10**COUNTER_DIGITS

LANE_DIGITS = 6
LANES = 10**LANE_DIGITS
# What stands behind the position of a pointer for an event of its chunk.
_INSIDE_DIGITS = 9

_MS_SIZE = 10**13
_COUNT_SIZE = 10 ** (COUNTER_DIGITS + LANE_DIGITS)
_MINUTE_MS = 60_000


def padded(counter: Column) -> Column:
    """Seven digits; longer counters keep their last seven."""
    return F.right(F.concat(F.lit("0" * COUNTER_DIGITS), counter.cast("string")), F.lit(COUNTER_DIGITS))


def bucket(ms: Column) -> Column:
    """``z/yyyy/MM/dd/HH/mm/`` of an epoch-millisecond column."""
    minute = div(ms, _MINUTE_MS)
    return F.concat(
        F.lit(ROOT),
        F.replace(utc_day(ms), F.lit("-"), F.lit("/")),
        F.lit("/"),
        two_digits(div(minute, 60) % 24),
        F.lit("/"),
        two_digits(minute % 60),
        F.lit("/"),
    )


def batch_prefix(batch_ms: Column, bucket_ms: Column | None = None) -> Column:
    return F.concat(bucket(batch_ms if bucket_ms is None else bucket_ms), batch_ms.cast("string"))


def position(batch_ms: Column, counter: Column, bucket_ms: Column | None = None, lane: Column | None = None) -> Column:
    return behind(batch_prefix(batch_ms, bucket_ms), counter, lane)


def behind(prefix: Column, counter: Column, lane: Column | None = None) -> Column:
    """The position of a counter, and a lane, of a batch whose :func:`batch_prefix` is known."""
    own = F.concat(prefix, F.lit("-"), padded(counter))
    if lane is None:
        return own
    other = F.concat(F.lit("-"), F.lpad(lane.cast("string"), LANE_DIGITS, "0"))
    return F.concat(own, F.when(lane > 0, other).otherwise(F.lit("")))


def key(batch_ms: Column, counter: Column, bucket_ms: Column | None = None, lane: Column | None = None) -> Column:
    """Number with the order of :func:`position`: minute, ms, counter, lane."""
    minute = div(batch_ms if bucket_ms is None else bucket_ms, _MINUTE_MS)
    own = (
        minute.cast("decimal(10,0)") * F.lit(Decimal(_MS_SIZE * _COUNT_SIZE))
        + batch_ms.cast("decimal(13,0)") * F.lit(Decimal(_COUNT_SIZE))
        + (counter % COUNTER_SIZE).cast("decimal(7,0)") * F.lit(Decimal(LANES))
    )
    return (own if lane is None else own + lane.cast("decimal(6,0)")).cast("decimal(38,0)")


def from_key(k: Column) -> Column:
    """The position a key stands for."""
    minute = F.call_function("div", k, F.lit(Decimal(_MS_SIZE * _COUNT_SIZE)))
    rest = (k % F.lit(Decimal(_MS_SIZE * _COUNT_SIZE))).cast("decimal(26,0)")
    batch_ms = F.call_function("div", rest, F.lit(Decimal(_COUNT_SIZE)))
    last = (rest % F.lit(Decimal(_COUNT_SIZE))).cast("bigint")
    return position(batch_ms, div(last, LANES), minute * _MINUTE_MS, last % LANES)


def inside(eid: Column, line: Column) -> Column:
    """Position of a line of the chunk that a row points to."""
    return F.concat(eid, F.lit("."), F.lpad(line.cast("string"), _INSIDE_DIGITS, "0"))


def pointer_text(eid: str | None) -> str | None:
    """The row's position of a position inside a chunk; any other as it is."""
    return eid and re.sub(rf"\.\d{{{_INSIDE_DIGITS}}}$", "", eid)


def day_of(eid: Column) -> Column:
    """``yyyy-MM-dd`` partition of a position."""
    return F.replace(F.substring(eid, 3, 10), F.lit("/"), F.lit("-"))


def first_day(start: str | None) -> str | None:
    """Earliest day partition that can hold positions from ``start`` on."""
    found = re.match(r"^z/(\d{4}(?:/\d{2}(?:/\d{2})?)?)(?=/|$)", start or "")
    return found.group(1).replace("/", "-") if found else None
