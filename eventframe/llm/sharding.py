"""Sharding by sampled splitters: shards of near-equal bytes over an ordered key.

Records are ordered by a point: the text's CRC, then a hash of the id, so equal
texts lie side by side. Size-weighted samples of the points give quantile
boundaries in two levels: as many groups as the square root of the ranges asked
for, and the ranges inside each group. Ranges that turn out overfull are sampled
again and subdivided. The bytes and rows of all ranges are then known, a window
inside each range gives every record its place, and shards are cut at equal bytes
of the running total.

Only DataFrame functions run on the executors. The driver sees the samples of the
groups, a few for each (7,000 for 195,000 ranges, which is 100 TB in half
gigabytes); boundaries and totals of ranges and shards are tables, joined by
group, range and shard, which Spark broadcasts only where they are small.
"""

from __future__ import annotations

from itertools import accumulate
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventframe.llm.texts import work_table

LAW = "bytes"
OVERHEAD = 16
ID_BITS = 30


def _records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each id, text CRC and size, with the number of its repeats."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.crc32(text.cast("binary")).alias("crc"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
    )
    point = F.shiftleft(F.coalesce(F.col("crc") + 1, F.lit(0).cast("long")), ID_BITS) + F.xxhash64("id").bitwiseAND((1 << ID_BITS) - 1)
    return rows.groupBy("id", "crc", "size").agg(F.count("*").alias("n")).withColumn("point", point)


def _group_of(bounds: list[int], point: Column) -> Column:
    """How many boundaries are at most ``point``."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= point))


def _drawn(records: DataFrame, chance: Column, seed: int) -> DataFrame:
    """Records drawn with a chance in proportion to their bytes, and the bytes each one stands for.

    The draw is a hash of the record, so a repeated task draws the same.
    """
    chance = F.least(F.lit(1.0), chance)
    u = F.xxhash64(F.lit(seed), "point", "id", "size").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    return records.where(u < chance).withColumn("weight", F.col("bytes") / chance)


def _quantiles(samples: list[tuple[int, float]], step: float) -> list[int]:
    """The points at which the running weight passes a multiple of ``step``."""
    bounds, seen = [], 0
    for (point, _), total in zip(samples, accumulate(w for _, w in samples)):
        if total // step > seen:
            seen = total // step
            if not bounds or bounds[-1] < point:
                bounds.append(point)
    return bounds


def _cuts(drawn: DataFrame, inside: list[str], step: float) -> DataFrame:
    """``group, bound``: the same points inside each ``inside``, which holds few samples."""
    seen = F.sum("weight").over(Window.partitionBy(*inside).orderBy("point", "id", "crc", "size").rowsBetween(Window.unboundedPreceding, 0))
    passes = F.floor(F.col("seen") / step) > F.floor((F.col("seen") - F.col("weight")) / step)
    return drawn.select("group", "point", "weight", seen.alias("seen")).where(passes).select("group", F.col("point").alias("bound"))


def _ranged(grouped: DataFrame, cuts: DataFrame) -> DataFrame:
    """Records with their range: the boundaries of their group that are at most their point."""
    bounds = cuts.groupBy("group").agg(F.array_sort(F.collect_set("bound")).alias("bounds"))
    inside = F.size(F.filter("bounds", lambda b: b <= F.col("point")))
    return grouped.join(bounds, "group", "left").withColumn("range", F.when(F.col("bounds").isNull(), 0).otherwise(inside)).drop("bounds")


def ranged(records: DataFrame, total: int, ranges: int, draws: int = 16, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """Records with ``group`` and ``range`` of about ``total / ranges`` bytes, and the table of all ranges.

    Ranges of over twice that size are sampled anew, each time twice as densely, until
    none is left, only ranges of a single point remain, or ``rounds`` are over; a range
    that is left over only costs its task more time.
    """
    step, groups = total / ranges, isqrt(ranges) + 1
    top = _drawn(records, F.col("bytes") * (groups * draws / total), -1).select("point", "weight").collect()
    grouped = records.withColumn("group", _group_of(_quantiles(sorted(map(tuple, top)), total / groups), F.col("point")))
    cuts = work_table(_cuts(_drawn(grouped, F.col("bytes") * (draws / step), 0), ["group"], step), "shard-cuts")
    for turn in range(rounds + 1):
        numbered = _ranged(grouped, cuts)
        found = work_table(numbered.groupBy("group", "range").agg(
            F.sum("bytes").alias("bytes"), F.sum("n").alias("rows"), F.min("point").alias("low"), F.max("point").alias("high")
        ), "shard-ranges")
        overfull = found.where((F.col("bytes") > 2 * step) & (F.col("low") < F.col("high"))).select("group", "range", "low")
        if turn == rounds or overfull.isEmpty():
            return numbered, found
        denser = draws * 2 ** (turn + 1)
        drawn = _drawn(numbered.join(overfull.drop("low"), ["group", "range"]), F.col("bytes") * (denser / step), turn + 1)
        lows = overfull.select("group", (F.col("low") + 1).alias("bound"))  # a single heavy first point stands alone
        cuts = work_table(cuts.union(_cuts(drawn, ["group", "range"], step)).union(lows).distinct(), "shard-cuts")


def _starts(found: DataFrame) -> DataFrame:
    """``group, range, first_byte, first_row``: what lies before each range."""
    before = lambda name, order: F.coalesce(F.sum(name).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_groups, in_group = Window.orderBy("group"), Window.partitionBy("group").orderBy("range")  # the first one over a row a group
    groups = found.groupBy("group").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    groups = groups.select("group", before("bytes", all_groups).alias("byte"), before("rows", all_groups).alias("row"))
    inside = found.select("group", "range", before("bytes", in_group).alias("bytes"), before("rows", in_group).alias("rows"))
    return inside.join(groups, "group").select(
        "group", "range", (F.col("byte") + F.col("bytes")).alias("first_byte"), (F.col("row") + F.col("rows")).alias("first_row")
    )


def shard_documents(
    docs: DataFrame, shards: int = 40, ranges_per_shard: int = 16, range_bytes: int = 512 << 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` of each row.

    Size is the text's UTF-8 bytes plus 16; a null text has none and a null CRC. Shards
    hold near-equal bytes (a record goes where it begins, so a shard is off by one record
    at most); slots count a shard's rows from 0 in the order of text CRC and id. Repeated
    rows get slots one after another, a null id is an id like others, other columns are
    not read, an empty table gives no rows. ``grown_shard`` belongs to another law and is null.
    """
    kind = docs.select(id_col).schema[0].dataType
    records = work_table(_records(docs, id_col, text_col), "shard-records")
    records = records.withColumn("bytes", F.col("size") * F.col("n"))
    total = records.agg(F.sum("bytes")).first()[0] or 0
    numbered, found = ranged(records, max(total, 1), max(shards * ranges_per_shard, -(-total // range_bytes)))

    order = Window.partitionBy("group", "range").orderBy("point", "id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name: F.coalesce(F.sum(name).over(order), F.lit(0))
    placed = numbered.select("group", "range", "id", "size", "crc", "n", before("bytes").alias("bytes_before"), before("n").alias("rows_before"))
    placed = placed.join(_starts(found), ["group", "range"]).select(
        "id", "size", "crc", "n", (F.col("bytes_before") + F.col("first_byte")).alias("offset"), (F.col("rows_before") + F.col("first_row")).alias("row")
    )
    # repeats are expanded only behind the window, each with its place among them
    placed = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    shard = F.expr(f"cast(least({shards - 1}, (cast(offset + copy * size as decimal(20, 0)) * {shards}) div {max(total, 1)}) as int)")
    ranked = work_table(placed.select("id", "size", "crc", shard.alias("shard"), (F.col("row") + F.col("copy")).alias("row")), "shard-rows")
    firsts = ranked.groupBy("shard").agg(F.min("row").alias("first_row"))
    return ranked.join(firsts, "shard").select(
        F.col("id").cast(kind).alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard",
        (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
