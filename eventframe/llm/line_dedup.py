"""Cross-site boilerplate lines by the number of distinct sites that carry them.

Every line's hash gets HyperLogLog sketches of its sites and of the distinct texts that hold
it; sketches are built where the lines are read and merge by aggregation. A line is
boilerplate if as many sites as the threshold and as many different texts carry it: the lines
of one text that many sites have copied are no boilerplate. Lines whose estimates lie well
above the threshold, or one of them well below, are decided by them, others get exact
distinct counts. All boilerplate lines are then removed from the texts.

Only DataFrame functions are used.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventframe.llm.texts import unused, work_table

MIN_SITES = 10
MIN_CHARS = 12
PRECISION = 12
# The broadcast side of a join is at most this many 8-byte hashes or this many characters.
BROADCAST_ROWS = 200_000


def _trimmed(line: Column) -> Column:
    return F.trim(line)


def _hash(line: Column) -> Column:
    return F.xxhash64(_trimmed(line))


def _hashes(text: Column, min_chars: int) -> Column:
    """Hashes of the text's lines that are long enough to be boilerplate, each once."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(_trimmed(x)) >= min_chars)
    return F.array_distinct(F.transform(lines, _hash))


def _hint(df: DataFrame) -> DataFrame:
    """Broadcast a table of hashes if it is counted to be small; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, precision: int = PRECISION,
    site_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``line_hash`` of the lines that stand on at least ``min_sites`` distinct sites and in as many different texts."""
    text = F.col(text_col).cast("string")
    seen = docs.select(
        F.col(site_col).cast("string").alias("site"), F.xxhash64(text).alias("page"), F.explode(_hashes(text, min_chars)).alias("line_hash")
    ).where(F.col("site").isNotNull())
    # The band is six standard errors of the sketch, and one site at least.
    error = 6 * 1.04 / 2 ** (precision / 2)
    low, high = floor(min_sites * (1 - error)) - 1, ceil(min_sites * (1 + error)) + 1
    spread = seen.groupBy("line_hash").agg(
        F.hll_sketch_agg("site", precision).alias("_sites"), F.hll_sketch_agg("page", precision).alias("_pages")
    )
    spread = spread.select("line_hash", F.least(F.hll_sketch_estimate("_sites"), F.hll_sketch_estimate("_pages")).alias("least"))
    spread = work_table(spread.where(F.col("least") >= low), "line-spread")
    near = spread.where(F.col("least") <= high).select("line_hash")
    exact = seen.join(_hint(near), "line_hash", "left_semi").groupBy("line_hash").agg(
        F.count_distinct("site").alias("sites"), F.count_distinct("page").alias("pages")
    )
    sure = spread.where(F.col("least") > high).select("line_hash")
    return sure.unionByName(exact.where((F.col("sites") >= min_sites) & (F.col("pages") >= min_sites)).select("line_hash"))


def without_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, precision: int = PRECISION,
    site_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text; ``n_lines`` and ``n_removed`` are added.

    A line is boilerplate if, without the spaces around it, it has ``min_chars`` characters
    and stands on ``min_sites`` distinct sites and in as many different texts. What is left of
    a text may be empty.

    Null texts stay null (no lines), null sites count for no line, repeated rows are kept
    and treated alike, a column that has the name of an added one is replaced, an empty
    table gives no rows.
    """
    spread = work_table(boilerplate(docs, min_sites, min_chars, precision, site_col, text_col), "boilerplate")
    text = F.col(text_col).cast("string")
    key, drop = unused("text_hash", docs.columns), unused("drop", docs.columns)
    affected = docs.select(F.xxhash64(text).alias(key), F.explode(_hashes(text, min_chars)).alias("line_hash"))
    affected = affected.join(_hint(spread), "line_hash", "left_semi")
    # equal texts have equal lines, so the list is kept once for each text
    lists = work_table(affected.groupBy(key).agg(F.collect_set("line_hash").alias(drop)), "boilerplate-lists")
    # joined by sorting at every size: the lists grow with the documents, and skewed texts are split
    joined = docs.withColumn(key, F.xxhash64(text)).join(lists.hint("merge"), key, "left")

    lines = F.split(text, "\n", -1)
    stays = F.filter(lines, lambda x: ~((F.length(_trimmed(x)) >= min_chars) & F.array_contains(F.col(drop), _hash(x))))
    changed = F.col(drop).isNotNull()
    out = joined.withColumns({
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)),
        "n_removed": F.when(changed, F.size(lines) - F.size(stays)).otherwise(0),
        text_col: F.when(changed, F.array_join(stays, "\n")).otherwise(text),
    })
    return out.drop(key, drop)
