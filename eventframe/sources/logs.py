"""Text lines of size logs, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: shape of a size line.
SIZE_LINE = r"shardId-(\d+) (\d+) (\{.*\})"


def write_lines(lines: DataFrame, path: str, failed_line: str | None = None) -> None:
    """Append text lines to a log folder, closed by the marker line of a failed run."""
    rows = lines.select("line")
    if failed_line is not None:
        rows = rows.unionByName(lines.sparkSession.range(1).select(F.lit(failed_line).alias("line")))
    rows.write.mode("append").text(path)


def size_lines(sizes: DataFrame) -> DataFrame:
    """Lines of per-queue sizes: (date, shard, name, chars) to (date, line)."""
    entries = F.array_sort(F.collect_list(F.concat("name", F.lit(": "), F.col("chars").cast("string"))))
    grouped = sizes.groupBy("date", "shard").agg(F.sum("chars").alias("bytes"), entries.alias("entries"))
    return grouped.select(
        "date",
        F.concat(
            F.lit("size: shardId-"), F.lpad(F.col("shard").cast("string"), 12, "0"), F.lit(" "),
            F.col("bytes").cast("string"), F.lit(" { "), F.concat_ws(", ", "entries"), F.lit(" }"),
        ).alias("line"),
    )


def parse_size_lines(lines: DataFrame) -> DataFrame:
    """(date, shard, bytes, queue, queue_bytes) of size lines; other lines give nothing."""
    rows = lines.filter(F.col("line").rlike(SIZE_LINE)).select(
        "date",
        F.regexp_extract("line", SIZE_LINE, 1).alias("shard"),
        F.regexp_extract("line", SIZE_LINE, 2).cast("bigint").alias("bytes"),
        F.regexp_replace(F.regexp_extract("line", SIZE_LINE, 3), r"[{}']", "").alias("_map"),
    )
    sizes = F.filter(F.split("_map", r"\s*,\s*"), lambda e: e.contains(":"))
    return rows.select("date", "shard", "bytes", F.explode(sizes).alias("_entry")).select(
        "date",
        "shard",
        "bytes",
        F.trim(F.split_part("_entry", F.lit(":"), F.lit(1))).alias("queue"),
        F.trim(F.split_part("_entry", F.lit(":"), F.lit(2))).try_cast("bigint").alias("queue_bytes"),
    )
