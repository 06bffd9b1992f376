"""Session helpers: shared work folder and checked broadcast hints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 200_000
SMALL_BYTES = 32 * 1024 * 1024


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "eventframe") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", f"{tempfile.gettempdir()}/eventframe-work")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def work_table(df: DataFrame, label: str) -> DataFrame:
    """Write rows that are read several times to the shared folder and read them back.

    It cuts the lineage, and lost executors cost a read instead of the work.
    """
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> bool:
    """Measure at most ``max_rows + 1`` rows of ``df`` against both bounds."""
    probe = df.limit(max_rows + 1).select(F.length(F.to_json(F.struct("*"))).alias("n"))
    rows, size = probe.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def hint_small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` when its measured size allows; else let AQE choose and split skew."""
    return F.broadcast(df) if is_small(df) else df
