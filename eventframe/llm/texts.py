"""Shared by operators over texts: chosen columns, Arrow batches, work tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """A column name that is not among ``columns``, whatever the case of their letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def schema_of(df: DataFrame, added: str) -> StructType:
    """The id's type and the columns that an Arrow function adds."""
    return StructType([df.schema["id"], *StructType.fromDDL(added).fields])


def cut(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows each, so that few texts are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def map_texts(df: DataFrame, added: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Rows of ``id`` and the added columns from rows of ``id`` and ``text``.

    ``make`` runs once a task and gives a function from a batch's texts (None for null) to
    its new columns. Batches are bounded in bytes and rows by Spark.
    """
    schema = schema_of(df, added)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in cut(batches):
            columns = of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names)

    return df.select("id", "text").mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows, all columns as they are, whose text is kept; ``make`` gives a batch's decisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in cut(batches):
            yield batch.filter(pa.array(of(batch.column(text_col).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; set by this library only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = f"{tempfile.gettempdir()}/eventframe-shared"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def work_table(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Rows that are read more than once, written to the shared folder and read back.

    It cuts the lineage, and a lost executor costs a read instead of the work.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
