"""Change feeds: rows of old and new documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import parsed_image, plain_image
from ..operators.running import with_previous
from ..schemas import CHANGE


def stream_changes(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Change records from JSON files, oldest first."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", max_files).json(path)


def typed_changes(rows: DataFrame, image: T.StructType) -> DataFrame:
    """(seq, kind, changed_ms, new, old) of change records; images get the types of ``image``."""
    record = F.col("dynamodb")
    parsed = rows.select(
        record["SequenceNumber"].alias("seq"),
        F.col("eventName").alias("kind"),
        (record["ApproximateCreationDateTime"] * 1000).alias("changed_ms"),
        parsed_image(record["NewImage"], image).alias("_new"),
        parsed_image(record["OldImage"], image).alias("_old"),
    )
    return parsed.select(
        "seq", "kind", "changed_ms",
        plain_image(F.col("_new"), image).alias("new"), plain_image(F.col("_old"), image).alias("old"),
    )


def changes_of_versions(versions: DataFrame, key: list[str], bucket: list[str], order: list[str], document: Column) -> DataFrame:
    """Old and new document per version of a key.

    ``bucket`` cuts the versions of a key into ordered stretches, so a key that
    is written all the time does not end up in one task.
    """
    rows = with_previous(versions.withColumn("new", document), key, bucket, order, "new", "old")
    return rows.withColumn("kind", F.when(F.col("old").isNull(), "INSERT").otherwise("MODIFY"))
