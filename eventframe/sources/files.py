"""Files that wait to be loaded: discovery by cursor, load commands, their lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import div
from ..operators.running import with_running_total
from ..schemas import LOAD_COMMAND
from . import folders

# Where files land, files per command, queue of the commands.
PREFIX = "firehose/"
PAGE = 100
# Characters behind the prefix by which keys are cut into runs: a day's folder of a dated layout.
BEGIN_CHARS = 10
COMMAND = "load"
COMMAND_QUEUE = "commands.s3_bus_load"

# Paths handed to a reader by name; beyond it the folders that hold the files are read and joined.
MAX_PATHS = 10_000


def listing(spark: SparkSession, folder: str, after: str = "") -> DataFrame:
    """Keys and sizes below a folder; contents are not read, and folders whose keys all come before ``after`` are not listed."""
    root = folder.rstrip("/") + "/"
    places = _open_places(spark, root, "", after) if after else [folder]
    if not places:
        return spark.createDataFrame([], "key string, bytes bigint")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(places)
    path = plain_path(F.col("path"))
    return files.select(F.substr(path, F.lit(len(plain_text(root)) + 1)).alias("key"), F.col("length").alias("bytes"))


def _open_places(spark: SparkSession, root: str, below: str, after: str) -> list[str]:
    """Files and folders that can hold keys behind ``after``; only folders on its own path are looked into."""
    found = []
    for name, is_folder in folders.entries(spark, f"{root}{below}"):
        key = f"{below}{name}/" if is_folder else f"{below}{name}"
        if is_folder and after.startswith(key):
            found += _open_places(spark, root, key, after)
        elif key > after and not name.startswith(("_", ".")):
            found.append(f"{root}{below}{name}")
    return found


def next_files(files: DataFrame, cursor: str, prefix: str = PREFIX, limit: int = PAGE) -> DataFrame:
    """The first files after the cursor in key order."""
    return files.filter(F.col("key").startswith(prefix) & (F.col("key") > cursor)).orderBy("key").limit(limit)


def cursor_after(page: DataFrame, cursor: str) -> DataFrame:
    """The cursor once a page is done, and how many files it had; an empty page moves nothing."""
    return page.agg(F.coalesce(F.max("key"), F.lit(cursor)).alias("cursor"), F.count("*").alias("files"))


def load_command(page: DataFrame, bucket: str) -> DataFrame:
    """One command row for a page of files, and the cursor after it; no row for no files."""
    listed = page.agg(F.array_sort(F.collect_list("key")).alias("keys")).filter(F.size("keys") > 0)
    files = F.transform("keys", lambda k: F.struct(F.lit(bucket).alias("bucket"), k.alias("key")))
    payload = F.to_json(F.struct(F.lit(COMMAND).alias("command"), files.alias("files")))
    return listed.select(payload.alias("payload"), F.element_at("keys", -1).alias("cursor"))


def load_commands(files: DataFrame, bucket: str, cursor: str = "", prefix: str = PREFIX, limit: int = PAGE) -> DataFrame:
    """All load commands for the files after the cursor: ``page, payload, cursor, files`` per page of ``limit`` files, in key order."""
    rows = files.filter(F.col("key").startswith(prefix) & (F.col("key") > cursor)).select("key", F.lit(0).alias("_all"))
    # Beginnings of keys order as the keys do.
    rows = rows.withColumn("_begin", F.substring("key", 1, len(prefix) + BEGIN_CHARS))
    numbered = with_running_total(rows, ["_all"], ["_begin"], ["key"], F.lit(1).cast("bigint"), "_n")
    pages = numbered.groupBy(div(F.col("_n") - 1, limit).alias("page")).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    named = F.transform("keys", lambda k: F.struct(F.lit(bucket).alias("bucket"), k.alias("key")))
    payload = F.to_json(F.struct(F.lit(COMMAND).alias("command"), named.alias("files")))
    return pages.select("page", payload.alias("payload"), F.element_at("keys", -1).alias("cursor"), F.size("keys").cast("bigint").alias("files"))


def command_files(commands: DataFrame) -> DataFrame:
    """One row per file of each load command, in list order."""
    columns = [c for c in commands.columns if c != "payload"]
    parsed = commands.withColumn("_c", F.from_json("payload", LOAD_COMMAND)).filter(F.col("_c.command") == COMMAND)
    return parsed.select(*columns, F.posexplode("_c.files").alias("pos", "_f")).select(
        *columns, "pos", F.col("_f.bucket").alias("bucket"), F.col("_f.key").alias("key")
    )


def plain_text(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def plain_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file:/+", "/")


def _holding(wanted: DataFrame) -> list[str]:
    """Folders below which all wanted files lie, none inside another: their own ones, or the bases where those are too many."""
    parent = F.regexp_replace("_path", "/[^/]*$", "")
    found = [r[0] for r in wanted.select(parent.alias("place")).distinct().limit(MAX_PATHS + 1).collect()]
    if len(found) > MAX_PATHS:
        found = [r[0] for r in wanted.select("_base").distinct().collect()]
    places: list[str] = []
    for place in sorted(found, key=lambda p: f"{p}/"):
        if not places or not place.startswith(f"{places[-1]}/"):
            places.append(place)
    return places


def lines_of(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """Text lines of the files in ``files`` (column ``key`` below ``root``), with its columns.

    ``block`` and ``row`` order the lines of a file.

    A file whose ``bucket`` is a path or address lies below it instead. Files that are
    not there raise an error, however many are named: up to ``MAX_PATHS`` names go to the
    reader, so it opens nothing else; more names stay in the cluster, where the folders that
    hold them are listed, compared and read by join.
    """
    base = F.lit(root.rstrip("/"))
    if "bucket" in files.columns:
        base = F.when(F.col("bucket").contains("/"), plain_path(F.rtrim("bucket", F.lit("/")))).otherwise(base)
    wanted = files.withColumn("_base", base).withColumn("_path", F.concat("_base", F.lit("/"), "key"))
    named = [r[0] for r in wanted.select("_path").distinct().limit(MAX_PATHS + 1).collect()]
    if not named:
        place = [T.StructField("text", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("block", "row")]]
        schema = T.StructType([*files.schema.fields, *place])
        return spark.createDataFrame([], schema)
    reader = spark.read
    if len(named) <= MAX_PATHS:
        texts = reader.text(sorted(named))
    else:
        places = _holding(wanted)
        listed = reader.format("binaryFile").option("recursiveFileLookup", "true").load(places)
        missing = wanted.join(listed.select(plain_path(F.col("path")).alias("_path")), "_path", "left_anti").first()
        if missing is not None:
            raise FileNotFoundError(missing["_path"])
        texts = reader.option("recursiveFileLookup", "true").text(places)
    texts = texts.select(
        F.col("value").alias("text"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        plain_path(F.col("_metadata.file_path")).alias("_path"),
    )
    return texts.join(wanted, "_path").drop("_path", "_base")
