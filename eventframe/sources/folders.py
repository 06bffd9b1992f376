"""Files of the shared folder, on whatever file system Spark uses for it."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


# Object stores that neither create a file for one writer alone nor move a folder as a whole.
NOT_EXCLUSIVE = {"s3", "s3a", "s3n", "oss", "cosn", "swift"}


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder."""
    if not exists(spark, path):
        return []
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def entries(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names directly below a folder, and whether each is a folder."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file, or None."""
    if not exists(spark, path):
        return None
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a small file with its whole content; False if it is there already, whoever made it."""
    fs, target = _path(spark, path)
    target = fs.makeQualified(target)
    kind = fs.getUri().getScheme()
    if kind in NOT_EXCLUSIVE:
        raise ValueError(f"{kind}: no file can be created there for one writer alone; keep the store on HDFS, ABFS or a shared disk")
    _, fresh = _path(spark, f"{path}.{uuid.uuid4().hex}.new")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if kind == "file":
            # A plain rename would replace the file on a local or mounted disk; a link does not.
            os.link(fresh.toUri().getPath(), target.toUri().getPath())
            return True
        return _rename(spark, fs, fs.makeQualified(fresh), target)
    except FileExistsError:
        return False
    finally:
        fs.delete(fresh, False)


def _rename(spark: SparkSession, fs, source, target) -> bool:
    """Move a file or folder to a name nobody has; False if the name is taken or the source is gone."""
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, spark._sc._gateway.new_array(rename, 0))
    except Py4JJavaError as failed:
        if fs.exists(target) or not fs.exists(source):
            return False
        raise failed
    return True


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file or folder, whole or not at all, to a name nobody has; False if the name is taken or the source is gone."""
    fs, old = _path(spark, source)
    _, new = _path(spark, target)
    fs.mkdirs(new.getParent())
    return _rename(spark, fs, fs.makeQualified(old), fs.makeQualified(new))


def files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the data files anywhere below a folder."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return []
    found, listed = [], fs.listFiles(p, True)
    while listed.hasNext():
        file = listed.next().getPath()
        if not file.getName().startswith(("_", ".")):
            found.append(file.toString())
    return found
