"""The shared folder: tables written once and read again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where neither the session nor its context names one and Spark runs in this
    one process (tests) is a temporary folder made, to be removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="scrivia-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Rows of an Arrow batch while a write runs; None leaves the session's setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if rows:
            spark.conf.set(key, before)


def materialise(df: DataFrame, label: str, batch: int | None = None, parts: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends here.

    ``batch``: rows of an Arrow batch meanwhile, for Python functions over long texts.
    ``parts``: the most tasks and files worth having, where the caller has counted the rows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with arrow_batches(spark, batch):
        (df if parts is None else df.coalesce(parts)).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete the folders of written frames that nothing reads any more."""
    for f in frames:
        path = getattr(f, "scratch_path", None)
        if path:
            delete(f.sparkSession, path)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def changed(spark: SparkSession, path: str) -> int:
    """When the file or folder was last changed, in milliseconds."""
    fs, at = _at(spark, path)
    return fs.getFileStatus(at).getModificationTime()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where it is not there."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly in a folder, none where it is not there."""
    fs, at = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if nothing is there under its name; of several writers one has True.

    It is written whole beside and renamed without overwriting, so nobody reads half of it.
    """
    fs, at = _at(spark, path)
    _, beside = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(at), options)
        return True
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(at):
            return False
        raise
