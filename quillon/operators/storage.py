"""Tables that several jobs read: written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or in local mode, where it is unset, a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: ``df`` as Parquet in the shared folder, so that a lost executor costs no recomputation of it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there as a whole, the old one or the new one: written beside its place, then put there in one step.

    A crash between the steps leaves the old file as it was, and a file beside it that nothing reads.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = place.getFileSystem(conf)
    out = files.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    where = files.makeQualified(place)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(files.makeQualified(beside), where, over)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def signature(df: DataFrame) -> str:
    """The files that ``df`` reads, with their lengths and times: what tells one state of a table from another."""
    spark = df.sparkSession
    out = []
    for file in sorted(df.inputFiles()):
        fs, where = file_system(spark, file)
        status = fs.getFileStatus(where)
        out.append(f"{file}:{status.getLen()}:{status.getModificationTime()}")
    return "\n".join(out)


@atexit.register
def drop_folders() -> None:
    for spark, path in _folders:
        try:
            fs, where = file_system(spark, path)
            fs.delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            continue
    _folders.clear()
