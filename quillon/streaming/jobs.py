"""Jobs that are reserved once, run as a stream in batches that may be replayed, and are polled.

Everything is a file that appears whole or not at all, so a driver lost at any point leaves a state that the next one
can read: a reservation is a file that only one caller can create, a status is replaced in one step, and a batch of rows
is a folder named by its number that counts only when its commit file is there.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.storage import file_system, replace_text

RESERVED, RUNNING, DONE, FAILED = "reserved", "running", "done", "failed"


def reserve(spark: SparkSession, path: str, job: str, **details: object) -> bool:
    """Whether this call reserved the job; False if anyone has before. Ids are checked, as they name files."""
    _checked(job)
    files, place = file_system(spark, f"{path}/reservations/{job}.json")
    files.mkdirs(place.getParent())
    # Creation without overwriting is the condition: of several callers one succeeds.
    if not files.createNewFile(place):
        return False
    set_status(spark, path, job, RESERVED, **details)
    return True


def release(spark: SparkSession, path: str, job: str) -> None:
    """Give a reservation up, so that the job can be reserved again; rows that it has committed stay."""
    _checked(job)
    files, place = file_system(spark, f"{path}/reservations/{job}.json")
    files.delete(place, False)


def set_status(spark: SparkSession, path: str, job: str, status: str, **details: object) -> None:
    replace_text(spark, f"{path}/status/{_checked(job)}.json", json.dumps({"job": job, "status": status, **details}, sort_keys=True))


def poll(spark: SparkSession, path: str, job: str) -> dict | None:
    """The job's last status, or None if it has none."""
    files, place = file_system(spark, f"{path}/status/{_checked(job)}.json")
    return json.loads(spark.read.text(place.toString(), wholetext=True).first()[0]) if files.exists(place) else None


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """(job, status) of all jobs."""
    return spark.read.schema("job string, status string").json(f"{path}/status/*.json")


def _checked(job: str) -> str:
    if not job or not all(c.isascii() and (c.isalnum() or c in "-_") for c in job):
        raise ValueError(f"not a job id: {job!r}")
    return job


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer for which a replay changes nothing.

    A batch goes to the folder of its number, over what an interrupted run left there, and is committed by a file beside
    it. A batch that is committed is not written again, whatever a replay would give.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        files, commit = file_system(spark, f"{path}/commits/{batch}")
        if files.exists(commit):
            return
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        replace_text(spark, f"{path}/commits/{batch}", "")

    return write


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed batches, with ``batch``."""
    files, place = file_system(spark, f"{path}/commits")
    names = sorted(int(s.getPath().getName()) for s in files.listStatus(place)) if files.exists(place) else []
    folders = [f"{path}/rows/batch={n}" for n in names]
    if not folders:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", f"{path}/rows").parquet(*folders)


def run(stream: DataFrame, path: str, job: str) -> dict:
    """Run a reserved job over what its stream (or the rest of it) holds; its status says how it went.

    A failed job can be run again: committed batches stay, and the stream goes on behind them.
    """
    spark = stream.sparkSession
    if poll(spark, path, job) is None:
        raise ValueError(f"the job {job} is not reserved")
    set_status(spark, path, job, RUNNING)
    try:
        stream.writeStream.foreachBatch(write_batch(f"{path}/jobs/{job}")).option("checkpointLocation", f"{path}/jobs/{job}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    except Exception as error:
        set_status(spark, path, job, FAILED, reason=str(error).splitlines()[0][:300] if str(error) else type(error).__name__)
        raise
    rows = committed(spark, f"{path}/jobs/{job}", _ddl(stream))
    set_status(spark, path, job, DONE, rows=rows.count())
    return poll(spark, path, job)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
