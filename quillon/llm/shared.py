"""Helpers that several operators share: the shared folder, written intermediates, word pattern, held-out split."""

from __future__ import annotations

import atexit
import ctypes
import gc
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a folder of this process."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet, with options of the writer, and read it back.

    A lost executor costs no recomputation of what is written. The files go with ``drop_written``, or when the driver's
    process ends, as a result that reads them may be computed at any time until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written_count() -> int:
    """How many folders ``written`` has written and not yet deleted."""
    return len(_written)


def drop_written(first: int = 0, last: int | None = None) -> None:
    """Delete what ``written`` wrote, from its ``first`` folder on, before its ``last``; results that read these can no longer be computed."""
    gone = _written[first:last]
    del _written[first:last]
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            continue


atexit.register(drop_written)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow``, after each task of which a Python worker gives its free memory back; Spark reuses workers."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    if not any("." in c or "`" in c for c in df.columns):
        return df.mapInArrow(tidy, schema)
    # Such names cannot be resolved there, so others stand in for them; operators go by place.
    plain = {c: f"_plain{i}" for i, c in enumerate(df.columns)}
    fields = schema.fields if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema).fields
    out = df.toDF(*plain.values()).mapInArrow(tidy, T.StructType([T.StructField(plain.get(f.name, f.name), f.dataType) for f in fields]))
    return out.toDF(*[f.name for f in fields])


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        return


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, _row, so that no name of theirs can clash; ``_row.*`` gives them back."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row")


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, which an operator is about to add."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


def least_hashed(rows: DataFrame, group: str, key: str, value: str, n: int) -> DataFrame:
    """Of each group the ``n`` distinct keys of least hash: group, value (of one of the key's rows, all alike) and place _n.

    Distinct keys are estimated first; hashes above twice the share that is asked for can hardly be among the least, so
    what reaches a group's task is about 2 n keys, however large the group and however often its rows repeat.
    """
    hashed = rows.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 1))
    sizes = hashed.groupBy(group).agg(F.approx_count_distinct("_hash").alias("_size"))
    # Labels and languages are few; were they many, the join would shuffle and the groups be small.
    if sizes.limit(10_001).count() <= 10_000:
        sizes = F.broadcast(sizes)
    near = hashed.join(sizes, group).filter(F.col("_hash") / F.lit(float(2**63)) <= (2.0 * n + 100) / F.col("_size"))
    first = Window.partitionBy(group).orderBy("_hash")
    chosen = near.select(group, "_hash").distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n)
    # As small as the sample.
    found = hashed.join(F.broadcast(chosen), [group, "_hash"])
    return found.groupBy(group, "_n").agg(F.min(value).alias(value))


def listed(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of constant rows, as one literal of the plan: no Python process serves it."""
    names = [c.split()[0] for c in ddl.split(", ")]
    literal = F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows]))
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(literal, f"array<struct<{ddl}>>")))


def held_out(id_column: Column) -> Column:
    """True where crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))
