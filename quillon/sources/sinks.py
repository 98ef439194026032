"""Writers: JSON lines, envelopes, keyed upserts, review tables, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import dedup, quality

#: Tasks over which the chunks of one domain are spread.
FILES_A_PART = 16


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept; committed as a whole by the file committer."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_corpus(chunks: DataFrame, path: str, partition: str = "domain", documents: DataFrame | None = None) -> None:
    """Chunks sorted within files and laid out by domain, so that domain filters read only their part.

    Ids that are null, empty or repeated refuse the write, and so do, with ``documents`` (document, chunk_count), counts
    that the chunks do not bear out. A domain is split over tasks by a hash of the id, as one may hold most chunks.
    """
    bad = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR chunk_id IS NULL OR trim(chunk_id) = ''").orderBy("chunk_id").limit(5).collect()
    if bad:
        raise ValueError("chunk ids are repeated or missing: " + ", ".join(str(r["chunk_id"]) for r in bad))
    faults = quality.envelope_faults(documents, chunks.withColumnRenamed("document_id", "document")).orderBy("document").limit(5).collect() if documents is not None else []
    if faults:
        raise ValueError("documents and chunks differ: " + ", ".join(f"{r['document']}: {r['fault']}" for r in faults))
    spread = chunks.repartition(F.col(partition), F.pmod(F.xxhash64("chunk_id"), F.lit(FILES_A_PART)))
    spread.sortWithinPartitions(partition, "chunk_id").write.mode("overwrite").partitionBy(partition).parquet(path)


def envelope(chunks: DataFrame, documents: DataFrame, name: str) -> DataFrame:
    """One row: name, counts and fingerprint parts that go beside the written chunks."""
    counts = chunks.agg(F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("document_id").alias("documents_with_chunks"))
    return counts.join(documents.agg(F.count(F.lit(1)).alias("document_count"))).select(F.lit(name).alias("dataset_name"), F.lit("2.0").alias("schema_version"), "document_count", "documents_with_chunks", "chunk_count")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without the keys of new ones, and the new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def still_missing(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return rows.join(present.select(key), key, "left_anti")


def overwritten_payload(points: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """Points with the payload columns that a table has for them, null ones included; vectors untouched."""
    new = payloads.select(F.col(key).alias("_k"), F.lit(True).alias("_given"), *[F.col(c).alias(f"_new_{c}") for c in payloads.columns if c != key])
    both = points.join(new, points[key] == new["_k"], "left")
    changed = set(payloads.columns) - {key}
    return both.select(*[F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in points.columns])


def review_table(records: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed columns as text; lists are joined by ' | '."""
    kinds = dict(records.dtypes)
    return records.select(*[(F.concat_ws(" | ", c) if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])


def write_review(records: DataFrame, path: str, columns: list[str]) -> None:
    review_table(records, columns).write.mode("overwrite").csv(path, header=True)


def report(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("report"))


def process_id_fits(c: Column) -> Column:
    """Ids of stored processes, which name files, have one form only."""
    return c.rlike(r"^EVR-\d{8}-[A-F0-9]{8}$")


def build_manifest(files: DataFrame) -> DataFrame:
    """One row over written files (path, content): number, bytes and a digest of paths and contents, however many there are."""
    each = files.select("path", F.length("content").alias("b"), F.sha2("content", 256).alias("digest"))
    whole = dedup.corpus_fingerprint(each, "path").select(F.col("rows").alias("files"), F.col("fingerprint").alias("digest"))
    return whole.join(each.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))).select("files", "bytes", "digest")


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A letter's source: each {{name}} of a template replaced once by its value."""
    out: list[Column] = []
    rest = template
    while "{{" in rest:
        head, _, tail = rest.partition("{{")
        name, _, rest = tail.partition("}}")
        out += [F.lit(head), F.coalesce(values[name], F.lit("[DOLDURULACAK]"))]
    return F.concat(*out, F.lit(rest))
