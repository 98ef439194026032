import json

import pytest
from pyspark.sql import functions as F

from quillon.sources import readers, sinks
from quillon.streaming import lifecycle


def test_texts_and_signatures(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿Şehir".encode())
    (tmp_path / "b.txt").write_bytes("Şehir".encode("cp1254"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "d.pdf").write_bytes(b"hello")
    rows = {r["path"][-5:]: r["text"] for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert rows["a.txt"] == rows["b.txt"] == "Şehir"
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r[0][-5:]: r[1] for r in files.select("path", readers.signature_fits(F.col("path"), F.col("content"))).collect()} == {"a.txt": True, "b.txt": True, "c.pdf": True, "d.pdf": False}


def test_corpus_and_defaults(spark, tmp_path):
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps({"dataset_name": "x", "data": [{"chunk_id": "1", "title": "t", "text": "u", "source": "s"}]}))
    row = readers.read_corpus(spark, str(path)).first()
    assert row["source_kind"] == "unknown" and row["approved_for_active_rag"] is False


def test_review_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", ["a", "b"], None)], "id string, tags array<string>, note string")
    sinks.write_review(rows, str(tmp_path / "out"), ["id", "tags", "note"])
    back = readers.read_review(spark, str(tmp_path / "out")).first()
    assert back["tags"] == "a | b"
    bom = tmp_path / "bom.csv"
    bom.write_bytes("﻿id,v\n1,2\n".encode())
    assert readers.read_review(spark, str(bom)).columns == ["id", "v"]


def test_layers_and_lookups(spark):
    a, b = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "x"), (2, "y")], [(1, "z")]))
    assert {r["id"]: r["v"] for r in readers.layered_catalog([a, b], ["id"]).collect()} == {1: "z", 2: "y"}
    found, lost = readers.looked_up(a, spark.createDataFrame([(1,), (9,)], "id int"), "id")
    assert found.count() == 1 and [r["id"] for r in lost.collect()] == [9]


def test_lines_and_tables(spark):
    words = spark.createDataFrame([(1, 1, 1, 1, 2, "b", 5.0, 0.0, 9.0, 2.0), (1, 1, 1, 1, 1, "a", 0.0, 0.0, 4.0, 1.0)], "doc int, page int, block int, line int, word_no int, word string, x0 double, y0 double, x1 double, y1 double")
    row = readers.word_lines(words).first()
    assert (row["text"], row["x1"], row["y1"]) == ("a b", 9.0, 2.0)
    table = spark.createDataFrame([(5, 1, 1, 1, 1, 1, 0, 0, 1, 1, 80.0, "x"), (5, 1, 1, 1, 1, 2, 0, 0, 1, 1, 60.0, "y"), (4, 1, 1, 1, 1, 0, 0, 0, 1, 1, -1.0, None)], readers.TSV)
    assert readers.ocr_table(table).first()["confidence"] == 0.7


def test_upsert_render_and_policy(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert {r["k"]: r["v"] for r in sinks.upserted(old, new, "k").collect()} == {1: "a", 2: "c", 3: "d"}
    assert spark.range(1).select(sinks.rendered("Konu: {{s}}; {{t}}", {"s": F.lit("x"), "t": F.lit(None).cast("string")})).first()[0] == "Konu: x; [DOLDURULACAK]"
    files = spark.createDataFrame([("a/b.py",), ("c.md",)], "path string")
    policy = spark.createDataFrame([(1, r"\.py$", "keep"), (2, ".*b.*", "drop")], "place int, pattern string, decision string")
    assert {r["path"]: r["decision"] for r in readers.first_policy(files, policy, "ask").collect()} == {"a/b.py": "keep", "c.md": "ask"}


def test_corpus_writer_prunes(spark, tmp_path):
    rows = spark.createDataFrame([("1", "d1", "x"), ("2", "d2", "y")], "chunk_id string, document_id string, domain string")
    sinks.write_corpus(rows, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).filter("domain = 'x'").count() == 1
    assert sinks.envelope(rows, rows.select("document_id"), "n").first()["chunk_count"] == 2


EVENTS = [(1, 1, "2024-01-01 00:00:00", "OPEN"), (1, 2, "2024-01-01 00:01:00", "COMPLETED"), (1, 3, "2024-01-01 00:02:00", "OPEN"), (2, 4, "2024-01-01 00:00:30", "OPEN")]


def events(spark):
    return spark.createDataFrame(EVENTS, "document int, event_id int, at string, status string").select("document", "event_id", F.to_timestamp("at").alias("ts"), "status")


def test_terminal_states_refuse_events(spark):
    kept = lifecycle.accepted_events(events(spark), lifecycle.TERMINAL)
    assert sorted(r["event_id"] for r in kept.collect()) == [1, 2, 4]
    assert {r["document"]: r["status"] for r in lifecycle.latest_state(kept).collect()} == {1: "COMPLETED", 2: "OPEN"}


def test_stream_agrees_with_batch(spark, tmp_path):
    for i in range(2):
        events(spark).filter(F.col("event_id") % 2 == i).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in*"))
    lifecycle.streamed_state(stream, lifecycle.TERMINAL).writeStream.format("memory").queryName("lifecycles").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = {r["document"]: r["status"] for r in spark.sql("select document, max_by(status, events) status from lifecycles group by document").collect()}
    assert got == {1: "COMPLETED", 2: "OPEN"}


def test_windowed_stream_to_files(spark, tmp_path):
    rows = events(spark).select("ts", F.col("status").alias("event_type"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    lifecycle.run_available(lifecycle.windowed(stream, "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["start", "event_type", "n", "total"]


def test_checkpoints_refuse_other_corpora(spark, tmp_path):
    from quillon.streaming import lifecycle

    path = f"file://{tmp_path}/state.json"
    assert lifecycle.load_checkpoint(spark, path, {"fingerprint": "a"}) is None
    for last in (5, 9):
        lifecycle.save_checkpoint(spark, path, {"fingerprint": "a", "last": last})
    assert lifecycle.load_checkpoint(spark, path, {"fingerprint": "a"})["last"] == 9
    assert lifecycle.load_checkpoint(spark, path, {"fingerprint": "b"}, overwrite=True) is None
    with pytest.raises(ValueError, match="another fingerprint"):
        lifecycle.load_checkpoint(spark, path, {"fingerprint": "b"})
    assert [f.name for f in tmp_path.iterdir() if "crc" not in f.name] == ["state.json"]


def test_zipped_sides_of_unequal_length_fail(spark):
    from quillon.operators import chunking

    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, a string"), spark.createDataFrame([(1, "z")], "i int, b string")
    assert [tuple(r) for r in chunking.zipped(a.limit(1), b, "i").collect()] == [(1, "x", "z")]
    with pytest.raises(Exception, match="differ in length"):
        chunking.zipped(a, b, "i").collect()


def _chunk(number, **changes):
    row = {"chunk_id": f"c{number}", "document_id": "d", "title": "t", "section": "s", "article": "a", "text": f"x{number}", "source": "data/x.pdf", "context_text": "c", "source_sha256": "a" * 64, "domain": "road_transport", "page": 1, "page_end": 2, "source_url": "https://a.org/x"}
    return {**row, **changes}


def _corpus(tmp_path, name, rows):
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps({"dataset_name": name, "data": rows}))
    return str(path)


PUBLIC = {"source_kind": "public_legislation", "approved_for_active_rag": True, "validity_status": "verified", "ocr_status": "ocr_verified"}
SNAPSHOT = {"source_kind": "competition_snapshot", "approved_for_active_rag": False, "validity_status": "needs_verification", "status": "competition_snapshot_not_currentness_verified", "ocr_status": "text_layer_available"}


def test_trusted_corpora_by_mode(spark, tmp_path):
    made = {"status": readers.SYNTHETIC_STATUS}
    for mode, extra in (("synthetic", made), ("public", PUBLIC), ("snapshot", SNAPSHOT)):
        rows = [_chunk(i, **extra) for i in (1, 2)]
        chunks, bound = readers.read_trusted(spark, _corpus(tmp_path, mode, rows), mode)
        assert chunks.count() == 2 and bound.first()["rows"] == 2
        again = readers.read_trusted(spark, _corpus(tmp_path, f"{mode}2", rows[::-1]), mode)[1]
        assert again.first() == bound.first()
        changed = readers.read_trusted(spark, _corpus(tmp_path, f"{mode}3", [rows[0], {**rows[1], "text": "y"}]), mode)[1]
        assert changed.first()["fingerprint"] != bound.first()["fingerprint"]
        for other in {"synthetic", "public", "snapshot"} - {mode}:
            with pytest.raises(ValueError, match="c1"):
                readers.read_trusted(spark, _corpus(tmp_path, "other", rows), other)
    assert {r[0] for r in readers.read_trusted(spark, _corpus(tmp_path, "s", [_chunk(1, **made)]), "synthetic")[0].select("source_kind").collect()} == {"synthetic"}
    with pytest.raises(ValueError, match="repeated"):
        readers.read_trusted(spark, _corpus(tmp_path, "twice", [_chunk(1, **PUBLIC)] * 2), "public")
    with pytest.raises(ValueError, match="chunk_id"):
        readers.read_trusted(spark, _corpus(tmp_path, "blank", [_chunk(1, **{**PUBLIC, "chunk_id": " "})]), "public")


def test_corpus_writer_refuses(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d1", "road"), ("b", "d1", "road"), ("c", "d2", "sea")], "chunk_id string, document_id string, domain string")
    counts = spark.createDataFrame([("d1", 2), ("d2", 1)], "document string, chunk_count int")
    sinks.write_corpus(rows, str(tmp_path / "ok"), documents=counts)
    assert spark.read.parquet(str(tmp_path / "ok")).filter("domain = 'road'").count() == 2
    with pytest.raises(ValueError, match="a"):
        sinks.write_corpus(rows.union(rows.limit(1)), str(tmp_path / "no"))
    with pytest.raises(ValueError, match="missing"):
        sinks.write_corpus(rows.withColumn("chunk_id", F.lit(None).cast("string")), str(tmp_path / "no"))
    with pytest.raises(ValueError, match="d2"):
        sinks.write_corpus(rows, str(tmp_path / "no"), documents=counts.filter("document = 'd1'"))
    assert not (tmp_path / "no").exists()
