"""Queries over the driver's tables, one for each operator, and SQL that DuckDB runs for those it can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fair_mix, gif_media, merge_dropout, merkle, page_text, pii_boost, ppm_langid, quality_rules, secret_scan, token_alignment, toxicity, trie_join, url_filter
from .oracle import SQL
from .shared import held_out


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(_read(spark, sf_dir, "pages", "page_id", "url"))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    stored = gif_media.write_gifs(docs)
    slim = stored.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "_media")
    shown = gif_media.read_gifs(slim)
    levels = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(gif_media.BINS - 1)), _level_sum), ",")
    feature = F.format_string("frames=%d;ms=%d;levels=%s", F.size("_frames"), F.aggregate("_frames", F.lit(0).cast("long"), lambda a, f: a + f["delay_ms"]), levels)
    return shown.select(
        "doc_id", "n_bytes", F.octet_length("_payload").cast("long").alias("payload_bytes"), F.sha2("_payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("_payload", -64, 64)).alias("tail_crc32"), F.octet_length("_media").cast("long").alias("media_bytes"), F.sha2("_media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def _level_sum(level: Column) -> Column:
    """Pixels of one grey level over all frames; grey has equal red, green and blue."""
    return F.aggregate("_frames", F.lit(0).cast("long"), lambda a, f: a + f["histogram"][level]).cast("string")


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fair_mix.fair_mix(_read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    with open(merge_dropout.DEFAULT_MODEL, "rb") as f:
        model = f.read()
    encoded = merge_dropout.encode_pieces(docs, model)
    slim = encoded.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "_ids")
    decoded = merge_dropout.decode_pieces(slim, model)
    ids = F.sha2(F.array_join(F.col("_ids").cast("array<string>"), ","), 256)
    return decoded.select("doc_id", F.coalesce(F.size("_ids"), F.lit(0)).cast("long").alias("n_pieces"), F.coalesce(ids, F.sha2(F.lit(""), 256)).alias("ids_sha256"), (F.sha2("_decoded", 256).eqNullSafe(F.col("text_sha256"))).alias("lossless"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(_read(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.col("_spans")
    counts = [F.size(_of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.filter(spans, lambda x: x["rank"] < 3)
    return out.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    scorer = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, scorer)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trie_join.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"))


def op9_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = ppm_langid.fit(docs)
    out = ppm_langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op10_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_boost.find_private(_read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "_spans")
    spans = F.col("_spans")
    counts = [F.size(_of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in pii_boost.BASE_KINDS]
    base = F.filter(spans, lambda x: x["rank"] < len(pii_boost.BASE_KINDS))
    return out.select("doc_id", *counts, F.sha2(pii_boost.joined(base), 256).alias("base_sha256"), pii_boost.joined(spans).alias("spans"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = []
    for path in (token_alignment.FIRST_MODEL, token_alignment.SECOND_MODEL):
        with open(path, "rb") as f:
            models.append(f.read())
    return token_alignment.token_links(_read(spark, sf_dir, "documents", "doc_id", "text"), *models)


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(_read(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_gif_media, op4_fair_mix, op5_merge_dropout, op6_secret_scan, op7_toxicity, op8_trie_join, op9_ppm_langid, op10_pii_boost, op11_token_alignment, op12_page_text, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
