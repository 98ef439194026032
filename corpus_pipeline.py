"""A training corpus from raw documents in five stages, each an operator of ``quillon.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the
shared folder and gives them, read again, to the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import fair_mix, merge_dropout, pii_boost, toxicity, trie_join
from quillon.llm.shared import drop_written, written, written_count

#: The stages depend on trained models and hash orders, which SQL cannot express; tests compare with plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from the labels, stays below the threshold.

    Null and empty texts get the score of no evidence and stay; long texts are read whole; repeated rows share their
    score. Without labelled texts all stay. An empty table gives none. Other columns may have any names.
    """
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, scorer).filter(F.col("_toxicity") < toxicity.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least id, null the greatest; of rows with equal id and text one.

    Each row is judged by its own text, also where ids repeat or are null. Null and empty texts and those without
    words link with nothing and stay; long texts are compared whole; ties go by a hash of the text. An empty table
    gives none. Other columns may have any names.
    """
    return trie_join.without_copies(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows, if the table has it.

    Null and empty texts stay as they are; long texts are searched whole; equal texts are redacted alike; ties between
    spans go by their place. An empty table gives none. Other columns may have any names.
    """
    found = pii_boost.find_private(docs)
    new = {"text": F.col("_redacted"), "n_chars": F.length("_redacted").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Null and empty texts, and those without words, have size 0 and are not taken; long texts are taken whole. A null
    source is a source; repeated rows share their fate; ties in finish time go by source. An empty table gives none.
    Other columns may have any names.
    """
    return fair_mix.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = merge_dropout.DEFAULT_MODEL) -> DataFrame:
    """Piece ids of each text under merge-dropout: doc_id, lang, source, n_pieces, pieces.

    A null text has null pieces, an empty one none; long texts are encoded whole; rows with equal id and text agree;
    ties between merges go to the leftmost. An empty table gives none. Other columns are left out.
    """
    with open(model, "rb") as f:
        data = f.read()
    out = merge_dropout.encode_pieces(docs.select("doc_id", "lang", "source", "text"), data)
    return out.select("doc_id", "lang", "source", F.size("_ids").alias("n_pieces"), F.col("_ids").alias("pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_private),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows.

    A stage's rows are written before the next one starts; what came before them is then deleted. Null, empty, long
    and repeated rows, ties and empty tables are what the stages make of them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = written_count()
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
        drop_written(first, written_count() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
