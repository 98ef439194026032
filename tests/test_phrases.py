"""The phrase automaton against plain search, for tens of thousands of phrases, crowded keys, blocks, rules and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import fusion, phrases, rules
from quillon.plans import retrieval


def plain(texts, wanted):
    return sorted((i, p) for i, t in texts if t is not None for p in {p for p in wanted if p is not None} if p in t)


def found(df):
    return sorted((r["id"], r["phrase"]) for r in df.collect())


TEXTS = [(1, None), (2, ""), (3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"), (4, "the phrase that ends"), (4, "the phrase that ends"), (5, "İstanbul ışık 日本語 😀x"), (6, "x" * 200_000 + "needle"), (7, "a\x00b\nc")]
WANTED = ["a", "aa", "aaaaaaaaaaaaaaaaab", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ends", "that ends!", "ışık 日本", "😀", "needle", "x" * 1000, "a\x00b", "", None, "ends"]


def test_odd_texts_and_phrases(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    wanted = spark.createDataFrame([(p,) for p in WANTED], "phrase string")
    assert found(phrases.held(texts, wanted)) == plain(TEXTS, WANTED)
    assert phrases.held(texts, wanted.limit(0)).count() == 0 and phrases.held(texts.limit(0), wanted).count() == 0
    extra = phrases.held(texts.withColumn("other", F.lit(2)).select("other", "text", "id"), wanted)
    assert extra.columns == ["other", "id", "phrase"]


def test_automaton_of_random_phrases():
    rng = random.Random(3)
    for _ in range(60):
        wanted = list({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) for _ in range(60)})
        text = "".join(rng.choice("ab") for _ in range(300))
        automaton = phrases.Phrases(wanted)
        assert [wanted[i] for i in automaton.held(text)] == [p for p in wanted if p in text]


def test_phrases_that_begin_alike():
    wanted = [f"Question number one of all questions, which is {i}?" for i in range(3000)] + ["Question number one", "Question number one of all quest"]
    automaton = phrases.Phrases(wanted)
    # Keys grow until they tell phrases apart, so few are tried at a place.
    assert max(len(m) for _, m in automaton.automaton.values()) <= phrases.CROWD
    text = "He asked: Question number one of all questions, which is 17? and so on"
    assert [wanted[i] for i in automaton.held(text)] == [p for p in wanted if p in text]
    same = ["Question number one of all questions" + " " * k for k in range(100)]
    assert phrases.Phrases(same).held(same[99]) == list(range(100))


def test_fifty_thousand_phrases_in_one_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    rows = docs.collect()
    rng = random.Random(5)
    wanted = set()
    while len(wanted) < 50_000:
        t = rng.choice(rows)["text"] or ""
        at = rng.randrange(max(1, len(t)))
        wanted.add(t[at : at + rng.randrange(8, 60)] + ("" if rng.random() < 0.5 else "~"))
    wanted = sorted(wanted)
    hits = phrases.held(docs, spark.createDataFrame([(p,) for p in wanted], "phrase string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "NestedLoop" not in plan
    # Each phrase is sought in the whole corpus at once, then in the texts if it is there.
    whole = "\x01".join(r["text"] or "" for r in rows)
    there = [p for p in wanted if p in whole]
    assert found(hits) == sorted((r["id"], p) for p in there for r in rows if p in (r["text"] or ""))


def test_blocks_of_phrases(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"text <{i}> and <{i + 1}>") for i in range(60)], "id long, text string")
    wanted = spark.range(60).select(F.format_string("<%d>", "id").alias("phrase"))
    whole = found(phrases.held(texts, wanted))
    monkeypatch.setattr(phrases, "BLOCK_PHRASES", 10)
    assert len(phrases.blocks(wanted)) == 12 and found(phrases.held(texts, wanted)) == whole


@pytest.mark.parametrize("limit", [0, 256])
def test_rule_tables_few_and_many(spark, monkeypatch, limit):
    monkeypatch.setattr(phrases, "LITERALS", limit)
    texts = spark.createDataFrame([(1, "road works and sea"), (2, "sea"), (3, "none"), (4, None)], "id long, text string")
    listed = [(2, "sea", "b"), (1, "road", "a"), (1, "road", "a"), (3, None, "x")]
    table = spark.createDataFrame(listed, "place int, phrase string, label string")
    assert sorted(tuple(r) for r in phrases.rule_hits(texts, table, "text").select("id", "place", "phrase", "label").collect()) == [(1, 1, "road", "a"), (1, 1, "road", "a"), (1, 2, "sea", "b"), (2, 2, "sea", "b")]
    assert {r["id"]: r["label"] for r in rules.first_match(texts, F.col("text"), table, "id", "other").collect()} == {1: "a", 2: "b", 3: "other", 4: "other"}
    assert phrases.rule_hits(texts, table.limit(0), "text").count() == 0
    gates = spark.createDataFrame([("p", 1, "road", "any"), ("p", 2, "works", "any"), ("p", 0, "sea", "veto")], "profile string, group int, phrase string, kind string")
    out = {r["query"]: (r["groups"], r["vetoed"], r["supported"]) for r in fusion.intent(texts.withColumnRenamed("id", "query"), gates).collect()}
    assert out == {1: ([1, 2], 1, False), 2: ([], 1, False)}


def test_passages_without_nested_loops(spark):
    plan = retrieval.mrr_recall_at_k(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # A one-row aggregate may be joined so; texts are not.
    assert "Contains" not in plan and "contains(" not in plan


def test_many_phrases_are_sought_in_one_scan(spark, monkeypatch):
    """beyond one block the texts are still read once; what the filter lets through is checked."""
    r = random.Random(77)
    words = ["ab", "abc", "ş", "😀", "b", "ca"]
    given = [" ".join(r.choices(words, k=r.randrange(0, 30))) for _ in range(60)] + [None, "", "ab" * 2000]
    sought = sorted({" ".join(r.choices(words, k=r.randrange(1, 5)))[r.randrange(2) :] for _ in range(80)} | {"", "zz", "ab" * 70})
    texts = spark.createDataFrame(list(enumerate(given)), "id int, text string")
    wanted = spark.createDataFrame([(p,) for p in [*sought, None, "ab"]], "phrase string")
    want = sorted((i, p) for i, t in enumerate(given) if t is not None for p in sought if p in t)
    monkeypatch.setattr(phrases, "BLOCK_PHRASES", 10)
    out = phrases.held(texts, wanted)
    assert sorted((x["id"], x["phrase"]) for x in out.collect()) == want
    monkeypatch.setattr(phrases, "PIECE", 50)
    listed = sorted({p for p in sought if p})
    bits, size, lengths = phrases._filters(wanted.filter("phrase is not null").distinct(), len(sought))
    some = {x for x in phrases._scanned(given, bits, size, lengths)}
    assert {(i, p) for i, p in want if p} <= some and len(some) < 2 * len(want)
    plan = phrases.held(texts, wanted.filter("phrase <> ''"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and listed
