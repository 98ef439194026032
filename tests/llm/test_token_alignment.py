"""Token alignment against plain Python over the two libraries, and over nulls, blank signs, long texts, ties, repeats and odd names."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import queries, token_alignment
from quillon.llm.token_alignment import FIRST_MODEL, SECOND_MODEL

from ..conftest import SF

NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def models():
    return [open(p, "rb").read() for p in (FIRST_MODEL, SECOND_MODEL)]


@pytest.fixture(scope="module")
def plain(models):
    first = Tokenizer.from_file(FIRST_MODEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND_MODEL)
    byte_of = token_alignment.byte_characters()

    def groups(text):
        if not text:
            return []
        data = (" " + text).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        bytes_a = [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            return []
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
        shared, out = set(ends[0]) & set(ends[1]), []
        i = j = 0
        for cut in sorted(shared):
            group = ([], [])
            while i < len(a) and ends[0][i] <= cut:
                group[0].append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= cut:
                group[1].append(b[j])
                j += 1
            out.append(group)
        return out

    def run(texts):
        found = [groups(t) for t in texts]
        linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in found]
        count = Counter(p for c in linked for p in c)
        best = defaultdict(int)
        for (x, _), n in count.items():
            best[x] = max(best[x], n)
        out = []
        for g, c in zip(found, linked, strict=True):
            said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
        return out

    return run


TEXTS = [None, "", " ", "word", "word", "  two  blanks ", "\n\n\ttabs\r\n", "a sign ▁ here", "<|endoftext|> and <s> and </s>", "É ß 日本語 😀 ﷽", "no\x00zero", "don't we'll I'M", "x" * 5000, "日本" * 3000, " " * 5000 + "end", "a　b c d", "!?" * 3000, "1234567890" * 500, "The the THE thE", "▁", "﻿mark", "word word " * 2000, "é combined ‍ joiner"]


def test_odd_texts(spark, models, plain):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, _key string, n_best int").repartition(3).withColumn("a.b", F.lit(1))
    expected = plain(TEXTS)
    for hot in (token_alignment.HOT, 5):
        out = token_alignment.token_links(df, *models, hot=hot)
        assert out.columns == ["doc_id", "_key", "a.b", *NAMES]
        rows = out.collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            assert tuple(r[n] for n in NAMES) == expected[r["doc_id"]], TEXTS[r["doc_id"]]


def test_query_on_whole_documents(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = {d["doc_id"]: e for d, e in zip(docs, plain([d["text"] for d in docs]), strict=True)}
    rows = queries.queries()["op11_token_alignment"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r[n] for n in NAMES) for r in rows} == expected and len(rows) == len(docs)


def test_blocks_of_links_and_vast_groups(models, monkeypatch):
    aligner = token_alignment.Aligner(*models)
    texts = [t for t in TEXTS if t]
    whole = aligner.align(texts)
    monkeypatch.setattr(token_alignment, "LINKS", 3)
    cut = aligner.align(texts)
    for c in ("pairs", "times", "at", "n_links"):
        assert whole[c].tolist() == cut[c].tolist()


def test_shared_cuts_of_many_bytes():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 500))
        a, b = (np.append(np.flatnonzero(rng.random(n - 1) < 0.4) + 1, n) for _ in range(2))
        cuts, upto_a, upto_b = token_alignment.shared_cuts(a, b, n)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert (cuts + 1).tolist() == both
        assert upto_a.tolist() == [int((a <= c).sum()) for c in both] and upto_b.tolist() == [int((b <= c).sum()) for c in both]


def test_empty_table(spark, models):
    assert token_alignment.token_links(spark.createDataFrame([], "doc_id long, text string"), *models).count() == 0
