"""The manifest against plain Python, and over nulls, ties, repeats, hot sources, many sources, empty tables and odd names."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(hashes, fanout):
    """Root of a list and, of each place, the steps to it."""
    ways = [[] for _ in hashes]
    owners = [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        parents, above = [], []
        for at in range(0, len(hashes), fanout):
            run = hashes[at : at + fanout]
            for k in range(len(run)):
                for i in owners[at + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(h(*run))
            above.append([i for o in owners[at : at + fanout] for i in o])
        hashes, owners = parents, above
    return hashes[0], ways


def plain(rows, fanout=16):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    def lower(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    groups = {}
    for r in rows:
        leaf = h(*map(field, r))
        hurt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(((r[0] is not None, r[0] or 0), leaf, h(*map(field, (*r[:4], lower(r[4])))) if hurt else leaf, r[0]))
    tops, found = [], []
    for g in sorted(groups):
        leaves = sorted(groups[g], key=lambda x: x[:2])
        top, ways = climb([x[1] for x in leaves], fanout)
        tops.append(top)
        found.append((leaves, ways, top))
    root, above = climb(tops, fanout)
    out = []
    for (leaves, ways, top), way in zip(found, above, strict=True):
        for (_, leaf, start, key), own in zip(leaves, ways, strict=True):
            steps = [*own, *way]
            for a, b in steps:
                start = h(a, start, b)
            out.append((key, leaf, top, root, h(*[a + b for a, b in steps]), start, start == root))
    return Counter(out)


def same(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert Counter(tuple(r) for r in merkle.manifest(df, **how).collect()) == plain(rows, how.get("fanout", 16))


ODD = [(1, None, None, None, None), (2, None, "en", 0, ""), (3, "", "en", 3, "É ß"), (None, "a", "de", 1, "No Id"), (None, "a", "de", 1, "No Id"), (None, "a", None, 1, "other"), (7, "a", "x", 5, "Hello World " * 5000), (7, "a", "x", 5, "Tie"), (7, "a", "x", 5, "Tie"), (-5, "ß", "x", 5, "NEGATIVE"), (2**62, "日本", "x", 5, "😀 A")]


def test_odd_rows(spark):
    same(spark, ODD)
    same(spark, ODD, fanout=2)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257, 300])
def test_sizes_of_a_source(spark, n):
    same(spark, [(i * 7 % 1009, "one", "en", i, f"Text {i}") for i in range(n)])


def test_hot_source_many_sources_and_deep_trees(spark):
    rows = [(i, "hot" if i % 3 else f"s{i:04d}", "en", i, f"Some TEXT {i % 50}") for i in range(900)]
    same(spark, rows)
    same(spark, rows, fanout=3)
    same(spark, [(5, "a", "en", 1, "Again")] * 100)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).count() == 0
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("_group", F.lit(1)).withColumn("_hash", F.lit("x")).withColumn("leaf", F.lit("y")).withColumn("_i", F.lit(0)).withColumn("a.b", F.lit(2))
    assert Counter(tuple(r) for r in merkle.manifest(df).collect()) == plain(ODD)
    out = merkle.with_manifest(df)
    assert out.columns == ["doc_id", "source", "lang", "n_chars", "text", "_group", "_hash", "_i", "a.b", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter((r["doc_id"], r["leaf"], r["proof_sha256"]) for r in out.collect()) == Counter({(k[0], k[1], k[4]): n for k, n in plain(ODD).items()})
    assert all(r["leaf"] == h(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]))) for r in out.collect())


def test_a_changed_row_is_found_and_only_it(spark):
    rows = [(i, "ab"[i % 2], "en", i, "Capital" if i % 4 else "small") for i in range(200)]
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    wrong = {r["doc_id"] for r in out if not r["verified"]}
    assert wrong == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0 and i % 4}
