"""Words that collide under every polynomial hash modulo a power of two: Thue-Morse words and their complements."""

import random

import pytest

from quillon.llm import merge_dropout, shingles, trie_join


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


SIZES = [1024, 2048, 4096, 8192]


@pytest.mark.parametrize("n", SIZES)
def test_words_that_share_nothing(n):
    a, b = (shingles.shingle_sets([thue_morse(n, x)])[0] for x in ("ab", "ba"))
    assert a.tolist() != b.tolist()
    around = [f"one two {thue_morse(n, x)} three four five six" for x in ("ab", "ba")]
    sets = [set(s.tolist()) for s in shingles.shingle_sets(around)]
    assert len(sets[0]) == len(sets[1]) == 3 and len(sets[0] & sets[1]) == 0


def test_join_of_such_words(spark):
    rows = [(2 * k + j, thue_morse(n, x)) for k, n in enumerate(SIZES) for j, x in enumerate(("ab", "ba"))]
    out = trie_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["_id"]: r["_component"] for r in out} == {i: i for i, _ in rows}


@pytest.mark.parametrize("dropout", [0.0, 0.1])
def test_stretches_of_one_batch_keep_their_texts(dropout):
    with open(merge_dropout.DEFAULT_MODEL, "rb") as f:
        coder = merge_dropout.PieceCoder(f.read(), dropout=dropout)
    texts = [thue_morse(n, x) for n in SIZES for x in ("ab", "ba", "é日")]
    ids, ends = coder.encode_batch(texts, list(range(len(texts))))
    assert [coder.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)] == texts


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 16))) for _ in range(20_000)})
    _, hashes = shingles.word_hashes(" ".join(words).encode())
    assert len(hashes) == len(words) == len(set(hashes.tolist()))
    assert shingles.word_hashes(b" \n\t ")[1].tolist() == [] and shingles.word_hashes(b"")[1].tolist() == []
    again = shingles.word_hashes(("  x\n" + "\t".join(words)).encode())[1][1:]
    assert again.tolist() == hashes.tolist()
