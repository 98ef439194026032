"""Each operator against plain versions, and over nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import fair_mix, gif_media, merge_dropout, pii_boost, ppm_langid, quality_rules, secret_scan, shingles, toxicity, trie_join, url_filter

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "word", "a"), (4, "word", "a"), (None, "null id here", "b"), (5, "long " * 30_000, "a"), (6, "É ß 日本 😀", ""), (7, "a b c d e f", "b"), (8, "a b c d e f", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# Quality rules


def plain_measures(text):
    words = WORD.findall(text or "")
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(3))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd, docs):
    for df in (odd, docs):
        rows = quality_rules.quality(df.withColumn("n_words", F.lit(1)).withColumn("kept", F.lit(1)), carry=["text"]).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(r["text"])
            assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_good_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.quality(docs).filter("not base_failed").join(labels, "doc_id").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)


def test_quality_of_nothing(empty):
    assert quality_rules.quality(empty).count() == 0


# URL filters


def plain_verdict(url):
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", "", None, "allow"
    host = re.split(r"[/?#]", rest[1])[0].translate({i: i + 32 for i in range(65, 91)})
    tail = rest[1][len(host) :]
    path = re.split(r"[?#]", tail)[0]
    best = None
    for rule, says in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    if best:
        return host, path, *best
    seen = host + path + tail[len(path) :].translate({i: i + 32 for i in range(65, 91)}) + "#"
    return host, path, None, "block" if any(re.search(r.pattern, seen) for r in url_filter.PATTERN_RULES) else "allow"


URLS = [None, "", "no scheme", "http://", "https://COM/", "http://com", "http://a.example.com/en/x", "http://www.example.com/en/x?y#z", "http://wexample.com/en/", "http://x.net/es/", "http://x.net/es", "http://x.net/fr/?a", "http://x.org/login", "http://x.org/loginx", "http://x.org/a?SID=5", "http://x.org/tag/q", "http://x.org/A.JPG", "http://x.org/?q=http://a.net/fr/", "http://x.org/p?utm_source=ads", "http://x.org/\nlogin", "http://foo?.com/", "http://foo#x.net/fr/", "http://shop?u=www.example.com/en/", "http://foo?/com/", "http://a.net", "http://b.net#/es/", "http://x.org/" + "a/" * 50_000 + "login", "http://x.org/q/" + "z" * 100_000, "http://x.org/tags/#", "http://x.org/tag//x", "http://x.org/wp-login.php", "http://x.org/a.jpeg", "http://x.org/?a;jsessionid=1", "http://x.org/cart\n", "http://com./en/", "://net/es/", "http://K.com/en/login", "http://x.org/checkout?x", "http://.net/fr/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + URLS[:9])], "page_id long, url string, _host string")
    rows = url_filter.filter_urls(pages).collect()
    assert len(rows) == len(URLS) + 9
    for r in rows:
        assert (r["_host"], r["_path"], r["_rule"], r["_verdict"]) == plain_verdict(r["url"]), r["url"]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert {r["_verdict"] for r in url_filter.filter_urls(pages, rules=[]).collect()} == {"allow"}


def test_rule_tokens():
    tokens = lambda p: [set(x) for x in url_filter.mandatory_tokens(url_filter.UrlRule("", "block", p))]
    site = lambda r: [set(x) for x in url_filter.mandatory_tokens(url_filter.site_rule("block", r))]
    assert site("net/es/") == [{"net", "es"}] and site("net/es") == [{"net"}]
    assert tokens(r"/search[/?]") == [{"search"}] and tokens(r"/tags?/") == [{"tag"}, {"tags"}]
    assert tokens(r"/(?:a|b)x?[c-e]") == [set()] and tokens(r"/x\d+/") == [set()] and tokens("^abc/") == [{"abc"}]
    assert tokens(r"[?&]utm_source=(?:ad|ads)") == [{"utm", "source"}]
    # No rule of the library runs everywhere.
    assert all(some for r in url_filter.SITE_RULES + url_filter.PATTERN_RULES for some in url_filter.mandatory_tokens(r))


def test_many_rules_are_found_by_their_tokens(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    want = sorted(map(tuple, url_filter.filter_urls(pages).collect()), key=str)
    monkeypatch.setattr(url_filter, "LITERAL_RULES", 0)
    assert sorted(map(tuple, url_filter.filter_urls(pages).collect()), key=str) == want


def test_url_sql_matches_odd_urls(spark):
    from quillon.llm import oracle

    from ..compare import connection

    con = connection(SF)
    con.register("odd_pages", spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").toArrow())
    rows = con.sql(oracle.op2().replace("FROM pages", "FROM odd_pages")).fetchall()
    assert len(rows) == len(URLS)
    for i, host, path, rule, verdict in rows:
        assert (host, path, rule, verdict) == plain_verdict(URLS[i]), URLS[i][:80]


# GIF media


def test_gif_payloads_round_trip(odd, docs):
    for df in (odd, docs):
        rows = gif_media.read_gifs(gif_media.write_gifs(df.withColumn("_media", F.lit(1)))).collect()
        for r in rows:
            raw = (r["text"] or "").encode()
            size = max(64, -(-len(raw) // 64) * 64)
            assert bytes(r["_payload"]) == raw + b"\0" * (size - len(raw))
            assert sum(sum(f["histogram"][:8]) for f in r["_frames"]) >= size
    assert gif_media.write_gifs(df.limit(0)).count() == 0


def gif(width, height, palette, *blocks):
    bits = (len(palette) // 3 - 1).bit_length() - 1
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | bits, 0, 0) + palette + b"".join(blocks) + b";"


def image(x, y, w, h, pixels, control=None, flags=0, least=2):
    """A frame of literal codes, cleared before each so that widths never grow."""
    codes = [c for p in pixels for c in (1 << least, p)] + [(1 << least) + 1]
    bits = sum(c << (i * (least + 1)) for i, c in enumerate(codes))
    raw = bits.to_bytes(-(-len(codes) * (least + 1) // 8), "little")
    head = b"" if control is None else struct.pack("<BBBBHBB", 0x21, 0xF9, 4, *control, 0)
    return head + struct.pack("<BHHHHB", 0x2C, x, y, w, h, flags) + bytes([least, len(raw)]) + raw + b"\0"


PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])


def test_gif_disposal_and_transparency():
    full = image(0, 0, 2, 2, [1, 1, 1, 1], control=(1 << 2, 5, 0))
    spot = lambda disposal: image(0, 0, 1, 1, [2], control=(disposal << 2, 7, 0))
    see_through = image(0, 0, 2, 1, [3, 2], control=(1 << 2 | 1, 1, 3))
    for disposal, corner in ((1, [0, 255, 0, 255]), (2, [0, 0, 0, 0]), (3, [255, 0, 0, 255])):
        frames = gif_media.decode_gif(gif(2, 2, PALETTE, full, spot(disposal), see_through))
        assert frames[1].canvas[0, 0].tolist() == [0, 255, 0, 255]
        assert frames[2].canvas[0, 0].tolist() == corner
        assert frames[2].canvas[0, 1].tolist() == [0, 255, 0, 255]
        assert [f.start_ms for f in frames] == [0, 50, 120]


def test_gif_interlace_and_local_palette():
    rows = [0, 1, 2, 3, 0, 1, 2, 3]
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    data = gif(1, 8, PALETTE, image(0, 0, 1, 8, [rows[y] for y in order], flags=0x40))
    assert list(gif_media.decode_gif(data)[0].indices) == rows
    local = image(0, 0, 1, 1, [1], flags=0x81)
    at = local.index(b"\x02", 10)
    data = gif(1, 1, PALETTE, local[:at] + bytes([9] * 12) + local[at:])
    assert gif_media.decode_gif(data)[0].canvas[0, 0].tolist() == [9, 9, 9, 255]


def plain_lzw(stream, least):
    """The textbook decoder, a code at a time."""
    clear, out, bits, n, at = 1 << least, [], 0, 0, 0
    table, width, before = {}, least + 1, None
    while True:
        while n < width:
            bits, n, at = bits | stream[at] << n, n + 8, at + 1
        code, bits, n = bits & ((1 << width) - 1), bits >> width, n - width
        if code == clear:
            table, width, before = {i: bytes([i]) for i in range(clear)}, least + 1, None
            free = clear + 2
            continue
        if code == clear + 1:
            return b"".join(out)
        entry = table[code] if code in table else before + before[:1]
        out.append(entry)
        if before is not None and free < 4096:
            table[free] = before + entry[:1]
            free += 1
            if free == 1 << width and width < 12:
                width += 1
        before = entry


def plain_grey_gif(data):
    """Pixels of a full-width grey animation, its frames, time and grey levels as shown."""
    width, height = struct.unpack("<HH", data[6:10])
    at, canvas, pixels, frames, ms, levels = 13 + 768, [None] * height, b"", 0, 0, [0] * 8
    while data[at] != 0x3B:
        assert data[at : at + 2] == b"\x21\xf9" and data[at + 8] == 0x2C
        ms += struct.unpack("<H", data[at + 4 : at + 6])[0] * 10
        left, top, w, h = struct.unpack("<HHHH", data[at + 9 : at + 17])
        least, at, stream = data[at + 18], at + 19, b""
        while data[at]:
            stream, at = stream + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        at += 1
        own = plain_lzw(stream, least)
        assert (left, top, w, len(own)) == (0, 0, width, w * h)
        for y in range(h):
            canvas[y] = own[y * w : (y + 1) * w]
        for row in canvas:
            for v in row or b"":
                levels[v // 32] += 1
        pixels, frames = pixels + own, frames + 1
    return pixels, f"frames={frames};ms={ms};levels={','.join(map(str, levels))}"


def test_gif_query_matches_a_plain_decoder(spark):
    from quillon.llm import queries as Q

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.length("text")).collect()
    texts = {r["doc_id"]: r["text"] for r in docs}
    for r in Q.queries()["op3_gif_media"](spark, SF).collect():
        media = gif_media.encode_gif(gif_media.payload_of(texts[r["doc_id"]]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        pixels, feature = plain_grey_gif(media)
        assert pixels == gif_media.payload_of(texts[r["doc_id"]]) and r["feature"] == feature


def test_gif_lzw_fuzz():
    r = random.Random(1)
    for n in (1, 63, 4000, 70_000):
        for k in (2, 200):
            data = bytes(r.randrange(k) for _ in range(n))
            assert gif_media.lzw_decode(gif_media.lzw_encode(data), 8, n) == data
    assert gif_media.lzw_decode(gif_media.lzw_encode(b"abc")[:2], 8, 3) in (b"", b"a")


def test_malformed_gifs_are_null(spark):
    wild = image(0, 0, 1, 1, [1])
    unknown = wild[:12] + bytes([0b00_111_100]) + wild[13:]
    huge = [gif(65535, 65535, PALETTE, wild), gif(1, 1, PALETTE, image(0, 0, 65535, 65535, [1])), gif(1, 1, PALETTE, unknown), gif(1, 1, PALETTE, image(0, 0, 1, 1, [1], least=2)[:10] + b"\x0c\x01\0\0")]
    df = spark.createDataFrame([(b"nothing",), (None,), (b"GIF89a",), *((h,) for h in huge)], "m binary")
    assert [r["_payload"] for r in gif_media.read_gifs(df, "m").collect()] == [None] * 7
    # Of many frames on a large canvas one is held at a time.
    many = gif(1000, 1000, PALETTE, *[image(0, 0, 1, 1, [k % 4]) for k in range(40)])
    row = gif_media.read_gifs(spark.createDataFrame([(many,)], "m binary"), "m").first()
    assert len(row["_frames"]) == 40 and len(row["_payload"]) == 40
    with pytest.raises(ValueError, match="unknown code"):
        gif_media.lzw_decode(struct.pack("<Q", 256 | 65 << 9 | 300 << 18), 8, 10)


# Mixing


def plain_targets(sizes, weights=(3, 1, 2), percent=150):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()) * percent / 100, set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * w[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_targets_and_shares(docs, odd):
    for df in (docs, odd):
        rows = fair_mix.fair_mix(df.withColumn("_size", F.lit("x"))).collect()
        assert len(rows) == df.count()
        sizes, taken = {}, {}
        for r in rows:
            assert r["_size"] == len(WORD.findall(r["text"] or "")) and r["_copies"] in (0, 1, 2)
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["_size"]
            taken[r["source"]] = taken.get(r["source"], 0) + r["_size"] * r["_copies"]
        want = plain_targets(sizes)
        largest = {s: max(r["_size"] for r in rows if r["source"] == s) for s in sizes}
        for r in rows:
            assert r["_target"] == pytest.approx(want[r["source"]]) and r["_source_size"] == sizes[r["source"]]
            # Repeated rows share their fate, hence twice the largest.
            assert abs(taken[r["source"]] - want[r["source"]]) <= 2 * largest[r["source"]]
        assert sum(taken.values()) <= 1.5 * sum(sizes.values()) + max(largest.values())


def test_mix_follows_the_queue(docs):
    """Against the whole order, built in one place."""
    rows = fair_mix.fair_mix(docs).withColumn("_k", F.xxhash64(F.lit(7), "doc_id", "text")).collect()
    ranks = {s: i for i, s in enumerate(sorted({r["source"] for r in rows}))}
    buckets, entries = fair_mix.LEAST_BUCKETS, []
    for s in ranks:
        through, queue = 0, sorted((r for r in rows if r["source"] == s and r["_size"]), key=lambda r: (r["_k"] % buckets, r["_k"], r["doc_id"]))
        for epoch in (0, 1):
            for r in queue:
                through += r["_size"]
                entries.append((through / r["_target"], ranks[s], r["doc_id"], r["_size"]))
    budget, total, want = sum(r["_size"] for r in rows) * 1.5, 0, {}
    for _, _, i, size in sorted(entries):
        total += size
        if total > budget:
            break
        want[i] = want.get(i, 0) + 1
    assert {r["doc_id"]: r["_copies"] for r in rows if r["_copies"]} == want


def test_mix_of_one_hot_or_null_id(spark):
    rows = [(None, "w " * (k % 7 + 1) + str(k), "a") for k in range(300)] + [(5, f"x y {k}", "a") for k in range(300)] + [(k, f"z {k}", "b") for k in range(50)]
    out = fair_mix.fair_mix(table(spark, rows)).collect()
    for s in "ab":
        taken = sum(r["_size"] * r["_copies"] for r in out if r["source"] == s)
        assert abs(taken - next(r["_target"] for r in out if r["source"] == s)) <= 20


def test_mix_reruns_agree_and_handle_nothing(docs, empty):
    once, again = ({(r["doc_id"], r["_copies"]) for r in fair_mix.fair_mix(docs.repartition(n)).collect()} for n in (1, 7))
    assert once == again
    assert fair_mix.fair_mix(empty).count() == 0 and fair_mix.mixed_rows(empty).count() == 0
    assert fair_mix.mixed_rows(docs).columns == docs.columns


# SentencePiece


@pytest.fixture(scope="module")
def model():
    with open(merge_dropout.DEFAULT_MODEL, "rb") as f:
        return f.read()


STRINGS = ["", " ", "a  b", "  x", "tab\there\n\nnew", "日本語 テスト", "x▁y ▁", "é́", "end ", "a\r\nb", "😀 ok", "x" * 100 + " " * 50 + "y", "\U0010fffe \n \n", "\x00\x01"]


def test_pieces_without_dropout_are_the_library_s(model, docs):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=merge_dropout.DEFAULT_MODEL)
    coder = merge_dropout.PieceCoder(model, dropout=0.0)
    for t in [r["text"] for r in docs.limit(80).collect()] + [s for s in STRINGS if "▁" not in s]:
        assert coder.encode(t) == library.encode(t), t[:50]


def test_pieces_decode_losslessly(model, odd, docs):
    coder = merge_dropout.PieceCoder(model, dropout=0.3, seed=5)
    for k in range(10):
        for s in STRINGS:
            assert coder.decode(coder.encode(s, k)) == s
    for df in (odd, docs, odd.limit(0)):
        rows = merge_dropout.decode_pieces(merge_dropout.encode_pieces(df.withColumn("_ids", F.lit(1)), model), model).collect()
        assert len(rows) == df.count() and all(r["_decoded"] == r["text"] for r in rows)


def test_pieces_by_arrays_are_those_of_the_agenda(model):
    coder = merge_dropout.PieceCoder(model, dropout=0.2, seed=3)
    r = random.Random(2)
    words = ["".join(r.choices("thenrsoi éü,▁", k=r.randrange(1, 14))) for _ in range(400)]
    for variant in (0, 3):
        for w in words:
            points = np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32)[None, :]
            assert coder._together(points, np.asarray([variant]))[0].tolist() == coder.encode_stretch(w, variant), w


def test_pieces_vary_by_seed_place_and_rate(model):
    text = "international organisation " * 40
    cuts = {tuple(merge_dropout.PieceCoder(model, 0.2, seed).encode(text, key)) for seed in (1, 2) for key in (1, 2)}
    assert len(cuts) == 4
    sizes = [len(merge_dropout.PieceCoder(model, rate, 1).encode(text)) for rate in (0.0, 0.1, 0.5, 1.0)]
    assert sizes == sorted(sizes) and sizes[-1] == len(text) + 1


def test_every_occurrence_draws_its_own_merges(spark, model):
    coder = merge_dropout.PieceCoder(model, dropout=0.1, seed=1)
    for word, least in ((" the", 5), (" organisation", 20), (" https://example.org/a/b", 50), (" " + "internationalorganisation" * 4, 100)):
        one = coder.encode(word.strip(), 0)
        cuts = [tuple(coder.encode(word.strip(), k)) for k in range(2000)]
        assert len(set(cuts)) >= least and coder.decode(one) == word.strip()
        # Within one text as well as across texts.
        out, _ = coder.encode_batch([word * 2000], [7])
        assert len(out) != 2000 * len(one) and coder.decode(out.tolist()) == word * 2000
    # What is shared is what each occurrence would give by itself.
    texts = ["international organisation of the the the strings and the " * 9, "the the of the " * 50]
    out, ends = coder.encode_batch(texts, [3, -4])
    for t, (key, a, b) in zip(texts, [(3, ends[0], ends[1]), (-4, ends[1], ends[2])], strict=True):
        assert coder.encode(t, key) == out[a:b].tolist()
        alone, place = [], 0
        for w in re.findall(" +[^ ]*", " " + t):
            draw = merge_dropout._mix(merge_dropout._mix(np.asarray([key % 2**64], dtype=np.uint64) + np.uint64(1)) + np.uint64(place))[0]
            alone, place = alone + coder.encode_stretch(w, int(draw)), place + 1
        assert alone == out[a:b].tolist()
    # Keys that are no numbers, and null ones, name their texts too.
    for ids in ([f"a{k}" for k in range(200)], [None] * 200):
        rows = [(i, f"international organisation {k % 100}") for k, i in enumerate(ids)]
        found = merge_dropout.encode_pieces(spark.createDataFrame(rows, "doc_id string, text string"), model).collect()
        assert len({tuple(r["_ids"][:4]) for r in found}) > 4


# Secrets


def plain_secrets(text):
    spans = []
    for r, rule in enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES):
        pattern = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}.get(rule.kind, rule.pattern)
        spans += [(m.start(), r, m.end(), rule.kind) for m in re.finditer(pattern, text or "") if len(m[rule.group]) >= rule.least]
    return sorted(spans)


SECRETS = ["password=hunter22", "PassWD : 'abcdefg' and token=token: abcdefgh", "secret=ab secret=abcdef", "api_key=\"A/b+c=d.e-f_\" apikey:123456", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 9, "x" + "0123456789abcdef" * 3, "é😀 token=abcdef1 ghp_" + "a" * 36, "eyJabcdefghij.eyJabcdefghij.abcdefgh", "ftp://user:pa55@host -----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abc AIza" + "b" * 35 + " sk_live_" + "c" * 20]


def test_secret_spans(spark, odd, docs):
    own = table(spark, [(i, s, "a") for i, s in enumerate(SECRETS + [" ".join(SECRETS)] * 2)])
    for df in (own, odd, docs):
        rows = secret_scan.scan_secrets(df.withColumn("_text", F.lit(1)).withColumn("_key", F.lit(1))).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert [tuple(x) for x in r["_spans"]] == plain_secrets(r["text"]), r["text"]
    assert secret_scan.scan_secrets(own.limit(0)).count() == 0


def test_trigram_queries_are_necessary():
    assert secret_scan.trigram_query(r"[0-9a-f]{24,}") == []
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    for rule in secret_scan.BASE_RULES + secret_scan.MORE_RULES:
        asked = secret_scan.trigram_query(rule.pattern)
        for s in SECRETS:
            for m in re.finditer(rule.pattern, s):
                assert not asked or any(all(t in m[0].lower() for t in a) for a in asked)


# Toxicity


def test_restores_hidden_words():
    chars = toxicity.char_model([("idiot", 30), ("moron", 30), ("trash", 30), ("stupid", 30), ("the", 60), ("letter", 20)])
    for hidden, clear in (("1d10t", "idiot"), ("m0r0n", "moron"), ("tr@$h", "trash"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("stuuuupid", "stupid")):
        assert toxicity.restore(chars, hidden) == clear


def test_spelling_is_learned_from_all_texts(spark, monkeypatch):
    # No labelled text holds the word; what is restored depends on all documents.
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 5)
    known = [(k, "a plain text about the weather") for k in range(40)]
    rows = known + [(k, "Ein Schwachkopf, (schwachkopf) redet.") for k in range(100, 140)] + [(None, "schwachkopf"), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels)
    assert toxicity.restore(scorer.chars, "5chw4chk0pf") == "schwachkopf"
    plain = toxicity.char_model([("a", 40), ("plain", 40), ("text", 40), ("about", 40), ("the", 40), ("weather", 40), ("ein", 40), ("schwachkopf", 81), ("redet", 40)])
    whole = toxicity.corpus_chars(docs)
    # A text that holds a word with and without marks counts it for each form.
    assert whole.three.keys() == plain.three.keys() and len(whole.three) > 30


def test_hidden_words_pass_the_gate_with_marks_around():
    chars = toxicity.char_model([("idiot", 30), ("stupid", 30), ("ass", 30), ("the", 60), ("you", 60)])
    r = toxicity.Restorer(chars)
    words = lambda text: {w for token in r.tokens(text) for w in r.clear(token)}
    for hidden, clear in (("idio7", "idiot"), ("s.t.u.p.i.d", "stupid"), ("a$$", "ass"), ("a55", "ass"), ("1diot", "idiot"), ("i d i o t", "idiot"), ("a s s", "ass")):
        for before, after in (("", ""), ("", "."), ("", ","), ("", "!"), ("(", ")"), ('"', '"'), ('"', '."'), ("...", "?!")):
            assert clear in words(f"you {before}{hidden}{after} the you"), before + hidden + after
            assert clear in words(before + hidden + after), before + hidden + after
    assert "idiot" in words("you !diot.") and "ass" in words("@s$!")
    assert words("you, (the) you!") == {"you", "the"}


def plain_best(model, noisy):
    """All paths of a small lattice."""
    paths = [("", 0.0)]
    for options in toxicity.lattice(noisy):
        paths = [(s + c, p + q + (model.log(("  " + s)[-2:], c) if c else 0)) for s, p in paths for c, q in options]
    return max(p + model.log(("  " + s)[-2:], " ") for s, p in paths)


def test_viterbi_finds_the_best_path():
    chars = toxicity.char_model([("idiot", 30), ("till", 9), ("lit", 20)])
    for noisy in ("1d10t", "ll1t", "t.1.l"):
        clear = toxicity.restore(chars, noisy)
        scores = {}
        for s, p in _paths(chars, noisy):
            scores[s] = max(p, scores.get(s, -1e9))
        assert scores[clear] == pytest.approx(plain_best(chars, noisy))


def _paths(model, noisy):
    paths = [("", 0.0)]
    for options in toxicity.lattice(noisy):
        paths = [(s + c, p + q + (model.log(("  " + s)[-2:], c) if c else 0)) for s, p in paths for c, q in options]
    return [(s, p + model.log(("  " + s)[-2:], " ")) for s, p in paths]


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scorer = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.withColumn("_toxicity", F.lit("x")), scorer).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(0 <= r["_toxicity"] <= 1 for r in rows)
    hit = [r for r in held if r["toxic"] and r["_toxicity"] >= toxicity.THRESHOLD]
    assert len(hit) >= 0.6 * sum(r["toxic"] for r in held)
    assert sum(1 for r in held if not r["toxic"] and r["_toxicity"] >= toxicity.THRESHOLD) <= 0.02 * len(held)


def plain_toxicity(scorer, text):
    """The score of one text, without memories: all words of all tokens, their beginnings, and the sum of weights."""
    restorer, names = toxicity.Restorer(scorer.chars), set()
    for token in restorer.tokens(text or ""):
        for w in toxicity.Restorer(scorer.chars).clear(token):
            names |= {w} | {w[:k] + "+" for k in (4, 5, 6) if len(w) > k}
    z = scorer.bias + sum(scorer.weights.get(x, 0.0) for x in names)
    return 1 / (1 + np.exp(-z))


def test_toxicity_query_matches_plain_scores(spark):
    from quillon.llm import queries as Q

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scorer = toxicity.fit(docs, labels)
    # The sample: labelled documents that are not held out, here fewer than the bound.
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    again = toxicity.train(toxicity.corpus_chars(docs), [text[i] for i in known], list(known.values()))
    assert again.weights.keys() == scorer.weights.keys() and all(abs(again.weights[k] - scorer.weights[k]) < 1e-6 for k in again.weights)
    rows = Q.queries()["op7_toxicity"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r["score"] == pytest.approx(plain_toxicity(scorer, text[r["doc_id"]])) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_toxicity_of_repeated_ids_is_the_same_in_every_run(spark):
    rows = [(1, "you idiot"), (1, "a friend"), (2, "the plain text"), (3, None), (4, "z" * 200_000)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    one, two = (toxicity.fit(spark.createDataFrame(rows[::k], "doc_id long, text string").repartition(3), labels, sample_docs=5) for k in (1, -1))
    assert one == two


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (7, 1, 0), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(odd, labels)
    assert toxicity.score(odd, scorer).count() == odd.count()
    assert toxicity.fit(empty, labels) is None
    assert toxicity.score(empty, None).count() == 0
    assert {r["_toxicity"] for r in toxicity.score(odd, None).collect()} == {0.0}


# N-gram Jaccard join


def plain_set(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if a and 100 * inter >= 80 * (len(a) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return [(i, len(sets[k]), min((x for x in groups[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def noisy_corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = r.choices(vocabulary, k=60)
    rows = []
    for base in range(25):
        words = r.choices(vocabulary, k=r.choice([3, 6, 30, 80, 150]))
        if base % 3 == 0:
            words += passage
        for _ in range(r.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.3:
                copy = copy[: -r.randrange(1, max(2, len(copy) // 6))] or copy
            rows.append((len(rows) * 3 % 1009, r.choice([" ", "\n"]).join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_join_matches_brute_force(spark, seed):
    rows = noisy_corpus(seed)
    got = trie_join.near_duplicates(table(spark, [(i, t, "a") for i, t in rows]).repartition(5)).collect()
    assert sorted((r["_id"], r["_n"], r["_component"]) for r in got) == sorted(plain_components(rows))


def test_join_in_blocks_matches(spark, monkeypatch):
    monkeypatch.setattr(trie_join, "BLOCK_SHINGLES", 60)
    monkeypatch.setattr(trie_join, "FEW", 3)
    rows = noisy_corpus(9)
    got = trie_join.near_duplicates(table(spark, [(i, t, "a") for i, t in rows])).collect()
    assert sorted((r["_id"], r["_n"], r["_component"]) for r in got) == sorted(plain_components(rows))


def test_join_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = trie_join.near_duplicates(odd.withColumn("_id", F.lit("x"))).collect()
    assert sorted(((r["_id"], r["_n"], r["_component"]) for r in got), key=str) == sorted(plain_components(rows), key=str)
    assert trie_join.near_duplicates(empty).count() == 0


def test_prefix_tree_matches_pairs():
    r = np.random.Generator(np.random.PCG64(4))
    for _ in range(30):
        base = [r.choice(300, size=r.integers(5, 60), replace=False) for _ in range(5)]
        sets = []
        for b in base:
            for _ in range(4):
                keep = b[r.random(len(b)) > 0.08]
                sets.append(np.unique(np.concatenate([keep, r.choice(300, size=r.integers(0, 3))])).astype(np.uint64))
        got = trie_join.link_sets(sets)
        root = list(range(len(sets)))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    k = len(np.intersect1d(a, b))
                    if 5 * k >= 4 * (len(a) + len(b) - k):
                        root[i] = root[j] = min(root[i], root[j])
        assert len({(x, y) for x, y in zip(got, root, strict=True)}) == len(set(got)) == len(set(root))


def test_bounds_are_those_of_the_threshold():
    for a in range(1, 60):
        for b in range(1, 60):
            least = next((k for k in range(min(a, b) + 1) if 5 * k >= 4 * (a + b - k)), None)
            if least is not None:
                assert trie_join.least_overlap(a, b) == least
                assert int(trie_join.least_shared(a, b)) >= 1


def test_shingles_in_pieces(monkeypatch):
    texts = [" ".join(random.Random(k).choices(["Ab", "c", "déf", "x" * 50], k=400)) for k in range(6)] + ["", None, "one", "y" * 300]
    whole = shingles.shingle_sets(texts)
    monkeypatch.setattr(shingles, "PIECE", 100)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_sets(texts), strict=True))
    assert [len(s) for s in whole] == [len(plain_set(t)) for t in texts]


# Language


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = ppm_langid.identify(docs.withColumn("_lang_pred", F.lit(1)), ppm_langid.fit(docs)).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["_lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_language_of_odd_rows(spark, odd, empty):
    model = ppm_langid.train({"en": ["the house is here"], "de": ["das haus ist hier"]})
    said = {(r["doc_id"], r["text"]): (r["_lang_pred"], r["_lang_score"]) for r in ppm_langid.identify(odd, model).collect()}
    assert said[1, None] == said[2, ""] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in said.values())
    assert ppm_langid.fit(empty) is None and ppm_langid.fit(odd) is None
    assert {r["_lang_pred"] for r in ppm_langid.identify(odd, None).collect()} == {"und"}


def plain_chances(counts, context):
    """A byte's chances by plain PPM: escapes to the next shorter context, without the bytes already seen."""
    if context is None:
        return np.full(256, 1 / 256)
    shorter = plain_chances(counts, context[1:] if context else None)
    if context not in counts:
        return shorter
    n = np.zeros(256)
    for b, k in counts[context].items():
        n[b] = k
    seen, rest = n > 0, shorter[n == 0].sum()
    if rest <= 1e-12:
        return n / n.sum()
    return np.where(seen, n, seen.sum() * shorter / rest) / (n.sum() + seen.sum())


def plain_bits(texts, text):
    pad, counts = b" " * ppm_langid.DEPTH, {}
    data = b"".join(pad + t.lower().encode() for t in texts) + pad
    for i in range(len(pad), len(data)):
        for k in range(len(pad) + 1):
            counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    data = pad + text
    return sum(-np.log2(plain_chances(counts, data[i - len(pad) : i])[data[i]]) for i in range(len(pad), len(data)))


def test_code_lengths_are_those_of_plain_ppm(monkeypatch):
    own = {"en": ["the cat sat on the mat, the then", "there was a hat"], "fr": ["le chat est sur le tapis été", "là bas"], "xx": ["ωωψ the", bytes(range(256)).decode("latin-1")]}
    model = ppm_langid.train(own)
    texts = [t.encode() for t in ("the chat é", "zzzq", "ω the ωψ", " ", "x" * 50, "été the cat\n", "日本", "the cat " * 30)]
    want = [[plain_bits(own[la], t) for la in model.languages] for t in texts]
    assert np.allclose(ppm_langid.code_lengths(model, texts), want)
    monkeypatch.setattr(ppm_langid, "CHUNK", 16)
    assert np.allclose(ppm_langid.code_lengths(model, texts), want)


def test_language_sample_is_bounded_and_exact(spark):
    rows = [(k, f"text number {k}", "en") for k in range(2000)] + [(8, f"other {k}", "en") for k in range(5000)] + [(9, "same", "en")] * 3000 + [(None, f"null {k}", "en") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    for n in (1, 5):
        kept = {}
        original = ppm_langid.train
        try:
            ppm_langid.train = lambda texts: kept.update(texts)
            ppm_langid.fit(docs.repartition(n), sample_docs=400)
        finally:
            ppm_langid.train = original
        seen.append(kept)
    assert seen[0] == seen[1] and len(seen[0]["en"]) == 400 == len(set(seen[0]["en"]))
    assert {x.split()[0] for x in seen[0]["en"]} >= {"text", "other", "null"}


# Personal data


def plain_private(text):
    out = []
    for rank, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii_boost.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_match_plain_search(docs, odd):
    r = random.Random(3)
    texts = ["".join(r.choices("ab.@%-+ 1234(é", k=r.randrange(1, 40))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "+1 (988) 555-2485", "1.2.3.4.5 256.1.1.1 0001.2.3.4", "a@b.c%d@e.f"] + [x["text"] for x in docs.collect() + odd.collect()]
    for t in texts:
        assert [(c.start, pii_boost.KINDS.index(c.kind), c.end, c.kind) for c in pii_boost.base_spans(t or "")] == plain_private(t), t


def test_found_spans_keep_the_base(docs, odd):
    for df in (docs, odd, odd.limit(0)):
        rows = pii_boost.find_private(df.withColumn("_spans", F.lit(1))).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert [(x["start"], x["rank"], x["end"], x["kind"]) for x in r["_spans"] if x["rank"] < 4] == plain_private(r["text"])
            assert (r["_redacted"] is None) == (r["text"] is None)
            if not r["_spans"]:
                assert r["_redacted"] == r["text"]


def test_hardware_addresses_need_no_two_digits():
    model = pii_boost.train()
    for s in ("de:ad:be:ef:ca:fe", "a1:b2:c3:d4:e5:f6", "DE-AD-BE-EF-CA-FE", "00:1a:2b:3c:4d:5e"):
        text = f"the mac {s} is mine"
        assert pii_boost.Candidate(8, 8 + len(s), "hardware") in pii_boost.loose_candidates(text)
        assert s not in pii_boost.redact(text, pii_boost.find(model, text))


def test_boosted_trees_tell_private_from_like():
    model = pii_boost.train()
    x, y = pii_boost.examples(1000, seed=77)
    picked = model.picked(x)
    assert (picked == (y == 1)).mean() > 0.95
    found = {k: [c.kind for c in pii_boost.find(model, k)] for k in ("call 415-555-0199 today", "order 123-456-7890 x", "mail me john [at] corp [dot] com", "he sat at home", "my ssn 123-45-6789")}
    assert list(found.values()) == [["local_phone"], [], ["hidden_email"], [], ["identity"]]


def plain_found(model, text):
    """Base spans and the trees' verdicts, candidate by candidate, tree by tree."""

    def leaf(tree, x):
        node = 0
        while node < len(tree.feature):
            node = 2 * node + (2 if x[tree.feature[node]] > tree.cut[node] else 1)
        return tree.leaf[node - len(tree.feature)]

    kept = [pii_boost.Candidate(s, e, k) for s, _, e, k in plain_private(text)]
    scored = []
    for c in pii_boost.loose_candidates(text or ""):
        x = pii_boost.features(text, c)
        z = model.bias + sum(leaf(t, x) for t in model.trees)
        scored.append((-z, c, 1 / (1 + np.exp(-z)) >= model.thresholds[pii_boost.MORE_KINDS.index(c.kind)]))
    for _, c, fine in sorted(scored):
        if fine and not any(c.start < k.end and k.start < c.end for k in kept):
            kept.append(c)
    return sorted((c.start, pii_boost.KINDS.index(c.kind), c.end) for c in kept)


PRIVATE = ["call 415-555-0199 or mail bob [at] corp [dot] com, ssn 123-45-6789", "iban DE89 3704 0044 0532 0130 00 and mac de:ad:be:ef:ca:fe born 03.04.1985", "x" * 90 + " [at] mail.example.com", "+1 (415) 555-0199 a@b.co 10.0.0.1 4111 1111 1111 1111"]


def test_private_query_matches_plain_trees(spark):
    from quillon.llm import queries as Q

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = table(spark, [(i, t, "a") for i, t in enumerate(PRIVATE * 2)])
    model = pii_boost.fit(docs)
    assert model is pii_boost.fit(docs.repartition(5))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in Q.queries()["op10_pii_boost"](spark, SF).collect():
        assert r["spans"] == ",".join(f"{pii_boost.KINDS[k]}:{s}:{e}" for s, k, e in plain_found(model, text[r["doc_id"]]))
    for r in pii_boost.find_private(own, model=model).collect():
        assert [(x["start"], x["rank"], x["end"]) for x in r["_spans"]] == plain_found(model, r["text"]) and r["_spans"]
    # A name of any length is taken whole.
    assert pii_boost.find(model, PRIVATE[2])[0].start == 0


def test_private_spans_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")
    apart = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = pii_boost.fit(docs.filter(~apart))
    held = [r["text"] for r in docs.filter(apart).collect()]
    # The corpus's own addresses and numbers, rewritten; and its other numbers, alone or replaced by values that look personal.
    around = [s for t in held for s in pii_boost.surroundings(t)]
    x, y = pii_boost.corpus_examples(around, seed=99)
    picked = model.picked(x)
    mail = (x[:, 0] == pii_boost.MORE_KINDS.index("hidden_email")) & (y == 1)
    assert mail.sum() > 20 and picked[mail].mean() > 0.95
    assert y[picked].mean() > 0.95 and (y == 0).sum() >= 50
    # Documents without a base span are left alone.
    clean = [t for t in held if not pii_boost.base_spans(t)]
    assert sum(bool(pii_boost.find(model, t)) for t in clean) <= 0.002 * len(clean)


def test_redaction_merges_overlaps():
    c = pii_boost.Candidate
    assert pii_boost.redact("abcdefgh", [c(1, 4, "email"), c(3, 5, "ip"), c(6, 7, "card")]) == "a[EMAIL]f[CARD]h"


def clash(docs):
    """With columns of names that operators use."""
    names = ["_id", "_mark", "_text", "_row", "_hash", "_n", "_size", "_copies", "_source", "_toxicity", "_spans", "_redacted", "_ids", "_key", "_e", "_component", "a.b"]
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


def test_stages_on_odd_empty_and_clashing_tables(spark, odd, empty):
    import corpus_pipeline as pipeline

    want = {
        "toxicity": len(ODD), "n-gram Jaccard join": len(ODD) - 2, "PII": len(ODD), "mixing sources to target weights": None, "SentencePiece encoding and decoding": len(ODD),
    }
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        rows = stage(spark, odd, SF)
        if name.startswith("SentencePiece"):
            assert [r["pieces"] for r in rows.filter("doc_id in (1, 2)").orderBy("doc_id").collect()] == [None, []]
        else:
            assert rows.columns == odd.columns
            wide = stage(spark, clash(odd), SF)
            assert wide.columns == clash(odd).columns
            pick = ["doc_id", "text", "source"]
            assert sorted(map(repr, wide.select(*pick).collect())) == sorted(map(repr, rows.select(*pick).collect()))
            assert all(r["a.b"] == 16 and r["_id"] == 0 for r in wide.collect())
        if want[name] is not None:
            assert rows.count() == want[name], name
        else:
            assert all(len(WORD.findall(r["text"])) for r in rows.collect())


@pytest.mark.parametrize("text", ["1" * 60_000, "a." * 40_000 + "@" + "b." * 2000, "+1" + "(" * 40_000, "a at " * 5000])
def test_long_texts_take_no_square_time(text):
    import time

    began = time.time()
    pii_boost.find(pii_boost.train(), text)
    assert time.time() - began < 20


# Queries and the pipeline


def test_queries_match_sql(spark):
    from quillon.llm import queries as Q

    from ..compare import assert_same, connection

    con = connection(SF)
    for name, sql in Q.oracle_sql().items():
        assert_same(Q.queries()[name](spark, SF), con, sql)


def test_language_query_matches_plain_predictions(spark):
    from quillon.llm import queries as Q

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, text = ppm_langid.fit(docs), {r["doc_id"]: r["text"] for r in docs.collect()}
    learned = {r["lang"] for r in docs.collect()}
    for r in Q.queries()["op9_ppm_langid"](spark, SF).collect():
        said, score = ppm_langid.predict(model, [text[r["doc_id"]]])
        assert (r["lang_pred"], r["score"]) == (said[0], pytest.approx(score[0])) and r["lang_pred"] in learned | {"und"}


def test_pieces_query_matches_plain_encoding(spark, model):
    from quillon.llm import queries as Q

    coder = merge_dropout.PieceCoder(model)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.queries()["op5_merge_dropout"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        # Each stretch by its own agenda of merges.
        ids, place = [], 0
        for w in coder_stretches(coder, text[r["doc_id"]]):
            draw = merge_dropout._mix(merge_dropout._mix(np.asarray([r["doc_id"] % 2**64], dtype=np.uint64) + np.uint64(1)) + np.uint64(place))[0]
            ids, place = ids + coder.encode_stretch(w, int(draw)), place + 1
        assert (r["n_pieces"], r["lossless"]) == (len(ids), True) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def coder_stretches(coder, text):
    apart = "".join(map(chr, coder.apart))
    return re.findall(f"[{apart}]| *[^ {apart}]+| +" if apart else " *[^ ]+| +", " " + text) if text else []


def test_queries_without_sql_have_their_columns(spark):
    from quillon.llm import queries as Q

    want = {
        "op3_gif_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        "op4_fair_mix": ["doc_id", "size", "source_size", "target", "taken"],
        "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op9_ppm_langid": ["doc_id", "held_out", "lang_pred", "score"],
        "op10_pii_boost": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    }
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, columns in want.items():
        df = Q.queries()[name](spark, SF)
        assert df.columns == columns and df.count() == n
    for r in Q.queries()["op3_gif_media"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        raw = r["text"].encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_pipeline_against_plain_versions(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, d = [docs], docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        d = pipeline.written(stage(spark, d, SF), f"test{k}")
        steps.append(d)
    assert all(s.columns == docs.columns for s in steps[:-1])
    scorer = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r for r in docs.collect()}
    score = dict(zip(texts, toxicity.score_texts(scorer, [r["text"] for r in texts.values()], {}), strict=True))
    first = {r["doc_id"] for r in steps[1].collect()}
    assert first == {i for i, s in score.items() if s < toxicity.THRESHOLD}
    groups = plain_components([(r["doc_id"], r["text"]) for r in steps[1].collect()])
    second = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    assert set(second) == {i for i, _, c in groups if i == c}
    model = pii_boost.fit(steps[2])
    for r in steps[3].collect():
        assert r["text"] == pii_boost.redact(second[r["doc_id"]], pii_boost.find(model, second[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    mixed = {(r["doc_id"], r["_copies"]) for r in fair_mix.fair_mix(steps[3]).collect() if r["_copies"]}
    counts = {}
    for r in steps[4].collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert set(counts.items()) == mixed
    with open(merge_dropout.DEFAULT_MODEL, "rb") as f:
        coder = merge_dropout.PieceCoder(f.read())
    last = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == sum(counts.values()) and all(coder.decode(r["pieces"]) == last[r["doc_id"]] for r in rows)


def test_pipeline_keeps_one_of_repeated_rows(spark, odd):
    import corpus_pipeline as pipeline

    kept = pipeline.drop_near_copies(spark, odd, SF)
    assert kept.columns == odd.columns
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    assert got.count("4") == 1 and "7" in got and "8" not in got and {"1", "2", "3", "None"} <= set(got)


def test_pipeline_drops_rows_and_not_ids(spark):
    import corpus_pipeline as pipeline

    words = [f"word{k}" for k in range(60)]
    near, clean, other = " ".join(words), " ".join(f"clean{k}" for k in range(40)), " ".join(f"other{k}" for k in range(40))
    few = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_copies(spark, table(spark, [(1, near, "a"), (4, near, "a"), (4, clean, "a")]), SF).collect()]
    assert sorted(few) == [(1, near), (4, clean)]
    # 5 occurs with a near copy of 1 and a clean text; of the null ids' near copies one stays; 7 leads one group and copies another.
    rows = [(1, near), (5, near + " more"), (5, clean), (5, clean), (None, other), (None, other + " more"), (7, " ".join(words[::-1])), (7, near + " again"), (9, " ".join(words[::-1]) + " end")]
    docs = table(spark, [(i, t, "a") for i, t in rows]).repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(k for k in kept if k[0] is not None) == sorted([(1, near), (5, clean), (7, " ".join(words[::-1]))])
    assert len([k for k in kept if k[0] is None]) == 1


def test_common_shingles_stand_out_whatever_the_input_holds(spark):
    """F1, F2: at 1.5 milliard shingles, passages of some documents are still told from what occurs once."""
    passage = "one passage that forty documents of a large corpus hold in common"
    rows = [(i, 0, f"{passage} and words that only text{i} has beside it{i} and them{i}") for i in range(40)]
    survey = trie_join._survey(spark.createDataFrame(rows, "_id long, _mark long, _text string").repartition(3))
    common = trie_join._levels(survey, 1_500_000_000)
    held, own = (shingles.shingle_sets([t])[0] for t in (passage, "words that only text7 has beside it7 and them7"))
    assert (trie_join.level_of(trie_join._cells(held), common) > 0).all()
    assert (trie_join.level_of(trie_join._cells(own[-3:]), common) == 0).any()
    cells = trie_join._cells(held)
    for block in range(4):
        some = np.arange(block << 22, (block << 22) + 9, 4).astype(np.uint32)
        back = trie_join.unpack_counts(trie_join.pack_counts(some, np.arange(1, 4), block), block)
        assert back[0].tolist() == some.tolist() and back[1].tolist() == [1, 2, 3]
    none = (np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.uint8))
    assert trie_join.level_of(cells, none).tolist() == [0] * len(cells)
