"""Main texts of web pages: markup, and differences between pages of one host whose URL paths are nearest.

A page becomes lines, one for each block, which its markup puts in the article, outside it, or in something that is no
text of a page (menus, forms, adverts). Lines outside the article are the page's frame. Pages of a host are sorted by
path; every page is aligned with its nearest neighbour by a longest common subsequence of frame lines, and lines that
both share are deleted. A neighbour that shares nearly everything is a copy and says nothing, so the other one is asked.

Pages differ in their menus, adverts and footers, so shared lines alone leave much of a frame. What markup itself calls
so goes too, and where a page has an article, its text is that; where it has none, its text is what differencing leaves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mapped, replaced, whole_row, written

#: Two pages that share at least this part of the shorter one's frame are copies.
COPY = 0.8

# What is called no text, by element, role, class or id.
_DROPPED = frozenset("nav header footer aside form head noscript template svg select button dialog menu object canvas audio video".split())
_RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_OTHERS = frozenset("comment comments disqus reply replies respond ad ads advert adverts advertisement advertising sponsor sponsored promo promotion related recommended".split())
_NAMES = _OTHERS | frozenset("nav navbar navigation menu menus masthead header footer sidebar banner cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social subscribe newsletter signup login breadcrumb breadcrumbs pagination pager widget toolbar".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements beyond which an open paragraph or list item is not closed by the next one.
_SCOPE = frozenset("article aside body div main nav section table td th ul ol dl blockquote form figure".split())

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SEPARATOR = re.compile(r"[^a-z0-9]+")

ARTICLE, FRAME, NO_TEXT = 0, 1, 2


def _named(attributes: str) -> tuple[set[str], bool]:
    """Words of class and id, and whether the role is none of text."""
    words, role = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            role = role or value.strip() in _ROLES
        else:
            words.update(_SEPARATOR.split(value))
    return words, role


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """Texts of blocks in page order, and where each stands: ARTICLE, FRAME or NO_TEXT."""
    texts: list[str] = []
    kinds: list[int] = []
    parts: list[str] = []
    # Open elements: name, how its text is dropped (0 not, 1 by a name that an article inside overrides, 2 for good), in an article.
    stack: list[tuple[str, int, bool]] = []
    opened: dict[str, int] = {}
    drop, article = 0, False

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                texts.append(text)
                kinds.append(NO_TEXT if drop else ARTICLE if article else FRAME)

    def cut(to: int) -> None:
        nonlocal drop, article
        for name, *_ in stack[to:]:
            opened[name] -= 1
        del stack[to:]
        now = stack[-1][1:] if stack else (0, False)
        if now != (drop, article):
            flush()
            drop, article = now

    def close_open(names: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return cut(k)
            if stack[k][0] in _SCOPE:
                return None

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCKS:
            flush()
        elif name in ("br", "img", "wbr"):
            if name == "br":
                parts.append(" ")
            continue
        if closing:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if name in _BLOCKS or not any(s[0] in _BLOCKS for s in stack[k + 1 :]):
                    cut(k)
                else:
                    # An inline element that is closed outside the block it was opened in.
                    opened[name] -= 1
                    del stack[k]
            continue
        if name in _RAW:
            found = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = found.end() if found else end
            continue
        if name in _VOID or attributes.endswith("/") and name not in _BLOCKS:
            continue
        if name in _BLOCKS:
            if opened.get("p") and name != "body":
                close_open(("p",))
            if name in ("li", "dd", "dt") and opened.get(name):
                close_open((name,) if name == "li" else ("dd", "dt"))
        new_drop, new_article = drop, article
        words, role = _named(attributes) if "=" in attributes else (set(), False)
        if name in ("article", "main"):
            if words & _OTHERS:
                new_drop = 2
            elif drop < 2:
                new_drop, new_article = 0, True
        elif name in _DROPPED and not (name == "header" and article) or role:
            new_drop = 2
        elif words and name not in ("html", "body") and not drop and words & (_NAMES - {"header"} if article else _NAMES):
            new_drop = 2 if words & _OTHERS else 1
        if (new_drop, new_article) != (drop, article):
            flush()
            drop, article = new_drop, new_article
        stack.append((name, drop, article))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return texts, kinds


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in bit vectors; in halves where the vectors would take much memory."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    inner = _common(a[first : len(a) - last], b[first : len(b) - last])
    return [*((i, i) for i in range(first)), *((i + first, j + first) for i, j in inner), *((len(a) - k, len(b) - k) for k in range(last, 0, -1))]


def _vectors(a: list[int], b: list[int]) -> Iterator[int]:
    """After each item of a, bits over b that are 0 where one more is in common."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    whole = (1 << len(b)) - 1
    v = whole
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & whole
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """How many items a has in common with each beginning of b."""
    v = (1 << len(b)) - 1
    for v in _vectors(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), dtype=np.uint8), bitorder="little", count=len(b))
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: list[int], b: list[int], most_bits: int = 1 << 26) -> list[tuple[int, int]]:
    if not a or not b or not set(a) & set(b):
        return []
    if len(a) * len(b) > most_bits and len(a) > 1:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return [*_common(a[:half], b[:cut], most_bits), *((i + half, j + cut) for i, j in _common(a[half:], b[cut:], most_bits))]
    rows = list(_vectors(a, b))
    out = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                j -= 1
                out.append((i, j))
    return out[::-1]


_PARSED = "_blocks array<string>, _open boolean, _frame array<long>, _sizes array<int>, _asks array<boolean>"


def parsed(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without html, with _blocks (the article's, or the frame's that may be text), _open (no article), and the frame: _frame (digests of lines), _sizes, _asks (whether a line may be text)."""
    place = pages.columns.index(html_column)
    kept = [i for i in range(len(pages.columns)) if i != place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                rows = []
                for html in batch.column(place).to_pylist():
                    texts, kinds = page_lines(html or "")
                    open_ = ARTICLE not in kinds
                    wanted = FRAME if open_ else ARTICLE
                    frame = [(t, k == FRAME) for t, k in zip(texts, kinds, strict=True) if k != ARTICLE]
                    hashes = [xxhash.xxh64_intdigest(t) - 2**63 for t, _ in frame]
                    rows.append(([t for t, k in zip(texts, kinds, strict=True) if k == wanted], open_, hashes, [len(t) for t, _ in frame], [k for _, k in frame]))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.list_(pa.string()), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())))]
                names = [batch.schema.names[i] for i in kept]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *columns], names=[*names, "_blocks", "_open", "_frame", "_sizes", "_asks"])

    return mapped(pages, run, T.StructType([*[pages.schema.fields[i] for i in kept], *T.StructType.fromDDL(_PARSED).fields]))


def _nearest_kept(frames: pd.Series, sizes: pd.Series, befores: pd.Series, afters: pd.Series, first: pd.Series) -> Iterator[list[bool]]:
    """For each page whether each frame line stays; ``first`` says whether the page before is nearer than the one after."""
    for frame, size, before, after, is_first in zip(frames, sizes, befores, afters, first, strict=True):
        keep = np.ones(len(frame), dtype=bool)
        for other in (before, after) if is_first else (after, before):
            if other is None:
                continue
            mine, theirs = frame.tolist(), other["frame"].tolist()
            both = common(mine, theirs)
            shared = sum(int(size[i]) for i, _ in both)
            if shared >= COPY * min(int(size.sum()), int(other["chars"])):
                continue
            keep[[i for i, _ in both]] = False
            break
        yield keep.tolist()


def frame_kept(pages: DataFrame) -> DataFrame:
    """(_host, _digest, _keep): of each frame of a host, whether each line that may be text stays, where one goes.

    ``pages`` has _host, _path, _digest, _frame, _sizes, _asks and _open; frames of pages without an article are told.
    Frames of one host that agree are one page, at the first of their paths. A range sort deals out pages however many
    a host has; the pages at the edges of its parts meet in a table with a row for each part.
    """
    order = ("_host", "_path", "_digest")
    same = [F.min("_path").alias("_path"), *[F.first(c).alias(c) for c in ("_frame", "_sizes", "_asks")], F.max("_open").alias("_open")]
    slim = pages.filter((F.col("_host") != "") & (F.size("_frame") > 0)).groupBy("_host", "_digest").agg(*same)
    parts = written(slim.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "pages-order")
    chars = F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = F.struct("_host", "_path", F.col("_frame").alias("frame"), chars.alias("chars"))
    edges = parts.groupBy("_part").agg(F.min_by(whole, F.struct(*order)).alias("_first"), F.max_by(whole, F.struct(*order)).alias("_last"))
    row = Window.partitionBy(F.lit(0)).orderBy("_part")
    edges = edges.select("_part", F.lag("_last").over(row).alias("_earlier"), F.lead("_first").over(row).alias("_later"))
    within = Window.partitionBy("_part").orderBy(*order)
    pairs = parts.withColumn("_before", F.lag(whole).over(within)).withColumn("_after", F.lead(whole).over(within)).join(edges, "_part")
    host = lambda c: F.when(c["_host"] == F.col("_host"), c)
    pairs = pairs.select("_host", "_path", "_digest", "_frame", "_sizes", "_asks", "_open", host(F.coalesce("_before", "_earlier")).alias("_before"), host(F.coalesce("_after", "_later")).alias("_after"))
    near = lambda c: F.coalesce(_alike(F.col("_path"), c["_path"]), F.lit(-1))
    pairs = pairs.withColumn("_is_first", near(F.col("_before")) >= near(F.col("_after")))

    @F.pandas_udf("array<boolean>")
    def kept(frame: pd.Series, sizes: pd.Series, before: pd.DataFrame, after: pd.DataFrame, is_first: pd.Series) -> pd.Series:
        sides = [[None if f is None else {"frame": f, "chars": c} for f, c in zip(side["frame"], side["chars"], strict=True)] for side in (before, after)]
        return pd.Series(list(_nearest_kept(frame, sizes, *sides, is_first)))

    found = pairs.select("_host", "_digest", "_asks", "_open", kept("_frame", "_sizes", "_before", "_after", "_is_first").alias("_keep"))
    asked = F.transform(F.filter(F.arrays_zip("_keep", "_asks"), lambda x: x["_asks"]), lambda x: x["_keep"])
    return found.filter("_open").select("_host", "_digest", asked.alias("_keep")).filter(F.exists("_keep", lambda k: ~k))


def _alike(a, b):
    """How many parts two paths have in common at their beginnings."""
    pair = F.arrays_zip(F.split(a, "/").alias("x"), F.split(b, "/").alias("y"))
    return F.aggregate(pair, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, p: F.struct((s["on"] & p["x"].eqNullSafe(p["y"])).alias("on"), (s["n"] + (s["on"] & p["x"].eqNullSafe(p["y"])).cast("int")).alias("n")))["n"]


def host_and_path(url):
    """Host, A to Z lowered, and path of a url; both empty without a scheme."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def main_text(pages: DataFrame, html_column: str = "html", url_column: str = "url") -> DataFrame:
    """``pages`` without html, with text and n_chars (code points).

    - Null and empty html give an empty text; html of any length is read whole, and broken markup as far as it goes.
    - A page with a null url, or with one without a scheme has no host and no neighbour; nothing is shared. A page that is the
      only one of its host has none either.
    - Of two neighbours as near as each other (ties) the one before is taken. Repeated rows and pages of a host with
      equal frames lose the same lines.
    - An empty table gives no rows. Other columns may have any names; text and n_chars are replaced.
    """
    slim = replaced(pages, "text", "n_chars").drop(html_column)
    raw = pages.select(whole_row(slim), pages[f"`{url_column}`"].cast("string").alias("_url"), pages[f"`{html_column}`"].cast("string").alias("_html"))
    host, path = host_and_path(F.coalesce(F.col("_url"), F.lit("")))
    placed = parsed(raw.select("_row", host.alias("_host"), path.alias("_path"), "_html"), "_html")
    # 128 bits tell frames apart.
    line = F.transform(F.arrays_zip("_frame", "_asks"), lambda x: F.concat(x["_frame"].cast("string"), F.when(x["_asks"], "+").otherwise("-")))
    placed = placed.withColumn("_digest", F.md5(F.array_join(line, ",")))
    gone = written(frame_kept(placed.drop("_row", "_blocks")), "pages-shared").withColumn("_open", F.lit(True))
    both = placed.select("_row", "_host", "_digest", "_blocks", "_open").join(gone, ["_host", "_digest", "_open"], "left")
    kept = F.when(F.col("_keep").isNull(), F.col("_blocks")).otherwise(F.filter("_blocks", lambda b, i: F.col("_keep")[i]))
    out = both.select("_row", F.array_join(kept, " ").alias("_text"))
    return out.select("_row.*", F.col("_text").alias("text"), F.char_length("_text").cast("long").alias("n_chars"))
