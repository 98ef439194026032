"""A Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources, and proofs.

Every level is a DataFrame. Leaves are numbered within their source by a range sort, numbers are divided by the fanout,
and the nodes of one run are gathered in order and hashed into their parent, until each source has one node. The roots
of sources go through the same climb. Back down, every run takes its own way to the root (what stands before and after
it at each level) by one join a level, so a proof is assembled from the siblings in the last run and the way of that
run; only a sixteenth of the rows ever carries one through a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import replaced, whole_row, written

FANOUT = 16
#: Tampering touches the rows whose crc32 of the id as decimal text is divisible by this.
TAMPER = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the strings, joined."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*map(field, values))


def lowered(text: Column) -> Column:
    """A to Z in lower case, all else kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, group: str, keys: list[str], to: str = "_i", count: str = "_n") -> DataFrame:
    """``rows`` with their numbers from 0 within a group, in the order of the keys, and the group's count.

    A range sort deals the rows out, however many of them a group has; each part is numbered for itself and the counts
    of the group's earlier parts are added. The parts are written, as a second sort may draw other bounds.
    """
    parts = written(rows.repartitionByRange(group, *keys).withColumn("_part", F.spark_partition_id()), "merkle-order")
    counts = parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    # As many rows a group as there are parts, at most.
    earlier = Window.partitionBy(group).orderBy("_part")
    whole = Window.partitionBy(group)
    offsets = counts.select(group, "_part", (F.sum("_rows").over(earlier) - F.col("_rows")).alias("_first"), F.sum("_rows").over(whole).alias(count))
    within = parts.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*keys)) - 1)
    return within.join(offsets, [group, "_part"]).withColumn(to, F.col("_first") + F.col("_place")).drop("_part", "_first", "_place")


def _parent(kids: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(kids, lambda k: k["hash"])), 256)


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """(_group, _run, _n, _kids in order, _hash): each run of a level; the one node of a group that has one stays itself.

    ``nodes`` has _group, _n (nodes of its group), _i (number), _hash and _leaf (what a leaf carries).
    """
    kid = F.struct(F.col("_i").alias("i"), F.col("_hash").alias("hash"), F.col("_leaf").alias("leaf"))
    runs = nodes.groupBy("_group", F.expr(f"_i div {fanout}").alias("_run")).agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list(kid)).alias("_kids"))
    return runs.withColumn("_hash", F.when(F.col("_n") > 1, _parent(F.col("_kids"))).otherwise(F.col("_kids")[0]["hash"]))


def climb(leaves: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, leaves first, and (_group, _hash) of each group's last node.

    ``leaves`` has _group, _n, _i, _hash and _leaf. A group with one leaf has it as its last node.
    """
    levels = [written(_runs(leaves, fanout), "merkle-level")]
    most = levels[0].agg(F.max("_n")).first()[0] or 0
    ceiling = F.expr(f"(_n + {fanout - 1}) div {fanout}")
    while most > fanout:
        below = levels[-1].filter(F.col("_n") > fanout)
        nodes = below.select("_group", ceiling.alias("_n"), F.col("_run").alias("_i"), "_hash", F.lit(None).cast("string").alias("_leaf"))
        levels.append(written(_runs(nodes, fanout), "merkle-level"))
        most = -(-most // fanout)
    tops = levels[0].filter(F.col("_n") <= fanout).select("_group", "_hash")
    for level in levels[1:]:
        tops = tops.unionByName(level.filter(F.col("_n") <= fanout).select("_group", "_hash"))
    return levels, tops


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves with their way to the root, and what ``tops`` says of their group.

    ``tops`` has _group, _way (the group's own way to the root, as steps) and any other columns. Gives _leaf, _hash, _way.
    """
    others = [c for c in tops.columns if c not in ("_group", "_way")]
    tops = tops.withColumnRenamed("_way", "_above")
    top = levels[-1].filter(F.col("_n") <= fanout).join(tops, "_group")
    for k in range(len(levels) - 1, 0, -1):
        nodes = _spread(top, others).select("_group", F.col("_i").alias("_run"), F.col("_way").alias("_above"), *others)
        lower = levels[k - 1]
        ended = lower.filter(F.col("_n") <= fanout).join(tops, "_group")
        top = lower.filter(F.col("_n") > fanout).join(nodes, ["_group", "_run"]).unionByName(ended)
    return _spread(top, others).select("_leaf", "_hash", "_way", *others)


def _spread(runs: DataFrame, others: list[str]) -> DataFrame:
    """The nodes of runs with their ways: what stands before and after each in its run, then the run's own way."""
    kids = runs.select("_group", "_n", "_kids", "_above", *others, F.posexplode("_kids").alias("_at", "_kid"))
    hashes = F.transform("_kids", lambda k: k["hash"])
    step = F.struct(F.concat_ws("", F.slice(hashes, 1, F.col("_at"))).alias("before"), F.concat_ws("", F.slice(hashes, F.col("_at") + 2, F.size("_kids"))).alias("after"))
    way = F.when(F.col("_n") > 1, F.concat(F.array(step), F.col("_above"))).otherwise(F.col("_above"))
    return kids.select("_group", F.col("_kid.i").alias("_i"), F.col("_kid.hash").alias("_hash"), F.col("_kid.leaf").alias("_leaf"), way.alias("_way"), *others)


def proof(way: Column) -> Column:
    """The digest of all siblings, level by level."""
    return F.sha2(F.concat_ws("", F.transform(way, lambda s: F.concat(s["before"], s["after"]))), 256)


def folded(start: Column, way: Column) -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(way, start, lambda h, s: digest(s["before"], h, s["after"]))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", text: str = "text", fanout: int = FANOUT, carry: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of ``docs``.

    The first column is named as ``key``. With ``carry`` a column _row, as it gives it, goes along.
    - A null in any field counts as ``-``; an empty text as a text of no bytes. Texts of any length are hashed whole.
      Null sources are a group of their own and come first; a null key comes first in its source and is not tampered.
    - Rows of equal source and key (ties) stand in the order of their leaves, tampered leaves included; repeated rows
      take places one after another, each with a proof of its own.
    - An empty table gives no rows. Other columns, of any names, are not read.
    """
    columns = {c: docs[f"`{c}`"] for c in fields}
    hurt = F.coalesce(F.crc32(docs[f"`{key}`"].cast("string")) % TAMPER == 0, F.lit(False))
    changed = [lowered(c.cast("string")) if name == text else c for name, c in columns.items()]
    # A null source sorts before every other, the empty one included.
    sources = F.coalesce(F.concat(F.lit("="), docs[f"`{group}`"].cast("string")), F.lit(""))
    row = carry(docs) if carry is not None else F.lit(None).cast("string")
    rows = docs.select(sources.alias("_group"), docs[f"`{key}`"].alias("_key"), leaf(list(columns.values())).alias("_hash"), F.when(hurt, leaf(changed)).alias("_changed"), row.alias("_row"))
    # Repeated rows are told apart, so that the sort can deal them out.
    rows = rows.withColumn("_copy", F.monotonically_increasing_id())
    leaves = numbered(rows, "_group", ["_key", "_hash", "_copy"])
    levels, subroots = climb(leaves.select("_group", "_n", "_i", "_hash", F.struct("_key", "_changed", "_row").alias("_leaf")), fanout)

    named = written(subroots, "merkle-subroots")
    all_sources = named.select(F.lit(0).alias("_all"), F.col("_group").alias("_source"), "_hash")
    above, roots = climb(numbered(all_sources, "_all", ["_source"]).select(F.col("_all").alias("_group"), "_n", "_i", "_hash", F.struct("_source").alias("_leaf")), fanout)
    no_steps = F.array().cast(f"array<{_STEP}>")
    tops = descend(above, roots.select("_group", no_steps.alias("_way"), F.col("_hash").alias("_root")), fanout)
    ways = written(tops.select(F.col("_leaf._source").alias("_group"), "_way", F.col("_hash").alias("_subroot"), "_root"), "merkle-ways")

    out = descend(levels, ways, fanout)
    again = folded(F.coalesce(F.col("_leaf._changed"), F.col("_hash")), F.col("_way"))
    out = out.select(F.col("_leaf._key").alias(key), F.col("_hash").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), proof(F.col("_way")).alias("proof_sha256"), again.alias("folded_root"), F.col("_leaf._row").alias("_row"))
    out = out.withColumn("verified", F.col("folded_root") == F.col("root"))
    return out if carry is not None else out.drop("_row")


def with_manifest(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with leaf, subroot, root, proof_sha256, folded_root and verified; columns of these names are replaced.

    The rows go along, so this shuffles them; nulls, ties and the rest as in ``manifest``.
    """
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    key = how.get("key", "doc_id")
    out = manifest(docs, carry=lambda df: whole_row(replaced(df, *names)), **how)
    return out.drop(key).select("_row.*", *names)
