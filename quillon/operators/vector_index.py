"""A stored index of vectors in cells, with approximate and exact cosine search.

``fit`` places the centres of cells by spherical k-means over a bounded sample. ``append`` gives every vector to the
nearest centre, sorts by cell, and writes blocks: each row holds up to a bounded number of vectors of one cell. Cells of
any size are many blocks, dealt out over ``share`` numbers where they are large.

A search sends each query to the cells of the nearest centres; query blocks and vector blocks of a cell meet in an
equi-join, and each joined row is one matrix product. In exact mode a second round visits every cell that can still hold
a hit: no vector of a cell is nearer to a query than the angle to the centre less the cell's widest angle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import products
from .storage import exists, written

#: Rows of the sample that centres are fitted on; centres at most (what is broadcast); vectors or queries of a block.
SAMPLE, CELLS, BLOCK = 20_000, 4096, 1024
#: Cells that an exact search visits before any is ruled out.
FIRST_CELLS = 8
#: Blocks of one cell that a join task reads, about; a cell of more is dealt out over several.
SHARE = 64
#: Room for rounding in bounds of scores, which are rounded to six places.
SLACK = 2e-6


def sample(vectors: DataFrame, n: int = SAMPLE) -> np.ndarray:
    """At most about ``n`` distinct vectors of least hash; as many reach the driver."""
    hashed = vectors.select("v", F.shiftrightunsigned(F.xxhash64("v"), 1).alias("h"))
    total = hashed.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, 1.2 * n / max(total, 1))
    near = hashed.filter(F.col("h") / F.lit(2.0**63) <= share).dropDuplicates(["h"]).orderBy("h").limit(n)
    return products.matrix(near.select("v").toArrow().column("v"))[1]


def fit(vectors: DataFrame, cells: int | None = None, n: int = SAMPLE, rounds: int = 12, seed: int = 7, k: int = 10, target: float = 0.95) -> tuple[np.ndarray, int]:
    """Unit centres of cells, about the square root of the sample's size unless said otherwise, and how many of the nearest a search visits.

    The number is what ``target`` of the best ``k`` need within the sample. One cell for no vectors.
    """
    rows = sample(vectors, n)
    if not len(rows):
        return np.ones((1, 1)), 1
    whole = rows
    rows = rows / products.lengths(rows)[:, None]
    count = min(len(rows), CELLS, cells or max(1, int(np.sqrt(len(rows)))))
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = rows[rng.choice(len(rows), count, replace=False)]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        size = products.lengths(sums)
        # An empty cell keeps its centre.
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres, probes_for(whole, centres, k, target)


def probes_for(rows: np.ndarray, centres: np.ndarray, k: int = 10, target: float = 0.95, asked: int = 300) -> int:
    """How many of the nearest cells hold that part of the true best k, on average over some of the sample's rows.

    Vectors in clear groups need few cells; vectors without any need about half of them, and get them.
    """
    if len(rows) <= k:
        return len(centres)
    unit = rows / products.lengths(rows)[:, None]
    queries = unit[:: max(1, len(unit) // asked)]
    # The row itself, which is always found, does not count.
    true = np.argsort(-(queries @ unit.T), axis=1, kind="stable")[:, 1 : k + 1]
    home = (unit @ centres.T).argmax(1)[true]
    place = np.argsort(np.argsort(-(queries @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    need = np.take_along_axis(place, home, 1).reshape(-1)
    return int(np.sort(need)[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]) + 1


def _blocks(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(cell, number, ids, vs, least): rows sorted by cell as blocks of vectors of one cell; ``least`` is the smallest cosine to the centre."""
    ids = T.ArrayType(rows.schema[id_column].dataType)
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("ids", ids), T.StructField("vs", T.ArrayType(T.DoubleType())), T.StructField("least", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            cells = waiting.column("cell").to_numpy()
            starts = np.flatnonzero(np.diff(cells, prepend=-1))
            ends = np.append(starts[1:], len(cells))
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                # The last cell may go on in the next batch.
                whole = hi - lo if hi < len(cells) else (hi - lo) // BLOCK * BLOCK
                for at in range(lo, lo + whole, BLOCK):
                    yield one(waiting.slice(at, min(BLOCK, lo + whole - at)), number)
                    number += 1
                left = waiting.slice(lo + whole)
            waiting = left if len(cells) else None
        for at in range(0, waiting.num_rows if waiting is not None else 0, BLOCK):
            yield one(waiting.slice(at, BLOCK), number)
            number += 1

    def one(rows: pa.Table, number: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        values = rows.column(vector_column).combine_chunks().flatten().cast(pa.float64())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows.column(id_column).combine_chunks(), values)]
        least = float(rows.column("near").to_numpy().min())
        return pa.RecordBatch.from_arrays([pa.array([rows.column("cell")[0].as_py()], pa.int32()), pa.array([number], pa.int32()), *lists, pa.array([least])], names=["cell", "number", "ids", "vs", "least"])

    return rows.mapInArrow(run, schema)


def _assigned(rows: DataFrame, vector_column: str, centres: np.ndarray, nearest: int) -> DataFrame:
    """``rows`` once for each of the nearest cells: cell and near (cosine); unusable vectors go."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])
    place = rows.columns.index(vector_column)
    # A row leaves once for each cell, so fewer are taken at once where these are many.
    step = max(1, products.VECTORS // max(1, min(nearest, len(centres))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                good, vs = products.matrix(batch.column(place), c.shape[1])
                if not len(good):
                    continue
                cosine = (vs / products.lengths(vs)[:, None]) @ c.T
                n = min(nearest, c.shape[0])
                cell = np.argpartition(-cosine, n - 1, axis=1)[:, :n]
                near = np.take_along_axis(cosine, cell, 1)
                out = batch.take(pa.array(np.repeat(good, n)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.reshape(-1), pa.int32()), pa.array(near.reshape(-1))], names=[*out.schema.names, "cell", "near"])

    return rows.mapInArrow(run, schema)


def append(vectors: DataFrame, path: str, cells: tuple[np.ndarray, int] | None = None) -> int:
    """Index ``vectors`` (item, v) as a new generation at ``path``; gives its number. The first one brings what ``fit`` gave.

    Vectors that are null, zero, not finite or of another dimension are left out, as they have no scores. Every other
    row is indexed, repeated ones too. A generation is read once its last table is written.
    """
    spark = vectors.sparkSession
    generation = generations(spark, path)
    if generation == 0:
        if cells is None:
            raise ValueError("the first generation needs cells")
        centres, probes = cells
        rows = [(i, c.tolist(), probes) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    else:
        centres, _ = _centres(spark, path)
    near = _assigned(vectors.select("item", "v"), "v", centres, 1)
    # A cell of many vectors is many blocks in several tasks.
    dealt = near.repartitionByRange("cell", F.xxhash64("item")).sortWithinPartitions("cell")
    target = f"{path}/blocks/generation={generation}"
    _blocks(dealt, "item", "v").write.mode("overwrite").parquet(target)
    stored = spark.read.parquet(target)
    stored.groupBy("cell").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("ids")).alias("n"), F.min("least").alias("least")).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells/generation={generation}")
    return generation


def generations(spark: SparkSession, path: str) -> int:
    n = 0
    while exists(spark, f"{path}/cells/generation={n}/_SUCCESS"):
        n += 1
    return n


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    rows = sorted(spark.read.parquet(f"{path}/centres").collect())
    return np.asarray([r["centre"] for r in rows]), rows[0]["probes"]


class VectorIndex:
    """What is stored at a path, as of now."""

    def __init__(self, spark: SparkSession, path: str):
        n = generations(spark, path)
        if not n:
            raise ValueError(f"there is no index at {path}")
        read = lambda table: spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/generation={g}" for g in range(n)])
        self.centres, self.probes = _centres(spark, path)
        self.blocks = read("blocks")
        #: A row for each cell that holds vectors.
        self.cells = read("cells").groupBy("cell").agg(F.sum("blocks").alias("blocks"), F.sum("n").alias("n"), F.min("least").alias("least"))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
        """From ``queries`` (query, qv): query, item, rank, score rounded to 6; ties go to the least item.

        Without ``exact`` the nearest ``probes`` cells (the fitted number, if none is given) are searched, and hits
        elsewhere may be missed. Queries that are
        null, zero, not finite or of another dimension have no hits.
        """
        asked, probes = queries.select("query", "qv"), probes or self.probes
        best = Window.partitionBy("query").orderBy(F.desc("score"), "item")
        if not exact:
            found = self._hits(_assigned(asked, "qv", self.centres, probes), k)
        else:
            # A few cells give scores to beat; others are visited only if they can hold a better one.
            placed = written(_assigned(asked, "qv", self.centres, min(probes, FIRST_CELLS)), "vectors-placed")
            first = written(self._hits(placed, k), "vectors-first")
            least = first.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == k).select("query", F.col("score").alias("least"))
            visited = placed.groupBy("query").agg(F.collect_set("cell").alias("visited"))
            found = first.unionByName(self._hits(self._unvisited(asked.join(visited, "query").join(least, "query", "left")), k))
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def _unvisited(self, asked: DataFrame) -> DataFrame:
        """Queries (query, qv, visited, least) with the other cells that can hold a score of at least ``least``."""
        # A number for each centre; of cells without vectors none can be near.
        widest = np.full(len(self.centres), np.nan)
        for r in self.cells.select("cell", "least").collect():
            widest[r["cell"]] = r["least"]
        shared = asked.sparkSession.sparkContext.broadcast((self.centres, np.arccos(np.clip(widest, -1, 1))))
        schema = T.StructType([asked.schema["query"], asked.schema["qv"], T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, wide = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, products.QUERIES):
                    batch = whole.slice(at, products.QUERIES)
                    column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
                    good, qs = products.matrix(column("qv"), c.shape[1])
                    if not len(good):
                        continue
                    near = np.clip((qs / products.lengths(qs)[:, None]) @ c.T, -1, 1)
                    bound = np.cos(np.maximum(0.0, np.arccos(near) - wide))
                    least = pc.fill_null(column("least"), -2.0).to_numpy(zero_copy_only=False)[good]
                    wanted = bound + SLACK >= least[:, None]
                    for i, seen in enumerate(column("visited").take(pa.array(good)).to_pylist()):
                        wanted[i, seen] = False
                    row, cell = np.nonzero(wanted)
                    places = pa.array(good[row])
                    yield pa.RecordBatch.from_arrays([column("query").take(places), column("qv").take(places), pa.array(cell, pa.int32()), pa.array(near[row, cell])], names=["query", "qv", "cell", "near"])

        return asked.mapInArrow(run, schema)

    def _hits(self, placed: DataFrame, k: int) -> DataFrame:
        """(query, item, score): of each query block and vector block of a cell the best k."""
        asked = _blocks(placed.repartitionByRange("cell", F.xxhash64("query")).sortWithinPartitions("cell"), "query", "qv")
        shares = self.cells.select("cell", F.greatest(F.lit(1), F.ceil(F.col("blocks") / SHARE)).cast("int").alias("shares"))
        asked = asked.join(F.broadcast(shares), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("ids").alias("queries"), F.col("vs").alias("qs"))
        held = self.blocks.join(F.broadcast(shares), "cell").select("cell", F.pmod(F.xxhash64("number", "generation"), F.col("shares")).cast("int").alias("share"), "ids", "vs")
        pairs = asked.join(held, ["cell", "share"]).select("queries", "qs", "ids", "vs")
        kinds = [placed.schema["query"].dataType, self.blocks.schema["ids"].dataType.elementType]
        schema = T.StructType([T.StructField("query", kinds[0]), T.StructField("item", kinds[1]), T.StructField("score", T.DoubleType())])
        dimension = self.centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(whole.num_rows):
                    queries, qs, ids, vs = (whole.column(c)[i].values for c in range(4))
                    order = pc.sort_indices(ids)
                    rows, columns = (x.to_numpy(zero_copy_only=False).reshape(-1, dimension) for x in (qs, vs))
                    columns = columns[order.to_numpy()]
                    scores = np.round((rows @ columns.T) / (products.lengths(rows)[:, None] * products.lengths(columns)), 6)
                    best = products.Best(k)
                    best.add(0, ids.take(order), scores)
                    yield from best.table(pa.chunked_array([queries])).combine_chunks().to_batches()

        return pairs.mapInArrow(run, schema)


def recall(found: DataFrame, true: DataFrame, k: int) -> DataFrame:
    """One row: the part of the true hits (query, item, rank) up to rank k that were found."""
    wanted = true.filter(F.col("rank") <= k).select("query", "item")
    hit = found.filter(F.col("rank") <= k).select("query", "item", F.lit(1).alias("_hit"))
    return wanted.join(hit, ["query", "item"], "left").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("n"))
