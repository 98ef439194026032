"""The stored cells against brute force: recall, exactness, appended vectors, hot cells, groups, odd vectors and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import dense, products, vector_index
from quillon.operators.storage import new_folder
from quillon.plans import retrieval

VECTORS = "item long, v array<float>"


def plain(queries, vectors, k):
    out = set()
    for q, qv in queries:
        a = np.asarray(qv, dtype=np.float64)
        scores = sorted((-round(float(a @ v) / float(np.sqrt(a @ a) * np.sqrt(v @ v)), 6), i) for i, w in vectors if (v := np.asarray(w, dtype=np.float64)).any())
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(scores[:k])}
    return out


@pytest.fixture(scope="module")
def grouped():
    """Vectors in groups, a third of them in one."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    group = np.where(rng.random(3000) < 0.35, 0, rng.integers(0, 30, 3000))
    return [(i, v.tolist()) for i, v in enumerate((centres[group] + 0.25 * rng.normal(size=(3000, 16))).astype(np.float32))]


@pytest.fixture(scope="module")
def index(spark, grouped):
    path = new_folder(spark, "test")
    vectors = spark.createDataFrame(grouped, VECTORS)
    cells = vector_index.fit(vectors, cells=40)
    for part in range(2):
        assert vector_index.append(vectors.filter(F.col("item") % 2 == part), path, cells if part == 0 else None) == part
    return vector_index.VectorIndex(spark, path)


def asked(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "query long, qv array<float>")


def found(df):
    return {(r["query"], r["item"], r["rank"]) for r in df.collect()}


def test_every_row_is_indexed_and_cells_are_cut(index):
    assert index.cells.agg(F.sum("n")).first()[0] == 3000
    assert index.blocks.agg(F.max(F.size("ids"))).first()[0] <= vector_index.BLOCK


def test_recall_and_exactness_of_groups(spark, grouped, index):
    some = grouped[::20]
    true = plain(some, grouped, 10)
    near = found(index.search(asked(spark, some), 10))
    assert len({x[:2] for x in near} & {x[:2] for x in true}) >= 0.9 * len(true)
    assert index.probes < 20
    assert found(index.search(asked(spark, some), 10, exact=True)) == true
    assert found(index.search(asked(spark, some), 10, probes=1, exact=True)) == true


def test_hot_cells_are_shared_out(spark, grouped, index, monkeypatch):
    monkeypatch.setattr(vector_index, "SHARE", 1)
    monkeypatch.setattr(vector_index, "BLOCK", 100)
    some = grouped[::50]
    assert found(index.search(asked(spark, some), 7, exact=True)) == plain(some, grouped, 7)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_given_vectors(spark, sf):
    """They hardly form groups; the fitted number of cells still finds nine of ten."""
    d = f"/root/testdata/{sf}"
    true = dense.cosine_top_k(*retrieval._vectors(spark, d), 10)
    row = vector_index.recall(retrieval.vector_index_topk(spark, d), true, 10).first()
    assert row["n"] == true.count() and row["recall"] >= 0.9


def test_no_nested_loops(spark, index, grouped):
    for df in (index.search(asked(spark, grouped[:9])), retrieval.cosine_topk(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_vectors_ties_and_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, 1.0]), (9, [None, 1.0])]
    vectors = spark.createDataFrame(rows, VECTORS)
    path = new_folder(spark, "test")
    vector_index.append(vectors, path, vector_index.fit(vectors.filter("item in (1, 2, 8)")))
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "query long, qv array<float>")
    index = vector_index.VectorIndex(spark, path)
    for hits in (index.search(queries, 3, exact=True), dense.cosine_top_k(queries, vectors, 3)):
        assert sorted((r["query"], r["item"], r["rank"], r["score"]) for r in hits.collect()) == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 2, 3, 1.0)]
    assert index.search(queries.limit(0), exact=True).count() == 0
    empty = new_folder(spark, "test")
    vector_index.append(vectors.limit(0), empty, vector_index.fit(vectors.limit(0)))
    assert vector_index.VectorIndex(spark, empty).search(queries).count() == 0
    with pytest.raises(ValueError, match="needs cells"):
        vector_index.append(vectors, new_folder(spark, "test"))
    with pytest.raises(ValueError, match="no index"):
        vector_index.VectorIndex(spark, new_folder(spark, "test"))


def test_conditions_and_blocks_of_products(spark, grouped, monkeypatch):
    monkeypatch.setattr(products, "QUERIES", 3)
    monkeypatch.setattr(products, "VECTORS", 64)
    some = [(i, v) for i, v in grouped[:400]]
    vectors = spark.createDataFrame([(i, v, f"g{i % 5}" if i % 7 else None) for i, v in some], VECTORS + ", label string")
    queries = spark.createDataFrame([(i, v, f"g{i % 5}") for i, v in some[:20]], "query long, qv array<float>, mine string")
    hits = dense.cosine_top_k(queries, vectors, 4, equal=(("mine", "label"),), differ=(("query", "item"),))
    expected = set()
    for i, v in some[:20]:
        expected |= plain([(i, v)], [(j, w) for j, w in some if j != i and j % 7 and j % 5 == i % 5], 4)
    assert found(hits) == expected
    best = dense.best_per_chunk(dense.cosine_best(queries, vectors.withColumnRenamed("label", "chunk"), "chunk"), 3)
    for r in best.collect():
        members = [(j, w) for j, w in some if (f"g{j % 5}" if j % 7 else None) == r["chunk"]]
        assert (r["query"], r["item"], 1) in plain([(r["query"], dict(some)[r["query"]])], members, 1)


def repeated(nearest, rows=10_000):
    """Rows of the batches that vectors leave in, and the most bytes Arrow held, for one batch of many vectors."""
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark.sql import types as T

    vs = np.random.default_rng(3).normal(size=(rows, 64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), pa.FixedSizeListArray.from_arrays(vs.reshape(-1), 64).cast(pa.list_(pa.float64()))], names=["query", "qv"])
    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("qv", T.ArrayType(T.DoubleType()))])
    run = vector_index._assigned(SimpleNamespace(sparkSession=session, schema=schema, columns=["query", "qv"], mapInArrow=lambda f, _: f), "qv", np.eye(64)[:, :64], nearest)
    return [(b.num_rows, b.nbytes) for b in run(iter([batch]))]


def test_vectors_of_many_cells_leave_in_bounded_batches():
    """a task holds as many repeated rows for sixty cells as for one."""
    for nearest in (1, 60):
        got = repeated(nearest)
        assert sum(n for n, _ in got) == 10_000 * nearest
        assert max(n for n, _ in got) <= products.VECTORS
