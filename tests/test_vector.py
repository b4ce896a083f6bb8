"""Exact top-k against plain sorting, in both plans and with small tiles."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from check import canon
from storyspark.operators import vector


@pytest.mark.parametrize("same", [None, "kind"])
@pytest.mark.parametrize("limit", [64 << 20, 600])
def test_top_k_equals_plain_sorting(spark, monkeypatch, same, limit):
    monkeypatch.setattr(vector, "MAX_QUERY_BYTES", limit)  # 600 bytes: many tiles of a few queries
    monkeypatch.setattr(vector, "TILE_CELLS", 2048)
    rng = np.random.default_rng(0)
    data = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties
    data[data.any(1) == 0] = 1.0
    asked = rng.normal(size=(60, 4))
    vectors = spark.createDataFrame([(i, v.tolist(), f"k{i % 3}") for i, v in enumerate(data)], "vec_id long, embedding array<double>, kind string")
    queries = spark.createDataFrame([(f"q{i}", v.tolist(), f"k{i % 3}") for i, v in enumerate(asked)], "query_id string, q array<double>, kind string")
    got = vector.top_k_vectors(vectors, queries, 5, qvector="q", same=same).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(data) @ unit(asked).T
    for q in range(60):
        rows = sorted(((-round(sims[i, q], 9), i) for i in range(300) if same is None or i % 3 == q % 3))[:5]
        mine = sorted((r["rank"], r["vec_id"], round(r["similarity"], 9)) for r in got if r["query_id"] == f"q{q}")
        assert [-s for s, _ in rows] == [s for _, _, s in mine]
    assert len(got) == 300


def test_products_stay_within_the_tile(monkeypatch):
    monkeypatch.setattr(vector, "TILE_CELLS", 4096)
    sizes = []
    plain = vector._Best._tile
    monkeypatch.setattr(vector._Best, "_tile", lambda self, a, b, ids, *rest: (sizes.append((b - a) * len(ids)), plain(self, a, b, ids, *rest))[1])
    rng = np.random.default_rng(1)
    best = vector._Best(list(range(500)), vector.unit(rng.normal(size=(500, 8))), None, 3, 1.0, 1.0, False, False)
    best.add(np.arange(3000), vector.unit(rng.normal(size=(3000, 8))), None, None)
    assert max(sizes) <= 4096 and sum(sizes) == 500 * 3000 and len(best.frame("q", "v")) == 1500


def test_no_queries(spark):
    empty = spark.createDataFrame([], "query_id string, embedding array<double>")
    with pytest.raises(ValueError):
        vector.top_k_vectors(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), empty, 3)


NULL_ROWS = [
    "j20_vector_top_k", "j20_vector_top_k_filtered", "j21_retrieval_context", "e5_retrieval_context", "j5_semantic_rank",
]


@pytest.mark.parametrize("name", NULL_ROWS)
def test_rows_without_label_or_vector_as_in_sql(spark, tmp_path, name):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 8 == 3 else i % 4, None if i % 19 == 5 else rng.normal(size=6).tolist()) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    texts = [(i, f"The story of row {i} starts here. It goes on.", "en", "s") for i in range(90)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    short = lambda rows: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    df = entry.queries()[name](spark, str(tmp_path))
    cur = con.execute(entry.oracle_sql()[name])
    assert canon(short(df.collect()), df.columns) == canon(short(cur.fetchall()), [d[0] for d in cur.description])


@pytest.mark.parametrize("limit", [64 << 20, 100])
def test_incomplete_vectors_have_no_hits(spark, monkeypatch, limit):
    monkeypatch.setattr(vector, "MAX_QUERY_BYTES", limit)
    rows = [(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [None, 1.0], "a"), (4, [float("nan"), 1.0], "a"), (5, [1.0, 1.0], None), (6, [0.0, 1.0], "b")]
    asked = [(f"q{i}", [1.0, 0.0], "a") for i in range(20)] + [(None, [0.0, 1.0], "b"), ("x", None, "a"), ("y", [None, 1.0], "a"), ("z", [1.0, 0.0], None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string")
    queries = spark.createDataFrame(asked, "query_id string, q array<double>, kind string")
    found = lambda **kw: {(r.query_id, r.rank): r.vec_id for r in vector.top_k_vectors(vectors, queries, 5, qvector="q", **kw).collect()}
    near = {(f"q{i}", n): v for i in range(20) for n, v in ((1, 1), (2, 5), (3, 6))}
    assert found() == near | {("z", 1): 1, ("z", 2): 5, ("z", 3): 6, (None, 1): 6, (None, 2): 5, (None, 3): 1}
    assert found(same="kind") == {(f"q{i}", 1): 1 for i in range(20)} | {(None, 1): 6}
    assert vector.top_k_vectors(vectors, queries.filter("query_id = 'x'"), 5, qvector="q").collect() == []


@pytest.mark.parametrize("limit", [64 << 20, 100])
def test_parts_without_vectors_and_ids_of_any_type(spark, monkeypatch, limit):
    monkeypatch.setattr(vector, "MAX_QUERY_BYTES", limit)
    asked = spark.createDataFrame([(f"q{i}", [1.0, 0.0]) for i in range(20)], "query_id string, q array<double>")
    for kind in ("string", "long"):
        vectors = spark.range(3).repartition(6).selectExpr(f"cast(id AS {kind}) AS vec_id", "array(1D, cast(id AS double)) AS embedding")  # some parts are empty
        found = vector.top_k_vectors(vectors, asked, 2, qvector="q").collect()
        assert {(r["rank"], str(r.vec_id)) for r in found} == {(1, "0"), (2, "1")} and len(found) == 40
        none = vector.top_k_vectors(vectors.selectExpr("vec_id", "array(double('NaN')) AS embedding"), asked.selectExpr("query_id", "array(1D) AS q"), 2, qvector="q")
        assert none.collect() == []
