"""Search against all pairs: recall, exact scores, ties, copies, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesloom.llm import nn_descent as nd

KIND = "vec_id long, embedding array<float>"


def answer(table, every=20, queries=None):
    index = nd.build(table, "vec_id", "embedding")
    asked = table.where(F.col("vec_id") % every == 0) if queries is None else queries
    found = {}
    for r in nd.search(index, asked, "vec_id", "embedding").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return {k: sorted(v) for k, v in found.items()}


def plain(rows, every=20, most=20):
    """Nearest rows of each query by all pairs, with scores."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q, i in enumerate(ids.tolist()):
        if i % every == 0:
            scores = np.einsum("ij,j->i", x, x[q])
            others = np.flatnonzero(ids != i)
            best = others[np.lexsort((ids[others], -scores[others]))][:most]
            out[i] = [(k + 1, int(ids[b]), float(scores[b])) for k, b in enumerate(best)]
    return out


def recall(got, want):
    shares = [len({x[1] for x in got.get(k, [])} & {x[1] for x in v}) / len(v) for k, v in want.items()]
    return float(np.mean(shares))


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], KIND)


def test_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got, want = answer(table), plain(rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.98
    x = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for k, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 21)) and k not in {i for _, i, _ in found}
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(s == pytest.approx(float(x[k] @ x[i]), rel=1e-12, abs=1e-15) for _, i, s in found)


def test_clusters_and_lengths(spark, monkeypatch):
    """Tight clusters of different sizes and lengths that differ: chunks far below all rows."""
    monkeypatch.setattr(nd, "CHUNK", 64)
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for size in (400, 200, 60, 30, 12, 5, 300):
        centre = rng.standard_normal(16)
        for _ in range(size):
            rows.append((n, (centre + 0.05 * rng.standard_normal(16)) * rng.uniform(0.5, 2.0)))
            n += 1
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    got, want = answer(table_of(spark, rows), 5), plain(rows, 5)
    assert recall(got, want) >= 0.95


def test_few_rows_are_exact(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 15, 40):
        rows = [(i, np.float32(rng.standard_normal(6)).tolist()) for i in range(n)]
        got, want = answer(table_of(spark, rows), 4), plain(rows, 4)
        want = {k: v for k, v in want.items() if v}
        assert {k: [(r, i) for r, i, _ in v] for k, v in got.items()} == {
            k: [(r, i) for r, i, _ in v] for k, v in want.items()
        }


def test_copies_and_ties(spark):
    """A third of all rows are one vector: its smallest ids come first, never the own one."""
    rng = np.random.default_rng(5)
    hot = np.float32(rng.standard_normal(8)).tolist()
    rows = [(i, hot if i % 3 == 0 else np.float32(rng.standard_normal(8)).tolist()) for i in range(600)]
    table = table_of(spark, rows)
    got = answer(table.unionByName(table.limit(50)))
    want = plain(rows)
    for k in (0, 60, 300):
        assert [i for _, i, _ in got[k]] == [i for _, i, _ in want[k]]
    assert recall(got, want) >= 0.95


def test_odd_vectors_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0, 0]), (20, None), (40, [0, 0, 0]), (60, [nan, 1, 0]), (80, [1, inf, 0]), (1, [0.5, 0.5, 0])]
    rows += [(2, [1]), (3, []), (100, [1, 2, 3]), (None, [1, 1, 1])]
    table = table_of(spark, rows).withColumns({c: F.lit(1) for c in ("id", "vec", "node", "q", "score", "rank")})
    table = table.unionByName(
        spark.createDataFrame([(120, [None, 1.0])], KIND).withColumns({c: F.lit(1) for c in ("id", "vec", "node", "q", "score", "rank")})
    )
    got = answer(table)
    assert {k: [i for _, i, _ in v] for k, v in got.items()} == {0: [2, 100, 1], 100: [1, 0, 2]}
    assert answer(table.limit(0)) == {}
    assert answer(table, queries=table.limit(0)) == {}


def test_queries_that_are_no_rows(spark):
    """Queries from outside start from the entry nodes."""
    rng = np.random.default_rng(6)
    rows = [(i, np.float32(rng.standard_normal(8)).tolist()) for i in range(1500)]
    asked = [(-i - 1, np.float32(rng.standard_normal(8)).tolist()) for i in range(40)]
    got = answer(table_of(spark, rows), queries=table_of(spark, asked))
    x = np.array([v for _, v in rows], dtype=np.float64)
    shares = []
    for k, v in asked:
        best = np.argsort(-(x @ np.array(v)))[:20]
        shares.append(len({i for _, i, _ in got[k]} & set(best.tolist())) / 20)
    assert np.mean(shares) >= 0.9
