import math
import random

import duckdb
import pytest

from quern.llm import exact_topk, queries


def brute(rows, k):
    ok = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in ok if m != n))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_odd_rows_and_ties(spark):
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randrange(-3, 4)) for _ in range(6)]) for i in range(900)]
    rows += [(100, None), (200, [1.0, None]), (300, [float("nan")] * 6), (None, [1.0] * 6), (400, [float("inf")] * 6), (500, []), (600, [2.0]), (7, rows[7][1]), (700, rows[700][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "'x' AS id", "1 AS row", "2 AS score")
    got = exact_topk.top_k(df, lambda i: i % 100 == 0)
    key = lambda r: (r.query_id, r.rank, r.vec_id, r.score)
    assert sorted(map(key, got.collect())) == brute(rows, 10)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "CANDIDATES", 50)
    monkeypatch.setattr(exact_topk, "QUERIES", 3)
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) if rnd.random() < 0.7 else 0.0 for _ in range(8)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, lambda i: i % 100 == 0, k=4)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, 4)


def test_fewer_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_topk.top_k(df, lambda i: i % 100 == 0).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert exact_topk.top_k(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_large_components(spark):
    """Against the query's SQL: components beyond 2**14, and sums that leave 64 bits on the way to a score within them."""
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([1e5, -1e5, 99_999.5, 20_000.25, 16_385.0, 0.5]) for _ in range(6)]) for i in range(300)]
    rows += [(1000, [2e6, 2e6, 2e6, 2e6, 2e6, 2e6]), (1001, [1.4e6, 1.4e6, 1.4e6, -1.4e6, -1.4e6, -1.3e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, lambda i: i % 100 == 0)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    key = lambda r: (r.query_id, r.rank, r.vec_id, r.score)
    mine = sorted(map(key, got.collect()))
    assert mine == sorted(con.execute(queries.SQL_op10_exact_topk).fetchall()) == brute(rows, 10)


def test_component_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e17]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        exact_topk.top_k(df, lambda i: i % 100 == 0).collect()
