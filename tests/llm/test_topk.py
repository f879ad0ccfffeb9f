"""Top-k search: bounds, cutoffs, repeated and huge vectors, and the same result as the SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.llm import topk as T
from partita.llm.shared import Scratch


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def clustered(n, groups, dim=32, spread=0.1, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(groups, dim))[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def test_bounds_hold():
    r = np.random.default_rng(1)
    for dim, scale in ((1, 5), (7, 300), (64, 10**6)):
        x, q = r.integers(-scale, scale, (40, dim)), r.integers(-scale, scale, (20, dim))
        a, b = T.Bounds.of(x[:25], 4), T.Bounds.of(x[25:], 4)
        both = T._joined([a.middle[0], a.radius[0], a.low[0], a.high[0]], [b.middle[0], b.radius[0], b.low[0], b.high[0]], 4)
        for bounds, rows in ((a, x[:25]), (T.Bounds(4, *[m[None, :] for m in both]), x)):
            part = bounds.partial(q)
            for s, (lo, hi) in enumerate(T.cuts(dim, 4)):
                assert (part[s, :, 0] >= (q[:, lo:hi] @ rows[:, lo:hi].T).max(axis=1)).all()
            best = (q @ rows.T).max(axis=1)
            assert T.passing(part, best.astype(float))[:, 0].all() and not T.passing(part, part.sum(axis=0)[:, 0] + 1).any()


def test_the_same_as_the_sql_with_repeated_rows(spark):
    x = clustered(400, 12, 8)
    rows = [(i, e.tolist()) for i, e in enumerate(x)]
    rows += [rows[7], rows[7], rows[50], (50, rows[3][1]), (100, None), (None, rows[1][1]), (150, [1.0] * 7), (151, [0.5] * 7), (152, []), (200, [])]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties, beyond the k that are kept
    v = T.quantised(frame(spark, rows))
    got = sorted(tuple(r) for r in T.top_k(v.where("vec_id % 50 = 0"), v).select("query_id", "rank", "vec_id", "score").collect())
    with duckdb.connect() as con:
        con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
        con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(i, e) for i, e in rows])
        want = sorted(con.execute(T.SQL).fetchall())
    want = [w for w in want if w[3] is not None]  # the SQL gives vectors without components a null score
    assert [g for g in got if g[0] != 200 and g[2] != 152] == [w for w in want if w[0] != 200]
    assert {g[2] for g in got if g[0] == 0} >= {1000, 1001}


@pytest.mark.parametrize("block", [5, 2048])
def test_against_all_pairs_on_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(T, "VECTOR_BLOCK", block)
    monkeypatch.setattr(T, "CELL", 16)
    x = clustered(600, 30, 16, seed=3)
    x[100:160] = x[100]  # one very common vector
    v = T.quantised(frame(spark, [(i, e.tolist()) for i, e in enumerate(x)]))
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    got: dict = {}
    for r in T.top_k(v.where("vec_id % 50 = 0"), v).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for i in range(0, 600, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(600), -s)).tolist() if j != i][:5]
        assert got[i] == [(j, int(s[j])) for j in order]


def test_the_cutoff_saves_products(spark):
    x = clustered(6000, 60, 64, seed=5)
    v = T.quantised(frame(spark, [(i, e.tolist()) for i, e in enumerate(x)]))
    q = v.where("vec_id % 50 = 0")
    heads, rest = T.phases(q, v, 5, 4, Scratch(spark))
    made = [f.agg(F.sum("resolved")).first()[0] / (6000 * 120) for f in (heads, rest)]
    print("share of products made by the heads and by the rest:", made)
    assert sum(made) < 0.5


def test_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (50, [-1e30, 2.0]), (51, [3e9, 3e9]), (52, [1.0, 1.0])]
    v = T.quantised(frame(spark, rows))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in T.top_k(v.where("vec_id % 50 = 0"), v).collect()}
    assert got[0, 50] == -T.LONG and got[0, 51] == T.LONG and got[50, 52] < 0 and len(got) == 6


def test_odd_tables(spark):
    v = T.quantised(frame(spark, [(1, [1.0]), (50, [2.0])]).selectExpr("*", "1 as x", "2 as cell", "3 as dim"))
    assert [tuple(r) for r in T.top_k(v.where("vec_id = 50"), v).collect()] == [(50, 1, 1, 256 * 512)]
    assert T.top_k(v.where("vec_id = 50"), v.limit(0)).collect() == [] and T.top_k(v.limit(0), v).collect() == []


def test_queries_are_copied_per_tile_and_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(T, "CELL", 8)
    monkeypatch.setattr(T, "VECTOR_BLOCK", 16)
    x = np.random.default_rng(2).normal(size=(2000, 16)).astype(np.float32)
    v = T.quantised(frame(spark, [(i, e.tolist()) for i, e in enumerate(x)]))
    q = v.where("vec_id % 50 = 0")
    heads, rest = T.phases(q, v, 5, 4, Scratch(spark))
    per_query = rest.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert per_query <= T.TILES + 1  # of 250 cells that are nearly all left open
    blocks, tiles = T._index(v, 4, Scratch(spark), 250)
    bounds = T.Cells(blocks, 4)
    held = {(r["dim"], r["cell"], r["tile"]) for r in blocks.collect()}
    for d, (names, _) in bounds.by.items():
        first, reached = tiles.reached(d, names.tolist())
        assert held == {(d, int(names[c]), first + int(t)) for c, t in np.argwhere(reached)}
    assert 1 < tiles.n <= T.TILES + 1


def test_no_join_of_packed_queries_is_broadcast(spark, monkeypatch):
    plans = []
    write = Scratch.write

    def noted(self, df, name):
        if name in ("heads", "rest"):
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", noted)
    v = T.quantised(frame(spark, [(i, e.tolist()) for i, e in enumerate(clustered(600, 5, 8))]))
    T.phases(v.where("vec_id % 50 = 0"), v, 5, 4, Scratch(spark))
    assert len(plans) == 2
    assert "SortMergeJoin [dim" in plans[0] and "Join" not in plans[1]
