"""Factorisation against hand-made values and a dense reference in NumPy."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partita.operators import factor as N
from partita.operators import matrix as M

X = np.array([[2, 0, 1, 0], [0, 3, 0, 1], [1, 0, 2, 0], [0, 1, 0, 2], [1, 1, 0, 0]], float)
W0 = np.array([[0.5, 0.1], [0.1, 0.5], [0.5, 0.2], [0.2, 0.5], [0.3, 0.3]])
H0 = np.array([[1, 0, 1, 0], [0, 1, 0, 1]], float)


def entries(a):
    return [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]


def frames(spark, x, w, h):
    return (
        spark.createDataFrame(entries(x), "row_id long, col_id long, val double"),
        spark.createDataFrame(entries(w), "row_id long, comp int, val double"),
        spark.createDataFrame(entries(h), "comp int, col_id long, val double"),
    )


def array(df, a, b, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[a], r[b]] = r["val"]
    return out


def ids(spark, n, name):
    return spark.range(n).withColumnRenamed("id", name)


def test_multiplicative_step(spark):
    x, w, h = frames(spark, X, W0, H0)
    w1 = N.mu_update_w(x, w, h, 2)
    assert np.allclose(array(w1, "row_id", "comp", (5, 2)), [[1.5, 0], [0, 2], [1.5, 0], [0, 1.5], [0.5, 0.5]])
    h1 = N.mu_update_h(x, w1, h, 2)
    assert np.allclose(array(h1, "comp", "col_id", (2, 4)), [[1.052632, 0, 0.947368, 0], [0, 1.230769, 0, 0.769231]], atol=1e-6)
    assert np.sqrt(N.squared_error(x, w, h).first()[0]) == pytest.approx(3.919184, abs=1e-6)
    assert np.sqrt(N.squared_error(x, w1, h1).first()[0]) == pytest.approx(1.944576, abs=1e-6)


def test_row_wise_step_revives_zeros(spark):
    x, w, h = frames(spark, X, W0, H0)
    w1 = N.hals_update_w(x, w, h, ids(spark, 5, "row_id"), 2)
    assert np.allclose(array(w1, "row_id", "comp", (5, 2)), [[1.5, 0], [0, 2], [1.5, 0], [0, 1.5], [0.5, 0.5]])
    h1 = N.hals_update_h(x, w1, h, ids(spark, 4, "col_id"), 2)
    assert np.allclose(array(h1, "comp", "col_id", (2, 4)), [[1.052632, 0.052632, 0.947368, 0], [0.036437, 1.228745, 0, 0.769231]], atol=1e-6)
    assert np.sqrt(N.squared_error(x, w1, h1).first()[0]) == pytest.approx(1.940524, abs=1e-6)


@pytest.mark.parametrize("solver", ["mu", "hals"])
@pytest.mark.parametrize("init", ["random", "acol"])
def test_fit_lowers_the_error(spark, solver, init):
    rng = np.random.default_rng(3)
    dense = rng.random((30, 12)) * (rng.random((30, 12)) < 0.4)
    x = spark.createDataFrame(entries(dense), "row_id long, col_id long, val double")
    config = N.FactorConfig(4, 4, 0.0, init, solver=solver)
    out = N.fit(x, ids(spark, 30, "row_id"), ids(spark, 12, "col_id"), config)
    errors = [e for _, e, _, _ in out.history]
    assert out.n_iter == 4 and all(b <= a + 1e-9 for a, b in zip(errors, errors[1:], strict=False))
    w, h = array(out.w, "row_id", "comp", (30, 4)), array(out.h, "comp", "col_id", (4, 12))
    assert (w >= 0).all() and (h >= 0).all()
    assert np.linalg.norm(dense - w @ h) == pytest.approx(out.error, rel=1e-6)


@pytest.mark.parametrize("solver, stripe, sent", [("mu", 1 << 24, 4096), ("mu", 10, 3), ("hals", 10, 4096)])
def test_blocks_give_what_joins_give(spark, monkeypatch, solver, stripe, sent):
    rng = np.random.default_rng(5)
    dense, w0, h0 = rng.random((50, 40)) * (rng.random((50, 40)) < 0.3), rng.random((50, 5)), rng.random((5, 40))
    x, w, h = frames(spark, dense, w0, h0)
    update = {"mu": lambda: (N.mu_update_w(x, w, h, 5), N.mu_update_h(x, w, h, 5)), "hals": lambda: (N.hals_update_w(x, w, h, ids(spark, 50, "row_id"), 5), N.hals_update_h(x, w, h, ids(spark, 40, "col_id"), 5))}[solver]
    joined = [array(df, a, b, s) for df, a, b, s in zip(update(), ("row_id", "comp"), ("comp", "col_id"), ((50, 5), (5, 40)), strict=True)]
    error = N.squared_error(x, w, h).first()[0]
    for module, name, value in ((M.blocked, "BLOCKED_FROM", 2), (N, "BLOCKED_FROM", 2), (M.blocked, "ROWS", 16), (M.blocked, "NUMBERS", 80), (M.blocked, "STEP", 7), (M.blocked, "STRIPE", stripe), (M.blocked, "PIECE", 7), (N, "SENT", sent)):
        monkeypatch.setattr(module, name, value)
    packed = [array(df, a, b, s) for df, a, b, s in zip(update(), ("row_id", "comp"), ("comp", "col_id"), ((50, 5), (5, 40)), strict=True)]
    assert all(np.allclose(a, b) for a, b in zip(joined, packed, strict=True))
    assert N.squared_error(x, w, h, 5).first()[0] == pytest.approx(error) == pytest.approx(np.linalg.norm(dense - w0 @ h0) ** 2)


def test_tolerance_counts_only_with_errors(spark):
    x = spark.createDataFrame(entries(X), "row_id long, col_id long, val double")
    rows, cols = ids(spark, 5, "row_id"), ids(spark, 4, "col_id")
    assert N.fit(x, rows, cols, N.FactorConfig(2, 5, 0.9)).n_iter == 2  # never after the first iteration
    out = N.fit(x, rows, cols, N.FactorConfig(2, 3, 0.9, compute_error=False))
    assert out.n_iter == 3 and out.error == -1 and not out.history
    assert N.fit(x, rows, cols, N.FactorConfig(0, 1)).k == 4


def test_configuration_is_checked(spark):
    for bad in ({"init": "other"}, {"solver": "other"}, {"max_iter": -1}):
        with pytest.raises(ValueError):
            N.FactorConfig(2, **bad)
    empty = spark.createDataFrame([], "row_id long, col_id long, val double")
    with pytest.raises(ValueError):
        N.fit(empty, empty.select("row_id"), empty.select("col_id"), N.FactorConfig(2, 1))


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_matrix_algebra(spark, seed):
    rng = np.random.default_rng(seed)
    a, w, h = (rng.integers(0, 4, s) * (rng.random(s) < 0.6) for s in ((6, 5), (6, 3), (3, 5)))
    x, wf, hf = frames(spark, a.astype(float), w.astype(float), h.astype(float)) if a.any() and w.any() and h.any() else (None, None, None)
    if x is None:
        return
    assert np.allclose(array(M.x_ht(x, hf), "row_id", "comp", (6, 3)), a @ h.T)
    assert np.allclose(array(M.xt_w(x, wf), "comp", "col_id", (3, 5)), (a.T @ w).T)
    assert np.allclose(array(M.gram(hf, "col_id"), "a", "b", (3, 3)), h @ h.T)
    assert np.allclose(array(M.gram(wf, "row_id"), "a", "b", (3, 3)), w.T @ w)
    assert np.allclose(array(M.times_gram(wf, M.gram(hf, "col_id"), "row_id", 3), "row_id", "comp", (6, 3)), w @ (h @ h.T))
    back = M.unpacked(M.packed(x))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, x.collect()))


def test_numbering_and_sampling(spark):
    from partita.storage import Scratch

    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "row_id long").repartition(5)
    got = sorted(map(tuple, N.numbered(rows, Scratch(spark)).collect()))
    assert got == [(i, i) for i in range(101)]
    x = rows.selectExpr("row_id", "row_id % 3 as col_id", "1d as val")
    a, b = (sorted(r[0] for r in M.sample_rows(x, 10, s).collect()) for s in (1, 2))
    assert len(a) == len(b) == 10 and a != b
    assert M.sample_rows(x, 500).count() == 101


def test_random_numbers_are_uniform(spark):
    from pyspark.sql import functions as F

    from partita.functions.numbers import uniform

    n = 200_000
    u = np.array([r[0] for r in spark.range(n).select(uniform("id", F.lit(3), 5)).collect()])
    assert len(np.unique(u)) == n and 0 < u.min() and u.max() <= 1
    chi = ((np.bincount((u * 256).astype(int).clip(0, 255), minlength=256) - n / 256) ** 2 / (n / 256)).sum()
    assert 170 < chi < 350  # 255 are expected, with a deviation of 23
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.01 and abs(np.corrcoef(u[:-10007], u[10007:])[0, 1]) < 0.01
    v = np.array([r[0] for r in spark.range(n).select(uniform("id", F.lit(4), 5)).collect()])
    assert abs(np.corrcoef(u, v)[0, 1]) < 0.01
    x = spark.range(60_000).selectExpr("id as row_id", "0L as col_id", "1d as val")
    chosen = np.array([r[0] for r in M.sample_rows(x, 3000, 1).select("row_id").collect()])
    assert len(chosen) == 3000 and len(np.unique(chosen % 97)) == 97 and abs(chosen.mean() - 30_000) < 1300
    draws = N.acol_draws(spark, x.selectExpr("row_id as place", "row_id"), 60_000, 1000, 20).select("row_id").distinct().count()
    assert 16_000 < draws < 18_200  # of 20,000 draws from 60,000 rows about 17,009 differ


def test_no_factor_is_sent_though_its_size_is_taken_for_small(spark):
    rows, cols = spark.range(50).withColumnRenamed("id", "row_id"), spark.range(40).withColumnRenamed("id", "col_id")
    x = spark.createDataFrame([(r, c, 1.0) for r in range(50) for c in range(r % 7, 40, 7)], "row_id long, col_id long, val double")
    w, h = N.random_init(rows, cols, 3, 0.5)
    for df in (M.x_ht(x, h), M.xt_w(x, w), M.gram(h, "col_id")):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    for df in (N.mu_update_w(x, w, h, 3), N.mu_update_h(x, w, h, 3)):  # a Gram matrix of 3 x 3 alone
        assert df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1


def test_rows_without_entries_have_no_weights_left():
    r = np.random.default_rng(7)
    for k in (4, 16):
        h = r.random((k, 500)) * 0.03
        for sweeps in (1, 2):
            assert not N._descend(np.zeros((2000, k)), r.random((2000, k)) * 0.03, h @ h.T, sweeps).any()
