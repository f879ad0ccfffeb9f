"""Lists, search and evaluation against hand-made values and simulations."""

import heapq
import random

import pytest

from partita.operators import evaluate as E
from partita.operators import lists as L
from partita.operators import search as S

SCORES = [0.9, 0.2, 0.1, 0.8, 0.95, 0.05, 0.85, 0.3, 0.99, 0.0]
LISTS = [[0, 1, 2, 3, 4, 5], [3, 6, 7], [8, 9]]


def bounded_heap(scores, cap):
    heap = []
    for doc, s in enumerate(scores):
        if s > 0:
            if len(heap) < cap:
                heapq.heappush(heap, (s, doc))
            elif s > heap[0][0]:
                heapq.heapreplace(heap, (s, doc))
    return [d for _, d in sorted(heap, reverse=True)]


def test_many_ties_at_the_cap(spark):
    r = random.Random(3)
    for cap in (1, 7, 40):
        rows = [(0, d, float(r.choice([1, 1, 1, 1, 2]) if d % 50 else 3)) for d in range(4000)]
        got = L.admitted(spark.createDataFrame(rows, "comp int, doc_id long, affinity double"), cap).orderBy("pos").collect()
        assert [g["doc_id"] for g in got] == bounded_heap([s for _, _, s in rows], cap)


def test_lists_keep_what_a_bounded_heap_keeps(spark):
    random.seed(4)
    cases = [[1, 1, 1], [1, 1, 1, 2], [1, 2, 1], [2, 2, 2, 2], [0, -1, 3, 2, 3], [0, 0]]
    cases += [[random.randint(-1, 3) for _ in range(random.randint(1, 12))] for _ in range(150)]
    rows = [(c, d, float(s)) for c, scores in enumerate(cases) for d, s in enumerate(scores)]
    for cap in (1, 2, 5):
        got = {}
        for r in L.admitted(spark.createDataFrame(rows, "comp int, doc_id long, affinity double"), cap).orderBy("comp", "pos").collect():
            got.setdefault(r["comp"], []).append(r["doc_id"])
        assert [got.get(c, []) for c in range(len(cases))] == [bounded_heap(s, cap) for s in cases]
    assert L.list_cap(1500, 6, 0.5) == 125 and L.list_cap(7, 3) == 24
    with pytest.raises(ValueError):
        L.list_cap(5, 0)


@pytest.fixture(scope="module")
def fixture(spark):
    x = spark.createDataFrame([(d, 0, s) for d, s in enumerate(SCORES) if s], "row_id long, col_id long, val double")
    q = spark.createDataFrame([(7, 0, 1.0)], "row_id long, col_id long, val double")
    docs = spark.range(10).withColumnRenamed("id", "doc_id")
    ranked = spark.createDataFrame([(7, 0, 1.0, 1), (7, 1, 0.5, 2), (7, 2, 0.1, 3)], "query_id long, comp int, q_score double, rank int")
    lists = spark.createDataFrame([(c, p, d) for c, ds in enumerate(LISTS) for p, d in enumerate(ds)], "comp int, pos int, doc_id long")
    return q, x, docs, ranked, lists


@pytest.mark.parametrize(
    "misses, ratio, scores, processed",
    [
        (1, 0.15, [0.9, 0.85], 6), (2, 0.15, [0.95, 0.9], 8), (3, 0.15, [0.95, 0.9], 8), (2, 0.05, [0.99, 0.95], 10),
        (1, 0.6, [0.9, 0.2], 3), (0, 0.05, [0.99, 0.9], 3), (2, 1.5, [], 0), (100, 0.0, [0.99, 0.95], 10),
    ],
)
def test_adaptive(fixture, misses, ratio, scores, processed):
    q, x, docs, ranked, lists = fixture
    got = S.adaptive_search(q, x, docs, ranked, lists, 2, S.AdaptiveParams(misses, ratio)).orderBy("rank").collect()
    assert [r["score"] for r in got] == scores
    assert {r["processed"] for r in got} == ({processed} if scores else set())


@pytest.mark.parametrize("slice_, growth", [(1, 2), (3, 2), (2, 4)])
def test_rounds_score_little_more_than_the_walk(spark, monkeypatch, slice_, growth):
    """Against a walk in memory, which scores no more rows than the rounds do, and they no more than the lists hold."""
    monkeypatch.setattr(S, "SLICE", slice_)
    monkeypatch.setattr(S, "GROWTH", growth)
    r = random.Random(slice_)
    n, comps = 150, 5
    score = {(q, d): float(r.randint(0, 30)) for q in range(6) for d in range(n)}
    q = spark.createDataFrame([(i, i, 1.0) for i in range(6)], "row_id long, col_id long, val double")
    x = spark.createDataFrame([(d, i, s) for (i, d), s in score.items() if s], "row_id long, col_id long, val double")
    held = {c: r.sample(range(n), r.randint(5, 60)) for c in range(comps)}
    lists = spark.createDataFrame([(c, p, d) for c, ds in held.items() for p, d in enumerate(ds)], "comp int, pos int, doc_id long")
    order = {i: r.sample(range(comps), comps) for i in range(6)}
    ranked = spark.createDataFrame([(i, c, 1.0 / k, k) for i, cs in order.items() for k, c in enumerate(cs, 1)], "query_id long, comp int, q_score double, rank int")
    docs = spark.range(n - 10).withColumnRenamed("id", "doc_id")
    got, scored = S.adaptive_rounds(q, x, docs, ranked, lists, 4, S.AdaptiveParams(3, 0.0))
    rows, most = {}, {}
    for i, cs in order.items():
        walk = S.Walk(4, 3)
        for k, c in enumerate(cs, 1):
            for d in held[c]:
                if d < n - 10:
                    walk.visit(k, d, score[i, d])
        rows[i] = [(d, -s, len(walk.seen)) for s, d in sorted((s, d) for s, _, d in walk.heap)]
        most[i] = len({d for ds in held.values() for d in ds if d < n - 10})
    found: dict = {}
    for row in got.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["doc_id"], row["score"], row["processed"]))
    assert found == rows
    counts = {row["query_id"]: row["count"] for row in scored.groupBy("query_id").count().collect()}
    assert all(rows[i][0][2] <= counts[i] <= most[i] for i in rows) and sum(counts.values()) < 0.9 * sum(most.values())
    assert scored.count() == scored.select("query_id", "doc_id").distinct().count()


@pytest.mark.parametrize(
    "nprobe, factor, docs_, n",
    [(1, 1.0, [4, 0], 6), (2, 1.0, [4, 0], 8), (3, 1.0, [8, 4], 10), (3, 0.25, [8, 0], 6), (2, 0.5, [0, 6], 6), (99, 0.0, [8, 0], 3)],
)
def test_naive(fixture, nprobe, factor, docs_, n):
    q, x, docs, ranked, lists = fixture
    params = S.NaiveParams(nprobe, factor)
    assert [r["doc_id"] for r in S.naive_search(q, x, docs, ranked, lists, 6, 2, params).orderBy("rank").collect()] == docs_
    assert S.naive_candidates(ranked, lists, docs, 6, params).count() == n


def test_rows_outside_the_searched_ones_are_skipped(fixture):
    q, x, docs, ranked, lists = fixture
    got = S.naive_search(q, x, docs.where("doc_id < 8"), ranked, lists, 6, 2, S.NaiveParams(3)).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [4, 0]


def test_zero_scores_fill_up_and_limits_are_checked(fixture):
    q, x, docs, ranked, lists = fixture
    got = S.naive_search(q, x, docs, ranked, lists, 6, 20, S.NaiveParams(3)).orderBy("rank").collect()
    assert len(got) == 10 and got[-1]["doc_id"] == 9 and got[-1]["score"] == 0
    with pytest.raises(ValueError):
        S.naive_search(q, x, docs, ranked, lists, 6, 0)
    with pytest.raises(ValueError):
        S.adaptive_search(q, x, docs, ranked, lists, 0)
    with pytest.raises(TypeError):
        S.search(q, x, docs, None, lists, 3, 6, 2, "naive")


def truth_and_results(spark):
    gt = {0: [5, 9, 1, 7], 1: [2, 6, -1, -1], 2: [-1] * 4, 3: [1, 2, 3, 4]}
    found = {0: [5, 7, 9], 1: [1, 2], 2: [4, 3, 8], 3: []}
    t = spark.createDataFrame([(q, r, d) for q, ds in gt.items() for r, d in enumerate(ds, 1)], "query_id long, rank int, doc_id long")
    f = spark.createDataFrame([(q, r, d, 1.0) for q, ds in found.items() for r, d in enumerate(ds, 1)], "query_id long, rank int, doc_id long, score double")
    return f, t, spark.range(4).withColumnRenamed("id", "query_id")


def test_recall(spark):
    f, t, ids = truth_and_results(spark)
    got = {(r["query_id"], r["recall_at"]): r["recall"] for r in E.recall_normalised(f, t, ids, (2, 3)).collect()}
    assert [got[q, 2] for q in range(4)] == [1, 0.5, 0, 0] and [got[q, 3] for q in range(4)] == [1, 0.5, 0, 0]
    m = {r["recall_at"]: r for r in E.mean_std(E.recall_normalised(f, t, ids, (2, 3)), ["recall_at"], "recall").collect()}
    assert m[2]["mean_recall"] == 0.375 and m[2]["std_recall"] == pytest.approx(0.414578, abs=1e-6)
    two = {r["query_id"]: r["recall"] for r in E.recall_fixed(f, t, ids, 2).collect()}
    three = {r["query_id"]: r["recall"] for r in E.recall_fixed(f, t, ids, 3).collect()}
    assert [two[q] for q in range(4)] == [0.5, 0.5, 0, 0]
    assert [round(three[q], 6) for q in range(4)] == [0.666667, 0.333333, 0, 0]


def test_cheapest_run_per_target(spark):
    runs = spark.createDataFrame([("a", 0, 30, 0.95, 5.0), ("b", 1, 30, 0.92, 2.0), ("c", 2, 30, 0.92, 2.0), ("d", 3, 30, 0.5, 1.0)], "config string, seq int, recall_at int, mean_recall double, cost double")
    got = {r["target"]: r["config"] for r in E.optimal_per_target(runs).collect()}
    assert got[0.9] == "b" and got[0.92] == "b" and got[0.93] == "a" and got[0.95] == "a" and got[0.96] is None


def test_coverage(spark):
    lists = spark.createDataFrame([(c, p, d) for c, ds in enumerate(LISTS) for p, d in enumerate(ds)], "comp int, pos int, doc_id long")
    projected = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (0, 2, 0.1), (1, 0, 0.1), (1, 1, 0.9), (1, 2, 0.4)], "query_id long, comp int, q_score double")
    truth = spark.createDataFrame([(q, r, d) for q, ds in enumerate([[4, 3, 7, 8], [7, 3, 9, 99]]) for r, d in enumerate(ds, 1)], "query_id long, rank int, doc_id long")
    ids = spark.range(2).withColumnRenamed("id", "query_id")
    hits = E.first_hits(projected, truth, lists, ids, 3, 3, 4).persist()
    rows = [tuple(round(v, 6) for v in r[1:]) for r in E.coverage_by_rank(hits, 2, 3, 4).orderBy("list_rank").collect()]
    assert rows == [(2.0, 0.5, 0.458333, 0.273227), (1.0, 0.75, 0.583333, 0.083333), (0.5, 0.875, 0, 0)]
    hist = E.coverage_histogram(hits, 3).orderBy("list_rank", "bin").collect()
    assert [r["n"] for r in hist] == [1, 0, 0, 0, 0, 1, 2, 0, 0, 0] + [0, 0, 0, 0, 0, 1, 1, 0, 0, 0] + [1] + [0] * 9
    assert E.coverage_overall(hits, 2, 4).first()[0] == 0.875


def test_exact_and_full_probing_agree(spark):
    random.seed(9)
    x = spark.createDataFrame([(r, c, float(random.randint(1, 5))) for r in range(40) for c in random.sample(range(8), 3)], "row_id long, col_id long, val double")
    q, docs = x.where("row_id < 5"), x.selectExpr("row_id as doc_id").distinct()
    h = spark.createDataFrame([(c % 3, c, 1.0) for c in range(8)], "comp int, col_id long, val double")
    lists = L.build_lists(x, h, 1000)
    exact = [tuple(r) for r in S.exact_top_k(q, x, 5).orderBy("query_id", "rank").collect()]
    naive = [tuple(r) for r in S.search(q, x, docs, h, lists, 3, 1000, 5, S.NaiveParams(3)).orderBy("query_id", "rank").collect()]
    assert exact == naive
    walk = S.search(q, x, docs, h, lists, 3, 1000, 5, S.AdaptiveParams(10**6, 0.0)).select("query_id", "rank", "score").orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in walk] == [(a, b, d) for a, b, _, d in exact]


def test_scale_of_the_matrix_changes_nothing(spark):
    """Scores are compared as they are: a matrix of tiny numbers has the lists and results of the matrix times a power of two."""
    random.seed(10)
    rows = [(r, c, float(random.randint(1, 9))) for r in range(60) for c in random.sample(range(12), 4)]
    h = spark.createDataFrame([(c % 4, c, 0.25 + c) for c in range(12)], "comp int, col_id long, val double")
    got = []
    for scale in (1.0, 2.0**-40):
        x = spark.createDataFrame([(r, c, v * scale) for r, c, v in rows], "row_id long, col_id long, val double")
        lists = L.build_lists(x, h, 20).orderBy("comp", "pos").collect()
        found = S.search(x.where("row_id < 6"), x, x.selectExpr("row_id as doc_id").distinct(), h, L.build_lists(x, h, 20), 4, 20, 5, S.AdaptiveParams(30, 0.1)).orderBy("query_id", "rank").collect()
        exact = S.exact_top_k(x.where("row_id < 6"), x, 5).orderBy("query_id", "rank").collect()
        got.append(([tuple(r)[:3] for r in lists], [tuple(r)[:3] for r in found], [tuple(r)[:3] for r in exact]))
        assert lists and found and all(r["affinity"] > 0 for r in lists) and all(r["score"] > 0 for r in exact)
    assert got[0] == got[1]


def test_reports(spark):
    from partita.plans import report

    by = spark.createDataFrame([(1, 2.0, 1.0, 0.4, 0.2), (2, 0.0, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0, 0.0)], "list_rank int, avg_found double, cumul_recall double, mean_rel_pos double, std_rel_pos double")
    hist = spark.createDataFrame([(r, b, int(r == 1 and b < 2), 0.5 if r == 1 and b < 2 else 0.0) for r in (1, 2, 3) for b in range(10)], "list_rank int, bin int, n long, share double")
    text = report.coverage_report(by, hist, spark.createDataFrame([(1.0,)], "overall_recall double"))
    assert "overall recall 100.0 %" in text and "|##        |" in text and "ranks 2 to 3 find nothing more" in text
    assert report.profile([0.0, 0.02, 0.1, 0.19, 0.2, 1.0]) == " .++##"
    runs = spark.createDataFrame([("a", 0, 30, 0.95, 0.1, 5.0)], "config string, seq int, recall_at int, mean_recall double, std_recall double, cost double")
    out = report.runs_report(runs, E.optimal_per_target(runs))
    assert "recall@30 >= 0.95: a" in out and "recall@30 >= 0.96: None" in out


def small_search(spark, signs):
    """Queries and rows over few columns, with lists that overlap; rows past the tenth share no column with any query."""
    r = random.Random(5)
    x = [(d, c, float(r.choice(signs))) for d in range(30) for c in range(6) if r.random() < 0.4 and (d < 10) == (c < 4)]
    ranked = [(q, c, 1.0, i + 1) for q in range(4) for i, c in enumerate(r.sample(range(3), 3))]
    lists = [(c, p, d) for c in range(3) for p, d in enumerate(r.sample(range(30), 14))]
    frames = (
        spark.createDataFrame(x, "row_id long, col_id long, val double"), spark.range(28).withColumnRenamed("id", "doc_id"),
        spark.createDataFrame(ranked, "query_id long, comp int, q_score double, rank int"), spark.createDataFrame(lists, "comp int, pos int, doc_id long"),
    )
    return x, ranked, lists, frames


@pytest.mark.parametrize("signs", [(1, 2), (-2, -1, 1, 2)])
def test_naive_search_without_pairs_equals_scoring_every_candidate(spark, signs):
    x, ranked, lists, (xs, docs, rs, ls) = small_search(spark, signs)
    cells = {(r, c): v for r, c, v in x}
    for nprobe, factor in ((1, 1.0), (2, 1.0), (3, 0.5)):
        params, want, n = S.NaiveParams(nprobe, factor), [], 0
        for q in range(4):
            comps = {c for qq, c, _, rank in ranked if qq == q and rank <= nprobe}
            found = {d for c, p, d in lists if c in comps and p < S.list_depth(14, factor) and d < 28}
            n += len(found)
            scored = sorted((-sum(cells.get((q, c), 0) * cells.get((d, c), 0) for c in range(6)), d) for d in found)
            want += [(q, k, d, -s + 0.0) for k, (s, d) in enumerate(scored[:8], 1)]
        got = S.naive_search(xs.where("row_id < 4"), xs, docs, rs, ls, 14, 8, params).collect()
        assert sorted(tuple(g) for g in got) == sorted(want)
        assert S.count_candidates(rs, ls, docs, 14, params) == n


def test_naive_search_pairs_no_query_with_rows_that_share_nothing(spark, monkeypatch):
    _, _, _, (xs, docs, rs, ls) = small_search(spark, (1, 2))
    sizes, write = {}, S.Scratch.write

    def noted(self, df, name):
        out = write(self, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(S.Scratch, "write", noted)
    S.naive_search(xs.where("row_id < 4"), xs, docs, rs, ls, 14, 1, S.NaiveParams(3, 1.0)).collect()
    assert 0 < sizes["scored"] <= 4 * 10


def test_all_dots_lay_out_pairs_without_shuffling_them(spark, monkeypatch):
    from partita.operators import matrix as M

    monkeypatch.setattr(M, "LAID", 5)
    x, _, _, (xs, docs, _, _) = small_search(spark, (-1, 1, 2))
    cells = {(r, c): v for r, c, v in x}
    got = M.all_dots(xs, xs.where("row_id < 4"), docs)
    want = [(q, d, sum(cells.get((q, c), 0) * cells.get((d, c), 0) for c in range(6)) + 0.0) for q in {r for r, _, _ in x if r < 4} for d in range(28)]
    assert sorted(tuple(g) for g in got.collect()) == sorted(want)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().sparkPlan().toString()) and "NestedLoop" not in plan
