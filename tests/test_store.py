"""Storage, configurations and whole runs."""

import json

import pytest

from partita.operators.search import AdaptiveParams, NaiveParams
from partita.plans import run as R
from partita.plans.index import Index
from partita.sources import store


def test_readers_tell_forms_apart(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([(1, 2, 3.0), (1, 3, 0.0)], "row_id long, col_id int, val float").write.parquet(f"{base}/coo")
    spark.createDataFrame([(1, [2, 3], [3.0, 0.0])], "row_id long, indices array<int>, data array<float>").write.parquet(f"{base}/packed")
    spark.createDataFrame([(1, [0.0, 0.0, 3.0])], "row_id long, values array<float>").write.parquet(f"{base}/dense")
    spark.range(2).write.parquet(f"{base}/other")
    for form in ("coo", "packed", "dense"):
        df = store.read_matrix(spark, f"{base}/{form}")
        assert [tuple(r) for r in df.collect()] == [(1, 2, 3.0)] and df.schema.simpleString() == store.MATRIX.simpleString()
    with pytest.raises(ValueError):
        store.read_matrix(spark, f"{base}/other")


def test_compressed_rows(spark):
    got = sorted(map(tuple, store.csr_entries(spark, [1.0, 2.0, 0.0], [1, 0, 2], [0, 1, 1, 3], (3, 3)).collect()))
    assert got == [(0, 1, 1.0), (2, 0, 2.0)]
    with pytest.raises(ValueError):
        store.csr_entries(spark, [1.0], [5], [0, 1], (1, 3))


def test_results_and_attributes(spark, tmp_path):
    path = str(tmp_path / "out")
    found = spark.createDataFrame([(0, 1, 5, 2.0), (0, 2, 3, 1.0), (1, 1, 9, 4.0)], "query_id long, rank int, doc_id long, score double")
    ids = spark.range(3).withColumnRenamed("id", "query_id")
    store.write_results(found.where("query_id > 5"), ids, 3, path)
    assert store.attribute(spark, path, "algo") == ""
    store.write_results(found, ids, 3, path, params="a=1;", query_time_sec=2.5)
    rows = {r["query_id"]: r for r in spark.read.parquet(f"{path}/results").collect()}
    assert rows[0]["knns"] == [6, 4, 0] and rows[0]["dists"] == [2.0, 1.0, float("-inf")] and rows[2]["knns"] == [0, 0, 0]
    assert sorted(map(tuple, store.read_results(spark, path).collect())) == sorted(map(tuple, found.collect()))
    store.write_meta(spark, path, params="b=2;")
    assert store.read_meta(spark, path) == {"algo": store.ALGO, "task": store.TASK, "params": "b=2;", "query_time_sec": 2.5}


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("data") / "toy"
    rows = [(r, c, float((r * c) % 5 + 1)) for r in range(60) for c in range(12) if (r + c) % 3 == r % 2]
    x = spark.createDataFrame(rows, "row_id long, col_id long, val double")
    x.write.parquet(f"{base}/train")
    q = x.where("row_id % 10 = 0")
    q.write.parquet(f"{base}/queries")
    from partita.operators.search import exact_top_k, query_ids

    store.padded(exact_top_k(q, x, 5), query_ids(q), 5).select("query_id", "knns").write.parquet(f"{base}/knns")
    return base


@pytest.mark.parametrize("backend", ["naive", "adaptive"])
def test_whole_run(spark, dataset, tmp_path, backend):
    config = R.preset(
        "toy", data_dir=str(dataset.parent), n_components=3, max_iter=2, backend=backend, nprobe=3, max_misses=1000, drop_ratio=0.0, top_k=5,
        recall_ats=(5,), evaluate_recall=backend == "adaptive", debug=True, save_index=f"{tmp_path}/index", save_results=f"{tmp_path}/results",
    )
    out = R.run(spark, config)
    assert out["k"] == 3 and out["n_iter"] == 2 and len(out["history"]) == 2
    again = Index.load(spark, config.save_index)
    assert (again.k, again.cap, again.n_rows) == (3, 200, 60) and again.sizes().count() == 3
    values = R.evaluate_saved(spark, config.save_results, f"{dataset}/knns", 5, f"{tmp_path}/m.json", dataset="toy")
    # every list is probed by one strategy, those of positive components by the other
    assert values["recall@5"] >= (1.0 if backend == "naive" else 0.5) and json.load(open(f"{tmp_path}/m.json")) == values
    assert values["search_params"] == config.params().label()
    if backend == "adaptive":
        assert {r["recall_at"] for r in out["runs"]} == {5} and len(out["runs"]) == 6 and len(out["best"]) == 10
        by, hist, overall = R.coverage(spark, config, 20, 5)
        assert by.count() == 3 and hist.count() == 30 and 0 < overall.first()[0] <= 1
        assert R.k_sweep(spark, R.replace(config, evaluate_recall=False), (2,), [AdaptiveParams(1000, 0.0)], 0.5, 5)[0]["found"]
        assert R.sampling_recall(spark, config, (20,), (1,), NaiveParams(3)).count() == 1


def test_configuration(spark, tmp_path):
    nq = R.preset("nq", nprobe=3)
    assert (nq.n_components, nq.max_iter, nq.nprobe, nq.max_misses, nq.drop_ratio) == (3000, 25, 3, 80, 0.2)
    assert R.preset("unknown").n_components == 512
    assert store.params_text(8, 2, AdaptiveParams(80, 0.2)) == "n_components=8;max_iter=2;max_misses=80;dr=0.2"
    with pytest.raises(ValueError):
        R.RunConfig(backend="other").params()
    given = vars(R.parser().parse_args(["toy", "--n-components", "7", "--debug", "--no-save-index"]))
    assert given["n_components"] == 7 and given["debug"] is True and given["save_index"] == ""
    with pytest.raises(ValueError):
        Index.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        Index.build(None, None, None, None)


def test_stream_of_queries(spark, tmp_path):
    from partita.operators.search import exact_top_k
    from partita.streaming import search_stream

    x = spark.createDataFrame([(r, c, 1.0 + r) for r in range(6) for c in range(3)], store.MATRIX)
    x.where("row_id = 2").write.parquet(f"{tmp_path}/in")
    s = search_stream(spark.readStream.schema(store.MATRIX).parquet(f"{tmp_path}/in"), lambda q: exact_top_k(q, x, 2), f"{tmp_path}/out", f"{tmp_path}/cp")
    s.processAllAvailable()
    s.stop()
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [4, 5]


def test_stream_of_packed_queries(spark, tmp_path):
    from partita.operators.matrix import packed
    from partita.operators.search import exact_top_k
    from partita.streaming import search_stream

    x = spark.createDataFrame([(r, c, 1.0 + r) for r in range(6) for c in range(3)], store.MATRIX)
    packed(x.where("row_id in (1, 2)")).coalesce(1).write.parquet(f"{tmp_path}/in")
    kind = spark.read.parquet(f"{tmp_path}/in").schema
    s = search_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), lambda q: exact_top_k(q, x, 2), f"{tmp_path}/out", f"{tmp_path}/cp")
    s.processAllAvailable()
    s.stop()
    assert sorted((r["query_id"], r["doc_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 4), (1, 5), (2, 4), (2, 5)]


@pytest.mark.parametrize("indptr, indices, data", [([0, 2, 1], [0, 1], [1.0, 2.0]), ([1, 1, 2], [0, 1], [1.0, 2.0]), ([0, 1, 2], [0, -1], [1.0, 2.0]), ([0, 1], [0], [1.0])])
def test_arrays_that_make_no_matrix(spark, indptr, indices, data):
    with pytest.raises(ValueError):
        store.csr_entries(spark, data, indices, indptr, (2, 2))


def test_recall_sweep_over_a_saved_index(spark, dataset, tmp_path):
    config = R.preset("toy", data_dir=str(dataset.parent), n_components=2, max_iter=1, backend="adaptive", save_index=f"{tmp_path}/index", save_results="")
    R.run(spark, config)
    runs = R.recall_benchmark(spark, config, (1, 1000), (0.0, 0.5)).collect()
    assert [r["config"] for r in runs] == ["max_misses=1;dr=0", "max_misses=1;dr=0.5", "max_misses=1000;dr=0", "max_misses=1000;dr=0.5"]
    assert all(0 <= r["mean_recall"] <= 1 and r["qps"] > 0 for r in runs)
    assert len(R.grid(R.GRID_MISSES, R.GRID_RATIOS)) == 108
