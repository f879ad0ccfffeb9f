"""HDF5 files in the layout of compressed-row matrices, an index and padded results; needs h5py, imported on use.

A file is written by the driver, a block of rows at a time, and must lie where every executor can open it to be read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import padded


def _rows(spark: SparkSession, n: int, rows_per_task: int) -> DataFrame:
    return spark.range(0, n, rows_per_task, max(1, -(-n // rows_per_task)))


def read_csr(spark: SparkSession, path: str, group: str = "train", rows_per_task: int = 100_000) -> DataFrame:
    """(row_id, col_id, val) of a group with data, indices, indptr and attribute shape; each task reads its own rows."""
    import h5py

    with h5py.File(path, "r") as f:
        n = int(f[group].attrs["shape"][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        with h5py.File(path, "r") as f:
            g = f[group]
            for b in batches:
                for start in b.column(0).to_pylist():
                    at = np.asarray(g["indptr"][start : min(n, start + rows_per_task) + 1]).astype(np.int64)
                    rows = np.repeat(np.arange(start, start + len(at) - 1), np.diff(at))
                    val, col = (np.asarray(g[name][at[0] : at[-1]]) for name in ("data", "indices"))
                    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(col.astype(np.int64)), pa.array(val.astype(np.float64))], ["row_id", "col_id", "val"])

    return _rows(spark, n, rows_per_task).mapInArrow(run, "row_id long, col_id long, val double").where("val <> 0")


def read_dense(spark: SparkSession, path: str, dataset: str, rows_per_task: int = 1000) -> DataFrame:
    """(row_id, col_id, val) of the nonzero cells of a two-dimensional dataset."""
    import h5py

    with h5py.File(path, "r") as f:
        if len(f[dataset].shape) != 2:
            raise ValueError(f"{dataset} does not have two dimensions")
        n = int(f[dataset].shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        with h5py.File(path, "r") as f:
            for b in batches:
                for start in b.column(0).to_pylist():
                    a = np.asarray(f[dataset][start : min(n, start + rows_per_task)])
                    r, c = np.nonzero(a)
                    yield pa.RecordBatch.from_arrays([pa.array(r + start), pa.array(c), pa.array(a[r, c].astype(np.float64))], ["row_id", "col_id", "val"])

    return _rows(spark, n, rows_per_task).mapInArrow(run, "row_id long, col_id long, val double")


def read_knns(spark: SparkSession, path: str, dataset: str = "otest/knns") -> DataFrame:
    """(query_id, knns) of a two-dimensional integer dataset, a table as long as the query set."""
    import h5py

    with h5py.File(path, "r") as f:
        if len(f[dataset].shape) != 2:
            raise ValueError("ground truth has two dimensions")
        rows = [(i, [int(v) for v in r]) for i, r in enumerate(np.asarray(f[dataset][:]))]
    return spark.createDataFrame(rows, "query_id long, knns array<long>")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The index's components (comp, col_id, val) and lists (comp, pos, doc_id)."""
    h = read_dense(spark, path, "index/H").select(F.col("row_id").cast("int").alias("comp"), "col_id", "val")
    lists = read_knns(spark, path, "index/lists").select(F.col("query_id").cast("int").alias("comp"), F.posexplode("knns").alias("pos", "doc_id"))
    return h, lists.where("doc_id >= 0")


def _replace(f, name: str, shape: tuple, dtype: str):
    if name in f:
        del f[name]
    return f.create_dataset(name, shape=shape, dtype=dtype)


def write_index(h: DataFrame, lists: DataFrame, k: int, n_cols: int, cap: int, path: str, **attributes) -> None:
    """Replaces index/H (k x n_cols) and index/lists (k x cap, ids from 0, -1 where there is none), a component at a time."""
    import h5py

    with h5py.File(path, "a") as f:
        dense, ids = _replace(f, "index/H", (k, n_cols), "f4"), _replace(f, "index/lists", (k, cap), "i4")
        rows = h.groupBy("comp").agg(F.collect_list(F.struct("col_id", "val")).alias("e"))
        for r in rows.toLocalIterator():
            line = np.zeros(n_cols, np.float32)
            line[[e["col_id"] for e in r["e"]]] = [e["val"] for e in r["e"]]
            dense[r["comp"]] = line
        for comp in range(k):
            ids[comp] = np.full(cap, -1, np.int32)
        for r in lists.groupBy("comp").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))).alias("e")).toLocalIterator():
            line = np.full(cap, -1, np.int32)
            line[: len(r["e"])] = [e["doc_id"] for e in r["e"]]
            ids[r["comp"]] = line
        for name, value in attributes.items():
            f.attrs[name] = value


def write_results(results: DataFrame, ids: DataFrame, width: int, path: str, **attributes) -> None:
    """knns (ids from 1, 0 where there is none) and dists, a row for each query by rising id; nothing without results."""
    import h5py

    if not results.limit(1).count():
        return
    n = ids.select("query_id").distinct().count()
    with h5py.File(path, "a") as f:
        knns, dists = _replace(f, "knns", (n, width), "i4"), _replace(f, "dists", (n, width), "f4")
        for i, r in enumerate(padded(results, ids, width).orderBy("query_id").toLocalIterator()):
            knns[i], dists[i] = np.array(r["knns"], np.int32), np.array(r["dists"], np.float32)
        for name, value in attributes.items():
            f.attrs[name] = value


def attribute(path: str, name: str, default: str = "unknown") -> str:
    """A root attribute as text."""
    import h5py

    with h5py.File(path, "r") as f:
        value = f.attrs.get(name, default)
    return value.decode() if isinstance(value, bytes) else str(value)
