"""The index: factors and lists, built, saved, loaded and searched."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.factor import FactorConfig, Factors, fit
from ..operators.lists import OVERLAP, build_lists, list_cap, list_sizes
from ..operators.matrix import sample_rows
from ..operators.search import AdaptiveParams, NaiveParams, query_ids, search
from ..sources.store import params_text, read_index, read_meta, write_index, write_results
from ..storage import Scratch

SAMPLE_SIZE = 150_000


@dataclass
class Index:
    h: DataFrame
    lists: DataFrame
    k: int
    cap: int
    n_rows: int
    n_cols: int
    max_iter: int = 0
    build_time_sec: float = 0.0
    factors: Factors | None = None

    @classmethod
    def build(cls, x: DataFrame, rows: DataFrame, cols: DataFrame, config: FactorConfig, sample_size: int = SAMPLE_SIZE, overlap: float = OVERLAP) -> Index:
        """Learns the components on a seeded sample of at most ``sample_size`` rows and lists all rows of X."""
        if x is None or config is None:
            raise ValueError("a matrix and a configuration are needed")
        began = time.time()
        scratch = Scratch(x.sparkSession)
        n, f = rows.select("row_id").distinct().count(), cols.select("col_id").distinct().count()
        part, part_rows = x, rows
        if n > sample_size:
            part = scratch.write(sample_rows(x, sample_size, config.seed), "sample")
            part_rows = part.select("row_id").distinct()
        found = fit(part, part_rows, cols, config)
        cap = list_cap(n, found.k, overlap)
        lists = scratch.write(build_lists(x, found.h, cap, found.k), "lists")
        return cls(found.h, lists, found.k, cap, n, f, config.max_iter, time.time() - began, found)

    def search(self, queries: DataFrame, x: DataFrame, docs: DataFrame, top_k: int, params: NaiveParams | AdaptiveParams | None = None) -> DataFrame:
        return search(queries, x, docs, self.h, self.lists, self.k, self.cap, top_k, params)

    def search_and_save(self, queries: DataFrame, x: DataFrame, docs: DataFrame, top_k: int, path: str, params: NaiveParams | AdaptiveParams | None = None) -> DataFrame:
        """Searches, times the whole search, and saves the padded results and their attributes."""
        began = time.time()
        found = Scratch(x.sparkSession).write(self.search(queries, x, docs, top_k, params), "found")
        text = params_text(self.k, self.max_iter, params or NaiveParams())
        write_results(
            found, query_ids(queries), top_k, path, query_time_sec=time.time() - began, build_time_sec=self.build_time_sec,
            params=text, build_params=f"n_components={self.k};max_iter={self.max_iter}", search_params=(params or NaiveParams()).label(),
        )
        return found

    def sizes(self) -> DataFrame:
        return list_sizes(self.lists, self.k)

    def save(self, path: str) -> None:
        write_index(self.h, self.lists, path, build_time_sec=self.build_time_sec, k=self.k, cap=self.cap, n_rows=self.n_rows, n_cols=self.n_cols, build_params=f"n_components={self.k};max_iter={self.max_iter}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        if "k" not in read_meta(spark, path):
            raise ValueError(f"no index at {path}")
        h, lists, meta = read_index(spark, path)
        return cls(h, lists, meta["k"], meta["cap"], meta["n_rows"], meta["n_cols"], build_time_sec=meta.get("build_time_sec", 0.0))


def ids_of(x: DataFrame) -> DataFrame:
    return x.select(F.col("row_id").alias("doc_id")).distinct()
