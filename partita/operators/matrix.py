"""Sparse matrices as (row_id, col_id, val) tables without zeros; dense factors W (row_id, comp, val), H (comp, col_id, val)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ship
from . import blocked

#: Factors are made from the short table of their ids, and so taken for small; joined like this they are not sent to the driver.
UNSENT = "merge"
#: Rows that a query is laid out against at once.
LAID = 1024


def coo(df: DataFrame, row: str, col: str, val: str) -> DataFrame:
    """A sparse matrix of summed values; zeros and nulls are absent."""
    summed = df.groupBy(F.col(row).alias("row_id"), F.col(col).alias("col_id")).agg(F.sum(val).cast("double").alias("val"))
    return summed.where("val <> 0 and row_id is not null and col_id is not null")


def stats(x: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(n_rows, n_cols, nnz, total, cell_mean): the mean counts every cell, zeros included."""
    cells = max(1, n_rows * n_cols)
    return x.agg(
        F.lit(n_rows).cast("long").alias("n_rows"), F.lit(n_cols).cast("long").alias("n_cols"), F.count(F.lit(1)).alias("nnz"),
        F.coalesce(F.sum("val"), F.lit(0.0)).alias("total"), (F.coalesce(F.sum("val"), F.lit(0.0)) / cells).alias("cell_mean"),
    )


def x_ht(x: DataFrame, h: DataFrame, k: int = 0) -> DataFrame:
    """X times H transposed: (row_id, comp, val); absent where no nonzero meets.  Many components ``k`` are multiplied in blocks; 0: not known."""
    if k >= blocked.BLOCKED_FROM:
        return blocked.product(x, "row_id", "col_id", h, k)
    if k > 0:
        return _few(x, "row_id", "col_id", h, k)
    h = h.select("comp", "col_id", F.col("val").alias("_h")).hint(UNSENT)
    return x.join(h, "col_id").groupBy("row_id", "comp").agg(F.sum(F.col("val") * F.col("_h")).alias("val"))


def _few(x: DataFrame, row: str, col: str, factor: DataFrame, k: int) -> DataFrame:
    """(``row``, comp, val): the product over ``col``, with a column of sums for each component, so that an entry of X is shuffled once and not k times."""
    wide = factor.groupBy(col).agg(*[F.sum(F.when(F.col("comp") == c, F.col("val"))).alias(f"_{c}") for c in range(k)]).hint(UNSENT)
    sums = x.join(wide, col).groupBy(row).agg(*[F.sum(F.col("val") * F.col(f"_{c}")).alias(f"_{c}") for c in range(k)])
    comp = factor.schema["comp"].dataType
    e = F.explode(F.array(*[F.struct(F.lit(c).cast(comp).alias("comp"), F.col(f"_{c}").alias("val")) for c in range(k)])).alias("e")
    return sums.select(row, e).select(row, "e.comp", "e.val").where("val is not null")


def xt_w(x: DataFrame, w: DataFrame, k: int = 0) -> DataFrame:
    """X transposed times W, given as (comp, col_id, val)."""
    if k >= blocked.BLOCKED_FROM:
        return blocked.product(x, "col_id", "row_id", w, k).select("comp", "col_id", "val")
    if k > 0:
        return _few(x, "col_id", "row_id", w, k).select("comp", "col_id", "val")
    w = w.select("row_id", "comp", F.col("val").alias("_w")).hint(UNSENT)
    return x.join(w, "row_id").groupBy("comp", "col_id").agg(F.sum(F.col("val") * F.col("_w")).alias("val"))


def gram(factor: DataFrame, shared: str, k: int = 0) -> DataFrame:
    """(a, b, val): inner products of components over the ``shared`` dimension, col_id for H and row_id for W."""
    if k >= blocked.BLOCKED_FROM:
        return blocked.gram(factor, shared, k)
    one = factor.select(F.col(shared), F.col("comp").alias("a"), F.col("val").alias("_a"))
    two = factor.select(F.col(shared), F.col("comp").alias("b"), F.col("val").alias("_b")).hint(UNSENT)
    return one.join(two, shared).groupBy("a", "b").agg(F.sum(F.col("_a") * F.col("_b")).alias("val"))


def times_gram(factor: DataFrame, g: DataFrame, shared: str, k: int) -> DataFrame:
    """The factor multiplied by its k x k Gram-shaped partner along the components: (comp, ``shared``, val)."""
    if k >= blocked.BLOCKED_FROM:
        return blocked.times(factor, g, shared, k).select("comp", shared, "val")
    g = F.broadcast(g.select("a", "b", F.col("val").alias("_g")))  # a few hundred numbers
    joined = factor.join(g, factor["comp"] == g["a"])
    return joined.groupBy(F.col("b").alias("comp"), shared).agg(F.sum(F.col("val") * F.col("_g")).alias("val"))


def row_dots(x: DataFrame, q: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): exact sparse inner products of given pairs; 0 where nothing is shared."""
    qv = q.select(F.col("row_id").alias("query_id"), "col_id", F.col("val").alias("_q"))
    xv = x.select(F.col("row_id").alias("doc_id"), "col_id", F.col("val").alias("_x"))
    met = pairs.join(qv, "query_id").join(xv, ["doc_id", "col_id"])
    dots = met.groupBy("query_id", "doc_id").agg(F.sum(F.col("_q") * F.col("_x")).alias("_dot"))
    return pairs.join(dots, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("_dot", F.lit(0.0))).drop("_dot")


def all_dots(x: DataFrame, q: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): exact inner products of every query and every row of ``docs`` (doc_id); 0 where nothing is shared.

    Products are made by column, and so only of pairs that share one; the other pairs are laid out beside them, a query and
    ``LAID`` rows at a time, and are never shuffled.
    """
    ship(x.sparkSession)
    parts = max(1, -(-docs.count() // LAID))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part")
    qv = q.select(F.col("row_id").alias("query_id"), "col_id", F.col("val").alias("_q"))
    xv = x.select(F.col("row_id").alias("doc_id"), "col_id", F.col("val").alias("_x")).join(docs, "doc_id", "left_semi")
    dots = qv.join(xv, "col_id").groupBy("query_id", "doc_id").agg(F.sum(F.col("_q") * F.col("_x")).alias("score"))
    near = dots.groupBy("query_id", part).agg(F.array_sort(F.collect_list(F.struct("doc_id", "score"))).alias("near"))
    grid = qv.select("query_id").distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    rows = docs.groupBy(part).agg(F.collect_list("doc_id").alias("ids")).hint(UNSENT)
    met = grid.join(near.hint(UNSENT), ["query_id", "part"], "left").join(rows, "part").select("query_id", "ids", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = b["ids"][i].values.to_numpy()
                score = np.zeros(len(ids))
                if b["near"][i].is_valid:
                    known, dot = (b["near"][i].values.field(c).to_numpy() for c in ("doc_id", "score"))
                    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                    score = np.where(known[at] == ids, dot[at], 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), b["query_id"][i].as_py())), pa.array(ids), pa.array(score)], ["query_id", "doc_id", "score"])

    return met.mapInArrow(run, "query_id long, doc_id long, score double")


def sample_rows(x: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """The entries of exactly min(size, rows) rows, chosen by a seeded hash; ``size`` bounds the chosen ids."""
    from ..functions.numbers import uniform

    ids = x.select("row_id").distinct().orderBy(uniform("row_id", F.lit(0), seed), "row_id").limit(size)
    return x.join(ids, "row_id", "left_semi")


def renumbered(x: DataFrame, ids: DataFrame) -> DataFrame:
    """X with row_id replaced by its place from 0 in ``ids`` (row_id, place)."""
    return x.join(ids, "row_id").select(F.col("place").alias("row_id"), "col_id", "val")


def dense(df: DataFrame, row: str, values: str, clip: bool = False) -> DataFrame:
    """The nonzero entries of rows that hold one array each; ``clip`` drops what is below zero too."""
    out = df.select(F.col(row).alias("row_id"), F.posexplode(values).alias("col_id", "val"))
    out = out.withColumn("val", F.col("val").cast("double"))
    return out.where("val > 0" if clip else "val <> 0")


def packed(x: DataFrame) -> DataFrame:
    """(row_id, indices, data): each row's entries by column, as arrays."""
    e = x.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "val"))).alias("e"))
    return e.select("row_id", F.col("e.col_id").alias("indices"), F.col("e.val").alias("data"))


def unpacked(rows: DataFrame) -> DataFrame:
    """The inverse of ``packed``."""
    e = F.explode(F.arrays_zip("indices", "data")).alias("e")
    return rows.select("row_id", e).select("row_id", F.col("e.indices").alias("col_id"), F.col("e.data").cast("double").alias("val"))
