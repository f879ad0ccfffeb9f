"""Non-negative factorisation X ~ W H by multiplicative updates or hierarchical alternating least squares."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import partial
from math import inf, isnan, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import uniform
from ..storage import Scratch, ship
from .blocked import BLOCKED_FROM, gram_array
from .matrix import UNSENT, gram, times_gram, x_ht, xt_w

#: Fixed value: the floor of divisors, and what is added to the diagonal in the row-wise solver.
EPS = 1e-10
#: Up to so many components a Gram matrix (128 MB) goes to all tasks; beyond, updates multiply it block by block.
SENT = 4096


@dataclass(frozen=True)
class FactorConfig:
    n_components: int = 0  # 0: as many as columns
    max_iter: int = 100
    tol: float = 1e-4
    init: str = "acol"  # or "random"
    acol_p: int = 5
    compute_error: bool = True
    seed: int = 42
    solver: str = "mu"  # or "hals"
    w_sweeps: int = 1
    h_sweeps: int = 1

    def __post_init__(self):
        if self.init not in ("acol", "random"):
            raise ValueError(f"unknown init {self.init!r}")
        if self.solver not in ("mu", "hals"):
            raise ValueError(f"unknown solver {self.solver!r}")
        if self.max_iter < 0 or self.w_sweeps < 1 or self.h_sweeps < 1:
            raise ValueError("max_iter must not be negative, sweeps must be positive")


def scale_of(cell_mean: float, k: int) -> float:
    return sqrt(max(cell_mean, 1e-12) / max(k, 1))


def _dense_uniform(ids: DataFrame, id_col: str, k: int, high: float, seed: int) -> DataFrame:
    comps = ids.select(F.col(id_col), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("comp"))
    return comps.select(id_col, "comp", (uniform(id_col, "comp", seed) * F.lit(high)).alias("val"))


def random_init(rows: DataFrame, cols: DataFrame, k: int, cell_mean: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """W and H uniform in (0, 2 scale]; ``rows`` (row_id) and ``cols`` (col_id) list the dimensions."""
    s = 2 * scale_of(cell_mean, k)
    return _dense_uniform(rows, "row_id", k, s, seed), _dense_uniform(cols, "col_id", k, s, seed + 1).select("comp", "col_id", "val")


def acol_draws(spark, row_ids: DataFrame, n: int, k: int, p: int, seed: int = 0) -> DataFrame:
    """(comp, draw, row_id): p rows for each component, drawn with replacement; ``row_ids`` (place, row_id) number the rows from 0."""
    draws = spark.range(k * p).select((F.col("id") / p).cast("int").alias("comp"), (F.col("id") % p).cast("int").alias("draw"))
    place = F.least(F.floor(uniform("comp", "draw", seed) * n), F.lit(n - 1)).cast("long")
    return draws.withColumn("place", place).join(row_ids, "place").select("comp", "draw", "row_id")


def acol_init(x: DataFrame, rows: DataFrame, draws: DataFrame, k: int, p: int, cell_mean: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """H: each component the mean of its drawn rows (a row drawn twice counts twice); W uniform in (0, scale]."""
    h = draws.join(x, "row_id").groupBy("comp", "col_id").agg((F.sum("val") / F.lit(float(max(1, p)))).alias("val"))
    return _dense_uniform(rows, "row_id", k, scale_of(cell_mean, k), seed), h.where("val > 0")


def _multiplied(factor: DataFrame, top: DataFrame, low: DataFrame, shared: str) -> DataFrame:
    top = top.select("comp", shared, F.col("val").alias("_top")).hint(UNSENT)
    low = low.select("comp", shared, F.col("val").alias("_low")).hint(UNSENT)
    new = F.col("val") * F.coalesce("_top", F.lit(0.0)) / F.greatest(F.coalesce("_low", F.lit(0.0)), F.lit(EPS))
    out = factor.join(top, ["comp", shared], "left").join(low, ["comp", shared], "left")
    return out.select("comp", shared, F.greatest(new, F.lit(0.0)).alias("val")).where("val > 0")


def mu_update_w(x: DataFrame, w: DataFrame, h: DataFrame, k: int) -> DataFrame:
    """W <- W * (X H') / max(W (H H'), eps); zeros stay zeros and are absent."""
    top = x_ht(x, h, k)
    if BLOCKED_FROM <= k <= SENT:
        return _rows(w.select("row_id").distinct(), "row_id", top, w, gram_array(h, "col_id", k), _multiply)
    return _multiplied(w, top, times_gram(w, gram(h, "col_id", k), "row_id", k), "row_id").select("row_id", "comp", "val")


def mu_update_h(x: DataFrame, w: DataFrame, h: DataFrame, k: int) -> DataFrame:
    """H <- H * (W' X) / max((W' W) H, eps)."""
    top = xt_w(x, w, k)
    if BLOCKED_FROM <= k <= SENT:
        return _rows(h.select("col_id").distinct(), "col_id", top, h, gram_array(w, "row_id", k), _multiply).select("comp", "col_id", "val")
    return _multiplied(h, top, times_gram(h, gram(w, "row_id", k), "col_id", k), "col_id")


def _multiply(c: np.ndarray, w: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, w * c / np.maximum(w @ g, EPS))


def _descend(c: np.ndarray, w: np.ndarray, g: np.ndarray, sweeps: int) -> np.ndarray:
    """Cyclic non-negative coordinate descent on all rows at once.

    What the other components explain is summed anew at each step: a running sum would leave rounding where it should be zero,
    and with it entries that are not there.
    """
    others = g - np.diag(np.diag(g))
    for _ in range(sweeps):
        for r in range(len(g)):
            w[:, r] = np.maximum(0.0, (c[:, r] - w @ others[:, r]) / (g[r, r] + EPS))
    return w


def _rows(rows: DataFrame, id_col: str, target: DataFrame, factor: DataFrame, g: np.ndarray, step: Callable) -> DataFrame:
    """Updates every row of a factor alone: ``target`` are the right-hand sides, g the Gram matrix of the other factor."""
    ship(rows.sparkSession)
    k = len(g)

    def array(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("comp", "val"))).alias(name)).hint(UNSENT)

    def dense_of(name: str):
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.coalesce(F.try_element_at(name, c.cast("int")), F.lit(0.0)))

    joined = rows.join(array(target, "_c"), id_col, "left").join(array(factor, "_w"), id_col, "left")
    joined = joined.select(F.col(id_col).cast("long").alias(id_col), dense_of(F.col("_c")).alias("c"), dense_of(F.col("_w")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                c, w = (part.column(j).flatten().to_numpy(zero_copy_only=False).reshape(-1, k).copy() for j in (1, 2))
                w = step(c, w, g)
                at, comp = np.nonzero(w)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(comp.astype(np.int32)), pa.array(w[at, comp])], [id_col, "comp", "val"])

    return joined.mapInArrow(run, f"{id_col} long, comp int, val double")


def _descent_gram(factor: DataFrame, shared: str, k: int) -> np.ndarray:
    """The row-wise solver goes through all components of a row in turn, so each task needs the whole matrix."""
    if k > 2 * SENT:
        raise ValueError(f"{k} components are too many for the row-wise solver, which sends {8 * k * k >> 20} MB to each task")
    return gram_array(factor, shared, k)


def hals_update_w(x: DataFrame, w: DataFrame, h: DataFrame, rows: DataFrame, k: int, sweeps: int = 1) -> DataFrame:
    """One or more cyclic sweeps over the components of every row; a zero may come back, so all ``rows`` take part."""
    return _rows(rows, "row_id", x_ht(x, h, k), w, _descent_gram(h, "col_id", k), partial(_descend, sweeps=sweeps))


def hals_update_h(x: DataFrame, w: DataFrame, h: DataFrame, cols: DataFrame, k: int, sweeps: int = 1) -> DataFrame:
    """The same over the components of every column."""
    return _rows(cols, "col_id", xt_w(x, w, k), h, _descent_gram(w, "row_id", k), partial(_descend, sweeps=sweeps)).select("comp", "col_id", "val")


def squared_error(x: DataFrame, w: DataFrame, h: DataFrame, k: int = 0) -> DataFrame:
    """One row (err2): the squared Frobenius norm of X - W H, without forming W H.

    The inner product of X and W H is that of X H' and W, which needs a row per row and component only.
    """
    squares = x.agg(F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0)).alias("xx"))
    cross = x_ht(x, h, k).join(w.select("row_id", "comp", F.col("val").alias("_w")), ["row_id", "comp"])
    cross = cross.agg(F.coalesce(F.sum(F.col("val") * F.col("_w")), F.lit(0.0)).alias("xwh"))
    both = gram(w, "row_id", k).withColumnRenamed("val", "_w").join(gram(h, "col_id", k).withColumnRenamed("val", "_h"), ["a", "b"])
    both = both.agg(F.coalesce(F.sum(F.col("_w") * F.col("_h")), F.lit(0.0)).alias("whwh"))
    # three tables of one row each
    return squares.crossJoin(cross).crossJoin(both).select(F.greatest(F.lit(0.0), F.col("xx") - 2 * F.col("xwh") + F.col("whwh")).alias("err2"))


@dataclass
class Factors:
    w: DataFrame
    h: DataFrame
    k: int
    n_iter: int = 0
    error: float = -1.0
    #: (iteration from 1, error, improvement, relative improvement); empty without errors
    history: list[tuple[int, float, float, float]] = field(default_factory=list)


def fit(x: DataFrame, rows: DataFrame, cols: DataFrame, config: FactorConfig) -> Factors:
    """Alternates the updates of W and of H (with the new W) until the error settles or ``max_iter``.

    ``rows`` (row_id) and ``cols`` (col_id) list all rows and columns, those without entries included.  X must not be
    negative.  Without ``compute_error`` exactly ``max_iter`` iterations run.  Each iteration's factors are written to
    the shared folder, which cuts the plan's growth.
    """
    spark = x.sparkSession
    scratch = Scratch(spark)
    x = scratch.write(x.repartition("row_id"), "x")
    rows, cols = scratch.write(rows.select("row_id").distinct(), "rows"), scratch.write(cols.select("col_id").distinct(), "cols")
    n, f = rows.count(), cols.count()
    k = config.n_components if config.n_components > 0 else f
    if n == 0 or k < 1:
        raise ValueError("nothing to factor")
    mean = (x.agg(F.sum("val")).first()[0] or 0.0) / max(1, n * f)
    if config.init == "random":
        w, h = random_init(rows, cols, k, mean, config.seed)
    else:
        draws = acol_draws(spark, numbered(rows, scratch), n, k, max(1, config.acol_p), config.seed)
        w, h = acol_init(x, rows, draws, k, max(1, config.acol_p), mean, config.seed)
    w, h = scratch.write(w, "w-0"), scratch.write(h, "h-0")
    out, before = Factors(w, h, k), inf
    for i in range(1, config.max_iter + 1):
        if config.solver == "mu":
            w = scratch.write(mu_update_w(x, w, h, k), f"w-{i}")
            h = scratch.write(mu_update_h(x, w, h, k), f"h-{i}")
        else:
            w = scratch.write(hals_update_w(x, w, h, rows, k, config.w_sweeps), f"w-{i}")
            h = scratch.write(hals_update_h(x, w, h, cols, k, config.h_sweeps), f"h-{i}")
        scratch.drop(f"w-{i - 1}", f"h-{i - 1}")
        out = replace(out, w=w, h=h, n_iter=i)
        if config.compute_error:
            error = sqrt(squared_error(x, w, h, k).first()[0])
            relative = abs(before - error) / max(before, 1e-12) if before < inf else float("nan")
            out = replace(out, error=error, history=[*out.history, (i, error, before - error, relative)])
            if config.tol > 0 and not isnan(relative) and relative <= config.tol:
                break
            before = error
    return out


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(place, row_id): rows numbered from 0 by id, with one count per range of ids instead of one sorted task."""
    ranged = scratch.write(rows.select("row_id").orderBy("row_id").withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_m", 33)
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).count().collect())  # one number per partition
    first, total = {}, 0
    for p, n in sizes:
        first[p], total = total, total + n
    if not first:
        return ranged.select(F.col("_m").alias("place"), "row_id")
    start = F.element_at(F.create_map(*[F.lit(v) for kv in first.items() for v in kv]), part)
    return ranged.select((start + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("place"), "row_id")
