"""Products with many components, in blocks of dense and sparse matrices.

The relational products of ``matrix`` make a row for each nonzero and component before they sum.  From
``BLOCKED_FROM`` components on, the functions here are used instead: entries are packed into blocks of bounded
size, blocks meet by their number, and NumPy multiplies them.  Results are the same up to the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ship

BLOCKED_FROM = 16
#: Rows of a block of X, and numbers of a block of the factor, which bounds its columns.
ROWS, NUMBERS = 4096, 1 << 20
#: Nonzeros that are multiplied at once.
STEP = 1 << 13
#: Tasks that each sum up stripes of a Gram matrix; numbers of a stripe, which a task holds, and of what they hand on.
GRAM_TASKS, STRIPE, PIECE = 64, 1 << 24, 1 << 17


def _tiles(m: DataFrame, row: str, col: str, rows: int, cols: int, names: tuple[str, str]) -> DataFrame:
    """(names[0], names[1], e): the entries of each block, places within the block from 0."""
    a, b = F.pmod(F.col(row).cast("long"), F.lit(rows)), F.pmod(F.col(col).cast("long"), F.lit(cols))
    entry = F.struct(a.cast("int").alias("r"), b.cast("int").alias("c"), F.col("val").alias("v"))
    blocks = [((F.col(row).cast("long") - a) / rows).cast("long").alias(names[0]), ((F.col(col).cast("long") - b) / cols).cast("long").alias(names[1])]
    return m.groupBy(*blocks).agg(F.collect_list(entry).alias("e"))


def _entries(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = column[i].values
    return tuple(e.field(n).to_numpy(zero_copy_only=False) for n in ("r", "c", "v"))


def product(x: DataFrame, row: str, col: str, factor: DataFrame, k: int) -> DataFrame:
    """(``row``, comp, val): the sparse matrix times a dense factor (comp, ``col``, val) over the columns."""
    ship(x.sparkSession)
    cols = max(16, NUMBERS // k)
    left = _tiles(x, row, col, ROWS, cols, ("rb", "cb"))
    right = _tiles(factor, "comp", col, 1 << 30, cols, ("kb", "cb")).select("cb", F.col("e").alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dense = None, None
        for b in batches:
            for i in range(b.num_rows):
                cb = b["cb"][i].as_py()
                if cb != now:
                    comp, at, val = _entries(b["f"], i)
                    now, dense = cb, np.zeros((cols, k))
                    dense[at, comp] = val
                r, c, v = _entries(b["e"], i)
                order = np.argsort(r, kind="stable")
                r, c, v = r[order], c[order], v[order]
                ids, out = np.unique(r), np.zeros((len(np.unique(r)), k))
                place = np.searchsorted(ids, r)
                for s in range(0, len(r), STEP):
                    p = place[s : s + STEP]
                    first = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1]
                    out[p[first]] += np.add.reduceat(v[s : s + STEP, None] * dense[c[s : s + STEP]], first, axis=0)
                at, comp = np.nonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int64) + b["rb"][i].as_py() * ROWS), pa.array(comp.astype(np.int32)), pa.array(out[at, comp])], [row, "comp", "val"])

    # rows that come out of a sort-merge join are in the order of cb, so each block of the factor is unpacked once a task
    met = left.join(right.hint("merge"), "cb").select("rb", "cb", "e", "f")
    return met.mapInArrow(run, f"{row} long, comp int, val double").groupBy(row, "comp").agg(F.sum("val").alias("val"))


def gram_blocks(factor: DataFrame, shared: str, k: int) -> DataFrame:
    """(first, data): rows of the k x k matrix of inner products of components, from row ``first`` on, as doubles.

    A task sums up one stripe of the matrix at a time, of at most ``STRIPE`` numbers; with many components the factor is read once
    for each stripe.  Pieces of at most ``PIECE`` numbers are then summed over the tasks.
    """
    ship(factor.sparkSession)
    rows = max(1, STRIPE // k)
    piece = max(1, min(rows, PIECE // k))
    packed = factor.groupBy(shared).agg(F.collect_list(F.struct(F.col("comp").cast("int").alias("r"), F.col("val").alias("v"))).alias("e"))
    if rows >= k:
        source = packed.select("e", F.lit(0).alias("first")).coalesce(GRAM_TASKS)
    else:
        source = packed.select(shared, "e", F.explode(F.array(*[F.lit(r) for r in range(0, k, rows)])).alias("first"))
        source = source.repartition(GRAM_TASKS, "first", F.pmod(F.xxhash64(shared), F.lit(8))).sortWithinPartitions("first").select("e", "first")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, g = None, None

        def flush() -> Iterator[pa.RecordBatch]:
            for s in range(0, 0 if g is None else len(g), piece):
                yield pa.RecordBatch.from_arrays([pa.array([now + s], pa.int32()), pa.array([g[s : s + piece].tobytes()], pa.binary())], ["first", "data"])

        for b in batches:
            first = b["first"].to_numpy()
            for s in range(0, b.num_rows, 256):
                for start in np.unique(first[s : s + 256]).tolist():
                    if start != now:
                        yield from flush()
                        now, g = start, np.zeros((min(rows, k - start), k))
                    at = s + np.flatnonzero(first[s : s + 256] == start)
                    e = b["e"].take(pa.array(at))
                    dense = np.zeros((len(e), k))
                    line = np.repeat(np.arange(len(e)), np.diff(e.offsets.to_numpy()))
                    flat = e.flatten()
                    dense[line, flat.field("r").to_numpy(zero_copy_only=False)] = flat.field("v").to_numpy(zero_copy_only=False)
                    g += dense[:, start : start + len(g)].T @ dense
        yield from flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            for first, data in zip(b["first"].to_pylist(), b["data"], strict=True):
                new = np.frombuffer(data.as_buffer())
                if first == now:
                    held += new
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["first", "data"])
                now, held = first, new.copy()
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["first", "data"])

    parts = source.mapInArrow(partial, "first int, data binary")
    return parts.repartition("first").sortWithinPartitions("first").mapInArrow(total, "first int, data binary")


def gram(factor: DataFrame, shared: str, k: int) -> DataFrame:
    """(a, b, val): inner products of components that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data in zip(b["first"].to_pylist(), b["data"], strict=True):
                g = np.frombuffer(data.as_buffer()).reshape(-1, k)
                a, c = np.nonzero(g)
                yield pa.RecordBatch.from_arrays([pa.array((a + first).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(g[a, c])], ["a", "b", "val"])

    return gram_blocks(factor, shared, k).mapInArrow(run, "a int, b int, val double")


def gram_array(factor: DataFrame, shared: str, k: int) -> np.ndarray:
    """The same as one array on the driver: k x k numbers, whatever the number of rows and columns."""
    out = np.zeros((k, k))
    for r in gram_blocks(factor, shared, k).collect():
        g = np.frombuffer(bytes(r["data"])).reshape(-1, k)
        out[r["first"] : r["first"] + len(g)] = g
    return out


def times(factor: DataFrame, g: DataFrame, shared: str, k: int) -> DataFrame:
    """(``shared``, comp, val): the factor times its Gram-shaped partner (a, b, val), a block of components at a time."""
    return product(factor.withColumnRenamed("comp", "_at"), shared, "_at", g.select(F.col("b").alias("comp"), F.col("a").alias("_at"), "val"), k)
