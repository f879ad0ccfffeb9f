"""Exact top-k inner products by a three-phase uniform threshold.

Each vector's dimensions are cut into slices; a slice gives every query a list of partial scores over
all vectors, and the full score is their sum.  Vectors are grouped into cells around pivots and into blocks
of a cell, and each keeps, for every slice, bounds of what its vectors can score: the list's block maxima.

* Phase one reads the heads of the lists only: for every slice the cell with the highest bound, and the cell with the highest sum
  of bounds.  One block of each is resolved, and so a score is known that the k-th best cannot be below.
* Phase two sends every query that safe cutoff: a vector can only reach it if its partial score in at least one of m lists is the
  cutoff's m-th part or more, so only cells and blocks above that share in some list, and whose bounds sum up to the cutoff, are read.
* Phase three resolves the remaining scores of what was read, exactly, and keeps what reaches the cutoff.  Blocks are dealt to tiles of
  bounded size and queries are sent once to each tile that holds a cell left open, so queries are copied per tile and not per cell; a task
  holds one tile, through which its queries stream.

Scores are exact integers.  What is sent to all tasks are the bounds of at most ``CELLS`` cells for each length of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, table

SLICES = 4
#: Cells of vectors, about ``CELL`` vectors in each but never more than ``CELLS`` cells; their pivots are fitted on at most ``SAMPLE`` vectors.
CELLS, CELL, SAMPLE, ROUNDS = 1024, 256, 16384, 4
#: Vectors of a block, and queries that meet a block at once.
VECTOR_BLOCK, QUERY_BLOCK = 2048, 512
#: Components of the vectors that a task holds at once, and tiles that the vectors are dealt to at least.
TILE, TILES = 1 << 23, 16
#: Components are cut to what fits in a long after scaling; beyond these sizes sums are made of Python's integers and cut at the end.
LONG = 2**63 - 1
#: Stands for a cutoff where fewer than k entries are known.
NO_CUTOFF = -(2**63)


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): integer components floor(scale * x); null vectors, and those holding a null or non-finite one, go.

    A component beyond the range of a long is cut to it.
    """
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform("x", lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024)))).alias("x")
    )


def cuts(dim: int, slices: int) -> list[tuple[int, int]]:
    """The bounds of the slices of so many dimensions."""
    return [(int(c[0]), int(c[-1]) + 1) for c in np.array_split(np.arange(dim), slices) if len(c)] or [(0, 0)]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact, in the smallest type that holds every sum: floats, doubles, longs, else cut to longs."""
    most = a.shape[1] * (int(np.abs(a.astype(np.float64)).max()) if a.size else 0) * (int(np.abs(b.astype(np.float64)).max()) if b.size else 0)
    if most < 2**52:
        kind = np.float32 if most < 2**24 else np.float64
        return a.astype(kind) @ b.T.astype(kind)
    if most < 2**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -LONG, LONG).astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k first by falling score, then by rising id."""
    keep = np.arange(len(score))
    if len(score) > k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


class Bounds:
    """For groups of vectors of one length: middles, radii in every slice, and the least and greatest of every dimension."""

    def __init__(self, slices: int, middle: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.cuts, self.middle, self.radius, self.low, self.high = cuts(middle.shape[1], slices), middle, radius, low, high

    @classmethod
    def of(cls, x: np.ndarray, slices: int) -> Bounds:
        """Those of one group, around its middle."""
        x = x.astype(np.float64)
        middle = x.mean(axis=0, keepdims=True)
        far = [np.sqrt(((x[:, lo:hi] - middle[:, lo:hi]) ** 2).sum(axis=1).max()) for lo, hi in cuts(x.shape[1], slices)]
        return cls(slices, middle, np.array([far]), x.min(axis=0, keepdims=True), x.max(axis=0, keepdims=True))

    def partial(self, q: np.ndarray) -> np.ndarray:
        """(slice, query, group): what no vector of the group exceeds in a slice; the lesser of a ball's and a box's bound."""
        q, out = q.astype(np.float64), []
        for s, (lo, hi) in enumerate(self.cuts):
            part, middle = q[:, lo:hi], self.middle[:, lo:hi]
            long, far = np.sqrt((part**2).sum(axis=1))[:, None], self.radius[:, s][None, :]
            ball = part @ middle.T + long * far
            box = np.maximum(part, 0) @ self.high[:, lo:hi].T + np.minimum(part, 0) @ self.low[:, lo:hi].T
            reach = np.sqrt(np.maximum(self.low[:, lo:hi] ** 2, self.high[:, lo:hi] ** 2).sum(axis=1))[None, :] + far
            out.append(np.minimum(ball, box) + 1e-9 * long * reach + 1)  # more than the rounding of doubles
        return np.stack(out)


def passing(partial: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """(query, group): whether some list's bound reaches the cutoff's uniform share, and the sum of all the cutoff."""
    share = tau[:, None] / len(partial)
    return ((partial >= share).any(axis=0)) & (partial.sum(axis=0) >= tau[:, None])


def _matrix(column: pa.ListArray | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _compact(x: np.ndarray) -> tuple[str, bytes]:
    """The name of the smallest type that holds every number, and the numbers in it."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in ("int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, x.astype(kind).tobytes()


def _unpacked(b: pa.RecordBatch, i: int, n: int) -> np.ndarray:
    return np.frombuffer(b["data"][i].as_buffer(), b["kind"][i].as_py()).reshape(n, b["dim"][i].as_py())


def _by_length(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of the batch's vectors."""
    size = pc.list_value_length(b[column]).to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        yield int(d), np.flatnonzero(size == d)


def pivots(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Middles of at most ``cells`` cells for each length, fitted on a sample of at most ``SAMPLE`` vectors, those first by a hash."""
    rows = vectors.select("x").orderBy(F.xxhash64("vec_id", "x")).limit(SAMPLE).toArrow()["x"].to_pylist()
    by: dict[int, list] = {}
    for x in rows:
        by.setdefault(len(x), []).append(x)
    out = {}
    for d, some in by.items():
        x = np.array(some, np.float64).reshape(len(some), d)
        n = max(1, cells * len(some) // len(rows))
        middle = np.unique(x, axis=0)
        middle = middle[np.random.default_rng(1).permutation(len(middle))[:n]]
        for _ in range(rounds):
            near = nearest(x, middle)
            count = np.bincount(near, minlength=len(middle))
            total = np.stack([np.bincount(near, x[:, j], len(middle)) for j in range(d)], axis=1) if d else np.zeros((len(middle), 0))
            middle = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], middle)
        out[d] = middle
    return out


def nearest(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    square = (middle**2).sum(axis=1)[None, :]
    return np.concatenate([(square - 2 * x[k : k + 1024] @ middle.T).argmin(axis=1) for k in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


class Tiles:
    """Blocks in the order of their cells, cut into tiles of so many components at most, or one block more; no tile mixes lengths."""

    def __init__(self, sizes: dict[tuple[int, int], int]):
        self.at, self.n, self.block, share = {}, 0, VECTOR_BLOCK, -(-sum(sizes.values()) // TILES)
        for d in sorted({key[0] for key in sizes}):
            most, before = max(self.block, min(TILE // max(1, d), share)), 0
            for key in sorted(key for key in sizes if key[0] == d):
                self.at[key] = self.n, before, sizes[key], most
                before += sizes[key]
            self.n += before // most + 1

    def of(self, dim: int, cell: int, part: int) -> int:
        first, before, n, most = self.at[dim, cell]
        return first + (before + n * part // max(1, -(-n // self.block))) // most

    def reached(self, dim: int, cells: list[int]) -> tuple[int, np.ndarray]:
        """The first tile of a length, and (cell, tile from there) of 1 where a tile holds blocks of the cell."""
        last = [self.of(dim, c, max(0, -(-self.at[dim, c][2] // self.block) - 1)) for c in cells]
        first = [self.of(dim, c, 0) for c in cells]
        out = np.zeros((len(cells), max(last) + 1 - min(first)), np.float32)
        for row, lo, hi in zip(out, first, last, strict=True):
            row[lo - min(first) : hi + 1 - min(first)] = 1
        return min(first), out


BLOCK = "dim int, cell int, part long, tile int, ids array<long>, kind string, data binary, middle binary, radius binary, low binary, high binary"


def _index(vectors: DataFrame, slices: int, scratch: Scratch, cells: int) -> tuple[DataFrame, Tiles]:
    """Every vector in a block of its cell; a cell with more vectors has more blocks, so a hot one is spread out."""
    middles = pivots(vectors, cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, cell = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            for d, at in _by_length(b, "x"):
                dim[at] = d
                if d in middles:  # a length that is not in the sample is one cell
                    cell[at] = nearest(_matrix(b["x"].take(pa.array(at)), d).astype(np.float64), middles[d])
            yield pa.RecordBatch.from_arrays([pa.array(dim), pa.array(cell), b["vec_id"], b["x"]], ["dim", "cell", "vec_id", "x"])

    placed = scratch.write(vectors.select("vec_id", "x").mapInArrow(assign, "dim int, cell int, vec_id long, x array<long>"), "placed")
    size = scratch.write(placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
    tiles = Tiles({(r["dim"], r["cell"]): r["n"] for r in size.collect()})  # a number a cell
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / VECTOR_BLOCK)).cast("long")
    salted = placed.join(size, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), parts))
    packed = salted.groupBy("dim", "cell", "part").agg(F.collect_list(F.struct("vec_id", "x")).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, v = b["dim"][i].as_py(), b["v"][i].values
                x = _matrix(v.field("x"), dim)
                box = Bounds.of(x, slices)
                kind, data = _compact(x)
                made = [data, *(m.tobytes() for m in (box.middle, box.radius, box.low, box.high))]
                tile = tiles.of(dim, b["cell"][i].as_py(), b["part"][i].as_py())
                one = [pa.array([tile], pa.int32()), pa.array([v.field("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([kind]), *(pa.array([m], pa.binary()) for m in made)]
                names = ["dim", "cell", "part", "tile", "ids", "kind", "data", "middle", "radius", "low", "high"]
                yield pa.RecordBatch.from_arrays([b[c].slice(i, 1) for c in names[:3]] + one, names)

    return scratch.write(packed.mapInArrow(pack, BLOCK), "blocks"), tiles


class Cells:
    """The bounds of all cells: numbers of the order of the number of cells, whatever the number of vectors."""

    def __init__(self, blocks: DataFrame, slices: int):
        self.by: dict[int, tuple[np.ndarray, Bounds]] = {}
        held: dict[tuple[int, int], list] = {}

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A task's blocks of a cell as one ball and one box: the ball is around the first block's middle."""
            cells: dict[tuple[int, int], list] = {}
            for b in batches:
                for i in range(b.num_rows):
                    key = b["dim"][i].as_py(), b["cell"][i].as_py()
                    new = [np.frombuffer(b[c][i].as_py()) for c in ("middle", "radius", "low", "high")]
                    cells[key] = _joined(cells[key], new, slices) if key in cells else new
            if cells:
                cols = [pa.array([k[0] for k in cells], pa.int32()), pa.array([k[1] for k in cells], pa.int32())]
                cols += [pa.array([c[j].tobytes() for c in cells.values()], pa.binary()) for j in range(4)]
                yield pa.RecordBatch.from_arrays(cols, ["dim", "cell", "middle", "radius", "low", "high"])

        few = blocks.select("dim", "cell", "middle", "radius", "low", "high").coalesce(16)
        for r in few.mapInArrow(merged, "dim int, cell int, middle binary, radius binary, low binary, high binary").collect():
            new = [np.frombuffer(bytes(r[c])) for c in ("middle", "radius", "low", "high")]
            key = r["dim"], r["cell"]
            held[key] = _joined(held[key], new, slices) if key in held else new
        for d in {k[0] for k in held}:
            keys = sorted(k for k in held if k[0] == d)
            made = [np.array([held[k][j] for k in keys]) for j in range(4)]
            self.by[d] = np.array([k[1] for k in keys], np.int32), Bounds(slices, *made)


def _joined(a: list, b: list, slices: int) -> list:
    far = [max(a[1][s], np.sqrt(((a[0][lo:hi] - b[0][lo:hi]) ** 2).sum()) * (1 + 1e-12) + b[1][s]) for s, (lo, hi) in enumerate(cuts(len(a[0]), slices))]
    return [a[0], np.array(far), np.minimum(a[2], b[2]), np.maximum(a[3], b[3])]


def _sent(queries: DataFrame, cells: Cells) -> DataFrame:
    """The queries (query_id, x) once for each cell whose heads they read, packed: (dim, cell, q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(s, QUERY_BLOCK)
                for d, at in _by_length(part, "x"):
                    if d not in cells.by:
                        continue
                    names, bounds = cells.by[d]
                    found = bounds.partial(_matrix(part["x"].take(pa.array(at)), d))
                    best = np.concatenate([found.argmax(axis=2), found.sum(axis=0).argmax(axis=1)[None]]).T
                    row, cell = np.repeat(np.arange(len(at)), best.shape[1]), best.ravel()
                    pairs = np.unique(np.column_stack([row, cell]), axis=0)
                    row, cell = pairs[:, 0], pairs[:, 1]
                    here = part.take(pa.array(at[row]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d, np.int32)), pa.array(names[cell]), *here.columns], ["dim", "cell", *here.schema.names])

    made = queries.mapInArrow(run, "dim int, cell int, query_id long, x array<long>")
    # the queries of a hot cell are dealt to several packs
    size = made.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("packs"))
    salt = F.pmod(F.xxhash64("query_id", "x"), F.col("packs"))
    return made.join(size, ["dim", "cell"]).groupBy("dim", "cell", salt.alias("pack")).agg(F.collect_list(F.struct("query_id", "x")).alias("q")).drop("pack")


def _dealt(queries: DataFrame, cells: Cells, tiles: Tiles) -> DataFrame:
    """The queries (query_id, x, tau, last) once for each tile with a cell that their cutoff leaves, in packs."""
    reached = {d: tiles.reached(d, names.tolist()) for d, (names, _) in cells.by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(s, QUERY_BLOCK)
                for d, at in _by_length(part, "x"):
                    if d not in cells.by:
                        continue
                    x = _matrix(part["x"].take(pa.array(at)), d)
                    qid, tau, last = (part[c].to_numpy()[at] for c in ("query_id", "tau", "last"))
                    first, held = reached[d]
                    open_ = passing(cells.by[d][1].partial(x), tau.astype(np.float64)).astype(np.float32) @ held > 0
                    for t in np.flatnonzero(open_.any(axis=0)).tolist():
                        some = np.flatnonzero(open_[:, t])
                        kind, data = _compact(x[some])
                        cols = [pa.array([first + t], pa.int32()), pa.array([d], pa.int32()), pa.array([qid[some].tolist()], pa.list_(pa.int64())), pa.array([kind])]
                        cols += [pa.array([m], pa.binary()) for m in (data, tau[some].tobytes(), last[some].tobytes())]
                        yield pa.RecordBatch.from_arrays(cols, ["tile", "dim", "ids", "kind", "data", "tau", "last"])

    return queries.mapInArrow(run, "tile int, dim int, ids array<long>, kind string, data binary, tau binary, last binary")


FOUND = "query_id long, vec_ids array<long>, scores array<long>, resolved long"


def resolve(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int):
    """Each query's (id, vec_ids, scores, products made) of its best k in a block of vectors."""
    score = _product(q, v).astype(np.int64)
    for i, s in enumerate(score):
        at = np.flatnonzero(vid != qid[i])
        best = at[_first(s[at], vid[at], k)]
        yield int(qid[i]), vid[best].tolist(), s[best].tolist(), len(vid)


def resolve_tile(qid: np.ndarray, q: np.ndarray, tau: np.ndarray, last: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, Bounds]], k: int):
    """(query, vec_id, score) of the best k of each query in all blocks, of those that reach its cutoff, and the products made.

    ``query`` is a place in qid, ascending.  A query's cutoff rises with its k best so far.
    """
    tau, last, made = tau.copy(), last.copy(), np.zeros(len(qid), np.int64)
    row, vec, score = (np.zeros(0, np.int64) for _ in range(3))
    for vid, v, bounds in blocks:
        some = np.flatnonzero(passing(bounds.partial(q), tau.astype(np.float64))[:, 0])
        if not len(some):
            continue
        made[some] += len(vid)
        s = _product(q[some], v)
        # a cutoff beyond what the type holds is rounded, but never to below a score that misses it
        r, c = np.nonzero(s >= tau[some].astype(s.dtype)[:, None])
        r, new, at = some[r], s[r, c].astype(np.int64), vid[c]
        keep = (at != qid[r]) & ((new > tau[r]) | ((new == tau[r]) & (at <= last[r])))
        if not keep.any():
            continue
        row, vec, score = np.concatenate([row, r[keep]]), np.concatenate([vec, at[keep]]), np.concatenate([score, new[keep]])
        order = np.lexsort((vec, -score, row))
        row, vec, score = row[order], vec[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, vec, score, place = (m[place < k] for m in (row, vec, score, place))
        full = place == k - 1
        tau[row[full]], last[row[full]] = score[full], vec[full]
    return row, vec, score, made


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, vid = b["q"][i].values, b["ids"][i].values.to_numpy()
                out = list(resolve(rows.field("query_id").to_numpy(), _matrix(rows.field("x"), b["dim"][i].as_py()), vid, _unpacked(b, i, len(vid)), k))
                if out:
                    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["query_id", "vec_ids", "scores", "resolved"])

    return run


def _scan_tiles(k: int, slices: int):
    """Of each tile come its blocks first, which are held, then packs of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                if b["tile"][i].as_py() != now:
                    now, held = b["tile"][i].as_py(), []
                ids = b["ids"][i].values.to_numpy()
                x = _unpacked(b, i, len(ids))
                if not b["pack"][i].as_py():
                    box = [np.frombuffer(b[c][i].as_py())[None, :] for c in ("middle", "radius", "low", "high")]
                    held.append((ids.copy(), x.copy(), Bounds(slices, *box)))
                    continue
                row, vec, score, made = resolve_tile(ids, x.astype(np.int64), *(np.frombuffer(b[c][i].as_buffer(), np.int64) for c in ("tau", "last")), held, k)
                ends = pa.array(np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32))
                out = [pa.array(ids), *(pa.ListArray.from_arrays(ends, pa.array(m)) for m in (vec, score)), pa.array(made)]
                yield pa.RecordBatch.from_arrays(out, ["query_id", "vec_ids", "scores", "resolved"])

    return run


def _entries(found: DataFrame, k: int) -> DataFrame:
    """The k best entries of each query."""
    e = found.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("e"))
    e = e.select("query_id", F.col("e.vec_ids").alias("vec_id"), F.col("e.scores").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return e.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)


def phases(queries: DataFrame, vectors: DataFrame, k: int, slices: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What phases one and three resolved, as (query_id, vec_ids, scores, resolved); the second holds the result."""
    cells = min(CELLS, max(1, vectors.count() // CELL))
    blocks, tiles = _index(vectors, slices, scratch, cells)
    bounds = Cells(blocks, slices)
    one = scratch.write(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("x")), "queries")
    # a block and a pack of queries are of bounded size, and meet once; neither side goes to the driver, whatever its size is taken for
    heads = _sent(one, bounds).join(blocks.where("part = 0").hint("merge"), ["dim", "cell"]).select("dim", "q", "ids", "kind", "data").mapInArrow(_scan(k), FOUND)
    heads = scratch.write(heads, "heads")
    kth = _entries(heads, k).groupBy("query_id").agg(F.min("score").alias("least"), F.max_by("vec_id", "rank").alias("last"), F.count(F.lit(1)).alias("n"))
    known = F.col("n") >= k
    cut = one.join(kth, "query_id", "left").select("query_id", "x", F.when(known, F.col("least")).otherwise(F.lit(NO_CUTOFF)).alias("tau"), F.when(known, F.col("last")).otherwise(F.lit(LONG)).alias("last"))
    cut = scratch.write(cut, "cut")
    shown = blocks.select("tile", F.lit(False).alias("pack"), "dim", "ids", "kind", "data", "middle", "radius", "low", "high")
    met = shown.unionByName(_dealt(cut, bounds, tiles).withColumn("pack", F.lit(True)), allowMissingColumns=True)
    met = met.repartition(max(1, 2 * tiles.n), "tile").sortWithinPartitions("tile", "pack")
    rest = met.mapInArrow(_scan_tiles(k, slices), FOUND)
    return heads, scratch.write(rest, "rest")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the highest inner product for each query.

    Both inputs hold (vec_id long, x array<long>) without nulls, as ``quantised`` gives them.  Ties go to the
    smaller vec_id.  A query meets every row but those of its own vec_id; rows that repeat vec_id and
    components are entries of their own, and a vec_id queried with several vectors is queried with the smallest.  Vectors
    of another length than the query's take no part.  Scores beyond the range of a long are cut to it.  Fewer vectors than k give
    them all; an empty table, none.
    """
    _, found = phases(queries, vectors, k, slices, Scratch(vectors.sparkSession))
    return _entries(found, k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), q AS (
  SELECT vec_id, MIN(x) AS x FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
QUERIES = {"op3_top_k": op3_top_k}
ORACLES = {"op3_top_k": SQL}
