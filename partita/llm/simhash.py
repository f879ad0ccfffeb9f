"""SimHash near-duplicate detection over a Gray-ordered hierarchical index.

The distinct fingerprints are sorted by Gray rank, all in one order; neighbours share many bits, so each run of
eight is summed up by the bits all of them share (mask and pattern), runs of eight nodes likewise, up to the top.
A fingerprint walks the tree from the top and leaves a whole group as soon as its differences on the
shared bits exceed the budget.  The order is cut into leaves, each held by a task; the tree above the leaves, whose size is
bounded, is sent to all tasks, so a fingerprint goes only to leaves that it may have neighbours in, and walks on there.
Every pair is met once, in the leaf of the later fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, lean, table

FAN = 8
SEED = 42
#: Fingerprints of a leaf, the fewest leaves and the most, beyond which they grow; fingerprints that meet a leaf in one task, and walk at once.
LEAF, SPREAD, LEAVES, COMERS, WALKED = 1 << 15, 32, 2048, 1 << 16, 256
#: Texts of a band that are compared in one task; larger bands are dealt out as tiles.
TILE = 2048
#: Places of a sketch, and in how many of them two texts at 0.8 may differ: 24 are expected, with a standard deviation of 4.4.
PLACES, WIDE = 128, 48
#: Least values that make a band, and bands of a text: of pairs at 0.8 one in 300,000 shares none.
BAND, BANDS = 4, 24
#: Texts whose shingles are compared in one task, and bytes of them that are held for one round.
SETS, HELD = 1024, 1 << 26
#: Pairs whose sketches are compared at once.
STEP = 1 << 15
_RNG = np.random.default_rng(5)
_ODD = _RNG.integers(0, 2**31, PLACES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = _RNG.integers(0, 2**32, PLACES, dtype=np.uint32)


def _shingles(text: bytes | None, shingle: int) -> bytes:
    """The 8-byte hashes of all shingles of a whole text (UTF-8), repeats included; none without words."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return b""
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = list(accumulate([len(w) + 1 for w in words]))
    return b"".join([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 where it has no word."""
    return _majority(_shingles(text, shingle))


def _majority(hashes: bytes) -> int:
    """The fingerprint of 8-byte hashes, which are big-endian."""
    raw = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(raw), 1 << 15):
        ones += np.unpackbits(raw[k : k + (1 << 15)], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big")


def _distinct(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.frombuffer(_shingles(text, shingle), ">u8").astype(np.uint64))


def _minima(h: np.ndarray) -> np.ndarray:
    """The least of each of ``PLACES`` hashes over some hashes of shingles."""
    h = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 1 << 11):
        np.minimum(least, (h[k : k + (1 << 11)] * _ODD[:, None] ^ _MIX[:, None]).min(axis=1), out=least)
    return least


def _packed(least: np.ndarray) -> bytes:
    # the least values are small, so their bits are mixed before some are kept
    nibble = (least * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8)
    return (nibble[::2] << 4 | nibble[1::2]).tobytes()


def sketch(text: bytes | None, shingle: int = 5) -> bytes:
    """The lowest four bits of the least of each of ``PLACES`` hashes over a text's shingles; zeros without words.

    Of two texts with a Jaccard similarity J of their shingles, a share of J + (1 - J) / 16 of the places agree.
    """
    h = _distinct(text, shingle)
    return _packed(_minima(h)) if len(h) else bytes(PLACES // 2)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places the sketches a and b, rows of 64-bit words, differ."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, hash, text as bytes); ``hash`` is the text's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).cast("binary").alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, hash, fp): one row per document; fp is the fingerprint over shingles of so many words as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made)], ["doc_id", "hash", "fp"])

    return _texts(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, hash long, fp long")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, hash, node, fp, second, bands): one row per document.

    ``node`` is a number of the set of shingles, ``fp`` the fingerprint, ``second`` the sketch, and ``bands`` numbers of ``BANDS`` groups
    of least values; a text without words has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, second, bands = [], [], [], []
            for t in b.column(2):
                raw = _shingles(t.as_py(), shingle)
                fp.append(_majority(raw))
                h = np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))
                least = _minima(h)
                node.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                second.append(_packed(least))
                bands.append([xxhash.xxh3_64_intdigest(least[k * BAND : (k + 1) * BAND].tobytes(), k) - (1 << 63) for k in range(BANDS)] if len(h) else [])
            made = [pa.array(node, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(second, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "hash", "node", "fp", "second", "bands"])

    return _texts(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, hash long, node long, fp long, second binary, bands array<long>")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each uint64 in the sequence of Gray codes."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of i and j: the smallest index of each set."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


class Tree:
    """Levels of summed-up fingerprints over a Gray order.

    Level 0 are fingerprints, or groups of them given by the bits that all share: the ``mask`` of these bits and their
    ``pattern``.  A node of a higher level sums up ``FAN`` neighbours by what their patterns share, up to at most ``FAN`` nodes at the top.
    """

    def __init__(self, pattern: np.ndarray, mask: np.ndarray | None = None):
        self.masked = mask is not None
        mask = mask if self.masked else np.full(len(pattern), ~np.uint64(0))
        self.levels, self.visits = [(pattern, mask)], 0
        while len(self.levels[-1][0]) > FAN:
            pattern, mask = self.levels[-1]
            cut = np.arange(0, len(pattern), FAN)
            low, high = np.bitwise_and.reduceat(pattern, cut), np.bitwise_or.reduceat(pattern, cut)
            shared = np.bitwise_and.reduceat(mask, cut) & ~(low ^ high)
            self.levels.append((low & shared, shared))

    def walk(self, x: np.ndarray, start: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, place at level 0) of all pairs that differ in ``bits`` or fewer shared bits, from place ``start`` on.

        A fingerprint leaves a whole group as soon as its differences on the bits the group shares exceed ``bits``.
        """
        top, before = len(self.levels) - 1, bool(start.any())
        size = len(self.levels[top][0])
        q, node = np.repeat(np.arange(len(x), dtype=np.int32), size), np.tile(np.arange(size, dtype=np.int32), len(x))
        for depth in range(top, -1, -1):
            pattern, mask = self.levels[depth]
            if before:
                keep = node >= (start // FAN**depth)[q]
                q, node = q[keep], node[keep]
            self.visits += len(q)
            differ = x[q]
            differ ^= pattern[node]
            if depth or self.masked:
                differ &= mask[node]
            keep = np.flatnonzero(np.bitwise_count(differ) <= bits)
            q, node = q[keep], node[keep]
            if depth:
                q, node = np.repeat(q, FAN), (node[:, None] * np.int32(FAN) + np.arange(FAN, dtype=np.int32)).ravel()
                if len(node) and len(self.levels[depth - 1][0]) % FAN:
                    keep = node < len(self.levels[depth - 1][0])
                    q, node = q[keep], node[keep]
        return q, node


class Leaf:
    """The fingerprints of a stretch of the Gray order, in order, which are joined with all that come to it."""

    def __init__(self, fps: np.ndarray, rank: np.ndarray, bits: int):
        self.tree, self.rank, self.bits = Tree(fps), rank, bits
        self.label = np.arange(len(fps))

    def meet(self, x: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins fingerprints with the later ones of the leaf that they are near.

        Returns (place in x, place in the leaf) of one link for each fingerprint that is not the leaf's own; all other links are
        kept as labels of the leaf's places.
        """
        here, there = [], []
        for s in range(0, len(x), WALKED):
            some, ranks = x[s : s + WALKED], rank[s : s + WALKED]
            start = np.searchsorted(self.rank, ranks, "right")
            q, at = self.tree.walk(some, start, self.bits)
            if not len(q):
                continue
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if (q[1:] >= q[:-1]).all() else np.unique(q, return_index=True)[1]
            one = np.zeros(len(some), np.int64)
            one[q[first]] = at[first]
            own = (start > 0) & (self.rank[np.maximum(start, 1) - 1] == ranks)
            base = np.where(own, start - 1, one)
            self.label = _merge(self.label, base[q], at)
            come = q[first][~own[q[first]]]
            here.append(come + s)
            there.append(one[come])
        empty = np.zeros(0, np.int64)
        return np.concatenate(here or [empty]), np.concatenate(there or [empty])

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, first place) of the leaf's own fingerprints that are linked."""
        rest = np.flatnonzero(self.label != np.arange(len(self.label)))
        return rest, self.label[rest]


def _signed_rank(fp: np.ndarray) -> np.ndarray:
    """The place in the sequence of Gray codes as a long whose order is the order of places."""
    return (gray_rank(fp.view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64)


def _rank(fp: str) -> F.Column:
    """The same as an expression."""
    x = F.col(fp)
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def leaves_of(prints: DataFrame, scratch: Scratch, leaf: int = LEAF) -> DataFrame:
    """(fp, leaf): fingerprints by stretches of the Gray order, cut at approximate quantiles.

    There are ``SPREAD`` stretches, as many as it takes for ``leaf`` fingerprints in each, or ``LEAVES`` longer ones.
    """
    n = max(1, min(LEAVES, max(SPREAD, -(-prints.count() // leaf))))
    at = [k / n for k in range(1, n)] or [0.5]
    cut = np.unique(np.array(prints.agg(F.percentile_approx(_rank("fp"), at, 20 * n)).first()[0] or [], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = _signed_rank(b["fp"].to_numpy())
            yield pa.RecordBatch.from_arrays([b["fp"], pa.array(np.searchsorted(cut, rank, "right").astype(np.int32))], ["fp", "leaf"])

    return scratch.write(prints.select("fp").mapInArrow(lean(run), "fp long, leaf int"), "leaves")


def upper_tree(placed: DataFrame) -> tuple[np.ndarray, Tree]:
    """The numbers of the leaves, and the tree over what the fingerprints of each share: a few numbers for each leaf."""
    rows = sorted(tuple(r) for r in placed.groupBy("leaf").agg(F.bit_and("fp"), F.bit_or("fp")).collect())
    low, high = (np.array([r[k] for r in rows], np.int64).view(np.uint64) for k in (1, 2))
    return np.array([r[0] for r in rows], np.int64), Tree(low & ~(low ^ high), ~(low ^ high))


def routed(placed: DataFrame, names: np.ndarray, tree: Tree, bits: int) -> DataFrame:
    """(fp, leaf): every fingerprint in its own leaf, and in each later leaf that the differences on its shared bits leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, WALKED):
                part = b.slice(s, WALKED)
                own = np.searchsorted(names, part["leaf"].to_numpy())
                q, at = tree.walk(part["fp"].to_numpy().view(np.uint64), own + 1, bits)
                q, at = np.r_[np.arange(len(own)), q], np.r_[own, at]
                yield pa.RecordBatch.from_arrays([part["fp"].take(pa.array(q)), pa.array(names[at].astype(np.int32))], ["fp", "leaf"])

    return placed.mapInArrow(lean(run), "fp long, leaf int")


def links(prints: DataFrame, scratch: Scratch, bits: int = 3, leaf: int = LEAF, comers: int = COMERS) -> DataFrame:
    """(u, v) pairs of fingerprints whose chains hold every pair at ``bits`` or fewer differing bits.

    ``prints``: (fp long), each once.  The upper tree, of at most ``LEAVES`` leaves, goes to all
    tasks; fingerprints go only to leaves that it leaves open.  A leaf that more than ``comers`` come to is met in
    several tasks: nothing is dropped, and no task grows with a group of near fingerprints.
    """
    placed = leaves_of(prints, scratch, leaf)
    if not placed.limit(1).count():
        return placed.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    come = scratch.write(routed(placed, *upper_tree(placed), bits), "routed")
    parts = come.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / comers).cast("long").alias("parts"))
    parts = F.broadcast(scratch.write(parts, "parts"))  # a row for each of at most LEAVES leaves

    def slot(part) -> F.Column:
        return (F.col("leaf").cast("long") * (1 << 40) + part).alias("slot")

    come = come.join(parts, "leaf").select(slot(F.pmod(F.xxhash64("fp"), F.col("parts"))), F.lit(1).alias("kind"), "fp")
    held = placed.join(parts, "leaf").select("leaf", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    held = held.select(slot(F.col("part")), F.lit(0).alias("kind"), "fp")
    return held.union(come).repartition("slot").sortWithinPartitions("slot", "kind", _rank("fp")).mapInArrow(lean(_met(bits)), "u long, v long")


def _met(bits: int):
    """Joins the fingerprints of each leaf (kind 0), which come first, with those that come to it (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, leaf, own = None, [], None, None

        def out(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        def close() -> Iterator[pa.RecordBatch]:
            if leaf is not None:
                a, b = leaf.joined()
                yield from out(own[a], own[b])

        for batch in batches:
            slot, kind, fp = (batch[c].to_numpy() for c in ("slot", "kind", "fp"))
            cut = np.flatnonzero((slot[1:] != slot[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(slot)], strict=True):
                if s == e:
                    continue
                if slot[s] != now:
                    yield from close()
                    now, held, leaf, own = slot[s], [], None, None
                some = fp[s:e]
                if not kind[s]:
                    held.append(some)
                    continue
                if leaf is None:
                    own, held = np.concatenate(held), []
                    leaf = Leaf(own.view(np.uint64), _signed_rank(own), bits)
                u, v = leaf.meet(some.view(np.uint64), _signed_rank(some))
                yield from out(some[u], own[v])
        yield from close()

    return run


def _tiled(rows: DataFrame, scratch: Scratch, tile: int, name: str = "large") -> DataFrame:
    """The rows (node, bucket, ...), those of a bucket with more than ``tile`` of them once for every two chunks that meet."""
    large = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    large = scratch.write(large.select("bucket", F.ceil(F.col("n") / (tile // 2)).cast("int").alias("chunks")), name)
    if large.limit(1).count():
        rows = rows.join(large, "bucket", "left")
        mine = F.pmod(F.xxhash64("node", "bucket"), F.col("chunks").cast("long")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.xxhash64(F.col("bucket"), F.least(mine, c), F.greatest(mine, c)))
        places = F.when(F.col("chunks").isNull(), F.array("bucket")).otherwise(pairs)
        rows = rows.withColumn("bucket", F.explode(places)).drop("chunks")
    return rows


def _words(sketches: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(len(sketches), -1)


def _in_buckets(rows: DataFrame, found: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(u, v): the nodes at the places that ``found`` links, given the rows of whole buckets in order of bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= 1 << 16 or sum(h.nbytes for h in held) >= HELD:
                yield from flush(held, False)
        yield from flush(held, True)

    def flush(held: list, last: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        t = pa.Table.from_batches(held)
        bucket = t["bucket"].to_numpy()
        cut = len(bucket) if last else int(np.searchsorted(bucket, bucket[-1]))  # rows come sorted by bucket
        held[:] = [] if last else t.slice(cut).to_batches()
        if cut:
            t = t.slice(0, cut)
            node = t["node"].to_numpy()
            u, v = found(t)
            yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    return rows.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(lean(run), "u long, v long")


def alike(bucket: np.ndarray, second: np.ndarray, wide: int = WIDE, sure: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within each bucket, all rows connected by chains of sketches that differ in ``wide`` or fewer places.

    ``bucket`` is sorted; with ``sure``, a link between two rows must also be confirmed by it.  Returns two arrays of indices: each row
    that is not the first of its chain, and that first one.
    """
    label = np.arange(len(bucket))
    first = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    many = np.flatnonzero(np.diff(first) > 1)
    for a, b in zip(first[many], first[many + 1], strict=True):
        mine = label[a:b]
        for i in range(a, b - 1):
            j = i + 1 + np.flatnonzero(mine[i - a + 1 :] != mine[i - a])  # what is linked already needs no comparison
            j = j[differing(second[i], second[j]) <= wide]
            if sure is None and len(j):
                some = np.unique(np.r_[mine[i - a], mine[j - a]])
                mine[np.isin(mine, some)] = some[0]
            for k in j if sure is not None else ():
                x, y = mine[i - a], mine[k - a]
                if x != y and sure(i, k):
                    mine[mine == max(x, y)] = min(x, y)
    rest = np.flatnonzero(label != np.arange(len(label)))
    return rest, label[rest]


def _same(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of numbers, sorted and distinct, have a Jaccard similarity of so many per cent or more."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _by_bands(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) links between nodes that share a band and have like sketches."""
    rows = _tiled(nodes.select("node", "second", F.explode("bands").alias("bucket")), scratch, TILE)
    return _in_buckets(rows, lambda t: alike(t["bucket"].to_numpy(), _words(t["second"])))


def _by_index(nodes: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """(u, v) links that join the nodes whose fingerprints the Gray index links; a fingerprint is a node of its own, by its hash."""
    fps = nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    fps = scratch.write(fps, "prints")
    pairs = scratch.write(links(fps, scratch, bits), "print-links")
    wanted = pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp"))).union(fps.where("n > 1").select("fp")).distinct()
    own = nodes.select("node", "fp").join(wanted, "fp").select(F.col("node").alias("u"), F.xxhash64("fp").alias("v"))
    return own.union(pairs.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")))


def near_links(docs: DataFrame, all_: DataFrame, scratch: Scratch, percent: int, shingle: int, id_col: str, text_col: str, bits: int = 3) -> DataFrame:
    """(u, v) pairs of nodes whose chains hold every pair of texts with a Jaccard similarity of so many per cent or more.

    Candidates are texts whose fingerprints the Gray index links, and, as no budget that an index of 64 bits can prune by reaches
    texts as far apart as 0.8, texts that share a band and have like sketches.  All pairs of like sketches within a component of candidates
    are compared by all their shingles, in tiles where it has more than ``SETS`` texts.
    """
    nodes = all_.groupBy("node").agg(F.min(F.struct("doc_id", "hash", "fp", "second", "bands")).alias("of"))
    nodes = scratch.write(nodes.select("node", "of.*"), "nodes")
    roots = components(_by_index(nodes, scratch, bits).union(_by_bands(nodes, scratch)), scratch, "likely")
    wanted = nodes.select("node", "doc_id", "hash").join(roots, "node").select("node", F.col("root").alias("bucket"), F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    wanted = scratch.write(wanted, "wanted")
    texts = _texts(docs, id_col, text_col).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("node", "bucket", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_distinct(t.as_py(), shingle) for t in b.column(2)]
            second = [_packed(_minima(h)) for h in made]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(second, pa.binary()), pa.array([h.tobytes() for h in made], pa.binary())], ["node", "bucket", "second", "set"])

    def confirmed(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        held = t["set"].to_pylist()

        def sure(i: int, j: int) -> bool:
            return _same(np.frombuffer(held[i], np.uint64), np.frombuffer(held[j], np.uint64), percent)

        return alike(t["bucket"].to_numpy(), _words(t["second"]), WIDE, sure)

    # rows that share id and text come more than once
    made = scratch.write(texts.dropDuplicates(["node"]).mapInArrow(lean(sets), "node long, bucket long, second binary, set binary"), "sets")
    scratch.drop("likely-roots", "wanted", "nodes", "large", "leaves", "routed", "parts", "prints", "print-links")
    return _in_buckets(_tiled(made, scratch, SETS, "large-sets").select("node", "second", "set", "bucket"), confirmed)


def _named(all_: DataFrame, pairs: DataFrame, scratch: Scratch, name: F.Column) -> DataFrame:
    """(node, component): the smallest ``name`` over each component of the links ``pairs`` between nodes."""
    roots = components(pairs, scratch)
    reps = all_.groupBy("node").agg(F.min(name).alias("rep"))
    member = reps.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    member = scratch.write(member, "members")
    # written, so that the join reads both sides from their own shuffle and a large component can be split
    found = scratch.write(member.groupBy("root").agg(F.min("rep").alias("component")), "components")
    named = scratch.write(member.join(found, "root").select("node", "component"), "named")
    scratch.drop("nodes", "large", "leaves", "routed", "parts", "sets", "large-sets", "cc-roots", "members", "components")
    return named


def near_duplicates(
    docs: DataFrame, bits: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked at ``bits`` or fewer differing bits.

    component_id is the smallest doc_id reachable over links, the document's own included.  A null or
    empty text, or one of white space only, has fingerprint zero and is linked like any other; a null
    doc_id keeps its row and takes part in links, but names no component (component_id is null where a
    component has no other id).  Repeated rows give repeated results.  Other columns are ignored; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    all_ = scratch.write(fingerprints(docs, id_col, text_col, shingle).withColumn("node", F.col("fp")), "fps")
    nodes = scratch.write(all_.select("node", "fp").distinct(), "nodes")
    named = _named(all_, links(nodes, scratch, bits), scratch, F.col("doc_id"))
    return all_.join(named, "node").select("doc_id", "fp", F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group of near copies, the one with the smallest id, with all their columns.

    Two documents are near copies if the sets of their five-word shingles have a Jaccard similarity of ``percent`` per cent or
    more, which is computed from all shingles; groups are chains of near copies.  Candidates come from the Gray index over five-word
    fingerprints at 3 bits and from bands of least hashes (see ``BANDS`` and ``WIDE``), chosen for 80 per cent and more.  Of rows that
    share id and text one stays.  Texts without words are copies of each other.  Null ids come first.
    """
    scratch = Scratch(docs.sparkSession)
    all_ = scratch.write(sketches(docs, id_col, text_col, 5), "sketches")
    pairs = near_links(docs, all_, scratch, percent, 5, id_col, text_col)
    named = _named(all_, pairs, scratch, F.struct("doc_id", "hash"))
    kept = scratch.write(named.select("component.*").distinct().select(F.col("doc_id").alias("_partita_id"), F.col("hash").alias("_partita_hash")), "kept")
    out = docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("_partita_id")) & (F.xxhash64(F.col(text_col)) == F.col("_partita_hash")))
    if all_.groupBy("doc_id", "hash").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["_partita_id", "_partita_hash"])
    return out.drop("_partita_id", "_partita_hash")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The constants of XXH64.
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_M = 1 << 64


def _sql(bits: int = 3, shingle: int = 3) -> str:
    """The whole query in SQL, hash included: 64-bit words are 128-bit numbers that are cut after each step."""

    def u(x: int) -> str:
        return f"{x % _M}::UHUGEINT"

    def cut(x: str) -> str:
        return f"(({x}) % {_M}::UHUGEINT)"

    def times(x: str, p: int) -> str:
        return cut(f"({x}) * {u(_P[p - 1])}")

    def turn(x: str, r: int) -> str:
        return f"({cut(f'({x}) * {1 << r}::UHUGEINT')} + ({x}) // {1 << (64 - r)}::UHUGEINT)"

    def round_(acc: str, lane: str) -> str:
        return times(turn(cut(f"{acc} + {times(lane, 2)}"), 31), 1)

    def merge(h: str, v: str) -> str:
        return cut(f"{times(f'xor({h}, {round_(u(0), v)})', 1)} + {u(_P[3])}")

    def fold(first: str, items: str, step) -> str:
        return f"list_reduce(list_concat([{first}], {items}), lambda a, x: {step('a', 'x')})"

    def lane(at: str, width: int) -> str:
        parts = " || ".join(f"substr(h, 2 * ({at} + {b}) + 1, 2)" for b in reversed(range(width)))
        return f"CAST(CAST('0x' || {parts} AS UBIGINT) AS UHUGEINT)"

    v = (SEED + _P[0] + _P[1], SEED + _P[1], SEED, SEED - _P[0])
    stripes = ",\n  ".join(fold(u(v[k]), f"list_transform(range(n // 32), lambda i: lanes[4 * i + {k + 1}])", round_) + f" AS v{k + 1}" for k in range(4))
    start = cut(f"{turn('v1', 1)} + {turn('v2', 7)} + {turn('v3', 12)} + {turn('v4', 18)}")
    merged = [f"SELECT *, {start} AS m0 FROM striped"]
    for k in range(4):
        merged.append(f"SELECT *, {merge(f'm{k}', f'v{k + 1}')} AS m{k + 1} FROM ({merged[-1]})")
    eight = fold("h8", "lanes[4 * (n // 32) + 1 :]", lambda a, x: cut(f"{times(turn(f'xor({a}, {round_(u(0), x)})', 27), 1)} + {u(_P[3])}"))
    four = cut(f"{times(turn(f'xor(h4, {times(lane("(n // 8 * 8)", 4), 1)})', 23), 2)} + {u(_P[2])}")
    tail = f"list_transform(range(n // 4 * 4, n), lambda i: {lane('i', 1)})"
    one = fold("h1", tail, lambda a, x: times(turn(f"xor({a}, {times(x, 5)})", 11), 1))
    white = r"[ \t\n\v\f\r]+"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{white}'), lambda w: w <> '') AS w FROM documents),
shingled AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {shingle} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i : i + {shingle - 1}], ' ')) END) AS s FROM words),
raw AS (SELECT s, hex(encode(s)) AS h, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingled)),
laned AS (SELECT *, list_transform(range(n // 8), lambda i: {lane('8 * i', 8)}) AS lanes FROM raw),
striped AS (SELECT *,
  {stripes} FROM laned),
merged AS ({merged[-1]}),
eights AS (SELECT *, {cut("(CASE WHEN n >= 32 THEN m4 ELSE " + u(SEED + _P[4]) + " END) + n::UHUGEINT")} AS h8 FROM merged),
fours AS (SELECT *, {eight} AS h4 FROM eights),
ones AS (SELECT *, CASE WHEN n % 8 >= 4 THEN {four} ELSE h4 END AS h1 FROM fours),
ended AS (SELECT *, {one} AS e FROM ones),
hashed AS (
  SELECT s, CAST(xor(c, c // {1 << 32}::UHUGEINT) AS UBIGINT) AS x FROM (
    SELECT s, {times(f"xor(b, b // {1 << 29}::UHUGEINT)", 3)} AS c FROM (
      SELECT s, {times(f"xor(e, e // {1 << 33}::UHUGEINT)", 2)} AS b FROM ended))),
ones_of AS (
  SELECT doc_id, bit, SUM((x >> bit) & 1::UBIGINT) AS k, COUNT(*) AS n
  FROM (SELECT doc_id, s, COUNT(*) AS times FROM shingled GROUP BY ALL) JOIN hashed USING (s) CROSS JOIN (SELECT CAST(unnest(range(64)) AS UBIGINT) AS bit)
  CROSS JOIN LATERAL (SELECT unnest(range(times))) GROUP BY 1, 2),
fps AS (
  SELECT d.doc_id, CAST(coalesce(bit_or(CASE WHEN 2 * k > n THEN 1::UHUGEINT << bit::UHUGEINT ELSE 0::UHUGEINT END), 0::UHUGEINT) AS UBIGINT) AS fp
  FROM documents d LEFT JOIN ones_of o ON o.doc_id = d.doc_id GROUP BY d.doc_id),
nodes AS (SELECT fp, MIN(doc_id) AS rep FROM fps GROUP BY 1),
link AS MATERIALIZED (SELECT a.fp AS u, b.fp AS v FROM nodes a JOIN nodes b ON bit_count(xor(a.fp, b.fp)) <= {bits}),
reach AS (SELECT fp AS u, fp AS v FROM nodes UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v),
component AS (SELECT u AS fp, MIN(rep) AS component_id FROM reach JOIN nodes ON nodes.fp = reach.v GROUP BY 1)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM fps JOIN component USING (fp)
"""


QUERIES = {"op2_simhash": op2_simhash}
ORACLES = {"op2_simhash": _sql()}
