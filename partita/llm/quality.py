"""Document quality by a linear-chain conditional random field over lines.

Every line that is not blank is good or bad.  Its evidence are the shares of characters of several kinds,
word shape and repetition, of the line itself and of the lines before and after it; neighbouring labels
are tied by transition weights.  The field is trained on a bounded sample of labelled documents, whose lines
take their document's label.  A document's quality is the mean over its lines, weighted by length, of the
forward-backward probability that the line is good.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learning import bounded, held_out, minimise, training_rows
from .shared import Scratch, lean, ship, slices, table

#: Labelled documents of each class that the field learns from at most.
PER_CLASS = 1500
#: Bytes of the features of these documents' lines, 56 for each line: documents beyond are left out of the sample.
SAMPLE_BYTES = 1 << 24
RIDGE = 1.0
THRESHOLD = 0.3
#: Bytes of text whose features are computed at once; a longer text is computed alone.
CHUNK = 1 << 20
#: Rows that are filtered at once.
ROWS = 256

_KINDS = np.zeros((256, 6), np.uint8)  # upper, digit, sentence mark, other symbol, white space, beyond ASCII
for _c in range(256):
    _s = chr(_c)
    _KINDS[_c] = [65 <= _c <= 90, 48 <= _c <= 57, _s in ".,;:!?'\"-", 33 <= _c < 127 and not _s.isalnum() and _s not in ".,;:!?'\"-", _c in (9, 10, 11, 12, 13, 32), _c >= 128]
_NUMBER = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def line_features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, features, length) of each line that is not blank; ``starts`` bound the documents in the bytes."""
    doc_of = np.flatnonzero(np.diff(starts) > 0)
    if _KINDS[:, 4][data].all():  # white space only, or nothing
        return np.zeros(0, np.int64), np.zeros((0, FEATURES)), np.zeros(0)
    begin = starts[:-1][doc_of]
    cut = np.union1d(begin, np.flatnonzero(data == 10) + 1)
    cut = cut[cut < len(data)]
    n = np.diff(np.r_[cut, len(data)])
    kinds = np.stack([np.add.reduceat(_KINDS[:, k][data], cut, dtype=np.int32) for k in range(6)], axis=1).astype(np.float64)
    space = _KINDS[:, 4][data].astype(bool)
    before = np.r_[True, space[:-1]]
    before[begin] = True
    first = np.flatnonzero(~space & before)
    line = np.searchsorted(cut, first, "right") - 1
    words = np.bincount(line, minlength=len(cut))
    total = np.cumsum(np.where(space, np.uint64(0), _NUMBER[data]))  # wraps: differences still tell words apart
    mark = total[np.r_[first[1:], len(data)] - 1] - np.where(first > 0, total[np.maximum(first, 1) - 1], np.uint64(0))
    same = np.r_[False, (mark[1:] == mark[:-1]) & (line[1:] == line[:-1])]
    again = np.bincount(line[same], minlength=len(cut))
    solid = n - kinds[:, 4]
    keep = np.flatnonzero(solid > 0)
    cut, n, kinds, words, again, solid = cut[keep], n[keep], kinds[keep], words[keep], again[keep], solid[keep]
    share = kinds[:, [0, 1, 2, 3, 5]] / solid[:, None]
    repeat = again / np.maximum(words - 1, 1)
    last = np.minimum(cut + n - 1, len(data) - 1)
    ends = data[np.where((data[last] == 10) & (last > cut), last - 1, last)]
    f = np.column_stack([
        share, np.sqrt(share[:, [0, 3]]), repeat, np.sqrt(repeat), np.minimum(solid / np.maximum(words, 1), 30) / 10, np.log1p(n) / 8,
        np.log1p(words) / 6, np.isin(ends, [33, 46, 63]), np.isin(data[cut], np.arange(65, 91)),
    ])
    return doc_of[np.searchsorted(begin, cut, "right") - 1], f, solid


FEATURES = 14


def _with_neighbours(doc: np.ndarray, f: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after it in its document, whether these exist, and one."""
    if not len(f):
        return np.zeros((0, 3 * FEATURES + 3))
    same = doc[1:] == doc[:-1]
    up, down = np.zeros_like(f), np.zeros_like(f)
    up[1:][same] = f[:-1][same]
    down[:-1][same] = f[1:][same]
    return np.column_stack([f, up, down, np.r_[False, same], np.r_[same, False], np.ones(len(f))])


def chains(doc: np.ndarray) -> list[np.ndarray]:
    """For each t, the t-th lines of all documents that have so many, longest document first."""
    if not len(doc):
        return []
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    n = np.diff(np.r_[first, len(doc)])
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    more = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")
    return [first[:m] + t for t, m in enumerate(more)]


def forward_backward(z: np.ndarray, trans: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability that each line is good, expected transitions, and the log partition sum.

    ``z``: a line's evidence for good over bad; ``trans``: 2 x 2 transition weights.
    """
    z = np.clip(z, -30, 30)
    e = np.column_stack([np.exp(-np.maximum(z, 0)), np.exp(np.minimum(z, 0))])
    m = np.exp(trans)
    a, b, c = np.empty((len(z), 2)), np.ones((len(z), 2)), np.empty(len(z))
    for t, at in enumerate(steps):
        now = e[at] if not t else e[at] * (a[at - 1] @ m)
        c[at] = now.sum(axis=1)
        a[at] = now / c[at][:, None]
    pairs = np.zeros((2, 2))
    for t in range(len(steps) - 1, 0, -1):
        at = steps[t]
        right = e[at] * b[at] / c[at][:, None]
        b[at - 1] = right @ m.T
        pairs += (a[at - 1].T @ right) * m
    return a[:, 1] * b[:, 1], pairs, float(np.log(c).sum() + np.maximum(z, 0).sum())


class Model(NamedTuple):
    weight: np.ndarray
    trans: np.ndarray


def fit(lines: list[np.ndarray], labels: list[int]) -> Model:
    """Maximum likelihood of the lines' labels given their evidence, with a ridge; ``lines``: each document's features."""
    width = 3 * FEATURES + 3
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return Model(np.r_[np.zeros(width - 1), np.log(share / (1 - share))], np.zeros((2, 2)))
    doc, f = np.repeat(np.arange(len(lines)), [len(f) for f in lines]), np.concatenate(lines).astype(np.float64)
    x, y, steps = _with_neighbours(doc, f), np.array(labels)[doc], chains(doc)
    follow = np.flatnonzero(np.r_[False, doc[1:] == doc[:-1]])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[follow - 1], y[follow]), 1)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z, trans = x @ p[:width], p[width:].reshape(2, 2)
        good, pairs, log_sum = forward_backward(z, trans, steps)
        z = np.clip(z, -30, 30)
        value = log_sum - z[y == 1].sum() - (seen * trans).sum() + 0.5 * RIDGE * p @ p
        return value, np.r_[x.T @ (good - y), (pairs - seen).ravel()] + RIDGE * p

    p = minimise(loss, np.zeros(width + 4), 80)
    return Model(p[:width], p[width:].reshape(2, 2))


def line_scores(data: np.ndarray, starts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, probability of good, length) of every line that is not blank."""
    parts, k = [], 0
    while k < len(starts) - 1:
        e = max(k + 1, int(np.searchsorted(starts, starts[k] + CHUNK, "right")) - 1)
        doc, f, size = line_features(data[starts[k] : starts[e]], starts[k : e + 1] - starts[k])
        parts.append((doc + k, _with_neighbours(doc, f) @ model.weight, size))
        k = e
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    doc, z, size = (np.concatenate(c) for c in zip(*parts, strict=True))
    return doc, forward_backward(z, model.trans, chains(doc))[0] if len(doc) else z, size


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """The quality of each text of a binary column."""
    column = column.fill_null(b"") if column.null_count else column
    starts = np.r_[0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    skip = int(np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset]) if len(column) else 0
    doc, good, size = line_scores(data[skip : skip + starts[-1]], starts, model)
    weight = np.bincount(doc, size, len(column))
    bare = 1 / (1 + np.exp(-np.clip(model.weight[-1], -30, 30)))  # no line: what a line without evidence gets
    return np.clip(np.where(weight > 0, np.bincount(doc, size * good, len(column)) / np.maximum(weight, 1), bare), 0, 1)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The sample's lines come to the driver as features, not as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for t in b.column(0):
                data = np.frombuffer(t.as_py().encode(), np.uint8)
                made.append(line_features(data, np.array([0, len(data)]))[1].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), b.column(1)], ["f", "label"])

    scratch = Scratch(docs.sparkSession)
    sample = scratch.write(training_rows(docs, labels, "quality", per_class).mapInArrow(lean(run), "f binary, label int"), "sample")
    rows = sorted((bytes(r["f"]), r["label"]) for r in bounded(sample, "f", SAMPLE_BYTES).collect())
    scratch.drop("sample")
    return fit([np.frombuffer(f, "<f4").reshape(-1, FEATURES) for f, _ in rows], [y for _, y in rows])


def _scored(docs: DataFrame, model: Model, text_col: str, keep: bool):
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(b.column(at).cast(pa.binary()), model)
            if keep:
                good = pa.array(s >= THRESHOLD)
                for k, part in enumerate(slices([b], ROWS)):
                    yield part.filter(good.slice(ROWS * k, ROWS))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Only the text is scored.  ``labels`` has doc_id and quality (0 or 1; others and null are ignored); ids
    whose crc32 modulo 5 is 0 are never learnt from.  At most ``per_class`` labelled documents of each class train
    the field, with at most ``SAMPLE_BYTES`` of features in all.  A text without lines (null, empty, white space) scores what a line without evidence would.  Without labels of
    both classes every line gets the smoothed share of the known one.  Repeated rows and null ids are scored like any.
    """
    ship(docs.sparkSession)
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, per_class)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_scored(rows, model, "text", False)), "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose quality is ``THRESHOLD`` or more, with all their columns; see ``quality``."""
    ship(docs.sparkSession)
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, per_class)
    return docs.mapInArrow(lean(_scored(docs, model, text_col, True)), docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
