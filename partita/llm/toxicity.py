"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct 3- to 5-grams of its characters, hashed; each is scaled by the log ratio
of its smoothed document counts in toxic and other texts, and a regularised logistic regression weighs
the scaled features.  Trained on a bounded sample of labelled rows, it scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learning import bounded, held_out, minimise, sigmoid, training_rows
from .shared import Scratch, ship, table

SIZES = (3, 4, 5)
BITS = 18
#: Labelled documents of each class that the classifier learns from at most.
PER_CLASS = 2500
#: Bytes of these documents' features, four for each: documents beyond are left out of the sample.
SAMPLE_BYTES = 1 << 27
#: Added to the counts before the ratio.
SMOOTHING = 2.0
#: Features whose log ratio is nearer to zero than this tell the classes too little to be kept.
LEAST_RATIO = 0.1
#: Sampled documents whose features are multiplied at once.
STEP = 256
#: Strength of the pull of the weights towards zero.
RIDGE = 1.0


def grams(text: str, sizes: tuple = SIZES, bits: int = BITS) -> np.ndarray:
    """Hashes of all character n-grams of a lower-cased text, white space as single spaces, with repeats."""
    chars = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "replace"), np.uint32)
    out, h = [], np.zeros(len(chars), np.uint32)
    for n in range(1, max(sizes) + 1):
        if len(chars) < n:
            break
        h = h[: len(chars) - n + 1] * np.uint32(0x01000193) ^ chars[n - 1 :] * np.uint32(0x9E3779B1)
        if n in sizes:
            out.append(((h ^ np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Model(NamedTuple):
    weight: np.ndarray  # ratio times learnt weight, by hash
    bias: float


def ratios(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of each feature's document counts in both classes, 0 where it is too near to it.

    ``counts``: (class, feature); ``documents``: how many there are of each class.
    """
    share = (counts + SMOOTHING) / (documents + 2 * SMOOTHING)[:, None]
    ratio = np.log(share[1]) - np.log(share[0])
    ratio[np.abs(ratio) < LEAST_RATIO] = 0
    return ratio


def fit(rows: list[tuple[np.ndarray, int]], ratio: np.ndarray) -> Model:
    """Learns from (distinct hashes with a ratio, label) rows, which it uses up; both classes weigh the same."""
    n, y = len(ratio), np.array([r[1] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(n, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    weigh = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    parts = []  # of so many rows that the copies made of their features stay small
    for k in range(0, len(rows), STEP):
        length = [len(r[0]) for r in rows[k : k + STEP]]
        parts.append((slice(k, k + len(length)), np.concatenate([r[0] for r in rows[k : k + STEP]]), np.repeat(np.arange(len(length), dtype=np.int32), length)))
    rows.clear()

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        ridge = RIDGE * p
        ridge[-1] = 0
        scaled, value, g, bias = p[:-1] * ratio, 0.5 * float(ridge @ p), np.zeros(n), 0.0
        for here, at, row in parts:
            z = np.bincount(row, scaled[at], here.stop - here.start) + p[-1]
            e = weigh[here] * (sigmoid(z) - y[here])
            g += np.bincount(at, e[row], n)
            bias += e.sum()
            value += float(weigh[here] @ (np.logaddexp(0, z) - y[here] * z))
        return value, np.r_[g * ratio, bias] + ridge

    p = minimise(loss, np.zeros(n + 1), 40)
    return Model((p[:-1] * ratio).astype(np.float32), float(p[-1]))


def score(texts: Iterator, model: Model) -> np.ndarray:
    out, seen = [], np.zeros(len(model.weight), bool)
    bits = len(model.weight).bit_length() - 1
    for t in texts:
        at = grams(t.as_py() or "", SIZES, bits)
        seen[:] = False
        seen[at] = True  # a feature is there or not
        out.append(model.weight[seen].sum(dtype=np.float64) + model.bias)
    return sigmoid(np.array(out))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """The sample's features are counted, and those without a ratio left out, before they come to the driver."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.unique(grams(t.as_py())).astype("<i4").tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), b.column(1)], ["at", "label"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, c = np.zeros(2, np.int64), np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for at, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                c[y, np.frombuffer(at.as_py(), "<i4")] += 1
                n[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["n", "c"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [a[ratio[a] != 0].tobytes() for a in (np.frombuffer(at.as_py(), "<i4") for at in b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), b.column(1)], ["at", "label"])

    scratch = Scratch(docs.sparkSession)
    sample = scratch.write(training_rows(docs, labels, label, per_class).mapInArrow(hashed, "at binary, label int"), "sample")
    sample = bounded(sample, "at", SAMPLE_BYTES)
    n, c = np.zeros(2, np.int64), np.zeros((2, 1 << BITS), np.int64)
    for r in sample.coalesce(4).mapInArrow(counted, "n binary, c binary").collect():
        n += np.frombuffer(r["n"], np.int64)
        c += np.frombuffer(r["c"], np.int32).reshape(2, -1)
    ratio = ratios(c, n)
    # a partition of the sample at a time, which halves what the driver's JVM holds
    rows = sorted((bytes(r["at"]), r["label"]) for r in sample.mapInArrow(kept, "at binary, label int").toLocalIterator())
    scratch.drop("sample")
    return fit([(np.frombuffer(a, "<i4"), y) for a, y in rows], ratio)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Only the text is scored.  ``labels`` has doc_id and toxic (0 or 1; others and null are ignored); ids
    whose crc32 modulo 5 is 0 are never learnt from.  At most ``per_class`` labelled documents of each
    class train the classifier, with at most ``SAMPLE_BYTES`` of features in all.  A null or empty text scores by the bias alone.  Without labels of both classes, every
    text gets the smoothed share of the known one.  Repeated rows and null ids (not held out) are scored like any.
    """
    ship(docs.sparkSession)
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, "toxic", per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(b.column(2), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_col)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
