"""What the trained operators share: the labelled sample, and a minimiser."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether an id is kept from training: crc32 of its text, modulo 5, is 0; a null id is not in any sample."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label): at most ``per_class`` documents of each class, the first by a hash of their id.

    Only ids that are not held out, with a label of 0 or 1; an id labelled several times counts with its
    highest label, an id of several documents with one of their texts.
    """
    known = labels.where(~held_out("doc_id") & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = parts[0].union(parts[1]).withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the chosen ids are at most 2 * per_class rows of two numbers
    found = texts.join(F.broadcast(chosen), "_id")
    return found.groupBy("_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).drop("_id")


def bounded(sample: DataFrame, column: str, most: int) -> DataFrame:
    """The sample's rows, first by a hash of their features, whose features make up ``most`` bytes at most; one row's at least.

    The sizes of the sample's rows, of which there is a bounded number, come to the driver.
    """
    mark = F.xxhash64(column)
    last, total = None, 0
    for h, n in sorted(tuple(r) for r in sample.select(mark, F.octet_length(column)).collect()):
        total += n
        if total > most and last is not None:
            break
        last = h
    return sample if total <= most else sample.where(mark <= last)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 60, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking; f gives the value and the gradient."""
    value, g = f(x)
    past: deque = deque(maxlen=memory)
    for _ in range(steps):
        if np.abs(g).max() <= tolerance * max(1.0, np.abs(x).max()):
            break
        d, saved = -g, []
        for s, y, rho in reversed(past):
            a = rho * (s @ d)
            saved.append(a)
            d = d - a * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, rho), a in zip(past, reversed(saved), strict=True):
            d = d + s * (a - rho * (y @ d))
        slope, t = g @ d, 1.0 if past else min(1.0, 1.0 / max(np.abs(g).max(), 1e-12))
        while t > 1e-10:
            new, gn = f(x + t * d)
            if new <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, gn - g
        if s @ y > 1e-12:
            past.append((s, y, 1.0 / (s @ y)))
        done = abs(value - new) <= 1e-7 * max(1.0, abs(value))
        x, value, g = x + s, new, gn
        if done:
            break
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
