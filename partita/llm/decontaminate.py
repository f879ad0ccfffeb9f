"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters with an error budget of k is split into k + 1 pieces.  If a text holds the item with
at most k edits, at least one piece stands in it unchanged; one automaton finds all pieces of all
items in a single pass, and each hit's surroundings are verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, ship, slices, table

#: Edits allowed per character of an item.
ERROR_RATE = 0.08
#: Items with fewer characters (normalised) must occur without edits, as whole words.
MIN_CHARS = 20
#: Scripts written without spaces, where a word may end anywhere (Thai to Lao, Myanmar, Khmer, Kana, Han).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Characters of items that are searched for in one pass over the documents; more items take more passes.
BLOCK_CHARS = 2_000_000

_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalise(text: str | None) -> str:
    """Lower case, with each run of ASCII characters that are neither letters nor digits as one space."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_SPACE).split()).decode()


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """The bounds of k + 1 pieces of n characters, as even as possible."""
    return [(n * p // (k + 1), n * (p + 1) // (k + 1)) for p in range(k + 1)]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of a pattern within a text with at most k edits; the first of the best."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for end, c in enumerate(text, 1):
        eq = where.get(c, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(d0 | plus))
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1  # an occurrence may start anywhere, so the first row is all zero
        down = down << 1
        plus = full & (down | ~(d0 | up))
        minus = full & up & d0
        if score <= k and (best is None or score < best[0]):
            best = score, end
            if not score:
                break
    return best


def _joined(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word."""
    return a.isalnum() and b.isalnum() and not any(lo <= ord(c) <= hi for c in (a, b) for lo, hi in UNSPACED)


def stands(text: str, start: int, stop: int) -> bool:
    """Whether a stretch of a text begins and ends with words."""
    return not (start and _joined(text[start - 1], text[start])) and not (stop < len(text) and _joined(text[stop - 1], text[stop]))


class Finder:
    """Finds items, given as (number, normalised text), in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items = [(i, t, int(rate * len(t)) if len(t) >= MIN_CHARS else 0) for i, t in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for a, b in pieces(len(t), k):
                at.setdefault(t[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item -> (distance, start, end) of its best occurrence; the first of the best."""
        found: dict[int, tuple[int, int, int]] = {}
        if not self.items:
            return found
        tried: dict[int, set[int]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                item, pattern, k = self.items[n]
                start = last + 1 - length - offset
                if len(pattern) < MIN_CHARS:
                    if (item not in found or found[item][0]) and stands(text, start, last + 1):
                        found[item] = 0, start, last + 1
                    continue
                tried.setdefault(n, set()).add(start // (k + 1))  # starts this close lie in one window
        for n, slots in tried.items():
            item, pattern, k = self.items[n]
            for lo, stop in _stretches(sorted(slots), k, len(pattern)):
                if item in found and not found[item][0]:
                    break
                part = text[lo:stop]
                got = myers(pattern, part, k)
                if got and (item not in found or got[0] < found[item][0]):
                    back = myers(pattern[::-1], part[: got[1]][::-1][: len(pattern) + k], got[0])
                    found[item] = got[0], lo + got[1] - back[1], lo + got[1]
        return found


def _stretches(slots: list[int], k: int, m: int) -> Iterator[tuple[int, int]]:
    """The windows of m characters and k edits around starts in these slots; windows that overlap as one, so no character is read twice."""
    lo = stop = None
    for slot in slots:
        first, last = max(0, slot * (k + 1) - k), (slot + 1) * (k + 1) + m + k
        if lo is None:
            lo, stop = first, last
        elif first <= stop:
            stop = last
        else:
            yield lo, stop
            lo, stop = first, last
    if lo is not None:
        yield lo, stop


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded size, each small enough for the driver and every task."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    rows = rows.where(F.char_length("text") > 0)
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).distinct().collect()
        yield [(r["item"], t) for r in part if (t := normalise(r["text"]))]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, stop): each benchmark item found in each document, once, at its best place.

    Texts are compared as ``normalise`` gives them; start and stop count the characters of that form.  Whole
    texts are searched.  An item may occur with up to rate * (its characters) insertions, deletions and
    substitutions, one under ``MIN_CHARS`` characters with none, as whole words.  A null or empty text has no leaks; null or
    empty items take no part; items sharing an id are found under it separately or together as one row.
    Repeated documents repeat their rows, and null ids are kept.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    out = None
    for items in _blocks(benchmark, item_col, item_text_col):
        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(lean(_search(items, rate)), LEAK)
        out = part if out is None else out.union(part)
    return out


LEAK = "doc_id long, item_id long, distance int, start long, stop long"


def _search(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(items, rate)
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out += [(d, item, *at) for item, at in find(normalise(t.as_py())).items()]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "stop"])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; see ``leaks``."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            find = Finder(items, rate)
            for b in slices(batches):
                yield b.filter(pa.array([not find(normalise(t.as_py())) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES: dict[str, str] = {}
