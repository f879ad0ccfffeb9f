"""Packing of tokenised documents into fixed-length sequences.

Only lengths decide a packing, and there are at most ``capacity`` of them: their counts go to the
driver, which works on whole classes of equal pieces.  Martello-Toth reduction first fixes sets that
provably dominate every other way to fill a sequence around their largest piece; best fit decreasing
packs what remains.  The plan is then dealt out to the pieces by their rank among pieces of equal length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import KEPT, Scratch, lean, ranked_in, rows_per_bucket, table

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
#: Encodings of words a worker keeps at hand in each of two generations.
KEPT_WORDS = 250_000
#: Longer ones are not kept.
LONGEST_KEPT = 64
#: Bytes of text that are encoded at once (whole texts, so a longer one by itself).
AT_ONCE = 1 << 22
MOST_BUCKETS = 1 << 16


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What the vocabulary does to a text before the merges; texts are only cut into words for one that does this.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "suffix": "</w>",
}
#: Kinds of bytes.  LATIN is the second byte of a letter from U+00C0 to U+00FF, which begins with LEAD; REST are its candidates.
OTHER, LETTER, DIGIT, MARK, QUOTE, SPACE, LEAD, REST, LATIN = range(9)


def _kind(b: int) -> int:
    if b >= 0x80:
        return LEAD if b == 0xC3 else REST if b < 0xC0 and b not in (0x97, 0xB7) else OTHER
    c = chr(b)
    return LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else SPACE if c in " \n" else MARK


def _cuts(prev: int, kind: int) -> bool:
    """Whether the splitting rule always parts a byte of this kind from the one before."""
    if kind == SPACE or prev == SPACE:
        return kind == SPACE  # white space is dropped, so a word may begin with it
    if prev in (LETTER, DIGIT, LATIN):
        return kind in (DIGIT, MARK, QUOTE) or (prev, kind) == (DIGIT, LETTER)
    return kind == DIGIT and prev in (MARK, QUOTE) or (prev, kind) == (MARK, LETTER)  # a quote may begin 's, 't, 're


KINDS = bytes(map(_kind, range(256)))
CUTS = bytes(_cuts(k >> 4, k & 15) for k in range(256))
LOWER = bytes(range(256)).lower().replace(b"\n", b" ")
#: Lower-case words of letters that are one token each before the merges and that no rule changes.
PLAIN = re.compile(rb" ?(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The vocabulary's names of the bytes in such words (it has names of its own for bytes without a printed form).
NAMES = {b: 0x100 + 33 + k for k, b in enumerate([*range(0x7F, 0xA1), 0xAD])}
#: Such words in one string for the tokenizer.
JOINED = 64


def _joined(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of large binary values one after the other, and where each begins and the last ends."""
    if not len(values):
        return memoryview(b""), np.zeros(1, np.int64)
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return memoryview(values.buffers()[2] or b"")[at[0] : at[-1]], at - at[0]


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers.

    The vocabulary lower-cases, drops white space and always cuts between some kinds of characters, so a
    text's ids are those of the words between such places in order.  Words are numbered by
    Arrow; each distinct word is encoded once while it is in use.  An added token is a word as it stands.
    Under a vocabulary of other rules texts are taken whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        rules["suffix"] = rules["model"].get("end_of_word_suffix")
        loose = any(t[k] for t in rules["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.whole = loose or any(rules[k] != v for k, v in RULES.items())
        self.added = [t["content"].encode() for t in rules["added_tokens"]]
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for name, k in vocabulary.items() if name.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The ids of these texts (binary, without nulls) one after the other, and the bytes at which each text's begin and the last ends."""
        data, at = _joined(texts.cast(pa.large_binary()))
        words, starts = self._words(bytes(data), at)
        numbered = words.dictionary_encode()
        distinct, ends = _joined(numbered.dictionary)
        distinct, ends = bytes(distinct), ends.tolist()
        made = self._encode([distinct[a:b] for a, b in pairwise(ends)])
        ids, ends = _joined(pa.array(made, pa.large_binary()).take(numbered.indices))
        return ids, ends[np.searchsorted(starts, at)]

    def _words(self, data: bytes, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of texts that begin at these places, in lower case where that is safe, and where they start."""
        begins, raw = at[:-1][at[1:] > at[:-1]], np.frombuffer(data, np.uint8)
        low, cut = raw, np.zeros(len(data) + 1, bool)
        if data and not self.whole:
            kind = np.frombuffer(bytearray(data.translate(KINDS)), np.uint8)
            kind[1:] += (kind[:-1] == LEAD) & (kind[1:] == REST)  # which makes it LATIN
            kind[begins] -= kind[begins] == LATIN
            cut[1:-1] = np.frombuffer((kind[:-1] << 4 | kind[1:]).tobytes().translate(CUTS), bool)
            low = np.frombuffer(bytearray(data.translate(LOWER)), np.uint8)
            # a letter may be composed with what follows in one case only, such as j and a caron
            kept = np.flatnonzero((raw[1:] >= 0x80) & (raw[:-1] != low[:-1]))
            low[kept] = raw[kept]
            if any(a in data for a in self.added):
                for m in re.finditer(b"|".join(map(re.escape, self.added)), data):
                    a, b = m.span()
                    if np.searchsorted(at, a, "right") == np.searchsorted(at, b, "left"):  # in one text
                        low[a:b], cut[a:b] = raw[a:b], False
                        cut[a] = cut[b] = True
        cut[begins] = cut[-1] = True
        starts = np.flatnonzero(cut)
        return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(low)]), starts

    def _encode(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, words))
        if None not in found:
            return found
        if len(self.known) > KEPT_WORDS:  # words of the last generation that come up again move to the new one
            self.older, self.known = self.known, {}
        at = [k for k, ids in enumerate(found) if ids is None]
        plain, others = [], []
        for k in at:
            ids = self.older.get(words[k])
            if ids is not None:
                found[k] = ids
            else:
                (plain if not self.whole and PLAIN.fullmatch(words[k]) else others).append(k)
        for k, ids in zip(plain, self._merged([words[k].lstrip(b" ") for k in plain]), strict=True):
            found[k] = ids
        made = self.tokenizer.encode_batch_fast([words[k].decode("utf-8", "replace") for k in others], add_special_tokens=False)
        for k, e in zip(others, made, strict=True):
            found[k] = np.array(e.ids, "<u4").tobytes()
        self.known.update((words[k], found[k]) for k in at if len(words[k]) <= LONGEST_KEPT)
        return found

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of plain words, many in one string: the last token of each, and no other, is one that ends a word."""
        joined = [b" ".join(words[k : k + JOINED]).decode("latin-1").translate(NAMES) for k in range(0, len(words), JOINED)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.merges.encode_batch_fast(joined, add_special_tokens=False)), "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(words):
            raise ValueError("plain words end otherwise than by their last token")
        data = ids.tobytes()
        return [data[a:b] for a, b in pairwise([0, *ends.tolist()])]


def encoder(path: str) -> Encoder:
    """This process's encoder: a worker that serves many tasks keeps the words that it knows."""
    if path not in KEPT:
        KEPT[path] = Encoder(path)
    return KEPT[path]


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Rows (an id and a text) in parts with at most so many bytes of text, or one row; null texts are empty."""
    for b in batches:
        texts = pc.fill_null(b.column(1).cast(pa.large_binary()), b"")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, most + (ends[lo - 1] if lo else 0), "right")))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo)], ["id", "text"])
            lo = hi


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and its end id, cut where over ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in by_bytes(batches):
            ids, at = encode(b.column(1))
            row: list[int] = []
            out: list[tuple] = []
            for k, (lo, hi) in enumerate(pairwise(at.tolist())):
                n = (hi - lo) // 4 + 1
                for piece, start in enumerate(range(0, n, capacity)):
                    stop = min(n, start + capacity)
                    crc = zlib.crc32(ids[lo + 4 * start : min(lo + 4 * stop, hi)])
                    row.append(k)
                    out.append((piece, start, stop - start, zlib.crc32(end, crc) if stop == n else crc))
            cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))] if out else None
            if cols:
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary")).mapInArrow(
        lean(run, keep=True), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # (((size, copies), ...), number of such sequences)


def _largest(h: np.ndarray) -> np.ndarray:
    """For each size the largest size not above it that has pieces; 0 where none."""
    return np.maximum.accumulate(np.where(h > 0, np.arange(len(h)), 0))


def reduce_dominated(h: np.ndarray, capacity: int) -> tuple[Plan, np.ndarray]:
    """Martello-Toth reduction of counts by size: sets fixed for good, and the counts that remain.

    Around the largest piece w with r = capacity - w left, a set is fixed if every other choice could be
    exchanged for it piece by piece: w alone if nothing else fits; w and the largest fitting j if j = r, if no
    two pieces fit together, or if no three do and j is no smaller than the best two; w, j and b if no
    three fit, b is the largest beside j, and no fitting pair has a smaller piece over b.
    """
    h, fixed = h.copy(), []
    while True:
        before = int(h.sum())
        for w in range(capacity, 0, -1):
            while h[w]:
                r = capacity - w
                h[w] -= 1
                low = _largest(h)
                j = int(low[r])
                if not j:
                    fixed.append((((w, 1),), int(h[w]) + 1))
                    h[w] = 0
                    continue
                small, need = [], 3
                for s in np.flatnonzero(h)[:3]:
                    small += [int(s)] * min(need - len(small), int(h[s]))
                two, three = sum(small[:2]) if len(small) > 1 else capacity + 1, sum(small) if len(small) > 2 else capacity + 1
                pair, b = j == r or two > r, 0
                if not pair and three > r:
                    a = np.flatnonzero(h[: r + 1])
                    other = low[np.minimum(a, r - a)]
                    other = np.where((other == a) & (h[a] < 2), low[np.maximum(a - 1, 0)], other)
                    ok = other > 0
                    if not ok.any() or j >= int((a + other)[ok].max()):
                        pair = True
                    else:
                        h[j] -= 1
                        beside = int(_largest(h)[r - j])
                        h[j] += 1
                        if beside and beside >= int(other[ok].max()):
                            b = beside
                if pair:
                    times = (int(h[w]) + 1) // 2 if j == w else min(int(h[w]) + 1, int(h[j]))
                    fixed.append((((w, 2),) if j == w else ((w, 1), (j, 1)), times))
                    h[w] -= times - 1
                    h[j] -= times
                elif b:
                    fixed.append((_runs([w, j, b]), 1))
                    h[j] -= 1
                    h[b] -= 1
                else:
                    h[w] += 1
                    break
        if int(h.sum()) in (before, 0):
            return fixed, h


def _runs(sizes: list[int]) -> tuple[tuple[int, int], ...]:
    return tuple((s, sizes.count(s)) for s in sorted(set(sizes), reverse=True))


def best_fit(h: np.ndarray, capacity: int) -> Plan:
    """Best fit decreasing on counts by size: equal pieces are placed a class of equal sequences at a time."""
    room: dict[int, list] = {}
    keys: list[int] = []

    def put(left: int, what: tuple, times: int) -> None:
        if times:
            if left not in room:
                room[left] = []
                insort(keys, left)
            room[left].append((what, times))

    for w in map(int, np.flatnonzero(h)[::-1]):
        n = int(h[w])
        while n:
            at = bisect_left(keys, w)
            left, what, times = capacity, (), n
            if at < len(keys):
                left = keys[at]
                what, times = room[left].pop()
                if not room[left]:
                    del room[left], keys[at]
            each = left // w
            full = min(times, n // each)
            put(left - each * w, (*what, (w, each)), full)
            n -= full * each
            if full < times and n < each and n:
                put(left - n * w, (*what, (w, n)), 1)
                full, n = full + 1, 0
            if what:
                put(left, what, times - full)
    return [group for groups in room.values() for group in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    h = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        h[size] = n
    fixed, rest = reduce_dominated(h, capacity)
    return fixed + best_fit(rest, capacity)


def _intervals(made: Plan) -> list[tuple]:
    """(size, from rank, to rank, first sequence, copies in each, offset in each) of each class of slots."""
    out, sequence, next_rank = [], 0, {}
    for what, times in made:
        offset = 0
        for size, copies in what:
            lo = next_rank.get(size, 0)
            next_rank[size] = lo + times * copies
            out.append((size, lo, next_rank[size], sequence, copies, offset))
            offset += size * copies
        sequence += times
    return out


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece in one place.

    A null or empty text is the end id alone, one piece of one token.  Documents over ``capacity`` tokens,
    and only those, are cut; nothing is truncated.  Repeated rows and null ids keep a piece each; equal pieces
    are interchangeable.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cut = scratch.write(pieces(docs, path or vocabulary_path(), capacity, 0, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    slots = _intervals(plan(counts, capacity))
    buckets = min(MOST_BUCKETS, rows_per_bucket(sum(counts.values())))
    mix = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = ranked_in(cut.withColumn("mix", mix), "length", ["mix"], F.shiftright("mix", 64 - (buckets.bit_length() - 1)), "rank", copies=True)
    # at most a few classes of slots for each of at most `capacity` lengths, whatever the number of rows
    where = spark.createDataFrame(slots, "size long, lo long, hi long, sequence long, copies long, at long")
    placed = ranked.join(F.broadcast(where), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.expr("(rank - lo) div copies")).alias("sequence_id"),
        (F.col("at") + (step % F.col("copies")) * F.col("length")).alias("offset"),
    )


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op8_pack": op8_pack}
ORACLES: dict[str, str] = {}
