"""Line dedup over the suffix array of all documents' line sequences.

A document is a sequence of line ids.  Prefix doubling ranks the suffixes by their first 1, 2, 4, ...
lines: the ranks of depth 2h are the sorted pairs (rank of the first h lines, rank of the next h).  Equal
ranks at depth h are an interval of the suffix array in which all longest common prefixes are h or
more; two overlapping ranks give the interval of any length between.  A run of lines is repeated where its
interval holds two suffixes or more: the first in document order stays, later copies go.  A run must have
``min_words`` words; every maximal repeated run is the union of the shortest runs with so many words at
its starts and ends, so no interval deeper than ``min_words`` lines is ever needed, and a suffix whose
prefix is unique leaves the array.  Nothing is gathered per line id: counts and first places are map-side
aggregates joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, lean, slices, table

MIN_WORDS = 4
AT = ["doc", "hash", "i"]
#: Stands for a null id in the order of documents: before all others.
NO_ID = -(2**63)


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, how many lines the shortest run of ``least`` words has that starts, and that ends, there; 0 if none."""
    n, c = len(words), np.r_[0, np.cumsum(words)]
    ends = np.searchsorted(c, c[:-1] + least, "left")
    starts = np.searchsorted(c, c[1:] - least, "right") - 1
    return np.where(ends <= n, ends - np.arange(n), 0), np.where(starts >= 0, np.arange(1, n + 1) - starts, 0)


def text_lines(text: bytes) -> list[tuple[int, bytes]]:
    """(line number, trimmed line) of the lines that are not blank; the sequence a document stands for."""
    return [(k, s) for k, line in enumerate(text.split(b"\n")) if (s := line.strip())]


def _lines(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, place, ahead, behind, ids = [], [], [], [], []
            for k, t in enumerate(b.column(2)):
                lines = [s for _, s in text_lines(t.as_py() or b"")]
                if lines:
                    fwd, bwd = windows(np.array([len(s.split()) for s in lines]), least)
                    row.append(np.full(len(lines), k))
                    place.append(np.arange(len(lines)))
                    ahead.append(fwd)
                    behind.append(bwd)
                    ids += [xxhash.xxh3_128_digest(s) for s in lines]
            if ids:
                row = pa.array(np.concatenate(row))
                ab = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
                small = [pa.array(np.concatenate(x).astype(np.int32)) for x in (place, ahead, behind)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(1).take(row), *small, pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())],
                    ["doc", "hash", "i", "fwd", "bwd", "a", "b"],
                )

    return docs.mapInArrow(lean(run), "doc long, hash long, i int, fwd int, bwd int, a long, b long")


def _first(df: DataFrame, by: list[str]) -> DataFrame:
    """Per class its first place, for classes of two places or more."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*AT)).alias("first"))
    return g.where("n > 1").drop("n")


def _ranked(df: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The places whose class has others, with the class's rank in sorted order and its first place."""
    ids = _first(df, by).orderBy(*by).withColumn("rank", F.monotonically_increasing_id())
    ids = scratch.write(ids, f"{name}-ids")
    return scratch.write(df.join(ids, by).drop(*by), name)


def _here(places: DataFrame, ahead: int | str, name: str) -> DataFrame:
    """The ranks found ``ahead`` lines further on, as column ``name`` of the earlier place."""
    return places.select("doc", "hash", (F.col("i") - F.lit(ahead)).cast("int").alias("i"), F.col("rank").alias(name))


def repeated_runs(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, hash, i, m): runs of m lines from the i-th on (blank lines not counted) that occur earlier.

    ``docs``: (doc long, hash long, text binary).  A document is its id and its text's hash; documents
    come in that order, lines in theirs.
    """
    lines = scratch.write(_lines(docs, min_words), "lines")
    lone = F.col("first") != F.struct(*AT)
    ranks = _ranked(lines, ["a", "b"], scratch, "rank-0").dropDuplicates(AT)
    ranks = scratch.write(ranks, "unique-0")
    scratch.drop("rank-0", "rank-0-ids", "lines")
    found = [scratch.write(ranks.where((F.col("fwd") == 1) & lone).select(*AT, F.lit(1).alias("m")), "found-0")]
    both = F.explode(F.array(F.struct(F.col("i"), F.col("fwd").alias("m")), F.struct((F.col("i") - F.col("bwd") + 1).alias("i"), F.col("bwd").alias("m"))))
    longer = ranks.where("fwd > 1 or bwd > 1").select("doc", "hash", both.alias("s")).select("doc", "hash", "s.i", "s.m").where("m > 1").distinct()
    longer = scratch.write(longer, "longer")
    deepest = longer.agg(F.max("m")).first()[0] or 1
    now, h = ranks.select(*AT, "rank"), 1
    while h <= deepest:
        runs = longer.where((F.col("m") >= h) & (F.col("m") < 2 * h))
        if h > 1:
            tail = now.select("doc", "hash", F.col("i").alias("j"), F.col("rank").alias("r2"))
            runs = runs.join(now.withColumnRenamed("rank", "r1"), AT).withColumn("j", F.col("i") + F.col("m") - h).join(tail, ["doc", "hash", "j"])
            same = _first(runs, ["r1", "r2", "m"])
            runs = runs.join(same, ["r1", "r2", "m"]).where(lone)
            found.append(scratch.write(runs.select(*AT, "m"), f"found-{h}-more"))
        if 2 * h > deepest:
            break
        pairs = now.withColumnRenamed("rank", "r1").join(_here(now, h, "r2"), AT)
        now = _ranked(pairs, ["r1", "r2"], scratch, f"rank-{2 * h}").select(*AT, "rank")
        scratch.drop(f"rank-{h}", f"rank-{2 * h}-ids")
        h *= 2
    scratch.drop("unique-0", "longer", f"rank-{h}")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", report: bool = True) -> DataFrame:
    """The documents with later copies of repeated line runs deleted; adds ``removed`` and ``n_lines``.

    ``removed`` lists the maximal deleted spans as (start, count) over the original line numbers from 0, blank
    lines inside a span included; ``n_lines`` counts the original lines.  Lines are compared without white
    space at their ends; blank lines stay, unless inside a span.  A run needs ``min_words`` words.  The first
    copy by (id, hash of the text, line) stays; a null id comes before all others.  Rows repeating id and text are one
    document and are treated alike.  A null or empty text stays as it is, with ``removed`` empty.  Overlapping
    copies within one text keep their first line run.  Other columns, whatever their names, pass through
    (a column named removed or n_lines is replaced); without ``report`` nothing is added, and such columns pass through
    too.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.drop("removed", "n_lines") if report else docs
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.col(text_col))]
    found = repeated_runs(docs.select(key[0].alias("doc"), key[1].alias("hash"), F.col(text_col).cast("binary")), scratch, min_words)
    spans = found.groupBy("doc", "hash").agg(F.collect_list(F.struct("i", "m")).alias("_partita_runs"))
    spans = spans.select(F.col("doc").alias("_partita_doc"), F.col("hash").alias("_partita_hash"), "_partita_runs")
    joined = docs.join(spans, (key[0] == F.col("_partita_doc")) & (key[1] == F.col("_partita_hash")), "left").drop("_partita_doc", "_partita_hash")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, removed, n_lines = b.column(at).cast(pa.binary()).to_pylist(), [], []
            for k, runs in enumerate(b.column(len(names)).to_pylist()):
                n_lines.append(0 if texts[k] is None else texts[k].count(b"\n") + 1)
                texts[k], gone = without(texts[k], runs or [])
                removed.append([{"start": s, "count": c} for s, c in gone])
            cols = [b.column(k) for k in range(len(names))]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32())]))
            more = [pa.array(removed, kind), pa.array(n_lines, pa.int32())] if report else []
            yield pa.RecordBatch.from_arrays([*cols, *more], [*names, "removed", "n_lines"][: len(cols) + len(more)])

    from pyspark.sql import types as T

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("count", T.IntegerType())]))
    more = [T.StructField("removed", span), T.StructField("n_lines", T.IntegerType())] if report else []
    schema = T.StructType([*docs.schema.fields, *more])
    return joined.mapInArrow(lean(run), schema)


def without(text: bytes | None, runs: list[dict]) -> tuple[bytes | None, list[tuple[int, int]]]:
    """A text without its runs, and the maximal deleted spans as (line number, count)."""
    if not runs or text is None:
        return text, []
    lines = text.split(b"\n")
    number = [k for k, _ in text_lines(text)]
    cover = np.zeros(len(number) + 1, np.int64)
    for r in runs:
        cover[r["i"]] += 1
        cover[r["i"] + r["m"]] -= 1
    inside = np.r_[0, np.cumsum(cover)[:-1] > 0, 0]
    spans = []
    for s, e in zip(np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1), strict=True):
        spans.append((number[s], number[e - 1] - number[s] + 1))
    for s, c in reversed(spans):
        del lines[s : s + c]
    return b"\n".join(lines), spans


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat(s["start"], F.lit("+"), s["count"])), " ")
    return out.select("doc_id", "text", spans.alias("removed"), "n_lines")


#: Every run of four words lies in at most four lines, so all runs of up to four lines are compared.
SQL = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
every AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM raw),
seq AS (
  SELECT doc_id, ln, s, len(string_split_regex(s, '[ \t\n\v\f\r]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS i
  FROM (SELECT doc_id, ln, regexp_replace(line, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') AS s FROM every) WHERE s <> ''),
runs AS (
  SELECT a.doc_id, a.i, m.m, list(b.s ORDER BY b.i) AS key
  FROM seq a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m) m JOIN seq b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.i < a.i + m.m
  GROUP BY 1, 2, 3 HAVING COUNT(*) = m.m AND SUM(b.w) >= 4),
later AS (SELECT * FROM (SELECT doc_id, i, m, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS copy FROM runs) WHERE copy > 1),
dead AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS i FROM later),
spans AS (
  SELECT doc_id, MIN(ln) AS a, MAX(ln) AS b
  FROM (SELECT doc_id, ln, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM dead JOIN seq USING (doc_id, i)) GROUP BY doc_id, island),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM every e
  WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = e.doc_id AND e.ln BETWEEN s.a AND s.b) GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce((SELECT string_agg(a || '+' || (b - a + 1), ' ' ORDER BY a) FROM spans s WHERE s.doc_id = d.doc_id), '') AS removed,
  CAST(coalesce(len(r.ls), 0) AS INTEGER) AS n_lines
FROM documents d LEFT JOIN raw r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": SQL}
