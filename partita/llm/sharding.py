"""Mixture-preserving shards by proportional stratified interleaving, in DataFrame functions only.

Within each source the rows are shuffled by a seeded hash and ranked; rank r of n rows becomes the
fractional rank (r + u) / n with a seeded offset u in [0, 1) for the source.  Sorted by fractional rank,
any contiguous cut holds every source in proportion, to within a row or two per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, ranked_in, rows_per_bucket, table

#: Hexadecimal digits of a hash that make a number, which then fits in a long.
DIGITS = 15
#: Buckets are at most this many, so that their counts always fit in one task.
MOST_BUCKETS = 1 << 16
UNITS = 1 << 20


def seeded(seed: int, *cols: str) -> F.Column:
    """A number of 60 bits from a seed and columns, null or not, the same in any engine with md5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary")), 1, DIGITS), 16, 10).cast("long")


def stratified_shards(
    docs: DataFrame, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, source, fraction): each row in one of ``shards``.

    The law is ``rows``: shard sizes are at most one row apart, and slots run from 0 without gaps.  A null
    source is a source of its own; a null text counts as empty (size 1, checksum 0).  Repeated rows are
    shuffled like any others and keep their number; rows equal in id, text and source are
    interchangeable, counted first and dealt out afterwards, so no task holds all of them.  Null ids are kept.  Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    base = base.withColumn("mix", seeded(seed, "doc_id", "text_crc32"))
    base = scratch.write(base, "rows")
    n = base.count()
    buckets = min(MOST_BUCKETS, rows_per_bucket(n))
    bits = buckets.bit_length() - 1
    high = F.shiftright("mix", 4 * DIGITS - bits)  # the hash's upper bits: grows with the hash
    ranked = ranked_in(base, "source", ["mix", "doc_id", "size"], high, "rank", copies=True)
    of = base.groupBy("source").agg(F.count(F.lit(1)).alias("of")).withColumnRenamed("source", "_s")
    ranked = ranked.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    offset = (seeded(seed, "source") % UNITS) / F.lit(float(UNITS))
    ranked = scratch.write(ranked.withColumn("fraction", (F.col("rank") + offset) / F.col("of")).withColumn("all", F.lit(0)), "ranked")
    scratch.drop("rows")
    part = F.floor(F.col("fraction") * buckets)
    placed = ranked_in(ranked, "all", ["fraction", "source", "mix", "doc_id", "size"], part, "place")
    shard = F.expr(f"(place * {shards}) div {max(n, 1)}").cast("int")
    first = F.expr(f"((place * {shards}) div {max(n, 1)} * {n} + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), (F.col("place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source", "fraction",
    )


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(table(spark, sf_dir, "documents"))


SQL = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
bytes AS (
  SELECT doc_id, source, text, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)) AS b
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents)),
base AS (
  SELECT doc_id, source, size, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) AS text_crc32 FROM bytes, tab),
mixed AS (SELECT *, CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text_crc32), 1, 15) AS BIGINT) AS mix FROM base),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY mix, doc_id NULLS FIRST, size) - 1 AS r, COUNT(*) OVER (PARTITION BY source) AS n,
    (CAST('0x' || substr(md5('7|' || coalesce(source, '')), 1, 15) AS BIGINT) % 1048576) / 1048576.0::DOUBLE AS u FROM mixed),
placed AS (
  SELECT *, (r + u) / n AS fraction, row_number() OVER (ORDER BY (r + u) / n, source NULLS FIRST, mix, doc_id NULLS FIRST, size) - 1 AS place, COUNT(*) OVER () AS total FROM ranked),
cut AS (SELECT *, (place * 8) // total AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  place - (shard * total + 7) // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source, fraction
FROM cut
"""
QUERIES = {"op6_stratified_shards": op6_stratified_shards}
ORACLES = {"op6_stratified_shards": SQL}
