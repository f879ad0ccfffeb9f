"""Ordering helpers for the corpus operators, and the storage they share with the rest of the package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, shared_dir, ship, table

__all__ = ["KEPT", "Scratch", "lean", "ranked_in", "rows_per_bucket", "shared_dir", "ship", "slices", "table"]


#: What a worker keeps from task to task, by name; tasks that do not use it drop it.
KEPT: dict = {}


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, leaving its worker small: workers stay for later tasks of any kind, and what they hold adds up.

    What earlier tasks kept is dropped unless ``keep``, and memory that is free afterwards goes back to the system.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            KEPT.clear()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return whole


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that copies of whole texts stay small; an empty batch as it is."""
    for b in batches:
        for k in range(0, max(1, b.num_rows), rows):
            yield b.slice(k, rows)


def rows_per_bucket(n: int, target: int = 4096) -> int:
    """How many buckets keep about ``target`` rows each; at least 256 so that small inputs spread too."""
    return 1 << max(8, (max(n, 1) // target).bit_length())


#: Copies of equal rows that are numbered together.
COPIES = 4096


def ranked_in(df: DataFrame, group: str, order: list, bucket, rank: str, copies: bool = False) -> DataFrame:
    """Adds the 0-based rank of each row within ``group`` by (bucket, order), without one task per group.

    ``bucket`` is an expression that does not decrease along the wanted order.  Rows are counted per
    (group, bucket) with map-side sums, the counts are summed over the buckets of a group, and only
    rows of one bucket are sorted together; so a group holding a third of all rows is spread out.  With
    ``copies``, rows equal in every column are counted with map-side sums too, ranked as one and
    numbered afterwards in parts of ``COPIES`` rows that are dealt out; rows that only the
    columns outside ``order`` tell apart follow those columns.
    """
    from pyspark.sql import Window as W

    names = df.columns
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        F.col(group).alias("_g"),
        F.col("_b").alias("_c"),
        (F.sum("_n").over(W.partitionBy(group).orderBy("_b")) - F.col("_n")).alias("_before"),
    )
    b = b.groupBy(*names, "_b").agg(F.count(F.lit(1)).alias("_m")) if copies else b.withColumn("_m", F.lit(1))
    rest = [c for c in names if copies and c not in order]
    rows = W.partitionBy(group, "_b").orderBy(*order, *rest)
    upto = F.sum("_m").over(rows.rowsBetween(W.unboundedPreceding, W.currentRow)) if copies else F.row_number().over(rows)
    joined = b.withColumn("_k", upto - F.col("_m")).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    ranked = joined.withColumn(rank, F.col("_before") + F.col("_k"))
    if copies:
        parts = ranked.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(COPIES).cast("long"))))
        # a number of its own, as few bytes here may stand for many rows and would be put together
        parts = parts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(group, rank, "_at"))
        last = F.least(F.col("_at") + COPIES, F.col("_m")) - 1
        ranked = parts.withColumn("_at", F.explode(F.sequence(F.col("_at"), last))).withColumn(rank, F.col(rank) + F.col("_at"))
    return ranked.select(*names, rank)
