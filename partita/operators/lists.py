"""Inverted lists: for every component its best rows by exact score, capped."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .matrix import x_ht

#: Fixed value: lists hold this many times their even share of the rows.
OVERLAP = 10
#: Parts of a component's rows that are cut before they meet.
PARTS = 32


def list_cap(n_rows: int, k: int, overlap: float = OVERLAP) -> int:
    if k < 1:
        raise ValueError("at least one component is needed")
    return max(1, ceil(n_rows / k * overlap))


def admitted(scores: DataFrame, cap: int) -> DataFrame:
    """(comp, pos, doc_id, affinity) from (comp, doc_id, affinity): what a bounded heap fed in id order keeps.

    Positive scores only; the ``cap`` best, stored by falling score and, of equal scores, by falling id.  At the cap
    the heap keeps its early entries on a tie, but a better late row evicts the lowest id among the least: so of the
    rows tied at the cap score those survive that came among the first ``cap`` rows of at least that score, less the
    lowest ids that better rows pushed out.
    """
    # the first 2 cap by (falling score, id) hold every better row and the cap + 1 tied rows that come first, whatever the number of
    # ties; parts of a component are cut alone before it meets in one task
    order, twice = (F.desc("affinity"), "doc_id"), 2 * cap
    part = W.partitionBy("comp", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    kept = scores.where("affinity > 0").withColumn("r", F.row_number().over(part)).where(F.col("r") <= twice)
    kept = kept.withColumn("r", F.row_number().over(W.partitionBy("comp").orderBy(*order))).where(F.col("r") <= twice)
    kept = kept.withColumn("least", F.min(F.when(F.col("r") <= cap, F.col("affinity"))).over(W.partitionBy("comp")))
    kept = kept.where("affinity >= least").withColumn("tied", F.col("affinity") == F.col("least"))
    kept = kept.withColumn("better", F.sum((~F.col("tied")).cast("long")).over(W.partitionBy("comp")))
    kept = kept.withColumn("arrival", F.row_number().over(W.partitionBy("comp").orderBy("doc_id")))
    # a tied row stays if it arrived before the heap was full and is among the cap - better largest such ids
    early = F.col("tied") & (F.col("arrival") <= cap)
    kept = kept.withColumn("late", F.sum(early.cast("long")).over(W.partitionBy("comp").orderBy(F.desc("doc_id"))))
    kept = kept.where(~F.col("tied") | (early & (F.col("late") <= F.lit(cap) - F.col("better"))))
    place = W.partitionBy("comp").orderBy(F.desc("affinity"), F.desc("doc_id"))
    return kept.select("comp", (F.row_number().over(place) - 1).cast("int").alias("pos"), "doc_id", "affinity")


def build_lists(x: DataFrame, h: DataFrame, cap: int, k: int = 0) -> DataFrame:
    """The lists of all components over all rows of X, by their exact scores whatever the scale of X."""
    scores = x_ht(x, h, k).select("comp", F.col("row_id").alias("doc_id"), F.col("val").alias("affinity"))
    return admitted(scores, cap)


def list_sizes(lists: DataFrame, k: int) -> DataFrame:
    """(comp, size) for all k components, 0 for empty lists."""
    comps = lists.sparkSession.range(k).select(F.col("id").cast("int").alias("comp"))
    sizes = lists.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    return comps.join(sizes, "comp", "left").select("comp", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
