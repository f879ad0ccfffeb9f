"""Top-k search: exact, by a fixed number of lists, and adaptive."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Scratch
from .matrix import row_dots, x_ht


#: Entries of a list that the adaptive search scores at first, at least, and how many times as many when these do not end it.
SLICE, GROWTH = 32, 4


@dataclass(frozen=True)
class NaiveParams:
    nprobe: int = 10
    list_factor: float = 1.0

    def label(self) -> str:
        return f"nprobe={self.nprobe};list_search_factor={self.list_factor:g}"


@dataclass(frozen=True)
class AdaptiveParams:
    max_misses: int = 30
    drop_ratio: float = 0.15

    def label(self) -> str:
        return f"max_misses={self.max_misses};dr={self.drop_ratio:g}"


def list_depth(cap: int, factor: float) -> int:
    """How many entries of each list are looked at: at least one, halves rounded away from zero."""
    return max(1, min(int(cap * factor + 0.5), cap))


def query_ids(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("row_id").alias("query_id")).distinct()


def project(queries: DataFrame, h: DataFrame) -> DataFrame:
    """(query_id, comp, q_score): inner products of queries and components; absent where nothing is shared."""
    return x_ht(queries, h).select(F.col("row_id").alias("query_id"), "comp", F.col("val").alias("q_score"))


def rank_components(projected: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(query_id, comp, q_score, rank from 1) of all k components; missing scores are 0, ties go to the smaller comp."""
    all_ = ids.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("comp"))
    scored = all_.join(projected, ["query_id", "comp"], "left").withColumn("q_score", F.coalesce("q_score", F.lit(0.0)))
    best = W.partitionBy("query_id").orderBy(F.desc("q_score"), "comp")
    return scored.withColumn("rank", F.row_number().over(best).cast("int"))


def best_k(scored: DataFrame, top_k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the highest scores of each query, ties to the smaller id."""
    if top_k < 1:
        raise ValueError("top_k must be positive")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", "doc_id", "score")


def exact_top_k(queries: DataFrame, x: DataFrame, top_k: int) -> DataFrame:
    """Ground truth: the best rows by inner product, of those that share a column with the query."""
    qv = queries.select(F.col("row_id").alias("query_id"), "col_id", F.col("val").alias("_q"))
    xv = x.select(F.col("row_id").alias("doc_id"), "col_id", F.col("val").alias("_x"))
    dots = qv.join(xv, "col_id").groupBy("query_id", "doc_id").agg(F.sum(F.col("_q") * F.col("_x")).alias("score"))
    return best_k(dots, top_k)


def naive_candidates(ranked: DataFrame, lists: DataFrame, docs: DataFrame, cap: int, params: NaiveParams) -> DataFrame:
    """(query_id, doc_id): the heads of each query's first lists, once each; ``docs`` (doc_id) are the rows that can be scored."""
    probed, heads = _probed(ranked, lists, docs, cap, params)
    return probed.join(heads, "comp").select("query_id", "doc_id").distinct()


def _probed(ranked: DataFrame, lists: DataFrame, docs: DataFrame, cap: int, params: NaiveParams) -> tuple[DataFrame, DataFrame]:
    """(query_id, comp) of each query's first lists and (comp, doc_id) of the lists' heads."""
    heads = lists.where(F.col("pos") < list_depth(cap, params.list_factor)).join(docs, "doc_id", "left_semi")
    return ranked.where(F.col("rank") <= params.nprobe).select("query_id", "comp"), heads.select("comp", "doc_id")


def _sets(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.array_sort(F.collect_set("comp")).alias("comps"))


def count_candidates(ranked: DataFrame, lists: DataFrame, docs: DataFrame, cap: int, params: NaiveParams) -> int:
    """How many pairs ``naive_candidates`` gives, from counts of queries and rows with the same lists."""
    probed, heads = _probed(ranked, lists, docs, cap, params)
    q = _sets(probed, "query_id").groupBy(F.col("comps").alias("_q")).agg(F.count(F.lit(1)).alias("_nq"))
    d = _sets(heads, "doc_id").groupBy(F.col("comps").alias("_d")).agg(F.count(F.lit(1)).alias("_nd"))
    met = q.withColumn("comp", F.explode("_q")).join(d.withColumn("comp", F.explode("_d")), "comp").drop("comp").distinct()
    return met.agg(F.sum(F.col("_nq") * F.col("_nd"))).first()[0] or 0


def naive_search(queries: DataFrame, x: DataFrame, docs: DataFrame, ranked: DataFrame, lists: DataFrame, cap: int, top_k: int, params: NaiveParams | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the best of each query's candidates.

    Entries of queries and candidates meet by column and are kept where a list is shared, so candidates that share no column are
    never paired with the query; these score 0, and where the rest do not fill the result the smallest ids of them do.
    """
    params = params or NaiveParams()
    if top_k < 1:
        raise ValueError("top_k must be positive")
    probed, heads = _probed(ranked, lists, docs, cap, params)
    scratch = Scratch(x.sparkSession)
    probed = scratch.write(probed, "probed")
    qv = queries.select(F.col("row_id").alias("query_id"), "col_id", F.col("val").alias("_q")).join(_sets(probed, "query_id").withColumnRenamed("comps", "_in"), "query_id")
    xv = x.select(F.col("row_id").alias("doc_id"), "col_id", F.col("val").alias("_x")).join(_sets(heads, "doc_id").withColumnRenamed("comps", "_of"), "doc_id")
    met = qv.join(xv, "col_id").where(F.arrays_overlap("_in", "_of"))
    scored = scratch.write(met.groupBy("query_id", "doc_id").agg(F.sum(F.col("_q") * F.col("_x")).alias("score")), "scored")
    known = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("over"))
    short = probed.join(known, "query_id", "left").where(F.coalesce("over", F.lit(0)) < top_k)
    short = scratch.write(short.select("query_id", "comp", (F.coalesce("n", F.lit(0)) + top_k).alias("need")), "short")
    # the first n + top_k ids of a head hold its first top_k that share no column
    place = F.row_number().over(W.partitionBy("comp").orderBy("doc_id"))
    most = short.agg(F.max("need")).first()[0] or 0
    fill = short.join(heads.withColumn("at", place).where(F.col("at") <= most), "comp").where("at <= need").select("query_id", "doc_id").distinct()
    fill = fill.join(scored, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(0.0).alias("score"))
    return best_k(scored.union(fill) if most else scored, top_k)


def passing_lists(ranked: DataFrame, params: AdaptiveParams) -> DataFrame:
    """(query_id, rank, comp) of the lists that pass the cutoff: a positive score of at least drop_ratio times the query's best."""
    best = F.max("q_score").over(W.partitionBy("query_id"))
    passing = ranked.withColumn("_best", best).where((F.col("q_score") > 0) & (F.col("q_score") >= F.col("_best") * params.drop_ratio))
    return passing.select("query_id", "rank", "comp")


class Walk:
    """One query's walk: the k best so far, what was seen, and the misses in the current list."""

    def __init__(self, top_k: int, max_misses: int):
        self.top_k, self.max_misses = top_k, max_misses
        self.heap: list[tuple[float, int, int]] = []  # (-score, order of visit, doc): the first visited of equal scores leads
        self.seen: set[int] = set()
        self.list, self.misses = -1, 0

    def visit(self, rank: int, doc: int, score: float) -> None:
        if rank != self.list:
            self.list, self.misses = rank, 0
        if self.misses < 0 or doc in self.seen:
            return  # the list is over, or the row is known, which is no miss
        self.seen.add(doc)
        if len(self.heap) < self.top_k or score > -self.heap[-1][0]:
            insort(self.heap, (-score, len(self.seen), doc))
            del self.heap[self.top_k :]
            self.misses = 0
        else:
            self.misses += 1
        if self.misses >= self.max_misses:
            self.misses = -1


def adaptive_search(
    queries: DataFrame, x: DataFrame, docs: DataFrame, ranked: DataFrame, lists: DataFrame, top_k: int, params: AdaptiveParams | None = None
) -> DataFrame:
    """(query_id, rank, doc_id, score, processed): lists are left after ``max_misses`` misses in a row.

    A miss is a newly scored row that does not enter the k best so far; ``processed`` counts the rows that the walk scores.
    """
    return adaptive_rounds(queries, x, docs, ranked, lists, top_k, params)[0]


def adaptive_rounds(
    queries: DataFrame, x: DataFrame, docs: DataFrame, ranked: DataFrame, lists: DataFrame, top_k: int, params: AdaptiveParams | None = None
) -> tuple[DataFrame, DataFrame]:
    """The results, and (query_id, doc_id, score) of all rows that were scored for them.

    A round scores the next slice of each open list, by joins, and then walks through what is scored, a query at a time in visiting
    order.  A list that the walk leaves within its slice is never read further; where a slice ends before the walk leaves its
    list, the list is open and gets a slice ``GROWTH`` times as deep; the lists after it are walked as if it had ended, and may be read deeper
    than the walk needs in the end.  A query without open lists is done, and takes no part in later rounds.
    """
    if top_k < 1:
        raise ValueError("top_k must be positive")
    params = params or AdaptiveParams()
    scratch = Scratch(x.sparkSession)
    # positions among the rows that can be scored; a list is capped, so its window is too
    place = F.row_number().over(W.partitionBy("comp").orderBy("pos")).cast("long") - 1
    heads = scratch.write(lists.join(docs, "doc_id", "left_semi").select("comp", place.alias("pos"), "doc_id"), "heads")
    sizes = heads.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    first = F.lit(max(SLICE, min(params.max_misses, 1 << 30))).cast("long")
    depth = passing_lists(ranked, params).join(sizes, "comp").select("query_id", "rank", "comp", "size", F.lit(0).cast("long").alias("lo"), first.alias("hi"))
    depth, entries, scored, done, n = scratch.write(depth, "depth-0"), None, None, None, 0
    while True:
        fresh = depth.where("lo < hi").join(heads, "comp").where("pos >= lo and pos < hi").select("query_id", "rank", "pos", "doc_id")
        fresh = scratch.write(fresh, f"entries-{n}")
        pairs = fresh.select("query_id", "doc_id").distinct()
        pairs = pairs if scored is None else pairs.join(scored, ["query_id", "doc_id"], "left_anti")
        new = scratch.write(row_dots(x, queries, scratch.write(pairs, f"pairs-{n}")), f"scored-{n}")
        entries, scored = (fresh, new) if entries is None else (entries.union(fresh), scored.union(new))
        ends = depth.select("query_id", "rank", (F.col("size") > F.col("hi")).alias("more"))
        seq = entries.join(ends, ["query_id", "rank"]).join(scored, ["query_id", "doc_id"]).select("query_id", "rank", "pos", "doc_id", "score", "more")
        seq = seq.repartition("query_id").sortWithinPartitions("query_id", "rank", "pos")
        walked = scratch.write(seq.mapInArrow(_walk(top_k, params.max_misses), "query_id long, rank int, doc_id long, score double, processed long, open boolean"), f"walked-{n}")
        found = walked.where("not open").drop("open")
        done = found if done is None else done.union(found)
        wider = walked.where("open").select("query_id", "rank", F.lit(True).alias("open"))
        if not wider.limit(1).count():
            return done, scored
        left = depth.join(wider.select("query_id").distinct(), "query_id", "left_semi").join(wider, ["query_id", "rank"], "left")
        deeper = F.when(F.col("open"), F.col("hi") * GROWTH).otherwise(F.col("hi"))
        n += 1
        depth = scratch.write(left.select("query_id", "rank", "comp", "size", F.col("hi").alias("lo"), deeper.alias("hi")), f"depth-{n}")


def _walk(top_k: int, max_misses: int):
    """For each query its results, or the lists that must be read further before they are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, walk, wider, last, more = None, None, [], None, False

        def ended() -> None:
            if more and walk.misses >= 0:
                wider.append(last)

        def result() -> pa.RecordBatch:
            ended()
            best = sorted((s, d) for s, _, d in walk.heap)
            if wider:
                rows = [(query, r, None, None, None, True) for r in wider]
            else:
                rows = [(query, k, d, -s, len(walk.seen), False) for k, (s, d) in enumerate(best, 1)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["query_id", "rank", "doc_id", "score", "processed", "open"])

        for b in batches:
            for q, r, d, s, m in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True):
                if q != query or walk is None:
                    if walk is not None:
                        yield result()
                    query, walk, wider, last, more = q, Walk(top_k, max_misses), [], r, m
                elif r != last:
                    ended()
                    last, more = r, m
                walk.visit(r, d, s)
        if walk is not None:
            yield result()

    return run


def search(queries, x, docs, h, lists, k: int, cap: int, top_k: int, params: NaiveParams | AdaptiveParams | None = None) -> DataFrame:
    """Projects the queries on the components and searches by the strategy that ``params`` name."""
    if params is not None and not isinstance(params, (NaiveParams, AdaptiveParams)):
        raise TypeError(f"unknown parameters {params!r}")
    ranked = rank_components(project(queries, h), query_ids(queries), k)
    if isinstance(params, AdaptiveParams):
        return adaptive_search(queries, x, docs, ranked, lists, top_k, params)
    return naive_search(queries, x, docs, ranked, lists, cap, top_k, params)
