"""Readers and writers: matrices, ground truth, the index, results and metrics, as parquet tables in a folder."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matrix import dense, unpacked
from ..operators.search import AdaptiveParams, NaiveParams

MATRIX = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("col_id", T.LongType()), T.StructField("val", T.DoubleType())])
COMPONENTS = T.StructType([T.StructField("comp", T.IntegerType()), T.StructField("col_id", T.LongType()), T.StructField("val", T.DoubleType())])
LISTS = T.StructType([T.StructField("comp", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("affinity", T.DoubleType())])
META = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("algo", "task", "build_params", "search_params", "params")]
    + [T.StructField(n, T.DoubleType()) for n in ("build_time_sec", "query_time_sec")]
    + [T.StructField(n, T.LongType()) for n in ("k", "cap", "n_rows", "n_cols")]
)
#: What an index and its results say of themselves.
ALGO, TASK = "nmf-lists", "top-k"


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A sparse matrix as (row_id, col_id, val), from that form, from packed rows (indices, data) or from dense rows (values).

    The form is told by the columns, zeros are dropped, and any other form is an error.
    """
    df = spark.read.parquet(path)
    names = set(df.columns)
    if {"row_id", "col_id", "val"} <= names:
        return shaped(df, MATRIX).where("val <> 0")
    if {"row_id", "indices", "data"} <= names:
        return shaped(unpacked(df), MATRIX).where("val <> 0")
    if {"row_id", "values"} <= names:
        return shaped(dense(df, "row_id", "values"), MATRIX)
    raise ValueError(f"neither a sparse nor a dense matrix: {sorted(names)}")


def csr_entries(spark: SparkSession, data: list, indices: list, indptr: list, shape: tuple[int, int]) -> DataFrame:
    """Entries of a compressed-row matrix held in arrays on the driver, handed on as columns; bounds are checked."""
    data, indices, indptr = np.asarray(data, float), np.asarray(indices, np.int64), np.asarray(indptr, np.int64)
    length = np.diff(indptr)
    if len(indptr) != shape[0] + 1 or indptr[0] != 0 or indptr[-1] != len(data) or len(data) != len(indices) or (length < 0).any():
        raise ValueError("the arrays do not make a matrix of this shape")
    if len(indices) and not 0 <= indices.min() <= indices.max() < shape[1]:
        raise ValueError("the arrays do not make a matrix of this shape")
    columns = (np.repeat(np.arange(shape[0], dtype=np.int64), length), indices, data)
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=MATRIX.names), MATRIX).where("val <> 0")


def read_ground_truth(spark: SparkSession, path: str, one_based: bool = True) -> DataFrame:
    """(query_id, rank, doc_id) from (query_id, knns array), nearest first; ids from 0, absent entries dropped."""
    return ground_truth(spark.read.parquet(path), one_based)


def ground_truth(df: DataFrame, one_based: bool = True) -> DataFrame:
    out = df.select("query_id", F.posexplode("knns").alias("p", "d"))
    out = out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), (F.col("d") - int(one_based)).cast("long").alias("doc_id"))
    return out.where("doc_id >= 0")


def params_text(k: int, max_iter: int, params: NaiveParams | AdaptiveParams | None) -> str:
    return f"n_components={k};max_iter={max_iter};" + (params.label() if params else "")


def write_meta(spark: SparkSession, path: str, **values) -> None:
    """Inserts or replaces scalar attributes of the folder's one-row table."""
    now = read_meta(spark, path)
    now.update(values)
    spark.createDataFrame([tuple(now.get(f.name) for f in META)], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    """The attributes that are set; an empty dict where there are none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return {}
    row = spark.read.schema(META).parquet(f"{path}/meta").first()
    return {k: v for k, v in row.asDict().items() if v is not None}


def attribute(spark: SparkSession, path: str, name: str) -> str:
    """A text attribute, empty if unset."""
    return str(read_meta(spark, path).get(name, ""))


def write_index(h: DataFrame, lists: DataFrame, path: str, **meta) -> None:
    """Replaces the index's tables, and only them."""
    shaped(h, COMPONENTS).write.mode("overwrite").parquet(f"{path}/components")
    shaped(lists, LISTS).write.mode("overwrite").parquet(f"{path}/lists")
    write_meta(h.sparkSession, path, algo=ALGO, task=TASK, **meta)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return spark.read.schema(COMPONENTS).parquet(f"{path}/components"), spark.read.schema(LISTS).parquet(f"{path}/lists"), read_meta(spark, path)


def padded(results: DataFrame, ids: DataFrame, width: int, zero_based: bool = True) -> DataFrame:
    """(query_id, knns, dists): arrays of one width; ids from 1, with 0 and minus infinity for absent results."""
    got = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("r"))
    shift = F.lit(int(zero_based)).cast("long")
    knns = F.transform(F.coalesce("r.doc_id", F.array().cast("array<bigint>")), lambda d: d + shift)
    dists = F.coalesce(F.col("r.score"), F.array().cast("array<double>"))
    out = ids.select("query_id").distinct().join(got, "query_id", "left").select("query_id", knns.alias("k"), dists.alias("d"))
    gap = F.greatest(F.lit(0), F.lit(width) - F.size("k"))
    fill = (F.array_repeat(F.lit(int(zero_based) - 1).cast("long"), gap), F.array_repeat(F.lit(float("-inf")), gap))
    return out.select("query_id", F.slice(F.concat("k", fill[0]), 1, width).alias("knns"), F.slice(F.concat("d", fill[1]), 1, width).alias("dists"))


def write_results(results: DataFrame, ids: DataFrame, width: int, path: str, **meta) -> None:
    """Writes nothing where there are no results."""
    if results.limit(1).count():
        padded(results, ids, width).write.mode("overwrite").parquet(f"{path}/results")
        write_meta(results.sparkSession, path, algo=ALGO, task=TASK, **meta)


def read_results(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) of the first k results, padding dropped."""
    df = spark.read.parquet(f"{path}/results").select("query_id", F.posexplode(F.arrays_zip("knns", "dists")).alias("p", "e"))
    out = df.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), (F.col("e.knns") - 1).alias("doc_id"), F.col("e.dists").alias("score")).where("doc_id >= 0")
    return out.where(F.col("rank") <= k) if k else out


def metrics(spark: SparkSession, path: str, dataset: str, k: int, recall: float) -> dict:
    meta = read_meta(spark, path)
    return {
        "dataset": dataset, "k_evaluated": k, "build_time_sec": meta.get("build_time_sec"), "query_time_sec": meta.get("query_time_sec"),
        "build_params": meta.get("build_params", "unknown"), "search_params": meta.get("search_params", "unknown"), f"recall@{k}": round(recall, 4),
    }


def write_metrics(values: dict, path: str) -> None:
    """One small file on the driver."""
    with open(path, "w") as f:
        json.dump(values, f, indent=4)
