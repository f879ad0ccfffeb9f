"""Queries that arrive as a stream are answered a micro-batch at a time (see ``search_stream``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.matrix import unpacked


def search_stream(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Answers a stream of query vectors with ``answer`` and appends parquet at ``path``.

    Vectors come packed, a row a query (row_id, indices, data), and so are whole in their micro-batch.  As entries
    (row_id, col_id, val) they are taken too, where all entries of a query arrive in one micro-batch.  A batch that is run again overwrites its own folder.
    """

    whole = {"indices", "data"} <= set(queries.columns)

    def batch(rows: DataFrame, number: int) -> None:
        answer(unpacked(rows) if whole else rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
