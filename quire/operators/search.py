"""Exact nearest rows of a stated set of queries, taken in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that go to the tasks at once.
BLOCK = 4096


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_top(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k rows of the largest cosine for each query, its own left out; ties to the smaller id.

    Each block of queries is sent to all tasks; these keep the k best of every batch of rows, so what is shuffled grows
    with the queries and the batches. Keys are unique, vectors all of one length and none of them zero.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = None
    for number in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == number).select(key, vector).toArrow()
        ids = mine[0].to_numpy()
        asked = _vectors(mine[1].combine_chunks()) if len(ids) else np.zeros((0, 1))

        def top(batches: Iterator[pa.RecordBatch], ids=ids, asked=asked) -> Iterator[pa.RecordBatch]:
            unit = asked / np.sqrt((asked * asked).sum(1, keepdims=True))
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                others, x = batch.column(0).to_numpy(), _vectors(batch.column(1))
                scores = unit @ (x / np.sqrt((x * x).sum(1, keepdims=True))).T
                scores[ids[:, None] == others[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(others, scores.shape), -scores), axis=1)[:, :k]
                near = np.take_along_axis(scores, order, 1)
                kept = np.isfinite(near)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, kept.sum(1))), pa.array(others[order][kept]), pa.array(near[kept])], ["query_id", "vec_id", "score"])

        part = rows.select(key, vector).mapInArrow(top, "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")
