"""Nearest vectors by cosine, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _blocks(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Rows (id, embedding) packed as blocks: one row holds up to `rows` unit vectors of a part of the table."""
    schema = pa.schema([(f"{name}_ids", pa.binary()), (f"{name}_units", pa.binary())])

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column("embedding")
                width = len(lists[0])
                matrix = np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, width)
                norm = np.linalg.norm(matrix, axis=1, keepdims=True)
                units = matrix / np.where(norm == 0, 1, norm)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().astype("<i8").tobytes()]), pa.array([units.astype("<f8").tobytes()])], schema=schema)

    return df.where("id is not null and embedding is not null").mapInArrow(pack, f"{name}_ids binary, {name}_units binary")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 30, min_score: float = 0.93, rows: int = 2048) -> DataFrame:
    """query_id, vec_id, score, place: for each query the k nearest other vectors with (1 + cosine) / 2 of at least min_score.

    queries and vectors: id (long), embedding. Blocks of queries meet blocks of vectors as one row each, a matrix product
    finds the best k of a pair of blocks, and a window the best of all. Equal scores go by vec_id.

    A grid of cells deals out the work: a block of vectors goes to one row of it, a block of queries to one column, and a cell
    joins what came to it by key. Nothing is broadcast, and a cell holds a bounded number of blocks of either side.
    """

    def lines(df: DataFrame, blocks: int) -> int:
        return max(1, -(-df.count() // (rows * blocks)))

    down, across = lines(vectors, 16), lines(queries, 4)
    deal = lambda df, name, n: _blocks(df, name, rows).withColumn(name, F.pmod(F.xxhash64(f"{name}_ids"), F.lit(n)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    pairs = deal(vectors, "v", down).withColumn("q", every(across)).join(deal(queries, "q", across).withColumn("v", every(down)), ["v", "q"]).drop("v", "q")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches):
        for batch in batches:
            for v_ids, v_units, q_ids, q_units in zip(*(batch.column(c) for c in ("v_ids", "v_units", "q_ids", "q_units"))):
                vid, qid = (np.frombuffer(x.as_py(), dtype="<i8") for x in (v_ids, q_ids))
                v, q = np.frombuffer(v_units.as_py(), dtype="<f8").reshape(len(vid), -1), np.frombuffer(q_units.as_py(), dtype="<f8").reshape(len(qid), -1)
                score = (1 + q @ v.T) / 2
                score[qid[:, None] == vid[None, :]] = -1
                order = np.lexsort((np.broadcast_to(vid, score.shape), -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, axis=1)
                row, col = np.nonzero(best >= min_score)
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(vid[order[row, col]]), pa.array(best[row, col])], schema=schema)

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)
