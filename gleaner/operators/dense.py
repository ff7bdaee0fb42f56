"""The dense leg: exact top-k by dot product for a table of query vectors.

Vectors are scored by matrix products over Arrow batches with a local top-k, so what is shuffled is k rows per query and
batch. A query set within ``SENT_FLOATS`` numbers (measured first) goes to the executors whole; a larger one meets the
vectors block by block in a shuffled co-grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import ranking
from gleaner.operators.sparse import DIGITS, top_k

SENT_FLOATS = 4_000_000
BLOCK_ROWS = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(qids: pa.Array, q: np.ndarray, ids: pa.Array, x: np.ndarray, k: int, schema: pa.Schema) -> pa.RecordBatch:
    """At least the k best of some vectors for each query."""
    order, rows, columns, scores = ranking.places(ids), [], [], []
    for i in range(0, len(q), 256):
        s = np.round(q[i : i + 256] @ x.T, DIGITS) + 0.0
        r, c = ranking.best(s, k, order)
        rows.append(r + i)
        columns.append(c)
        scores.append(s[r, c])
    if not rows or not len(x):
        return pa.RecordBatch.from_pylist([], schema=schema)
    return pa.RecordBatch.from_arrays([qids.take(pa.array(np.concatenate(rows))), ids.take(pa.array(np.concatenate(columns))), pa.array(np.concatenate(scores))], schema=schema)


def usable(rows: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector has the index's width."""
    return rows.where(F.col(vec).isNotNull() & (F.size(vec) == dim))


def scores(queries: DataFrame, vectors: DataFrame, k: int, dim: int, sent_floats: int = SENT_FLOATS) -> DataFrame:
    """(qid, id, score): at least the k best rows of vectors(id, vec) for every row of queries(qid, vec)."""
    from pyspark.sql.pandas.types import to_arrow_type

    q, v = usable(queries.select("qid", "vec"), "vec", dim), usable(vectors.select("id", "vec"), "vec", dim)
    schema = pa.schema([("qid", to_arrow_type(q.schema["qid"].dataType)), ("id", to_arrow_type(v.schema["id"].dataType)), ("score", pa.float64())])
    out = f"qid {q.schema['qid'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, score double"
    n = q.count()
    if n * dim <= sent_floats:
        t = q.toArrow()
        qids, matrix = t.column("qid").combine_chunks(), _matrix(t.column("vec")) if n else np.zeros((0, dim))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _best(qids, matrix, b.column("id"), _matrix(b.column("vec")), k, schema)

        return v.mapInArrow(scan, out)
    qb, vb = -(-n // BLOCK_ROWS), max(1, -(-v.count() // BLOCK_ROWS))
    left = q.select("qid", F.col("vec").alias("qvec"), F.pmod(F.xxhash64("qid"), F.lit(qb)).alias("qi"), F.explode(F.sequence(F.lit(0), F.lit(vb - 1))).alias("qj"))
    right = v.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(vb)).cast("int").alias("j"), F.explode(F.expr(f"sequence(0L, {qb - 1}L)")).alias("i"))

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.Table.from_batches([], schema=schema)
        return pa.Table.from_batches([_best(a.column("qid").combine_chunks(), _matrix(a.column("qvec")), b.column("id").combine_chunks(), _matrix(b.column("vec")), k, schema)])

    return left.groupBy("qi", "qj").cogroup(right.groupBy("i", "j")).applyInArrow(block, out)


def search(queries: DataFrame, vectors: DataFrame, k: int, dim: int, sent_floats: int = SENT_FLOATS) -> DataFrame:
    """(qid, id, score, rank): the k rows with the greatest dot product for each query; scores may be negative.

    Filters on vectors belong before the search. k <= 0 gives no rows. Vectors of another width or null are left out.
    """
    return top_k(scores(queries, vectors, max(k, 0), dim, sent_floats), k)
