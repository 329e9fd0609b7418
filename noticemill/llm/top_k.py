"""Exact top-k inner products by block-at-a-time pruning over document-range blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut

LONG = 2**63
EXACT = 2**53  # whole numbers below this are exact in doubles


def scaled(column: str, factor: int = 1024) -> Column:
    """Components as floor(factor * x), or null where a component or the vector is null or not finite."""
    values = F.col(column)
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    whole = F.transform(values, lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return F.when(F.forall(values, finite), whole)


def search(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, block: int):
    """(scores, ids, valid): the ``k`` best of ``vectors`` for each query, best first, ties by smaller id.

    ``vectors`` stand in blocks of neighbouring rows.  A block's bound is the sum over components of the larger of
    query times the component's largest and smallest value.  Each query visits its blocks by falling bound, scores
    them through the block's rows, and stops when a bound falls below its kth score.
    """
    n, m = len(queries), len(vectors)
    most = max((int(np.abs(a).max()) for a in (queries, vectors) if a.size), default=0)
    exact = all(abs(int(a.min())) < EXACT and int(a.max()) < EXACT for a in (queries, vectors) if a.size)
    kind = np.float64 if exact and most * most * max(vectors.shape[1], 1) < EXACT else object
    q, v = queries.astype(kind), vectors.astype(kind)
    starts = np.arange(0, m, block)
    high, low = np.maximum.reduceat(v, starts, axis=0), np.minimum.reduceat(v, starts, axis=0)
    zero = kind(0) if kind is np.float64 else 0
    bounds = np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    none = -np.inf if kind is np.float64 else -(10**60)
    best, best_id = np.full((n, k), none, kind), np.full((n, k), LONG - 1, np.int64)
    active = np.arange(n)
    for turn in range(len(starts)):
        at = order[active, turn]
        keep = bounds[active, at] >= best[active, k - 1]
        active, at = active[keep], at[keep]
        if not len(active):
            break
        for b in np.unique(at):
            rows = active[at == b]
            these = slice(starts[b], starts[b] + block)
            score = q[rows] @ v[these].T
            score[own[rows][:, None] == ids[these][None, :]] = none
            scores = np.concatenate([best[rows], score], axis=1)
            found = np.concatenate([best_id[rows], np.broadcast_to(ids[these], score.shape)], axis=1)
            for r in range(0) if kind is np.float64 else range(len(rows)):
                top = sorted(range(scores.shape[1]), key=lambda c, r=r: (-scores[r, c], found[r, c]))[:k]
                best[rows[r]], best_id[rows[r]] = scores[r, top], found[r, top]
            if kind is np.float64:
                top = np.lexsort((found, -scores), axis=1)[:, :k]
                best[rows], best_id[rows] = np.take_along_axis(scores, top, 1), np.take_along_axis(found, top, 1)
    return best, best_id, best != none


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """(part, dim, ids, vectors): (id, v) rows of a partition in their order, by dimension in runs of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, list[int]]]] = {}
        part = 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal part
            held = waiting.pop(dim)
            part += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([dim], pa.int32()),
                    pa.array([np.array([i for i, _ in held], np.int64).tobytes()], pa.binary()),
                    pa.array([np.array([v for _, v in held], np.int64).tobytes()], pa.binary()),
                ],
                names=["part", "dim", "ids", "vectors"],
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.setdefault(len(v), []).append((i, v))
                if len(waiting[len(v)]) == rows:
                    yield out(len(v))
        for dim in list(waiting):
            yield out(dim)

    packed = df.select("id", "v").mapInArrow(run, "part long, dim int, ids binary, vectors binary")
    return packed.withColumn("part", F.spark_partition_id() * 1_000_003 + F.col("part"))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, query_rows: int = 512, range_rows: int = 8192, block: int = 64
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products of each query, ties by smaller id.

    Both tables have (vec_id, embedding).  Components become floor(1024 * x).  Rows with a null id, a null vector or a
    null or non-finite component take no part, and vectors are compared only with queries of their own length; a query
    does not meet rows with its own id.  A query id that stands more than once is answered once, for its smallest
    vector; repeated candidates count each.  With fewer than ``k`` candidates all are given; empty tables give no rows.

    Vectors are sorted into ranges of ids and packed in runs of ``range_rows``, queries in runs of ``query_rows``; every
    pair of runs with equal length is one search by block bounds, and the k best of each run meet by query.  Runs are
    dealt over a salt, so no task holds all of them and memory does not grow with either table.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), scaled("embedding").alias("v")).filter(
        "id IS NOT NULL AND v IS NOT NULL"
    )
    asked = usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    ranges = _packed(usable(vectors).repartitionByRange(parts, "id", "v").sortWithinPartitions("id"), range_rows)
    ranges = cut(ranges).withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(parts)))
    blocks = cut(_packed(asked, query_rows)).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    )
    pairs = ranges.join(
        blocks.select("dim", "salt", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), ["dim", "salt"]
    ).select("dim", "ids", "vectors", "q_ids", "q_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, own = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                scores, found, valid = search(
                    np.frombuffer(q_data, np.int64).reshape(len(own), dim),
                    ids,
                    np.frombuffer(data, np.int64).reshape(len(ids), dim),
                    own,
                    k,
                    block,
                )
                row, _ = np.nonzero(valid)
                whole = [max(-LONG, min(LONG - 1, int(s))) for s in scores[valid]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[row]), pa.array(found[valid]), pa.array(whole, pa.int64())],
                    names=["query_id", "vec_id", "score"],
                )

    near = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    return near.selectExpr(
        "query_id",
        "cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank",
        "vec_id",
        "score",
    ).filter(F.col("rank") <= k)


def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s
)
SELECT * FROM r WHERE rank <= 10
"""
