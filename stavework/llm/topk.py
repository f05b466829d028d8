"""Exact top-k inner products by norm buckets: local cosine thresholds choose coordinate or length pruning per bucket.

Vectors are grouped by length. Against a bucket whose longest vector has length l, a query of length q needs a cosine
of at least theta / (q * l) to reach its present k-th score theta. Over 1 the bucket is skipped; where the local threshold
is high, the query's strongest coordinates bound what a partner's coordinates may be; where it is low, only lengths are compared.
What is left is multiplied out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stavework.session import share

BUCKET_RATIO = 1.05
BLOCK = 1000
SEEDS = 2000
HIGH_COSINE, FOCUS = 0.6, 4
_EXACT = float(1 << 53)


def scaled(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component in double precision; null for a null vector or one with a null or non-finite component.

    Components are kept within +-2^52, where doubles hold every integer.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    limit = float(1 << 52)
    return F.when(~bad, F.transform(vector, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(x.cast("double") * factor).cast("double")))))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of doubles; shorter vectors are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets)).astype(int)
    flat = np.asarray(column.flatten(), float)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max() if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))


def _products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held within long range."""
    if np.sqrt((q * q).sum()) * (np.sqrt((rows * rows).sum(axis=1)).max() if len(rows) else 0) < _EXACT:
        return (rows @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([min(max(sum(a * int(b) for a, b in zip(whole, r)), -(1 << 63)), (1 << 63) - 1) for r in rows], np.int64)


def block_search(queries: np.ndarray, theta: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """(query place, row ids, scores) of each query's best k in one block of rows with scores of at least theta."""
    queries, rows = _aligned(queries, rows)
    lengths = np.sqrt((rows * rows).sum(axis=1))
    unit = rows / np.maximum(lengths, 1e-300)[:, None]
    longest = lengths.max()
    for i, q in enumerate(queries):
        size = float(np.sqrt((q * q).sum()))
        reach = size * longest
        live = np.arange(len(rows))
        if np.isfinite(theta[i]):
            if theta[i] > reach * (1 + 1e-12) + 1e-6:
                continue
            cosine = theta[i] / reach if reach > 0 else 0.0
            if cosine >= HIGH_COSINE:
                slack = 1e-9
                direction = q / size
                for f in np.argsort(-np.abs(direction), kind="stable")[:FOCUS]:
                    x = direction[f]
                    spread = np.sqrt(max(0.0, 1 - x * x) * max(0.0, 1 - cosine * cosine))
                    low = x * cosine - spread if x > -cosine else -1.0
                    high = x * cosine + spread if x < cosine else 1.0
                    live = live[(unit[live, f] >= low - slack) & (unit[live, f] <= high + slack)]
            elif theta[i] > 0:
                live = live[lengths[live] * size >= theta[i] * (1 - 1e-12) - 1e-6]
        live = live[ids[live] != own[i]]
        if not len(live):
            continue
        scores = _products(q, rows[live])
        keep = np.flatnonzero(scores >= theta[i]) if np.isfinite(theta[i]) else np.arange(len(scores))
        best = keep[np.lexsort((ids[live[keep]], -scores[keep]))[:k]]
        if len(best):
            yield i, ids[live[best]], scores[best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k highest integer inner products of every query row with all other rows.

    * Components become floor(1024 * x). Ties go to the smaller id. With fewer than k other rows, all are returned.
    * Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors of different lengths are padded
      with zeros; an empty vector scores 0 with all. An id names one vector: of rows with the same id the greatest vector counts.
    * Each query starts from its k-th score among a bounded set of longest vectors, then meets every block of every bucket
      it can still reach. Blocks hold about BLOCK rows or queries, whatever the sizes of buckets. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), scaled(F.col(vector_col)).alias("v"), is_query.alias("asks")).where("id is not null and v is not null")
    rows = rows.groupBy("id").agg(F.max("v").alias("v"), F.max("asks").alias("asks"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    bucket = F.floor(F.log(F.greatest(norm, F.lit(1e-9))) / float(np.log(BUCKET_RATIO))).cast("int")
    rows = share(rows.withColumn("norm", norm).withColumn("bucket", bucket))
    buckets = share(rows.groupBy("bucket").agg(F.count("*").alias("size"), F.max("norm").alias("longest")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = rows.join(buckets.select("bucket", blocks.alias("blocks")), "bucket").select("bucket", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "v")
    asked = rows.where("asks").select("id", "v", "norm")
    asking = asked.count()
    groups = max(1, -(-asking // BLOCK))
    seeds = share(rows.orderBy(F.desc("norm"), "id").limit(SEEDS).select("id", "v"))
    known = seeds.toArrow()
    seed_rows, seed_ids = (_matrix(known.column("v")), np.asarray(known.column("id"))) if known.num_rows else (np.zeros((0, 0)), np.zeros(0, np.int64))

    def lower_bounds(batches):
        for batch in batches:
            queries, own = _matrix(batch.column("v")), np.asarray(batch.column("id"))
            theta = np.full(len(own), -np.inf)
            if len(seed_rows):
                for i, _, scores in block_search(queries, theta, seed_rows, seed_ids, own, k):
                    if len(scores) == k:
                        theta[i] = scores[-1]
            yield pa.record_batch([batch.column("id"), batch.column("v"), batch.column("norm"), pa.array(theta)], names=["id", "v", "norm", "theta"])

    asked = asked.repartition(F.pmod(F.xxhash64("id"), F.lit(groups))).mapInArrow(lower_bounds, "id long, v array<double>, norm double, theta double")
    asked = share(asked.withColumn("qgroup", F.pmod(F.xxhash64("id", F.lit("q")), F.lit(groups)).cast("int")))
    reach = buckets.select("bucket", "longest", blocks.alias("blocks"))
    pairs = asked.join(reach, F.col("theta") <= F.col("norm") * F.col("longest") * (1 + 1e-12) + 1e-6)
    pairs = pairs.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "qgroup", "id", "v", "theta")
    copies = placed.withColumn("qgroup", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else placed.withColumn("qgroup", F.lit(0))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if left.num_rows and right.num_rows:
            own = np.asarray(left.column("id"))
            for i, ids, scores in block_search(_matrix(left.column("v")), np.asarray(left.column("theta")), _matrix(right.column("v")), np.asarray(right.column("id")), own, k):
                out[0].append(np.full(len(ids), own[i])), out[1].append(ids), out[2].append(scores)
        return pa.table({name: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for name, x in zip(("query_id", "id", "score"), out)})

    keys = ["bucket", "block", "qgroup"]
    found = pairs.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
