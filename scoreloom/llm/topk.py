"""Exact top-k search by tiled matrix products.

Queries are handed out in blocks of bounded size, one block after the other; its lists are written before the next is handed out. Each task holds a tile of its own shard of the
vectors at a time, multiplies it with tiles of the queries, selects the best of each query within
the tile and folds them into its running list. The lists of the tasks meet in a merge tree, sixteen at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch, stored

QUERY_TILE, SHARD_TILE = 512, 4096
#: Bytes of a block of queries as doubles; what is broadcast at once.
BLOCK_BYTES = 16 << 20
FAN = 16
SCALE = 256
FLOOR, CEILING = -(2**63), 2**63 - 1


def _matrices(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, scaled and floored components) of the vectors that are whole and finite, by length."""
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
    for n in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        part = flat[offsets[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))
        good = np.isfinite(part).all(axis=1)
        scaled = np.floor(SCALE * part[good])
        whole = np.isfinite(scaled).all(axis=1)
        yield n, rows[good][whole], scaled[whole]


def _product(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products as doubles where these are exact, else as Python's integers, held to 64 bits."""
    most = max(1, queries.shape[1]) * max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(shard).max(initial=0))
    if most * SHARD_TILE < 2**52:
        return queries @ shard.T
    exact = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    out = exact(queries) @ exact(shard).T if queries.shape[1] else np.zeros((len(queries), len(shard)), object)
    return np.clip(out, FLOOR, CEILING)


class _Best:
    """The best k candidates so far of each query of one vector length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.score: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, shard: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, shard = ids[order], shard[order]
        n = len(ids)
        for at in range(0, len(self.ids), QUERY_TILE):
            own = self.ids[at : at + QUERY_TILE]
            score = _product(self.rows[at : at + QUERY_TILE], shard)
            left, right = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
            if score.dtype == object:
                for q, row in enumerate(score):
                    self._fold(at + q, sorted(((-s, int(i)) for s, i in zip(row, ids) if i != own[q]))[: self.k])
                continue
            # Ids ascend within the tile: the score and then the place make one exact number.
            key = score * SHARD_TILE + np.arange(n - 1, -1, -1.0)
            for q in np.flatnonzero(right > left):
                key[q, left[q] : right[q]] = -np.inf
            hopeful = np.flatnonzero((key.max(axis=1) >= (self.least[at : at + QUERY_TILE]) * SHARD_TILE) & (key.max(axis=1) > -np.inf))
            some = key[hopeful]
            top = np.argpartition(some, n - self.k, axis=1)[:, n - self.k :] if n > self.k else np.broadcast_to(np.arange(n), (len(some), n))
            for q, picked in zip(hopeful, top):
                self._fold(at + q, [(-int(score[q, j]), int(ids[j])) for j in picked if key[q, j] > -np.inf])

    def _fold(self, q: int, found: list[tuple[int, int]]) -> None:
        self.score[q] = sorted(self.score[q] + found)[: self.k]
        if len(self.score[q]) == self.k:
            self.least[q] = -self.score[q][-1][0]


def _search(handed, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: _Best(ids, rows, k) for n, (ids, rows) in handed.value.items()}
        for b in batches:
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            for n, rows, scaled in _matrices(b.column("embedding")):
                if n in best:
                    for at in range(0, len(rows), SHARD_TILE):
                        best[n].add(ids[rows[at : at + SHARD_TILE]], scaled[at : at + SHARD_TILE])
        part = TaskContext.get().partitionId()
        for x in best.values():
            out = [(int(q), -s, i, part) for q, row in zip(x.ids, x.score) for s, i in row]
            for at in range(0, len(out), 20_000):
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out[at : at + 20_000])], ["query_id", "score", "vec_id", "part"])

    return run


def _top(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query; ties go to smaller ids.

    Components x become floor(256 * x). Rows whose id or vector is null, or whose vector holds a null, an infinite or
    a not-a-number, take no part; vectors meet those of their own length only. A row with the query's id is never its candidate.
    Candidates that repeat an id count each; of queries that repeat an id, one is asked. Scores beyond 64 bits are held
    to them. A query with fewer candidates gets fewer rows; an empty table gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    mine = lambda df: df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    asked, shard = mine(queries), mine(vectors)
    held = asked.agg(F.sum(8 * F.size("embedding") + 16).alias("bytes")).first().bytes or 0
    blocks, path = int(held // BLOCK_BYTES) + 1, scratch(spark, "lists")
    fields = "query_id long, score long, vec_id long, part long"
    asked, width = stored(asked, "queries"), shard.rdd.getNumPartitions()
    spark.createDataFrame([], fields).write.parquet(path)
    for block in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        ids, by_length = table.column("vec_id").to_numpy(), {}
        for n, rows, scaled in _matrices(table.column("embedding").combine_chunks()):
            own, first = np.unique(ids[rows], return_index=True)
            by_length[n] = (own, scaled[first])
        if by_length:
            handed = spark.sparkContext.broadcast(by_length)
            shard.mapInArrow(_search(handed, k), fields).write.mode("append").parquet(path)
            handed.destroy()
    discard(asked)
    lists = spark.read.schema(fields).parquet(path)
    while width > FAN:
        lists = _top(lists.withColumn("part", F.expr(f"part div {FAN}")), ["query_id", "part"], k).drop("rank")
        width = -(-width // FAN)
    return _top(lists, ["query_id"], k).select("query_id", "rank", "vec_id", "score")
