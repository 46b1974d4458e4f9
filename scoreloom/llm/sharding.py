"""Sharding by a keyed permutation of global row numbers.

Rows are numbered 0..n-1 in the order of (id, size, checksum), whatever the partitioning of the
input. A Feistel network over the least even number of bits that holds n, walked along its cycle
until it lands below n, permutes the numbers; shard and slot are the remainder and the quotient of the
permuted number by the count of shards. Both directions can be computed for any one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

ROUNDS = 6
SEED = 20240229


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of xor-shifts and odd multipliers."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(x) for x in _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), seed & (2**64 - 1))]


def _half(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _walk(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    h = _half(n)
    mask, shift = np.uint64((1 << h) - 1), np.uint64(h)
    keys = _keys(seed)[::-1] if back else _keys(seed)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for key in keys:
            if back:
                left, right = right ^ (_mixed(left, key) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, key) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Where the rows of these numbers stand in the shuffle of n rows."""
    return _walk(np.asarray(rows), n, seed, False)


def restore(places: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The row numbers at these places: the inverse of permute()."""
    return _walk(np.asarray(places), n, seed, True)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, done = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(done, done + b.num_rows))], [*b.schema.names, "part", "nth"])
        done += b.num_rows


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, row_number, shard, slot.

    Shard counts differ by one at most; slots of a shard run from 0 without gaps. size is the UTF-8 length plus 1; a
    null text has length 0. Null ids come first in the numbering. Rows that repeat whole get numbers
    side by side, one each. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    bare = pick(docs, doc_id=id_col, text=text_col)
    body = F.coalesce("text", F.lit("")).cast("binary")
    light = bare.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    kind = dict(light.dtypes)["doc_id"]
    order = ("doc_id", "size", "text_crc32")
    columns = f"doc_id {kind}, size long, text_crc32 long"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(light.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_number, f"{columns}, part int, nth long"))
    # One count for each partition, not for each row.
    counts = np.zeros(1 + max((rows := {r.part: r["count"] for r in placed.groupBy("part").count().collect()}), default=0), np.int64)
    for part, n in rows.items():
        counts[part] = n
    total, starts = int(counts.sum()), np.cumsum(counts) - counts

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = starts[b.column("part").to_numpy()] + b.column("nth").to_numpy()
            place = permute(number, total, seed)
            yield pa.record_batch([*b.columns[:3], pa.array(number), pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], ["doc_id", "size", "text_crc32", "row_number", "shard", "slot"])

    return placed.mapInArrow(assign, f"{columns}, row_number long, shard int, slot long")


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs in one folder for each shard, ordered by slot within each file. Ids must be unique and not null here."""
    where = shard_rows(docs, shards, seed, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    joined = docs.join(where, docs[id_col] == where["__id"]).drop("__id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined.repartitionByRange(max(parts, shards), "__shard", "__slot").sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)
