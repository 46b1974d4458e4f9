"""Exact deduplication by counting quotient filters.

Every input partition builds counting quotient filters of its text fingerprints, one for each
segment of the fingerprint space; the filters of a segment merge losslessly by their sorted
remainders. Fingerprints with a count above one are routed to byte verification, which groups the
whole normalised texts themselves; all other rows are known to be alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quotient_filter as cqf
from .common import cut, pick, power_of_two, small

#: Fingerprints that a task holds before it writes out its filters.
FILTER_ROWS = 1 << 20
#: Fingerprints that a segment should hold.
SEGMENT_ROWS = 1 << 19
#: Bits of the routing map for each repeated fingerprint, and the most and least bits (as powers of two: 128 MB, 8 kB).
#: Where repeated fingerprints fill the largest map, more single texts go to verification, which settles them; none is missed.
ROUTE_ROOM, ROUTE_MOST, ROUTE_LEAST = 16, 30, 16


def _normalised(batch: pa.RecordBatch) -> list[bytes]:
    return pc.ascii_lower(pc.fill_null(batch.column("text"), "")).cast(pa.binary()).to_pylist()


def _prints(raw: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = _normalised(batch)
        yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(_prints(raw).view(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())], ["doc_id", "mark", "print", "text_sha256"])


def _filters(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            prints, counts = cqf.count(np.concatenate(held))
            held.clear()
            segment = (prints >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(prints), np.int64)
            names, starts = np.unique(segment, return_index=True)
            ends = np.append(starts[1:], len(prints))
            return pa.record_batch([pa.array(names), pa.array([cqf.build(prints[a:b], counts[a:b], bits) for a, b in zip(starts, ends)], pa.binary())], ["segment", "filter"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column("print").to_numpy().view(np.uint64))
            if sum(map(len, held)) >= FILTER_ROWS:
                yield flush()
        if held:
            yield flush()

    return build


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    prints, counts = cqf.merge(table.column("filter").to_pylist(), key[0].as_py())
    more = counts > 1
    return pa.table({"print": prints[more].view(np.int64), "n": counts[more]})


def _map(twice: DataFrame) -> tuple[int, bytes]:
    """The bits of the routing map and the map itself: a bit is set if a repeated fingerprint begins with its number."""
    bits = min(ROUTE_MOST, max(ROUTE_LEAST, power_of_two(ROUTE_ROOM * twice.count()).bit_length() - 1))
    at = F.shiftrightunsigned("print", 64 - bits)
    words = twice.select(at.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    full = np.zeros(1 << (bits - 6), np.uint64)
    full[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits, full.tobytes()


def _route(handed, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(handed.value, np.uint64)
        for batch in batches:
            raw = _normalised(batch)
            prints = _prints(raw)
            hit = np.flatnonzero((table[(prints >> np.uint64(70 - bits)).astype(np.int64)] >> ((prints >> np.uint64(64 - bits)) & np.uint64(63))) & np.uint64(1))
            for at in range(0, len(hit), 512):
                some = hit[at : at + 512]
                yield pa.record_batch([batch.column("doc_id").take(pa.array(some)), pa.array([raw[i] for i in some], pa.binary())], ["doc_id", "body"])

    return run


def repeated_prints(signed: DataFrame) -> DataFrame:
    """print, n: the fingerprints whose count over all rows is above one."""
    rows = signed.count()
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(24, max(power_of_two(parts), power_of_two(rows // SEGMENT_ROWS + 1)).bit_length() - 1)
    built = signed.select("print").mapInArrow(_filters(bits), "segment long, filter binary")
    return built.groupBy("segment").applyInArrow(_merge, "print long, n long")


def _mark(text_col: str):
    return F.xxhash64(F.col(text_col).cast("binary"))


def _groups(bare: DataFrame) -> DataFrame:
    """bare: doc_id, text. The columns of exact_groups(), and mark, a hash of the text as it is."""
    kind = dict(bare.dtypes)["doc_id"]
    signed = cut(bare.withColumn("mark", _mark("text")).mapInArrow(_sign, f"doc_id {kind}, mark long, print long, text_sha256 string"))
    bits, packed = _map(cut(repeated_prints(signed)))
    sent = bare.mapInArrow(_route(bare.sparkSession.sparkContext.broadcast(packed), bits), f"doc_id {kind}, body binary")
    classes = sent.groupBy("body").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select(F.sha2("body", 256).alias("sha"), "keep", "n")
    classes = small(cut(classes))
    found = signed.join(classes, signed.text_sha256 == classes.sha, "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", "mark")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id stays.
    A null text counts as empty, an empty text is a text like any other. A null id never stays
    while its group has another id; a group of null ids has keep_id null and kept true. Rows that
    repeat an id and text count each and share their answer. An empty table gives no rows. Other columns are ignored.
    """
    return _groups(pick(docs, doc_id=id_col, text=text_col)).drop("mark")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts.

    An id and its text name a row, so different texts under one id are told apart. Where the id that stays repeats with the same text (A-Z
    lower-cased), or a group has null ids only, one of these rows stays, whichever. An empty table gives no rows.
    """
    groups = cut(_groups(pick(docs, doc_id=id_col, text=text_col)).select("doc_id", "kept", "text_sha256", "mark"))
    gone = small(groups.where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct())
    left = docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]) & (_mark(text_col) == gone["__mark"]), "left_anti")
    again = groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not again.limit(1).count():
        return left
    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase)
    return left.withColumn("__text", F.sha2(plain.cast("binary"), 256)).dropDuplicates([id_col, "__text"]).drop("__text")
