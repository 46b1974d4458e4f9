"""Packing documents into sequences by cutting-stock column generation.

Each document is cut into atoms: whole sequences, one multiple of UNIT tokens and a rest under
UNIT. A linear program over the histogram of atom lengths, with patterns priced by a knapsack, says how
often to use each pattern. Patterns are rounded down and given to the atoms of each length by
their rank; the atoms left over follow each other in a stream that is cut where sequences end, and the
end of the stream is cut at powers of two, so no sequence is padded. The program sees
the histogram only, at most SEQUENCE / UNIT + UNIT numbers for any corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import loaded
from .common import give_back, pick, small, stored, texts

SEQUENCE = 2048
UNIT = 16
END_ID = 1
#: The program stops once it is so near the bound that the material sets.
NEAR = 1.0005
ROUNDS = 3000


def _knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best value of any number of each size in this room, and how many of each."""
    best = np.zeros(room + 1)
    useful = np.flatnonzero(values > 0)
    for i in useful[np.argsort(-sizes[useful], kind="stable")]:
        size, value = int(sizes[i]), values[i]
        while size <= room:  # up to 1, 3, 7 ... pieces
            np.maximum(best[size:], best[:-size] + value, out=best[size:])
            size, value = 2 * size, 2 * value
    best = np.maximum.accumulate(best)
    counts, left = np.zeros(len(sizes), np.int64), room
    while len(useful):
        fit = useful[sizes[useful] <= left]
        if not len(fit):
            break
        gain = best[left - sizes[fit]] + values[fit]
        k = int(np.argmax(gain))
        if gain[k] < best[left] - 1e-9 or gain[k] <= 1e-12:
            if left and best[left - 1] >= best[left] - 1e-12:
                left -= 1
                continue
            break
        counts[fit[k]] += 1
        left -= int(sizes[fit[k]])
    return float(counts @ values), counts


def patterns(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """Full patterns, each with how often to use it: the linear program, rounded down."""
    m = len(sizes)
    if not m:
        return []
    base = np.diag(room // sizes).astype(float)
    inverse, use = np.diag(1 / np.diag(base)), counts / np.diag(base)
    bound = float(counts @ sizes) / room
    for _ in range(ROUNDS):
        if use.sum() <= bound * NEAR:
            break
        price = inverse.sum(axis=0)
        value, column = _knapsack(sizes, price, room)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        base[:, out] = column
    left, kept = counts.copy(), []
    for k in np.argsort(-use, kind="stable"):
        pattern = np.round(base[:, k]).astype(np.int64)
        used = pattern > 0
        times = min(int(use[k] + 1e-6), int((left[used] // pattern[used]).min()))
        if times > 0 and int(pattern @ sizes) == room:
            kept.append((times, pattern))
            left -= times * pattern
    return kept


@dataclass
class Layout:
    """Where the atoms of each class go by rank. Class 0: whole sequences; k: k units; beyond: the rests."""

    sequence: int
    unit: int
    whole: int = 0
    size: dict[int, int] = field(default_factory=dict)
    blocks: dict[int, np.ndarray] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)
    stream: dict[int, int] = field(default_factory=dict)
    first: int = 0
    length: int = 0
    tails: tuple[np.ndarray, np.ndarray] | None = None

    def place(self, kind: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the parts of an atom, in order."""
        if kind == 0:
            return [(rank, 0, self.sequence)]
        size = self.size[kind]
        if rank < self.used[kind]:
            table = self.blocks[kind]
            start, each, sequence, offset = table[np.searchsorted(table[:, 0], rank, "right") - 1].tolist()
            return [(sequence + (rank - start) // each, offset + (rank - start) % each * size, size)]
        at = self.stream[kind] + (rank - self.used[kind]) * size
        out, whole = [], self.length // self.sequence * self.sequence
        while size:
            if at < whole:
                number, inside, room = at // self.sequence, at % self.sequence, self.sequence - at % self.sequence
            else:
                k = int(np.searchsorted(self.tails[0], at, "right")) - 1
                number, inside, room = whole // self.sequence + k, at - int(self.tails[0][k]), int(self.tails[0][k] + self.tails[1][k]) - at
            part = min(size, room)
            out.append((self.first + number, inside, part))
            at, size = at + part, size - part
        return out


def laid_out(histogram: dict[int, int], sequence: int = SEQUENCE, unit: int = UNIT) -> Layout:
    """histogram: atoms of each class."""
    plan = Layout(sequence, unit, histogram.get(0, 0))
    units = (sequence - 1) // unit
    kinds = sorted(k for k, n in histogram.items() if k and n)
    plan.size = {k: k * unit if k <= units else k - units for k in kinds}
    sizes, counts = np.array([plan.size[k] for k in kinds], np.int64), np.array([histogram[k] for k in kinds], np.int64)
    number, taken = plan.whole, np.zeros(len(kinds), np.int64)
    rows: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in kinds}
    for times, pattern in patterns(sizes, counts, sequence):
        offset = 0
        for i in np.flatnonzero(pattern):
            rows[kinds[i]].append((int(taken[i]), int(pattern[i]), number, offset))
            offset += int(pattern[i] * sizes[i])
        taken += times * pattern
        number += times
    plan.blocks = {k: np.array(x, np.int64).reshape(-1, 4) for k, x in rows.items()}
    plan.used = {k: int(n) for k, n in zip(kinds, taken)}
    plan.first = number
    for k, n, left in zip(kinds, sizes, counts - taken):
        plan.stream[k] = plan.length
        plan.length += int(n * left)
    rest = plan.length % sequence
    powers = np.array([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)
    plan.tails = (plan.length - rest + np.cumsum(powers) - powers, powers)
    return plan


def _tokens(path: str, sequence: int, unit: int):
    units = (sequence - 1) // unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packer, part = loaded(path), zstandard.ZstdCompressor(1), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        give_back(drop=False)
        for b in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
            rows = []
            for packed in model.encode(texts(b.column("text"))):
                n = len(packed) // model.kind.itemsize + 1
                whole, rest = divmod(n, sequence)
                main, small_rest = rest // unit, rest % unit
                kinds = (0, main, units + small_rest if small_rest else 0)
                ranks = [seen.get(k, 0) for k in kinds]
                seen[0] = seen.get(0, 0) + whole
                for k in kinds[1:]:
                    if k:
                        seen[k] = seen.get(k, 0) + 1
                rows.append((packer.compress(packed), n, whole, *kinds[1:], *ranks))
            columns = list(zip(*rows)) or [()] * 8
            yield pa.record_batch([b.column("doc_id"), pa.array(columns[0], pa.binary()), *(pa.array(x, pa.int64()) for x in columns[1:]), pa.array([part] * len(rows), pa.int32())], ["doc_id", "ids", "n", "whole", "main", "rest", "rank_whole", "rank_main", "rank_rest", "part"])

    return run


def _pieces(path: str, plan: Layout):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, unpacker = loaded(path), zstandard.ZstdDecompressor()
        give_back(drop=False)
        for b in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
            rows: list[tuple] = []
            index: list[int] = []
            column = b.column("ids")
            for i, (n, whole, main, rest, first_whole, first_main, first_rest) in enumerate(zip(*(b.column(x).to_pylist() for x in ("n", "whole", "main", "rest", "rank_whole", "rank_main", "rank_rest")))):
                ids = np.append(model.ids(unpacker.decompress(column[i].as_py())).astype("<u4"), np.uint32(END_ID)).astype("<u4")
                parts = [(first_whole + k, 0, plan.sequence) for k in range(whole)]
                if main:
                    parts += plan.place(main, first_main)
                if rest:
                    parts += plan.place(rest, first_rest)
                at = 0
                for number, offset, length in parts:
                    rows.append((at, length, zlib.crc32(ids[at : at + length].tobytes()), n, number, offset))
                    index.append(i)
                    at += length
            columns = list(zip(*rows)) or [()] * 6
            yield pa.record_batch([b.column("doc_id").take(pa.array(index, pa.int64())), *(pa.array(x, pa.int64()) for x in columns)], names)

    return run


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and END_ID; a null or empty text is END_ID alone. Each row of docs is a
    document of its own, whether or not its id or text repeats or is null. An empty table gives no pieces. Other columns are ignored.
    Every sequence is full, but for at most log2(sequence) last ones whose lengths are powers of two.
    The texts are encoded once and read in place; only counts by partition and length are shuffled.
    """
    bare = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(bare.dtypes)["doc_id"]
    fields = ("n", "whole", "main", "rest", "rank_whole", "rank_main", "rank_rest")
    coded = stored(bare.mapInArrow(_tokens(path, sequence, unit), f"doc_id {kind}, ids binary, {', '.join(f'{x} long' for x in fields)}, part int"), "tokens")
    atoms = coded.selectExpr("part", "inline(array(struct(0L as kind, whole as n), struct(main as kind, if(main > 0, 1L, 0L) as n), struct(rest as kind, if(rest > 0, 1L, 0L) as n)))")
    counts = atoms.where("n > 0").groupBy("part", "kind").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "kind", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    histogram = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    plan = laid_out(histogram, sequence, unit)
    table = small(starts.groupBy(F.col("part").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "start"))).alias("starts")), 5000)
    found = coded.join(table, coded.part == table["of"])
    begin = lambda k, rank: (F.coalesce(F.try_element_at("starts", k), F.lit(0)) + F.col(rank)).alias(rank)
    ready = found.select("doc_id", "ids", "n", "whole", "main", "rest", begin(F.lit(0).cast("long"), "rank_whole"), begin(F.col("main"), "rank_main"), begin(F.col("rest"), "rank_rest"))
    return ready.mapInArrow(_pieces(path, plan), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
