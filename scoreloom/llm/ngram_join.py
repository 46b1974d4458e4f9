"""Jaccard join on word shingles by grouped prefixes.

All sets order their shingles alike: by the count that a bounded sketch gives them, rarest first. Linked sets must share a shingle
among the first of each (the prefix), whatever the order, so the sketch decides cost only. Equal sets are one set from the start.
Prefix shingles that one set holds are dropped. In a few turns every shingle's holders meet some leaders, which joins dense
components up. Then sets of one size, one component and identical prefixes are one group; pairs of
groups of different components are filtered by size, place and parity sketches, made distinct, expanded into members, filtered and
verified. No pair that might link is left out unless both are known to be in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, discard, give_back, pick, shuffles_freed, small_batches, stored
from .shingling import WORDS, shingle_sets

#: Similarity from which sets link, in hundredths.
LEAST = 80
#: The count sketch has 2 ** COUNTERS counters whatever the input; it travels in slices of 2 ** SLICE.
COUNTERS, SLICE = 22, 16
#: Shingles counted this many times, and so many times the mean, are spread over SPREAD partitions.
HEAVY, SPREAD = 1024, 32
#: A parity sketch tells which of 64 * PARITY classes hold an odd number of a set's shingles: sets differ in at least as many
#: shingles as their sketches in bits, so a filter on it loses no link.
PARITY = 4
BITS = [f"s{k}" for k in range(PARITY)]
#: Leaders that each shingle gives its holders of about one size to meet, in each of at most so many turns.
HEADS, TURNS = 4, 4
#: Rows that a task gives out at once.
OUT = 1 << 16


def _batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            yield b, list(shingle_sets(b.column("text"), words))


def _counted(words: int):
    """Texts to the counters of the shingles' lowest bits, in slices: places (none: all) and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = np.zeros(1 << COUNTERS, np.uint32), [], 0

        def flush() -> None:
            places, n = np.unique(np.concatenate(held) & np.uint64(len(table) - 1), return_counts=True)
            table[places] += n.astype(np.uint32)

        for _, sets in _batches(batches, words):
            held += sets
            size += sum(map(len, sets))
            if size > 1 << 20:
                flush()
                held, size = [], 0
        if size:
            flush()
        for k, part in enumerate(table.reshape(-1, 1 << SLICE)):
            places = np.flatnonzero(part)
            if len(places):
                sparse = len(places) < len(part) // 2
                kind = "<u1" if part.max() < 256 else "<u4"
                yield pa.record_batch([pa.array([k]), pa.array([places.astype("<u2").tobytes() if sparse else b""]), pa.array([(part[places] if sparse else part).astype(kind).tobytes()])], ["slice", "places", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the slices of a partition, as quarter octaves: floor(4 * log2(1 + count)), one byte a counter."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, places, counts in zip(*(b.column(x).to_pylist() for x in ("slice", "places", "counts"))):
            table = sums.setdefault(k, np.zeros(1 << SLICE, np.int64))
            where = np.frombuffer(places, "<u2") if places else slice(None)
            table[where] += np.frombuffer(counts, "<u1" if len(counts) == (len(places) // 2 or len(table)) else "<u4")
    for k, table in sums.items():
        yield pa.record_batch([pa.array([k]), pa.array([np.floor(4 * np.log2(1.0 + table)).astype(np.uint8).tobytes()])], ["slice", "levels"])


def _parity(prints: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((prints >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1).view(np.int64)


def _signed(words: int, least: int, levels, heavy: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = levels.value
        for b, sets in _batches(batches, words):
            tokens, light = [], []
            for x in sets:
                level = own[(x & np.uint64(len(own) - 1)).view(np.int64)]
                order = np.argsort(level, kind="stable")[: len(x) - -(-least * len(x) // 100) + 1 if len(x) else 0]
                tokens.append(x[order].tobytes())
                light.append(int(np.count_nonzero(level[order] < heavy)))
            bits = np.array([_parity(x) for x in sets]).reshape(-1, PARITY)
            yield pa.record_batch([b.column("doc_id"), b.column("mark"), pa.array([len(x) for x in sets], pa.int32()), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(light, pa.int32()), pa.array(tokens, pa.binary()), *map(pa.array, bits.T.copy())], ["doc_id", "mark", "n", "print", "light", "tokens", *BITS])

    return run


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets to the shingles of their prefixes: token, sid, at (size, place in the order, whether it is heavy)."""
    for batch in batches:
        counts = np.array([len(x) // 8 for x in batch.column("tokens").to_pylist()], np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(counts[at:]), OUT, "right")))
            n = counts[at:to]
            b = batch.slice(at, to - at)
            token = np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.int64)
            sid, size, light = (np.repeat(b.column(x).to_numpy(zero_copy_only=False), n) for x in ("sid", "n", "light"))
            pos = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.record_batch(list(map(pa.array, (token, sid, size.astype(np.int64) << 32 | pos << 1 | (pos >= light)))), ["token", "sid", "at"])
            at = to


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of token, those whose token occurs again, and all heavy ones."""
    rest, met = None, False
    for b in batches:
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        token = b.column("token").to_numpy()
        like = token[1:] == token[:-1]
        keep = (b.column("at").to_numpy() & 1) > 0
        keep[1:] |= like
        keep[:-1] |= like
        keep[0] |= met
        rest, met = b.slice(b.num_rows - 1), bool(keep[-1])
        yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1]))
    if rest is not None and met:
        yield rest


def _hashed(words: int, wanted):
    """The sets of texts by print; wanted: the first halves of the prints that matter, or None for all. Copies in a task go out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = wanted.value if wanted else None
        for _, sets in _batches(batches, words):
            rows = {xxhash.xxh3_128_digest(x): x for x in sets if len(x)}
            if own is not None:
                half = np.array([int.from_bytes(p[:8], "little") for p in rows], np.uint64)
                hit = own[np.minimum(np.searchsorted(own, half), len(own) - 1)] == half if len(own) else np.zeros(len(half), bool)
                rows = {p: x for (p, x), h in zip(rows.items(), hit.tolist()) if h}
            yield pa.record_batch([pa.array(list(rows), pa.binary()), pa.array([x.tobytes() for x in rows.values()], pa.binary())], ["of", "hashes"])

    return run


def _linked(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            keep = []
            for x, y in zip(b.column("one"), b.column("other")):
                one, other = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([one, other]), kind="stable")
                inside = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * inside >= least * (len(one) + len(other) - inside))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that is reachable, for every node of the edges (a, b).

    Each round hooks nodes to their least neighbour, jumps to the roots and puts these for the ends of the edges. Edges within one label go and
    the rest are made distinct, so a dense component shrinks to few edges at once.
    """
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("a").alias("to")).union(left.select(F.col("b").alias("node"), F.col("a").alias("to")))
        moved = cut(ends.groupBy("node").agg(F.min("to").alias("label")))
        while True:  # each jump doubles the way that a label has come, until all have met their root
            nexts = moved.select(F.col("node").alias("at"), F.col("label").alias("next"))
            jumped = cut(moved.join(nexts, moved["label"] == nexts["at"]).select("node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moves")))
            moved = jumped.select("node", "label")
            if not jumped.where("moves").limit(1).count():
                break
        if labels is None:
            labels = moved
        else:
            on = moved.select(F.col("node").alias("at"), F.col("label").alias("next"))
            labels = cut(labels.join(on, labels["label"] == on["at"], "left").select("node", F.coalesce("next", "label").alias("label")))
        one, two = moved.select(F.col("node").alias("a"), F.col("label").alias("x")), moved.select(F.col("node").alias("b"), F.col("label").alias("y"))
        left = cut(left.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not left.limit(1).count():
            return labels


def _apart(a: str, b: str, least: int) -> str:
    """The filter on parity sketches."""
    return f"{100 + least} * ({' + '.join(f'bit_count({a}.{x} ^ {b}.{x})' for x in BITS)}) <= {100 - least} * ({a}.n + {b}.n)"


def _placed(a: str, b: str, least: int) -> str:
    """The filter on sizes and on the places of a shared shingle: no set can share more than what follows its place."""
    return f"100 * {a}.n >= {least} * {b}.n AND 100 * {b}.n >= {least} * {a}.n AND {100 + least} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {least} * ({a}.n + {b}.n)"


class _Join:
    """The parts of one join that its steps share. docs: text; sets: sid, n, print, the sketches; posts: token, sid, n, pos."""

    def __init__(self, docs: DataFrame, sets: DataFrame, posts: DataFrame, words: int, least: int):
        self.docs, self.sets, self.posts, self.words, self.least = docs, sets, posts, words, least
        self.sketches = sets.select("sid", "n", *BITS)

    def _few(self, df: DataFrame) -> bool:
        return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches are near enough."""
        x, y = self.sketches.alias("x"), self.sketches.alias("y")
        return pairs.join(x, F.col("a") == F.col("x.sid")).join(y, F.col("b") == F.col("y.sid")).where(_apart("x", "y", self.least)).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets link. Only the sets of these pairs are computed from the texts again and moved."""
        pairs = cut(pairs)
        ends = cut(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
        need, wanted = cut(self.sets.select("sid", "print").join(ends, "sid")), None
        if self._few(need):
            halves = np.array(sorted(int.from_bytes(bytes(r.half), "little") for r in need.select(F.substring("print", 1, 8).alias("half")).collect()), np.uint64)
            wanted, need = self.docs.sparkSession.sparkContext.broadcast(halves), F.broadcast(need)
        sets = self.docs.select("text").mapInArrow(_hashed(self.words, wanted), "of binary, hashes binary").join(need, F.col("of") == F.col("print"))
        sets = stored(sets.groupBy("sid").agg(F.first("hashes").alias("hashes")), "sets")
        one, two = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("one")), sets.select(F.col("sid").alias("b"), F.col("hashes").alias("other"))
        found = cut(pairs.join(one, "a").join(two, "b").select("a", "b", "one", "other").mapInArrow(_linked(self.least), "a long, b long"))
        discard(sets)
        if wanted:
            wanted.destroy()
        return found

    def met(self, rows: DataFrame, turn: int) -> DataFrame:
        """a, b: holders of a shingle and the leaders of their component's outside, of about one size."""
        led = rows.withColumn("scale", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / self.least))))
        drawn = [F.min_by(F.struct("sid", "n", "pos", "comp"), F.xxhash64("sid", F.lit(turn * HEADS + k))).alias(f"h{k}") for k in range(HEADS)]
        heads = led.groupBy("token", "scale").agg(*drawn, F.count("*").alias("m")).where("m > 1").selectExpr("token", "scale", f"inline(array_distinct(array({', '.join(f'h{k}' for k in range(HEADS))})))")
        pairs = heads.alias("h").join(led.alias("x"), ["token", "scale"]).where("h.comp <> x.comp AND " + _placed("h", "x", self.least))
        return self.close(pairs.select(F.least("h.sid", "x.sid").alias("a"), F.greatest("h.sid", "x.sid").alias("b")).distinct())

    def grouped(self, rows: DataFrame) -> DataFrame:
        """a, b: all pairs of members of groups of different components that pass the filters, each once."""
        least = self.least
        marks = rows.groupBy("sid", "n", "comp").agg(F.sort_array(F.collect_list("token")).alias("tokens")).select("sid", "n", "comp", F.xxhash64("tokens").alias("k1"), F.xxhash64("tokens", F.lit(1)).alias("k2"))
        keys = ["n", "comp", "k1", "k2"]
        member = stored(marks.join(self.sketches.drop("n"), "sid"), "members")
        ranges = [f(x).alias(f"{name}_{x}") for x in BITS for name, f in (("all", F.bit_and), ("any", F.bit_or))]
        groups = stored(member.groupBy(*keys).agg(F.min("sid").alias("gid"), *ranges), "groups")
        of = stored(member.join(groups.select("gid", *keys), keys), "expanded")
        posts = rows.select("token", "sid", "pos").join(of.select("sid", "gid"), "sid").groupBy("token", "gid").agg(F.min("pos").alias("pos")).join(groups.drop("k1", "k2"), "gid")
        posts = stored(posts, "grouped")
        # Bits that all of one group have and none of the other bound the difference of any two members.
        apart = " + ".join(f"bit_count((p.all_{x} & ~q.any_{x}) | (q.all_{x} & ~p.any_{x}))" for x in BITS)
        pairs = posts.alias("p").join(posts.alias("q"), "token").where(f"p.gid < q.gid AND p.comp <> q.comp AND {_placed('p', 'q', least)} AND {100 + least} * ({apart}) <= {100 - least} * (p.n + q.n)")
        pairs = cut(pairs.selectExpr("p.gid AS ga", "q.gid AS gb").distinct())
        x, y = of.alias("x"), of.alias("y")
        out = cut(pairs.join(x, F.col("ga") == F.col("x.gid")).join(y, F.col("gb") == F.col("y.gid")).where(_apart("x", "y", least)).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")))
        for df in (member, groups, of, posts):
            discard(df)
        return out

    def labels(self) -> DataFrame:
        """node, label for all sets that link with any."""
        links, known, before = None, None, None
        for turn in range(TURNS + 1):
            if known is None:
                rows = self.posts.withColumn("comp", F.col("sid"))
            else:
                placed = self.posts.join(known, self.posts["sid"] == known["node"], "left").select("token", "sid", "n", "pos", F.coalesce("label", "sid").alias("comp"))
                mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
                rows = stored(placed.join(mixed, "token", "left_semi"), "live")
                counts = rows.groupBy("token", "comp").agg(F.count("*").cast("double").alias("m")).groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
                held, open_pairs = counts.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("own")) / 2)).first()
                # Leaders go on meeting while that removes most of what is left; then every open pair is looked at.
                if not held or open_pairs <= 4 * held or turn == TURNS or before is not None and open_pairs > 0.7 * before:
                    found = self.verified(self.grouped(rows)) if held else None
                    discard(rows)
                    return components(links.union(found)) if found is not None else known
                before = open_pairs
            met = self.verified(self.met(rows, turn))
            if known is not None:
                discard(rows)
            links = met if links is None else links.union(met)
            known = components(links)


def _levels(docs: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """The level of each counter, and the level from which shingles are heavy. 4 MB reach the driver, whatever the input."""
    slices = 1 << (COUNTERS - SLICE)
    rows = docs.select("text").mapInArrow(_counted(words), "slice long, places binary, counts binary").repartition(slices, "slice").mapInArrow(_added, "slice long, levels binary").collect()
    levels = np.zeros((slices, 1 << SLICE), np.uint8)
    for r in rows:
        levels[r.slice] = np.frombuffer(r.levels, np.uint8)
    mean = float(np.mean(np.exp2(levels / 4.0) - 1))
    return levels.ravel(), int(np.floor(4 * np.log2(1 + HEAVY + 8 * mean)))


def _groups(docs: DataFrame, words: int, least: int) -> DataFrame:
    """doc_id, mark, n, component_id; docs: doc_id, text, mark."""
    with small_batches(docs.sparkSession), shuffles_freed(docs.sparkSession):
        return _found(docs, words, least)


def _found(docs: DataFrame, words: int, least: int) -> DataFrame:
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    levels, heavy = _levels(docs, words)
    handed = spark.sparkContext.broadcast(levels)
    # Row numbers are stored with the rows, so that they hold if a task is run again.
    signed = docs.mapInArrow(_signed(words, least, handed, heavy), f"doc_id {kind}, mark long, n int, print binary, light int, tokens binary, {', '.join(f'{x} long' for x in BITS)}")
    signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    full = signed.where("n > 0")
    classes = stored(full.groupBy("print").agg(F.min("row").alias("sid"), F.min("doc_id").alias("low"), F.count("*").alias("m")), "classes")
    again = cut(full.select("row", "print").join(classes.where("m > 1").select("print", "sid"), "print").where("row <> sid").select(F.col("row").alias("gone")))
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sets = full.join(F.broadcast(again) if few else again, full["row"] == again["gone"], "left_anti").withColumnRenamed("row", "sid")
    if not few:
        sets = stored(sets, "distinct")
    posts = sets.select("sid", "n", "light", "tokens").mapInArrow(_posted, "token long, sid long, at long")
    posts = posts.repartition("token", F.expr(f"if(at & 1 = 1, sid % {SPREAD}, -1)")).sortWithinPartitions("token").mapInArrow(_shared, "token long, sid long, at long")
    posts = stored(posts.selectExpr("token", "sid", "cast(at >> 32 AS int) AS n", "cast((at & 4294967295) >> 1 AS int) AS pos"), "posts")
    labels = _Join(docs, sets, posts, words, least).labels()
    named = classes.join(labels, classes["sid"] == labels["node"], "left").select("print", "low", F.coalesce("label", "sid").alias("label"))
    lows = named.groupBy("label").agg(F.min("low").alias("component_id"))
    by_print = named.select(F.col("print").alias("of"), "label").join(lows, "label").select("of", "component_id")
    found = signed.select("doc_id", "mark", "n", "print").join(by_print, (F.col("print") == F.col("of")) & (F.col("n") > 0), "left")
    out = stored(found.select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "components")
    for df in (posts, classes, signed, *([] if few else [sets])):
        discard(df)
    handed.destroy()
    return out


def near_groups(docs: DataFrame, words: int = WORDS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Words are parted by space and the controls 9 to 13 after lower-casing A-Z; a text with fewer words than a shingle is one
    shingle. A null text, or one without words, has none and links with nothing, not even its like. Links need
    least hundredths of the union in common. Rows with null ids connect others like any row; component_id is null where
    no row of the component has an id. Rows may repeat. An empty table gives no rows. Other columns are ignored. The texts are read
    several times: hand in what is stored, not what is costly to compute.
    """
    bare = pick(docs, doc_id=id_col, text=text_col).withColumn("mark", F.lit(0).cast("long"))
    return _groups(bare, words, least).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component those with the smallest id; rows without shingles all stay.

    An id and its text name a row: rows with a null id stay, different texts under one id are told apart, and rows that repeat both
    stay or go together.
    """
    marked = F.xxhash64(F.col(text_col).cast("binary"))
    groups = _groups(pick(docs, doc_id=id_col, text=text_col).withColumn("mark", F.xxhash64(F.col("text").cast("binary"))), WORDS, LEAST)
    gone = cut(groups.where("component_id < doc_id").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct())
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, (docs[id_col] == gone["__gone"]) & (marked == gone["__mark"]), "left_anti")
