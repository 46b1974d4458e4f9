"""Toxicity from the nearest labelled examples.

Terms are words, cut to their first letters. A bounded sample of labelled rows gives all its terms an inverse document frequency
and a relevance for the label, and an index of the examples: postings by term, in blocks of examples, each with the highest weight of its
term. A text asks for its nearest examples by exact cosine over all terms that any example has: the blocks of highest bound
are opened, and then all whose bound can still enter the list. Votes weighted by nearness, corrected for
the sampling of the classes, are calibrated on the examples themselves, each without its own vote.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, pick
from .shingling import texts_hashed

#: Labelled rows of each class that are learnt from, at most; chosen by a hash of their id. This bounds the index.
EXAMPLES = 3000
#: Letters of a word that count.
LETTERS = 8
BLOCK = 64
NEAREST = 15
#: Blocks that a text opens before it knows how near its nearest are.
FIRST = 8
#: A term held by at least one example in so many has its weights in a dense row.
DENSE = 32
#: Chi, less its usual noise, at which a term has half the greatest relevance; none has less than the least.
NOISE, HALF, RELEVANT_LEAST = 2.0, 20.0, 0.0025
#: Decimals of a cosine that count; more depend on the order of sums.
PLACES = 9


def _plain(column: pa.Array) -> pa.Array:
    """Lower-case letters, digits and single spaces."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), r"[^\pL\pN\pM]+", " ")


def text_terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For portions of the texts: how many, and for each text and term once the text's place in the portion, the term and its count, in order."""
    for at in range(0, len(column), 256):
        for n, row, word in texts_hashed(_plain(column.slice(at, 256)), LETTERS):
            if not len(row):
                yield n, row, word, row
                continue
            order = np.lexsort((word, row))
            row, word = row[order], word[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (word[1:] != word[:-1])))
            yield n, row[first], word[first], np.diff(np.append(first, len(row)))


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, values, minlength=n)


def _expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, end to end, and of which range each is."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n - first, n), of


@dataclass
class Index:
    """The examples: ids, labels and class weights, and the block-max inverted index over them."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Postings of term t: first[t] to first[t + 1], examples ascending; the same for the blocks and their highest weights.
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    block_first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    #: The row of a term in dense and dense_most (blocks), or -1.
    dense_row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    dense_most: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    ids: list = field(default_factory=list)
    label: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vote_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0
    line: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def built(cls, ids: list, label: np.ndarray, vote_weight: np.ndarray, row: np.ndarray, word: np.ndarray, count: np.ndarray) -> Index:
        """row, word, count: the terms of the examples, by example."""
        n = len(ids)
        terms, term = np.unique(word, return_inverse=True)
        df = np.bincount(term, minlength=len(terms)).astype(float)
        a, n1 = _sums(term, label[row], len(terms)), float(label.sum())
        n0, b = n - n1, df - a
        under = df * (n - df) * n0 * n1
        chi = np.sqrt(n * (a * n0 - b * n1) ** 2 / np.where(under > 0, under, np.inf))
        strong = np.maximum(chi - NOISE, 0) ** 2
        scale = (np.log((1 + n) / (1 + df)) + 1) * np.maximum(strong / (strong + HALF), RELEVANT_LEAST)
        raw = (1 + np.log(count)) * scale[term]
        weight = (raw / np.sqrt(_sums(row, raw**2, n))[row]).astype(np.float32)
        # Examples of one class whose heaviest terms agree share blocks.
        top = np.full(n, -1, np.int64)
        top[row[np.argsort(weight, kind="stable")]] = term[np.argsort(weight, kind="stable")]
        place = np.lexsort((np.arange(n), top, label))
        new = np.empty(n, np.int64)
        new[place] = np.arange(n)
        order = np.lexsort((new[row], term))
        term, example, weight = term[order], new[row][order], weight[order]
        first = np.searchsorted(term, np.arange(len(terms) + 1))
        start = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (example[1:] // BLOCK != example[:-1] // BLOCK))) if len(term) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(weight, start) if len(start) else weight
        often = np.flatnonzero(df * DENSE >= n)
        dense_row = np.full(len(terms), -1, np.int32)
        dense_row[often] = np.arange(len(often))
        dense = np.zeros((len(often), -(-n // BLOCK) * BLOCK), np.float32)
        at = dense_row[term] >= 0
        dense[dense_row[term][at], example[at]] = weight[at]
        own = cls(terms, scale, first, example.astype(np.int32), weight, np.searchsorted(term[start], np.arange(len(terms) + 1)), (example[start] // BLOCK).astype(np.int32), most, dense_row, dense, dense.reshape(len(often), -1, BLOCK).max(axis=2).astype(float) if len(often) else np.zeros((0, -(-n // BLOCK))), [ids[k] for k in place.tolist()], label[place], vote_weight[place])
        own.prior = float((own.vote_weight @ own.label) / own.vote_weight.sum())
        return own

    def vectors(self, n: int, row: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, term and weight of n texts; each text has length 1 over the terms of the index."""
        at = np.minimum(np.searchsorted(self.terms, word), max(len(self.terms) - 1, 0))
        known = self.terms[at] == word if len(self.terms) else np.zeros(len(word), bool)
        row, term = row[known], at[known]
        raw = (1 + np.log(count[known])) * self.scale[term]
        return row, term, raw / np.sqrt(_sums(row, raw**2, n))[row]

    def cosines(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, but: np.ndarray | None = None) -> np.ndarray:
        """n texts by examples: the cosines of all examples in the blocks that may hold one of the NEAREST, else 0. but: an example of each that is left out."""
        size = len(self.ids)
        blocks = -(-size // BLOCK)
        k = self.dense_row[term]
        thick = np.zeros((n, len(self.dense)))
        thick[row[k >= 0], k[k >= 0]] = weight[k >= 0]
        row, term, weight = row[k < 0], term[k < 0], weight[k < 0]
        at, of = _expanded(self.block_first[term], self.block_first[term + 1])
        bound = thick @ self.dense_most + _sums(row[of] * blocks + self.block[at], weight[of] * self.most[at], n * blocks).reshape(n, blocks)
        at, of = _expanded(self.first[term], self.first[term + 1])
        place, cell, value = row[of] * (blocks * BLOCK) + self.example[at], row[of] * blocks + self.example[at] // BLOCK, weight[of] * self.weight[at]
        found = np.zeros((n, blocks * BLOCK))

        def opened(wanted: np.ndarray) -> None:
            use = wanted.ravel()[cell]
            np.add(found, _sums(place[use], value[use], found.size).reshape(found.shape), out=found)
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows = np.flatnonzero(wanted[:, b])
                found[rows, b * BLOCK : (b + 1) * BLOCK] += thick[rows] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK].astype(float)

        begin = np.zeros((n, blocks), bool)
        begin[np.arange(n)[:, None], np.argpartition(-bound, min(FIRST, blocks) - 1, axis=1)[:, :FIRST]] = True
        opened(begin & (bound > 0))
        held = found.copy()
        if but is not None:
            held[np.arange(n), but] = 0
        least = np.partition(held, -NEAREST - 1, axis=1)[:, -NEAREST - 1] if held.shape[1] > NEAREST else np.zeros(n)
        opened((bound > 0) & (bound >= least[:, None] - 1e-9) & ~begin)
        if but is not None:
            found[np.arange(n), but] = 0
        return np.round(found[:, :size], PLACES)

    def nearest(self, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The NEAREST examples of each text by falling cosine, ties to the earlier example, and their cosines; those at 0 are none."""
        wide = min(NEAREST, cosines.shape[1])
        limit = np.partition(cosines, -wide, axis=1)[:, -wide]
        best, near = np.zeros((len(cosines), wide), np.int64), np.zeros((len(cosines), wide))
        row, example = np.nonzero((cosines >= limit[:, None]) & (cosines > 0))
        value = cosines[row, example]
        order = np.lexsort((example, -value, row))
        row, example, value = row[order], example[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(cosines)))[row]
        use = place < wide
        best[row[use], place[use]], near[row[use], place[use]] = example[use], value[use]
        return best, near

    def votes(self, best: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The share of the votes for label 1; the prior votes too, as one example at distance 1."""
        mine = np.where(near > 0, self.vote_weight[best] / (1.05 - np.minimum(near, 1)), 0)
        return ((mine * self.label[best]).sum(axis=1) + self.prior / 1.05) / (mine.sum(axis=1) + 1 / 1.05)

    def scored(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For portions of the texts: scores, nearest examples and their cosines."""
        for n, row, word, count in text_terms(column):
            if not self.ids:
                yield np.zeros(n), np.zeros((n, 0), np.int64), np.zeros((n, 0))
                continue
            best, near = self.nearest(self.cosines(n, *self.vectors(n, row, word, count)))
            a, b = self.line
            yield 1 / (1 + np.exp(-np.clip(a * _logit(self.votes(best, near)) + b, -50, 50))), best, near


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _fitted_line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic calibration with a slight pull to the identity, by Newton's method."""
    beta, pull = np.array([1.0, 0.0]), np.diag([1.0, 0.1])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        slope = design.T @ (w * (y - p)) - pull @ (beta - [1.0, 0.0])
        bend = (design * (w * p * (1 - p))[:, None]).T @ design + pull
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.05)), float(beta[1])


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            b = batch.slice(at, 64)
            words, counts = [], []
            for n, row, word, count in text_terms(b.column("text")):
                ends = np.searchsorted(row, np.arange(n + 1))
                words += [word[x:y].tobytes() for x, y in zip(ends, ends[1:])]
                counts += [count[x:y].astype("<u4").tobytes() for x, y in zip(ends, ends[1:])]
            yield pa.record_batch([b.column("doc_id"), b.column("toxic"), pa.array(words, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "toxic", "words", "counts"])


def learnt(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1; other values and null ids are ignored, of repeated ids the highest label counts).

    At most `examples` labelled ids of each class are learnt from, drawn by a hash of the id; their terms reach the driver.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    whole = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [marks.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for c in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]).withColumnRenamed("doc_id", "__id"))  # 2 * examples rows at most
    # Of rows that repeat an id, one is learnt from: the least text.
    one = docs.join(few, docs.doc_id == few["__id"]).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = one.mapInArrow(_example_terms, f"doc_id {kind}, toxic int, words binary, counts binary").collect()
    if not rows:
        return Index()
    rows.sort(key=lambda r: (r.toxic, r.doc_id))
    label = np.array([r.toxic for r in rows], float)
    sizes = np.bincount(label.astype(int), minlength=2)
    weight = np.array([whole.get(c, 0) / max(sizes[c], 1) for c in label.astype(int)])
    row = np.repeat(np.arange(len(rows)), [len(r.counts) // 4 for r in rows])
    word, count = np.frombuffer(b"".join(r.words for r in rows), np.uint64), np.frombuffer(b"".join(r.counts for r in rows), "<u4").astype(np.int64)
    index = Index.built([r.doc_id for r in rows], label, weight / weight.mean(), row, word, count)
    place = {d: k for k, d in enumerate(index.ids)}
    votes = np.zeros(len(rows))
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    for at in range(0, len(rows), 64):
        to = min(at + 64, len(rows))
        x, y = ends[at], ends[to]
        own = np.array([place[r.doc_id] for r in rows[at:to]])
        votes[own] = index.votes(*index.nearest(index.cosines(to - at, *index.vectors(to - at, row[x:y] - at, word[x:y], count[x:y]), but=own)))
    index.line = _fitted_line(_logit(votes), index.label, index.vote_weight)
    return index


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, evidence (the nearest examples: doc_id, cosine, toxic).

    Learns from the documents whose ids are in labels (doc_id, toxic), from at most `examples` of each class. A null text counts as empty; a
    text that shares no term with any example gets the calibrated prior; without examples all scores are 0. Ids may be null or repeat: each row is
    scored by its own text. An empty table gives no rows. Other columns are ignored.
    """
    bare = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(bare.dtypes)["doc_id"]
    handed = docs.sparkSession.sparkContext.broadcast(learnt(bare, labels.select("doc_id", "toxic"), examples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = handed.value
        give_back()
        for batch in batches:
            at = 0
            for scores, best, near in own.scored(batch.column("text")):
                ids = batch.column("doc_id").slice(at, len(scores))
                at += len(scores)
                shape = pa.list_(pa.struct([("doc_id", ids.type), ("cosine", pa.float64()), ("toxic", pa.int32())]))
                evidence = [[{"doc_id": own.ids[i], "cosine": c, "toxic": int(own.label[i])} for i, c in zip(b, x) if c > 0] for b, x in zip(best.tolist(), near.tolist())]
                yield pa.record_batch([ids, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array(evidence, shape)], ["doc_id", "score", "predicted", "evidence"])

    return bare.mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id: {kind}, cosine: double, toxic: int>>")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns. The text is scored in place; nothing of it is shuffled.

    Null, empty and repeated rows are treated as by toxicity(); without examples all rows stay.
    """
    bare = pick(docs, doc_id=id_col, text=text_col)
    handed, at = docs.sparkSession.sparkContext.broadcast(learnt(bare, labels.select("doc_id", "toxic"))), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = handed.value
        give_back()
        for b in batches:
            keep = [s < 0.5 for s, _, _ in own.scored(b.column(at))]
            yield b.filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
