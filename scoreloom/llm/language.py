"""Language identification as inference of a mixture of languages.

A language is a Markov model of the letters of its words, interpolated over n-grams of up to three. A
document is a mixture: expectation-maximisation over its words estimates the share of each
language, and languages are taken out, smallest share first, while the likelihood lost is worth
less than the penalty of a parameter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, pick, texts

#: Labelled documents of a language that are learnt from, about; chosen by a hash of their id.
LEARN_DOCS = 6000
#: N-grams that a language's model keeps, at most; the most frequent.
GRAMS = 30_000
LETTERS = regex.compile(r"\p{L}+")
#: A long run of letters is read in pieces of so many, each as a word; all letters count, but the model starts anew at each piece.
PIECE = 40
START, END = "\x02", "\x03"
#: Expectation-maximisation ends when no share moves by more than CLOSE; STEPS only guards against rounding that never settles.
STEPS, CLOSE = 10_000, 1e-3
CHARS = 1 << 19
UNKNOWN = "und"


def _words(text: str) -> Counter:
    found = LETTERS.findall(text.lower())
    if found and len(max(found, key=len)) > PIECE:
        found = [w[k : k + PIECE] for w in found for k in range(0, len(w), PIECE)]
    return Counter(found)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    words: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, found in words.items():
            counts: Counter = Counter()
            for w, n in found.items():
                w = START + w + END
                for k in range(1, len(w)):
                    counts[w[k]] += n
                    counts[w[k - 1 : k + 1]] += n
                    if k > 1:
                        counts[w[k - 2 : k + 1]] += n
            yield pa.record_batch([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])
        words.clear()

    for b in batches:
        for text, lang in zip(texts(b.column("text")), b.column("lang").to_pylist()):
            words.setdefault(lang, Counter()).update(_words(text))
            if sum(map(len, words.values())) > 200_000:
                yield from flush()
    yield from flush()


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    #: n-gram: its count in each language.
    counts: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        zero = np.zeros(len(self.langs))
        self.after: dict[str, np.ndarray] = {}
        for gram, n in self.counts.items():
            if len(gram) > 1:
                self.after[gram[:-1]] = self.after.get(gram[:-1], zero) + n
        self.total = sum((n for g, n in self.counts.items() if len(g) == 1), zero)
        self.letters = max(2, sum(len(g) == 1 for g in self.counts))
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))
        self.scored: dict[str, int] = {}
        self.likelihood = np.zeros((4096, len(self.langs)))

    def _row(self, gram: str) -> int:
        """The row of the table for a letter after up to two others."""
        at = self.rows.get(gram)
        if at is None:
            zero = np.zeros(len(self.langs))
            p = (self.counts.get(gram[-1], zero) + 0.5) / (self.total + 0.5 * self.letters + 1000)
            for back in range(2, len(gram) + 1):
                p = (self.counts.get(gram[-back:], zero) + 4 * p) / (self.after.get(gram[-back:-1], zero) + 4)
            at = self.rows[gram] = len(self.rows)
            if at >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = np.log(p)
        return at

    def learn(self, words: list[str]) -> None:
        """Put the log-likelihoods of these new words into the cache."""
        if not words:
            return
        rows, starts = [], []
        for w in words:
            starts.append(len(rows))
            w = START + w + END
            rows += [self._row(w[max(0, k - 2) : k + 1]) for k in range(1, len(w))]
        begin = len(self.scored)
        while begin + len(words) > len(self.likelihood):
            self.likelihood = np.concatenate([self.likelihood, np.zeros_like(self.likelihood)])
        self.likelihood[begin : begin + len(words)] = np.add.reduceat(self.table[rows], starts)
        self.scored.update(zip(words, range(begin, begin + len(words))))

    def shares(self, docs: list[Counter]) -> np.ndarray:
        """The share of each language in each document of words; zero for languages that aren't in its set."""
        if len(self.scored) > 300_000:
            self.scored.clear()
        if len(self.rows) > 300_000:
            self.rows.clear()
        self.learn(list({w for d in docs for w in d if w not in self.scored}))
        scored = self.scored
        at = np.fromiter((scored[w] for d in docs for w in d), np.int64)
        n = np.fromiter((c for d in docs for c in d.values()), float, len(at))
        first = np.cumsum([0, *map(len, docs)][:-1])
        like = self.likelihood[at]
        top = like.max(axis=1)
        like = np.exp(like - top[:, None])
        total = np.add.reduceat(n, first)
        inside = np.ones((len(docs), len(self.langs)), bool)
        share, fit = _mixed(like, n, first, total, inside, np.full(inside.shape, 1 / len(self.langs)))
        live = np.arange(len(docs))
        penalty = 0.5 * np.log(total) + 2.0
        while True:  # take the least language out where that costs less than its penalty
            live = live[inside[live].sum(axis=1) > 1]
            if not len(live):
                return share
            fewer = inside[live].copy()
            fewer[np.arange(len(live)), np.where(fewer, share[live], np.inf).argmin(axis=1)] = False
            some, their_first = _rows_of(first, len(n), live)
            begin = np.where(fewer, share[live] + 1e-3, 0)
            new, new_fit = _mixed(like[some], n[some], their_first, total[live], fewer, begin / begin.sum(axis=1, keepdims=True))
            better = new_fit >= fit[live] - penalty[live]
            live = live[better]
            inside[live], share[live], fit[live] = fewer[better], new[better], new_fit[better]


def _rows_of(first: np.ndarray, n: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.diff(np.append(first, n))[docs]
    begin = np.cumsum(length) - length
    return np.repeat(first[docs] - begin, length) + np.arange(length.sum()), begin


def _mixed(like: np.ndarray, n: np.ndarray, first: np.ndarray, total: np.ndarray, inside: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of the shares of many documents at once; the shares and the log-likelihoods."""
    length = np.diff(np.append(first, len(n)))
    share = np.where(inside, share, 0)
    fit = np.full(len(first), -np.inf)
    live = np.arange(len(first))
    rows, begin = np.arange(len(n)), first
    for _ in range(STEPS):
        part = like[rows] * np.repeat(share[live], length[live], axis=0)
        whole = np.maximum(part.sum(axis=1), 1e-300)
        weight = n[rows] / whole
        fit[live] = np.add.reduceat(n[rows] * np.log(whole), begin)
        new = np.add.reduceat(part * weight[:, None], begin) / total[live][:, None]
        moved = np.abs(new - share[live]).max(axis=1)
        share[live] = new
        keep = moved > CLOSE
        if not keep.any():
            break
        if not keep.all():
            live = live[keep]
            rows, begin = _rows_of(first, len(n), live)
    return share, fit


def learnt(docs: DataFrame, learn_docs: int = LEARN_DOCS) -> Model:
    """docs: doc_id, text, lang of the documents to learn from; those without a lang are ignored."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"))
    chosen = known.join(F.broadcast(sizes.withColumnRenamed("lang", "of")), F.col("lang") == F.col("of"))  # a row per language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") / (1 << 30)
    chosen = chosen.where(place * F.col("size") < learn_docs)
    grams = chosen.select("text", "lang").mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = grams.withColumn("place", F.row_number().over(best)).where(F.col("place") <= GRAMS).select("lang", "gram", "n").toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts: dict[str, np.ndarray] = {}
    for lang, gram, n in zip(*(rows.column(x).to_pylist() for x in ("lang", "gram", "n"))):
        counts.setdefault(gram, np.zeros(len(langs)))[langs.index(lang)] = n
    return Model(langs, counts)


def _predictions(model: Model, batch: list[str]) -> tuple[list[str], list[float], list[dict]]:
    names, scores, mixes = [], [], []
    at = 0
    while at < len(batch):
        docs, held = [], 0
        while at < len(batch) and held < CHARS:
            docs.append(_words(batch[at]))
            held += len(batch[at])
            at += 1
        full = [k for k, d in enumerate(docs) if d and model.langs]
        shares = model.shares([docs[k] for k in full]) if full else None
        found = dict(zip(full, range(len(full))))
        for k in range(len(docs)):
            if k in found:
                share = shares[found[k]]
                best = int(share.argmax())
                names.append(model.langs[best])
                scores.append(float(min(1.0, max(0.0, share[best]))))
                mixes.append([(model.langs[i], float(share[i])) for i in np.flatnonzero(share > 0)])
            else:
                names.append(UNKNOWN)
                scores.append(0.0)
                mixes.append([])
    return names, scores, mixes


def languages(docs: DataFrame, train: DataFrame, learn_docs: int = LEARN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (its share of the words), mixture (language: share).

    train: doc_id, text, lang; about learn_docs documents of a language are learnt from, drawn by a hash of their id, and its GRAMS most frequent
    n-grams kept, which bounds the model. Whole texts are learnt from and predicted. A text that is null or has no letter is `und` with score 0 and no mixture, and so are all texts if
    nothing is learnt. Equal shares go to the first language in order. Ids may be null or repeat. An empty table gives no rows; other columns are ignored.
    """
    bare = pick(docs, doc_id=id_col, text=text_col)
    handed = docs.sparkSession.sparkContext.broadcast(_plain(learnt(train.select("doc_id", "text", "lang"), learn_docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        model = Model(*handed.value)
        for b in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
            names, scores, mixes = _predictions(model, texts(b.column("text")))
            yield pa.record_batch([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "mixture"])

    return bare.mapInArrow(run, f"doc_id {dict(bare.dtypes)['doc_id']}, lang_pred string, score double, mixture map<string, double>")


def _plain(model: Model) -> tuple:
    return model.langs, model.counts


def identified(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter, with all their columns, however well the languages fit; also if none is learnt.

    Those without a letter are the ones that languages() predicts `und` once something is learnt. Nothing of the text is shuffled.
    """
    handed, at = docs.sparkSession.sparkContext.broadcast(_plain(learnt(train.select("doc_id", "text", "lang")))), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        model = Model(*handed.value)
        for b in (batch.slice(k, 512) for batch in batches for k in range(0, batch.num_rows, 512)):
            found = texts(b.column(at))
            keep = [x != UNKNOWN for x in _predictions(model, found)[0]] if model.langs else [bool(LETTERS.search(x.lower())) for x in found]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
