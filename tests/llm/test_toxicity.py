import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom.llm.queries import op3_language, op7_toxicity
from scoreloom.llm.toxicity import NEAREST, PLACES, Index, clean, text_terms, toxicity

DATA = "/root/testdata/sf0.01"


def _index(texts, label):
    parts, at = [], 0
    for n, row, word, count in text_terms(pa.array(texts)):
        parts.append((row + at, word, count))
        at += n
    return Index.built(list(range(len(texts))), np.array(label, float), np.ones(len(texts)), *map(np.concatenate, zip(*parts)))


def test_nearest_against_dense_brute_force():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 60, 3060])]) for _ in range(rng.randrange(1, 40))) for _ in range(700)]
    texts += texts[:20] * 2  # ties
    index = _index(texts, [k % 3 == 0 for k in range(len(texts))])
    asked = [None, "", "unheard words only", *texts[:50], *(" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(50)), "w1 " * 5000]
    dense = np.zeros((len(index.ids), len(index.terms)))
    for t in range(len(index.terms)):
        z = slice(index.first[t], index.first[t + 1])
        dense[index.example[z], t] = index.weight[z]
    assert np.allclose((dense**2).sum(axis=1), 1)
    at = 0
    found = list(index.scored(pa.array(asked)))
    for n, row, word, count in text_terms(pa.array(asked)):
        _, best, near = found.pop(0)
        rows, term, weight = index.vectors(n, row, word, count)
        for k in range(n):
            own = np.zeros(len(index.terms))
            own[term[rows == k]] = weight[rows == k]
            cosine = np.round(dense @ own, PLACES)
            want = [i for i in np.lexsort((np.arange(len(cosine)), -cosine))[:NEAREST].tolist() if cosine[i] > 0]
            got = best[k][near[k] > 0].tolist()
            assert np.allclose(near[k][: len(want)], cosine[want], atol=1e-8) and len(got) == len(want)
            assert [i for i in got if cosine[i] > cosine[want[-1]] + 1e-8] == [i for i in want if cosine[i] > cosine[want[-1]] + 1e-8]
        at += n
    assert at == len(asked)


def test_held_out_accuracy(spark):
    marks = spark.read.parquet(f"{DATA}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    rows = op7_toxicity(spark, DATA).join(marks, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    toxic, fine = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    pairs = [(a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in fine]
    assert sum(pairs) / len(pairs) > 0.85 and np.mean([r.predicted for r in fine]) < 0.05


def test_language_held_out(spark):
    langs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang IS NOT NULL AND length(text) > 0").select("doc_id", "lang")
    rows = op3_language(spark, DATA).where("held_out").join(langs, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(k, t, k) for k, t in [(1, "you idiot fool"), (2, "a kind friend"), (3, None), (4, ""), (None, "idiot"), (5, "idiot"), (5, "kind friend"), (6, "x " * 200_000)]], "doc_id long, text string, score int")
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (6, 7)], "doc_id long, toxic int")
    rows = toxicity(docs, marks).orderBy("doc_id").collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {e.doc_id for r in rows for e in r.evidence} <= {1, 2} and [r.evidence for r in rows if r.doc_id in (3, 4, 6)] == [[], [], []]
    assert toxicity(docs.limit(0), marks).count() == 0 and clean(docs.limit(0), marks).count() == 0
    assert {r.score for r in toxicity(docs, marks.limit(0)).collect()} == {0.0} and clean(docs, marks.limit(0)).count() == 8
    assert clean(docs, marks).columns == docs.columns
    again = {r.doc_id: r.score for r in toxicity(docs.repartition(5), marks).where(F.col("doc_id") < 5).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in rows if r.doc_id and r.doc_id < 5})
