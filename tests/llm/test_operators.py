"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from scoreloom.llm.exact_dedup import exact_dedup, exact_groups
from scoreloom.llm.language import Model, identified, languages
from scoreloom.llm.packing import pack
from scoreloom.llm.queries import word_vocabulary
from scoreloom.llm.sharding import shard_rows
from scoreloom.llm.topk import exact_topk
from scoreloom.llm.toxicity import toxicity
from scoreloom.llm.warc import warc_round_trip

TEXTS = ["Alpha beta", "alpha BETA", "ÀB", "Àb", "àb", "", None, "x" * 50_000, "one two three " * 900, "alpha beta"]
DOCS = [(i, t, "print", 7) for i, t in enumerate(TEXTS * 3)]
SCHEMA = "doc_id long, text string, source string, n long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    groups = defaultdict(list)
    for i, t, *_ in DOCS:
        groups[lower(t)].append(i)
    found = {r.doc_id: r for r in exact_groups(docs).collect()}
    assert len(found) == len(DOCS)
    for text, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {r.doc_id for r in exact_dedup(docs).collect()} == {max(x) for x in groups.values()}
    assert exact_groups(docs.limit(0)).count() == 0


def test_topk(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.25, 1.0]) for _ in range(6)], 1) for i in range(200)]
    rows += [(200, None, 1), (250, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (300, [float("nan")] * 6, 1), (350, [0.0] * 6, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = {i: np.floor(256 * np.array(e, np.float32).astype(float)) for i, e, _ in rows if e and None not in e and np.isfinite(e).all()}
    expected = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk(vectors, vectors.where("vec_id % 50 = 0"), k=5).collect()} == expected


def test_sharding(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    rows = shard_rows(docs, shards=8).collect()
    text = dict((i, t) for i, t, *_ in DOCS)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_packing(spark):
    from tokenizers import Tokenizer

    coder, pieces, sequences = Tokenizer.from_file(word_vocabulary()), defaultdict(list), defaultdict(list)
    for r in pack(spark.createDataFrame(DOCS, SCHEMA), word_vocabulary()).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in DOCS:
        ids, at = [*coder.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_warc(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(TEXTS)], "page_id long, url string, html string")
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[(t or "").encode()].append(i)
    found = {r.page_id: r for r in warc_round_trip(pages).collect()}
    assert len(found) == len(TEXTS)
    for raw, ids in groups.items():
        for i in ids:
            first = i == min(ids)
            assert found[i].payload_bytes == len(raw)
            assert found[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            assert (found[i].record_type, found[i].refers_to) == (("response", None) if first else ("revisit", min(ids)))


def test_learnt_operators_keep_every_row(spark):
    words = {"a": "the cat and the dog sat here", "b": "die katze und der hund sitzen da"}
    rows = [(i, words["ab"[i % 2]] + f" {i}", "ab"[i % 2]) for i in range(40)] + [(40, None, "a"), (41, "", None), (42, "123 !", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in languages(docs, docs.where("doc_id < 30")).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    assert all(found[i].lang_pred == "ab"[i % 2] for i in range(40))
    assert {found[i].lang_pred for i in (40, 41, 42)} == {"und"}
    marks = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    scored = {r.doc_id: r for r in toxicity(docs, marks).collect()}
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored.values())
    assert all(scored[i].predicted == i % 2 for i in range(40))
    assert {r.score for r in toxicity(docs, marks.limit(0)).collect()} == {0.0}


def test_likelihoods_do_not_depend_on_the_batch():
    """Over 400,000 n-grams in one call."""
    rng = random.Random(3)
    counts = {"ab": np.array([5.0, 1.0]), "a": np.array([9.0, 2.0]), "b": np.array([3.0, 7.0]), "\x03": np.array([4.0, 4.0])}
    words = ["abab", "ba", *("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(40)) for _ in range(11_000)), "bbbb", "aab"]
    together = Model(["x", "y"], counts)
    together.learn(words)
    assert len(together.rows) > 400_000
    for w in words[:50] + words[9700:9900] + words[-50:]:
        alone = Model(["x", "y"], counts)
        alone.learn([w])
        assert np.allclose(together.likelihood[together.scored[w]], alone.likelihood[0])


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "the cat", None), (2, "12 !", None), (3, None, None), (4, "", None), (5, "Àß", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in identified(docs, docs).collect()) == [1, 5]
    known = docs.unionByName(spark.createDataFrame([(6, "the dog", "a")], docs.schema))
    assert sorted(r.doc_id for r in identified(known, known).collect()) == [1, 5, 6]


def test_exact_dedup_tells_texts_of_one_id_apart(spark):
    rows = [(1, "a b"), (2, "A b"), (1, "c"), (1, "C"), (None, "c"), (None, "d"), (None, "D"), (3, None), (4, ""), (2, "a B")]
    kept = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, lower(r.text)) for r in kept.collect()) == [(0, "d"), (1, "c"), (2, "a b"), (4, "")]
    assert exact_dedup(kept.limit(0)).count() == 0


def test_routing_map_of_any_size(spark, monkeypatch):
    from scoreloom.llm import exact_dedup as module

    docs = spark.createDataFrame([(i, f"text {i % 700}") for i in range(1000)], "doc_id long, text string")
    for most, least in ((6, 6), (30, 22)):
        monkeypatch.setattr(module, "ROUTE_MOST", most)
        monkeypatch.setattr(module, "ROUTE_LEAST", least)
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_groups(docs).collect()) == [(i, i % 700 + 700 if i % 700 < 300 else i, 2 if i % 700 < 300 else 1) for i in range(1000)]


def test_topk_in_blocks_by_length_and_through_the_merge_tree(spark, monkeypatch):
    from scoreloom.llm import topk as module

    monkeypatch.setattr(module, "BLOCK_BYTES", 400)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.125, 2.0]) for _ in range(3 + i % 2)]) for i in range(300)] + [(10, [1.0, 1.0, 1.0]), (None, [9.0, 9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk(vectors, vectors.where("vec_id % 25 = 0"), k=4).collect()}
    expected = set()
    for q, own in [x for x in rows if x[0] is not None and x[0] % 25 == 0]:
        best = sorted((-int(sum(np.floor(256 * a) * np.floor(256 * b) for a, b in zip(own, v))), i) for i, v in rows if i is not None and i != q and len(v) == len(own))[:4]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert found == expected
    assert exact_topk(vectors.limit(0), vectors.limit(0)).count() == 0
