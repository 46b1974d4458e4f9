from collections import defaultdict

import corpus_pipeline
from test_ngram_join import brute

from scoreloom.llm.queries import remainder, word_vocabulary
from scoreloom.llm.toxicity import toxicity

DATA = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "exact_dedup", "ngram_join", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, labels = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(f"{DATA}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity(docs, labels.where(remainder("doc_id", 5) != 0)).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == spark.read.parquet(f"{DATA}/documents.parquet").columns and all(before[k] == r for k, r in after.items())
        if name == "toxicity":
            want = {k for k in before if not scores[k]}
        elif name == "language":
            want = {k for k, r in before.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "exact_dedup":
            best = defaultdict(int)
            for k, r in before.items():
                best[lower(r.text)] = max(best[lower(r.text)], k)
            want = set(best.values())
        else:
            want = {k for k, n, c in brute([(k, r.text) for k, r in before.items()]) if k == c}
        assert set(after) == want
        before = after
    coder, seen = Tokenizer.from_file(word_vocabulary()), defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect():
        seen[r.doc_id] += r.length
    assert seen == {k: len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1 for k, r in before.items()}


def test_empty_corpus(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_begin_with_heaps_handed_back(spark, monkeypatch):
    def full_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for operator in ("clean", "identified", "exact_dedup", "near_dedup", "pack"):
        monkeypatch.setattr(corpus_pipeline, operator, lambda *_: seen.append(full_collections()))
    for _, stage in corpus_pipeline.STAGES:
        before = full_collections()
        stage(spark, docs, DATA)
        assert seen[-1] > before
    assert len(seen) == len(corpus_pipeline.STAGES)
