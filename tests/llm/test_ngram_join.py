import random
import re

from scoreloom.llm.ngram_join import near_dedup, near_groups


def _set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(d, low.get(find(k), d))
    return sorted(((d, len(s), low.get(find(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def _corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 90))]
        texts.append(base)
        for _ in range(rng.randrange(8)):
            base = list(base) if rng.random() < 0.5 else list(texts[-1])
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(base + [rng.choice(words)] * rng.randrange(2))
    texts += [passage + [rng.choice(words) for _ in range(rng.randrange(12))] for _ in range(25)]
    texts += [["a"] * 50, ["a"] * 60, ["x", "y"], ["x", "y"], ["x", "z"]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, rows[0][1]), (903, rows[0][1].upper()), (903, rows[0][1]), (904, "É b c d e f"), (905, "é b c d e f"), (906, "a\x1cb c\x0bd e f g")]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in range(3):
        rows = _corpus(seed)
        docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, n long, print string").repartition(3)
        got = sorted((tuple(r) for r in near_groups(docs).collect()), key=str)
        assert got == brute(rows)


def test_one_of_each_stays(spark):
    text = " ".join(f"t{k}" for k in range(60))
    docs = spark.createDataFrame([(3, text), (5, text + " more"), (7, "other words"), (8, None), (9, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup(docs).collect()) == [3, 7, 8, 9]
    assert near_groups(docs.where("false")).count() == 0
