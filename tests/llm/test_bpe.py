import hashlib
import random

import pytest

from scoreloom.llm.bpe import WordBpe, decode, encode, encode_digests
from scoreloom.llm.queries import word_vocabulary

tokenizers = pytest.importorskip("tokenizers")
PATH = word_vocabulary()
HARD = [
    "", " ", "aaa aaaa aaaaa a", "It's we'll THEY'RE 'sx don't", "x<|endoftext|>y <|startoftext|>", "<|endoftext|", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ﬁ ß ẞ", "é 각 Å",
    "\x00\x1c\x1d\x1e\x1f\x85\xa0 　 a​b﻿", "123 4५६ ²³ Ⅷ", "😀😃👩‍👩‍👧 🇩🇪", "z" * 5000, "ab" * 3000 + "!" * 700, "日本語 עברית العربية हिन्दी", "\r\n\t\x0b\x0c", "___--__  ...,,,", "\0sx", "\0<|ENDOFTEXT|> <|ENDOFTEXT|>", "a\x1cb \x1d c", "'S 'T 'LL", "a\u0558b \u1c89 \ua7cb! \U0003d000x",
]


def _random(seed: int) -> str:
    rng = random.Random(seed)
    return "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 127), rng.randrange(1, 0x2FF), rng.randrange(0x300, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(400)))


def test_matches_the_tokenizers_library():
    model, other = WordBpe(PATH), tokenizers.Tokenizer.from_file(PATH)
    batch = HARD + [_random(k) for k in range(300)]
    for text, packed in zip(batch, model.encode(batch, 2000)):
        ids = model.ids(packed)
        assert ids.tolist() == other.encode(text, add_special_tokens=False).ids, repr(text)
        assert model.decode(ids) == other.decode(ids.tolist(), skip_special_tokens=False)


def test_every_symbol_is_made_before_it_is_used():
    model = WordBpe(PATH)
    first: dict[int, int] = {}
    for rank, made in enumerate(model.made.tolist()):
        first.setdefault(made, rank)
    for key, rank in zip(model.keys.tolist(), model.ranks.tolist()):
        assert all(first.get(x, -1) < rank for x in divmod(key, int(model.size)))


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("scoreloom.llm.bpe.CACHE_WORDS", 3)
    model, whole = WordBpe(PATH), WordBpe(PATH)
    batch = [f"word{k} other{k}" for k in range(20)]
    assert list(model.encode(batch, 10)) == list(whole.encode(batch))


def test_rows(spark):
    rows = [(1, "Hello, world"), (1, None), (None, ""), (3, "the the")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = sorted(encode_digests(docs, PATH).collect(), key=str)
    other = tokenizers.Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = other.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(other.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in got} == set(want) and len(got) == 4
    back = {r.text for r in decode(encode(docs, PATH), PATH).collect()}
    assert "hello</w> ,</w> world</w>" in back and "" in back
    assert encode_digests(docs.where("false"), PATH).count() == 0


def test_the_cache_holds_each_word_once_whatever_stands_beside_it():
    model, marks = WordBpe(PATH), [".", ",", "!", "?", ";", ")", "(", "..", "--", "7"]
    batch = [f"{mark}word{'x' * k}{mark} " for k in range(50) for mark in marks]
    list(model.encode(batch, 100))
    assert len(model.known) <= 50 + len(marks) + 2  # and a space, and a space before the next text


@pytest.mark.parametrize("chars", [5, 300, 1 << 19])
def test_splits_as_the_library_does(chars):
    """Endings after an apostrophe, numbers, mixed white space and letters of all widths, also where a text begins or ends."""
    rng = random.Random(7)
    letters = [*"''strevmld 1!\n", "é", "²", "’", "ſ", "\xa0", "\x85", " ", "\x1c", "日", "😀", "İ", "Σ", "́", "<|endoftext|>", "LL"]
    batch = ["".join(rng.choice(letters[: rng.choice([14, 28])]) for _ in range(rng.randrange(14))) for _ in range(5000)]
    model, other = WordBpe(PATH), tokenizers.Tokenizer.from_file(PATH)
    got = [model.ids(x).tolist() for x in model.encode(batch, chars)]
    assert got == [x.ids for x in other.encode_batch(batch, add_special_tokens=False)]
