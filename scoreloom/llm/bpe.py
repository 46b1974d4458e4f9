"""BPE encoding and decoding by batched merge rounds.

The letters of a batch are split into words by the kinds of neighbours, and each different word is looked
up once. The words that are not in the cache yet lie as one flat array of symbols. In each round
the rank of every neighbouring pair is found by binary search over the sorted pair keys, the lowest
rank of each word is taken, and all its places in the word merge at once, from the left.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import KEPT, pick, texts

#: Words whose ids a task remembers; then it starts anew from those in use.
CACHE_WORDS = 300_000
#: Characters of new words that merge together.
ROUND_CHARS = 1 << 18
#: Unicode white space.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Kinds of code points; all others may stand together in a word.
BLANK, LETTER, NUMBER = 1, 2, 3
NONE = np.iinfo(np.int32).max


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it has one, else the next letter from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Finds letters that this Python's Unicode version doesn't know."""
    runs: list[list[int]] = []
    for c in range(0x100, sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    points = "".join(map(chr, range(sys.maxunicode + 1)))
    out = np.zeros(len(points), np.int8)
    for kind, letters in ((BLANK, f"[{SPACE}]+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(letters, points):
            out[found.start() : found.end()] = kind
    return out


class WordBpe:
    """The vocabulary of a tokenizer file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.final = np.array([vocab[x + self.suffix] for x in letters], np.int32)
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.size = np.int64(len(self.tokens))
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.blank = regex.compile(f"[{SPACE}]")
        self.kind = np.dtype("<u2") if len(self.tokens) <= 1 << 16 else np.dtype("<u4")
        self.known: dict[bytes, bytes] = {}
        self.path, self.other = path, None

    def _parts(self, text: str) -> list[str | bytes]:
        """Normalised text that is still to be split, between the packed ids of special tokens and of words that were split otherwise."""
        if self.special and "<|" in text:
            out: list[str | bytes] = []
            for k, part in enumerate(self.special.split(text)):
                out.append(np.array(self.added[part], self.kind).tobytes() if k % 2 else self._plain(part))
            return out
        return [self._plain(text)]

    def _plain(self, text: str) -> str | bytes:
        if text.isascii():
            return text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if _unassigned().search(text):
                return self._newer(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter by itself: no final sigma

    def _newer(self, text: str) -> bytes:
        """The ids where letters are newer than this Python: split with the library's own tables; the merges stay ours."""
        if self.other is None:
            from tokenizers import Tokenizer

            self.other = Tokenizer.from_file(self.path)
        byte = {x: b for b, x in enumerate(_byte_letters())}
        split = self.other.pre_tokenizer.pre_tokenize_str(self.other.normalizer.normalize_str(text))
        words = [bytes(byte[x] for x in word) for word, _ in split]
        different = list(set(words))
        ids = dict(zip(different, self._looked_up(different)))
        return b"".join([ids[w] for w in words])

    def _split(self, raw: bytes) -> np.ndarray:
        """Where the words and the runs of white space of these letters begin, and their end. A word is what `'s 't 're 've 'm 'll 'd`, a run of letters, one number or a run of others is."""
        data, kinds = np.frombuffer(raw, np.uint8), _kinds()
        kind = kinds[data]
        if raw.isascii():
            begins = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER))
        else:
            points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
            points = points[points >= 0x80]
            kind[data >= 0x80] = np.repeat(kinds[points], 2 + (points >= 0x800).astype(np.int8) + (points >= 0x10000))
            begins = np.append(True, ((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)) & (data[1:] & 0xC0 != 0x80))
        mark = np.flatnonzero(data == ord("'"))
        mark = mark[begins[mark]]
        for ending in (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"):
            at = mark[mark <= len(data) - len(ending)]
            for k in range(1, len(ending)):
                at = at[data[at + k] == ending[k]]
            begins[at + 1] = False
            begins[at[at < len(data) - len(ending)] + len(ending)] = True
        return np.append(np.flatnonzero(begins), len(data))

    def _looked_up(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each of these different words. White space has none."""
        known = self.known
        found = list(map(known.get, words))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            new = [words[i] for i in gaps]
            portion = np.cumsum(np.fromiter(map(len, new), np.int64, len(new))) // ROUND_CHARS
            stops = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), len(new)]
            for a, b in zip(stops[:-1], stops[1:]):
                for i, w, ids in zip(gaps[a:b], new[a:b], self._merged(new[a:b])):
                    found[i] = b"" if w[:1].isspace() or w[0] >= 0x80 and self.blank.match(w.decode("utf-8")) else ids
            if len(known) + len(new) > CACHE_WORDS:  # those in use stay
                known.clear()
                known.update(zip(words, found))
            else:
                known.update((words[i], found[i]) for i in gaps)
        return found

    def _packed(self, some: list[str]) -> Iterator[bytes]:
        """The packed ids of each of these normalised texts. Each different word is looked up once."""
        raws = [x.encode("utf-8") for x in some]
        raw = b"\n".join(raws)
        if not raw:
            yield from raws
            return
        starts = self._split(raw)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(raw)]).dictionary_encode()
        ids = self._looked_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        taken = pa.array(ids, pa.large_binary()).take(words.indices)
        _, places, letters = taken.buffers()
        places, letters = np.frombuffer(places, np.int64)[: len(taken) + 1], memoryview(letters or b"")
        begin = np.cumsum([0, *(len(x) + 1 for x in raws[:-1])])
        # A text may begin inside white space, which has no ids.
        at = [*places[np.searchsorted(starts, begin, "right") - 1].tolist(), int(places[-1])]
        for a, b in zip(at[:-1], at[1:]):
            yield bytes(letters[a:b])

    def _merged(self, words: list[bytes]) -> list[bytes]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(length) - 1
        symbols[ends] = self.final[raw[ends]]
        of = np.repeat(np.arange(len(words), dtype=np.int32), length)
        rank = np.full(len(symbols), NONE, np.int32)
        self._rank(rank, symbols, of, np.arange(len(symbols) - 1))
        done_of, done = [], []
        while len(symbols):
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            length = np.diff(np.append(first, len(of)))
            least = np.minimum.reduceat(rank, first)
            low = np.repeat(least, length)
            if (least == NONE).any():
                over = low == NONE
                done_of.append(of[over])
                done.append(symbols[over])
                live = ~over
                symbols, of, rank, low = symbols[live], of[live], rank[live], low[live]
                if not len(symbols):
                    break
            hit = rank == low
            if (hit[1:] & hit[:-1]).any():  # a symbol that meets itself: every other place of a run, from the left
                step = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), step, 0))
                hit &= (step - begin) % 2 == 0
            where = np.flatnonzero(hit)
            symbols[where] = self.made[rank[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, of, rank = symbols[keep], of[keep], rank[keep]
            # Only pairs with a new symbol have a new rank.
            where = where - np.arange(len(where))
            before = where[where > 0] - 1
            rank[where[where == len(rank) - 1]] = NONE
            self._rank(rank, symbols, of, np.concatenate([where[where < len(rank) - 1], before]))
        of, ids = np.concatenate(done_of), np.concatenate(done)
        order = np.argsort(of, kind="stable")
        packed = ids[order].astype(self.kind).tobytes()
        stop = np.cumsum(np.bincount(of, minlength=len(words))) * self.kind.itemsize
        return [packed[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]

    def _rank(self, rank: np.ndarray, symbols: np.ndarray, of: np.ndarray, at: np.ndarray) -> None:
        """Look up the ranks of the pairs that begin at these places."""
        key = symbols[at] * self.size + symbols[at + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rank[at] = np.where((self.keys[found] == key) & (of[at] == of[at + 1]), self.ranks[found], NONE)

    def encode(self, batch: list[str], chars: int = 1 << 19) -> Iterator[bytes]:
        """The ids of each text, packed in self.kind. The new words of many texts are merged together."""
        at = 0
        while at < len(batch):
            some, held = at, 0
            while at < len(batch) and held < chars:
                held += len(batch[at])
                at += 1
            split = [self._parts(x) for x in batch[some:at]]
            packed = self._packed([x for parts in split for x in parts if isinstance(x, str)])
            for parts in split:
                yield b"".join([next(packed) if isinstance(x, str) else x for x in parts])

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.kind)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with single spaces between them: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


KEPT.append(loaded.cache_clear)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for b in batches:
            counts, coded, decoded = [], [], []
            for packed in model.encode(texts(b.column("text"))):
                ids = model.ids(packed)
                numbers = ids.tolist()
                counts.append(len(numbers))
                coded.append(hashlib.sha256(" ".join(map(str, numbers)).encode()).hexdigest())
                decoded.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for b in batches:
            ids = [model.ids(x).astype(np.int32) for x in model.encode(texts(b.column("text")))]
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for b in batches:
            out = [None if x is None else model.decode(np.array([i for i in x if i is not None], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: one row per input row. A null or empty text has no ids; ids of rows may repeat or be null; other columns are ignored."""
    bare = pick(docs, doc_id=id_col, text=text_col)
    return bare.mapInArrow(_encoder(path), f"doc_id {dict(bare.dtypes)['doc_id']}, ids array<int>")


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: one row per input row. Null ids give a null text; null items are left out."""
    bare = pick(coded, doc_id=id_col, ids=ids_col)
    return bare.mapInArrow(_decoder(path), f"doc_id {dict(bare.dtypes)['doc_id']}, text string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the encoding of each text and of the text decoded from those ids.

    Nothing is shuffled. A null text counts as empty: no tokens, and the digests of an empty string.
    """
    bare = pick(docs, doc_id=id_col, text=text_col)
    return bare.mapInArrow(_digests(path), f"doc_id {dict(bare.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
