"""Encoding and decoding with a word-end BPE vocabulary (a tokenizers .json file) by prefix-sharing trie traversal.

Distinct words go into a trie in sorted order, which is its depth-first order. Each node carries one state: the last
token of the encoding of the prefix that ends there. A prefix's last token is the one vocabulary entry that ends there,
and whose pair with the last token of what remains is stable under merging; so a prefix shared by many words is encoded
once, and a word's ids are read off by stepping back from its end.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from speechloom.llm.common import bound_batches, map_columns, texts
from speechloom.llm.word_hash import WordTable

#: Distinct chunks and words each Python worker keeps.
CHUNKS_KEPT, WORDS_KEPT, PAIRS_KEPT = 1_500_000, 750_000, 400_000

END = "</w>"
#: Without these, the standard library's view of letters, numbers and white space is the vocabulary's own.
_UNUSUAL = re.compile(r"[^\t\n\r !-~\xa1-\xff]")
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else "" for b in range(256)} | {b: chr(next(spare)) for b in range(256) if b not in plain}


class TrieEncoder:
    """Words (in the byte-level alphabet) to token tuples."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]) -> None:
        self.vocab = vocab
        self.rank = {tuple(p): i for i, p in enumerate(merges)}
        made = {a + b for a, b in self.rank}
        reachable = [t for t in vocab if t in made or len(t.removesuffix(END)) == 1]
        self.inner = {t: t for t in reachable if not t.endswith(END)}
        self.final = {t.removesuffix(END): t for t in reachable if t.endswith(END)}
        self.longest: dict[tuple[bool, str], int] = {}
        for t in reachable:
            body = t.removesuffix(END)
            key = (len(body) < len(t), body[-1:])
            self.longest[key] = max(self.longest.get(key, 1), len(body))
        self.stable: dict[tuple[str, str], bool] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain pair merging, lowest rank first, leftmost of equals."""
        while len(symbols) > 1:
            best, at = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        body = token.removesuffix(END)
        out = list(body)
        if len(body) < len(token):
            out[-1] += END
        return out

    def follows(self, left: str, right: str) -> bool:
        """Whether merging keeps the border between two tokens; an empty left asks whether right is reachable by itself."""
        key = (left, right)
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= PAIRS_KEPT:
                self.stable.clear()
            start = self.symbols(left) if left else []
            known = self.stable[key] = self.merge(start + self.symbols(right)) == ([left, right] if left else [right])
        return known

    def last(self, word: str, end: int, closed: bool, states: list[str]) -> str:
        """The last token of word[:end], at the end of the word if closed."""
        find, stable = (self.final if closed else self.inner).get, self.stable
        for begin in range(max(0, end - self.longest.get((closed, word[end - 1]), 1)), end):
            token = find(word[begin:end])
            if token is not None:
                left = states[begin]
                ok = stable.get((left, token))
                if self.follows(left, token) if ok is None else ok:
                    return token
        return word[end - 1] + (END if closed else "")

    def encode_sorted(self, words: list[str]) -> list[list[str]]:
        """Distinct words in sorted order; a depth-first walk whose stack holds the states of the current path."""
        out, states, path = [], [""], ""
        for word in words:
            shared, most = 0, min(len(states) - 1, len(word) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word)):
                states.append(self.last(word, end, False, states))
            path = word
            token = self.last(word, len(word), True, states)
            back, at = [token], len(word) - len(token.removesuffix(END))
            while at > 0:
                back.append(states[at])
                at -= len(states[at])
            out.append(back[::-1])
        return out


class WordBpe:
    """A tokenizer file's whole way from text to ids and back, with bounded caches of chunks and words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        assert model["end_of_word_suffix"] == END and not model["byte_fallback"]
        self.encoder = TrieEncoder(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.id = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.letters = {k: v for k, v in byte_letters().items() if chr(k) != v}
        names = {**{i: t for t, i in self.id.items()}, **{i: t for t, i in self.added.items()}}
        assert max(names) < 1 << 16
        self.token = [names.get(i, "") for i in range(max(names) + 1)]
        self.number = list(map(str, range(len(self.token))))
        self.chunks = ChunkIds(self, self._word_ids)

    @staticmethod
    def lower(text: str) -> str:
        """NFC, then each character by itself in lower case (so no final sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split_all(self, chunks: list[str]) -> list[list[str]]:
        """The words of each chunk; a space is no part of a chunk, and neither joins nor is joined in normalising."""
        low = self.lower(" ".join(chunks))
        if not _UNUSUAL.search(low):
            return list(map(_LATIN.findall, low.split(" ")))
        return [_LATIN.findall(c) if not _UNUSUAL.search(c) else self.pattern.findall(c) for c in low.split(" ")]

    def _encode_words(self, words: list[str]) -> list[list[str]]:
        spelt = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        order = sorted(range(len(words)), key=spelt.__getitem__)
        out: list[list[str]] = [[]] * len(words)
        for i, tokens in zip(order, self.encoder.encode_sorted([spelt[i] for i in order]), strict=True):
            out[i] = tokens
        return out

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, ids = self._encode_words(words), self.id
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((ids[t] for ts in found for t in ts), np.uint16, int(sizes.sum())), sizes

    def pieces(self, text: str) -> list[str]:
        """White-space chunks; added tokens stand alone, as they are found before anything is normalised."""
        if "<|" not in text and not _UNUSUAL.search(text):
            return text.split()
        out, at = [], 0
        for m in self.special.finditer(text):
            out += regex.split(r"\s+", text[at : m.start()]) + [m[0]]
            at = m.end()
        return [c for c in out + regex.split(r"\s+", text[at:]) if c]

    def encode_batch(self, batch: list[str]) -> list[tuple[str, str]]:
        """For each text its decimal ids and its decoded text."""
        number, token = self.number.__getitem__, self.token.__getitem__
        found = (ids.tolist() for ids in self.chunks.encode_batch(batch))
        return [(" ".join(map(number, ids)), " ".join(map(token, ids))) for ids in found]


class ChunkIds:
    """The ids of whole texts: each different chunk is looked up once a batch, and each word of chunks not seen yet once."""

    def __init__(self, bpe: WordBpe, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], chunks_kept: int = CHUNKS_KEPT, words_kept: int = WORDS_KEPT) -> None:
        self.bpe = bpe
        self.words = WordTable(words_kept, encode_words)
        self.chunks = WordTable(chunks_kept, self._encode)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        added = [(i, self.bpe.added[c]) for i, c in enumerate(chunks) if c in self.bpe.added]
        if added:
            chunks = list(chunks)
            for i, _ in added:
                chunks[i] = ""
        split = self.bpe.split_all(chunks)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = " ".join(chain.from_iterable(split))
        ids, sizes = self.words.runs(words) if words else (np.empty(0, np.uint16), np.empty(0, np.int64))
        last = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        total = np.diff(last, prepend=0)
        if added:
            at = np.array([i for i, _ in added])
            ids = np.insert(ids, last[at], [x for _, x in added])
            total[at] = 1
        return ids, total

    def encode_batch(self, batch: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with the end id after them where given."""
        plain = [" ".join(self.bpe.pieces(t)) for t in batch]
        counts = np.array([t.count(" ") + 1 if t else 0 for t in plain])
        some = [t for t in plain if t]
        ids, sizes = self.chunks.runs(" ".join(some)) if some else (np.empty(0, np.uint16), np.empty(0, np.int64))
        last = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        if end is not None:
            ids = np.insert(ids, last, end)
            last = last + np.arange(1, len(last) + 1)
        return np.split(ids, last[:-1])


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: its ids, and the text they decode to.

    Null and empty texts have no ids and decode to the empty text; repeated rows are encoded each for itself; an empty
    table gives an empty one; other columns of docs are left out. Special strings inside a text become their single ids.
    """
    bound_batches(docs.sparkSession)

    def make(batches):
        bpe = loaded(tokenizer_path)
        for b in batches:
            got = bpe.encode_batch(b["text"])
            yield {
                "doc_id": b["doc_id"],
                "n_tokens": [ids.count(" ") + 1 if ids else 0 for ids, _ in got],
                "ids_sha256": [hashlib.sha256(ids.encode()).hexdigest() for ids, _ in got],
                "decoded_sha256": [hashlib.sha256(text.encode()).hexdigest() for _, text in got],
            }

    return map_columns(texts(docs, "doc_id"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The ids and decoded texts themselves: doc_id, ids array<int>, decoded string."""
    bound_batches(docs.sparkSession)

    def make(batches):
        bpe = loaded(tokenizer_path)
        for b in batches:
            got = bpe.encode_batch(b["text"])
            yield {"doc_id": b["doc_id"], "ids": [[int(i) for i in ids.split()] for ids, _ in got], "decoded": [text for _, text in got]}

    return map_columns(texts(docs, "doc_id"), "doc_id long, ids array<int>, decoded string", make)
