"""Packed 16-bit ids of whole texts: word_bpe's chunks and tables, with the tokenizers library's model for words not seen yet."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from speechloom.llm.word_bpe import ChunkIds
from speechloom.llm.word_bpe import loaded as word_bpe


class FastIds(ChunkIds):
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        super().__init__(word_bpe(path), self._encode_words)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's merging by itself: what goes before it (normalising, splitting) is word_bpe's, and cheaper there."""
        letters, merge = self.bpe.letters, self.model.tokenize
        found = [[t.id for t in merge(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters))] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint16, int(sizes.sum())), sizes


_LOADED: dict[str, FastIds] = {}


def loaded(path: str) -> FastIds:
    if path not in _LOADED:
        _LOADED[path] = FastIds(path)
    return _LOADED[path]
