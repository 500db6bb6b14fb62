"""Words that simple hashes take for each other keep their own ids."""

import hashlib

import numpy as np
import pytest

from speechloom.llm import word_hash
from speechloom.llm.near_dup import shingles
from speechloom.llm.word_hash import WordTable


def thue_morse(letters: int) -> tuple[str, str]:
    word = "a"
    other = str.maketrans("ab", "ba")
    while len(word) < letters:
        word += word.translate(other)
    return word, word.translate(other)


SIZES = (1024, 2048, 4096)


@pytest.mark.parametrize("letters", SIZES)
def test_words_of_alternating_blocks_have_their_own_hashes(letters):
    data = np.frombuffer((" ".join(thue_morse(letters)) + " ").encode(), np.uint8)
    for h in word_hash.word_hashes(data, word_hash.word_ends(data), 2):
        assert h[0] != h[1]
    one, other = shingles(list(thue_morse(letters)))
    assert one[0] != other[0]


def test_their_ids_are_those_of_the_library(spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from speechloom.llm import packing, word_bpe
    from speechloom.llm.queries import tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [t for n in SIZES for w, v in [thue_morse(n)] for t in (w, v, f"{w} {v}", f"{v}, {w}.", f"x{w}")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for r in word_bpe.encode_decode(docs, path).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
    for r in packing.tokenised(docs, path, 1).collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == [*want[r.doc_id], 1]


def test_words_that_share_their_first_hash(monkeypatch):
    """Every word has the same first hash here: results must not change, and nothing fails."""
    honest = word_hash.word_hashes

    def clashing(data, ends, kinds=1):
        out = honest(data, ends, kinds)
        out[0][:] = 7
        return out

    monkeypatch.setattr(word_hash, "word_hashes", clashing)
    table = WordTable(100, lambda words: (np.array([ord(w[0]) for w in words], np.uint16), np.ones(len(words), np.int64)))
    for words in ("a b c a", "c b d", "d a", "b"):
        ids, sizes = table.runs(words)
        assert [chr(i) for i in ids] == words.split(" ") and sizes.tolist() == [1] * len(words.split(" "))
