"""Token operators against the libraries they stand for, and packing against its own ids."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from speechloom.llm import packing, piece_count, word_bpe  # noqa: E402
from speechloom.llm.fast_ids import FastIds  # noqa: E402
from speechloom.llm.queries import QUERIES, tokenizer  # noqa: E402

WORD, PIECE = "word_bpe_49k.json", "piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(WORD))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE))


def test_round_trip_of_nasty_rows(spark, nasty, library):
    rows = {r.doc_id: r for r in word_bpe.encode_decode(nasty, tokenizer(WORD)).collect()}
    for r in nasty.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert word_bpe.encode_decode(nasty, tokenizer(WORD)).count() == nasty.count()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeINGtion's .,!12éßñ日<|>\n\t ΣK")), max_size=60))
def test_encoder_matches_library(library, text):
    ids, decoded = word_bpe.loaded(tokenizer(WORD)).encode_batch([text])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == " ".join(map(str, want)) and decoded == library.decode(want, skip_special_tokens=False)


def test_whole_table_round_trip(spark, library):
    """Both digests of every document."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op6_word_bpe_round_trip"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ids_and_texts_themselves(spark, nasty, library):
    for r, want in zip(word_bpe.encoded(nasty, tokenizer(WORD)).collect(), nasty.collect(), strict=True):
        ids = library.encode(want.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_trie_of_words_of_any_length(library):
    bpe = word_bpe.loaded(tokenizer(WORD))
    words = sorted({"".join(w) for w in np.random.default_rng(2).choice(list("abcdehinorst"), (400, 9))} | {"a", "an", "and", "andthe", "andthem", "x" * 3000, "the" * 900})
    for w, tokens in zip(words, bpe.encoder.encode_sorted(words), strict=True):
        assert tokens == library.encode(w).tokens


def test_cache_limits_change_nothing():
    small = word_bpe.WordBpe(tokenizer(WORD))
    small.chunks.chunks.limit = small.chunks.words.limit = 3
    texts = ["one two three four", "five six one two", "three seven eight one"] * 2
    assert [small.encode_batch([t])[0] for t in texts] == word_bpe.loaded(tokenizer(WORD)).encode_batch(texts)


def test_piece_counts_of_nasty_rows(spark, nasty, pieces):
    rows = piece_count.token_counts(nasty, tokenizer(PIECE), limit=100).collect()
    text = {r.doc_id: r.text or "" for r in nasty.collect()}
    assert len(rows) == nasty.count()
    for r in rows:
        n = len(pieces.encode(text[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 100)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdetINGion's .,!12éßñ日<>\n\t ▁")), max_size=60))
def test_counter_matches_library(pieces, text):
    assert piece_count.loaded(tokenizer(PIECE)).count_batch([text]) == [len(pieces.encode(text))]


def test_whole_table_queries(spark, library, pieces):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op5_piece_token_counts"](spark, SF).collect():
        assert r.n_tokens == len(pieces.encode(text[r.doc_id])) and r.over_limit == (r.n_tokens > 4096)
    for r in QUERIES["op6_word_bpe_round_trip"](spark, SF).collect():
        assert r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids)


def test_empty_tables(spark, empty):
    assert word_bpe.encode_decode(empty, tokenizer(WORD)).count() == 0
    assert piece_count.token_counts(empty, tokenizer(PIECE)).count() == 0
    assert packing.packed(empty, tokenizer(WORD)).count() == 0


def checked_packing(docs, library, **options):
    rows = packing.packed(docs, tokenizer(WORD), **options).collect()
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in docs.dropDuplicates().collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        copies = docs.where(docs.doc_id.eqNullSafe(r.doc_id)).count()
        assert sum(p.length for p in by_doc[r.doc_id]) == copies * len(ids)
        for p in by_doc[r.doc_id]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        if copies == 1:
            at = 0
            for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
                assert p.start == at
                at += p.length
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return rows


def test_packing_of_nasty_rows(spark, nasty, library):
    checked_packing(nasty, library)
    checked_packing(nasty.repartition(3), library, rounds=1)


def test_packing_of_whole_table_keeps_the_mixture(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = checked_packing(docs, library, rounds=4)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    total: dict = {}
    window: dict = {}
    for r in rows:
        total[source[r.doc_id]] = total.get(source[r.doc_id], 0) + r.length
        key = (r.sequence_id // 4, source[r.doc_id])
        window[key] = window.get(key, 0) + r.length
    whole = sum(total.values())
    for w in range(whole // (4 * 2048)):
        for s, n in total.items():
            assert abs(window.get((w, s), 0) - 4 * 2048 * n / whole) <= len(total) + 1


def test_schedule_with_other_shares_and_tiny_sources():
    plan = packing.Schedule({"a": 5000, "b": 3, "c": 20_000}, {"a": 0.6, "b": 0.3, "c": 0.1}, length=64, rounds=2)
    seen = []
    for s, n in (("a", 5000), ("b", 3), ("c", 20_000)):
        for start in range(0, n, 700):
            seen += [(q, o, size) for _, size, q, o in plan.place(s, start, min(700, n - start))]
    filled: dict = {}
    for q, o, size in seen:
        filled.setdefault(q, []).append((o, size))
    used = 0
    for parts in filled.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        used += at
        assert at == 64 or at & (at - 1) == 0
    assert used == 25_003


def test_fast_ids_match(library, nasty):
    texts = [r.text or "" for r in nasty.select("text").collect()]
    fast = FastIds(tokenizer(WORD))
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert fast.encode_batch([t])[0].tolist() == want and fast.encode_batch([t], 1)[0].tolist() == [*want, 1]
    together = texts * 2
    assert [x.tolist() for x in fast.encode_batch(together)] == [library.encode(t, add_special_tokens=False).ids for t in together]


def test_word_tables_past_their_limit(spark, library):
    """Words that find no room are worked out anew; results stay the same."""
    fast = FastIds(tokenizer(WORD))
    fast.chunks.limit, fast.words.limit = 50, 30
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for _ in range(2):
        for i in range(0, len(texts), 40):
            got = fast.encode_batch(texts[i : i + 40])
            assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[i : i + 40]]


def test_null_and_empty_sources_have_queues_of_their_own(spark):
    docs = spark.createDataFrame([(i, "some words here", None if i % 2 else "") for i in range(4)], "doc_id long, text string, source string")
    rows = packing.packed(docs, tokenizer(WORD), shares={None: 0.9, "": 0.1}).orderBy("sequence_id", "offset").collect()
    assert len(packing.tokenised(docs, tokenizer(WORD), 1).select("queue").distinct().collect()) == 2
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_more_sources_than_queues(spark, library):
    """Small sources share a queue; every document is packed all the same, and large ones keep their shares."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "big").otherwise(F.col("doc_id").cast("string")))
    checked_packing(docs, library, queues=3)
    rows = packing.packed(docs, tokenizer(WORD), queues=1).collect()
    total, big = sum(r.length for r in rows), {r.doc_id for r in docs.where("source = 'big'").collect()}
    share = sum(r.length for r in rows if r.doc_id in big) / total
    for w in range(total // 2048):
        assert abs(sum(r.length for r in rows if r.sequence_id == w and r.doc_id in big) - 2048 * share) <= 3


def test_every_sequence_of_the_query_keeps_the_mixture(spark):
    """With the registered query's own defaults."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    total: dict = {}
    window: dict = {}
    for r in QUERIES["op7_mixture_packing"](spark, SF).collect():
        s = source[r.doc_id]
        total[s] = total.get(s, 0) + r.length
        window[r.sequence_id, s] = window.get((r.sequence_id, s), 0) + r.length
    whole = sum(total.values())
    assert len(total) > 1 and whole >= 2048
    for w in range(whole // 2048):
        for s, n in total.items():
            assert abs(window.get((w, s), 0) - 2048 * n / whole) <= len(total) + 1
