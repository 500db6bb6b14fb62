"""Near-duplicate classes against brute force over word tuples and exact document counts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechloom.llm import near_dup
from speechloom.llm.queries import QUERIES


def shingle_counts(text):
    words = (text or "").lower().split()
    if not words:
        return Counter()
    return Counter([tuple(words[i : i + 5]) for i in range(len(words) - 4)] or [tuple(words)])


def brute_classes(texts, similarity, same=True):
    """The class of each text, as the least position: all pairs that share a shingle, by weighted Jaccard similarity."""
    n, sets = len(texts), [shingle_counts(t) for t in texts]
    held = Counter(s for own in sets for s in own)
    idf = {s: 1 + math.log(1 / max(c / n, 0.001)) for s, c in held.items()}
    holders = defaultdict(list)
    for i, own in enumerate(sets):
        for s in own:
            holders[s].append(i)
    common = Counter()
    for s, who in holders.items():
        for x, i in enumerate(who):
            for j in who[x + 1 :]:
                common[i, j] += min(sets[i][s], sets[j][s]) * idf[s]
    total = [sum(c * idf[s] for s, c in own.items()) for own in sets]
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    def join(i, j):
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)

    for (i, j), w in common.items():
        if w >= (similarity - 1e-9) * (total[i] + total[j] - w):
            join(i, j)
    first = {}
    for i, t in enumerate(texts):
        join(i, first.setdefault(t or "", i))
    return [find(i) for i in range(n)]


def between(got, low, high):
    """Whether the classes got join all that high joins, and nothing that low does not."""
    finer = lambda a, b: len(set(zip(a, b, strict=True))) == len(set(a))
    return finer(high, got) and finer(got, low)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_against_brute_force(spark, sf):
    """The sketch's noise moves a similarity by less than 0.02 at these sizes; beyond that every link is found, and no other."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op8_icws_near_duplicates"](spark, f"/root/testdata/{sf}").collect()}
    texts = [r.text for r in rows]
    classes = [got[r.doc_id].class_id for r in rows]
    assert between(classes, brute_classes(texts, 0.78), brute_classes(texts, 0.82))
    sizes = Counter(classes)
    assert all(got[r.doc_id].class_size == sizes[got[r.doc_id].class_id] for r in rows)


@pytest.fixture
def groups():
    """Copies of one text with one word changed in each, a chain whose ends are not alike, and others."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(words, 120))
    rows = []
    for i in range(60):
        t = list(base)
        t[int(rng.integers(120))] = f"x{i}"
        rows.append((i, " ".join(t)))
    chain = list(rng.choice(words, 150))
    for i in range(40):
        chain = [*chain[2:], f"y{i}", f"z{i}"]
        rows.append((100 + i, " ".join(chain)))
    return rows + [(1000 + i, " ".join(rng.choice(words, 60))) for i in range(1500)]


@pytest.mark.parametrize(("sketches", "block", "room"), [(2048, 256, 4_000_000), (8, 8, 4_000_000), (16, 4, 4_000_000), (2048, 256, 900)])
def test_blocks_of_any_size_give_the_same_classes(spark, monkeypatch, groups, sketches, block, room):
    monkeypatch.setattr(near_dup, "SKETCHES", sketches)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", room)
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(groups, "doc_id long, text string")).collect()}
    texts = [t for _, t in groups]
    assert between([got[i] for i, _ in groups], brute_classes(texts, 0.79), brute_classes(texts, 0.81))


def test_common_passages_weigh_little(spark):
    """Texts alike mostly by a passage that a third of all documents hold are no copies; with a rare passage they are."""
    rng = np.random.default_rng(9)
    word = lambda: f"v{rng.integers(1 << 40)}"
    common, rare = (" ".join(word() for _ in range(80)) for _ in range(2))
    tail = lambda: " ".join(word() for _ in range(6))
    rows = [(i, f"{common} {tail()}") for i in range(300)] + [(1000 + i, f"{rare} {tail()}") for i in range(2)]
    rows += [(2000 + i, " ".join(word() for _ in range(60))) for i in range(598)]
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1001] == 1000 and all(got[i] == i for i in range(300))


def test_nasty_rows(spark, nasty, empty):
    got = near_dup.classes(nasty)
    assert got.count() == nasty.count()
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[0].class_id == rows[1].class_id == 0 and rows[0].class_size == 2
    assert rows[4].class_size == 3 and rows[None].class_id is None
    kept = near_dup.deduplicated(nasty)
    assert kept.columns == nasty.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id = 1").count() == 0
    assert kept.where("doc_id IS NULL").count() == 1
    assert near_dup.classes(empty).count() == 0 and near_dup.deduplicated(empty).count() == 0


def test_rows_without_an_id(spark):
    """A text that only rows without an id hold bridges two others, and goes where a row with an id stays."""
    words = [f"w{i}" for i in range(200)]
    chain = [" ".join(words[7 * i : 100 + 7 * i]) for i in range(3)]
    rows = [(1, chain[0]), (None, chain[1]), (None, chain[1]), (3, chain[2])]
    rows += [(100 + i, " ".join(f"v{i}_{j}" for j in range(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.classes(docs).where("doc_id IS NULL OR doc_id < 100").collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in got} == {(1, 1, 4), (None, 1, 4), (3, 1, 4)}
    assert [r.doc_id for r in near_dup.deduplicated(docs).where("doc_id IS NULL OR doc_id < 100").collect()] == [1]
    alone = spark.createDataFrame([(None, chain[0]), (None, chain[0])], "doc_id long, text string")
    assert near_dup.deduplicated(alone).count() == 1


def test_an_id_with_different_texts(spark):
    """Different texts under one id are different documents: none is lost, and their classes are told apart."""
    text = lambda k: " ".join(f"{k}{j}" for j in range(30))
    docs = spark.createDataFrame([(5, text("a")), (5, text("b")), (5, text("b")), (6, text("a"))], "doc_id long, text string")
    got = near_dup.classes(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == [(5, 5, 2)] * 3 + [(6, 5, 2)]
    assert len({r.class_key for r in got}) == 2
    kept = sorted(r.text for r in near_dup.deduplicated(docs).collect())
    assert kept == [text("a"), text("b")]


def test_agreement_bound():
    """A pair at the similarity agrees in fewer samples than asked for at most once in ten thousand."""
    rng = np.random.default_rng(4)
    least = near_dup.least_agreement(0.8)
    assert 14 <= least <= 20 and (rng.binomial(33, 0.8, 1_000_000) < least).mean() <= 1.3e-4


def test_sampling_agrees_with_similarity():
    """The share of equal samples is the weighted Jaccard similarity."""
    rng = np.random.default_rng(6)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    w = rng.uniform(1, 3, 300).astype(np.float32)
    a, b = np.arange(0, 220), np.arange(60, 300)
    both = np.concatenate([h[a], h[b]])
    log_weight = np.log(np.concatenate([w[a], w[b] * np.float32(1.2)]))
    same = np.mean([len(set(near_dup.samples(both, log_weight, np.array([0, len(a)]), k))) == 1 for k in range(1500)])
    wa, wb = np.zeros(300), np.zeros(300)
    wa[a], wb[b] = w[a], w[b] * 1.2
    assert abs(same - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


def test_document_counts_of_full_batches(spark, monkeypatch):
    """A task whose last batch has just been added up still gives its counts, and one without words gives zeros."""
    words = near_dup.WIDTH + 5
    docs = spark.createDataFrame([(" ".join(map(str, range(words))),), (None,)], "text string").coalesce(1)
    sketch, n = near_dup.document_counts(docs)
    assert n == 2 and sketch.sum(1).tolist() == [words - 4, words - 4]
    assert near_dup.document_counts(spark.createDataFrame([(None,)], "text string"))[0].sum() == 0


def test_shingles_by_the_plain_rule(nasty_texts=("a b c d e f", "A  b\tc D\u3000e F", "a b", "", " ", "é à b c d e ü", "x" * 3000 + " b c d e f g", "w " * 300_000 + "z")):
    """Equal five-word runs, and only these, have equal hashes, however the texts are batched."""
    seen = {}
    for t, h in zip(nasty_texts, near_dup.shingles(list(nasty_texts)), strict=True):
        words = t.lower().split()
        want = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        assert len(want) == len(h) and near_dup.shingles([t])[0].tolist() == h.tolist()
        for w, x in zip(want, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_spanning_links():
    rng = np.random.default_rng(3)
    for _ in range(20):
        linked = np.triu(rng.random((30, 30)) < 0.05, 1)
        linked |= linked.T
        roots = rng.integers(0, 12, 30).tolist()
        want, got = near_dup.Union(), near_dup.Union()
        for i, j in np.argwhere(linked):
            want.join(roots[i], roots[j])
        for i, j in near_dup.spanning(linked, roots):
            assert linked[i, j] and got.join(roots[i], roots[j])
        assert [want.find(r) for r in roots] == [got.find(r) for r in roots]


def test_document_counts(spark):
    """The sketch's shares are the exact ones but for its noise."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sketch, n = near_dup.document_counts(docs)
    shares = near_dup.bucket_shares(sketch, n)
    made = [np.unique(h) for h in near_dup.shingles([r.text or "" for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).collect()])]
    h, count = np.unique(np.concatenate(made), return_counts=True)
    want = 1 - np.log(np.clip(count / n, near_dup.RARE, 1))
    off = np.abs(near_dup.idf(h, shares) - want)
    assert n == 1000 and off.mean() < 0.15 and off[count > 50].max() < 0.1
