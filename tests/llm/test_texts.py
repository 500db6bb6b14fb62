"""Classifiers, near-duplicates and the pipeline."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from speechloom.llm import near_dup, quality, toxicity
from speechloom.llm.components import components
from speechloom.llm.labelled import held_out
from speechloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_fold(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_quality_on_the_held_out_fold(spark):
    """Balanced accuracy on rows that were never learnt from."""
    got = QUERIES["op1_pu_quality"](spark, SF)
    assert got.count() == 1000 and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    rows = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert np.mean([np.mean([r.predicted == y for r in rows if r.quality == y]) for y in (0, 1)]) >= 0.9


def test_toxicity_on_the_held_out_fold_of_every_language(spark):
    """Of clean rows that were never learnt from at least 97 in 100 are left alone, of toxic ones at least 85 caught."""
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_string_kernel_toxicity"](spark, sf)
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(lang, "doc_id").collect()
    for name in ("de", "en", "es", "fr"):
        clean, toxic = ([r.predicted for r in rows if r.lang == name and r.toxic == y] for y in (0, 1))
        assert np.mean(clean) <= 0.03 and np.mean(toxic) >= 0.85, name


def test_weights_by_triple_are_the_kernel_machine():
    """The folded decision equals the sum over landmarks of their weight times the kernel, by plain counting."""

    def kernel(a, b):
        both = []
        for w in (a, b):
            letters = toxicity.codes([w])[0].tolist()
            held: dict = {}
            for i in range(len(letters)):
                for k in range(i + 2, min(len(letters), i + toxicity.SPAN)):
                    for j in range(i + 1, k):
                        key = (letters[i], letters[j], letters[k])
                        held[key] = held.get(key, 0) + toxicity.DECAY ** (k - i + 1 - 3)
            both.append(held)
        norm = lambda h: sum(v * v for v in h.values()) ** 0.5
        return sum(v * both[1].get(key, 0) for key, v in both[0].items()) / norm(both[0]) / norm(both[1])

    words = ["idiot", "idoit", "clown", "house", "i.diot", "stupid"]
    near = toxicity.dense(words, words)
    assert np.abs(near - [[kernel(a, b) for b in words] for a in words]).max() < 1e-5
    model = toxicity.train_words(["idiot", "stupid"], ["house", "clown", "river", "table"], [])
    assert min(model.decide(["idiot", "idixot"])) > max(model.decide(["house", "tables"]))


def test_one_stray_word_is_not_enough_where_labels_say_so():
    """Clean texts hold a stem of an insult now and then; toxic texts hold several of its forms."""
    rng = np.random.default_rng(12)
    plain = ["the", "on", "re", "at", "ing", "mar", "sel", "dun"]
    say = lambda n: " ".join("".join(rng.choice(plain, rng.integers(1, 4))) for _ in range(n))
    form = lambda: "qurvak" + "".join(rng.choice(plain, 1))
    bad = [f"{say(6)} {form()} {form()} {say(5)} {form()}." for _ in range(300)]
    good = [f"{say(12)} {'qurvaka' if i % 8 == 0 else ''} {say(4)}." for i in range(900)]
    model = toxicity.fit(bad + good, [1] * 300 + [0] * 900)
    score = model.score(toxicity.evidence([*bad, *good], model))
    assert (score[:300] >= 0.5).mean() > 0.97 and (score[300:] < 0.5).mean() > 0.97


def test_classifiers_ignore_ids_and_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fitted(docs, labels)
    x = np.array([quality.features(t) for t in ("THE!! END!! " * 40, "The end of the day was near, and all of the men went home again.")])
    assert model.score(x)[0] < model.score(x)[1] and 0.05 < model.prior < 0.99


def test_class_prior_is_found():
    rng = np.random.default_rng(3)
    pos, neg = rng.normal(2, 1, (3000, 2)), rng.normal(-2, 1, (3000, 2))
    model = quality.fit(pos[:1500], np.r_[pos[1500:], neg[:1000]], epochs=20)
    assert abs(model.prior - 0.6) < 0.08
    assert (model.score(pos) > 0.5).mean() > 0.95 and (model.score(neg) < 0.5).mean() > 0.95


def test_string_kernel_tolerates_gaps():
    insults = ["idiot", "worthless", "pathetic"]
    rng = np.random.default_rng(4)
    syllables = ["the", "on", "re", "at", "ing", "ti", "on", "est", "al", "ou"]
    say = lambda n: " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))
    bad = [f"{say(9)} {insults[i % 3]} {say(9)}." for i in range(60)]
    good = [f"{say(19)}." for _ in range(240)]
    model = toxicity.fit(bad + good, [1] * 60 + [0] * 240)
    score = lambda t: float(model.score(toxicity.evidence([t], model))[0])
    assert min(score(t) for t in ("you idiot", "you IDIOT!!", "an idi.ot", "i d i o t", "worthlesss", "pathe-tic")) >= 0.5
    assert max(score(t) for t in ("", "the rest at sea", "onthe ting", "... !!!")) < 0.5
    kernel = toxicity.dense(["idiot", "idxiot", "reading"], ["idiot"])[:, 0]
    assert kernel[0] == pytest.approx(1) and kernel[0] > kernel[1] > kernel[2]


def test_triples_against_brute_force():
    word = "abcab"
    want: dict = {}
    s = f"\0\0{word}\0"
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                want[s[i], s[j], s[k]] = want.get((s[i], s[j], s[k]), 0) + toxicity.DECAY ** (k - i - 2)
    norm = sum(v * v for v in want.values()) ** 0.5
    _, _, value = toxicity.triples([word])
    assert sorted(value) == pytest.approx(sorted(v / norm for v in want.values()))


def test_classifiers_on_nasty_and_empty_rows(spark, nasty, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nothing = labels.where("false")
    for module in (quality, toxicity):
        assert module.scored(nasty, nothing).count() == nasty.count()
        assert module.scored(empty, labels).count() == 0
        kept = module.scored(nasty.withColumn("_score", F.lit(1)), nothing, keep=True)
        assert kept.columns == [*nasty.columns, "_score"]
    mixed = docs.select("doc_id", "text").union(nasty.select(F.col("doc_id") + 10**6, "text"))
    for module in (quality, toxicity):
        assert module.scored(mixed, labels).where("score BETWEEN 0 AND 1").count() == mixed.count()


def test_components(spark):
    rng = np.random.default_rng(7)
    links = rng.integers(0, 300, (200, 2)).tolist() + [[i, i + 1] for i in range(1000, 1060)] + [[5, 5]]
    union = near_dup.Union()
    for a, b in links:
        union.join(a, b)
    # In one task, and scattered over many.
    for tasks in (1, 7):
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(tasks)).collect()}
        assert got == {x: union.find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_links(spark):
    """A hub that a third of all links lead to, long chains in every task, and stars, with 300,000 links."""
    i = F.col("id")
    a = F.when(i % 3 == 0, i).when(i % 3 == 1, i + 3).otherwise(i - i % 300 + 299)
    b = F.when(i % 3 == 0, F.lit(0)).when(i % 3 == 1, i).otherwise(i)
    rows = components(spark.range(0, 300_000, 1, 8).select(a.alias("a"), b.alias("b")))
    got = rows.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()
    assert [(r.root, r.n) for r in got[:2]] == [(1, 100_001), (0, 100_000)]
    assert sum(r.n for r in got) == rows.select("node").distinct().count()
    assert {r.n for r in got[2:]} == {100}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.quality_stage(spark, docs, SF)
    assert one.columns == docs.columns
    two = corpus_pipeline.toxicity_stage(spark, one, SF)
    three = corpus_pipeline.near_dup_stage(spark, two, SF)
    n = [x.count() for x in (docs, one, two, three)]
    assert n == sorted(n, reverse=True) and n[3] > 0.6 * n[0]
    kept = [r.doc_id for r in three.select("doc_id").collect()]
    assert len(kept) == len(set(kept))
    assert near_dup.classes(three).where("class_size > 1").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dup", "packing"]


def test_stages_on_nasty_and_empty_tables(spark, nasty, empty):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names go through every stage."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert labels.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, nasty, SF)
        assert kept.columns == nasty.columns and kept.count() <= nasty.count() and kept.exceptAll(nasty).count() == 0
        none = stage(spark, empty, SF)
        assert none.columns == empty.columns and none.count() == 0
    packed = corpus_pipeline.packing_stage(spark, nasty, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in nasty.collect()}
    assert corpus_pipeline.packing_stage(spark, empty, SF).count() == 0


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from speechloom.llm.common import shared_dir

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_oracles_run(spark):
    from speechloom.llm.queries import ORACLES

    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLES.items():
        other = con.execute(sql)
        names = [d[0] for d in other.description]
        want = sorted(map(repr, (dict(zip(names, r, strict=True)) for r in other.fetchall())))
        assert sorted(repr({c: r[c] for c in names}) for r in QUERIES[name](spark, SF).collect()) == want


def test_toxicity_fit_is_filled_with_texts_that_fit(spark, monkeypatch):
    """Overlong texts take no place in the sample, whatever their hash."""
    monkeypatch.setattr(toxicity, "FIT_TOXIC", 20)
    monkeypatch.setattr(toxicity, "FIT_CLEAN", 40)
    monkeypatch.setattr(toxicity, "FIT_CHARS", 50)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.extend(zip(texts, toxic, strict=True)))
    docs = spark.createDataFrame([(i, f"text {i} " * (1 if i % 4 else 20)) for i in range(400)], "doc_id long, text string")
    toxicity.fitted(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert all(len(t) <= 50 for t, _ in seen) and [y for _, y in seen].count(1) == 20 and [y for _, y in seen].count(0) == 40


def test_infrequent_insults_among_many_labelled_texts():
    """An insult in 25 of 2500 toxic texts: the fit at its bounds must read all of these."""
    rng = np.random.default_rng(8)
    syllables = ["the", "on", "re", "at", "ing", "ti", "est", "al", "ou", "mar", "sel", "dun"]
    say = lambda n: " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))
    bad = [f"{say(4)} {'zqvurk' if i % 100 == 0 else ('idiot', 'worthless')[i % 2]} {say(4)}." for i in range(2500)]
    good = [f"{say(9)}." for _ in range(5000)]
    n, m = toxicity.FIT_TOXIC, toxicity.FIT_CLEAN
    model = toxicity.fit(bad[-n:] + good[-m:], [1] * min(n, 2500) + [0] * min(m, 5000))
    score = lambda t: float(model.score(toxicity.evidence([t], model))[0])
    assert n >= 2500 and m >= 5000 and score("the zqvurk on") >= 0.5 and score("the rest on") < 0.5
