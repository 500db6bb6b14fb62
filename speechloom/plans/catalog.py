"""The registered queries: each operator applied to whole tables of the test schema.

Documents stand in for segments (file name from the id, duration from the length), with artefacts put in by id so that the
text operators have something to change; labels for decisions, events for ordered signals, conversations for diarized turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechloom.functions import similarity
from speechloom.functions.expr import tokens
from speechloom.functions.numbers import int_to_words, protected_number_words
from speechloom.operators import audio, checks, dataset, ladders, normalise, ordered, polish, review, series
from speechloom.plans import paths
from speechloom.sources import diarization, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_name(doc_id: Column) -> Column:
    return F.concat(F.lit("doc_"), F.lpad(doc_id.cast("string"), 6, "0"), F.lit(".wav"))


def injected(text: Column, doc_id: Column) -> Column:
    """A text with the artefact of its id's class of twelve."""
    kind = doc_id % 12
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    forms = [
        text,
        F.concat(F.lit('{"transcription": "'), flat, F.lit('"}')),
        F.concat(F.lit("[SHOVQIN] "), text),
        F.concat(F.lit("<b>"), text, F.lit("</b>")),
        F.concat(text, F.lit("  12 va 1005 ")),
        F.concat(text, text),
        F.replace(text, F.lit(","), F.lit(",,")),
        F.concat(F.lit("ʻ"), text, F.lit("’")),
        F.concat(F.lit("Привет "), text),
        F.concat(text, F.lit(" 12, 13.5")),
        F.concat(F.lit("bu bu bu "), text),
        F.concat(text, F.lit(" ... mmm")),
    ]
    out = F.when(kind == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        out = out.when(kind == i, form)
    return out


#: Texts that no document holds: one row each beside the documents, under ids below zero.
STUBS = ["", "...", "mmm", "12, 13.5", "[SHOVQIN]", " ", "Привет", "ha bir", "bu bu bu bu bu bu"]


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", file_name(F.col("doc_id")).alias("file_name"), "text", "source", (F.col("n_chars") / 16.0).alias("duration"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whole, with an artefact by its id, and the stubs."""
    rows = recordings(spark, sf_dir).withColumn("text", injected(F.col("text"), F.col("doc_id")))
    stubs = spark.createDataFrame([(-i, t, "stub", 16.0) for i, t in enumerate(STUBS, 1)], "doc_id long, text string, source string, duration double")
    return rows.unionByName(stubs.withColumn("file_name", file_name(F.col("doc_id"))))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each text, and these with a change by id, for operators on pairs of texts."""
    words = tokens(F.lower("text"))
    kind, rest = F.col("doc_id") % 4, lambda at: F.slice("a", F.lit(at), F.size("a"))
    other = F.when(kind == 0, F.col("a")).when(kind == 1, F.reverse("a")).when(kind == 2, rest(3)).otherwise(F.concat(F.slice("a", 1, 5), F.array(F.lit("besh")), rest(7)))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("a")).withColumn("b", other)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with clocks made from text lengths (multiples of 1/16, so sums are exact), some of them odd by id."""
    c = table(spark, sf_dir, "conversations")
    by = Window.partitionBy("conv_id").orderBy("turn")
    d0 = F.length("text") / 16.0
    rows = c.select("conv_id", "turn", "role", "text", d0.alias("d0"), F.sum(d0).over(by).alias("e0"))
    m = F.when(F.col("conv_id") % 5 == 0, 1000.0).otherwise(1.0)
    reset = (F.col("conv_id") % 7 == 3) & (F.col("turn") == 2)
    start = F.when(reset, 0.0).otherwise(F.col("e0") - F.col("d0"))
    end = F.when(reset, F.col("d0")).when((F.col("conv_id") + F.col("turn")) % 13 == 5, F.col("e0") - F.col("d0") + 0.25).otherwise(F.col("e0"))
    text = F.when(F.col("turn") % 4 == 3, "[SHOVQIN]").when((F.col("conv_id") + F.col("turn")) % 11 == 0, "Привет").otherwise(F.col("text"))
    return rows.select(F.col("conv_id").cast("string").alias("record_id"), F.col("turn").alias("pos"), (start * m).alias("start"), (end * m).alias("end"), text.alias("text"), F.col("role").alias("speaker"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_type", "value", (F.row_number().over(by) - 1).alias("at"))


# Diarized recordings.


@query
def diarization_chunks(spark, sf_dir):
    return diarization.chunks(turns(spark, sf_dir)).select("file_name", "transcription", "speaker", "start", "end", "duration", "record_id", "idx", "style", "pipeline")


@query
def diarization_style(spark, sf_dir):
    return diarization.styles(diarization.cleaned(turns(spark, sf_dir)))


@query
def diarization_skip_counts(spark, sf_dir):
    return diarization.skip_counts(turns(spark, sf_dir))


@query
def diarization_plain_chunks(spark, sf_dir):
    return diarization.plain_chunks(turns(spark, sf_dir)).drop("transcription")


@query
def diarization_latin_chunks(spark, sf_dir):
    return diarization.plain_chunks(turns(spark, sf_dir), latin_only=True).drop("transcription")


# Ladders and flags on rows.


@query
def audio_ladder(spark, sf_dir):
    s = segments(spark, sf_dir)
    snr = (F.col("doc_id") % 41 - 1).cast("double")
    silence = (F.col("doc_id") % 100).cast("double")
    kept = ladders.measured_if_kept(F.col("duration"), snr)
    return s.select("doc_id", "duration", kept.alias("snr_score"), F.coalesce(ladders.audio_reason(F.col("duration"), snr, silence), F.lit("ok")).alias("reason_code"))


@query
def text_filter_v1(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", F.coalesce(ladders.text_reason(F.col("text"), ladders.PATH1_TEXT), F.lit("ok")).alias("reason_code"))


@query
def text_filter_v2(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", F.coalesce(ladders.text_reason(F.col("text"), ladders.PATH2_TEXT), F.lit("ok")).alias("reason_code"))


@query
def ready_text_ladder(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.select("doc_id", F.coalesce(ladders.ready_text_reason(F.col("duration"), F.col("text")), F.lit("approved")).alias("reason_code"))


@query
def validity_ladder(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", F.coalesce(ladders.validity_reason(F.col("text"), 3, True), F.lit("ok")).alias("reason_code"))


@query
def repeat_ratio(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", similarity.repeat_ratio(F.col("text")).alias("repeat_ratio"))


@query
def script_flags(spark, sf_dir):
    t = F.col("text")
    return segments(spark, sf_dir).select("doc_id", similarity.mixed_scripts(t).alias("mixed"), ladders.is_non_latin(t).alias("non_latin"), ladders.is_noise(t).alias("noise"), ladders.is_trash(t).alias("trash"), F.bround(similarity.cyrillic_word_ratio(t), 6).alias("cyrillic_ratio"))


@query
def score_status(spark, sf_dir):
    answer = F.when(F.col("doc_id") % 9 == 8, "none").when(F.col("doc_id") % 9 == 7, "").otherwise(F.concat((F.col("doc_id") % 9).cast("string"), F.lit(" of 5")))
    score = ladders.parsed_score(answer)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"), ladders.status_of_score(score).alias("status"), ladders.status_of_score(score, 4, 2).alias("status_strict"))


# Text chains.


@query
def norm_pipeline(spark, sf_dir):
    out = normalise.normalised(segments(spark, sf_dir), "text")
    return out.select("doc_id", F.md5("normalized").alias("text_md5"), F.length("normalized").alias("n_chars"), F.coalesce("drop_reason", F.lit("ok")).alias("drop_reason"))


@query
def int_words(spark, sf_dir):
    n = (F.col("doc_id") * F.col("doc_id") * 7919 + F.col("doc_id") * 31) % 1_000_000_000_000
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), int_to_words(n).alias("words"), int_to_words(F.col("doc_id")).alias("id_words"))


@query
def html_strip(spark, sf_dir):
    text = F.regexp_replace("html", "<[^>]+>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).alias("n_chars"))


@query
def polished_text(spark, sf_dir):
    out = polish.polished(segments(spark, sf_dir), "text")
    return out.select("doc_id", "polished")


@query
def protected_numbers(spark, sf_dir):
    text = F.concat(F.lit("tel +998 90 123-45-67, "), F.col("doc_id").cast("string"), F.lit("-chi kun 14.03.2024 14:30 da 1995 yil 5.5 va "), (F.col("doc_id") * 977).cast("string"), F.lit(" ta"))
    return table(spark, sf_dir, "documents").select("doc_id", protected_number_words(text).alias("text"))


# Similarity.


@query
def lcs_run_ratio(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("doc_id", similarity.order_ratios(F.col("a"), F.col("b")).alias("r"), F.bround(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))
    return rows.select("doc_id", F.bround("r.lcs", 6).alias("lcs"), F.bround("r.run", 6).alias("run"), "jaccard")


@query
def dedup_half(spark, sf_dir):
    text = F.concat_ws(" ", F.array_join("a", " "), F.array_join("b", " "))
    return pairs(spark, sf_dir).select("doc_id", similarity.dedup_half(text).alias("text"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's tokens, whole, and these with a change by turn."""
    kind, rest = (F.col("conv_id") + F.col("turn")) % 4, lambda at: F.slice("a", F.lit(at), F.size("a"))
    other = F.when(kind == 0, F.col("a")).when(kind == 1, F.reverse("a")).when(kind == 2, rest(3)).otherwise(F.concat(F.slice("a", 1, 5), F.array(F.lit("besh")), rest(7)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens(F.lower("text")).alias("a")).withColumn("b", other)


@query
def change_ratios(spark, sf_dir):
    a, b = F.array_join("a", " "), F.array_join("b", " ")
    rows = turn_pairs(spark, sf_dir).select("conv_id", "turn", similarity.change_ratio(a, b).alias("ratio"), similarity.simple_change_ratio(a, b).alias("simple_ratio"))
    return rows.withColumn("status", ladders.status_of_change(F.col("ratio")))


@query
def word_error_rate(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(F.array_join("a", " ").alias("reference"), F.array_join("b", " ").alias("guess"))
    out = audio.word_error_rate(rows, "reference", "guess")
    return out.select(F.bround("wer_ortho", 4).alias("wer_ortho"), F.bround("wer", 4).alias("wer"))


# Runs, counts, sinks.


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a status, as a run would leave them."""
    s = segments(spark, sf_dir)
    reason = F.coalesce(ladders.audio_reason(F.col("duration"), F.lit(-1.0), F.lit(0.0), ladders.AudioLimits(3.0, 400.0)), ladders.text_reason(F.col("text")))
    status = F.when(reason.isNotNull(), "filtered").when(F.col("doc_id") % 5 == 0, "pending").when(F.col("doc_id") % 7 == 0, "rejected").otherwise("approved")
    path = F.when(F.col("doc_id") % 2 == 0, "aisha_stt").otherwise("gemini_stt")
    return s.select("doc_id", "file_name", F.col("text").alias("transcription"), "duration", "source", status.alias("status"), reason.alias("reason"), path.alias("pipeline"))


@query
def status_counts(spark, sf_dir):
    return paths.status_counts(results(spark, sf_dir))


@query
def export_projection(spark, sf_dir):
    kept = results(spark, sf_dir).where(ladders.exportable(F.col("status"), F.col("transcription")))
    return kept.select("file_name", F.md5("transcription").alias("text_md5"), "duration", "source", "status", F.coalesce("reason", F.lit("")).alias("reason"))


@query
def export_file_plan(spark, sf_dir):
    return files.file_plan(results(spark, sf_dir), "/out")


@query
def export_json_lines(spark, sf_dir):
    return files.json_lines(results(spark, sf_dir), ["file_name", "duration", "status", "reason"])


@query
def hours_total(spark, sf_dir):
    hours = F.sum(F.when(F.col("doc_id") % 50 != 0, F.col("duration"))) / 3600
    return recordings(spark, sf_dir).agg(F.bround(hours, 6).alias("hours"), F.bround(hours * 0.25, 6).alias("disk_gb"))


@query
def path1_run(spark, sf_dir):
    raw = segments(spark, sf_dir).select("doc_id", "file_name", (F.col("duration") / 4).alias("duration"), F.lit(-1.0).alias("snr_score"), F.lit(0.0).alias("silence_ratio"), F.col("text").alias("raw_text"))
    done = paths.normalised_results(paths.path1(raw))
    return done.select("doc_id", "status", "reason", "change_ratio", "transcription", "pipeline")


@query
def path2_run(spark, sf_dir):
    rows = segments(spark, sf_dir).select("doc_id", (F.col("duration") / 4).alias("duration"), (F.col("doc_id") % 37 - 1).cast("double").alias("snr_score"), (F.col("doc_id") % 101).cast("double").alias("silence_ratio"), F.col("text").alias("raw_text"), F.pmod("doc_id", F.lit(6)).cast("string").alias("score_answer"))
    return paths.path2(rows).select("doc_id", "status", F.coalesce("reason", F.lit("ok")).alias("reason"), "gemini_score")


# Sets of rows.


@query
def manifest_anti_join(spark, sf_dir):
    name = F.when(F.col("doc_id") % 50 == 0, F.lit(None)).when(F.col("doc_id") % 50 == 1, F.lit(" ")).otherwise(F.concat(file_name(F.col("doc_id")), F.when(F.col("doc_id") % 3 == 0, " ").otherwise("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", name.alias("file_name"))
    used = table(spark, sf_dir, "benchmark").select(file_name(F.col("item_id")).alias("file_name"))
    return dataset.not_in_manifest(docs, dataset.manifest(used))


@query
def manifest_anti_join_named(spark, sf_dir):
    name = F.when(F.col("doc_id") % 50 == 0, F.lit(None)).otherwise(file_name(F.col("doc_id")))
    docs = table(spark, sf_dir, "documents").select("doc_id", name.alias("file_name"))
    used = table(spark, sf_dir, "benchmark").select(file_name(F.col("item_id")).alias("file_name"))
    return dataset.not_in_manifest(docs, used, keep_unnamed=False)


@query
def audio_semi_join(spark, sf_dir):
    have = table(spark, sf_dir, "labels").select(file_name(F.col("doc_id")).alias("file_name"))
    return dataset.with_file(recordings(spark, sf_dir).select("doc_id", "file_name", "duration"), have)


@query
def audio_missing(spark, sf_dir):
    have = table(spark, sf_dir, "labels").select(file_name(F.col("doc_id")).alias("file_name"))
    return dataset.without_file(recordings(spark, sf_dir).select("file_name"), have).agg(F.count("*").alias("missing"))


@query
def source_lookup(spark, sf_dir):
    out = recordings(spark, sf_dir).select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "augmented_").otherwise("aug_"), "file_name").alias("out_name"))
    waves = table(spark, sf_dir, "labels").select(files.stem(file_name(F.col("doc_id"))).alias("base"), F.lit(True).alias("found")).distinct()
    return out.withColumn("base", files.stem(files.without_prefix(F.col("out_name")))).join(waves, "base", "left").select("doc_id", "base", F.coalesce("found", F.lit(False)).alias("found"))


@query
def first_location(spark, sf_dir):
    base = recordings(spark, sf_dir).select("doc_id", "file_name")
    places = [base.where(F.col("doc_id") % (i + 2) == 0).select("file_name", F.concat(F.lit(f"/place{i}/"), "file_name").alias("path")) for i in range(4)]
    return dataset.first_found(base, "file_name", *places)


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    first = labels.select(file_name(F.col("doc_id")).alias("file_name"), F.lit("pending").alias("decision"), F.lit(None).cast("string").alias("edited_text"), F.lit(0).alias("seq"))
    edit = F.when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("edit "), F.col("doc_id").cast("string")))
    decision = F.when(F.col("toxic") == 1, "rejected").when(edit.isNotNull(), "edited").when(F.col("quality") == 1, "approved").otherwise("pending")
    return first.union(labels.select(file_name(F.col("doc_id")), decision, edit, F.lit(1)))


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("doc_id", "file_name", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("transcription"), F.col("text").alias("original_text"))
    return review.merged(s, review.decided(decision_log(spark, sf_dir)))


@query
def review_merge(spark, sf_dir):
    return review.saved(reviewed(spark, sf_dir)).select("doc_id", "decision", F.md5("text").alias("text_md5"))


@query
def review_stats(spark, sf_dir):
    return review.stats(reviewed(spark, sf_dir))


@query
def review_meta(spark, sf_dir):
    return recordings(spark, sf_dir).withColumn("note", F.when(F.col("doc_id") % 3 == 0, " ").when(F.col("doc_id") % 3 == 1, "seen")).select("doc_id", F.to_json(review.meta("source", "note")).alias("meta"))


def aug_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = recordings(spark, sf_dir).select("doc_id", "file_name", (F.col("duration") / 8).alias("duration"))
    i = F.col("doc_id")
    return s.withColumn("aug_status", dataset.augment_status(i, i % 97 != 0, F.when(i % 89 == 0, 0.0).otherwise(F.col("duration")), i % 83 == 0))


@query
def aug_status_plan(spark, sf_dir):
    return aug_plan(spark, sf_dir).select("doc_id", "aug_status")


@query
def aug_status_histogram(spark, sf_dir):
    return aug_plan(spark, sf_dir).groupBy("aug_status").agg(F.count("*").alias("n"))


@query
def aug_distribution_check(spark, sf_dir):
    return checks.status_distribution(aug_plan(spark, sf_dir), 0.5, 0.25)


@query
def aug_usable(spark, sf_dir):
    plan = aug_plan(spark, sf_dir)
    n = lambda df, what: df.agg(F.lit(what).alias("kept"), F.count("*").alias("n"))
    return n(dataset.only_usable(plan), "not_failed").union(n(dataset.only_usable(plan, strict=True), "augmented"))


@query
def schema_check(spark, sf_dir):
    i = F.col("doc_id")
    audio_col = F.when(i % 61 != 0, F.struct(F.when(i % 5 != 0, F.col("file_name")).alias("path"), F.when(i % 3 != 0, F.encode("file_name", "UTF-8")).alias("bytes")))
    rows = aug_plan(spark, sf_dir).select("doc_id", audio_col.alias("audio"), F.when(i % 53 != 0, F.lit("x")).alias("text"), "duration", F.when(i % 47 == 0, " ").otherwise(F.col("file_name")).alias("file_name"), "aug_status")
    return checks.schema_issues(rows)


@query
def audio_changed_check(spark, sf_dir):
    i = F.col("doc_id")
    rms = (F.lit(1.0) + i % 16) / 16
    rows = aug_plan(spark, sf_dir).select("aug_status", (i % 11 != 0).alias("found"), F.when((i % 11 != 0) & (i % 23 != 1), rms).alias("rms_in"), F.when(i % 4 == 0, rms).otherwise(rms * 2).alias("rms_out"), F.lit(100).alias("n_in"), F.when(i % 8 == 0, 99).otherwise(100).alias("n_out"))
    return checks.audio_changed(rows)


@query
def noise_corpus_check(spark, sf_dir):
    i = F.col("doc_id")
    folder = F.when(i % 5 == 0, "noise").when(i % 5 == 1, "music").when(i % 5 == 2, "speech").when(i % 5 == 3, "other").otherwise("noise/_quarantine")
    listing = table(spark, sf_dir, "documents").select(F.concat(F.lit("/corpus/"), folder, F.lit("/"), "source", F.when(i % 7 == 0, ".txt").otherwise(".WAV")).alias("path"))
    return checks.noise_corpus(listing, 50)


@query
def noise_quarantine_plan(spark, sf_dir):
    return checks.noise_quarantine(recordings(spark, sf_dir).select(F.concat(F.lit("/corpus/noise/"), "file_name").alias("path"), F.when(F.col("doc_id") % 10 != 0, F.col("duration") / 64).alias("duration")))


@query
def checks_verdict(spark, sf_dir):
    one = aug_distribution_check(spark, sf_dir).select("passed", F.lit(False).alias("critical"))
    two = audio_changed_check(spark, sf_dir).select("passed", "critical")
    return checks.verdict(one.union(two))


@query
def dup_names(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 700).cast("string")).alias("file_name"))
    return names.groupBy("file_name").agg(F.count("*").alias("n")).where("n > 1")


@query
def last_by_name(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 700).cast("string")).alias("file_name"), "doc_id", "source")
    return dataset.last_rows(rows.select("file_name", "source", "doc_id"), "file_name", "doc_id")


@query
def shuffle_head(spark, sf_dir):
    return dataset.shuffled_head(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


@query
def first_rows(spark, sf_dir):
    return dataset.head(recordings(spark, sf_dir).select("doc_id", "file_name"), "file_name", 100)


@query
def split_assign(spark, sf_dir):
    return dataset.train_test(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.01)


@query
def union_filter_counts(spark, sf_dir):
    s = segments(spark, sf_dir).select("doc_id", "source", F.size(tokens(F.col("text"))).alias("labels"))
    both = dataset.concatenated(s, s.where("doc_id % 2 = 0"))
    return both.groupBy("source").agg(F.count("*").alias("before"), F.count_if(F.col("labels") < 440).alias("after"))


@query
def test_and_continue(spark, sf_dir):
    """The first hundred and the rest by manifest are the whole set again."""
    s = recordings(spark, sf_dir).select("doc_id", "file_name")
    test = dataset.head(s, "file_name", 100)
    rest = dataset.not_in_manifest(s, dataset.manifest(test))
    part = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    return part(test, "test").union(part(rest, "continue")).union(part(dataset.concatenated(test, rest), "all"))


@query
def name_functions(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    address = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://hub.example/datasets/org"), i, F.lit("/name/viewer/default?x=1"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" org"), i, F.lit("/name/tree/main "))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("org"), i, F.lit("/name"))).otherwise(F.concat(F.lit("datasets/org"), i, F.lit("/name/")))
    rec = F.concat(F.lit('a/b:"'), i, F.lit("?"))
    return table(spark, sf_dir, "documents").select("doc_id", files.dataset_name(address).alias("dataset"), diarization.record_id(F.when(F.col("doc_id") % 2 == 0, rec), F.col("doc_id")).alias("record"), files.clean_path(F.concat(F.lit(' "/x/'), i, F.lit("' "))).alias("path"), files.stem(F.concat(F.lit("/a/b"), i, F.lit(".x.wav"))).alias("stem"))


@query
def record_urls(spark, sf_dir):
    pick = lambda *names: F.to_json(F.named_struct(*[x for n in names for x in (F.lit(n), F.concat(F.lit(n + "_"), F.col("doc_id").cast("string")))]))
    record = F.when(F.col("doc_id") % 3 == 0, pick("link", "audio_url")).when(F.col("doc_id") % 3 == 1, pick("path", "audio")).otherwise(pick("name"))
    return table(spark, sf_dir, "documents").select("doc_id", files.url_of(record).alias("url"))


# Ordered signals.


@query
def frame_rms_snr(spark, sf_dir):
    frames = series.framed_rms(signal(spark, sf_dir).select("user_id", "at", "value"), "user_id", "at", "value", 8, 4)
    return series.snr_db(frames, "user_id").select("user_id", "frames", F.bround("signal", 4).alias("signal"), F.bround("noise", 4).alias("noise"))


@query
def silent_bins(spark, sf_dir):
    return series.silent_share(signal(spark, sf_dir), "user_id", "at", "value", 4, 40.0)


@query
def run_coherence(spark, sf_dir):
    rows = signal(spark, sf_dir).where("event_type <> 'error'").withColumn("seconds", F.lit(0.75))
    return series.coherent(rows, "user_id", ["at"], "event_type", "seconds").select("user_id", "segments", "runs", F.bround("mean_run", 6).alias("mean_run"), "coherent")


@query
def value_histogram(spark, sf_dir):
    return series.histogram(signal(spark, sf_dir), "event_type", "value")


@query
def histogram_peaks(spark, sf_dir):
    return series.bimodal(series.histogram(signal(spark, sf_dir), "event_type", "value"), "event_type")


@query
def value_percentiles(spark, sf_dir):
    rows, shares = signal(spark, sf_dir), {"p10": 0.1, "p25": 0.25, "p35": 0.35, "p50": 0.5}
    found = ordered.percentiles(rows, "event_type", "value", shares).select("event_type", *[F.bround(n, 6).alias(n) for n in shares])
    return found.join(rows.groupBy("event_type").agg(F.bround(F.stddev_pop("value"), 4).alias("sd")), "event_type")


@query
def zscore_cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("recording"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    z = series.standardised(rows, "recording", "vec_id", "v")
    return series.cosine_distances(z, "recording", "vec_id", "z").select("recording", "a", "b", F.bround("distance", 4).alias("distance"))


@query
def speaker_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("r"), F.floor(F.col("vec_id") / 8).cast("string")).alias("file_name"), F.col("vec_id").alias("idx"), F.lit(0.75).alias("seconds"), "embedding")
    return audio.speaker_tags(rows)


@query
def music_scores(spark, sf_dir):
    i = F.col("doc_id")
    f = F.array((i % 10) / 10, (i % 7) / 7, (i % 5) / 4, (i % 30).cast("double"), (i % 3) / 2)
    score = audio.music_score(f)
    vote = audio.music_vote(F.array(score, score / 2, score * 1.2))
    return table(spark, sf_dir, "documents").select("doc_id", F.bround(score, 6).alias("score"), vote.alias("music"))


@query
def noise_levels(spark, sf_dir):
    low, high = dataset.noise_level_snr(F.col("doc_id") % 131 - 10)
    return table(spark, sf_dir, "documents").select("doc_id", F.bround(low, 4).alias("snr_low"), F.bround(high, 4).alias("snr_high"))
