"""Registered queries of single steps and smaller operators, each with its DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.functions import similarity
from speechloom.functions.expr import tokens
from speechloom.operators import audio, checks, dataset, ladders, normalise, polish, review
from speechloom.plans import catalog, paths
from speechloom.plans.catalog import Query, recordings, results, segments, table
from speechloom.plans.catalog_sql import INJ, KEEP, RESULTS, SP, W, blank, fname, rewrite, strip, toks, words
from speechloom.sources import files
from speechloom.sources.shared import scratch

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Steps of the polisher, each on its own over whole texts.

_EDGE = f"(^|[^{W[1:-1]}])"
_END = f"($|[^{W[1:-1]}])"


def alone(t: str, body: str, before: str = _EDGE) -> str:
    """Matches that stand between other characters go. A mark between two of them serves both, so it takes two passes."""
    once = lambda x: f"regexp_replace({x}, '(?i){before}(?:{body}){_END}', '\\1\\2', 'g')"
    return once(once(t))


_JSON = r"(?s)\{[\"'']transcription[\"'']\s*:\s*[\"''](.+?)[\"'']\}|\{[^}]{0,200}\}"
_STUTTER = f"""(SELECT array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN again[i] AND (again[i - 1] OR again[i + 1]) THEN '' ELSE s[i] || w[i] END), '') || s[len(w) + 1]
  FROM (SELECT w, s, list_transform(range(1, len(w) + 1), lambda i: i > 1 AND length(w[i]) >= 2 AND lower(w[i]) = lower(w[i - 1]) AND regexp_full_match(s[i], '{SP}+')) AS again FROM (SELECT regexp_extract_all(t, '{W}+') AS w, string_split_regex(t, '{W}+') AS s)))"""
POLISH_SQL = {
    "json": strip(rewrite("t", _JSON, lambda m: strip(f"regexp_extract({m}, '{_JSON}', 1)"))),
    "tags": strip(r"regexp_replace(t, '(?i)\[\s*(?:MUSIQA_BOR|KO''P_OVOZ|TUSHUNARSIZ|SHOVQIN|GUDOK|MUSIC|NOISE)\s*\]', '', 'g')"),
    "html": strip("regexp_replace(t, '</?[a-zA-Z][^>]{0,60}>', '', 'g')"),
    "apostrophe": "replace(replace(replace(replace(t, 'ʻ', ''''), 'ʼ', ''''), '`', ''''), '´', '''')",
    "fillers_en": alone("t", "mm+|uh+|ah+|eh+|um+|hmm+|hm+|ugh+|er+|eeh+"),
    "vowels": alone(alone("t", "a{3,}|e{3,}|i{3,}|o{3,}|u{3,}|y{3,}"), "[aeiouy]h{3,}"),
    "fillers_ru": alone("t", "ну|вот|эм+|э-э+|короче|значит|ладно"),
    "marks": strip(f"regexp_replace(regexp_replace(regexp_replace(t, ',{{2,}}', ',', 'g'), '({W})-{SP}+({W})', '\\1-\\2', 'g'), ' {{2,}}', ' ', 'g')"),
    "first_upper": "upper(substring(t, 1, 1)) || substring(t, 2)",
    "sentences": rewrite("t", f"[.!?]{SP}+[a-zA-Z]", lambda m: f"upper({m})"),
}


def marked(spark, sf_dir):
    """Whole texts, with what each step looks for put in by id."""
    extra = F.array(*[F.lit(x) for x in MARKS])
    return segments(spark, sf_dir).where("doc_id >= 0").select("doc_id", F.concat(F.get(extra, (F.col("doc_id") % len(MARKS)).cast("int")), F.lit(" "), "text").alias("t"))


MARKS = ["uh so hmm, er", "aaa ooo ehhh", "he-he xo'sh", "ну вот так", "salom salom salom ha ha", "a- b", "[ noise ]", "{'transcription': ' bir '}", "`a´", "<i>x</i>", "mm mm mm ta", "Ha ha HA ha ok"]
MARKED_SQL = f"""WITH {INJ}, marked AS (SELECT doc_id, [{', '.join("'" + m.replace("'", "''") + "'" for m in MARKS)}][doc_id % {len(MARKS)} + 1] || ' ' || text AS t FROM inj WHERE doc_id >= 0)"""


@query(f"{MARKED_SQL} SELECT doc_id, {', '.join(f'md5({e}) AS {n}' for n, e in POLISH_SQL.items())} FROM marked")
def polish_steps(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", *[F.md5(polish.STEPS[n](F.col("t"))).alias(n) for n in POLISH_SQL])


_UZ = alone(alone("t", "he-?he|ha-?ha|i-?i|o-?o|a-?a"), "xo''sh", "(^|[^a-zA-Z''])")


@query(f"{MARKED_SQL} SELECT doc_id, md5({_UZ}) AS fillers_uz, md5(CASE WHEN regexp_matches(t, '{W}') THEN {_STUTTER} ELSE t END) AS stutter FROM marked")
def polish_words(spark, sf_dir):
    """Interjections with a hyphen or an apostrophe, and words said three times or more."""
    return marked(spark, sf_dir).select("doc_id", F.md5(polish.STEPS["fillers_uz"](F.col("t"))).alias("fillers_uz"), F.md5(polish.STEPS["stutter"](F.col("t"))).alias("stutter"))


_ORD = "['birinchi', 'ikkinchi', 'uchinchi', 'to''rtinchi', 'beshinchi', 'oltinchi', 'yettinchi', 'sakkizinchi', 'to''qqizinchi', 'o''ninchi']"


@query(
    f"""SELECT doc_id, 'tel +998 90 123-45-67, ' || CASE WHEN doc_id BETWEEN 1500 AND 2049 THEN doc_id || '-chi' WHEN doc_id BETWEEN 1 AND 10 THEN {_ORD}[doc_id] ELSE {words('doc_id')} || '-nchi' END
      || ' kun 14.03.2024 14:30 da 1995 yil 5.5 va ' || CASE WHEN n BETWEEN 1500 AND 2049 OR n >= 10000000 THEN CAST(n AS VARCHAR) ELSE {words('n')} END || ' ta' AS text FROM (SELECT doc_id, doc_id * 977 AS n FROM documents)"""
)
def protected_numbers(spark, sf_dir):
    return catalog.protected_numbers(spark, sf_dir)


_OFF = {
    "broken_hyphen": f"regexp_replace(t, '({W})-{SP}+({W})', '\\1-\\2', 'g')",
    "dash": "replace(t, ' - ', ' — ')",
    "ellipsis": "replace(t, '...', '…')",
    "punct": "CASE WHEN right(t, 1) IN ('', '.', '!', '?', '…') THEN t ELSE t || '.' END",
}


@query(
    f"WITH {INJ}, x AS (SELECT doc_id, text AS raw, CASE doc_id % 3 WHEN 0 THEN text || ' bir - ikki... uch' WHEN 1 THEN text || ' yarim- \n ta' ELSE text END AS t FROM inj) SELECT doc_id, "
    + ", ".join(f"md5(CASE WHEN {blank('t')} THEN t ELSE {e} END) AS {n}" for n, e in _OFF.items())
    + " FROM x"
)
def norm_off_steps(spark, sf_dir):
    """The switches that are off by default, each alone."""
    tail = F.when(F.col("doc_id") % 3 == 0, " bir - ikki... uch").when(F.col("doc_id") % 3 == 1, " yarim- \n ta").otherwise("")
    none = dict.fromkeys(normalise.Normaliser.__dataclass_fields__, False)
    rows = segments(spark, sf_dir).select("doc_id", F.concat("text", tail).alias("t"))
    return rows.select("doc_id", *[F.md5(normalise.normalised_text(F.col("t"), normalise.Normaliser(**none | {n: True}))["t"]).alias(n) for n in _OFF])


# Order of tokens, on the whole texts of the benchmark.


def item_pairs(spark, sf_dir):
    kind, rest = F.col("item_id") % 4, lambda at: F.slice("a", F.lit(at), F.size("a"))
    other = F.when(kind == 0, F.col("a")).when(kind == 1, F.reverse("a")).when(kind == 2, rest(3)).otherwise(F.concat(F.slice("a", 1, 5), F.array(F.lit("besh")), rest(7)))
    return table(spark, sf_dir, "benchmark").select("item_id", tokens(F.lower("text")).alias("a")).withColumn("b", other)


ITEMS = f"""items AS (SELECT item_id, {toks('lower(text)')} AS a FROM benchmark), item_pairs AS (
  SELECT item_id, a, CASE item_id % 4 WHEN 0 THEN a WHEN 1 THEN list_reverse(a) WHEN 2 THEN a[3:] ELSE list_concat(list_concat(a[1:5], ['besh']), a[7:]) END AS b FROM items
)"""
_CLEAN = "list_filter(list_transform({0}, lambda w: lower(regexp_replace(w, '[.,!?;:''\"«»\\-]+', '', 'g'))), lambda w: w <> '')"


def order_sql(rows: str) -> str:
    """lcs (item_id, lcs) and run (item_id, run) over a table of (item_id, a, b): a row of the full table at a time."""
    return f"""steps AS (
  SELECT item_id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: CAST(0 AS BIGINT)) AS best FROM {rows}
  UNION ALL
  SELECT item_id, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: greatest(best[j], coalesce(list_max(list_transform(list_filter(range(2, j + 1), lambda k: b[k - 1] = a[i + 1]), lambda k: best[k - 1] + 1)), 0)))
  FROM steps WHERE i < len(a)
), lcs AS (SELECT item_id, best[len(b) + 1] AS lcs FROM steps WHERE i = len(a)), cells AS (
  SELECT item_id, i, j FROM (SELECT item_id, a, b, i, unnest(range(1, len(b) + 1)) AS j FROM (SELECT item_id, a, b, unnest(range(1, len(a) + 1)) AS i FROM {rows})) WHERE a[i] = b[j]
), run AS (
  SELECT item_id, max(n) AS run FROM (SELECT item_id, count(*) AS n FROM (SELECT item_id, i - j AS d, i - row_number() OVER (PARTITION BY item_id, i - j ORDER BY i) AS g FROM cells) GROUP BY item_id, d, g) GROUP BY item_id
)"""


@query(
    f"""WITH RECURSIVE {ITEMS}, {order_sql('item_pairs')} SELECT p.item_id, round_even(coalesce(lcs, 0) / greatest(len(a), len(b), 1)::DOUBLE, 6) AS lcs, round_even(coalesce(run, 0) / greatest(len(a), len(b), 1)::DOUBLE, 6) AS run,
      round_even(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1)::DOUBLE, 6) AS jaccard FROM item_pairs p LEFT JOIN lcs USING (item_id) LEFT JOIN run USING (item_id)"""
)
def item_order_ratios(spark, sf_dir):
    rows = item_pairs(spark, sf_dir).select("item_id", similarity.order_ratios(F.col("a"), F.col("b")).alias("r"), F.bround(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))
    return rows.select("item_id", F.bround("r.lcs", 6).alias("lcs"), F.bround("r.run", 6).alias("run"), "jaccard")


@query(
    f"""WITH RECURSIVE {ITEMS}, said AS (SELECT item_id, array_to_string(list_concat(a, b), ' ') AS text, list_concat(a, b) AS w FROM item_pairs), halves AS (
      SELECT item_id, text, w[1:len(w) // 2] AS first, {_CLEAN.format('w[1:len(w) // 2]')} AS a, {_CLEAN.format('w[len(w) // 2 + 1:]')} AS b, len(w) // 2 AS n FROM said), {order_sql('halves')}
      SELECT item_id, CASE WHEN n >= 4 AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1)::DOUBLE >= 0.82 AND (a = b OR lcs / greatest(len(a), len(b))::DOUBLE >= 0.70 AND run / greatest(len(a), len(b))::DOUBLE >= 0.40)
        THEN array_to_string(first, ' ') ELSE text END AS text FROM halves LEFT JOIN lcs USING (item_id) LEFT JOIN run USING (item_id)"""
)
def item_halves(spark, sf_dir):
    text = F.concat_ws(" ", F.array_join("a", " "), F.array_join("b", " "))
    return item_pairs(spark, sf_dir).select("item_id", similarity.dedup_half(text).alias("text"))


def edits_sql(rows: str, name: str) -> str:
    """(item_id, edits) over (item_id, a, b), likewise."""
    return f"""{name}_steps AS (
  SELECT item_id, a, b, 0 AS i, range(0, len(b) + 1) AS cost FROM {rows}
  UNION ALL
  SELECT item_id, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: CASE WHEN k = 1 THEN i + 1 ELSE least(cost[k] + 1, cost[k - 1] + CASE WHEN b[k - 1] = a[i + 1] THEN 0 ELSE 1 END) END + j - k)))
  FROM {name}_steps WHERE i < len(a)
), {name} AS (SELECT len(a) AS n, cost[len(b) + 1] AS e FROM {name}_steps WHERE i = len(a))"""


_PLAIN = "list_filter(string_split_regex(trim(regexp_replace(array_to_string({0}, ' '), '[^\\p{{L}}\\p{{N}}_\\s'']+', '', 'g')), '\\s+'), lambda w: w <> '')"


@query(
    f"""WITH RECURSIVE {ITEMS}, told AS (SELECT * FROM item_pairs WHERE len(a) > 0), plain AS (SELECT item_id, {_PLAIN.format('a')} AS a, {_PLAIN.format('b')} AS b FROM told), {edits_sql('told', 'x')}, {edits_sql('plain', 'y')}
      SELECT (SELECT round_even(sum(e) * 100 / sum(n)::DOUBLE, 4) FROM x) AS wer_ortho, (SELECT round_even(sum(e) * 100 / sum(n)::DOUBLE, 4) FROM y WHERE n > 0) AS wer"""
)
def item_error_rate(spark, sf_dir):
    rows = item_pairs(spark, sf_dir).select(F.array_join("a", " ").alias("reference"), F.array_join("b", " ").alias("guess"))
    out = audio.word_error_rate(rows, "reference", "guess")
    return out.select(F.bround("wer_ortho", 4).alias("wer_ortho"), F.bround("wer", 4).alias("wer"))


# Rows, reports and sinks.


@query(f"WITH {INJ} SELECT doc_id, len({toks('text')}) AS n FROM inj WHERE len({toks('text')}) < 440")
def short_labels(spark, sf_dir):
    rows = segments(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("labels"))
    return dataset.short_labels(rows).select("doc_id", F.size("labels").cast("long").alias("n"))


@query(f"WITH {INJ} SELECT file_name, md5(text) AS text_md5 FROM inj")
def required_columns(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumnRenamed("text", "transcription")
    return dataset.required_columns(rows, "file_name", "text").select("file_name", F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id, {fname('doc_id')} AS file_name FROM documents WHERE doc_id % 50 > 1 AND doc_id IN (SELECT doc_id FROM labels)")
def base_build(spark, sf_dir):
    """Named rows whose file is there."""
    name = F.when(F.col("doc_id") % 50 == 0, F.lit(None)).when(F.col("doc_id") % 50 == 1, F.lit(" ")).otherwise(F.col("file_name"))
    have = table(spark, sf_dir, "labels").select(catalog.file_name(F.col("doc_id")).alias("file_name"))
    return dataset.base_rows(recordings(spark, sf_dir).select("doc_id", name.alias("file_name")), have)


@query(
    """WITH d AS (SELECT doc_id, n_chars / 64.0 AS d, CAST(doc_id % 41 - 1 AS DOUBLE) AS snr, CAST(doc_id % 100 AS DOUBLE) AS sil FROM documents)
      SELECT doc_id, CASE WHEN d < 3 THEN 'too short (' || printf('%.1f', round_even(d, 1)) || ' s < 3 s)' WHEN d > 30 THEN 'too long (' || printf('%.1f', round_even(d, 1)) || ' s > 30 s)'
        WHEN snr >= 0 AND snr < 15 THEN 'low SNR (' || printf('%.1f', snr) || ' dB < 15 dB)' WHEN sil > 80 THEN 'mostly silence (' || printf('%.0f', sil) || '% > 80%)' END AS reason FROM d"""
)
def reason_figures(spark, sf_dir):
    i = F.col("doc_id")
    return recordings(spark, sf_dir).select("doc_id", ladders.reason_with_figures(F.col("duration") / 4, (i % 41 - 1).cast("double"), (i % 100).cast("double")).alias("reason"))


@query(f"WITH {INJ} SELECT doc_id, CASE WHEN contains(t, '[TUSHUNARSIZ]') THEN 'TUSHUNARSIZ' ELSE '' END AS tags FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' [TUSHUNARSIZ] .' ELSE text || ' [tushunarsiz]' END AS t FROM inj)")
def answer_tags(spark, sf_dir):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " [TUSHUNARSIZ] .").otherwise(" [tushunarsiz]"))
    return segments(spark, sf_dir).select("doc_id", F.array_join(ladders.answer_tags(text), ",").alias("tags"))


@query(f"WITH {RESULTS}, c AS (SELECT pipeline, count(*) AS total, count(*) FILTER (status = 'approved') AS a, count(*) FILTER (status = 'pending') AS p, count(*) FILTER (status = 'rejected') AS r, count(*) FILTER (status = 'filtered') AS f, count(*) FILTER ({KEEP}) AS s FROM results GROUP BY 1) SELECT '[' || string_agg('{{\"pipeline\":\"' || pipeline || '\",\"total\":' || total || ',\"approved\":' || a || ',\"pending\":' || p || ',\"rejected\":' || r || ',\"filtered\":' || f || ',\"saved\":' || s || '}}', ',' ORDER BY pipeline) || ']' AS report FROM c")
def run_report(spark, sf_dir):
    return paths.run_report(results(spark, sf_dir))


@query(f"WITH {RESULTS} SELECT '{{\"file_name\":\"' || file_name || '\",\"duration\":' || CAST(duration AS DOUBLE) || ',\"status\":\"' || status || '\"' || CASE WHEN reason IS NOT NULL THEN ',\"reason\":\"' || reason || '\"' ELSE '' END || '}}' AS line FROM results")
def json_lines(spark, sf_dir):
    return files.json_lines(results(spark, sf_dir), ["file_name", "duration", "status", "reason"])


@query("SELECT doc_id, '{\"source\":\"' || source || '\"' || CASE WHEN doc_id % 3 = 1 THEN ',\"note\":\"seen\"' ELSE '' END || '}' AS meta FROM documents")
def review_meta(spark, sf_dir):
    return catalog.review_meta(spark, sf_dir)


@query("SELECT doc_id, greatest(0, least(9, (doc_id % 12) - 1 + (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END))) AS up, greatest(0, least(9, doc_id % 12 - 1)) AS down FROM documents")
def review_cursor(spark, sf_dir):
    at = F.col("doc_id") % 12
    down = review.cursor(at, -1, F.lit(10))
    up = F.when(F.col("doc_id") % 2 == 0, review.cursor(at, 0, F.lit(10))).otherwise(down)
    return table(spark, sf_dir, "documents").select("doc_id", up.alias("up"), down.alias("down"))


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 60")
def log_tail(spark, sf_dir):
    return dataset.tail(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 60)


@query("SELECT max(json) FILTER (seq = last) AS json FROM (SELECT event_id AS seq, '{\"n\":' || event_id || '}' AS json, max(event_id) OVER () AS last FROM events WHERE event_id % 7 = 0)")
def log_result(spark, sf_dir):
    """The last of many marked lines."""
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('done RESULT_JSON: {"n":'), F.col("event_id").cast("string"), F.lit("} "))).otherwise("working")
    return files.log_result(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), line.alias("line")))


@query(f"SELECT doc_id, {fname('doc_id')} AS file_name FROM documents ORDER BY file_name OFFSET 100")
def resume_slice(spark, sf_dir):
    return dataset.resumed(recordings(spark, sf_dir).select("doc_id", "file_name"), "file_name", 100)


@query("SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS kept, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) AS missing, (SELECT string_agg(f, ', ' ORDER BY f) FROM (SELECT " + fname("doc_id") + " AS f FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY f LIMIT 3)) AS first FROM documents")
def push_report(spark, sf_dir):
    have = table(spark, sf_dir, "labels").select(catalog.file_name(F.col("doc_id")).alias("file_name"))
    return files.push_report(recordings(spark, sf_dir), have)


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'u' || doc_id WHEN 1 THEN 'a' || doc_id WHEN 2 THEN 'p' || doc_id END AS url FROM documents WHERE doc_id % 4 <> 3 UNION ALL SELECT doc_id, 'l' || doc_id FROM documents WHERE doc_id % 4 = 0")
def url_lists(spark, sf_dir):
    """Addresses in JSON documents of every root shape."""
    i = F.col("doc_id").cast("string")
    shape = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('[{"url":"u'), i, F.lit('"},{"link":"l'), i, F.lit('"}]')))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"n":1,"data":[{"audio_url":"a'), i, F.lit('"}],"more":[{"url":"x"}]}')))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit('{"path":"p'), i, F.lit('"}')))
        .otherwise("12")
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(files.records_of(shape)).alias("record"))
    return rows.select("doc_id", files.url_of(F.col("record")).alias("url"))


@query("SELECT doc_id, CASE WHEN b >= 1048576 THEN printf('%.1f MB', round_even(b / 1048576.0::DOUBLE, 1)) ELSE printf('%.0f KB', round_even(b / 1024.0::DOUBLE, 0)) END AS size FROM (SELECT doc_id, n_chars * 4096 AS b FROM documents)")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", files.human_size(F.col("n_chars") * 4096).alias("size"))


@query("SELECT event_type, round_even(avg(value), 6) AS mean, round_even(stddev_pop(value), 6) AS sd, round_even(var_pop(value), 4) AS var, round_even(stddev_pop(value) / avg(value), 6) AS cv, round_even(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1")
def value_moments(spark, sf_dir):
    from speechloom.operators import series

    out = series.moments(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", *[F.bround(c, 4 if c == "var" else 6).alias(c) for c in ("mean", "sd", "var", "cv", "rms")])


def described(x):
    """An array of samples as numbers: its length, ends, and the sum of its absolute values."""
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.abs(v))
    return [F.size(x).cast("long").alias("n"), F.bround(F.array_min(x), 6).alias("low"), F.bround(F.array_max(x), 6).alias("high"), F.bround(total, 4).alias("total")]


_DESCRIBED = "CAST(len(x) AS BIGINT) AS n, round_even(list_min(x), 6) AS low, round_even(list_max(x), 6) AS high, round_even(list_sum(list_transform(x, lambda v: abs(v))), 4) AS total"


@query(f"SELECT vec_id, {_DESCRIBED}, false AS broken FROM (SELECT vec_id, list_transform(embedding, lambda v: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v::DOUBLE * 20))) AS x FROM embeddings)")
def clipped_samples(spark, sf_dir):
    from speechloom.operators import series

    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 20)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", series.clipped(x).alias("x"), series.broken(x).alias("broken"))
    return rows.select("vec_id", *described(F.col("x")), "broken")


@query(
    f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), m AS (SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v))) AS peak, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms FROM s)
      SELECT vec_id, {_DESCRIBED} FROM (SELECT vec_id, list_transform(x, lambda v: v * CASE WHEN peak / rms > 12 THEN 0.1 / rms ELSE power(10::DOUBLE, -3 / 20.0::DOUBLE) / peak END) AS x FROM m WHERE peak >= 1e-6 AND rms >= 1e-8)"""
)
def levelled_samples(spark, sf_dir):
    from speechloom.operators import series

    x = series.levelled(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x")).where("x IS NOT NULL").select("vec_id", *described(F.col("x")))


@query("SELECT CAST(doc_id AS VARCHAR) AS seq, 'ok' AS state FROM documents WHERE doc_id % 5 <> 0")
def good_json_lines(spark, sf_dir):
    """Lines of JSON, of which every fifth is broken: these are left out."""
    line = F.when(F.col("doc_id") % 5 == 0, F.lit('{"seq": "1", "state"')).otherwise(F.concat(F.lit('{"seq":"'), F.col("doc_id").cast("string"), F.lit('","state":"ok"}')))
    return files.parsed_lines(table(spark, sf_dir, "documents").select(line.alias("line")), "line", "seq string, state string")


@query("SELECT count(*) FILTER (l >= 3 AND l <= 100) AS kept, count(*) FILTER (l < 3) AS short FROM (SELECT n_chars / 16.0 AS l FROM documents)")
def observed_counts(spark, sf_dir):
    """Counted by the write of what is kept."""
    rows = recordings(spark, sf_dir)
    seen = dataset.written_with_counts(rows, scratch(spark, "kept"), F.col("duration").between(3, 100), short=F.col("duration") < 3)
    return spark.createDataFrame([(seen["after"], seen["short"])], "kept long, short long")


@query(
    """WITH t AS (SELECT conv_id, turn, length(text) / 16.0 AS d FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM t WHERE d >= 3)
      SELECT conv_id, turn, 'c' || conv_id || '_seg_' || lpad(CAST(r AS VARCHAR), 3, '0') || '.wav' AS name FROM k"""
)
def segment_names(spark, sf_dir):
    """Numbers from one, after short segments are dropped."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") / 16.0).alias("d")).where("d >= 3")
    out = dataset.numbered(rows, "conv_id", "turn", "r", 1)
    return out.select("conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_seg_"), F.lpad(F.col("r").cast("string"), 3, "0"), F.lit(".wav")).alias("name"))


@query("SELECT 'some' AS outcome, count(*) FILTER (toxic = 1) > 0 AS passed FROM labels UNION ALL SELECT 'none', count(*) FILTER (toxic = 7) > 0 FROM labels")
def zero_guard(spark, sf_dir):
    """What the guard against empty results says of a condition that rows meet, and of one that none does."""
    rows, out = table(spark, sf_dir, "labels"), []
    for name, value in (("some", 1), ("none", 7)):
        try:
            checks.assert_some(rows, F.col("toxic") == value, "no row")
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "outcome string, passed boolean")
