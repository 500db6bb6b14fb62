"""DuckDB SQL for the registered queries: the same rows, written independently of the Spark expressions."""

from __future__ import annotations

from speechloom.functions.numbers import ONES, TENS
from speechloom.operators.ladders import NON_LATIN

W = r"[\p{L}\p{N}_]"
SP = r"[ \t\n\x0b\x0c\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def names(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SP}+|{SP}+$', '', 'g')"


def toks(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{SP}+'), lambda w: w <> '')"


def fname(i: str) -> str:
    return f"('doc_' || lpad(CAST({i} AS VARCHAR), 6, '0') || '.wav')"


def below_thousand(n: str) -> str:
    h = f"(CASE WHEN {n} >= 100 THEN {names(ONES)}[({n} // 100) + 1] || ' yuz' ELSE '' END)"
    return f"array_to_string(list_filter([{h}, {names(TENS)}[({n} % 100) // 10 + 1], {names(ONES)}[({n} % 10) + 1]], lambda z: z <> ''), ' ')"


def join_words(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda z: z <> ''), ' ')"


def below_million(n: str) -> str:
    k = f"(({n}) // 1000)"
    return join_words(f"(CASE WHEN {n} >= 1000 THEN {below_thousand(k)} || ' ming' ELSE '' END)", below_thousand(f"(({n}) % 1000)"))


def below_1e12(n: str) -> str:
    hi = f"(({n}) // 1000000)"
    return join_words(f"(CASE WHEN {n} >= 1000000 THEN {below_million(hi)} || ' million' ELSE '' END)", below_million(f"(({n}) % 1000000)"))


def words(n: str) -> str:
    """From 10**12 on, what stands before the last six digits is read as a number of its own."""
    high = join_words(f"({below_1e12(f'(({n}) // 1000000)')}) || ' million'", below_million(f"(({n}) % 1000000)"))
    return f"(CASE WHEN {n} = 0 THEN 'nol' WHEN {n} >= 1000000000000 THEN {high} ELSE {below_1e12(n)} END)"


def rewrite(t: str, pattern: str, fn) -> str:
    """Every match put through an expression, by splitting and joining."""
    parts, found = f"string_split_regex({t}, '{pattern}')", f"regexp_extract_all({t}, '{pattern}')"
    return f"list_transform([{found}], lambda f: array_to_string(list_transform({parts}, lambda p, i: p || coalesce({fn('f[i]')}, '')), ''))[1]"


INJ = """inj AS (
  SELECT doc_id, source, n_chars / 16.0 AS duration, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.wav' AS file_name,
    CASE doc_id % 12
      WHEN 0 THEN text
      WHEN 1 THEN '{"transcription": "' || replace(text, chr(10), ' ') || '"}'
      WHEN 2 THEN '[SHOVQIN] ' || text
      WHEN 3 THEN '<b>' || text || '</b>'
      WHEN 4 THEN text || '  12 va 1005 '
      WHEN 5 THEN text || text
      WHEN 6 THEN replace(text, ',', ',,')
      WHEN 7 THEN 'ʻ' || text || '’'
      WHEN 8 THEN 'Привет ' || text
      WHEN 9 THEN text || ' 12, 13.5'
      WHEN 10 THEN 'bu bu bu ' || text
      ELSE text || ' ... mmm'
    END AS text
  FROM documents
  UNION ALL SELECT CAST(doc_id AS BIGINT), 'stub', 16.0, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.wav', text
  FROM (VALUES (-1, ''), (-2, '...'), (-3, 'mmm'), (-4, '12, 13.5'), (-5, '[SHOVQIN]'), (-6, ' '), (-7, 'Привет'), (-8, 'ha bir'), (-9, 'bu bu bu bu bu bu')) AS stubs(doc_id, text)
)"""

TURNS = """w AS (
  SELECT conv_id, turn, role, text, length(text) / 16.0 AS d0, sum(length(text) / 16.0) OVER (PARTITION BY conv_id ORDER BY turn) AS e0,
         CASE WHEN conv_id % 5 = 0 THEN 1000.0 ELSE 1.0 END AS m, conv_id % 7 = 3 AND turn = 2 AS reset
  FROM conversations
), turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS record_id, turn AS pos, CAST((CASE WHEN reset THEN 0.0 ELSE e0 - d0 END) * m AS DOUBLE) AS "start",
         CAST((CASE WHEN reset THEN d0 WHEN (conv_id + turn) % 13 = 5 THEN e0 - d0 + 0.25 ELSE e0 END) * m AS DOUBLE) AS "end",
         CASE WHEN turn % 4 = 3 THEN '[SHOVQIN]' WHEN (conv_id + turn) % 11 = 0 THEN 'Привет' ELSE text END AS text, role AS speaker
  FROM w
), flagged AS (
  SELECT *, regexp_full_match(trim(text), '(?i)\\[(GUDOK|SHOVQIN|TINCH|MUSIQA|TUSHUNARSIZ)\\]') AS trash, regexp_matches(text, '%s') AS foreign_script
  FROM turns
)""".replace("%s", NON_LATIN)

CLEAN = TURNS + """, clean AS (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos) - 1 AS idx FROM flagged WHERE NOT trash AND NOT foreign_script
), seen AS (
  SELECT *, lag("end") OVER (PARTITION BY record_id ORDER BY idx) AS before FROM clean
), styles AS (
  SELECT record_id, CASE WHEN bool_or(coalesce("start" < before - 5, false)) THEN 'has_resets' WHEN max("end") > 3600 THEN 'possibly_ms'
         WHEN max("end") > 60 THEN 'normal' ELSE 'short_clip' END AS style FROM seen GROUP BY record_id
)"""

BLANK = "NOT regexp_matches({0}, '[^ \\t\\n\\x0b\\x0c\\r\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')"


def blank(t: str) -> str:
    return f"({t} IS NULL OR " + BLANK.format(t) + ")"


def repeat(t: str) -> str:
    return f"(CASE WHEN len({toks(f'lower({t})')}) = 0 THEN 100.0 ELSE round_even((1 - CAST(len(list_distinct({toks(f'lower({t})')})) AS DOUBLE) / len({toks(f'lower({t})')})) * 100, 1) END)"


def noise(t: str) -> str:
    s = strip(t)
    return f"(regexp_matches({s}, '(?i)^(mm+|uh+|ah+|eh+|um+|hmm+)[\\s.,!?]*$') OR regexp_matches({s}, '^[^\\p{{L}}\\p{{N}}_]+$'))"


def mixed(t: str) -> str:
    return f"(regexp_matches({t}, '[а-яёА-ЯЁ]') AND regexp_matches({t}, '[a-zA-Z]') AND CAST(len(regexp_extract_all({t}, '[a-zA-Z]+')) AS DOUBLE) / greatest(len({toks(t)}), 1) > 0.3)"


def cyr(t: str) -> str:
    let = lambda w: f"length(regexp_replace({w}, '[^\\p{{L}}]', '', 'g'))"
    c = lambda w: f"length(regexp_replace({w}, '[^а-яёА-ЯЁ]', '', 'g'))"
    dom = f"len(list_filter({toks(t)}, lambda w: {let('w')} > 0 AND {c('w')} * 2 > {let('w')}))"
    return f"(CASE WHEN len({toks(t)}) = 0 THEN 0.0 ELSE CAST({dom} AS DOUBLE) / len({toks(t)}) END)"


def ladder(words_min: int, repeat_max: float, is_mixed: bool) -> str:
    rule = f" WHEN {mixed('text')} THEN 'mixed_scripts'" if is_mixed else ""
    return f"WITH {INJ} SELECT doc_id, CASE WHEN {blank('text')} THEN 'empty' WHEN len({toks('text')}) < {words_min} THEN 'few_words' WHEN {repeat('text')} > {repeat_max} THEN 'repeats' WHEN {noise('text')} THEN 'noise'{rule} ELSE 'ok' END AS reason_code FROM inj"


RESULTS = f"""{INJ}, r0 AS (
  SELECT doc_id, file_name, text AS transcription, duration, source,
    CASE WHEN duration < 3 THEN 'too_short' WHEN duration > 400 THEN 'too_long' WHEN {blank('text')} THEN 'empty' WHEN len({toks('text')}) < 3 THEN 'few_words'
         WHEN {repeat('text')} > 70 THEN 'repeats' WHEN {noise('text')} THEN 'noise' END AS reason
  FROM inj
), results AS (
  SELECT *, CASE WHEN reason IS NOT NULL THEN 'filtered' WHEN doc_id % 5 = 0 THEN 'pending' WHEN doc_id % 7 = 0 THEN 'rejected' ELSE 'approved' END AS status,
    CASE WHEN doc_id % 2 = 0 THEN 'aisha_stt' ELSE 'gemini_stt' END AS pipeline
  FROM r0
)"""
KEEP = f"status <> 'filtered' AND NOT {blank('transcription')}"

TURN_PAIRS = f"""t0 AS (SELECT conv_id, turn, {toks('lower(text)')} AS a FROM conversations), turn_pairs AS (
  SELECT conv_id, turn, a, CASE (conv_id + turn) % 4 WHEN 0 THEN a WHEN 1 THEN list_reverse(a) WHEN 2 THEN a[3:] ELSE list_concat(list_concat(a[1:5], ['besh']), a[7:]) END AS b FROM t0
)"""

PLAN = """plan AS (
  SELECT doc_id, file_name, d AS duration, CASE WHEN doc_id % 97 = 0 THEN 'invalid_input'
    WHEN CAST(('0x' || substring(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 > 0.5 THEN 'skip_prob'
    WHEN doc_id % 89 = 0 OR d <= 0 THEN 'invalid_input' WHEN d > 24.5 THEN 'skip_long' WHEN doc_id % 83 = 0 THEN 'failed' ELSE 'augmented' END AS aug_status
  FROM (SELECT doc_id, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.wav' AS file_name, n_chars / 128.0 AS d FROM documents)
)"""

CHANGED = """pairs AS (
  SELECT aug_status, doc_id % 11 <> 0 AS found, CASE WHEN doc_id % 11 <> 0 AND doc_id % 23 <> 1 THEN (1.0 + doc_id % 16) / 16 END AS rin, (1.0 + doc_id % 16) / 16 * CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END AS rout,
    CASE WHEN doc_id % 8 = 0 THEN 99 ELSE 100 END AS n_out FROM plan WHERE aug_status <> 'invalid_input'
), changed AS (
  SELECT count(*) FILTER (NOT found) AS missing, count(*) FILTER (found AND rin IS NULL) AS decode_errors,
    count(*) FILTER (aug_status = 'augmented' AND rin IS NOT NULL) AS augmented_checked, count(*) FILTER (aug_status = 'augmented' AND rin = rout AND n_out = 100) AS augmented_unmodified,
    count(*) FILTER (aug_status IN ('skip_prob', 'skip_long') AND rin IS NOT NULL) AS skip_checked,
    count(*) FILTER (aug_status = 'failed' AND rin IS NOT NULL) AS failed_checked, count(*) FILTER (aug_status = 'failed' AND rin IS NOT NULL AND NOT (rin = rout AND n_out = 100)
      ) AS failed_modified FROM pairs
), changed_check AS (
  SELECT *, failed_checked >= 5 AND failed_modified / nullif(failed_checked, 0)::DOUBLE > 0.5 AS critical FROM changed
)"""

DIST = """c AS (
  SELECT count(*) AS total, count(*) FILTER (aug_status = 'augmented') AS augmented, count(*) FILTER (aug_status = 'skip_prob') AS skip_prob, count(*) FILTER (aug_status = 'skip_long') AS skip_long,
    count(*) FILTER (aug_status = 'failed') AS failed, count(*) FILTER (aug_status = 'invalid_input') AS invalid_input, CAST(0 AS BIGINT) AS unknown FROM plan
), dist AS (
  SELECT *, total - invalid_input AS effective_total, round_even(augmented / (total - invalid_input)::DOUBLE, 4) AS augmented_ratio, round_even(failed / (total - invalid_input)::DOUBLE, 4) AS failed_ratio,
    round_even(invalid_input / total::DOUBLE, 4) AS invalid_ratio FROM c
), dist_check AS (
  SELECT *, total > 0 AND abs(augmented_ratio - 0.5) <= 0.25 + 1e-12 AND failed_ratio <= 0.02 AND invalid_ratio <= 0.01 AND unknown = 0 AS passed FROM dist
)"""

REVIEWED = f"""{INJ}, decided AS (
  SELECT 'doc_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.wav' AS file_name, CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'edit ' || doc_id END AS edited_text,
    CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 AND doc_id % 3 = 0 THEN 'edited' WHEN quality = 1 THEN 'approved' ELSE 'pending' END AS decision FROM labels
), reviewed AS (
  SELECT i.doc_id, coalesce(d.decision, 'pending') AS decision, coalesce(d.edited_text, i.text) AS text FROM inj i LEFT JOIN decided d USING (file_name)
)"""

SIGNAL = "signal AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"

HIST = SIGNAL + """, b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM signal GROUP BY 1), hist AS (
  SELECT s.event_type, CAST(CASE WHEN hi = lo THEN 15 ELSE least(floor((value - lo) / (hi - lo) * 30), 29) END AS INTEGER) AS bin, count(*) AS n FROM signal s JOIN b USING (event_type) GROUP BY 1, 2
)"""


def sig(x: str, c: float, k: float) -> str:
    return f"1 / (1 + exp(greatest(-500.0, least(500.0, {-k} * (({x}) - {c})))))"


SCORE = f"(0.30 * {sig('(doc_id % 10) / 10.0::DOUBLE', 0.38, 20.0)} + 0.35 * {sig('(doc_id % 7) / 7.0::DOUBLE', 0.68, 14.0)} + 0.25 * {sig('(doc_id % 5) / 4.0::DOUBLE', 0.55, -8.0)} + 0.07 * {sig('(doc_id % 30)::DOUBLE', 16.0, 0.4)} + 0.03 * {sig('(doc_id % 3) / 2.0::DOUBLE', 0.5, 3.0)})"


def norm() -> str:
    """The normaliser's default chain, a step a subquery."""
    number = lambda m: f"CASE WHEN length({m}) <= 18 THEN list_transform([TRY_CAST({m} AS BIGINT)], lambda n: {words('n')})[1] ELSE {m} END"
    steps = [
        "replace(replace(replace(t, 'ʻ', ''''), 'ʼ', ''''), '’', '''')",
        f"CASE WHEN regexp_matches(t, '\\b\\d+\\b') THEN {rewrite('t', '\\b\\d+\\b', number)} ELSE t END",
        strip("regexp_replace(t, ' {2,}', ' ', 'g')"),
        strip("regexp_replace(regexp_replace(t, '\\{[\"'']transcription[\"'']\\s*:\\s*[\"''](.+?)[\"'']\\}', '\\1', 'g'), '\\{.*?\\}', '', 'g')"),
        strip("regexp_replace(t, '\\[.*?\\]', '', 'g')"),
        strip("regexp_replace(t, '<[^>]+>', '', 'g')"),
        f"CASE WHEN length(t) // 2 > 10 AND {strip('substring(t, 1, length(t) // 2)')} = {strip('substring(t, length(t) // 2 + 1)')} THEN {strip('substring(t, 1, length(t) // 2)')} ELSE t END",
        "regexp_replace(t, ',{2,}', ',', 'g')",
        "replace(replace(replace(replace(t, '“', '\"'), '”', '\"'), '‘', ''''), '’', '''')",
        "upper(substring(t, 1, 1)) || substring(t, 2)",
        rewrite("t", f"[.!?]{SP}+[a-záéíóúA-Z]", lambda m: f"upper({m})"),
    ]
    q = "SELECT doc_id, text AS raw, text AS t FROM inj"
    for s in steps:
        q = f"SELECT doc_id, raw, {s} AS t FROM ({q})"
    why = f"CASE WHEN {blank('raw')} THEN 'empty text' WHEN regexp_full_match({strip('t')}, '[0-9\\s.,]+') THEN 'only digits' WHEN regexp_matches(t, '[а-яёА-ЯЁ]') THEN 'cyrillic detected' WHEN {blank('t')} THEN 'empty after normalization' ELSE 'ok' END"
    return f"WITH {INJ} SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars, drop_reason FROM (SELECT doc_id, CASE WHEN {blank('raw')} THEN raw ELSE t END AS t, {why} AS drop_reason FROM ({q}))"


def valid() -> str:
    s = strip("text")
    return f"""WITH {INJ} SELECT doc_id, CASE WHEN {blank('text')} THEN 'empty'
      WHEN len({toks('text')}) < 3 AND NOT (length(regexp_replace({s}, '[\\s.,!?;:\\-]', '', 'g')) >= 4 AND right({s}, 1) IN ('.', '!', '?')) THEN 'few_words'
      WHEN regexp_full_match({s}, '[0-9\\s.,]+') THEN 'only_digits' WHEN regexp_full_match({s}, '[^\\p{{L}}\\p{{N}}_]+') THEN 'only_symbols'
      WHEN {cyr(s)} >= 0.30 THEN 'cyrillic' ELSE 'ok' END AS reason_code FROM inj"""


ORACLES: dict[str, str] = {
    "diarization_chunks": f"""WITH {CLEAN} SELECT record_id || '_chunk' || lpad(CAST(idx AS VARCHAR), 4, '0') || '.wav' AS file_name, {strip('text')} AS transcription, speaker, "start", "end", "end" - "start" AS duration,
      record_id, CAST(idx AS INTEGER) AS idx, style, 'v3_python_filter' AS pipeline FROM clean JOIN styles USING (record_id) WHERE "end" - "start" >= 0.4""",
    "diarization_style": f"WITH {CLEAN} SELECT record_id, style FROM styles",
    "diarization_skip_counts": f"""WITH {TURNS} SELECT CASE WHEN trash THEN 'skipped_trash' WHEN foreign_script THEN 'skipped_nonlatin' WHEN "end" - "start" < 0.5 THEN 'skipped_short' ELSE 'kept' END AS outcome, count(*) AS n FROM flagged GROUP BY 1""",
    "diarization_plain_chunks": f"""WITH {TURNS} SELECT record_id || '_seg' || lpad(CAST(pos AS VARCHAR), 4, '0') || '.wav' AS file_name, record_id, pos AS idx, speaker, "start", "end", round_even("end" - "start", 3) AS duration FROM flagged WHERE NOT trash AND "end" - "start" >= 0.5""",
    "diarization_latin_chunks": f"""WITH {TURNS} SELECT record_id || '_chunk' || lpad(CAST(pos AS VARCHAR), 4, '0') || '.wav' AS file_name, record_id, pos AS idx, speaker, "start", "end", round_even("end" - "start", 3) AS duration FROM flagged WHERE NOT trash AND NOT foreign_script AND "end" - "start" >= 0.5""",
    "audio_ladder": f"""WITH {INJ}, x AS (SELECT doc_id, duration, CAST(doc_id % 41 - 1 AS DOUBLE) AS snr, CAST(doc_id % 100 AS DOUBLE) AS sil FROM inj) SELECT doc_id, duration, CASE WHEN duration BETWEEN 3 AND 30 THEN snr END AS snr_score,
      CASE WHEN duration < 3 THEN 'too_short' WHEN duration > 30 THEN 'too_long' WHEN snr >= 0 AND snr < 15 THEN 'low_snr' WHEN sil > 80 THEN 'silence' ELSE 'ok' END AS reason_code FROM x""",
    "text_filter_v1": ladder(3, 70.0, False),
    "text_filter_v2": ladder(5, 50.0, True),
    "ready_text_ladder": f"WITH {INJ} SELECT doc_id, CASE WHEN duration < 3 THEN 'too_short' WHEN duration > 30 THEN 'too_long' WHEN {blank('text')} THEN 'empty' WHEN len({toks('text')}) < 2 THEN 'few_words' ELSE 'approved' END AS reason_code FROM inj",
    "validity_ladder": valid(),
    "repeat_ratio": f"WITH {INJ} SELECT doc_id, {repeat('text')} AS repeat_ratio FROM inj",
    "script_flags": f"WITH {INJ} SELECT doc_id, {mixed('text')} AS mixed, regexp_matches(text, '{NON_LATIN}') AS non_latin, {noise('text')} AS noise, regexp_full_match({strip('text')}, '(?i)\\[(GUDOK|SHOVQIN|TINCH|MUSIQA|TUSHUNARSIZ)\\]') AS trash, round_even({cyr('text')}, 6) AS cyrillic_ratio FROM inj",
    "score_status": "SELECT doc_id, score, CASE WHEN score >= 3 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN score >= 4 THEN 'approved' WHEN score <= 2 THEN 'rejected' ELSE 'pending' END AS status_strict FROM (SELECT doc_id, CAST(CASE WHEN doc_id % 9 >= 7 THEN 3 ELSE greatest(1, least(5, doc_id % 9)) END AS INTEGER) AS score FROM documents)",
    "norm_pipeline": norm(),
    "int_words": f"SELECT doc_id, n, {below_1e12('n')} AS words, CASE WHEN doc_id = 0 THEN 'nol' ELSE {below_1e12('doc_id')} END AS id_words FROM (SELECT doc_id, (doc_id * doc_id * 7919 + doc_id * 31) % 1000000000000 AS n FROM documents WHERE doc_id > 0) UNION ALL SELECT doc_id, 0, 'nol', 'nol' FROM documents WHERE doc_id = 0",
    "html_strip": "SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)",
    "change_ratios": f"""WITH {TURN_PAIRS}, sets AS (SELECT conv_id, turn, list_distinct(a) AS x, list_distinct(b) AS y, list_distinct(list_filter(list_transform(a, lambda w: regexp_replace(w, '[.,!?;:''"«»\\-]+', '', 'g')), lambda w: w <> '')) AS p,
      list_distinct(list_filter(list_transform(b, lambda w: regexp_replace(w, '[.,!?;:''"«»\\-]+', '', 'g')), lambda w: w <> '')) AS q FROM turn_pairs), r AS (
      SELECT conv_id, turn, CASE WHEN len(p) = 0 THEN 100.0 ELSE round_even((len(p) + len(q) - 2 * len(list_intersect(p, q))) / greatest(len(p), len(q), 1)::DOUBLE * 100, 1) END AS ratio,
        CASE WHEN len(x) = 0 THEN 100.0 ELSE round_even((len(x) + len(y) - 2 * len(list_intersect(x, y))) / len(x)::DOUBLE * 100, 1) END AS simple_ratio FROM sets)
      SELECT conv_id, turn, ratio, simple_ratio, CASE WHEN ratio < 25 THEN 'approved' ELSE 'pending' END AS status FROM r""",
    "status_counts": f"WITH {RESULTS} SELECT pipeline, count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'filtered') AS filtered, count(*) FILTER ({KEEP}) AS saved FROM results GROUP BY 1",
    "export_projection": f"WITH {RESULTS} SELECT file_name, md5(transcription) AS text_md5, duration, source, status, coalesce(reason, '') AS reason FROM results WHERE {KEEP}",
    "export_file_plan": f"WITH {RESULTS} SELECT file_name, CASE WHEN {KEEP} THEN 'copy' ELSE 'delete' END AS action, CASE WHEN {KEEP} THEN '/out/' || file_name END AS target FROM results",
    "hours_total": "SELECT round_even(sum(n_chars / 16.0) / 3600, 6) AS hours, round_even(sum(n_chars / 16.0) / 3600 * 0.25, 6) AS disk_gb FROM documents WHERE doc_id % 50 <> 0",
    "path2_run": f"""WITH {INJ}, x AS (SELECT doc_id, duration / 4 AS d, CAST(doc_id % 37 - 1 AS DOUBLE) AS snr, doc_id % 101 AS sil, text, CAST(greatest(1, least(5, ((doc_id % 6) + 6) % 6)) AS INTEGER) AS score FROM inj), y AS (
      SELECT doc_id, score, CASE WHEN d < 3 THEN 'too_short' WHEN d > 30 THEN 'too_long' WHEN sil > 70 THEN 'silence' WHEN {blank('text')} THEN 'empty' WHEN len({toks('text')}) < 5 THEN 'few_words' WHEN {repeat('text')} > 50 THEN 'repeats' WHEN {noise('text')} THEN 'noise' WHEN {mixed('text')} THEN 'mixed_scripts' END AS reason FROM x)
      SELECT doc_id, CASE WHEN reason IS NOT NULL THEN 'filtered' WHEN score >= 3 THEN 'approved' ELSE 'rejected' END AS status, coalesce(reason, 'ok') AS reason, CASE WHEN reason IS NULL THEN score END AS gemini_score FROM y""",
    "manifest_anti_join": f"""SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 50 = 1 THEN ' ' ELSE {fname('doc_id')} || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END END AS file_name FROM documents
      WHERE doc_id % 50 IN (0, 1) OR doc_id NOT IN (SELECT item_id FROM benchmark WHERE item_id IS NOT NULL)""",
    "manifest_anti_join_named": f"SELECT doc_id, {fname('doc_id')} AS file_name FROM documents WHERE doc_id % 50 <> 0 AND doc_id NOT IN (SELECT item_id FROM benchmark WHERE item_id IS NOT NULL)",
    "audio_semi_join": f"SELECT doc_id, {fname('doc_id')} AS file_name, n_chars / 16.0 AS duration FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "audio_missing": "SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "source_lookup": "SELECT doc_id, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS base, doc_id IN (SELECT doc_id FROM labels) AS found FROM documents",
    "first_location": f"SELECT doc_id, {fname('doc_id')} AS file_name, CASE WHEN doc_id % 2 = 0 THEN '/place0/' || {fname('doc_id')} WHEN doc_id % 3 = 0 THEN '/place1/' || {fname('doc_id')} WHEN doc_id % 4 = 0 THEN '/place2/' || {fname('doc_id')} WHEN doc_id % 5 = 0 THEN '/place3/' || {fname('doc_id')} END AS path FROM documents",
    "review_merge": f"WITH {REVIEWED} SELECT doc_id, decision, md5(text) AS text_md5 FROM reviewed WHERE decision <> 'rejected'",
    "review_stats": f"""WITH {REVIEWED}, s AS (SELECT count(*) AS total, count(*) FILTER (decision IN ('approved', 'edited')) AS approved, count(*) FILTER (decision = 'edited') AS edited, count(*) FILTER (decision = 'rejected') AS rejected FROM reviewed)
      SELECT *, total - approved - rejected AS pending, round_even((approved + rejected) * 100 / total::DOUBLE, 1) AS percent FROM s""",
    "aug_status_plan": f"WITH {PLAN} SELECT doc_id, aug_status FROM plan",
    "aug_status_histogram": f"WITH {PLAN} SELECT aug_status, count(*) AS n FROM plan GROUP BY 1",
    "aug_distribution_check": f"WITH {PLAN}, {DIST} SELECT * FROM dist_check",
    "aug_usable": f"WITH {PLAN} SELECT 'not_failed' AS kept, count(*) AS n FROM plan WHERE aug_status <> 'failed' UNION ALL SELECT 'augmented', count(*) FROM plan WHERE aug_status = 'augmented'",
    "schema_check": f"""WITH {PLAN} SELECT count(*) AS total, count(*) FILTER (doc_id % 61 = 0 OR (doc_id % 5 = 0 AND doc_id % 3 = 0)) AS no_audio, count(*) FILTER (doc_id % 53 = 0) AS no_text, count(*) FILTER (duration <= 0) AS no_duration,
      count(*) FILTER (doc_id % 47 = 0) AS no_name, count(*) FILTER (aug_status IS NULL) AS no_status, count(*) FILTER (doc_id % 61 <> 0 AND doc_id % 3 = 0 AND doc_id % 5 <> 0) AS path_only,
      count(*) FILTER (doc_id % 61 = 0 OR (doc_id % 5 = 0 AND doc_id % 3 = 0) OR doc_id % 53 = 0 OR duration <= 0 OR doc_id % 47 = 0) = 0 AS passed FROM plan""",
    "audio_changed_check": f"WITH {PLAN}, {CHANGED} SELECT *, augmented_unmodified = 0 AND NOT critical AS passed FROM changed_check",
    "checks_verdict": f"""WITH {PLAN}, {CHANGED}, {DIST}, v AS (SELECT (SELECT passed FROM dist_check) AND (SELECT augmented_unmodified = 0 AND NOT critical FROM changed_check) AS passed, (SELECT critical FROM changed_check) AS critical)
      SELECT CASE WHEN critical THEN 'critical' WHEN passed THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN critical THEN 3 WHEN passed THEN 0 ELSE 2 END AS exit_code FROM v""",
    "noise_corpus_check": "WITH f AS (SELECT unnest(['noise', 'music', 'speech', 'rir']) AS folder), n AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'noise' WHEN 1 THEN 'music' WHEN 2 THEN 'speech' END AS folder, count(*) AS files FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 < 3 GROUP BY 1) SELECT folder, coalesce(files, 0) AS files, coalesce(files, 0) >= 50 AS enough FROM f LEFT JOIN n USING (folder)",
    "noise_quarantine_plan": f"""SELECT '/corpus/noise/' || {fname('doc_id')} AS path, CASE WHEN doc_id % 10 = 0 OR n_chars / 1024.0 < 1 THEN 'quarantine' ELSE 'keep' END AS action,
      CASE WHEN doc_id % 10 = 0 OR n_chars / 1024.0 < 1 THEN '/corpus/noise/_quarantine/' || {fname('doc_id')} ELSE '/corpus/noise/' || {fname('doc_id')} END AS target FROM documents""",
    "dup_names": "SELECT 'd' || (doc_id % 700) AS file_name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "last_by_name": "SELECT file_name, source, doc_id FROM (SELECT 'd' || (doc_id % 700) AS file_name, source, doc_id, row_number() OVER (PARTITION BY doc_id % 700 ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1",
    "shuffle_head": "SELECT doc_id, source FROM documents ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100",
    "first_rows": f"SELECT doc_id, {fname('doc_id')} AS file_name FROM documents ORDER BY 2 LIMIT 100",
    "split_assign": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) <= ceil(0.01 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents",
    "union_filter_counts": f"WITH {INJ}, x AS (SELECT source, len({toks('text')}) AS labels, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS k FROM inj) SELECT source, CAST(sum(k) AS BIGINT) AS before, CAST(coalesce(sum(k) FILTER (labels < 440), 0) AS BIGINT) AS after FROM x GROUP BY 1",
    "test_and_continue": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY 'doc_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.wav') AS r FROM documents) SELECT 'test' AS part, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM r WHERE r <= 100 UNION ALL SELECT 'continue', count(*), CAST(sum(doc_id) AS BIGINT) FROM r WHERE r > 100 UNION ALL SELECT 'all', count(*), CAST(sum(doc_id) AS BIGINT) FROM r",
    "name_functions": "SELECT doc_id, 'org' || doc_id || '/name' AS dataset, CASE WHEN doc_id % 2 = 0 THEN 'a_b__' || doc_id || '_' ELSE 'rec_' || (doc_id + 1) END AS record, '/x/' || doc_id AS path, 'b' || doc_id || '.x' AS stem FROM documents",
    "record_urls": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'audio_url_' || doc_id WHEN 1 THEN 'audio_' || doc_id END AS url FROM documents",
    "frame_rms_snr": f"""WITH {SIGNAL}, m AS (SELECT user_id, max(pos) AS last FROM signal GROUP BY 1), k AS (SELECT user_id, unnest(range(0, greatest((last + 1 - 8) // 4 + 1, 0))) AS frame FROM m WHERE last >= 7),
      f AS (SELECT k.user_id, k.frame, sqrt(avg(s.value * s.value)) AS rms FROM k JOIN signal s ON s.user_id = k.user_id AND s.pos >= k.frame * 4 AND s.pos < k.frame * 4 + 8 GROUP BY 1, 2)
      SELECT user_id, count(*) AS frames, round_even(avg(rms), 4) AS signal, round_even(quantile_cont(rms, 0.1), 4) AS noise FROM f GROUP BY 1""",
    "silent_bins": f"WITH {SIGNAL}, b AS (SELECT user_id, pos // 4 AS bin, sqrt(avg(value * value)) AS rms FROM signal GROUP BY 1, 2) SELECT user_id, count(*) AS bins, round_even(count(*) FILTER (rms < 40) / count(*)::DOUBLE * 100, 1) AS silence_ratio FROM b GROUP BY 1",
    "run_coherence": f"""WITH {SIGNAL}, x AS (SELECT user_id, pos, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM signal WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
      g AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM x), r AS (SELECT user_id, run, count(*) * 0.75 AS sec, count(*) AS n FROM g GROUP BY 1, 2)
      SELECT user_id, CAST(sum(n) AS BIGINT) AS segments, count(*) AS runs, round_even(CAST(avg(sec) AS DOUBLE), 6) AS mean_run, sum(n) < 4 OR avg(sec) >= 1.0 AS coherent FROM r GROUP BY 1""",
    "value_histogram": f"WITH {HIST} SELECT event_type, bin, n FROM hist",
    "histogram_peaks": f"""WITH {HIST}, p AS (SELECT event_type, bin, n, CASE WHEN bin - lag(bin) OVER w = 1 THEN lag(n) OVER w ELSE 0 END AS l, CASE WHEN lead(bin) OVER w - bin = 1 THEN lead(n) OVER w ELSE 0 END AS r FROM hist WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
      t AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bin) AS k FROM p WHERE n > l AND n >= r)
      SELECT event_type, max(n) FILTER (k = 1) AS first, coalesce(max(n) FILTER (k = 2), 0) AS second, coalesce(max(n) FILTER (k = 2), 0) > max(n) FILTER (k = 1) * 0.3 AS bimodal FROM t WHERE k <= 2 GROUP BY 1""",
    "value_percentiles": "SELECT event_type, round_even(quantile_cont(value, 0.1), 6) AS p10, round_even(quantile_cont(value, 0.25), 6) AS p25, round_even(quantile_cont(value, 0.35), 6) AS p35, round_even(quantile_cont(value, 0.5), 6) AS p50, round_even(stddev_pop(value), 4) AS sd FROM events GROUP BY 1",
    "zscore_cosine": """WITH f AS (SELECT vec_id // 8 AS g, vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT g, d, avg(x) AS m, stddev_pop(x) AS sd FROM f GROUP BY 1, 2),
      z AS (SELECT f.g, vec_id, f.d, CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0 END AS z FROM f JOIN s ON f.g = s.g AND f.d = s.d), n AS (SELECT vec_id, sum(z * z) AS n FROM z GROUP BY 1),
      p AS (SELECT a.g, a.vec_id AS a, b.vec_id AS b, sum(a.z * b.z) AS dot FROM z a JOIN z b ON a.g = b.g AND a.d = b.d AND a.vec_id < b.vec_id GROUP BY 1, 2, 3)
      SELECT g AS recording, a, b, round_even(CASE WHEN x.n * y.n > 0 THEN 1 - dot / sqrt(x.n * y.n) ELSE 1.0 END, 4) AS distance FROM p JOIN n x ON x.vec_id = a JOIN n y ON y.vec_id = b""",
    "music_scores": f"SELECT doc_id, round_even(s, 6) AS score, (CASE WHEN s >= 0.6 THEN 1 ELSE 0 END + CASE WHEN s / 2 >= 0.6 THEN 1 ELSE 0 END + CASE WHEN s * 1.2 >= 0.6 THEN 1 ELSE 0 END) * 2 > 3 AS music FROM (SELECT doc_id, {SCORE} AS s FROM documents)",
    "noise_levels": "SELECT doc_id, round_even(30 - 0.27::DOUBLE * l, 4) AS snr_low, round_even(35 - 0.27::DOUBLE * l, 4) AS snr_high FROM (SELECT doc_id, greatest(0, least(100, doc_id % 131 - 10)) AS l FROM documents)",
}
