"""The thin registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from speechloom.llm.common import table
from speechloom.llm.repair_sql import OP13_SQL

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.audio_media import media_report

    return media_report(table(spark, sf_dir, "documents"))


def op3_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.vp_tree import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.html_blocks import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op5_piece_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.piece_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


def op6_word_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.word_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, length=2048)


def op8_icws_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.near_dup import classes

    return classes(table(spark, sf_dir, "documents"))


def op9_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op10_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.source_audit import audited

    return audited(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.secret_scan import report

    return report(table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechloom.llm.turn_repair import repair_report

    return repair_report(table(spark, sf_dir, "conversations"))


#: Of records with equal payloads of at least 1000 bytes the largest page_id is the response.
OP9_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
         max(page_id) OVER (PARTITION BY sha256(payload)) AS response_id
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND response_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND response_id <> page_id THEN response_id END AS refers_to
FROM d
"""

#: Every pair of sources over every kept term of their language, whether it occurs in them or not.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), lang_sum AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), dense AS (
  SELECT g.lang, g.source, kept.term, lang_n, coalesce(c.n, 0) AS n
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (CAST(n AS HUGEINT) + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p,
         1 + (1000000000 * (CAST(lang_n AS HUGEINT) + 2)) // (CAST(lang_total AS HUGEINT) + 2 * v) AS q
  FROM dense JOIN lang_sum USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), out AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM out
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pu_quality,
        op2_audio_media,
        op3_vantage_point_search,
        op4_main_text,
        op5_piece_token_counts,
        op6_word_bpe_round_trip,
        op7_mixture_packing,
        op8_icws_near_duplicates,
        op9_content_addressed_warc,
        op10_string_kernel_toxicity,
        op11_source_audit,
        op12_secret_scan,
        op13_turn_repair,
    )
}
ORACLES: dict[str, str] = {"op9_content_addressed_warc": OP9_SQL, "op11_source_audit": OP11_SQL, "op13_turn_repair": OP13_SQL}
