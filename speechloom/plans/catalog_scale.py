"""Registered queries of operators that spread one long recording, one hot key or a whole order over many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.functions import similarity
from speechloom.operators import clusters, dataset, ordered, spans
from speechloom.plans.catalog import Query, pairs, table
from speechloom.plans.catalog import turns as all_turns
from speechloom.plans.catalog_sql import TURNS
from speechloom.sources.shared import scratch
from speechloom.streaming import styles

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS position FROM documents")
def shuffled_positions(spark, sf_dir):
    """A whole shuffle of the documents."""
    return ordered.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


EPS, LEAST = 0.72, 3


@query(
    f"""WITH RECURSIVE v AS (SELECT label, vec_id, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
      n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1),
      p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.d = b.d JOIN n x ON x.vec_id = a.vec_id JOIN n y ON y.vec_id = b.vec_id
            GROUP BY 1, 2, x.n, y.n HAVING a.vec_id = b.vec_id OR 1 - sum(a.x * b.x) / (x.n * y.n) <= {EPS}),
      core AS (SELECT a FROM p GROUP BY a HAVING count(*) >= {LEAST}),
      e AS (SELECT p.a, p.b FROM p SEMI JOIN core x ON p.a = x.a SEMI JOIN core y ON p.b = y.a),
      reach AS (SELECT a, a AS root FROM core UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.a),
      of_core AS (SELECT a, min(root) AS cluster FROM reach GROUP BY 1),
      near AS (SELECT p.a, min(p.b) AS b FROM p JOIN core ON p.b = core.a ANTI JOIN core x ON p.a = x.a GROUP BY 1)
      SELECT label, vec_id, coalesce(c.cluster, d.cluster) AS cluster FROM embeddings LEFT JOIN of_core c ON c.a = vec_id LEFT JOIN near ON near.a = vec_id LEFT JOIN of_core d ON d.a = near.b"""
)
def density_clusters(spark, sf_dir):
    """Clusters of the segments of each recording (label)."""
    return clusters.dbscan(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", EPS, LEAST)


def drawn(name: str) -> str:
    return f"(CAST('0x' || substr(md5('42|{name}|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


_KINDS = "[" + ", ".join(f"'{k}'" for k in dataset.NOISE_KINDS) + "]"
_CHAIN = ", ".join(f"CASE WHEN {drawn(f'{n} applies')} < {p} THEN round_even({drawn(n)} * ({hi} - {lo}) + {lo}, 6) END AS {n}" for n, (p, lo, hi) in dataset.CHAIN.items())


@query(
    f"""WITH noises AS (SELECT {_KINDS}[page_id % 4 + 1] AS kind, url AS path FROM pages), numbered AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM noises),
      plan AS (SELECT doc_id, {_CHAIN}, {_KINDS}[CAST(floor({drawn('kind')} * 4) AS INTEGER) + 1] AS kind, round_even({drawn('snr')} * 5 + 16.5, 6) AS snr_db, {drawn('file')} AS place FROM documents)
      SELECT doc_id, rate, semitones, cutoff, gain_db, plan.kind, path AS noise, snr_db FROM plan LEFT JOIN numbered ON numbered.kind = plan.kind AND i = CAST(floor(place * n) AS INTEGER)"""
)
def augment_draws(spark, sf_dir):
    """The plan of a random chain for every document; pages stand for noise files."""
    kind = F.get(F.array(*map(F.lit, dataset.NOISE_KINDS)), (F.col("page_id") % 4).cast("int"))
    noises = table(spark, sf_dir, "pages").select(kind.alias("kind"), F.col("url").alias("path"))
    plan = dataset.augment_draws(table(spark, sf_dir, "documents"), "doc_id", noises)
    return plan.select("doc_id", *[F.bround(c, 6).alias(c) for c in dataset.CHAIN], "kind", "noise", F.bround("snr_db", 6).alias("snr_db"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\x0b\x0c\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda t: t <> '') AS a FROM documents),
      p AS (SELECT doc_id, a, CASE doc_id % 4 WHEN 0 THEN a WHEN 1 THEN list_reverse(a) WHEN 2 THEN a[3:] ELSE a[:5] || ['besh'] || a[7:] END AS b FROM w),
      x AS (SELECT doc_id, unnest(a) AS t, unnest(range(len(a))) AS i FROM p), y AS (SELECT doc_id, unnest(b) AS t, unnest(range(len(b))) AS j FROM p),
      cells AS (SELECT doc_id, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, i - j ORDER BY i) AS run FROM x JOIN y USING (doc_id, t)),
      best AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) AS n FROM cells GROUP BY doc_id, diagonal, run) GROUP BY 1)
      SELECT p.doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE round_even(coalesce(n, 0) / greatest(len(a), len(b))::DOUBLE, 6) END AS run FROM p LEFT JOIN best ON p.doc_id = best.doc_id"""
)
def longest_runs(spark, sf_dir):
    """The longest run that each document has in common with a changed form of it, over whole texts."""
    return pairs(spark, sf_dir).select("doc_id", F.bround(similarity.run_ratio(F.col("a"), F.col("b")), 6).alias("run"))


LOUD, SILENCE, KEEP, SHORTEST, LONGEST = 30.0, 40, 8, 60, 600


@query(
    f"""WITH m AS (SELECT source, max(doc_id) + 1 AS frames FROM documents GROUP BY 1),
      l AS (SELECT source, doc_id, CASE WHEN doc_id - lag(doc_id) OVER w - 1 < {SILENCE} THEN 0 ELSE 1 END AS new FROM documents WHERE n_chars / 16.0 >= {LOUD} WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
      r AS (SELECT source, doc_id, sum(new) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM l),
      s AS (SELECT m.source, frames, greatest(min(doc_id) - {KEEP}, 0) AS b, least(max(doc_id) + 1 + {KEEP}, frames) AS e FROM r JOIN m ON m.source = r.source GROUP BY m.source, frames, run),
      c AS (SELECT source, e, unnest(range(b, e, {LONGEST})) AS b FROM s WHERE frames > {LONGEST}),
      k AS (SELECT source, b AS "begin", least(e, b + {LONGEST}) AS "end" FROM c WHERE least(e, b + {LONGEST}) - b >= {SHORTEST} UNION ALL SELECT source, 0, frames FROM m WHERE frames BETWEEN {SHORTEST} AND {LONGEST})
      SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY "begin") AS INTEGER) AS segment, "begin", "end" FROM k"""
)
def speech_segments(spark, sf_dir):
    """Documents as frames (their ids) of one recording a source, their lengths as levels."""
    levels = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") / 16.0).alias("level"))
    found = spans.speech(levels, "source", "doc_id", F.col("level") >= LOUD, SILENCE, KEEP)
    return spans.segments(found, "source", SHORTEST, LONGEST)


@query(
    f"""WITH {TURNS}, seen AS (SELECT *, lag("end") OVER w AS before, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS new FROM turns WINDOW w AS (PARTITION BY record_id ORDER BY pos))
      SELECT record_id, count(*) AS turns, CAST(sum(new) AS BIGINT) AS runs, CASE WHEN bool_or(coalesce("start" < before - 5, false)) THEN 'has_resets' WHEN max("end") > 3600 THEN 'possibly_ms' WHEN max("end") > 60 THEN 'normal' ELSE 'short_clip' END AS style,
        round_even(sum("end" - "start") / sum(new), 6) AS mean_run, count(*) < 4 OR sum("end" - "start") / sum(new) >= 1.0 AS coherent FROM seen GROUP BY record_id"""
)
def followed_turns(spark, sf_dir):
    """Conversations that arrive in three parts: after each, a stream goes on from where the last one stopped."""
    turns = all_turns(spark, sf_dir).select("record_id", F.col("pos").cast("long").alias("pos"), "start", "end", "speaker")
    source, out, check = (scratch(spark, n) for n in ("turns", "facts", "state"))
    for part in (F.col("pos") < 2, F.col("pos").between(2, 3), F.col("pos") >= 4):
        turns.where(part).write.mode("append").parquet(source)
        styles.follow(spark, source, out, check, files_per_batch=1000).awaitTermination()
    return styles.known(spark, out).withColumn("mean_run", F.bround("mean_run", 6))


_TURN_SHARES = {"p10": 0.1, "p25": 0.25, "p35": 0.35, "p50": 0.5}


@query("SELECT conv_id, " + ", ".join(f"round_even(quantile_cont(length(text), {q}), 6) AS {n}" for n, q in _TURN_SHARES.items()) + " FROM conversations GROUP BY conv_id")
def turn_length_percentiles(spark, sf_dir):
    """Percentiles of turn lengths, for many keys at once."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.length("text").alias("length"))
    found = ordered.percentiles(rows, "conv_id", "length", _TURN_SHARES)
    return found.select("conv_id", *[F.bround(n, 6).alias(n) for n in _TURN_SHARES])
