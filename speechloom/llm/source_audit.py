"""Source divergence audit: how the words of one source differ from those of the others of its language.

Every pair of sources starts at the value it had if no kept term occurred in either: the number of terms times the
divergence of two zero counts. An inverted index (the sources of each term) then emits corrections only: those of a source's
own terms against another's zero counts, gathered first by how often they occur, and those of terms that both hold. All
arithmetic is on whole numbers, so results are exact in any order of addition.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.llm.common import bound_batches, map_columns, written

#: Documents of a language that must hold a term, and terms a group reports.
LEAST, SHOWN = 10, 10
#: Shares are in units of 1 / SCALE; every count is raised by MORE.
SCALE, MORE = 1_000_000_000, 2
#: Different terms a task holds before it hands its counts on.
HELD = 400_000

#: Letters of ASCII in lower case and all bytes beyond ASCII stay; what parts terms becomes a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Stretches of ASCII letters (in lower case) and characters beyond ASCII, of a whole text in UTF-8."""
    return text.translate(_TERMS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term. A null term stands for the group, which
    thereby occurs even without terms; its docs are the group's documents."""
    bound_batches(docs.sparkSession)

    def count(batches):
        held: dict[tuple[str, str], list] = {}

        def flushed():
            for (lang, source), (n, d, rows) in held.items():
                yield {"lang": [lang], "source": [source], "term": [None], "n": [0], "docs": [rows]}
                found = list(n)
                for at in range(0, len(found), 50_000):
                    some = found[at : at + 50_000]
                    yield {"lang": [lang] * len(some), "source": [source] * len(some), "term": [t.decode() for t in some], "n": [n[t] for t in some], "docs": [d[t] for t in some]}
            held.clear()

        for b in batches:
            for lang, source, text in zip(b["lang"], b["source"], b["text"], strict=True):
                group = held.setdefault((lang, source), [Counter(), Counter(), 0])
                found = terms(text)
                group[0].update(found)
                group[1].update(set(found))
                group[2] += 1
            if sum(len(n) for n, _, _ in held.values()) > HELD:
                yield from flushed()
        yield from flushed()

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    own = map_columns(plain, "lang string, source string, term string, n long, docs long", count)
    return own.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | str, total: str, v: str) -> Column:
    """1 + floor(SCALE * (n + MORE) / (total + MORE * v)), by decimals, as counts may be large."""
    top = f"(CAST({n} AS DECIMAL(20,0)) + {MORE}) * {SCALE}"
    return F.expr(f"CASE WHEN {total} + {v} > 0 THEN 1 + ({top}) DIV CAST({total} + {MORE} * {v} AS DECIMAL(20,0)) ELSE 1L END")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audited(docs: DataFrame, least: int = LEAST, shown: int = SHOWN) -> DataFrame:
    """Of every (lang, source): the divergence from each other source of its language (part pair, all ranks), and the terms
    that it has more of than its language as a whole (part term, the first ranks): lang, source, part, item, value, rank.

    Null text, lang and source count as empty ones; a document without terms still makes its group occur; repeated rows
    count each for itself; equal values are ranked by item; a language without kept terms has value 0 for every pair; a
    source alone in its language has no pair; an empty table gives no row. Other columns are left out. The result has a row
    for each ordered pair of sources of a language, so sources, unlike terms and documents, are taken to be some thousands
    at most.
    """
    counts = written(term_counts(docs), "audit-counts")
    found = counts.where("term IS NOT NULL")
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).drop("docs")
    index = written(found.drop("docs").join(kept, ["lang", "term"]), "audit-index")

    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    of_group = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    groups = written(groups.withColumn("zero", share("0", "total", "v")), "audit-groups")

    rows = index.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    return pairs(rows, groups).unionByName(leading(rows, shown)).select("lang", "source", "part", "item", "value", "rank")


def pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows: the index with each posting's share p and its group's share of a zero count."""
    g, h = (groups.select("lang", F.col("source").alias(s), F.col("zero").alias(f"zero_{s}"), "v") for s in "ab")
    zeros = divergence(F.col("zero_a"), F.col("zero_b"))
    base = g.join(h.drop("v"), "lang").where("a < b").select("lang", "a", "b", (F.col("v") * zeros).alias("value"))

    # A source's terms against zero counts of another: terms that occur equally often are corrected at once.
    often = rows.groupBy("lang", F.col("source").alias("a"), "p", F.col("zero").alias("zero_a")).agg(F.count("*").alias("m"))
    one = F.col("m") * (divergence(F.col("p"), F.col("zero_b")) - zeros)
    single = often.join(F.broadcast(h.drop("v")) if few(groups) else h.drop("v"), "lang").where("a <> b").withColumn("value", one).where("value <> 0")
    single = single.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))

    # Terms of both: in place of the two corrections that took the other's count for zero.
    x, y = (rows.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("zero").alias(f"zero_{s}")) for s in "ab")
    two = divergence(F.col("p_a"), F.col("p_b")) - divergence(F.col("p_a"), F.col("zero_b")) - divergence(F.col("zero_a"), F.col("p_b")) + zeros
    both = x.join(y, ["lang", "term"]).where("a < b").withColumn("value", two).where("value <> 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    total = base.unionByName(single).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return ranked(total.select("lang", ways.alias("way"), "value").select("lang", "way.*", "value"), "pair")


def few(groups: DataFrame, most: int = 100_000) -> bool:
    """Whether the groups (some 50 bytes each) may be sent to every task."""
    return groups.count() <= most


def leading(rows: DataFrame, shown: int) -> DataFrame:
    """The terms with a larger share in the group than in its language, those of the largest divergence."""
    q = share("lang_n", "lang_total", "v")
    more = rows.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return ranked(more, "term").where(F.col("rank") <= shown)


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(order))
