"""The transcript normaliser: an ordered chain of switches, each a column expression; drops by reason."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.functions.expr import blank, holds, let, may_be_cyrillic, only_of, replace_where, rewrite, strip, upper_first
from speechloom.functions.numbers import number_words


@dataclass(frozen=True)
class Normaliser:
    apostrophe: bool = True
    num_words: bool = True
    double_space: bool = True
    clean_json: bool = True
    brackets: bool = True
    html: bool = True
    duplicate: bool = True
    multi_comma: bool = True
    broken_hyphen: bool = False
    dash: bool = False
    ellipsis: bool = False
    quotes: bool = True
    capitalize: bool = True
    sentence_case: bool = True
    punct: bool = False
    only_digits: bool = True
    cyrillic: bool = True


def _halves(t: Column) -> Column:
    """The first half of a text that says the same twice, character by character."""

    def cut(s: Column) -> Column:
        first, second = strip(F.substring(s["t"], F.lit(1), s["h"])), strip(F.substring(s["t"], s["h"] + 1, F.length(s["t"])))
        return F.when((s["h"] > 10) & (first == second), first).otherwise(s["t"])

    return let(F.struct(t.alias("t"), F.floor(F.length(t) / 2).cast("int").alias("h")), cut)


def steps(on: Normaliser) -> list:
    """The text steps that are switched on, in their order, which matters."""
    translated = lambda t, a, b: F.when(holds(t, *a), F.translate(t, a, b)).otherwise(t)
    without_json = lambda t: F.regexp_replace(F.regexp_replace(t, r"\{['\"]transcription['\"]\s*:\s*['\"](.+?)['\"]\}", "$1"), r"\{.*?\}", "")
    chain = [
        (on.apostrophe, lambda t: translated(t, "ʻʼ’", "'''")),
        (on.num_words, number_words),
        (on.double_space, lambda t: strip(replace_where(holds(t, "  "), t, " {2,}", " "))),
        (on.clean_json, lambda t: strip(F.when(holds(t, "{"), without_json(t)).otherwise(t))),
        (on.brackets, lambda t: strip(replace_where(holds(t, "["), t, r"\[.*?\]", ""))),
        (on.html, lambda t: strip(replace_where(holds(t, "<"), t, "<[^>]+>", ""))),
        (on.duplicate, _halves),
        (on.multi_comma, lambda t: replace_where(holds(t, ",,"), t, ",{2,}", ",")),
        (on.broken_hyphen, lambda t: replace_where(holds(t, "-"), t, r"(?U)(\w)-\s+(\w)", "$1-$2")),
        (on.dash, lambda t: F.replace(t, F.lit(" - "), F.lit(" — "))),
        (on.ellipsis, lambda t: F.replace(t, F.lit("..."), F.lit("…"))),
        (on.quotes, lambda t: translated(t, "“”‘’", "\"\"''")),
        (on.capitalize, upper_first),
        (on.sentence_case, lambda t: rewrite(t, r"(?U)[.!?]\s+[a-záéíóú]", F.upper)),
        (on.punct, lambda t: F.when(F.right(t, F.lit(1)).isin("", ".", "!", "?", "…"), t).otherwise(F.concat(t, F.lit(".")))),
    ]
    return [step for wanted, step in chain if wanted]


def normalised_text(text: Column, on: Normaliser = Normaliser()) -> Column:
    """A struct of the normalised text (t) and the reason for dropping it (why; null: keep). Each step's result is bound once."""

    def judged(t: Column) -> Column:
        why = (
            F.when(blank(text), "empty text")
            .when(F.lit(on.only_digits) & only_of(strip(t), r"\d\s.,"), "only digits")
            .when(F.lit(on.cyrillic) & may_be_cyrillic(t) & t.rlike("[а-яёА-ЯЁ]"), "cyrillic detected")
            .when(blank(t), "empty after normalization")
        )
        return F.struct(F.when(blank(text), F.coalesce(text, F.lit(""))).otherwise(t).alias("t"), why.alias("why"))

    return let(reduce(let, steps(on), F.coalesce(text, F.lit(""))), judged)


def normalised(df: DataFrame, text: str, to: str = "normalized", reason: str = "drop_reason", on: Normaliser = Normaliser()) -> DataFrame:
    """Adds the normalised text and the reason for dropping it (null: keep)."""
    both = normalised_text(F.col(text), on)
    name = "_both"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, both).withColumns({to: F.col(name)["t"], reason: F.col(name)["why"]}).drop(name)
