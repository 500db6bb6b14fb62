"""Integers as Uzbek words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechloom.functions.expr import cut, let, rewrite

# Uzbek number words.
ONES = ["", "bir", "ikki", "uch", "to'rt", "besh", "olti", "yetti", "sakkiz", "to'qqiz"]
TENS = ["", "o'n", "yigirma", "o'ttiz", "qirq", "ellik", "oltmish", "yetmish", "sakson", "to'qson"]
ZERO, HUNDRED, THOUSAND, MILLION = "nol", "yuz", "ming", "million"
ORDINALS = ["birinchi", "ikkinchi", "uchinchi", "to'rtinchi", "beshinchi", "oltinchi", "yettinchi", "sakkizinchi", "to'qqizinchi", "o'ninchi"]
ORDINAL_ENDINGS = ["chi", "nchi", "inchi", "unchi", "inci"]

# What protected number rewriting leaves alone, in this order: telephone, date, time, year, decimal.
PROTECTED = [
    r"\+?\d[\d\s\-()]{6,}\d",
    r"\b\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\b",
    r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
    r"\b(?:1[5-9]\d{2}|20[0-4]\d)\b",
    r"\b\d+[.,]\d+\b",
]
INTEGER = r"(?U)\b\d+\b"
DIGIT = r"\p{Nd}"
#: Tokens with a digit that follow each other, or with tokens of hyphens and brackets alone between them, as in telephone
#: numbers. Of what stands before the first digit in its token one character is enough: a plus, or what tells whether a word begins.
DIGITS = r"(?U)\S?\d\S*+(?:\s++(?:[\-()]++\s++)*+[\S&&\D]*+\d\S*+)*"
#: Digits that fit a long.
MOST_DIGITS = 18


def _words(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def _div(n: Column, by: int) -> Column:
    return F.call_function("div", n, F.lit(by))


def _pick(words: list[str], i: Column) -> Column:
    # Folds to one literal; an array of literals would make the expression several times as large.
    return F.get(F.split(F.lit("|".join(words)), "[|]"), i.cast("int"))


def _below_thousand(n: Column) -> Column:
    hundreds = F.when(n >= 100, F.concat(_pick(ONES, _div(n, 100)), F.lit(" " + HUNDRED))).otherwise("")
    return _words(hundreds, _pick(TENS, _div(n % 100, 10)), _pick(ONES, n % 10))


def _below_million(n: Column) -> Column:
    thousands = F.when(n >= 1000, F.concat(_below_thousand(_div(n, 1000)), F.lit(" " + THOUSAND))).otherwise("")
    return _words(thousands, _below_thousand(n % 1000))


def int_to_words(n: Column, millions: int = 2) -> Column:
    """Words of a long from 0 to 10**18 - 1 (with millions=1: 10**12 - 1), read in millions (of millions)."""

    def split(n: Column, deeper: int) -> Column:
        if not deeper:
            return _below_million(n)
        rest = let(n % 1_000_000, _below_million)
        high = let(_div(n, 1_000_000), lambda h: split(h, deeper - 1))
        return F.when(n >= 1_000_000, _words(F.concat(high, F.lit(" " + MILLION)), rest)).otherwise(let(n, _below_million))

    return F.when(n == 0, ZERO).otherwise(let(n, lambda m: split(m, millions)))


def number_words(text: Column) -> Column:
    """Every whole number of a text in words; longer ones than MOST_DIGITS stay as they are."""
    known = lambda m: F.when(F.length(m) <= MOST_DIGITS, let(m.cast("long"), int_to_words)).otherwise(m)
    return rewrite(text, INTEGER, known, DIGIT)


def _short_words(digits: Column) -> Column:
    return F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 9, let(digits.cast("decimal(38,0)").cast("long"), lambda n: int_to_words(n, 1))).otherwise(digits)


def protected_number_words(text: Column) -> Column:
    """Numbers in words except telephone numbers, dates, times, years 1500-2049 and decimals; ordinals (5-chi) become ordinal words.

    Protected parts are set aside in passes, each over what the passes before have left: a text is a list of pieces, and
    only free pieces are looked at by later passes. All this is done for tokens with digits alone, each row of them on its own, as
    nothing protected reaches over other tokens: a text without digits is looked through once.
    """
    return rewrite(F.coalesce(text, F.lit("")), DIGITS, lambda m: let(m, _protected_number_words), DIGIT)


def _protected_number_words(text: Column) -> Column:
    piece = lambda t, free: F.struct(t.alias("t"), free.alias("free"))

    def set_aside(pieces: Column, pattern: str) -> Column:
        def both(s: Column) -> Column:
            pair = lambda part, i: F.array(piece(part, F.lit(True)), piece(F.coalesce(F.get(s["found"], i), F.lit("")), F.lit(False)))
            return F.flatten(F.transform(s["parts"], pair))

        def apart(p: Column) -> Column:
            return F.when(p["free"] & p["t"].rlike(DIGIT) & p["t"].rlike(pattern), let(cut(p["t"], pattern), both)).otherwise(F.array(p))

        return F.flatten(F.transform(pieces, apart))

    # What was set aside counts as word characters to its neighbours, as a placeholder would: \b and look-arounds see it.
    pieces = F.array(piece(text, F.lit(True)))
    for pattern in PROTECTED:
        # All begin with a digit or a plus: looking for that first passes over other characters at once.
        pieces = set_aside(pieces, r"(?U)(?=[+\d])" + pattern)
    ordinal = rf"(?iU)\b(\d+)-({'|'.join(ORDINAL_ENDINGS)})\b"
    known = F.array(*map(F.lit, ORDINALS))

    def as_ordinal(m: Column) -> Column:
        digits = F.regexp_extract(m, r"\d+", 0)
        n = F.try_to_number(F.right(F.concat(F.lit("0" * 18), digits), F.lit(18)), F.lit("9" * 18)).cast("long")
        return F.when((n >= 1) & (n <= 10), F.get(known, (n - 1).cast("int"))).otherwise(F.concat(_short_words(digits), F.lit("-nchi")))

    free = lambda t: rewrite(rewrite(t, ordinal, as_ordinal), INTEGER, _short_words, DIGIT)
    return F.array_join(F.transform(pieces, lambda p: F.when(p["free"], free(p["t"])).otherwise(p["t"])), "")
