"""Combinators: binding a value once, rewriting regex matches by an expression, tokens."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def holds(text: Column, *parts: str) -> Column:
    """Whether a text holds one of some strings: bytes are compared, many times as fast as a regular expression looks."""
    return reduce(or_, [text.contains(p) for p in parts])


def may_be_cyrillic(text: Column) -> Column:
    """False only of texts without a Cyrillic letter of U+0400 to U+047F or U+1C80 to U+1C88: by the first bytes of such letters,
    which are no letter's later bytes."""
    return reduce(or_, [F.contains(text.cast("binary"), F.lit(b)) for b in (b"\xd0", b"\xd1", b"\xe1\xb2")])


def replace_where(needed: Column, text: Column, pattern: str, by: str) -> Column:
    """regexp_replace where it is needed: for texts that are bound, as they are used twice."""
    return F.when(needed, F.regexp_replace(text, pattern, by)).otherwise(text)


def rewrite(text: Column, pattern: str, replace: Callable[[Column], Column], needs: str | None = None) -> Column:
    """Every match of pattern (no empty ones) replaced by an expression of the match: the callback form that regexp_replace
    lacks. needs: a cheap pattern without which there is no match, asked for in place of the pattern."""

    def put_together(s: Column) -> Column:
        return F.array_join(F.transform(s["parts"], lambda part, i: F.concat(part, F.coalesce(replace(F.get(s["found"], i)), F.lit("")))), "")

    return let(text, lambda t: F.when(t.rlike(needs or pattern), let(cut(t, pattern), put_together)).otherwise(t))


def cut(text: Column, pattern: str) -> Column:
    """What lies between the matches of a pattern (parts) and the matches (found)."""
    return F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))


#: Fixed value: the characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind. Only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def tokens(text: Column) -> Column:
    """White-space tokens; none of an empty text."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def fewer_tokens(text: Column, n: int) -> Column:
    """Whether a text has fewer than n tokens: only its first n are looked at."""
    return ~text.rlike(rf"(?U)\A\s*+(?:\S++\s++){{{n - 1}}}\S") if n > 0 else F.lit(False)


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def only_of(text: Column, kind: str) -> Column:
    """Whether a text has characters of a class alone, and some; of most texts the first one tells that it hasn't."""
    return F.substring(text, 1, 1).rlike(f"(?U)[{kind}]") & text.rlike(f"(?U)^[{kind}]+$")


def round_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


#: Letters whose upper case Unicode spells with several characters but that have a capital of one character.
MANY_UPPER = "ß" + "".join(c for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > len(c.title()) == 1)
ONE_UPPER = "\u1e9e" + "".join(c.title() for c in MANY_UPPER[1:])


def upper_first(text: Column) -> Column:
    """The first character as one capital, the rest untouched; a letter without such a capital stays."""
    first = F.substring(text, 1, 1)
    upper = F.upper(first)
    capital = F.when(F.length(upper) > 1, F.translate(first, MANY_UPPER, ONE_UPPER)).otherwise(upper)
    return F.concat(capital, F.substring(text, 2, 1 << 30))
