"""Secret scans: spans that look like credentials, by form and by the entropy of what they are made of.

Three forms are fixed (assignments to telling names, access key ids, long lower-case hexadecimal strings). Beside them every
candidate, a long stretch of letters, digits and the marks of base 64, is gone through with a window for each character
class: counts, and the sum of count * log(count), change by one character in and one out, so a window costs the same at any
length. Windows above their class's entropy join into spans, unless the candidate is of a kind on the allow list.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import bound_batches, map_columns, texts

# The forms of the base spans, and the least length of what each must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")

#: Without one of these in it, in lower case, a text holds no assignment.
_NAMES = ("passw", "secret", "token", "api")
#: Both fixed forms but assignments, and all windows, lie in a stretch of these that is at least so long.
SHORTEST = 20
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}")


class Class(NamedTuple):
    """A character class: its window, the bits a character that make it suspicious, and the groups a window must hold."""

    alphabet: re.Pattern
    window: int
    bits: float
    groups: tuple[str, ...]


UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Of random strings all but a few in ten thousand windows are above; words and names of 20 letters hold 3.0 to 3.8 bits.
CLASSES = (
    Class(re.compile("[0-9A-Fa-f]+"), 32, 3.0, (DIGIT, UPPER + LOWER)),
    Class(re.compile("[0-9A-Za-z]+"), 20, 3.75, (DIGIT, UPPER, LOWER)),
    Class(re.compile("[0-9A-Za-z+/_=-]+"), 32, 4.1, (DIGIT, UPPER, LOWER)),
)

#: Harmless though of many different characters. The last one is a name put together from words. A pattern sees the candidate behind up to BEFORE characters of what precedes it, and ends with it.
BEFORE = 80
ALLOWED = (
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    re.compile(r"(?:sha(?:1|256|384|512)|md5|integrity)[\"']?\s*[-:=]\s*[\"']?(?:sha(?:256|384|512)-)?[A-Za-z0-9+/_=-]+", re.IGNORECASE),
    re.compile(r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/_=-]+", re.IGNORECASE),
    re.compile(r"(?:https?|ftp)://[^\s\"'<>?]*", re.IGNORECASE),
    re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Z][a-z]{2,}+|[a-z]{3,}+|(?:By|Id|In|Is|Of|On|To|Up)(?![a-z])|[0-9]{1,4}+(?![0-9])|[/_-])++"),
)

#: Harmless anywhere in a candidate.
SAMPLES = re.compile("EXAMPLE|PLACEHOLDER|abcdefghijklmnop|ABCDEFGHIJKLMNOP|0123456789")

_UNIT = 1 << 32
_STEP = [0] * 4096
_STEP[:] = [round(_UNIT * (c + 1) * math.log2(c + 1)) - (round(_UNIT * c * math.log2(c)) if c else 0) for c in range(len(_STEP))]


def random_windows(s: str, window: int, bits: float, groups: tuple[str, ...]) -> list[tuple[int, int]]:
    """The stretches of a string that windows above so many bits cover. Sums are whole numbers, so nothing drifts."""
    most = (math.log2(window) - bits) * window * _UNIT
    of = {c: i for i, g in enumerate(groups) for c in g}
    counts, held, total = dict.fromkeys(s, 0), [0] * (len(groups) + 1), 0
    out: list[tuple[int, int]] = []
    for at, c in enumerate(s):
        total += _STEP[counts[c]]
        counts[c] += 1
        held[of.get(c, -1)] += 1
        begin = at + 1 - window
        if begin < 0:
            continue
        if total <= most and all(held[:-1]):
            if out and out[-1][1] >= begin:
                out[-1] = out[-1][0], at + 1
            else:
                out.append((begin, at + 1))
        first = s[begin]
        counts[first] -= 1
        total -= _STEP[counts[first]]
        held[of.get(first, -1)] -= 1
    return out


def allowed(text: str, start: int, end: int) -> bool:
    """Whether a candidate is of a kind on the allow list, by itself or with what precedes it."""
    seen = text[max(0, start - BEFORE) : end]
    return SAMPLES.search(text, start, end) is not None or any(m.end() == len(seen) for p in ALLOWED for m in p.finditer(seen))


def base_spans(text: str, candidates: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Of each form the leftmost matches that don't overlap, without those that are too short."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for start, end in candidates:
        for kind, form in (("access", ACCESS), ("hex", HEX)):
            out += [(kind, *m.span()) for m in form.finditer(text, start, end) if m.end() - m.start() >= LEAST[kind]]
    return out


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a whole text, in code points, ordered by start, then kind as listed. Spans of entropy that lie
    within a base span say nothing new and are left out."""
    candidates = [m.span() for m in _CANDIDATE.finditer(text)]
    found = base_spans(text, candidates)
    more: set[tuple[int, int]] = set()
    for start, end in candidates:
        own = {
            (start + m.start() + a, start + m.start() + b)
            for c in CLASSES
            for m in c.alphabet.finditer(text[start:end])
            if m.end() - m.start() >= c.window
            for a, b in random_windows(m[0], c.window, c.bits, c.groups)
        }
        if own and not allowed(text, start, end):
            more |= own
    joined: list[tuple[int, int]] = []
    for a, b in sorted(more):
        if joined and a <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(b, joined[-1][1])
        else:
            joined.append((a, b))
    found += [("entropy", a, b) for a, b in joined if not any(x <= a and b <= y for _, x, y in found)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of its whole text: array<struct<kind, start, end>>, offsets in code points, end exclusive.

    Null and empty texts have none; texts of any length are gone through in one pass; repeated rows are scanned each for
    itself; an empty table gives an empty one; other columns are left out.
    """
    bound_batches(docs.sparkSession)

    def make(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "spans": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t)] for t in b["text"]]}

    return map_columns(texts(docs, "doc_id"), "doc_id long, spans array<struct<kind string, start long, end long>>", make)


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as one string."""
    rows = scanned(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = listed(F.filter("spans", lambda s: s["kind"] != "entropy"))
    return rows.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
