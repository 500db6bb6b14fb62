"""Token measures: repetition, subsequences, runs, change ratios, script shares."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from speechloom.functions.expr import WHITE_SPACE, let, may_be_cyrillic, round_even, tokens
from speechloom.functions.numbers import protected_number_words

# Spellings that count as the same word when two texts are compared.
SYNONYMS = {
    "xam": "ham",
    "xar": "har",
    "xech": "hech",
    "xamma": "hamma",
    "xali": "hali",
    "yani": "ya'ni",
    "dema": "demak",
    "kyin": "keyin",
    "nul": "nol",
    "zero": "nol",
    "xop": "xo'p",
    "hop": "xo'p",
    "mayle": "mayli",
    "mayo": "mayli",
    "bilann": "bilan",
    "uchin": "uchun",
    "uchinn": "uchun",
}
# Fixed value: marks that are dropped from tokens before they are compared.
TOKEN_MARKS = r"[.,!?;:'\"«»\-]+"


def repeat_ratio(text: Column) -> Column:
    """Percentage of tokens that repeat another, one digit; 100 for an empty text."""
    share = lambda t: F.when(F.size(t) == 0, 100.0).otherwise(round_even((1 - F.size(F.array_distinct(t)) / F.size(t)) * 100, 1))
    return let(tokens(F.lower(text)), share)


def clean_tokens(text: Column) -> Column:
    """Tokens in lower case without marks. Marks go from the whole text first: no call for each token."""
    return tokens(F.lower(F.regexp_replace(text, TOKEN_MARKS, "")))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def same_ends(a: list, b: list) -> tuple[int, int]:
    """How many tokens are equal from the front, and from the back, each counted alone."""
    count = lambda pairs: next((i for i, (x, y) in enumerate(pairs) if x != y), min(len(a), len(b)))
    return count(zip(a, b, strict=False)), count(zip(reversed(a), reversed(b), strict=False))


#: Tokens put in or left out that few_edits follows.
EDITS = 16


def few_edits(a: list, b: list) -> tuple[int | None, int]:
    """Of two texts that differ in few tokens: their longest common subsequence, by the shortest way from one to the other, each
    edit's farthest place on every diagonal; of others, none. And the longest run met on the way, which may not be the longest."""
    n, m, longest = len(a), len(b), 0
    ends = {1: 0}
    for edits in range(EDITS + 1):
        for k in range(-edits, edits + 1, 2):
            x = start = ends[k + 1] if k == -edits or k != edits and ends[k - 1] < ends[k + 1] else ends[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ends[k], longest = x, max(longest, x - start)
            if x >= n and y >= m:
                return (n + m - edits) // 2, longest
    return None, longest


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence. Equal ends belong to one; between them, where texts differ in more than a few tokens, a row of
    the table at a time as the bits of one integer."""
    head, tail = same_ends(a, b)
    tail = min(tail, min(len(a), len(b)) - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    if (found := few_edits(a, b)[0]) is not None:
        return head + tail + found
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return head + tail + len(a) - row.bit_count()


#: Tokens that run_length compares, a token of both texts, before it builds the automaton.
TRIED = 16


def run_length(a: list, b: list) -> int:
    """Longest run of equal tokens side by side. Equal ends are one run, and so is what a few edits leave; whether there is a longer
    one is tried by windows of growing length, as long as few stay, and else told by the automaton; so time grows with both lengths."""
    size, most, left = max(same_ends(a, b)), min(len(a), len(b)), TRIED * (len(a) + len(b))
    if size < most:
        size = max(size, few_edits(a, b)[1])
    ours, theirs = range(len(a) - size), range(len(b) - size)
    while size < most:
        size += 1
        left -= size * (len(ours) + len(theirs))
        if left < 0:
            return automaton_run_length(a, b)
        window = lambda t, i, n=size: tuple(t[i : i + n])
        known = {window(b, j) for j in theirs}
        ours = [i for i in ours if window(a, i) in known]
        if not ours:
            return size - 1
        known = {window(a, i) for i in ours}
        theirs = [j for j in theirs if window(b, j) in known]
        ours, theirs = [i for i in ours if i + size < len(a)], [j for j in theirs if j + size < len(b)]
    return size


def automaton_run_length(a: list, b: list) -> int:
    """The longest run: b read by the automaton of all runs of a, in time that grows with both lengths."""
    # State 0 is the empty run; of each state: the next one by token, the state of its longest shorter ending, its length.
    follow: list[dict] = [{}]
    link, size, last = [-1], [0], 0
    for t in a:
        now, at = len(follow), last
        follow.append({})
        link.append(0)
        size.append(size[last] + 1)
        while at >= 0 and t not in follow[at]:
            follow[at][t] = now
            at = link[at]
        if at >= 0:
            to = follow[at][t]
            if size[to] == size[at] + 1:
                link[now] = to
            else:
                copy = len(follow)
                follow.append(follow[to].copy())
                link.append(link[to])
                size.append(size[at] + 1)
                while at >= 0 and follow[at].get(t) == to:
                    follow[at][t] = copy
                    at = link[at]
                link[to] = link[now] = copy
        last = now
    best = state = length = 0
    for t in b:
        while state and t not in follow[state]:
            state = link[state]
            length = size[state]
        if t in follow[state]:
            state, length = follow[state][t], length + 1
        best = max(best, length)
    return best


#: Rows whose tokens become numbers at once.
NUMBERED = 32


def numbered(a: pa.Array, b: pa.Array) -> Iterator[tuple[list[int], list[int]]]:
    """The lists of each row as numbers, equal ones for equal tokens of a row (a null list is empty). Few rows of a batch are
    numbered at once, so a batch takes little besides what came in."""
    for first in range(0, len(a), NUMBERED):
        x, y = a.slice(first, NUMBERED), b.slice(first, NUMBERED)
        codes = pa.concat_arrays([x.flatten(), y.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy()
        sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in (x, y)]
        at, to = 0, int(sizes[0].sum())
        for n, m in zip(*sizes, strict=True):
            yield codes[at : at + n].tolist(), codes[to : to + m].tolist()
            at, to = at + n, to + m


def _over_longer(f: Callable[[list, list], int], x: list, y: list) -> float:
    return f(x, y) / max(len(x), len(y)) if x and y else 0.0


def run_ratio(a: Column, b: Column) -> Column:
    """Longest run of equal tokens over the longer length, of whole texts, in Arrow batches; 0 where one has no token."""

    def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([_over_longer(run_length, x, y) for x, y in numbered(a, b)], pa.float64())

    return F.arrow_udf(ratio, "double")(a, b)


def order_ratios(a: Column, b: Column) -> Column:
    """lcs_ratio and run_ratio (lcs, run) of whole texts, in Arrow batches."""

    def both(a: pa.Array, b: pa.Array) -> pa.Array:
        found = [(_over_longer(lcs_length, x, y), _over_longer(run_length, x, y)) for x, y in numbered(a, b)]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.float64()) for i in range(2)], ["lcs", "run"])

    return F.arrow_udf(both, "lcs double, run double")(a, b)


#: White space of plain Python that Unicode doesn't count, and all that Unicode counts.
_OTHER_SPACE, _SPACE = re.compile("[\x1c-\x1f]"), re.compile(f"[{WHITE_SPACE}]+")
_MARKS = re.compile(TOKEN_MARKS)


def _split(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _OTHER_SPACE.search(text) else text.split()


def says_twice(text: str, jaccard_min: float, lcs_min: float, run_min: float) -> bool:
    """Whether the halves of a text's tokens agree in sets, order and runs, without case and marks."""
    words = _split(text)
    n = len(words) // 2
    if n < 4:
        return False
    a, b = (_split(_MARKS.sub("", " ".join(half)).lower()) for half in (words[:n], words[n:]))
    if not a or not b:
        return False
    ours, theirs = set(a), set(b)
    both = len(ours & theirs)
    if both / (len(ours) + len(theirs) - both) < jaccard_min:
        return False
    return a == b or _over_longer(lcs_length, a, b) >= lcs_min and _over_longer(run_length, a, b) >= run_min


def dedup_half(text: Column, jaccard_min: float = 0.82, lcs_min: float = 0.70, run_min: float = 0.40) -> Column:
    """The first half of a text whose second half says the same again: sets, order and runs of tokens must all agree.

    Texts are compared in Arrow batches, one at a time; the half is cut where they agree.
    """

    def agree(texts: pa.Array) -> pa.Array:
        return pa.array([t is not None and says_twice(t, jaccard_min, lcs_min, run_min) for t in (x.as_py() for x in texts)], pa.bool_())

    half = lambda words: F.array_join(F.slice(words, F.lit(1), F.floor(F.size(words) / 2).cast("int")), " ")
    # Called non-deterministic so that filters on what is made of it aren't pushed below it: they would take the batch function
    # into their lambdas, where it can't run.
    same = F.arrow_udf(agree, "boolean").asNondeterministic()(text)
    return F.when(same, let(tokens(text), half)).otherwise(text)


def comparable_tokens(text: Column) -> Column:
    """The distinct tokens of a text with numbers in words, marks dropped, and synonyms brought together."""
    known = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    one = lambda w: F.when(w.isin(list(SYNONYMS)), F.try_element_at(known, w)).otherwise(w)
    return F.array_distinct(F.transform(F.array_distinct(clean_tokens(protected_number_words(text))), one))


def change_ratio(original: Column, changed: Column) -> Column:
    """Percentage of comparable tokens in only one of two texts, over the larger set, one digit; 100 for an empty original."""
    # Equal texts have equal tokens; whether there is any, a character that is neither white space nor a mark tells.
    some = F.coalesce(original, F.lit("")).rlike(rf"(?U)[^\s{TOKEN_MARKS[1:-2]}]")
    ratio = let(F.struct(comparable_tokens(original).alias("a"), comparable_tokens(changed).alias("b")), lambda s: _difference(s["a"], s["b"], F.greatest(F.size(s["a"]), F.size(s["b"]))))
    return F.when(original.eqNullSafe(changed), F.when(some, 0.0).otherwise(100.0)).otherwise(ratio)


def simple_change_ratio(original: Column, changed: Column) -> Column:
    """The plain form: lower-case tokens, over the original's set (so it can pass 100)."""
    plain = lambda t: F.array_distinct(tokens(F.lower(t)))
    return let(F.struct(plain(original).alias("a"), plain(changed).alias("b")), lambda s: _difference(s["a"], s["b"], F.size(s["a"])))


def _difference(a: Column, b: Column, over: Column) -> Column:
    apart = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return F.when(F.size(a) == 0, 100.0).otherwise(round_even(apart / F.greatest(over, F.lit(1)) * 100, 1))


def cyrillic_word_ratio(text: Column) -> Column:
    """Share of tokens whose letters are Cyrillic by more than half."""
    some = "[а-яёА-ЯЁ]"
    letters = lambda w: F.length(F.regexp_replace(w, r"\P{L}+", ""))
    cyrillic = lambda w: F.length(F.regexp_replace(w, r"[^а-яёА-ЯЁ]+", ""))
    dominant = lambda t: F.size(F.filter(t, lambda w: w.rlike(some) & (cyrillic(w) * 2 > letters(w))))
    share = lambda t: F.when(F.size(t) == 0, 0.0).otherwise(dominant(t) / F.size(t))
    # Most texts have no such letter: they are looked through once.
    return let(text, lambda t: F.when(t.isNull() | may_be_cyrillic(t) & t.rlike(some), let(tokens(t), share)).otherwise(0.0))


def mixed_scripts(text: Column) -> Column:
    """Cyrillic and Latin letters both, and more than 0.3 runs of Latin letters a token."""
    runs = F.regexp_count(text, F.lit("[a-zA-Z]+"))
    share = runs / F.greatest(F.size(tokens(text)), F.lit(1))
    return may_be_cyrillic(text) & text.rlike("[а-яёА-ЯЁ]") & text.rlike("[a-zA-Z]") & (share > 0.3)
