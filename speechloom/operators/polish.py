"""The local polisher: artefacts, fillers, stutters, repeated halves, numbers, letter case."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.functions.expr import blank, holds, let, may_be_cyrillic, replace_where, rewrite, strip, upper_first
from speechloom.functions.numbers import protected_number_words
from speechloom.functions.similarity import dedup_half

# Patterns of what transcripts hold besides speech, and of fillers in three languages.
JSON_ARTEFACT = r"(?s)\{(?:['\"]transcription['\"]\s*:\s*['\"](.+?)['\"]\}|[^}]{0,200}\})"
STT_TAGS = r"(?i)\[\s*(?:MUSIQA_BOR|KO'P_OVOZ|TUSHUNARSIZ|SHOVQIN|GUDOK|MUSIC|NOISE)\s*\]"
TAG = r"</?[a-zA-Z][^>]{0,60}>"
# The first takes two letters by plain classes, which pass over a text fastest, and looks behind them only where they fit.
FILLERS = [
    r"[mMuUaAeEhH][mMhHrReEgG](?<![a-zA-Z]..)(?iU)(?<!\w..)(?:(?<=mm|um|hm)m*|(?<=uh|ah|eh)h*|(?<=ug|ee)h+|(?<=er)r*)(?!\w)",
    r"(?iU)(?<!\w)([aeiouy])\1{2,}(?!\w)",
    r"(?iU)(?<!\w)[aeiouy]h{3,}(?!\w)",
    r"(?iU)(?<!\w)(he-?he|ha-?ha|i-?i|o-?o|a-?a)(?!\w)|(?<![a-zA-Z'])xo'sh(?!\w)",
    r"(?iU)(?<!\w)(ну|вот|эм+|э-э+|короче|значит|ладно)(?!\w)",
]
# The fourth in plain letters, for texts without letters that Unicode takes for i or s.
FILLERS_UZ = r"[hHiIoOaAxX][eEaAiIoO\-](?<![a-zA-Z]..)(?iU)(?:(?<!\w..)(?:(?<=he)-?he|(?<=ha)-?ha|(?<=ii|oo|aa)|(?<=i-)i|(?<=o-)o|(?<=a-)a)|(?<![a-zA-Z']..)(?<=xo)'sh)(?!\w)"
LIKE_I, LIKE_S = "\u0130\u0131", "\u017f"
VOWELS = r"(?i)([aeiouy])(?:\1\1|hhh)"
STUTTER = r"(?iU)\b(\w{2,}+)(?:\s+\1){2,}\b"


@dataclass(frozen=True)
class Polisher:
    numbers: bool = True
    punctuation: bool = True
    apostrophe: bool = True
    artefacts: bool = True


def _without_json(t: Column) -> Column:
    """Unwraps a transcript that came as JSON, and drops other short braces; matches may cross lines."""
    inner = lambda m: strip(F.regexp_extract(m, JSON_ARTEFACT, 1))
    return strip(F.when(holds(t, "{"), rewrite(t, JSON_ARTEFACT, inner)).otherwise(t))


def _joined_marks(t: Column) -> Column:
    # Neither of the first two makes anything that the others look for, so the text as it came tells all three.
    commas = replace_where(holds(t, ",,"), t, ",{2,}", ",")
    joined = replace_where(holds(t, "-") & t.rlike(r"(?U)-\s"), commas, r"(?U)(\w)-\s+(\w)", "$1-$2")
    return strip(replace_where(holds(t, "  "), joined, " {2,}", " "))


def _without_vowels(t: Column) -> Column:
    """Without vowels that are drawn out, alone or with h."""
    without = F.regexp_replace(F.regexp_replace(t, FILLERS[1], ""), FILLERS[2], "")
    return F.when(holds(t, *LIKE_I) | t.rlike(VOWELS), without).otherwise(t)


def _without_fillers_uz(t: Column) -> Column:
    return F.when(holds(t, *LIKE_I, LIKE_S), F.regexp_replace(t, FILLERS[3], "")).otherwise(F.regexp_replace(t, FILLERS_UZ, ""))


#: The steps by name, in their order, which matters; dedup_half stands for the repeated half.
STEPS = {
    "json": _without_json,
    "tags": lambda t: strip(replace_where(holds(t, "["), t, STT_TAGS, "")),
    "html": lambda t: strip(replace_where(holds(t, "<"), t, TAG, "")),
    "apostrophe": lambda t: F.when(holds(t, *"ʻʼ`´"), F.translate(t, "ʻʼ`´", "''''")).otherwise(t),
    "fillers_en": lambda t: F.regexp_replace(t, FILLERS[0], ""),
    "vowels": _without_vowels,
    "fillers_uz": _without_fillers_uz,
    "fillers_ru": lambda t: replace_where(may_be_cyrillic(t), t, FILLERS[4], ""),
    "stutter": lambda t: F.regexp_replace(t, STUTTER, "$1"),
    "half": dedup_half,
    "marks": _joined_marks,
    "numbers": protected_number_words,
    "first_upper": upper_first,
    "sentences": lambda t: rewrite(t, r"(?U)[.!?]\s+[a-z]", F.upper),
}


def steps(on: Polisher) -> tuple[list, list]:
    """The steps that are switched on, in their order, before and after the repeated half goes."""
    off = {"json": on.artefacts, "tags": on.artefacts, "html": on.artefacts, "apostrophe": on.apostrophe, "numbers": on.numbers, "first_upper": on.punctuation, "sentences": on.punctuation}
    names = [n for n in STEPS if off.get(n, True)]
    at = names.index("half")
    return [strip, *(STEPS[n] for n in names[:at])], [*(STEPS[n] for n in names[at + 1 :]), strip]


def polished(df: DataFrame, text: str, to: str = "polished", on: Polisher = Polisher()) -> DataFrame:
    """Adds the polished text; a blank text stays as it is, a null one null.

    Each step's result is bound once, so the plan's size is the sum of its steps, however often one uses its input.
    """
    before, after = steps(on)
    name = "_half"
    while name in df.columns:
        name += "_"
    out = df.withColumn(name, reduce(let, before, F.col(text)))
    out = out.withColumn(name, dedup_half(F.col(name)))
    return out.withColumn(to, F.when(blank(F.col(text)), F.col(text)).otherwise(reduce(let, after, F.col(name)))).drop(name)
