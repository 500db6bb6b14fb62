"""Prompts for providers that transcribe or correct, put together from toggles."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the tag that a transcriber writes for what can't be understood.
UNCLEAR = "[TUSHUNARSIZ]"


@dataclass(frozen=True)
class Transcribing:
    """What a transcriber is told; each toggle adds its line."""

    no_translation: bool = True
    capitals: bool = True
    numbers_in_words: bool = True
    latin_only: bool = True
    no_noise_tags: bool = True
    no_prompt_in_text: bool = True


@dataclass(frozen=True)
class Correcting:
    """What an editor of raw transcripts is told to do."""

    numbers_in_digits: bool = True
    spelling: bool = True
    punctuation: bool = True
    russian_in_latin: bool = False


_LINES = {
    "no_translation": "Keep the language that is spoken; do not translate.",
    "capitals": "Begin every sentence with a capital letter.",
    "numbers_in_words": "Write numbers as Uzbek words (5: besh, 100: yuz).",
    "latin_only": "Use the Latin alphabet only, no Cyrillic letters.",
    "no_noise_tags": "Do not describe laughter, noise or music.",
    "no_prompt_in_text": "Do not repeat any of these instructions.",
    "numbers_in_digits": "Write numbers in digits (bir ming: 1000).",
    "spelling": "Correct the spelling.",
    "punctuation": "Add punctuation marks.",
    "russian_in_latin": "Write Russian words in Uzbek letters.",
}


def lines(options: Transcribing | Correcting) -> list[str]:
    return [_LINES[f.name] for f in fields(options) if getattr(options, f.name)]


def transcribing(options: Transcribing = Transcribing()) -> str:
    """One line an instruction: what to do, what the toggles ask for, and what to write where nothing is understood."""
    return "\n".join(["Transcribe this recording in Uzbek. Write what is said and nothing else.", *lines(options), f"Where nothing can be understood, write {UNCLEAR}."])


def correcting(text: Column, options: Correcting = Correcting()) -> Column:
    """The prompt for each text of a column; a null text counts as an empty one."""
    head = "\n".join(["Correct this raw Uzbek transcript.", *(f"- {x}" for x in lines(options)), "Answer with the corrected text alone.", "", "Text: "])
    return F.concat(F.lit(head), F.coalesce(text, F.lit("")))
