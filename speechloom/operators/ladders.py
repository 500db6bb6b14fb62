"""Rejection ladders: one reason code a row, null where it passes; the first rule that fails wins.

The codes are stable; the display text of a reason is made from them where it is wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechloom.functions.expr import blank, fewer_tokens, let, only_of, strip
from speechloom.functions.similarity import cyrillic_word_ratio, mixed_scripts, repeat_ratio

# Texts that are noise, whatever their length; tags of unusable turns; blocks of other scripts.
NOISE = [r"^(mm+|uh+|ah+|eh+|um+|hmm+)[\s.,!?]*$", r"^\W+$", r"^\.{3,}$"]
# How each of these begins, in two characters.
NOISE_START = r"^(?:\W|mm|[uae]h|[uh]m)"
TRASH_TAGS = ["GUDOK", "SHOVQIN", "TINCH", "MUSIQA", "TUSHUNARSIZ"]
NON_LATIN = "[\u0400-\u04ff\u0500-\u052f\u2de0-\u2dff\ua640-\ua69f\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff]"


@dataclass(frozen=True)
class AudioLimits:
    """Bounds are inclusive; snr_min 0 switches that rule off; negative measurements (failed ones) pass."""

    duration_min: float = 3.0
    duration_max: float = 30.0
    snr_min: float = 15.0
    silence_max: float = 80.0
    check_language: bool = False
    language: str = "uz"

    @classmethod
    def of_toggles(cls, path: int, noisy: bool, silence: bool, duration_min: float | None = None, duration_max: float | None = None) -> AudioLimits:
        """Effective limits of a run's switches; a duration of 0 or none means the default."""
        return cls(duration_min or 3.0, duration_max or 30.0, 15.0 if noisy else 0.0, (80.0 if path == 1 else 70.0) if silence else 100.0)


@dataclass(frozen=True)
class TextLimits:
    words_min: int = 3
    repeat_max: float = 70.0
    noise: bool = True
    mixed: bool = False


PATH1_TEXT, PATH2_TEXT = TextLimits(), TextLimits(5, 50.0, True, True)


def first_of(*rules: tuple[str, Column]) -> Column:
    out = None
    for code, fails in rules:
        out = F.when(fails, code) if out is None else out.when(fails, code)
    return out


def audio_reason(duration: Column, snr: Column, silence: Column, limits: AudioLimits = AudioLimits(), language: Column | None = None) -> Column:
    rules = [
        ("too_short", F.coalesce(duration, F.lit(0.0)) < limits.duration_min),
        ("too_long", duration > limits.duration_max),
        ("low_snr", F.lit(limits.snr_min > 0) & (snr >= 0) & (snr < limits.snr_min)),
        ("silence", (silence > 0) & (silence > limits.silence_max)),
    ]
    if limits.check_language and language is not None:
        rules.append(("language", (language != limits.language) & (language != "unknown")))
    return first_of(*rules)


def measured_if_kept(duration: Column, measure: Column, limits: AudioLimits = AudioLimits()) -> Column:
    """A measurement that is never taken of rows that their duration rules out."""
    return F.when(duration.between(limits.duration_min, limits.duration_max), measure)


def is_noise(text: Column) -> Column:
    return let(strip(text), lambda t: F.substring(t, 1, 2).rlike("(?iU)" + NOISE_START) & t.rlike("(?iU)" + "|".join(NOISE)))


def is_trash(text: Column) -> Column:
    return strip(text).rlike(rf"(?i)^\[({'|'.join(TRASH_TAGS)})\]$")


def is_non_latin(text: Column) -> Column:
    return text.rlike(NON_LATIN)


def text_reason(text: Column, limits: TextLimits = PATH1_TEXT) -> Column:
    return first_of(
        ("empty", blank(text)),
        ("few_words", fewer_tokens(text, limits.words_min)),
        ("repeats", repeat_ratio(text) > limits.repeat_max),
        ("noise", F.lit(limits.noise) & is_noise(text)),
        ("mixed_scripts", F.lit(limits.mixed) & mixed_scripts(text)),
    )


def validity_reason(text: Column, words_min: int = 3, check_cyrillic: bool = False) -> Column:
    """After polishing. A short text passes with at least four characters besides marks and a closing mark."""
    exempt = (F.length(F.regexp_replace(text, r"(?U)[\s.,!?;:\-]", "")) >= 4) & F.right(strip(text), F.lit(1)).isin(".", "!", "?")
    return first_of(
        ("empty", blank(text)),
        ("few_words", fewer_tokens(text, words_min) & ~exempt),
        ("only_digits", only_of(text, r"\d\s.,")),
        ("only_symbols", only_of(text, r"\W\s")),
        ("cyrillic", F.lit(check_cyrillic) & (cyrillic_word_ratio(text) >= 0.30)),
    )


def ready_text_reason(duration: Column, text: Column, words_min: int = 2, limits: AudioLimits = AudioLimits()) -> Column:
    """For segments that came with their text; those that pass are approved."""
    return first_of(
        ("too_short", F.coalesce(duration, F.lit(0.0)) < limits.duration_min),
        ("too_long", duration > limits.duration_max),
        ("empty", blank(text)),
        ("few_words", fewer_tokens(text, words_min)),
    )


def reason_with_figures(duration: Column, snr: Column, silence: Column, limits: AudioLimits = AudioLimits()) -> Column:
    """The display text of the audio ladder's reason: the measurement and the limit it breaks; null where a row passes."""
    code = audio_reason(duration, snr, silence, limits)
    shown = lambda label, x, digits, unit, sign, limit: F.format_string(f"{label} (%.{digits}f{unit} {sign} %s{unit})", F.bround(x, digits), F.lit(f"{limit:g}"))
    return (
        F.when(code == "too_short", shown("too short", F.coalesce(duration, F.lit(0.0)), 1, " s", "<", limits.duration_min))
        .when(code == "too_long", shown("too long", duration, 1, " s", ">", limits.duration_max))
        .when(code == "low_snr", shown("low SNR", snr, 1, " dB", "<", limits.snr_min))
        .when(code == "silence", shown("mostly silence", silence, 0, "%%", ">", limits.silence_max))
    )


# Fixed value: tags by which a model says that it could not transcribe.
ANSWER_TAGS = ["TUSHUNARSIZ"]


def answer_tags(text: Column) -> Column:
    """The tags that stand in a model's answer, in brackets and capitals, as an array."""
    return F.filter(F.array(*map(F.lit, ANSWER_TAGS)), lambda tag: F.coalesce(text, F.lit("")).contains(F.concat(F.lit("["), tag, F.lit("]"))))


def status_of_change(ratio: Column) -> Column:
    """Under 25 approved, else pending."""
    return F.when(ratio < 25, "approved").otherwise("pending")


def text_after_change(ratio: Column, raw: Column, polished: Column) -> Column:
    """From 50 on the raw text comes back."""
    return F.when(ratio >= 50, raw).otherwise(polished)


def status_of_score(score: Column, approve_min: int = 3, reject_max: int = 2) -> Column:
    return F.when(score >= approve_min, "approved").when(score <= reject_max, "rejected").otherwise("pending")


def parsed_score(answer: Column) -> Column:
    """A model's answer to a score: its first character, held to 1..5; 3 where that is no number."""
    number = F.left(strip(answer), F.lit(1)).try_cast("int")
    return F.when(number.isNull(), 3).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), number)))


def exportable(status: Column, text: Column) -> Column:
    """Rows that sinks write: all but filtered and blank ones (rejected and pending rows are written)."""
    return (F.coalesce(status, F.lit("")) != "filtered") & ~blank(text)
