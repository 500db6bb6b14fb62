import numpy as np
import pytest

NASTY = [
    None,
    "",
    " ",
    "\n\t ",
    "a",
    "Hello, it's  <|endoftext|>wörld 12345 a!!?",
    "ΑΣ σΣ İ ² ½ x₂ ⅷ 日本語 テスト é  x y z",
    "<|startoftext|><|startoftext|> <|STARTOFTEXT|> <s> </s> <0x0A>",
    "'s'S don't we'll I'VE'''s _a_b__c",
    "👩‍👩‍👧 नमस्ते a​b ﬁ ſ K Å",
    "a     b      c\n\n  d\t\t e\r\n▁▁ a▁b",
    "x" * 3000,
    "the" * 500,
    "word " * 4000,
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names clash with what operators add."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0, 0.5, True, "x") for i, t in enumerate(NASTY)]
    rows += [rows[4], rows[4], (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean, node string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def rng():
    return np.random.default_rng(0)
