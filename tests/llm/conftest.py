from __future__ import annotations

import pytest

TEXTS = {
    0: "The quick brown fox jumps over the lazy dog. " * 8,
    1: "",
    2: None,
    3: " \n\t ",
    4: "one two",
    5: "one two",
    6: "Ünïcödé wörds 你好 😀 and\nlines\nlines\n" * 5,
    7: "The quick brown fox jumps over the lazy dog. " * 8 + "tail of its own",
}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, a long text, and columns that clash with added ones."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 3 else None, len(t or ""), "clash", 7, True, 1, "x") for i, t in TEXTS.items()]
    rows += [rows[4], (None, "one two", None, None, None, None, None, None, None, None), (2**60 + 1, "word " * 30_000, "en", "s1", 150_000, "c", 1, False, 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, clean_text string, size int, kept boolean, chunk int, node string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

