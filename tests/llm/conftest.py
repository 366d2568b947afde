from __future__ import annotations

import random

import pytest

#: Texts that are awkward: empty, white, long, of other scripts, repeated.
ODD = ["", " ", "\n", "a", "a  b", "lead \n x", "x  y　z", "don't I'LL", "日本語 テスト🎉", "é é Å", "\x1c\x85\x00z", "<|endoftext|> <|startoftext|>x", "z" * 5000, "word " * 3000, "12345 6789 ¼½", "a\t\n\r\nb\n\n", "ΣΑΣ ΟΔΟΣ", "İx J̌"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, repeated rows and a column whose name could clash."""
    rows = [(i, t, "en", f"h{i % 3}", 1, "x") for i, t in enumerate(ODD)] + [(90, None, None, None, None, None), (None, "no id", "en", "h0", 1, "x"), (3, "a", "en", "h0", 1, "x"), (3, "a", "en", "h0", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, node string")


@pytest.fixture(scope="session")
def odd_rows(odd_docs):
    return [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]


def words(rng: random.Random, n: int, of: int = 400) -> list[str]:
    return [f"w{rng.randrange(of)}" for _ in range(n)]
