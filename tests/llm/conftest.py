"""Small documents with every awkward case, and brute-force helpers."""

from __future__ import annotations

import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return WORDS.findall((text or "").translate(_LOWER))


def shingles(text, width=5):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def awkward_rows():
    """Nulls, blanks, copies, near copies, ties, repeated rows, long and odd texts."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [
        (1, base), (2, base), (3, base.upper()), (3, base.upper()), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "one two"), (9, "One  Two\n"),
        (None, base + " more words at the end"), (None, None), (10, "é" * 50 + " ünïcode ½ ² 中文 \U0001f600"), (11, "x" * 70_000), (12, prose(rng, 8_000, 3)), (13, "a"),
        (14, "<|endoftext|> it's <|endoftext|>"), (15, "  odd blank \x1c \x85 end"), (2**62, prose(rng, 60)), (-5, prose(rng, 60)),
    ]
    for i in range(20, 60):
        w = words_of(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, prose(rng, rng.randrange(1, 200))) for i in range(60, 120)]
    return [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["class_id", "component", "key", "bucket", "rank", "length", "token_ids", "toxicity", "_h", "n_words", "quality", "lang_pred", "fingerprint", "spans", "lane", "_row", "_id", "mark", "salt", "place"]
    return awkward.withColumns({n: F.lit("x") for n in names})
