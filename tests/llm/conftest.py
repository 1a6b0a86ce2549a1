import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from plain import prose  # noqa: E402

#: Names that operators use inside.
CLASHING = ("n_tokens", "score", "fp", "held_out", "block", "rate", "id", "part", "label", "_u", "_spans", "domain", "start", "head")


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank and very long texts, repeated rows, ties, null ids, other columns."""
    base = prose(1, 120)
    rows = [
        (1, base), (2, base), (3, None), (4, ""), (5, " \t\n "), (6, prose(2, 60_000, 4000)), (7, prose(3, 90)), (7, prose(3, 90)), (None, prose(4, 80)), (8, "one"), (9, "Zwei Wörter"),
        (10, "ünï©ödé 日本語 🙂 " * 30), (11, base + " tail"),
    ]
    df = spark.createDataFrame([(d, t, "en" if i % 2 else None, "s", len(t or "")) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.selectExpr("*", f"cast(doc_id as string) as {c}")
    return df.cache()


@pytest.fixture(scope="session")
def labels(spark):
    known = spark.createDataFrame([(i, 1, int(i == 1)) for i in (1, 2, 4, 7, 8, 9, 10)] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    return known.selectExpr("*", *(f"'x' as {c}" for c in ("text", "lang", "score", "positive", "domain", "rate", "label", "held_out")))
