"""Token counts of texts with long runs of blanks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from botqa.llm import tokens


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Encoder(f.read())


def test_cuts_are_where_the_pattern_parts(encoder, monkeypatch):
    """With runs of 3 blanks taken out, texts encode as whole ones."""
    monkeypatch.setattr(tokens, "LONG_RUN", 3)
    monkeypatch.setattr(tokens, "_LONG_RUNS", re.compile(tokens._LONG_RUNS.pattern.replace("10000", "3")))
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice([" ", " ", "\t", "\n", "\r\n", "\xa0", "\u2003", "\u3000", "a", "b1", "\u00e9", "!?", "'s", "\x1c"]) * rng.choice([1, 1, 2, 5])
                       for _ in range(rng.randint(0, 12)))
        assert encoder.tokens(text).tolist() == encoder.encoding.encode(text, disallowed_special=()), repr(text)


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\u3000"])
def test_two_million_blanks(encoder, blank):
    n = 2_000_000
    for text, ends in [("a" + blank * n + "b", 1), (blank * n, 0), ("a b" + blank * n, 0), (blank * n + "!" + blank * n + "x", 1)]:
        starts, stops = encoder.spans(text)
        assert starts[0] == 0 and stops[-1] == len(text) and (starts[1:] <= stops[:-1]).all()
        assert ends == 0 or starts[-1] >= len(text) - 2  # the last blank stands with or before the last word, not with the run


def test_through_spark(spark):
    n = 2_000_000
    rows = [(i, f"start{b * n}end\nnext line", "en", "s") for i, b in enumerate(" \t")] + [(2, "x" + "\n" * n + "y", "en", "s"), (3, " " * n, None, None)]
    counts = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4))
    got = {r["doc_id"]: (r["c"], r["t"], r["s"]) for r in counts.where("field = 'text'").groupBy("doc_id").agg(
        F.sum("n_chars").alias("c"), F.sum("n_tokens").alias("t"), F.count("*").alias("s")).collect()}
    assert [got[i][0] for i in range(4)] == [len(r[1]) for r in rows] and got[2][2] == n + 1
    assert all(0 < got[i][1] <= len(rows[i][1]) for i in range(4))
    np.testing.assert_equal([got[i][2] for i in (0, 1, 3)], [2, 2, 1])
