"""Fuzzy matching against the sequential rule."""

import difflib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching, recovery

WORDS = ["add", "fix", "typo", "in", "reader", "writer", "index", "tests", "of", "search", "readme", "rename"]


def message(rng):
    text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))
    for _ in range(rng.choice([0, 0, 1, 2, 4])):
        at = rng.randint(0, len(text))
        text = text[:at] + rng.choice(["", "x", "s", " "]) + text[at + rng.randint(0, 2) :]
    return text


def tables(seed, n, copies=0):
    rng = random.Random(seed)
    commits = [(rng.choice("ab"), f"h{i}", rng.randint(0, 40), message(rng)) for i in range(n)]
    asked = [(r, i, rng.choice([m, m, message(rng)])) for i, (r, _, _, m) in enumerate(rng.sample(commits, n))]
    commits += [("a", f"c{i}", 50 - i, "fix typo in the docs") for i in range(copies)]
    asked += [("a", 1000 + i, rng.choice(["fix typo in the docs", "fix typos in the docs"])) for i in range(copies + 5)]
    return asked, commits


def sequential(asked, commits, threshold):
    used, out = set(), {}
    for repo, position, text in sorted(asked, key=lambda x: (x[0], x[1])):
        options = [(-difflib.SequenceMatcher(None, text, m).ratio(), t, h) for r, h, t, m in commits if r == repo and h not in used and text and m]
        options = sorted(o for o in options if -o[0] >= threshold)
        if options:
            used.add(options[0][2])
            out[repo, position] = options[0][2]
    return out


@pytest.mark.parametrize("seed,n,copies,threshold", [(1, 80, 0, 0.85), (2, 60, 25, 0.85), (3, 70, 0, 0.72), (4, 40, 0, 0.95)])
def test_as_the_sequential_rule(spark, seed, n, copies, threshold):
    asked, commits = tables(seed, n, copies)
    a = spark.createDataFrame(asked, "repo string, position long, a string")
    b = spark.createDataFrame(commits, "repo string, hash string, t long, b string")
    found = matching.assign_once(a, b, matching.similar_texts(a, b, ["repo"], threshold), ["repo"])
    assert {(r.repo, r.position): r.hash for r in found.collect()} == sequential(asked, commits, threshold)


def test_large_keys_go_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(matching, "HELD", 150)
    asked, commits = tables(2, 60, 25)
    a = spark.createDataFrame(asked, "repo string, position long, a string")
    b = spark.createDataFrame(commits, "repo string, hash string, t long, b string")
    found = matching.assign_once(a, b, matching.similar_texts(a, b, ["repo"], 0.85), ["repo"])
    assert {(r.repo, r.position): r.hash for r in found.collect()} == sequential(asked, commits, 0.85)


def test_texts_of_many_keys_are_compared_once(spark, monkeypatch):
    counted = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        counted.add(len(x))
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    monkeypatch.setattr(matching, "_ratio", ratio)
    texts = spark.createDataFrame([(k, f"purchase {n}") for k in range(30) for n in range(10, 16)], "k int, a string")
    got = matching.similar_texts(texts, texts.withColumnRenamed("a", "b"), ["k"], 0.85)
    assert got.count() == 30 * 36 and counted.value == 30  # pairs of different texts


def test_no_similar_text_is_missed(spark):
    rng = random.Random(9)
    one, two = ([(1, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 14)))) for _ in range(150)] for _ in range(2))
    a, b = spark.createDataFrame(one, "k int, a string"), spark.createDataFrame(two, "k int, b string")
    for threshold in (0.75, 0.85):
        got = {(r.a, r.b) for r in matching.similar_texts(a, b, ["k"], threshold).collect()}
        assert got == {(x, y) for _, x in one for _, y in two if x and y and difflib.SequenceMatcher(None, x, y).ratio() >= threshold}


def test_nothing_to_match(spark):
    a = spark.createDataFrame([("r", 1, None), ("r", 2, "")], "repo string, position long, message string")
    b = spark.createDataFrame([("r", "h", 5, None)], "repo string, hash string, timestamp long, message string")
    assert recovery.match_commits(a, b, ["repo"]).count() == 0
    assert recovery.match_commits(a.where(F.lit(False)), b.where(F.lit(False)), ["repo"]).count() == 0
