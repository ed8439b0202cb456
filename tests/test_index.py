"""The stored index against plain matching and scoring of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import index, search

WORDS = ["git", "commit", "commits", "docker", "build", "user", "host", "foo_bar", "ünder", "x9", "Gi", "é"]


def texts(seed, n, types=("command", "commit")):
    rng = random.Random(seed)
    glue = [" ", " ", "-", "@", ".", "  "]
    made = ["".join(rng.choice(WORDS) + rng.choice(glue) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return [(rng.choice(types), str(rng.randrange(n // 2)), t) for t in made] + [("command", "77", None), ("command", "78", ""), ("command", "79", "git"), ("command", "79", "git")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "type string, ref string, text string")


@pytest.fixture(scope="module", autouse=True)
def small_ranges():
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(index, "RANGE", 16)
        yield


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory, small_ranges):
    """Two batches, the second of which replaces some of the first, in ranges of 16 documents; and the live rows."""
    one, two = texts(1, 150), texts(2, 60)
    made = index.StoredIndex(spark, str(tmp_path_factory.mktemp("stored") / "index"), create=True)
    made.add(frame(spark, one))
    made.add(frame(spark, two), replace=True)
    fresh = {r[:2] for r in two}
    return made, [r for r in one if r[:2] not in fresh] + two


@pytest.mark.parametrize("query", ["git", "gi comm", "user@host", "foo-git build", "git-comm x9", "ünd", "zzz", "-", "git zzz"])
@pytest.mark.parametrize("every", [True, False])
def test_matching(spark, stored, query, every):
    made, live = stored
    want = frame(spark, live).where(search.prefix_match(F.col("text"), query, every)).select("type", "ref").collect()
    got = made.matching(query, every).select("type", "ref").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def best_of(made, live, terms):
    docs = made.docs()
    assert docs.count() == len(live)
    want = sorted(((-round(r.score, 9), r.doc) for r in search.bm25(docs, "doc", "text", terms).collect()))[:7]
    got = sorted((-round(r.score, 9), r.doc) for r in made.top(terms, k=7, first=2).collect())
    assert got == want


@pytest.mark.parametrize("terms", [["git"], ["git", "docker", "git"], ["build", "é", "none"], ["none"]])
def test_best_documents(spark, stored, terms):
    best_of(*stored, terms)


def test_best_documents_of_a_compact_index(stored, tmp_path):
    best_of(stored[0].compact(str(tmp_path / "compact")), stored[1], ["git", "docker", "git"])


def test_only_files_and_terms_of_the_query_are_read(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made = index.StoredIndex(spark, str(tmp_path / "index"), create=True)
    made.add(frame(spark, [("command", str(i), f"term{i:04d} other") for i in range(400)]))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = made._read("postings", index.POSTINGS).inputFiles()
    blocks = made.postings([("term0005", "term0005")])
    assert len(every) > 2 and len(blocks.inputFiles()) == 1 and blocks.count() == 1
    plan = blocks._sc._jvm.PythonSQLUtils.explainString(blocks._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in plan and "GreaterThanOrEqual(term,term0005)" in plan
    assert made.postings([("zz", "zz")]).count() == 0


def test_a_broken_batch_does_not_count(spark, tmp_path):
    made = index.StoredIndex(spark, str(tmp_path / "index"), create=True)
    made.add(frame(spark, [("command", "1", "alpha")]))
    made._write(frame(spark, [("command", "2", "alpha")]), 1, index.RANGE, [0], False)  # its row in `batches` is there; take another's away
    broken = index.StoredIndex(spark, made.path)
    broken.batches = lambda: [b for b in made.batches() if b.batch == 0]
    assert [r.ref for r in broken.matching("alpha").collect()] == ["1"]


def test_empty_index(spark, tmp_path):
    made = index.StoredIndex(spark, str(tmp_path / "index"), create=True)
    made.add(frame(spark, []))
    assert made.matching("git").count() == 0 and made.top(["git"]).count() == 0


def test_current(spark, stored):
    made, live = stored
    rows = frame(spark, live).where("type = 'command'").select(F.col("ref").cast("long").alias("session_id"))
    assert made.is_current(rows) and not made.is_current(rows.where("session_id <> 79"))
