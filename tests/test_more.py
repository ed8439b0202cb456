import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import time as C
from tidemark.operators import insights, joins, reports, search, store


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_memories_of_commands(spark):
    cases = {
        'git commit -am "Add search"': "Add search", "git commit --message=tidy": "tidy", "git checkout -b topic": "Create branch topic", "git switch main": "Switch to branch main",
        "git push origin main": "Push changes to remote", "git pull": "Pull latest changes", "git rebase -i HEAD~1": "Interactive rebase of last commit", "git rebase -i HEAD~07": "Interactive rebase of last 7 commits",
        "git rebase -i main": "Interactive rebase", "git rebase main": "Rebase onto main", "git cherry-pick abc": "Cherry-pick commit", "git reset --hard HEAD~1": "Hard reset to previous commit",
        "git reset --soft HEAD~3": "Soft reset 3 commits back", "git reset HEAD~1": "Reset to previous commit", "cd app && make all && ls": "make all", "cd a && ls": "cd a && ls", "cd x; git pull": "Pull latest changes", "git status": "git status",
    }
    assert values(spark, list(cases), X.command_memory) == list(cases.values())
    assert values(spark, ["git push x", "git status", "make", "makefile", "npm", "npmx", "go test ./...", " pytest"], X.is_project_command) == [True, False, True, True, True, False, True, True]
    assert values(spark, ["x" * 1500 + "-y", "my-cool_app/"], X.humanize_project) == ["X" + "x" * 1499 + " Y", "Cool App"]


def test_offsets_and_ranges(spark):
    assert values(spark, [0, 61, 3723, -5, 360000], C.format_offset, "long") == ["+00:00", "+01:01", "+01:02:03", "-00:05", "+100:00:00"]
    rows = [(1748304000, 1748307600), (1748304000, 1748390400), (1748304000, 1749000000), (1735600000, 1749000000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a long, b long").orderBy("i")
    assert [r.y for r in df.select(C.format_range(F.col("a"), F.col("b")).alias("y")).collect()] == ["May 27, 2025", "May 27 - 28, 2025", "May 27 - June 04, 2025", "December 30, 2024 - June 04, 2025"]


def test_leaders_do_not_depend_on_the_parts(spark):
    rng = random.Random(4)
    rows = [(g, i, [rng.gauss(c, 0.4) for c in ((g or 0) % 2, i % 3 - 1, 0.3)]) for g in (1, 2, None) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int, v array<double>")
    whole, cut = ({(r.g, r.i): r.cluster for r in search.leader_clusters(df, ["g"], "v", "i", 0.7, n).collect()} for n in (5000, 7))
    assert whole == cut and len(whole) == 120 and max(whole.values()) > 1
    assert search.leader_clusters(df.where(F.lit(False)), ["g"], "v", "i").count() == 0


def test_leaders_of_many_unlike_vectors(spark):
    """Nearly each vector leads a cluster of its own, so all are compared with all."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4000, 24))
    base[1000:1400] = base[:400] + 0.3 * rng.normal(size=(400, 24))  # join one of the same or an earlier block, whose mean moves
    base[1400:1500] = base[1300:1400] + 0.5 * rng.normal(size=(100, 24))
    base[7] = 0.0
    rows = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(base)], "g int, i int, v array<double>")
    begin = time.monotonic()
    found = {r.i: r.cluster for r in search.leader_clusters(rows, ["g"], "v", "i", 0.7, 1100).collect()}
    assert time.monotonic() - begin < 25  # a loop over the clusters of each vector takes longer
    sums, sizes, want = np.zeros_like(base), np.zeros(len(base)), []
    for i, v in enumerate(base):
        mean = sums[: max(want, default=-1) + 1] / sizes[: max(want, default=-1) + 1, None]
        with np.errstate(invalid="ignore"):
            near = np.flatnonzero(mean @ v / (np.linalg.norm(mean, axis=1) * np.linalg.norm(v)) >= 0.7)
        want.append(int(near[0]) if len(near) else len(mean))
        sums[want[-1]] += v
        sizes[want[-1]] += 1
    assert [found[i] for i in range(len(base))] == want and 3000 < len(set(want)) < 3700


def test_errors_and_multiplicity(spark):
    s = spark.createDataFrame([(1, 10, 20, 10, 1, False)], "id long, start_time long, end_time long, duration_seconds long, project_id long, is_legacy boolean")
    c = spark.createDataFrame([(1, 10, "make", 1, 1)], "id long, timestamp long, command string, session_id long, project_id long")
    p = spark.createDataFrame([(1, "one", None)], "id long, name string, path string")
    with pytest.raises(ValueError):
        store.export_selection(s, c, p, since=5, until=4)
    assert store.export_selection(s, c, p, since=10, until=10).count() == 1 and store.export_selection(s, c, p, "other").count() == 0
    tags = spark.createDataFrame([(1, ["setup"])], "session_id long, tags array<string>")
    with pytest.raises(ValueError):
        reports.tag_listing(s, c, tags, p, "unknown")
    assert [r.summary for r in reports.tag_listing(s, c, tags, p, " Setup").collect()] == ["make"]
    a, b = (spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 1, 2], [1, 2, 2]))
    assert not joins.same_rows(a, b) and joins.same_rows(a, a) and not insights.resurrections(s, p, []).count()


def test_search_filters_pages_and_recovers(spark):
    s = spark.createDataFrame([(i, 100 * i, 100 * i + 50, 50, i % 2, False) for i in range(1, 9)], "id long, start_time long, end_time long, duration_seconds long, project_id long, is_legacy boolean")
    c = spark.createDataFrame([(i, 100 * i, "docker run" if i % 3 else "ls", i, i % 2) for i in range(1, 9)], "id long, timestamp long, command string, session_id long, project_id long")
    m = spark.createDataFrame([], "session_id long, hash string, t long, message string")
    p = spark.createDataFrame([(1, "one", "/x"), (0, "zero", "/y")], "id long, name string, path string")
    tags = spark.createDataFrame([(i, ["debug", "test"] if i > 4 else ["test"]) for i in range(1, 9)], "session_id long, tags array<string>")
    ids = lambda **k: [r.id for r in search.advanced_search(s, c, m, p, **k).collect()]
    assert ids(query="docker") == [8, 7, 5, 4, 2, 1] and ids(query="docker", limit=2, offset=3) == [4, 2]
    assert ids(query="docker", project="one", since=100, until=700) == [7, 5, 1] and ids(query="") == [8, 7, 6, 5, 4, 3, 2, 1]
    assert ids(query="docker", tags=tags, wanted_tags=("TEST", "debug")) == [8, 7, 5]
    index = search.index_rows(c, m.select("hash", "message"), s)
    assert sorted(ids(query="doc run", index=index)) == [1, 2, 4, 5, 7, 8] and ids(query="doc run") == []
    assert ids(query="docker run", index=index.where("ref <> '8'")) == [8, 7, 5, 4, 2, 1]  # the base still finds what the index lost


def test_search_steps_are_apart(spark):
    """No stage of the last plan joins for more than the tiers: project, tags and hits are worked out before, each by itself."""
    s = spark.createDataFrame([(i, 100 * i, 100 * i + 50, 50, i % 2, False) for i in range(1, 9)], "id long, start_time long, end_time long, duration_seconds long, project_id long, is_legacy boolean")
    c = spark.createDataFrame([(i, 100 * i, "docker run" if i % 3 else "ls", i, i % 2) for i in range(1, 9)], "id long, timestamp long, command string, session_id long, project_id long")
    m = spark.createDataFrame([], "session_id long, hash string, t long, message string")
    p = spark.createDataFrame([(1, "one", "/x"), (0, "zero", "/y")], "id long, name string, path string")
    tags = c.groupBy("session_id").agg(F.array(F.lit("test")).alias("tags"))
    found = search.advanced_search(s, c, m, p, "docker", "one", tags=tags, wanted_tags=("test",))
    assert [r.id for r in found.collect()] == [7, 5, 1]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4
