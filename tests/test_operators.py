import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import attribution, insights, joins, payloads, predict, recovery, search, sessions, store

KEYS = ["user_id"]


def commands(spark, times, user=1, text="ls"):
    rows = [(user, i, t, text, 0, None, False) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "user_id long, id long, timestamp long, command string, exit_code int, project_id long, is_legacy boolean")


def test_gap_of_exactly_1800_stays_and_1801_splits(spark):
    rows = sessions.session_rows(sessions.assign_sessions(commands(spark, [0, 1800, 3601, 3700, 5700]), KEYS), KEYS)
    assert [(r.start_time, r.duration_seconds) for r in rows.orderBy("id").collect()] == [(0, 1800), (3601, 99), (5700, 0)]


def test_idle_chunks_split_at_1800(spark):
    got = sessions.idle_chunks(commands(spark, [0, 1800, 1900]), KEYS, now=2000)
    assert [r.timestamp for r in got.collect()] == [0]
    assert sessions.idle_chunks(commands(spark, [0, 1800]), KEYS, now=2000, force=True).count() == 2


def test_empty_tables(spark):
    empty = commands(spark, [])
    rows = sessions.session_rows(sessions.assign_sessions(empty, KEYS), KEYS)
    assert rows.count() == 0
    assert sessions.rebuild_clusters(empty, KEYS, F.lit(True)).count() == 0
    assert predict.predict_next(rows, sessions.assign_sessions(empty, KEYS), KEYS, 0).count() == 0


def test_rebuild_clusters_match_a_plain_scan(spark):
    def plain(times, window=60):
        out, i = [], 0
        while i < len(times):
            j = i
            while j + 1 < len(times) and times[j + 1] - times[i] <= window:
                j += 1
            if j - i >= 2:
                out.append((times[i], j - i + 1))
                i = j + 1
            else:
                i += 1
        return out

    rng = random.Random(1)
    for _ in range(3):
        times = sorted(rng.sample(range(1200), 40))
        got = sessions.rebuild_clusters(commands(spark, times), KEYS, F.lit(True)).orderBy("start").collect()
        assert [(r.start, r.n) for r in got] == plain(times)


def test_streak(spark):
    day = 86400
    rows = spark.createDataFrame([(1, i, d * day) for i, d in enumerate([0, 2, 3, 4])], "user_id long, id long, start_time long")
    at = lambda d: sessions.streaks(rows, KEYS, F.lit(d).cast("date")).first()["streak"]
    assert [at("1970-01-05"), at("1970-01-06"), at("1970-01-07")] == [3, 3, 0]


def test_commits_within_the_interval(spark):
    s = spark.createDataFrame([(1, 10, 1000, 2000, 7), (1, 11, 90000, None, 7), (1, 12, 1000, 2000, None)], "user_id long, id long, start_time long, end_time long, project_id long")
    m = spark.createDataFrame([(1, 7, "a", 700), (1, 7, "b", 699), (1, 7, "c", 2600), (1, 7, "d", 2601), (1, 7, "e", 90600), (1, None, "f", 1500)], "user_id long, project_id long, hash string, timestamp long")
    got = {(r.session_id, r.hash) for r in joins.sessions_with_commits(s, m, KEYS).collect()}
    assert got == {(10, "a"), (10, "c"), (11, "e")}
    assert (11, "e") in {(r.session_id, r.hash) for r in joins.sessions_with_commits(s, m, KEYS, open_seconds=3600).collect()}


def test_orphans(spark):
    s = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 9)], "user_id long, id long, start_time long")
    c = spark.createDataFrame([(1,)], "session_id long")
    assert sorted(r.id for r in joins.prune_orphans(s, c, KEYS).collect()) == [1, 3]


def test_keepers(spark):
    s = spark.createDataFrame([(5, 1, 2, None, 1), (5, 1, 3, "x", 2), (5, None, 1, None, 3)], "start_time long, project_id long, n_commands long, ai_summary string, id long")
    assert {r.id: r.keeper for r in sessions.session_keepers(s).collect()} == {1: 2, 2: 2, 3: 3}


def test_nth_occurrence(spark):
    c = spark.createDataFrame([(1, "a", 0, None), (1, "a", 1, 50), (1, "b", 2, None)], "user_id long, command string, position long, timestamp long")
    known = spark.createDataFrame([(1, "a", 10)], "user_id long, command string, timestamp long")
    assert {r.position: (r.timestamp, r.locked) for r in joins.nth_occurrence(c, known, KEYS).collect()} == {0: (10, True), 1: (50, False), 2: (None, False)}


def test_interpolation(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([None, 100, None, None, 131, None])], "user_id long, position long, timestamp long")
    got = {r.position: (r.timestamp, r.recovery_source) for r in recovery.interpolate(rows, KEYS, now=200).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [100, 110, 120, 131]
    assert got[0][0] <= 100 and 131 < got[5][0] <= 200
    none = rows.withColumn("timestamp", F.lit(None).cast("long"))
    assert all(r.timestamp is None for r in recovery.interpolate(none, KEYS, now=200).collect())


def test_bounded_fill_keeps_within_five_years(spark):
    now = 2_000_000_000
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([-9, 10**13, now - 100, None, now - 50, None])], "user_id long, position long, timestamp long")
    got = [r.timestamp for r in recovery.fill_bounded_gaps(rows, KEYS, now).orderBy("position").collect()]
    assert got == [now - 120, now - 110, now - 100, now - 75, now - 50, now - 40]


def test_bursts_fall_on_working_days_at_16(spark):
    rows = spark.createDataFrame([(1, i, "x") for i in range(130)], "user_id long, position long, command string")
    got = [r.timestamp for r in recovery.place_bursts(rows, KEYS, 1_700_000_000).orderBy("position").collect()]
    assert got == sorted(got) and len(set(got)) == 130
    assert all((t // 86400 + 3) % 7 < 5 and (t % 86400) // 3600 == 16 for t in got)


def test_inline_dates(spark):
    df = spark.createDataFrame([("tar x-2024-01-02.tgz",), ("git log --since 2024-01-02",), ("echo 20240103",), ("ls",)], "c string")
    assert [r[0] for r in df.select(recovery.inline_date(F.col("c"))).collect()] == [1704153600, None, 1704240000, None]


def test_commit_matching_uses_each_commit_once(spark):
    a = spark.createDataFrame([("r", 0, "fix the parser bug"), ("r", 1, "fix the parser bug"), ("r", 2, "other text here")], "repo string, position long, message string")
    b = spark.createDataFrame([("r", "h1", 5, "fix: the parser bug"), ("r", "h2", 9, "Fix the parser bugs")], "repo string, hash string, timestamp long, message string")
    got = {r.position: r.hash for r in recovery.match_commits(a, b, ["repo"]).collect()}
    assert set(got) == {0, 1} and set(got.values()) == {"h1", "h2"}


def test_directories(spark):
    texts = ["cd /w/app", "make", "cd src", "cd -", "pushd /tmp", "popd", "ls"]
    rows = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(texts)] + [(1, 99, 90000, "pwd")], "user_id long, id long, timestamp long, command string")
    got = {r.id: r.cwd for r in attribution.replay_directories(rows, KEYS, "/home/u").collect()}
    assert [got[i] for i in range(7)] == ["/home/u", "/w/app", "/w/app", "/w/app/src", "/w/app", "/tmp", "/w/app"]
    assert got[99] == "/home/u"


def test_project_roots(spark):
    paths = spark.createDataFrame([("/home/u/a/b/c",), ("/srv/x/y",), ("/home/u/.cfg/z",), ("/home/u/d/e/f",)], "path string")
    marks = spark.createDataFrame([("/home/u/a", "vcs"), ("/home/u/a/b", "manifest"), ("/srv/x", "manifest")], "path string, kind string")
    got = {r.path: r.root for r in attribution.project_roots(paths, marks, "/home/u").collect()}
    assert got == {"/home/u/a/b/c": "/home/u/a", "/srv/x/y": "/srv/x", "/home/u/.cfg/z": None, "/home/u/d/e/f": "/home/u/d/e"}


def test_propagation_sees_earlier_assignments(spark):
    rows = spark.createDataFrame([(1, 1, 0, 10, 7), (1, 2, 5000, 5010, None), (1, 3, 10000, 10010, None), (1, 4, 99999, 99999, None)], "user_id long, id long, start_time long, end_time long, project_id long")
    assert {r.id: r.propagated for r in attribution.propagate_neighbours(rows, KEYS).collect()} == {1: 7, 2: 7, 3: 7, 4: None}


def test_breakdown_and_shares(spark):
    s = spark.createDataFrame([(1, 1, 0, 100, 100, 7), (1, 2, 0, 50, 50, None)], "user_id long, id long, start_time long, end_time long, duration_seconds long, project_id long")
    c = spark.createDataFrame([(7, 1), (None, 2), (None, 3)], "project_id long, timestamp long")
    p = spark.createDataFrame([(7, "App", "/a", 0, 9)], "id long, name string, path string, first_seen long, last_seen long")
    got = {r.name: (r.sessions, r.commands, r.duration) for r in insights.project_breakdown(s, c, p).collect()}
    assert got == {"App": (1, 1, 100), "Other": (1, 2, 50)}
    assert sorted(round(r.percent, 1) for r in insights.time_distribution(s, p, KEYS).collect()) == [33.3, 66.7]


def test_focus_counts_no_project_as_one(spark):
    s = spark.createDataFrame([(1, 0, 600, 7), (1, 60, 600, None)], "user_id long, start_time long, duration_seconds long, project_id long")
    assert insights.focus_score(s, KEYS).first()["focus"] == pytest.approx(6 - 1.5 + 0.5)


def test_daily_class_prefers_the_first_seen(spark):
    c = commands(spark, [1]).withColumn("command", F.lit("git x")).union(commands(spark, [0]).withColumn("command", F.lit("npm x")).withColumn("id", F.lit(5)))
    assert insights.daily_class(c, KEYS).first()["class"] == "Level 1 Frontend Bard"


def test_tiers_and_prefix_match(spark):
    c = spark.createDataFrame([(1, 1, "make"), (2, 1, "make all"), (3, 1, "cmake"), (4, 2, "x")], "session_id long, project_id long, command string")
    s = spark.createDataFrame([(i, 2 if i == 4 else 1) for i in (1, 2, 3, 4)], "id long, project_id long")
    p = spark.createDataFrame([(1, "zzz", "/z"), (2, "Make", "/m")], "id long, name string, path string")
    assert {r.id: r.tier for r in search.exactness_tier(s, c, p, " MAKE ").collect()} == {1: 0, 2: 1, 3: 5, 4: 2}
    df = spark.createDataFrame([("git commit",), ("digit commits",), ("commit only",)], "t string")
    assert [r[0] for r in df.select(search.prefix_match(F.col("t"), "git comm")).collect()] == [True, False, False]


def test_bm25_repeats_add(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "d"), (4, None)], "id long, text string")
    once = {r.id: r.score for r in search.bm25(d, "id", "text", ["a"]).collect()}
    twice = {r.id: r.score for r in search.bm25(d, "id", "text", ["a", "A"]).collect()}
    assert set(once) == {1, 2} and twice[1] == pytest.approx(2 * once[1])


def test_cosine_of_zero_is_zero(spark):
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in d.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_upsert_is_idempotent_and_null_safe(spark):
    kind = "user_id long, start_time long, project_id long, end_time long, duration_seconds long, ai_summary string, tags string"
    old = spark.createDataFrame([(1, 5, None, 6, 1, "kept", "t")], kind)
    new = spark.createDataFrame([(1, 5, None, 9, 4, None, None), (1, 7, 2, 8, 1, None, None)], kind)
    once = store.upsert_sessions(old, new, KEYS)
    twice = store.upsert_sessions(once.select(*old.columns), new, KEYS)
    rows = sorted(map(tuple, twice.select(*old.columns).collect()), key=str)
    assert rows == sorted(map(tuple, once.select(*old.columns).collect()), key=str)
    assert (1, 5, None, 9, 4, "kept", "t") in rows and len(rows) == 2


def test_consolidation_adds_nothing_twice(spark):
    done = spark.createDataFrame([], "user_id long, start_time long, end_time long, summary string, commands array<string>")
    c = commands(spark, [0, 10, 5000])
    first = store.consolidate(c, done, KEYS, now=9000)
    assert first.count() == 2
    assert store.consolidate(c, first, KEYS, now=9000).count() == 0


def test_snapshots_and_keyed_store(spark):
    s = spark.createDataFrame([(1, "cli", '{"a":1}', 1), (1, "cli", '{"a":1}', 2), (1, "cli", "bad", 3)], "session_id long, source string, payload string, captured_at long")
    assert [r.payload for r in payloads.changed_snapshots(s).orderBy("captured_at").collect()] == ['{"a":1}', "bad"]
    k = spark.createDataFrame([("d", "x", 1), ("d", "y", 2)], "timeframe_id string, summary string, created_at long")
    assert store.latest_by_key(k, "timeframe_id", "created_at").first()["summary"] == "y"


def test_interrupted(spark):
    now, h = 1_000_000, 3600
    s = spark.createDataFrame([(1, 1, now - 20 * h, now - 20 * h, 7), (1, 2, now - 40 * h, now - 40 * h, 7), (1, 3, now - 30 * h, now - 30 * h, 7), (1, 4, now - h, now - h, 8)], "user_id long, id long, start_time long, end_time long, project_id long")
    assert sorted(r.id for r in joins.interrupted_sessions(s, KEYS, now).collect()) == [1]


def test_leader_clusters_are_sequential(spark):
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]])], "g long, i long, v array<double>")
    assert [r.cluster for r in search.leader_clusters(d, ["g"], "v", "i").orderBy("i").collect()] == [0, 0, 1]


def test_moods_and_bugs(spark):
    from tidemark.operators import reports

    rows = spark.createDataFrame([(2, 0, 5, "x"), (0, 1, 9, "x"), (1, 1, 0, "x"), (0, 0, 4, "x"), (0, 0, 3, "x"), (0, 0, 0, "x"), (9, 9, 9, "Fix it")], "k int, c int, e int, m string")
    got = [r[0].split()[0] for r in rows.select(reports.emotion(F.col("k"), F.col("c"), F.col("e"), F.col("m"))).collect()]
    assert got == ["FURY", "RECOMPILING", "BUILD", "RAGE", "FRUSTRATION", "TRIUMPH", "EXHAUSTION"]
    chaotic = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    c = spark.createDataFrame([(1, "docker ps"), (1, "git commit --amend"), (2, "pytest -k 'not slow'"), (3, "ls")], "session_id long, command string")
    assert {r.id: r.bug.split()[0] for r in reports.likely_bugs(chaotic, c).collect()} == {1: "Detached", 2: "Silently", 3: "Sleep-Deprived"}


def test_header_counts_no_project_and_ties_go_late(spark):
    from tidemark.operators import reports

    s = spark.createDataFrame([(1, 7, 0, 0, 0, None), (1, 8, 0, 0, 0, 3)], "user_id long, id long, start_time long, end_time long, duration_seconds long, project_id long")
    linked = spark.createDataFrame([], "user_id long, session_id long")
    r = reports.header(s, linked, KEYS).first()
    assert (r.projects, r.commits, r.peak) == (2, 0, "afternoon")


def test_query_expansion_has_anchors_of_late_documents(spark, tmp_path):
    from tidemark.plans.queries import queries

    spark.createDataFrame([(3, "early"), (150, "late early"), (2000, "latest")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "late early latest none")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r.query for r in queries()["query_expansion"](spark, str(tmp_path)).collect()] == ["late early latest none doc150 doc3 doc2000"]
