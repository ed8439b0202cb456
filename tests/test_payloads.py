import json
import random

from pyspark.sql import functions as F

from tidemark.operators import payloads

KIND = "session_id long, source string, payload string, captured_at long"


def spelled(rng, value):
    """The value as JSON with its keys in any order."""
    if isinstance(value, dict):
        items = list(value.items())
        rng.shuffle(items)
        return "{" + ", ".join(json.dumps(k) + rng.choice([":", " : "]) + spelled(rng, v) for k, v in items) + "}"
    return json.dumps(value)


def differences(a, b, path="$"):
    if isinstance(a, dict) and isinstance(b, dict):
        return [d for k in {*a, *b} for d in differences(a.get(k, ...), b.get(k, ...), f"{path}.{k}")]
    text = lambda x: None if x is ... else json.dumps(x, sort_keys=True, separators=(",", ":"))
    return [] if text(a) == text(b) else [(path, text(a), text(b))]


def random_value(rng, depth):
    if depth and rng.random() < 0.7:
        return {k: random_value(rng, depth - 1) for k in rng.sample(["a", "b", "c"], rng.randint(0, 3))}
    return rng.choice([0, 1, 2.5, "x", "1", None, True, [1, 2], [], {"z": 1}, {}])


def test_changes_equal_a_plain_comparison(spark):
    rng = random.Random(3)
    rows, want, kept = [], [], []
    for session in range(6):
        before = ...
        for at in range(40):
            value = before if at and rng.random() < 0.3 else random_value(rng, 3)
            rows.append((session, "cli", spelled(rng, value), at))
            want += [(session, at, *d) for d in differences(before, value)]
            kept += [(session, at)] if at == 0 or differences(before, value) else []
            before = value
    df = spark.createDataFrame(rows, KIND)
    got = [tuple(r) for r in payloads.field_changes(df, ["session_id"], ["captured_at"]).collect()]
    key = lambda r: (*r[:3], r[3] or "", r[4] or "")
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sorted((r.session_id, r.captured_at) for r in payloads.changed_snapshots(df).collect()) == sorted(kept)


def test_odd_payloads(spark):
    texts = ['{"a": 1.0}', '{"a":1}', "no json", "no json", None, None, "", "[1,  2]", "[1,2]", '{"a":1,"a":2}', "null", '{"k": "7", "n": {"m": 7}}']
    df = spark.createDataFrame([(1, "cli", t, i) for i, t in enumerate(texts)], KIND)
    assert sorted(r.captured_at for r in payloads.changed_snapshots(df).collect()) == [0, 2, 4, 6, 7, 9, 10, 11]
    got = {r.captured_at: r for r in payloads.payload_fields(df, {"a": ("$.a", "int"), "m": ("$.n.m", "string"), "k": ("$.k", "long")}).collect()}
    assert (got[0].a, got[1].a, got[2].a, got[9].a, got[11].m, got[11].k) == (1, 1, None, None, "7", 7)
    r = payloads.payload_schema(df, ["session_id"]).first()
    assert r.malformed == 4 and r.n == 12 and payloads.payload_schema(df.where("captured_at < 2"), ["session_id"]).first().schema.startswith("OBJECT<a: ")
    empty = df.where(F.lit(False))
    assert payloads.field_changes(empty, ["session_id"], ["captured_at"]).count() == payloads.changed_snapshots(empty).count() == 0


def test_dashboard_days(spark):
    from tidemark.operators import insights

    day = 86400
    sessions = spark.createDataFrame(
        [(1, 9 * day, 60, False), (2, 9 * day + 7, None, None), (3, 8 * day, 30000, False), (4, 7 * day, 0, True), (5, 2 * day, 99999, False), (6, 20 * day, 99999, False)], "id long, start_time long, duration_seconds long, is_legacy boolean"
    )
    commands = spark.createDataFrame([(1,)] * 3 + [(2,)] * 2 + [(3,)] * 4 + [(4,)] * 9 + [(5,)] * 30, "session_id long")
    got = [(str(r.day), r.n, r.level, r.highlight) for r in insights.dashboard_days(sessions, commands, "1970-01-11", 5).orderBy("day").collect()]
    assert got == [("1970-01-07", 0, 0, False), ("1970-01-08", 0, 0, False), ("1970-01-09", 4, 1, True), ("1970-01-10", 5, 2, True), ("1970-01-11", 0, 0, False)]
    assert not any(r.highlight for r in insights.dashboard_days(sessions.where("id = 0"), commands, "1970-01-11", 5).collect())
