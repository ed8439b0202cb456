"""Queries whose SQL once stated another rule, on the rows that showed it."""

import duckdb
from pyspark.sql import functions as F

from tests.test_order import plain_bursts
from tidemark.functions import redact as R
from tidemark.operators import recovery
from tidemark.plans import deeper, queries  # noqa: F401


def test_neighbouring_addresses_are_all_redacted(spark):
    texts = ["1.2.3.4 5.6.7.8 9.10.11.12 13.14.15.16", "1.2.3.4,5.6.7.8", "1.2.3.4.5 6.7.8.9", "\n1.1.1.1\n2.2.2.2\n", "1234.1.1.1 1.1.1.1", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.t for r in rows.select("doc_id", F.regexp_replace("text", R.ADDRESSES[0][1], R.ADDRESSES[0][2]).alias("t")).orderBy("doc_id").collect()]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(texts)])
    assert [t for _, t in sorted(c.execute(queries.SQL["redact_addresses"]).fetchall())] == got
    assert got[0] == " ".join(["[REDACTED_IP]"] * 4)


def test_bursts_before_1970(spark):
    """So many bursts that a day for each goes back before the epoch."""
    n, mtime = 3000, 10_000_000
    rows = spark.range(n).select(F.col("id").alias("position"))
    got = [r.timestamp for r in recovery.place_bursts_apart(rows, [], mtime).orderBy("position").collect()]
    shift = 7 * 86400 * 1000  # whole weeks: the same rule at times after the epoch
    assert got[0] < 0 and got == [t - shift for t in plain_bursts(n, mtime + shift)]
    c = duckdb.connect()
    for t in (-1, -86400 * 5 + 30000, -86400 * 3 + 40000, 0, 86400 * 9 + 70000, -250000):
        want = spark.range(1).select(recovery._in_hours(F.lit(t))).first()[0]
        assert c.execute(f"SELECT {deeper._in_hours('t')} FROM (SELECT {t}::BIGINT AS t)").fetchone()[0] == want


def test_near_scores_are_not_ties():
    """Scores that differ in the seventh decimal: the higher comes first, not the newer."""
    c = duckdb.connect()
    c.execute("CREATE TABLE f AS SELECT * FROM (VALUES (1, 10, 1000000, 'docker', 1), (2, 20, 1000001, 'docker', 1), (3, 30, 1000000, 'docker', 1)) t(id, start_time, n, term, tf)")
    c.execute("CREATE TABLE d AS SELECT 'docker' AS term, 500 AS df")
    c.execute("CREATE TABLE s AS SELECT 1000 AS docs, 1000000000 AS total")
    sql = deeper.SQL["ask_sessions"]
    got = c.execute(sql[sql.rindex("SELECT id, round(") :]).fetchall()
    assert len({score for _, score in got}) == 1 and [i for i, _ in got] == [3, 1, 2]
