"""The activity-log tables, derived from the test tables.

Events other than purchases are commands, purchases are commits, a user works
on one project (or on none), and sessions come from gaps between commands.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sessions import assign_sessions, session_rows

GAP = 43200  # the test events are sparse: 12 hours


def _command(kind: Column, k: Column) -> Column:
    text = k.cast("string")

    def pick(n: int, *choices: Column) -> Column:
        return F.element_at(F.array(*choices), (F.pmod(k, F.lit(n)) + 1).cast("int"))

    lit = F.lit
    return (
        F.when(kind == "click", pick(4, F.concat(lit('git commit -m "fix: item '), text, lit('"')), lit("git status"), lit("docker build -t app ."), F.concat(lit("vim src/file_"), text, lit(".py"))))
        .when(kind == "view", pick(3, lit("ls -la"), F.concat(lit("cat notes_"), text, lit(".txt")), F.concat(lit("cd project-"), F.pmod(k, lit(5)).cast("string"))))
        .when(kind == "error", pick(2, lit("npm run build"), F.concat(lit("pytest tests/test_"), text, lit(".py"))))
        .otherwise(F.concat(lit("ssh deploy@host-"), text, lit(".example.com && export API_TOKEN=abc"), text))
    )


COMMANDS_SQL = """
WITH ev AS (SELECT event_id, user_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS t, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
raw AS (
  SELECT user_id, event_id AS id, t AS timestamp,
    CASE event_type
      WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'git commit -m "fix: item ' || k || '"' WHEN 1 THEN 'git status' WHEN 2 THEN 'docker build -t app .' ELSE 'vim src/file_' || k || '.py' END
      WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'ls -la' WHEN 1 THEN 'cat notes_' || k || '.txt' ELSE 'cd project-' || (k % 5) END
      WHEN 'error' THEN CASE k % 2 WHEN 0 THEN 'npm run build' ELSE 'pytest tests/test_' || k || '.py' END
      ELSE 'ssh deploy@host-' || k || '.example.com && export API_TOKEN=abc' || k END AS command,
    CASE WHEN k % 7 = 0 THEN NULL ELSE k % 3 END AS exit_code, nullif(user_id % 7, 0) AS project_id, k % 11 = 0 AS is_legacy
  FROM ev WHERE event_type <> 'purchase'),
commits AS (
  SELECT 'h' || event_id AS hash, t AS timestamp, 'feat(core): :rocket: purchase ' || k || ' (#' || k || ')' AS message, nullif(user_id % 7, 0) AS project_id, user_id
  FROM ev WHERE event_type = 'purchase'),
marked AS (
  SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w > 43200 OR lag(timestamp) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
  FROM raw WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY timestamp, id)::BIGINT AS n FROM marked),
commands AS (SELECT *, min(id) OVER (PARTITION BY user_id, n) AS session_id FROM numbered),
sessions AS (
  SELECT user_id, session_id AS id, min(timestamp) AS start_time, max(timestamp) AS end_time, max(timestamp) - min(timestamp) AS duration_seconds,
    min(project_id) AS project_id, bool_and(is_legacy) AS is_legacy, count(*) AS n_commands
  FROM commands GROUP BY user_id, session_id),
projects AS (
  SELECT nullif(user_id % 7, 0) AS id, 'project ' || (user_id % 7) AS name, '/home/dev/project-' || (user_id % 7) AS path, min(t) AS first_seen, max(t) AS last_seen
  FROM ev WHERE user_id % 7 > 0 GROUP BY ALL)
"""


class Core:
    """The tables of one scale factor, each planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), k.alias("k"))

    @property
    def project_id(self) -> Column:
        return F.nullif(F.pmod("user_id", F.lit(7)), F.lit(0)).cast("long")

    @cached_property
    def commands(self) -> DataFrame:
        k = F.col("k")
        rows = self.events.where("event_type <> 'purchase'").select(
            "user_id", F.col("event_id").alias("id"), F.col("t").alias("timestamp"), _command(F.col("event_type"), k).alias("command"),
            F.when(F.pmod(k, F.lit(7)) != 0, F.pmod(k, F.lit(3))).cast("int").alias("exit_code"), self.project_id.alias("project_id"), (F.pmod(k, F.lit(11)) == 0).alias("is_legacy"),
        )
        return assign_sessions(rows, keys=["user_id"], gap=GAP)

    @cached_property
    def sessions(self) -> DataFrame:
        return session_rows(self.commands, keys=["user_id"])

    @cached_property
    def commits(self) -> DataFrame:
        text = F.col("k").cast("string")
        message = F.concat(F.lit("feat(core): :rocket: purchase "), text, F.lit(" (#"), text, F.lit(")"))
        return self.events.where("event_type = 'purchase'").select(F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("hash"), F.col("t").alias("timestamp"), message.alias("message"), self.project_id.alias("project_id"), "user_id")

    @cached_property
    def projects(self) -> DataFrame:
        n = F.pmod("user_id", F.lit(7)).cast("long")
        rows = self.events.where(n > 0).groupBy(n.alias("id")).agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))
        text = F.col("id").cast("string")
        return rows.select("id", F.concat(F.lit("project "), text).alias("name"), F.concat(F.lit("/home/dev/project-"), text).alias("path"), "first_seen", "last_seen")
