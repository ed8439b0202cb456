"""Registered queries: each an operator over the test tables, with DuckDB SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.adapters import COMMANDS_SQL, Core
from tidemark.functions import redact as R
from tidemark.functions import text as X
from tidemark.functions import time as C
from tidemark.operators import attribution, insights, joins, predict, recovery, reports, search, sessions, store
from tidemark.sources import sinks

Plan = Callable[[Core], DataFrame]
NOW = 1706745600  # 2024-02-01, the end of the events
CUTOFF = 1705276800  # 2024-01-15
KEYS = ["user_id"]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, bare: bool = False) -> Callable[[Plan], Plan]:
    """Registers a plan; ``sql`` follows the definitions of the core tables unless ``bare``."""

    def add(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql:
            SQL[name] = sql if bare else f"{COMMANDS_SQL.rstrip()}{'' if sql.lstrip().startswith('SELECT') else ','}\n{sql}"
        return plan

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Core(spark, sf_dir))) for name, plan in PLANS.items()}


LINKED_SQL = """linked AS (
  SELECT s.id AS session_id, m.hash, m.timestamp AS t, m.message FROM sessions s JOIN commits m
  ON m.user_id = s.user_id AND m.project_id = s.project_id AND m.timestamp BETWEEN s.start_time - 300 AND s.end_time + 600)"""


def linked(c: Core) -> DataFrame:
    return joins.sessions_with_commits(c.sessions, c.commits, KEYS).join(c.commits.select("hash", "message"), "hash")


@query("flagship_project_time", f"""{LINKED_SQL},
n AS (SELECT session_id, count(*) AS c FROM linked GROUP BY 1)
SELECT p.name, count(*) AS sessions, sum(s.duration_seconds)::BIGINT AS seconds, coalesce(sum(n.c), 0)::BIGINT AS commits
FROM sessions s JOIN projects p ON p.id = s.project_id LEFT JOIN n ON n.session_id = s.id GROUP BY 1 ORDER BY seconds DESC, name LIMIT 10""")
def _flagship(c: Core) -> DataFrame:
    n = joins.sessions_with_commits(c.sessions, c.commits, KEYS).groupBy("session_id").agg(F.count("*").alias("c"))
    rows = c.sessions.join(c.projects.select(F.col("id").alias("project_id"), "name"), "project_id").join(n.withColumnRenamed("session_id", "id"), "id", "left")
    out = rows.groupBy("name").agg(F.count("*").alias("sessions"), F.sum("duration_seconds").alias("seconds"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("commits"))
    return out.orderBy(F.col("seconds").desc(), "name").limit(10)


@query("sessions_gap", "SELECT user_id, id, start_time, end_time, duration_seconds, project_id, is_legacy, n_commands FROM sessions")
def _sessions(c: Core) -> DataFrame:
    return c.sessions


@query("idle_chunks", f"""big AS (
  SELECT user_id, id, timestamp, CASE WHEN timestamp - lag(timestamp) OVER w >= 1800 OR lag(timestamp) OVER w IS NULL THEN 1 ELSE 0 END AS f
  FROM raw WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id)),
num AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY timestamp, id) AS n FROM big),
ch AS (SELECT user_id, n, count(*) AS c, max(timestamp) AS last FROM num GROUP BY 1, 2)
SELECT user_id, count(*) AS chunks, max(c) AS largest FROM ch x
WHERE last < (SELECT max(last) FROM ch y WHERE y.user_id = x.user_id) OR {NOW} - last >= 1800 GROUP BY 1""")
def _idle(c: Core) -> DataFrame:
    chunks = sessions.idle_chunks(c.commands.drop("session_id"), KEYS, NOW).groupBy("user_id", "session_id").agg(F.count("*").alias("n"))
    return chunks.groupBy("user_id").agg(F.count("*").alias("chunks"), F.max("n").alias("largest"))


@query("nested_sessions", f"""{LINKED_SQL},
m AS (SELECT session_id, string_agg(hash, ',' ORDER BY t, hash) AS hashes FROM linked GROUP BY 1)
SELECT s.id, string_agg(c.command, ';' ORDER BY c.timestamp, c.id) AS commands, coalesce(any_value(m.hashes), '') AS hashes
FROM sessions s JOIN commands c ON c.session_id = s.id LEFT JOIN m ON m.session_id = s.id GROUP BY 1""")
def _nested(c: Core) -> DataFrame:
    text = lambda a, f, sep: F.coalesce(F.array_join(F.transform(a, lambda x: x[f]), sep), F.lit(""))
    return joins.nested_sessions(c.sessions, c.commands, c.commits, KEYS).select("id", text("commands", "command", ";").alias("commands"), text("commits", "hash", ",").alias("hashes"))


@query("session_commits", f"{LINKED_SQL} SELECT session_id, hash, t FROM linked")
def _session_commits(c: Core) -> DataFrame:
    return joins.sessions_with_commits(c.sessions, c.commits, KEYS).select("session_id", "hash", "t")


@query("session_commits_open_hour", """SELECT s.id AS session_id, m.hash FROM sessions s JOIN commits m
ON m.user_id = s.user_id AND m.project_id = s.project_id AND m.timestamp BETWEEN s.start_time - 300 AND CASE WHEN s.n_commands = 1 THEN s.start_time + 3600 ELSE s.end_time END + 600""")
def _open_hour(c: Core) -> DataFrame:
    opened = c.sessions.withColumn("end_time", F.when(F.col("n_commands") > 1, F.col("end_time")))
    return joins.sessions_with_commits(opened, c.commits, KEYS, open_seconds=3600).select("session_id", "hash")


@query("projects_with_stats", """SELECT p.id, p.name, p.path, p.first_seen, p.last_seen, coalesce(count(s.id), 0) AS session_count, coalesce(sum(s.duration_seconds), 0)::BIGINT AS total_time
FROM projects p LEFT JOIN sessions s ON s.project_id = p.id GROUP BY ALL""")
def _projects(c: Core) -> DataFrame:
    return insights.projects_with_stats(c.projects, c.sessions)


@query("range_filter", f"SELECT id, start_time FROM sessions WHERE start_time BETWEEN {CUTOFF} AND {NOW}")
def _range(c: Core) -> DataFrame:
    return c.sessions.where(F.col("start_time").between(CUTOFF, NOW)).select("id", "start_time")


@query("calendar_ranges", """SELECT timestamp, epoch(date_trunc('week', make_timestamp(timestamp * 1000000)))::BIGINT AS week_start,
epoch(date_trunc('month', make_timestamp(timestamp * 1000000)))::BIGINT AS month_start FROM raw""")
def _calendar(c: Core) -> DataFrame:
    t = F.col("timestamp")
    return c.commands.select("timestamp", C.calendar_range(t, "week")[0].alias("week_start"), C.calendar_range(t, "month")[0].alias("month_start"))


@query("durations_and_buckets", """SELECT id, CASE WHEN duration_seconds <= 0 THEN '0s' WHEN duration_seconds < 60 THEN duration_seconds || 's'
  WHEN duration_seconds < 3600 THEN (duration_seconds // 60) || 'm' WHEN duration_seconds < 86400 THEN (duration_seconds // 3600) || 'h ' || (duration_seconds % 3600 // 60) || 'm'
  ELSE (duration_seconds // 86400) || 'd ' || (duration_seconds % 86400 // 3600) || 'h' END AS readable, hour(make_timestamp(start_time * 1000000)) >= 23 OR hour(make_timestamp(start_time * 1000000)) < 5 AS late FROM sessions""")
def _durations(c: Core) -> DataFrame:
    return c.sessions.select("id", C.format_duration(F.col("duration_seconds")).alias("readable"), C.late_night(F.col("start_time")).alias("late"))


@query("long_gaps", """g AS (SELECT id, lead(start_time) OVER (PARTITION BY user_id ORDER BY start_time, id) - end_time AS gap_seconds FROM sessions)
SELECT id, gap_seconds, gap_seconds // 86400 AS gap_days FROM g WHERE gap_seconds >= 172800""")
def _gaps(c: Core) -> DataFrame:
    return sessions.long_gaps(c.sessions, KEYS, 172800).select("id", "gap_seconds", "gap_days")


@query("absence_signatures", """lastc AS (SELECT session_id, arg_max(command, (timestamp, id)) AS command FROM commands GROUP BY 1),
g AS (SELECT id, lead(start_time) OVER (PARTITION BY user_id ORDER BY start_time, id) - end_time AS gap FROM sessions)
SELECT command, count(*) AS times FROM g JOIN lastc ON lastc.session_id = g.id WHERE gap >= 86400 GROUP BY 1""")
def _absence(c: Core) -> DataFrame:
    return sessions.last_commands_before_absence(c.sessions, c.commands, KEYS, 86400).select("command", "times")


@query("streaks", """d AS (SELECT DISTINCT user_id, make_timestamp(start_time * 1000000)::DATE AS d FROM sessions),
i AS (SELECT user_id, d, d - (row_number() OVER (PARTITION BY user_id ORDER BY d))::INT AS island FROM d),
r AS (SELECT user_id, count(*) AS n, max(d) AS last FROM i GROUP BY user_id, island)
SELECT user_id, CASE WHEN DATE '2024-01-31' - max(last) <= 1 THEN arg_max(n, last) ELSE 0 END AS streak FROM r WHERE last <= DATE '2024-01-31' GROUP BY 1""")
def _streaks(c: Core) -> DataFrame:
    return sessions.streaks(c.sessions, KEYS, F.lit("2024-01-31").cast("date"))


@query("inferred_breaks", """b AS (SELECT id, end_time AS break_start, lead(start_time) OVER (PARTITION BY user_id ORDER BY start_time, id) - end_time AS seconds, hour(make_timestamp(end_time * 1000000)) AS h FROM sessions)
SELECT id, break_start, seconds, CASE WHEN h BETWEEN 11 AND 14 THEN 'lunch' WHEN h BETWEEN 18 AND 21 THEN 'dinner' WHEN h >= 23 OR h < 5 THEN 'sleep' ELSE 'break' END AS kind FROM b WHERE seconds >= 600""")
def _breaks(c: Core) -> DataFrame:
    return sessions.inferred_breaks(c.sessions, KEYS).select("id", "break_start", "seconds", "kind")


@query("relative_timeline", """SELECT session_id, id, timestamp - min(timestamp) OVER (PARTITION BY session_id) AS "offset",
coalesce(timestamp - lag(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp, id), 0) AS since_previous FROM commands""")
def _timeline(c: Core) -> DataFrame:
    return sessions.relative_timeline(c.commands).drop("command")


@query("keep_best_duplicates", "SELECT project_id, arg_max(id, (n_commands, -start_time, -id)) AS id FROM sessions GROUP BY 1")
def _best(c: Core) -> DataFrame:
    return sessions.keep_best(c.sessions, ["project_id"], F.col("n_commands").desc(), F.col("start_time"), F.col("id")).select("project_id", "id")


@query("first_seen_order", """f AS (SELECT user_id, command, min((timestamp, id)) AS o FROM commands GROUP BY 1, 2)
SELECT user_id, string_agg(command, '|' ORDER BY o) AS commands FROM f GROUP BY 1""")
def _first_seen(c: Core) -> DataFrame:
    out = sessions.first_seen_order(c.commands, KEYS, F.col("command"), F.struct("timestamp", "id"))
    return out.select("user_id", F.array_join("values", "|").alias("commands"))


@query("collapse_repeats", """l AS (SELECT *, lag(exit_code) OVER w AS p, row_number() OVER w AS r FROM commands WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id))
SELECT user_id, count(*) AS runs FROM l WHERE r = 1 OR exit_code IS DISTINCT FROM p GROUP BY 1""")
def _collapse(c: Core) -> DataFrame:
    return sessions.collapse_repeats(c.commands, KEYS, "exit_code", ["timestamp", "id"]).groupBy("user_id").agg(F.count("*").alias("runs"))


@query("personal_best_days", """d AS (SELECT user_id, make_timestamp(timestamp * 1000000)::DATE AS day, count(*) AS n FROM commands GROUP BY ALL)
SELECT user_id, day, n FROM d QUALIFY n = max(n) OVER (PARTITION BY user_id)""")
def _best_days(c: Core) -> DataFrame:
    per = c.commands.groupBy("user_id", C.day(F.col("timestamp")).alias("day")).agg(F.count("*").alias("n"))
    return sessions.personal_best_days(per, KEYS)


@query("command_lookup", "SELECT command, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM commands GROUP BY 1")
def _lookup(c: Core) -> DataFrame:
    return store.command_lookup(c.commands).select("command", F.size("times").cast("long").alias("n"), F.col("times")[0].alias("first"), F.element_at("times", -1).alias("last"))


@query("project_breakdown", """s AS (SELECT project_id AS p, count(*) AS sessions, sum(duration_seconds) AS d FROM sessions GROUP BY 1), c AS (SELECT project_id AS p, count(*) AS commands FROM commands GROUP BY 1)
SELECT coalesce(n.name, 'Other') AS name, sum(s.sessions)::BIGINT AS sessions, sum(c.commands)::BIGINT AS commands, sum(s.d)::BIGINT AS duration
FROM s JOIN c ON s.p IS NOT DISTINCT FROM c.p LEFT JOIN projects n ON n.id = s.p GROUP BY 1""")
def _breakdown(c: Core) -> DataFrame:
    return insights.project_breakdown(c.sessions, c.commands, c.projects).select("name", "sessions", "commands", "duration")


@query("activity_window", """SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT sum(duration_seconds) FROM sessions)::BIGINT AS duration, (SELECT count(*) FROM commands) AS commands,
(SELECT min(timestamp) FROM commands) AS first, (SELECT max(timestamp) FROM commands) AS last""")
def _window(c: Core) -> DataFrame:
    return insights.activity_window(c.sessions, c.commands)


@query("time_distribution", """t AS (SELECT user_id, coalesce(p.name, 'General / No Project') AS name, sum(duration_seconds) AS duration FROM sessions s LEFT JOIN projects p ON p.id = s.project_id GROUP BY 1, 2)
SELECT user_id, name, duration::BIGINT AS duration, duration / sum(duration) OVER (PARTITION BY user_id) * 100 AS percent FROM t QUALIFY sum(duration) OVER (PARTITION BY user_id) > 0""")
def _distribution(c: Core) -> DataFrame:
    return insights.time_distribution(c.sessions, c.projects, KEYS)


@query("time_of_day_split", """m AS (SELECT user_id, duration_seconds AS d, hour(make_timestamp(((start_time + end_time) // 2) * 1000000)) AS h FROM sessions)
SELECT user_id, coalesce(sum(d) FILTER (h >= 6 AND h < 12), 0)::BIGINT AS morning, coalesce(sum(d) FILTER (h >= 12 AND h < 18), 0)::BIGINT AS afternoon, coalesce(sum(d) FILTER (h < 6 OR h >= 18), 0)::BIGINT AS evening FROM m GROUP BY 1""")
def _time_of_day(c: Core) -> DataFrame:
    return insights.time_of_day_split(c.sessions, KEYS)


@query("day_of_week_split", "SELECT user_id, " + ", ".join(f"coalesce(sum(duration_seconds) FILTER (dayname(make_timestamp(start_time * 1000000)) = '{d}'), 0)::BIGINT AS {d.lower()}" for d in insights.WEEKDAYS) + " FROM sessions GROUP BY 1")
def _day_of_week(c: Core) -> DataFrame:
    return insights.day_of_week_split(c.sessions, KEYS)


@query("focus_score", """d AS (SELECT user_id, make_timestamp(start_time * 1000000)::DATE AS day, count(DISTINCT coalesce(project_id, -1)) AS n, sum(duration_seconds) AS d, count(*) AS s FROM sessions GROUP BY 1, 2),
t AS (SELECT user_id, avg(n) AS per_day, sum(d) / sum(s) / 60 AS minutes FROM d GROUP BY 1)
SELECT user_id, greatest(0.0, least(10.0, 6.0 - greatest(0.0, (per_day - 1) * 1.5) + least(4.0, minutes / 20)))::DOUBLE AS focus FROM t""")
def _focus(c: Core) -> DataFrame:
    return insights.focus_score(c.sessions, KEYS)


@query("class_counts", """k AS (SELECT user_id, string_split_regex(lower(trim(command)), '\\s+') AS w, command FROM commands),
f AS (SELECT user_id, CASE WHEN contains(command, '|') OR list_has_any(w, ['grep', 'awk', 'sed']) THEN 1 WHEN list_has_any(w, ['docker', 'docker-compose', 'podman']) THEN 2 WHEN list_has_any(w, ['git', 'gh']) THEN 3
  WHEN list_has_any(w, ['npm', 'yarn', 'pnpm', 'npx']) THEN 4 WHEN list_has_any(w, ['python', 'python3', 'pytest', 'poetry', 'pip']) THEN 5 END AS c FROM k)
SELECT user_id, count(*) AS total, count(*) FILTER (c = 2) AS docker_demolitionist, count(*) FILTER (c = 3) AS git_paladin, count(*) FILTER (c = 4) AS frontend_bard, count(*) FILTER (c = 5) AS python_alchemist FROM f GROUP BY 1""")
def _classes(c: Core) -> DataFrame:
    return insights.class_counts(c.commands, KEYS).select("user_id", "total", "docker_demolitionist", "git_paladin", "frontend_bard", "python_alchemist")


@query("daily_class")
def _daily_class(c: Core) -> DataFrame:
    return insights.daily_class(c.commands, KEYS)


@query("late_night_index", """c AS (SELECT user_id, count(*) AS commands, count(*) FILTER (hour(make_timestamp(timestamp * 1000000)) < 5) AS late_commands FROM commands GROUP BY 1),
m AS (SELECT user_id, count(DISTINCT hash) AS commits, count(DISTINCT hash) FILTER (hour(make_timestamp(timestamp * 1000000)) < 5) AS late_commits FROM commits GROUP BY 1)
SELECT user_id, coalesce(commands, 0) AS commands, coalesce(late_commands, 0) AS late_commands, coalesce(commits, 0) AS commits, coalesce(late_commits, 0) AS late_commits,
  coalesce(late_commands, 0) / greatest(coalesce(commands, 0), 1) * 100 AS percent FROM c FULL JOIN m USING (user_id)""")
def _late(c: Core) -> DataFrame:
    return insights.late_night_index(c.commands, c.commits, KEYS).drop("tier")


@query("chaotic_sessions", """p AS (SELECT session_id, count(*) AS commands, count(*) FILTER (exit_code IS NULL OR exit_code <> 0) AS failures FROM commands GROUP BY 1)
SELECT s.id, p.commands, p.failures FROM sessions s JOIN p ON p.session_id = s.id WHERE NOT is_legacy AND (hour(make_timestamp(start_time * 1000000)) >= 23 OR hour(make_timestamp(start_time * 1000000)) < 5) AND (p.commands >= 10 OR p.failures >= 3)""")
def _chaotic(c: Core) -> DataFrame:
    return insights.chaotic_sessions(c.sessions, c.commands).select("id", "commands", "failures")


@query("peak_hours", """SELECT h AS hour, (SELECT count(*) FROM commands WHERE hour(make_timestamp(timestamp * 1000000)) = h) AS n FROM range(24) r(h)""")
def _peak(c: Core) -> DataFrame:
    return insights.peak_hours(c.commands, [])


@query("heat_levels", """d AS (SELECT day::DATE AS day FROM generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY) g(day)),
n AS (SELECT make_timestamp(timestamp * 1000000)::DATE AS day, count(*) AS n FROM commands GROUP BY 1)
SELECT d.day, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 0 WHEN n < 5 THEN 1 WHEN n < 20 THEN 2 ELSE 3 END AS level FROM d LEFT JOIN n USING (day)""")
def _heat(c: Core) -> DataFrame:
    per = c.commands.groupBy(C.day(F.col("timestamp")).alias("day")).agg(F.count("*").alias("n"))
    return insights.heat_levels(C.fill_days(per, [], "2023-12-20", "2024-02-10"))


@query("daily_totals", """d AS (SELECT make_timestamp(start_time * 1000000)::DATE AS day, sum(duration_seconds)::BIGINT AS seconds FROM sessions WHERE NOT is_legacy GROUP BY 1)
SELECT day, seconds, round(seconds / max(seconds) OVER () * 40)::INT AS bar FROM d""")
def _totals(c: Core) -> DataFrame:
    return insights.daily_totals(c.sessions)


@query("punch_card", """SELECT left(dayname(make_timestamp(timestamp * 1000000)), 3) AS weekday, hour(make_timestamp(timestamp * 1000000)) AS hour, count(*) AS n,
CASE WHEN count(*) <= 10 THEN 1 WHEN count(*) <= 30 THEN 2 ELSE 3 END AS level FROM commands GROUP BY 1, 2""")
def _punch(c: Core) -> DataFrame:
    return insights.punch_card(c.commands, [])


@query("top_commands_per_project", """w AS (SELECT project_id, array_to_string((string_split_regex(trim(command), '\\s+'))[1:2], ' ') AS start, timestamp, id FROM commands),
n AS (SELECT project_id, start, count(*) AS n, min((timestamp, id)) AS o FROM w GROUP BY 1, 2)
SELECT project_id, start, n, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, o) AS rank FROM n QUALIFY rank <= 5""")
def _top(c: Core) -> DataFrame:
    return predict.top_commands(c.commands)


@query("session_tags", f"""{LINKED_SQL},
t AS (SELECT session_id, lower(command) AS x, false AS m FROM commands UNION ALL SELECT session_id, lower(message), true FROM linked),
f AS (SELECT session_id, """ + ", ".join(f"bool_or(CASE WHEN m THEN regexp_matches(x, '{X.whole_words(rules[1])}') ELSE regexp_matches(x, '{X.whole_words(rules[0])}') END) AS {tag}" for tag, rules in X.TAGS.items()) + """ FROM t GROUP BY 1)
SELECT session_id, concat_ws(',', """ + ", ".join(f"CASE WHEN {tag} THEN '{tag}' END" for tag in X.TAGS) + ") AS tags FROM f")
def _tags(c: Core) -> DataFrame:
    return insights.session_tags(c.commands, linked(c)).select("session_id", F.array_join("tags", ",").alias("tags"))


@query("tag_summary")
def _tag_summary(c: Core) -> DataFrame:
    return insights.tag_summary(c.sessions, insights.session_tags(c.commands, linked(c)))


@query("week_report")
def _week(c: Core) -> DataFrame:
    return insights.week_report(c.sessions, c.commands, c.projects).withColumn("top_classes", F.array_join("top_classes", ","))


@query("month_report", """SELECT coalesce(p.name, 'Other') AS name, count(DISTINCT make_timestamp(start_time * 1000000)::DATE) AS days, sum(duration_seconds)::BIGINT AS duration,
sum(duration_seconds) / count(DISTINCT make_timestamp(start_time * 1000000)::DATE) AS per_day FROM sessions s LEFT JOIN projects p ON p.id = s.project_id GROUP BY 1""")
def _month(c: Core) -> DataFrame:
    return insights.month_report(c.sessions, c.projects)


@query("project_report")
def _project_report(c: Core) -> DataFrame:
    out = insights.project_report(c.sessions, insights.session_memory(c.commands, linked(c)))
    return out.select("project_id", "day", F.array_join("values", "|").alias("memories"))


@query("period_telemetry", """s AS (SELECT user_id, sum(duration_seconds) / 3600 AS hours, count(*) AS sessions FROM sessions GROUP BY 1),
c AS (SELECT user_id, count(*) AS commands, count(*) FILTER (exit_code IS NULL OR exit_code = 0) AS ok FROM commands GROUP BY 1), m AS (SELECT user_id, count(DISTINCT hash) AS commits FROM commits GROUP BY 1)
SELECT user_id, hours, sessions, commands, coalesce(commits, 0) AS commits, ok * 100 / commands AS success_percent FROM s JOIN c USING (user_id) LEFT JOIN m USING (user_id)""")
def _telemetry(c: Core) -> DataFrame:
    return insights.period_telemetry(c.sessions, c.commands, c.commits, KEYS).select("user_id", "hours", "sessions", "commands", "commits", "success_percent")


@query("highlight_days", """n AS (SELECT make_timestamp(timestamp * 1000000)::DATE AS day, count(*) AS n FROM commands GROUP BY 1)
SELECT day FROM n WHERE n = (SELECT max(n) FROM n) UNION SELECT make_timestamp(start_time * 1000000)::DATE FROM sessions WHERE duration_seconds >= 172800""")
def _highlights(c: Core) -> DataFrame:
    return insights.highlight_days(c.sessions, c.commands, 172800)


@query("edited_files", """SELECT regexp_extract(command, '([^/ ]+)$', 1) AS file, count(*) AS n, 'Core Logic' AS layer FROM commands WHERE command LIKE 'vim %' GROUP BY 1""")
def _edited(c: Core) -> DataFrame:
    return insights.edited_files(c.commands)


@query("query_profile", """SELECT trim(regexp_replace(command, '\\s+', ' ', 'g')) AS sql, count(*) AS n, sum(coalesce(exit_code, 0))::BIGINT AS total, avg(coalesce(exit_code, 0)) AS mean FROM commands GROUP BY 1""")
def _profile(c: Core) -> DataFrame:
    return insights.query_profile(c.commands.select(F.col("command").alias("sql"), F.coalesce("exit_code", F.lit(0)).alias("duration")))


@query("calendar_tree")
def _tree(c: Core) -> DataFrame:
    marked = c.commands.withColumn("recovery_source", F.when(F.pmod("id", F.lit(50)) == 0, "between anchors"))
    tree = insights.calendar_tree(c.sessions, marked, c.projects)
    leaf = lambda x: F.concat_ws(":", x["id"].cast("string"), x["duration_seconds"].cast("string"), x["kind"])
    return tree.select("month", "day", "project", F.array_join(F.transform("sessions", leaf), ",").alias("sessions"))


@query("insight_patterns")
def _patterns(c: Core) -> DataFrame:
    return insights.patterns(c.sessions, c.commands, KEYS)


@query("usage_anomalies", f"""t AS (SELECT user_id, CASE WHEN command LIKE 'git %' THEN 'git' WHEN command LIKE 'docker %' THEN 'docker' END AS tool, timestamp FROM commands),
n AS (SELECT user_id, tool, count(*) FILTER (timestamp >= {CUTOFF}) AS now, count(*) FILTER (timestamp < {CUTOFF}) AS before FROM t WHERE tool IS NOT NULL GROUP BY 1, 2)
SELECT user_id, tool, now, before, now / before AS ratio FROM n WHERE before > 0 AND (now / before >= 1.5 OR now / before <= 0.7)""")
def _anomalies(c: Core) -> DataFrame:
    return insights.usage_anomalies(c.commands, KEYS, ["git", "docker"], CUTOFF)


@query("language_share")
def _languages(c: Core) -> DataFrame:
    named = c.spark.range(1, 4).select(F.col("id").alias("project_id"), F.when(F.col("id") == 1, "Rust").when(F.col("id") == 2, "Go").alias("language"))
    return insights.language_share(c.commands, named)


@query("rebuild_clusters")
def _rebuilds(c: Core) -> DataFrame:
    return sessions.rebuild_clusters(c.commands, KEYS, F.col("command").contains("npm run build"), window=86400)


@query("failures_before_commits", """SELECT m.hash, count(*) AS failures FROM commits m JOIN commands c ON c.user_id = m.user_id AND c.project_id = m.project_id AND c.exit_code <> 0
AND c.timestamp >= m.timestamp - 43200 AND c.timestamp < m.timestamp GROUP BY 1""")
def _failures(c: Core) -> DataFrame:
    return joins.failures_before_commits(c.commits, c.sessions, c.commands, KEYS, 43200).select("hash", "failures")


@query("interrupted_sessions", f"""SELECT s.id, s.end_time AS ended FROM sessions s WHERE s.end_time BETWEEN {NOW} - 604800 AND {NOW} - 43200
AND NOT EXISTS (SELECT 1 FROM sessions n WHERE n.user_id = s.user_id AND n.project_id = s.project_id AND n.start_time > s.end_time AND n.start_time <= s.end_time + 43200)""")
def _interrupted(c: Core) -> DataFrame:
    return joins.interrupted_sessions(c.sessions, KEYS, NOW).select("id", "ended")


@query("timestamp_locking", """a AS (SELECT user_id, id, command, row_number() OVER (PARTITION BY user_id, command ORDER BY id) AS n FROM commands),
b AS (SELECT user_id, command, timestamp, row_number() OVER (PARTITION BY user_id, command ORDER BY timestamp) AS n FROM commands WHERE id % 2 = 0)
SELECT a.id, b.timestamp, b.timestamp IS NOT NULL AS locked FROM a LEFT JOIN b USING (user_id, command, n)""")
def _locking(c: Core) -> DataFrame:
    blank = c.commands.select("user_id", "id", "command", F.col("id").alias("position"), F.lit(None).cast("long").alias("timestamp"))
    return joins.nth_occurrence(blank, c.commands.where("id % 2 = 0"), KEYS).select("id", "timestamp", "locked")


@query("compare_days", """a AS (SELECT project_id, sum(duration_seconds) AS d FROM sessions WHERE make_timestamp(start_time * 1000000)::DATE = DATE '2024-01-16' AND project_id IS NOT NULL GROUP BY 1),
b AS (SELECT project_id, sum(duration_seconds) AS d FROM sessions WHERE make_timestamp(start_time * 1000000)::DATE = DATE '2024-01-15' AND project_id IS NOT NULL GROUP BY 1)
SELECT project_id, coalesce(a.d, 0)::BIGINT AS current, coalesce(b.d, 0)::BIGINT AS previous, (coalesce(a.d, 0) - coalesce(b.d, 0))::BIGINT AS difference FROM a FULL JOIN b USING (project_id)""")
def _compare(c: Core) -> DataFrame:
    day = lambda d: c.sessions.where((C.day(F.col("start_time")) == F.lit(d).cast("date")) & F.col("project_id").isNotNull()).groupBy("project_id").agg(F.sum("duration_seconds").alias("d"))
    return joins.compare_days(day("2024-01-16"), day("2024-01-15"), ["project_id"], "d")


@query("project_signals")
def _signals(c: Core) -> DataFrame:
    out = predict.project_signals(c.sessions, KEYS, NOW)
    return out.select("user_id", "project_id", "sessions", *[F.round(x, 6).alias(x) for x in ("recency", "hour_share", "day_share", "score")])


@query("predict_next")
def _predict(c: Core) -> DataFrame:
    mixed = c.sessions.withColumn("project_id", F.pmod("id", F.lit(5)))
    out = predict.predict_next(mixed, c.commands, KEYS, NOW)
    return out.select("user_id", "project_id", "rank", F.array_join("signals", ",").alias("signals"), F.round("score", 6).alias("score"))


@query("noise_and_classes", """SELECT id, CASE WHEN lower(command) IN ('ls -la') OR command LIKE 'ls %' OR command LIKE 'cd %' OR command LIKE 'cat %' OR command = 'git status' THEN true ELSE false END AS noise,
CASE WHEN command LIKE 'git %' THEN 'git' WHEN command LIKE 'docker %' THEN 'docker' WHEN command LIKE 'npm %' THEN 'npm' WHEN command LIKE 'pytest %' THEN 'python' WHEN command LIKE 'vim %' THEN 'vim' ELSE split_part(command, ' ', 1) END AS class FROM commands""")
def _noise(c: Core) -> DataFrame:
    return c.commands.select("id", X.is_noise(F.col("command")).alias("noise"), X.classify_command(F.col("command")).alias("class"))


@query("clean_commits", """SELECT hash, 'Purchase ' || regexp_extract(message, 'purchase (\\d+)', 1) AS cleaned FROM commits""")
def _clean(c: Core) -> DataFrame:
    return c.commits.select("hash", X.clean_commit(F.col("message")).alias("cleaned"))


@query("chain_split", """SELECT id, len(string_split(command, '&&')) AS parts FROM commands""")
def _chain(c: Core) -> DataFrame:
    return c.commands.select("id", F.size(X.split_chain(F.col("command"))).cast("long").alias("parts"))


@query("text_entropy", """ch AS (SELECT id, unnest(string_split(command, '')) AS x, length(command) AS n FROM commands), f AS (SELECT id, x, n, count(*) AS k FROM ch GROUP BY ALL)
SELECT id, round(sum(-(k / n) * log2(k / n)), 6) AS bits FROM f GROUP BY 1""")
def _entropy(c: Core) -> DataFrame:
    return c.commands.select("id", F.round(X.entropy(F.col("command")), 6).alias("bits"))


@query("redact_commands")
def _redact(c: Core) -> DataFrame:
    return c.commands.select("id", R.redact(F.col("command")).alias("redacted"), R.is_blacklisted(F.col("command")).alias("blacklisted"))


@query("redact_documents")
def _redact_documents(c: Core) -> DataFrame:
    return c.table("documents").select("doc_id", F.sha2(R.redact(F.col("text")).cast("binary"), 256).alias("sha256"), R.redaction_counts(F.col("text")).alias("counts"))


# The SQL has no look-around: a match takes the character after it, so of neighbours that share one every second waits for the second pass.
ADDRESS_SQL = r"'(^|[^\d.])(?:\d{1,3}\.){3}\d{1,3}($|[^\d.])', '\1[REDACTED_IP]\2', 'g'"


@query("redact_addresses", f"SELECT doc_id, regexp_replace(regexp_replace(text, {ADDRESS_SQL}), {ADDRESS_SQL}) AS t FROM documents", bare=True)
def _addresses(c: Core) -> DataFrame:
    return c.table("documents").select("doc_id", F.regexp_replace("text", R.ADDRESSES[0][1], R.ADDRESSES[0][2]).alias("t"))


@query("gate_sessions", """b AS (SELECT DISTINCT session_id FROM commands WHERE regexp_matches(command, '(?i)\\b(?:password|passwd|pwd|secret)\\b\\s*[=:]\\s*\\S+'))
SELECT c.id, b.session_id IS NOT NULL AS blocked FROM commands c LEFT JOIN b USING (session_id)""")
def _gate(c: Core) -> DataFrame:
    return store.gate_sessions(c.commands).select("id", "blocked")


@query("safe_context")
def _context(c: Core) -> DataFrame:
    return store.safe_context(c.commands, 50, ["ssh*"]).select("id", "command")


@query("postings", "SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1", bare=True)
def _postings(c: Core) -> DataFrame:
    return search.postings(c.table("documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


BM25_SQL = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), s AS (SELECT count(*) AS n, sum(len(w)) AS total FROM t),
q AS (SELECT unnest(['the', 'erth', 'thing', 'onand']) AS term),
f AS (SELECT doc_id, len(w) AS l, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, q), p AS (SELECT * FROM f WHERE tf > 0), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1 + 1e-9) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / (total / (n + 1e-9))))), 6) AS score FROM p JOIN d USING (term), s GROUP BY 1"""


@query("bm25_documents", BM25_SQL, bare=True)
def _bm25(c: Core) -> DataFrame:
    return search.bm25(c.table("documents"), "doc_id", "text", ["the", "erth", "thing", "onand"]).select("doc_id", F.round("score", 6).alias("score"))


@query("exactness_tiers", """c AS (SELECT c.session_id AS id, least(CASE WHEN lower(trim(command)) = 'git' THEN 0 WHEN starts_with(lower(trim(command)), 'git') THEN 1 WHEN contains(lower(command), 'git') THEN 5 ELSE 6 END,
  CASE WHEN contains(lower(coalesce(p.name, '')), 'git') THEN 4 ELSE 6 END) AS t FROM commands c LEFT JOIN projects p ON p.id = c.project_id)
SELECT id, min(t)::INT AS tier FROM c GROUP BY 1""")
def _tiers(c: Core) -> DataFrame:
    return search.exactness_tier(c.sessions, c.commands, c.projects, "git")


@query("standard_search", f"""{LINKED_SQL},
h AS (SELECT session_id AS id FROM commands WHERE command ILIKE '%docker%' UNION SELECT session_id FROM linked WHERE message ILIKE '%docker%'),
t AS (SELECT session_id AS id, min(CASE WHEN starts_with(lower(command), 'docker') THEN 1 WHEN contains(lower(command), 'docker') THEN 5 ELSE 6 END) AS tier FROM commands GROUP BY 1)
SELECT s.id, t.tier::INT AS tier FROM sessions s JOIN h USING (id) JOIN t USING (id) WHERE s.start_time >= {CUTOFF} ORDER BY tier, s.start_time DESC, s.id DESC LIMIT 50""")
def _standard(c: Core) -> DataFrame:
    return search.standard_search(c.sessions, c.commands, linked(c), c.projects, "docker", since=CUTOFF).select("id", "tier")


@query("index_search")
def _index(c: Core) -> DataFrame:
    rows = search.index_rows(c.commands, c.commits, c.sessions)
    return search.index_search(rows, c.sessions, c.commands, c.projects, "git comm").select("id", "tier", F.round("score", 6).alias("score"))


@query("ask_sessions")
def _ask(c: Core) -> DataFrame:
    docs = search.session_documents(c.sessions, c.commands, linked(c), c.projects)
    return search.ask(docs, "docker build npm").select("id", F.round("score", 6).alias("score"))


@query("cosine_nearest", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]))), 6) AS score FROM embeddings, q""", bare=True)
def _cosine(c: Core) -> DataFrame:
    v = c.table("embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("e"))
    return v.crossJoin(F.broadcast(one)).select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))


@query("hybrid_search", BM25_SQL.replace("['the', 'erth', 'thing', 'onand']", "['the', 'erth']").replace("SELECT doc_id, round(sum(ln", ", b AS (SELECT doc_id, sum(ln").replace("))))), 6) AS score FROM p JOIN d USING (term), s GROUP BY 1", """))))) AS score FROM p JOIN d USING (term), s GROUP BY 1),
v0 AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS doc_id, list_dot_product(embedding::DOUBLE[], e) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e, e))) AS s FROM embeddings, v0 WHERE vec_id IN (SELECT doc_id FROM documents)),
c AS (SELECT v.doc_id, s, coalesce(b.score, 0) AS l FROM v LEFT JOIN b USING (doc_id)),
m AS (SELECT min(s) AS s0, max(s) AS s1, min(l) AS l0, max(l) AS l1 FROM c)
SELECT doc_id, round(0.5 * (s - s0) / greatest(s1 - s0, 1e-9) + 0.5 * (l - l0) / greatest(l1 - l0, 1e-9), 6) AS score FROM c, m ORDER BY score DESC, doc_id LIMIT 10"""), bare=True)
def _hybrid(c: Core) -> DataFrame:
    """Words and the vector of item 0, over the documents that have a vector."""
    v = c.table("embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("e"))
    near = v.crossJoin(F.broadcast(one)).select(F.col("vec_id").alias("doc_id"), search.cosine(F.col("embedding"), F.col("e")).alias("score"))
    found = search.hybrid(search.bm25(c.table("documents"), "doc_id", "text", ["the", "erth"]), near.join(c.table("documents").select("doc_id"), "doc_id", "left_semi"), "doc_id")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("leader_clusters")
def _leaders(c: Core) -> DataFrame:
    return search.leader_clusters(c.table("embeddings"), ["label"], "embedding", "vec_id", 0.6)


@query("command_clusters", """d AS (SELECT user_id, command, min((timestamp, id)) AS o, split_part(command, ' ', 1) AS word FROM commands GROUP BY 1, 2)
SELECT user_id, word, string_agg(command, '|' ORDER BY o) AS commands FROM d GROUP BY 1, 2""")
def _clusters(c: Core) -> DataFrame:
    return search.command_clusters(c.commands, KEYS).select("user_id", "word", F.array_join("commands", "|").alias("commands"))


@query("query_expansion")
def _expansion(c: Core) -> DataFrame:
    asked = c.table("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"))
    anchors = search.postings(c.table("documents"), "doc_id", "text").groupBy("term").agg(F.min("ref").alias("r")).select(F.col("term").alias("word"), F.concat(F.lit("doc"), F.col("r").cast("string")).alias("anchor"))
    return search.expand_queries(asked, anchors)


@query("project_search", "SELECT id, CASE WHEN lower(name) = 'project 3' THEN 0 WHEN starts_with(lower(name), 'project 3') THEN 1 WHEN contains(lower(name), 'project 3') THEN 2 ELSE 3 END AS rank FROM projects WHERE name ILIKE '%project 3%' OR path ILIKE '%project 3%'")
def _project_search(c: Core) -> DataFrame:
    return search.search_projects(c.projects, "project 3").select("id", "rank")


@query("interpolated_times", f"""a AS (SELECT user_id, id AS i, CASE WHEN id % 3 = 0 THEN timestamp END AS t FROM commands),
b AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS bi, first_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ai FROM a)
SELECT b.i AS id, trunc(x.t + (y.t - x.t) * (b.i - bi) / (ai - bi))::BIGINT AS timestamp FROM b JOIN a x ON x.user_id = b.user_id AND x.i = bi JOIN a y ON y.user_id = b.user_id AND y.i = ai WHERE b.t IS NULL""")
def _interpolated(c: Core) -> DataFrame:
    rows = c.commands.select("user_id", F.col("id").alias("position"), F.when(F.pmod("id", F.lit(3)) == 0, F.col("timestamp")).alias("timestamp"))
    return recovery.interpolate(rows, KEYS, NOW).where("recovery_source = 'between anchors'").select(F.col("position").alias("id"), "timestamp")


@query("bounded_gap_fill")
def _bounded(c: Core) -> DataFrame:
    rows = c.commands.select("user_id", F.col("id").alias("position"), F.when(F.pmod("id", F.lit(3)) == 0, F.col("timestamp")).alias("timestamp"))
    return recovery.fill_bounded_gaps(rows, KEYS, NOW)


@query("burst_placement")
def _bursts(c: Core) -> DataFrame:
    return recovery.place_bursts(c.commands.select("user_id", F.col("id").alias("position"), "command"), KEYS, NOW)


@query("commit_matching")
def _matching(c: Core) -> DataFrame:
    asked = c.commits.select("user_id", F.crc32(F.col("hash").cast("binary")).alias("position"), X.clean_commit(F.col("message")).alias("message"))
    return recovery.match_commits(asked, c.commits.withColumn("message", X.clean_commit(F.col("message"))), KEYS)


@query("directory_replay")
def _replay(c: Core) -> DataFrame:
    return attribution.replay_directories(c.commands.select("user_id", "id", "timestamp", "command"), KEYS, "/home/dev", reset_after=86400)


@query("neighbour_propagation")
def _propagate(c: Core) -> DataFrame:
    sparse = c.sessions.withColumn("project_id", F.when(F.pmod("id", F.lit(3)) == 0, F.pmod("id", F.lit(4))))
    return attribution.propagate_neighbours(sparse, KEYS, 172800).select("id", "propagated")


@query("nearest_activity", """o AS (SELECT s.* FROM sessions s WHERE id % 3 <> 0 AND EXISTS (SELECT 1 FROM commands c WHERE c.session_id = s.id AND contains(command, 'git '))),
k AS (SELECT *, id % 4 AS p FROM sessions WHERE id % 3 = 0),
g AS (SELECT o.id, k.p, k.start_time AS os, k.id AS other, least(abs(o.start_time - k.end_time), abs(k.start_time - o.end_time)) AS gap FROM o JOIN k ON o.user_id = k.user_id)
SELECT id, arg_min(p, (gap, os, other)) AS inferred FROM g WHERE gap < 86400 GROUP BY 1""")
def _nearest_activity(c: Core) -> DataFrame:
    sparse = c.sessions.withColumn("project_id", F.when(F.pmod("id", F.lit(3)) == 0, F.pmod("id", F.lit(4))))
    return attribution.nearest_activity(sparse, c.commands, KEYS, 86400)


@query("upsert_sessions", f"""a AS (SELECT user_id, start_time, project_id, end_time, duration_seconds AS d, 'kept' AS summary FROM sessions WHERE start_time < {CUTOFF}),
b AS (SELECT user_id, start_time, project_id, end_time + 1 AS end_time, duration_seconds + 1 AS d FROM sessions WHERE start_time >= {CUTOFF} - 604800)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.start_time, b.start_time) AS start_time, coalesce(b.end_time, a.end_time) AS end_time, coalesce(b.d, a.d) AS duration_seconds, a.summary AS ai_summary
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.start_time = b.start_time AND a.project_id IS NOT DISTINCT FROM b.project_id""")
def _upsert(c: Core) -> DataFrame:
    none = F.lit(None).cast("string")
    old = c.sessions.where(F.col("start_time") < CUTOFF).withColumn("ai_summary", F.lit("kept")).withColumn("tags", none)
    new = c.sessions.where(F.col("start_time") >= CUTOFF - 604800).withColumn("end_time", F.col("end_time") + 1).withColumn("duration_seconds", F.col("duration_seconds") + 1).withColumn("ai_summary", none).withColumn("tags", none)
    return store.upsert_sessions(old, new, KEYS).drop("tags", "project_id")


@query("archive_split", f"""SELECT 'sessions' AS part, count(*) FILTER (start_time < {CUTOFF}) AS old, count(*) FILTER (start_time >= {CUTOFF}) AS kept FROM sessions
UNION ALL SELECT 'commands', count(*) FILTER (s.start_time < {CUTOFF}), count(*) FILTER (s.start_time >= {CUTOFF}) FROM commands c JOIN sessions s ON s.id = c.session_id
UNION ALL SELECT 'commits', count(*) FILTER (timestamp < {CUTOFF}), count(*) FILTER (timestamp >= {CUTOFF}) FROM commits""")
def _archive(c: Core) -> DataFrame:
    summaries = c.spark.createDataFrame([], "timeframe_id string, type string, summary string, created_at long")
    parts = store.archive(c.sessions, c.commands, c.commits, summaries, CUTOFF)
    count = lambda p: parts[f"old_{p}"].agg(F.count("*").alias("old")).crossJoin(parts[p].agg(F.count("*").alias("kept"))).select(F.lit(p).alias("part"), "old", "kept")
    return count("sessions").union(count("commands")).union(count("commits"))


@query("consolidation", f"""big AS (SELECT user_id, id, timestamp, command, CASE WHEN timestamp - lag(timestamp) OVER w >= 1800 OR lag(timestamp) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM raw WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id)),
num AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY timestamp, id) AS n FROM big),
w AS (SELECT user_id, n, split_part(command, ' ', 1) AS word, count(*) AS k, min((timestamp, id)) AS o, min(timestamp) AS s, max(timestamp) AS e FROM num GROUP BY 1, 2, 3)
SELECT user_id, min(s) AS start_time, max(e) AS end_time, string_agg(word || ' x' || k, ' | ' ORDER BY o) AS summary FROM w GROUP BY user_id, n HAVING max(e) <= {NOW} - 1800""")
def _consolidation(c: Core) -> DataFrame:
    done = c.spark.createDataFrame([], "user_id long, start_time long, end_time long, summary string, commands array<string>")
    return store.consolidate(c.commands.drop("session_id"), done, KEYS, NOW).drop("commands")


@query("project_filter", "SELECT id FROM sessions WHERE project_id = 3")
def _filter(c: Core) -> DataFrame:
    return store.matches_project(c.sessions, c.commands, c.projects, "Project 3").select("id")


@query("json_export")
def _json(c: Core) -> DataFrame:
    nested = sinks.nested_export(c.sessions, c.commands, linked(c), c.projects)
    return nested.select("session_id", F.to_json(F.struct(*nested.columns)).alias("json"))


@query("csv_export")
def _csv(c: Core) -> DataFrame:
    return sinks.csv_export(sinks.nested_export(c.sessions, c.commands, linked(c), c.projects))


@query("markdown_export")
def _markdown(c: Core) -> DataFrame:
    return sinks.markdown_export(sinks.nested_export(c.sessions, c.commands, linked(c), c.projects))


@query("journal")
def _journal(c: Core) -> DataFrame:
    return sinks.journal(c.sessions, c.commands, c.projects)


@query("orphans_pruned", "SELECT count(*) AS n FROM sessions")
def _orphans(c: Core) -> DataFrame:
    return joins.prune_orphans(c.sessions, c.commands, KEYS).agg(F.count("*").alias("n"))


@query("report_meta", f"""SELECT 500 AS "limit", least(count(*), 500) AS returned, count(*) AS total, count(*) > 500 AS truncated FROM sessions WHERE start_time BETWEEN {CUTOFF} AND {NOW}""")
def _report(c: Core) -> DataFrame:
    return store.report_tables(c.sessions, c.commands, CUTOFF, NOW)["meta"].withColumn("returned", F.col("returned").cast("long"))


@query("commit_moods", """f AS (SELECT m.hash, count(c.id) AS failures FROM commits m LEFT JOIN commands c ON c.user_id = m.user_id AND c.project_id = m.project_id AND c.exit_code <> 0 AND c.timestamp >= m.timestamp - 43200 AND c.timestamp < m.timestamp GROUP BY 1)
SELECT hash, failures, CASE WHEN failures > 3 THEN 'RAGE & DESPAIR' WHEN failures >= 1 THEN 'FRUSTRATION / WORKAROUND' ELSE 'TRIUMPH / SMOOTH SAILING' END AS emotion FROM f""")
def _moods(c: Core) -> DataFrame:
    failures = joins.failures_before_commits(c.commits, c.sessions, c.commands, KEYS, 43200)
    clusters = sessions.rebuild_clusters(c.commands, KEYS, X.is_build(F.col("command")))
    return reports.commit_moods(c.commits, failures, clusters, KEYS, 43200).select("hash", "failures", "emotion")


@query("likely_bugs")
def _bugs(c: Core) -> DataFrame:
    return reports.likely_bugs(insights.chaotic_sessions(c.sessions, c.commands), c.commands)


@query("chronicle")
def _chronicle(c: Core) -> DataFrame:
    return reports.chronicle(c.sessions, c.commands, c.projects).withColumn("commands", F.array_join("commands", "|"))


@query("main_achievements")
def _achievements(c: Core) -> DataFrame:
    return reports.main_achievements(c.sessions, c.commands, linked(c))


@query("timeframe_header", f"""{LINKED_SQL},
s AS (SELECT user_id, sum(duration_seconds)::BIGINT AS seconds, count(DISTINCT coalesce(project_id, -1)) AS projects FROM sessions GROUP BY 1),
m AS (SELECT s.user_id, count(*) AS commits FROM linked l JOIN sessions s ON s.id = l.session_id GROUP BY 1)
SELECT user_id, seconds, projects, coalesce(commits, 0) AS commits FROM s LEFT JOIN m USING (user_id)""")
def _header(c: Core) -> DataFrame:
    return reports.header(c.sessions, joins.sessions_with_commits(c.sessions, c.commits, KEYS), KEYS).select("user_id", "seconds", F.col("projects").cast("long").alias("projects"), "commits")


@query("day_report")
def _day(c: Core) -> DataFrame:
    out = reports.day_report(c.sessions, insights.session_memory(c.commands, linked(c)), c.projects, F.lit("2024-01-16").cast("date"))
    return out.withColumn("memories", F.array_join("memories", "|"))


@query("recent_sessions", """f AS (SELECT session_id, arg_min(command, (timestamp, id)) AS first FROM commands GROUP BY 1)
SELECT s.id, CASE WHEN length(first) > 40 THEN left(first, 37) || '...' ELSE first END AS first FROM sessions s JOIN f ON f.session_id = s.id ORDER BY end_time DESC, start_time DESC, s.id DESC LIMIT 20""")
def _recent(c: Core) -> DataFrame:
    return reports.recent_sessions(c.sessions, c.commands).select("id", "first")


@query("commit_digest", f"""{LINKED_SQL},
o AS (SELECT project_id, lower(l.message) AS low, arg_min(l.message, (t, hash)) AS message, min((t, hash)) AS seen FROM linked l JOIN sessions s ON s.id = l.session_id GROUP BY 1, 2)
SELECT project_id, message, row_number() OVER (PARTITION BY project_id ORDER BY seen) AS rank FROM o QUALIFY rank <= 20""")
def _digest(c: Core) -> DataFrame:
    rows = linked(c).join(c.sessions.select(F.col("id").alias("session_id"), "project_id"), "session_id")
    return reports.commit_digest(rows, ["project_id"])
