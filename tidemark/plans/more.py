"""More registered queries: filters, search, insight records and point operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.adapters import COMMANDS_SQL, Core
from tidemark.functions import text as X
from tidemark.functions import time as C
from tidemark.operators import insights, joins, payloads, reports, search, sessions, store
from tidemark.plans.queries import CUTOFF, KEYS, LINKED_SQL, NOW, SQL, linked, query

DAY = "make_timestamp({} * 1000000)::DATE"
READABLE = """CASE WHEN duration_seconds <= 0 THEN '0s' WHEN duration_seconds < 60 THEN duration_seconds || 's' WHEN duration_seconds < 3600 THEN (duration_seconds // 60) || 'm'
  WHEN duration_seconds < 86400 THEN (duration_seconds // 3600) || 'h ' || (duration_seconds % 3600 // 60) || 'm' ELSE (duration_seconds // 86400) || 'd ' || (duration_seconds % 86400 // 3600) || 'h' END"""


def _also(name: str, sql: str) -> None:
    """SQL for a query that is registered without."""
    SQL[name] = f"{COMMANDS_SQL.rstrip()}{'' if sql.lstrip().startswith('SELECT') else ','}\n{sql}"


@query("id_filter", "SELECT id, start_time FROM sessions WHERE id % 7 = 0")
def _ids(c: Core) -> DataFrame:
    ids = c.commands.where("id % 7 = 0").select("id").union(c.spark.range(3).select(-F.col("id") - 1))
    return joins.by_ids(c.sessions, ids).select("id", "start_time")


@query("project_since", f"SELECT id, start_time FROM sessions WHERE project_id = 2 AND start_time >= {CUTOFF}")
def _since(c: Core) -> DataFrame:
    return joins.project_sessions_since(c.sessions, 2, CUTOFF).select("id", "start_time")


@query("tag_filter", """SELECT id FROM sessions s WHERE EXISTS (SELECT 1 FROM commands c WHERE c.session_id = s.id AND starts_with(command, 'pytest '))
AND EXISTS (SELECT 1 FROM commands c WHERE c.session_id = s.id AND contains(command, ' build'))""")
def _tagged(c: Core) -> DataFrame:
    return joins.with_tags(c.sessions, insights.session_tags(c.commands, linked(c)), ["test", " Setup"]).select("id")


@query("export_selection", f"SELECT id, start_time FROM sessions WHERE start_time BETWEEN {CUTOFF} AND {NOW} - 259200 AND project_id = 3")
def _selection(c: Core) -> DataFrame:
    return store.export_selection(c.sessions, c.commands, c.projects, "Project 3", CUTOFF, NOW - 259200).select("id", "start_time")


@query("interactive_filter", f"{LINKED_SQL} SELECT DISTINCT session_id AS id FROM linked WHERE message ILIKE '%purchase 1%'")
def _interactive(c: Core) -> DataFrame:
    links = linked(c)
    return store.interactive_filter(c.sessions, c.commands, links, c.projects, insights.session_memory(c.commands, links), "PURCHASE 1").select("id")


@query("advanced_search", f"""{LINKED_SQL},
h AS (SELECT session_id AS id FROM commands WHERE command ILIKE '%build%'),
t AS (SELECT session_id AS id, min(CASE WHEN contains(lower(command), 'build') THEN 5 ELSE 6 END) AS tier FROM commands GROUP BY 1)
SELECT s.id, s.start_time, t.tier::INT AS tier, 0.0::DOUBLE AS score FROM sessions s JOIN t USING (id) WHERE id IN (SELECT id FROM h) AND s.project_id = 3 AND s.start_time BETWEEN {CUTOFF} AND {NOW}
AND EXISTS (SELECT 1 FROM commands c WHERE c.session_id = s.id AND starts_with(command, 'pytest ')) ORDER BY tier, s.start_time DESC, s.id DESC LIMIT 20 OFFSET 1""")
def _advanced(c: Core) -> DataFrame:
    links = linked(c)
    tags = insights.session_tags(c.commands, links)
    return search.advanced_search(c.sessions, c.commands, links, c.projects, "build", "project 3", CUTOFF, NOW, tags, ("test",), limit=20, offset=1)


@query("advanced_search_index", f"""d AS (SELECT session_id AS id, string_agg(command, ' ') AS x FROM commands WHERE session_id IN (SELECT session_id FROM commands WHERE regexp_matches(lower(command), '(^|[^\\p{{L}}\\p{{N}}_])docker')) GROUP BY 1),
w AS (SELECT id, regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]+') AS w FROM d), f AS (SELECT id, len(w) AS l, len(list_filter(w, lambda y: y = 'docker')) AS tf FROM w),
n AS (SELECT count(*) AS n, sum(l) AS total, count(*) FILTER (tf > 0) AS df FROM f),
r AS (SELECT id, round(ln((n - df + 0.5) / (df + 0.5) + 1 + 1e-9) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / (total / (n + 1e-9)))), 6) AS score FROM f, n)
SELECT s.id, s.start_time, 1 AS tier, r.score FROM sessions s JOIN r USING (id) WHERE s.start_time <= {NOW} - 604800""")
def _advanced_index(c: Core) -> DataFrame:
    rows = search.index_rows(c.commands, c.commits, c.sessions)
    found = search.advanced_search(c.sessions, c.commands, linked(c), c.projects, "docker", until=NOW - 604800, index=rows, limit=None)
    every = search.advanced_search(c.sessions, c.commands, linked(c), c.projects, "docker", index=rows, limit=None)
    return found.drop("score").join(every.select("id", F.round("score", 6).alias("score")), "id")


@query("index_current", "SELECT true AS current, false AS after_loss, true AS after_sync")
def _current(c: Core) -> DataFrame:
    """Whether an index is seen to be whole, then to lack rows, then to be whole again."""
    rows = search.index_rows(c.commands, c.commits, c.sessions)
    lost = rows.where("NOT (type = 'command' AND cast(ref AS long) % 5 = 0)")
    again = search.sync_index(lost, rows.where("type = 'command' AND cast(ref AS long) % 5 = 0"))
    return c.spark.createDataFrame([tuple(search.index_is_current(x, c.commands) for x in (rows, lost, again))], "current boolean, after_loss boolean, after_sync boolean")


@query("resurrections", """g AS (SELECT *, lead(start_time) OVER (PARTITION BY user_id, project_id ORDER BY start_time, id) AS back FROM sessions WHERE NOT is_legacy)
SELECT user_id, coalesce(p.name, 'Other') AS project, end_time AS last_active, back AS resurrected_at, (back - end_time) // 86400 AS gap_days FROM g LEFT JOIN projects p ON p.id = g.project_id WHERE back - end_time >= 172800""")
def _resurrections(c: Core) -> DataFrame:
    return insights.resurrections(c.sessions, c.projects, KEYS, 2).drop("project_id")


@query("overall_insights", f"""s AS (SELECT *, hour(make_timestamp(((start_time + end_time) // 2) * 1000000)) AS h, dayname(make_timestamp(start_time * 1000000)) AS w FROM sessions WHERE start_time >= {NOW} - 1728000),
r AS (SELECT * FROM s WHERE NOT is_legacy), u AS (SELECT user_id, count(*) AS total_sessions FROM sessions GROUP BY 1), k AS (SELECT user_id, count(*) AS total_commands FROM commands GROUP BY 1),
d AS (SELECT user_id, lower(w) AS w, sum(duration_seconds) AS d, min(list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], w)) AS o FROM r GROUP BY 1, 2),
e AS (SELECT user_id, CASE WHEN max(d) = 0 THEN 'N/A' ELSE arg_max(w, (d, -o)) END AS active_day FROM d GROUP BY 1),
t AS (SELECT user_id, CASE WHEN h >= 6 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 18 THEN 'afternoon' ELSE 'evening' END AS t, sum(duration_seconds) AS d FROM r GROUP BY 1, 2),
a AS (SELECT user_id, CASE WHEN max(d) = 0 THEN 'N/A' ELSE arg_max(t, (d, CASE t WHEN 'morning' THEN 3 WHEN 'afternoon' THEN 2 ELSE 1 END)) END AS active_time FROM t GROUP BY 1),
l AS (SELECT user_id, count(*) FILTER (hour(make_timestamp(timestamp * 1000000)) < 5) * 100 / count(*) AS late_percent FROM commands WHERE timestamp >= {NOW} - 1728000 GROUP BY 1),
g AS (SELECT user_id, lead(start_time) OVER (PARTITION BY user_id, project_id ORDER BY start_time, id) - end_time AS gap FROM r), n AS (SELECT user_id, count(*) AS resurrections FROM g WHERE gap >= 172800 GROUP BY 1)
SELECT user_id, total_sessions, coalesce(total_commands, 0) AS total_commands, active_day, active_time, round(late_percent, 6) AS late_percent,
  CASE WHEN late_percent >= 50 THEN 'Dracula Level Vampire' WHEN late_percent >= 20 THEN 'Late-Night Bat' WHEN late_percent >= 5 THEN 'Midnight Caffeinator' WHEN late_percent IS NOT NULL THEN 'Solar Coder' END AS late_tier, coalesce(resurrections, 0) AS resurrections
FROM u LEFT JOIN k USING (user_id) LEFT JOIN e USING (user_id) LEFT JOIN a USING (user_id) LEFT JOIN l USING (user_id) LEFT JOIN n USING (user_id)""")
def _overall(c: Core) -> DataFrame:
    out = insights.overall(c.sessions, c.commands, c.commits, c.projects, KEYS, NOW, days=20, away=2)
    return out.select("user_id", "total_sessions", "total_commands", "active_day", "active_time", F.round("late_percent", 6).alias("late_percent"), "late_tier", "resurrections")


@query("stats_json", """SELECT (SELECT count(*) FROM sessions) AS total_sessions, (SELECT count(*) FROM commands) AS total_commands, (SELECT count(*) FROM projects) AS total_projects,
(SELECT strftime(make_timestamp(min(timestamp) * 1000000), '%Y-%m-%dT%H:%M:%S') FROM commands) AS earliest, (SELECT strftime(make_timestamp(max(timestamp) * 1000000), '%Y-%m-%dT%H:%M:%S') FROM commands) AS latest,
(SELECT string_agg(name || ':' || n, ',' ORDER BY name) FROM (SELECT coalesce(p.name, 'Other') AS name, count(*) AS n FROM commands c LEFT JOIN projects p ON p.id = c.project_id GROUP BY 1)) AS commands_of""")
def _stats(c: Core) -> DataFrame:
    kind = "total_sessions long, total_commands long, total_projects long, time_range struct<earliest:string,latest:string>, projects array<struct<name:string,id:long,path:string,commands_count:long>>"
    x = insights.stats_json(c.sessions, c.commands, c.projects).select(F.from_json("json", kind).alias("x"))
    named = F.transform("x.projects", lambda p: F.concat(p["name"], F.lit(":"), p["commands_count"].cast("string")))
    return x.select("x.total_sessions", "x.total_commands", "x.total_projects", "x.time_range.earliest", "x.time_range.latest", F.array_join(F.array_sort(named), ",").alias("commands_of"))


@query("tag_listing", f"""f AS (SELECT session_id, arg_min(command, (timestamp, id)) AS first FROM commands GROUP BY 1)
SELECT s.id, strftime(make_timestamp(start_time * 1000000), '%Y-%m-%d %H:%M') AS start, coalesce(p.name, 'Other') AS project, {READABLE} AS duration, CASE WHEN length(first) > 40 THEN left(first, 37) || '...' ELSE first END AS summary
FROM sessions s JOIN f ON f.session_id = s.id LEFT JOIN projects p ON p.id = s.project_id WHERE EXISTS (SELECT 1 FROM commands c WHERE c.session_id = s.id AND starts_with(command, 'pytest ')) ORDER BY start_time DESC, s.id DESC LIMIT 20""")
def _listing(c: Core) -> DataFrame:
    return reports.tag_listing(c.sessions, c.commands, insights.session_tags(c.commands, linked(c)), c.projects, "TEST ")


@query("detailed_rows", f"""{LINKED_SQL},
a AS (SELECT session_id, 'command' AS kind, timestamp AS x, command AS text, CASE WHEN exit_code <> 0 THEN 'exit ' || exit_code ELSE '' END AS note, id::VARCHAR AS ref FROM commands
  UNION ALL SELECT session_id, 'commit', t, message, left(hash, 7), hash FROM linked)
SELECT session_id, kind, text, note, strftime(make_timestamp(x * 1000000), '%-I:%M %p') AS clock, row_number() OVER (PARTITION BY session_id ORDER BY x, kind, ref) AS place FROM a""")
def _detailed(c: Core) -> DataFrame:
    return reports.detailed_rows(c.commands, linked(c)).drop("at", "ref")


@query("command_memories", """SELECT id, CASE WHEN starts_with(command, 'git commit') THEN regexp_extract(command, '"([^"]+)"', 1) WHEN contains(command, ' && ') THEN split_part(command, ' && ', 2) ELSE command END AS memory,
starts_with(command, 'git commit') OR starts_with(command, 'npm ') OR starts_with(command, 'pytest ') AS of_project, CASE WHEN starts_with(command, 'git commit') THEN regexp_extract(command, '"([^"]+)"', 1) END AS message FROM commands""")
def _memories(c: Core) -> DataFrame:
    t = F.col("command")
    return c.commands.select("id", X.command_memory(t).alias("memory"), X.is_project_command(t).alias("of_project"), X.commit_message_in(t).alias("message"))


@query("cleaned_commands", "SELECT id, command AS cleaned, true AS balanced FROM commands")
def _cleaned(c: Core) -> DataFrame:
    """Colours, line continuations and repeated white space are put around the commands, and must go again."""
    wrapped = F.concat(F.lit("\x1b[1;31m  "), F.replace("command", F.lit(" "), F.lit(" \\\n\t")), F.lit(" \x1b[0m\\"))
    return c.commands.select("id", X.clean_command(wrapped).alias("cleaned"), X.quotes_balanced(F.col("command")).alias("balanced"))


@query("file_arguments", """SELECT id, array_to_string(list_filter(string_split_regex(trim(command), '\\s+')[2:], lambda w: regexp_matches(w, '[/.]') AND NOT regexp_matches(w, '^-|://|[$=]')), ' ') AS files FROM commands""")
def _files(c: Core) -> DataFrame:
    return c.commands.select("id", F.array_join(X.file_arguments(F.col("command")), " ").alias("files"))


@query("offsets_and_ranges", """d AS (SELECT *, make_timestamp(start_time * 1000000) AS a, make_timestamp(end_time * 1000000) AS b, duration_seconds AS n FROM sessions)
SELECT id, CASE WHEN n >= 3600 THEN format('+{:02d}:{:02d}:{:02d}', n // 3600, n % 3600 // 60, n % 60) ELSE format('+{:02d}:{:02d}', n // 60, n % 60) END AS readable,
  CASE WHEN a::DATE = b::DATE THEN strftime(b, '%B %d, %Y') WHEN year(a) = year(b) AND month(a) = month(b) THEN strftime(a, '%B %d') || ' - ' || strftime(b, '%d, %Y') WHEN year(a) = year(b) THEN strftime(a, '%B %d') || ' - ' || strftime(b, '%B %d, %Y')
  ELSE strftime(a, '%B %d, %Y') || ' - ' || strftime(b, '%B %d, %Y') END AS span FROM d""")
def _offsets(c: Core) -> DataFrame:
    return c.sessions.select("id", C.format_offset(F.col("duration_seconds")).alias("readable"), C.format_range(F.col("start_time"), F.col("end_time")).alias("span"))


@query("time_predicates", f"""SELECT id, timestamp >= {NOW} - 1728000 AS recent, timestamp BETWEEN {NOW} - 31536000 AND {NOW} AS plausible, {DAY.format('timestamp')} < DATE '2024-01-15' AS older,
last_day({DAY.format('timestamp')}) < DATE '2024-01-15' AS month_over FROM commands WHERE NOT is_legacy""")
def _predicates(c: Core) -> DataFrame:
    t, cutoff = F.col("timestamp"), F.lit("2024-01-15").cast("date")
    older = lambda fmt, kind: C.timeframe_older_than(F.date_format(C.day(t), fmt), F.lit(kind), cutoff)
    return c.commands.where("NOT is_legacy").select("id", C.recent(t, NOW, 20).alias("recent"), C.plausible(t, NOW, 1).alias("plausible"), older("yyyy-MM-dd", "date").alias("older"), older("yyyy-MM", "month").alias("month_over"))


@query("index_hits", f"""{LINKED_SQL},
h AS (SELECT session_id, id % 10 AS score FROM commands WHERE contains(command, 'docker') UNION ALL SELECT session_id, t % 10 FROM linked WHERE contains(message, '1') UNION ALL SELECT id, 3 FROM sessions WHERE id % 5 = 0)
SELECT session_id, min(score) AS score FROM h GROUP BY 1""")
def _hits(c: Core) -> DataFrame:
    hit = lambda df, kind, ref, score: df.select(F.lit(kind).alias("type"), F.col(ref).cast("string").alias("ref"), score.cast("long").alias("score"))
    hits = hit(c.commands.where(F.col("command").contains("docker")), "command", "id", F.pmod("id", F.lit(10))).union(hit(c.commits.where(F.col("message").contains("1")), "commit", "hash", F.pmod("timestamp", F.lit(10))))
    return joins.hits_to_sessions(hits.union(hit(c.sessions.where("id % 5 = 0"), "summary", "id", F.lit(3))), c.commands, linked(c))


@query("summaries_of_day", f"""m AS (SELECT {DAY.format('start_time')} AS day, min(start_time) AS created_at FROM sessions WHERE id % 3 = 0 GROUP BY 1)
SELECT s.id, m.created_at FROM m JOIN sessions s ON {DAY.format('s.start_time')} = m.day""")
def _of_day(c: Core) -> DataFrame:
    made = c.sessions.where("id % 3 = 0").groupBy(C.day(F.col("start_time")).cast("string").alias("timeframe_id")).agg(F.min("start_time").alias("created_at"))
    return joins.summaries_of_day(made.withColumn("type", F.lit("daily")).withColumn("summary", F.lit("done")), c.sessions).select("id", "created_at")


@query("first_match_project", """f AS (SELECT session_id, arg_min(id % 5, (timestamp, id)) AS p FROM commands WHERE contains(command, 'docker') AND id % 3 = 0 GROUP BY 1)
SELECT s.id, coalesce(f.p, s.project_id) AS effective_project FROM sessions s LEFT JOIN f ON f.session_id = s.id""")
def _first_match(c: Core) -> DataFrame:
    own = c.commands.withColumn("project_id", F.when(F.pmod("id", F.lit(3)) == 0, F.pmod("id", F.lit(5))))
    return joins.project_of_first_match(c.sessions, own, F.col("command").contains("docker")).select("id", "effective_project")


@query("session_repair", "SELECT id, CASE WHEN id % 4 = 1 THEN 7 ELSE end_time END AS end_time, duration_seconds FROM sessions")
def _repair(c: Core) -> DataFrame:
    """Every third session loses its end and length; a written end, even a wrong one, must stay."""
    gone = F.pmod("id", F.lit(4)).isin(0, 2)
    broken = c.sessions.withColumn("end_time", F.when(F.pmod("id", F.lit(4)) == 1, 7).when(~gone, F.col("end_time"))).withColumn("duration_seconds", F.when(~gone, F.col("duration_seconds")))
    return sessions.repair_sessions(broken, c.commands).select("id", "end_time", "duration_seconds")


@query("one_per_day", f"SELECT user_id, {DAY.format('timestamp')} AS day, arg_max(command, ((starts_with(command, 'git commit'))::INT, length(command), -id)) AS text FROM commands GROUP BY 1, 2")
def _one_per_day(c: Core) -> DataFrame:
    entries = c.commands.select("user_id", C.day(F.col("timestamp")).alias("day"), F.col("command").alias("text"), F.col("command").startswith("git commit").alias("from_commit"), F.col("id").alias("order"))
    return sessions.one_per_day(entries, KEYS)


@query("three_source_search", """h AS (SELECT session_id AS id, 1 AS k FROM commands WHERE contains(command, 'docker build') UNION ALL SELECT id, 2 FROM sessions WHERE id % 4 = 0 UNION ALL SELECT id, 3 FROM sessions WHERE id % 6 = 1),
b AS (SELECT id, min(k) AS match_type FROM h GROUP BY 1) SELECT s.id, b.match_type FROM sessions s JOIN b USING (id) ORDER BY match_type, start_time DESC, id DESC LIMIT 400""")
def _three(c: Core) -> DataFrame:
    said = lambda k, r: c.sessions.where(F.pmod("id", F.lit(k)) == r).select(F.col("id").alias("session_id"), F.lit("Builds, in docker buildings").alias("summary"))
    return search.three_source_search(c.commands, said(4, 0), said(6, 1), c.sessions, "docker build", 400).select("id", "match_type")


@query("populated_results", f"""{LINKED_SQL}, m AS (SELECT session_id, count(*) AS n FROM linked GROUP BY 1)
SELECT c.session_id AS id, count(*) AS commands, count(*) FILTER (contains(command, 'docker')) AS matching, coalesce(any_value(m.n), 0) AS commits FROM commands c LEFT JOIN m USING (session_id) GROUP BY 1""")
def _populated(c: Core) -> DataFrame:
    n = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("long")
    out = search.populate(c.sessions.select("id"), c.commands, linked(c), " Docker ")
    return out.select("id", n("commands").alias("commands"), n("matching").alias("matching"), F.greatest(n("commits"), F.lit(0)).alias("commits"))


@query("verbalised_commands", "SELECT id, CASE WHEN starts_with(command, 'vim ') THEN 'vim (edit a file)' || substr(command, 4) WHEN starts_with(command, 'pytest ') THEN 'pytest (run tests)' || substr(command, 7) ELSE command END AS text FROM commands")
def _verbalised(c: Core) -> DataFrame:
    return c.commands.select("id", search.verbalise(F.col("command"), {"vim": "edit a file", "pytest": "run tests"}).alias("text"))


@query("insert_or_ignore", "SELECT hash, CASE WHEN timestamp % 2 = 0 THEN message ELSE 'new' END AS message FROM commits")
def _ignore(c: Core) -> DataFrame:
    old, new = c.commits.select("hash", "message", "timestamp"), F.lit("new").alias("message")
    return store.insert_new(old.where("timestamp % 2 = 0").drop("timestamp"), old.select("hash", new), ["hash"])


@query("keyed_store", "SELECT project_id, max(timestamp) AS at, arg_max(hash, (timestamp, hash)) AS hash FROM commits WHERE project_id IS NOT NULL GROUP BY 1")
def _keyed(c: Core) -> DataFrame:
    rows = c.commits.where("project_id IS NOT NULL").select("project_id", F.col("timestamp").alias("at"), "hash", F.struct("timestamp", "hash").alias("place"))
    return store.latest_by_key(rows, "project_id", "place").drop("place")


@query("point_updates", "SELECT id, CASE WHEN id % 5 = 0 THEN project_id + 100 ELSE project_id END AS project_id FROM sessions")
def _updates(c: Core) -> DataFrame:
    new = c.sessions.where("id % 5 = 0").select("id", (F.col("project_id") + 100).alias("project_id"))
    return store.point_updates(c.sessions.select("id", "project_id"), new, "id", "project_id")


@query("changed_snapshots", """l AS (SELECT *, lag(exit_code) OVER w AS p, row_number() OVER w AS r FROM commands WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, id))
SELECT session_id, count(*) AS n FROM l WHERE r = 1 OR coalesce(exit_code, -1) <> coalesce(p, -1) GROUP BY 1""")
def _snapshots(c: Core) -> DataFrame:
    payload = F.concat(F.lit('{"code": '), F.coalesce("exit_code", F.lit(-1)).cast("string"), F.lit("}"))
    rows = c.commands.select("session_id", F.lit("shell").alias("source"), payload.alias("payload"), F.struct("timestamp", "id").alias("captured_at"))
    return payloads.changed_snapshots(rows).groupBy("session_id").agg(F.count("*").alias("n"))


@query("report_kpis", f"SELECT count(*) AS sessions, count(DISTINCT project_id) AS projects, sum(duration_seconds)::BIGINT AS duration FROM sessions WHERE start_time BETWEEN {CUTOFF} AND {NOW}")
def _kpis(c: Core) -> DataFrame:
    return store.report_tables(c.sessions, c.commands, CUTOFF, NOW)["kpis"]


@query("report_daily", f"""d AS (SELECT day::DATE AS day FROM generate_series(DATE '2023-11-04', DATE '2024-02-01', INTERVAL 1 DAY) g(day)), n AS (SELECT {DAY.format('timestamp')} AS day, count(*) AS n FROM commands GROUP BY 1),
p AS (SELECT {DAY.format('start_time')} AS day, count(*) AS s FROM sessions GROUP BY 1) SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (day)""")
def _daily(c: Core) -> DataFrame:
    none = F.lit(None).cast("string")
    return store.report_data(c.sessions.withColumn("ai_summary", none), c.commands, c.projects, CUTOFF, NOW)["daily"]


@query("report_projects", f"""SELECT coalesce(p.name, 'Other') AS project, count(*) AS sessions, sum(duration_seconds)::BIGINT AS duration FROM sessions s LEFT JOIN projects p ON p.id = s.project_id WHERE start_time BETWEEN {CUTOFF} AND {NOW} GROUP BY 1""")
def _report_projects(c: Core) -> DataFrame:
    return store.report_data(c.sessions.withColumn("ai_summary", F.lit(None).cast("string")), c.commands, c.projects, CUTOFF, NOW)["projects"]


@query("current_context", """c AS (SELECT 'command' AS kind, timestamp AS x, id FROM commands WHERE session_id NOT IN (SELECT session_id FROM commands WHERE starts_with(command, 'ssh')) ORDER BY timestamp DESC, id DESC LIMIT 50),
m AS (SELECT 'commit' AS kind, timestamp AS x FROM commits ORDER BY timestamp DESC, hash LIMIT 50), p AS (SELECT 'project' AS kind, start_time AS x FROM sessions WHERE project_id IS NOT NULL ORDER BY start_time DESC, id DESC LIMIT 1)
SELECT kind, x AS moment FROM c UNION ALL SELECT kind, x FROM m UNION ALL SELECT kind, x FROM p""")
def _current_context(c: Core) -> DataFrame:
    return store.current_context(c.sessions, c.commands, c.commits, c.projects, 50, ["ssh*"]).select("kind", F.col("at").alias("moment"))


@query("id_breakdown", """s AS (SELECT project_id AS p, count(*) AS sessions, sum(duration_seconds)::BIGINT AS duration FROM sessions GROUP BY 1), c AS (SELECT project_id AS p, count(*) AS commands FROM commands GROUP BY 1)
SELECT s.p AS project_id, coalesce(n.name, 'Other') AS name, sessions, commands, duration FROM s JOIN c ON s.p IS NOT DISTINCT FROM c.p LEFT JOIN projects n ON n.id = s.p""")
def _id_breakdown(c: Core) -> DataFrame:
    return insights.project_breakdown(c.sessions, c.commands, c.projects, by_id=True).select("project_id", "name", "sessions", "commands", "duration")


@query("late_night_tiers", """c AS (SELECT user_id, count(*) FILTER (hour(make_timestamp(timestamp * 1000000)) < 5) * 100 / count(*) AS p FROM commands GROUP BY 1)
SELECT user_id, CASE WHEN p >= 50 THEN 'Dracula Level Vampire' WHEN p >= 20 THEN 'Late-Night Bat' WHEN p >= 5 THEN 'Midnight Caffeinator' ELSE 'Solar Coder' END AS tier FROM c""")
def _late_tiers(c: Core) -> DataFrame:
    return insights.late_night_index(c.commands, c.commits, KEYS).where("commands > 0").select("user_id", "tier")


@query("orphans_and_twins", "SELECT id, start_time FROM sessions WHERE id % 3 <> 0 UNION ALL SELECT -id, start_time + 1 FROM sessions WHERE id % 6 = 0 AND id > 0")
def _twins(c: Core) -> DataFrame:
    """Sessions whose id divides by 3 lose their commands and, in half the cases, get a twin's start moved: only those that share a start go."""
    own = c.sessions.select("user_id", "id", "start_time", F.pmod("id", F.lit(3)).alias("r"))
    lost = own.where("r = 0")
    twins = lost.select("user_id", (-F.col("id")).alias("id"), (F.col("start_time") + F.when(F.pmod("id", F.lit(6)) == 0, 1).otherwise(0)).alias("start_time"), "r")
    left = c.commands.join(lost.select(F.col("id").alias("session_id")), "session_id", "left_anti")
    return joins.prune_orphans(own.union(twins), left, KEYS).where("r <> 0 OR id < 0").select("id", "start_time")


_also("tag_summary", """t AS (SELECT session_id, bool_or(contains(command, ' build')) AS setup, bool_or(starts_with(command, 'pytest ')) AS test, bool_or(starts_with(command, 'ssh deploy')) AS deploy FROM commands GROUP BY 1)
SELECT tag, coalesce(n, 0) AS sessions, coalesce(d, 0)::BIGINT AS duration FROM (VALUES ('deploy'), ('debug'), ('setup'), ('test'), ('docs')) v(tag) LEFT JOIN (
  SELECT 'setup' AS tag, count(*) AS n, sum(duration_seconds) AS d FROM sessions s JOIN t ON t.session_id = s.id WHERE setup
  UNION ALL SELECT 'deploy', count(*), sum(duration_seconds) FROM sessions s JOIN t ON t.session_id = s.id WHERE deploy
  UNION ALL SELECT 'test', count(*), sum(duration_seconds) FROM sessions s JOIN t ON t.session_id = s.id WHERE test) USING (tag)""")
_also("daily_class", """w AS (SELECT user_id, timestamp, id, CASE WHEN starts_with(command, 'docker ') THEN 'docker' WHEN starts_with(command, 'git ') THEN 'git' WHEN starts_with(command, 'npm ') THEN 'npm' WHEN starts_with(command, 'pytest ') THEN 'pytest' ELSE split_part(command, ' ', 1) END AS tool FROM commands),
n AS (SELECT user_id, tool, count(*) AS n, min((timestamp, id)) AS o FROM w GROUP BY 1, 2)
SELECT user_id, tool, n, 'Level ' || least(100, greatest(1, n // 5)) || ' ' || CASE tool WHEN 'docker' THEN 'Docker Demolitionist' WHEN 'git' THEN 'Version Control Paladin' WHEN 'npm' THEN 'Frontend Bard' WHEN 'pytest' THEN 'Python Pyromancer' WHEN 'vim' THEN 'Vim Vampire' WHEN 'ls' THEN 'Directory Druid'
  WHEN 'cd' THEN 'Pathfinder Rogue' ELSE 'Scripting Shaman (' || tool || ')' END AS class FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o) = 1""")
_also("language_share", """g AS (SELECT CASE project_id WHEN 1 THEN 'Rust' WHEN 2 THEN 'Go' WHEN 3 THEN NULL END AS named, CASE WHEN starts_with(command, 'pytest ') THEN 'Python' WHEN starts_with(command, 'npm ') THEN 'JavaScript' END AS tool FROM commands),
l AS (SELECT coalesce(named, tool) AS language, count(*) AS n FROM g WHERE coalesce(named, tool) IS NOT NULL GROUP BY 1) SELECT language, n, n * 100 / sum(n) OVER () AS percent FROM l""")
_also("insight_patterns", f"""d AS (SELECT user_id, {DAY.format('start_time')} AS day, sum(duration_seconds) AS d FROM sessions GROUP BY 1, 2),
p AS (SELECT user_id, project_id::VARCHAR AS p, sum(duration_seconds) AS d FROM sessions GROUP BY 1, 2),
k AS (SELECT user_id, CASE split_part(command, ' ', 1) WHEN 'pytest' THEN 'python' ELSE split_part(command, ' ', 1) END AS tool, count(*) AS n, min((timestamp, id)) AS o FROM commands GROUP BY 1, 2)
SELECT user_id, 'busiest_day' AS rule, arg_max(day, (d, day))::VARCHAR AS subject, max(d)::DOUBLE AS value FROM d GROUP BY 1 UNION ALL SELECT user_id, 'quietest_day', arg_min(day, (d, day))::VARCHAR, min(d)::DOUBLE FROM d GROUP BY 1
UNION ALL SELECT user_id, 'daily_mean', NULL, avg(d) FROM d GROUP BY 1 UNION ALL SELECT user_id, 'top_project', arg_max(p, (d, p)), max(d)::DOUBLE FROM p GROUP BY 1
UNION ALL SELECT user_id, 'top_tool', tool, n::DOUBLE FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o) = 1""")
_also("likely_bugs", """c AS (SELECT session_id, count(*) AS n, count(*) FILTER (exit_code IS NULL OR exit_code <> 0) AS f, bool_or(contains(command, 'pytest')) AS t, bool_or(contains(command, 'docker')) AS d FROM commands GROUP BY 1)
SELECT s.id, CASE WHEN t THEN 'Mock Leak or Commented-Out Assertion' WHEN d THEN 'Docker Port Bind Collision / Zombie Container' ELSE 'Sleep-Deprived Off-by-One or Typo' END AS bug FROM sessions s JOIN c ON c.session_id = s.id
WHERE NOT is_legacy AND (hour(make_timestamp(start_time * 1000000)) >= 23 OR hour(make_timestamp(start_time * 1000000)) < 5) AND (n >= 10 OR f >= 3)""")


NOISE = "command = 'ls -la' OR starts_with(command, 'cd ') OR starts_with(command, 'cat ') OR command = 'git status' OR starts_with(command, 'ssh ') AND NOT contains(command, '&&')"
MEMORY_SQL = f"""{LINKED_SQL},
mem AS (SELECT c.session_id AS id, coalesce(any_value(m.message), arg_max(command, (length(command), -timestamp, -c.id)) FILTER (NOT ({NOISE})), arg_max(command, (length(command), -timestamp, -c.id))) AS memory
  FROM commands c LEFT JOIN (SELECT session_id, 'Purchase ' || regexp_extract(arg_max(message, (t, hash)), 'purchase (\\d+)', 1) AS message FROM linked GROUP BY 1) m USING (session_id) GROUP BY 1)"""
_also("project_report", f"""{MEMORY_SQL},
f AS (SELECT project_id, {DAY.format('start_time')} AS day, memory, min((start_time, s.id)) AS o FROM sessions s JOIN mem USING (id) GROUP BY 1, 2, 3)
SELECT project_id, day, string_agg(memory, '|' ORDER BY o) AS memories FROM f GROUP BY 1, 2""")
_also("day_report", f"""{MEMORY_SQL},
n AS (SELECT s.*, coalesce(p.name, 'Other') AS project, {DAY.format('start_time')} AS day FROM sessions s LEFT JOIN projects p ON p.id = s.project_id),
t AS (SELECT project, coalesce(sum(duration_seconds) FILTER (day = DATE '2024-01-16'), 0)::BIGINT AS seconds, coalesce(sum(duration_seconds) FILTER (day = DATE '2024-01-15'), 0)::BIGINT AS before FROM n GROUP BY 1 HAVING count(*) FILTER (day = DATE '2024-01-16') > 0),
f AS (SELECT project, memory, min((start_time, n.id)) AS o FROM n JOIN mem USING (id) WHERE day = DATE '2024-01-16' GROUP BY 1, 2), g AS (SELECT project, string_agg(memory, '|' ORDER BY o) AS memories FROM f GROUP BY 1)
SELECT project, seconds, before, memories, seconds - before AS difference FROM t LEFT JOIN g USING (project)""")
_also("calendar_tree", f"""r AS (SELECT session_id AS id, bool_or(id % 50 = 0) AS r FROM commands GROUP BY 1)
SELECT strftime({DAY.format('start_time')}, '%Y-%m') AS month, {DAY.format('start_time')} AS day, coalesce(p.name, 'Other') AS project,
string_agg(s.id || ':' || duration_seconds || ':' || CASE WHEN r THEN 'recovered' WHEN is_legacy THEN 'legacy' ELSE 'normal' END, ',' ORDER BY start_time, s.id) AS sessions
FROM sessions s JOIN r ON r.id = s.id LEFT JOIN projects p ON p.id = s.project_id GROUP BY 1, 2, 3""")
_also("week_report", """k AS (SELECT project_id, CASE split_part(command, ' ', 1) WHEN 'pytest' THEN 'python' ELSE split_part(command, ' ', 1) END AS class, count(*) AS n, min((timestamp, id)) AS o FROM commands GROUP BY 1, 2),
t AS (SELECT project_id, string_agg(class, ',' ORDER BY n DESC, o) AS top_classes FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, o) <= 5) GROUP BY 1),
w AS (SELECT project_id, count(*) AS sessions, sum(duration_seconds)::BIGINT AS duration, """ + ", ".join(f"coalesce(sum(duration_seconds) FILTER (dayname(make_timestamp(start_time * 1000000)) = '{d}'), 0)::BIGINT AS {d[:3].lower()}" for d in insights.WEEKDAYS) + """ FROM sessions GROUP BY 1)
SELECT w.*, t.top_classes, coalesce(p.name, 'Other') AS project_name, p.path AS project_path FROM w LEFT JOIN t ON t.project_id IS NOT DISTINCT FROM w.project_id LEFT JOIN projects p ON p.id = w.project_id""")
_also("index_search", """h AS (SELECT DISTINCT session_id AS id FROM commands WHERE starts_with(command, 'git commit')), d AS (SELECT session_id AS id, string_agg(command, ' ') AS x FROM commands WHERE session_id IN (SELECT id FROM h) GROUP BY 1),
w AS (SELECT id, regexp_extract_all(lower(x), '[\\p{L}\\p{N}_]+') AS w FROM d), f AS (SELECT id, len(w) AS l, len(list_filter(w, lambda y: y = 'git')) AS tf FROM w), n AS (SELECT count(*) AS n, sum(l) AS total, count(*) FILTER (tf > 0) AS df FROM f),
r AS (SELECT id, ln((n - df + 0.5) / (df + 0.5) + 1 + 1e-9) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / (total / (n + 1e-9)))) AS score FROM f, n)
SELECT s.id, 1 AS tier, round(r.score, 6) AS score FROM sessions s JOIN r USING (id) ORDER BY r.score DESC, start_time DESC, s.id DESC LIMIT 50""")
_also("ask_sessions", f"""{LINKED_SQL},
c AS (SELECT session_id AS id, string_agg(command, ' ' ORDER BY timestamp, id) AS t FROM commands GROUP BY 1), m AS (SELECT session_id AS id, string_agg(message, ' ' ORDER BY message) AS t FROM linked GROUP BY 1),
x AS (SELECT s.id, s.start_time, regexp_extract_all(lower(repeat(coalesce(p.name, '') || ' ', 3) || c.t || ' ' || coalesce(m.t, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM sessions s JOIN c USING (id) LEFT JOIN m USING (id) LEFT JOIN projects p ON p.id = s.project_id),
a AS (SELECT id, start_time, len(w) AS n, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS every FROM x WHERE len(list_filter(w, lambda y: starts_with(y, 'docker') OR starts_with(y, 'build') OR starts_with(y, 'npm'))) > 0),
q(term, pair) AS (VALUES ('docker', false), ('build', false), ('npm', false), ('docker_build', true), ('build_npm', true)),
f AS (SELECT id, start_time, n, term, len(list_filter(every, lambda y: CASE WHEN pair THEN y = term ELSE starts_with(y, term) END)) AS tf FROM a, q),
s AS (SELECT count(*) AS docs, sum(n) AS total FROM a), d AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1)
SELECT id, round(score, 6) AS score FROM (SELECT id, start_time, sum(ln((docs - df + 0.5) / (df + 0.5) + 1 + 1e-9) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / (total / (docs + 1e-9))))) AS score FROM f JOIN d USING (term), s WHERE tf > 0 GROUP BY id, start_time) r ORDER BY round(r.score, 9) DESC, start_time DESC, id LIMIT 10""")
_also("safe_context", """SELECT id, command FROM commands WHERE session_id NOT IN (SELECT session_id FROM commands WHERE starts_with(command, 'ssh')) ORDER BY timestamp DESC, id DESC LIMIT 50""")
_also("redact_commands", """SELECT id, CASE WHEN starts_with(command, 'ssh ') THEN 'ssh deploy@[REDACTED_HOST] && export API_TOKEN=[REDACTED]' ELSE command END AS redacted, false AS blacklisted FROM commands""")
SQL["query_expansion"] = """WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term, doc_id FROM documents), a AS (SELECT term, 'doc' || min(doc_id) AS anchor FROM t GROUP BY 1),
q AS (SELECT item_id AS id, text AS query, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark), u AS (SELECT id, query, unnest(w) AS term, unnest(range(len(w))) AS pos FROM q),
f AS (SELECT id, anchor, min(pos) AS pos FROM u JOIN a USING (term) WHERE NOT contains(lower(query), anchor) GROUP BY 1, 2), n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, anchor) <= 8),
r AS (SELECT id, string_agg(anchor, ' ' ORDER BY pos, anchor) AS added FROM n GROUP BY 1) SELECT id, query || coalesce(' ' || added, '') AS query FROM q LEFT JOIN r USING (id)"""
_also("main_achievements", f"""{LINKED_SQL},
m AS (SELECT s.project_id AS p, 'Purchase ' || regexp_extract(arg_max(l.message, (start_time, s.id, l.t, l.hash)), 'purchase (\\d+)', 1) AS message FROM linked l JOIN sessions s ON s.id = l.session_id GROUP BY 1),
c AS (SELECT s.project_id AS p, arg_max(command, (start_time, s.id, length(command), -timestamp, -c.id)) FILTER (NOT ({NOISE})) AS longest, arg_max(command, (start_time, s.id, timestamp, c.id)) AS newest FROM commands c JOIN sessions s ON s.id = c.session_id GROUP BY 1)
SELECT c.p AS project_id, coalesce(m.message, longest, newest) AS achievement FROM c LEFT JOIN m ON m.p IS NOT DISTINCT FROM c.p""")
_also("bounded_gap_fill", f"""a AS (SELECT user_id, id AS i, CASE WHEN id % 3 = 0 THEN timestamp END AS t, max(id) OVER (PARTITION BY user_id) AS high FROM commands),
b AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS bi, first_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ai FROM a),
v AS (SELECT b.user_id, b.i, b.t, CASE WHEN bi IS NOT NULL AND ai IS NOT NULL THEN x.t + greatest(1, floor((y.t - x.t) / (ai - bi))) * (b.i - bi) WHEN ai IS NOT NULL THEN y.t - 10 * (ai - b.i)
  WHEN bi IS NOT NULL THEN x.t + least(10, greatest(0, floor(({NOW} - x.t) / (b.high - bi)))) * (b.i - bi) END AS value FROM b LEFT JOIN a x ON x.user_id = b.user_id AND x.i = bi LEFT JOIN a y ON y.user_id = b.user_id AND y.i = ai)
SELECT user_id, i AS position, coalesce(t, CASE WHEN value IS NULL THEN greatest({NOW} - 5 * 31536000, {NOW}) ELSE greatest({NOW} - 5 * 31536000, least({NOW}, value)) END)::BIGINT AS timestamp FROM v""")
_also("burst_placement", f"""p AS (SELECT user_id, id, command, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) - 1 AS back FROM commands),
d AS (SELECT *, back // 20 AS burst, {NOW} // 86400 AS day, ({NOW} // 86400 + 3) % 7 AS w FROM p)
SELECT user_id, id AS position, command, ((day - greatest(0, w - 4) - burst - 2 * ((burst + 4 - least(4, w)) // 5)) * 86400 + 57600 + (19 - back % 20) * 10)::BIGINT AS timestamp FROM d""")

SIGNALS_SQL = f"""x AS (SELECT *, make_timestamp(start_time * 1000000) AS ts FROM used WHERE start_time <= {NOW}),
g AS (SELECT user_id, project_id, sum(pow(0.5, ({NOW} - start_time) / 259200) * (duration_seconds / 3600 + 0.1)) AS recency, avg((hour(ts) < 5)::INT) AS hour_share, avg((dayname(ts) = 'Thursday')::INT) AS day_share, count(*) AS sessions FROM x GROUP BY 1, 2),
sig AS (SELECT *, 2.0 * recency / max(recency) OVER (PARTITION BY user_id) + 1.5 * hour_share + day_share AS score FROM g)"""
_also("project_signals", f"""used AS (SELECT * FROM sessions), {SIGNALS_SQL}
SELECT user_id, project_id, sessions, round(recency, 6) AS recency, round(hour_share, 6) AS hour_share, round(day_share, 6) AS day_share, round(score, 6) AS score FROM sig""")
_also("predict_next", f"""used AS (SELECT s.user_id, s.id, start_time, end_time, duration_seconds, s.id % 5 AS project_id FROM sessions s WHERE NOT is_legacy AND start_time >= {NOW} - 2592000 AND EXISTS (SELECT 1 FROM commands c WHERE c.session_id = s.id AND NOT c.is_legacy)), {SIGNALS_SQL},
i AS (SELECT user_id, arg_max(project_id, end_time) AS project_id FROM used u WHERE end_time BETWEEN {NOW} - 604800 AND {NOW} - 43200
  AND NOT EXISTS (SELECT 1 FROM used n WHERE n.user_id = u.user_id AND n.project_id = u.project_id AND n.start_time > u.end_time AND n.start_time <= u.end_time + 43200) GROUP BY 1),
r AS (SELECT sig.*, i.user_id IS NOT NULL AS interrupted, score + CASE WHEN i.user_id IS NOT NULL THEN 3 ELSE 0 END AS total FROM sig LEFT JOIN i ON i.user_id = sig.user_id AND i.project_id = sig.project_id)
SELECT user_id, project_id, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, project_id) AS rank,
  concat_ws(',', CASE WHEN recency >= 0.3 THEN 'recent' END, CASE WHEN hour_share >= 0.2 THEN 'hour' END, CASE WHEN day_share >= 0.2 THEN 'weekday' END, CASE WHEN interrupted THEN 'interrupted' END) AS signals, round(total, 6) AS score
FROM r QUALIFY rank <= 3""")

ISO = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%S')"
CLOCK = "strftime(make_timestamp({} * 1000000), '%-I:%M %p')"
REDACTED = "CASE WHEN starts_with(command, 'ssh ') THEN 'ssh deploy@[REDACTED_HOST] && export API_TOKEN=[REDACTED]' ELSE command END"
_also("csv_export", f"""{LINKED_SQL}, m AS (SELECT session_id, string_agg(left(hash, 7) || ': ' || message, '; ' ORDER BY t, hash) AS commits FROM linked GROUP BY 1)
SELECT c.session_id, {ISO.format('start_time')} AS start_time_iso, {ISO.format('end_time')} AS end_time_iso, duration_seconds, coalesce(p.name, 'Other') AS project_name, {ISO.format('c.timestamp')} AS timestamp_iso, {REDACTED} AS command, exit_code, m.commits
FROM commands c JOIN sessions s ON s.id = c.session_id LEFT JOIN m ON m.session_id = c.session_id LEFT JOIN projects p ON p.id = s.project_id""")
_also("markdown_export", f"""{LINKED_SQL}, m AS (SELECT session_id, string_agg('- ' || regexp_replace(message, '([()#])', '\\\\\\1', 'g'), chr(10) ORDER BY t, hash) AS commits FROM linked GROUP BY 1),
b AS (SELECT session_id, string_agg({REDACTED}, chr(10) ORDER BY timestamp, id) AS body FROM commands GROUP BY 1)
SELECT s.id AS session_id, '## ' || coalesce(p.name, 'Other') || ' - ' || {ISO.format('start_time')} || ' (' || {READABLE} || ')' || chr(10) || '```' || chr(10) || body || chr(10) || '```' || coalesce(chr(10) || commits, '') AS value
FROM sessions s JOIN b ON b.session_id = s.id LEFT JOIN m ON m.session_id = s.id LEFT JOIN projects p ON p.id = s.project_id""")
_also("journal", f"""b AS (SELECT session_id, string_agg('    ' || command, chr(10) ORDER BY timestamp, id) AS body FROM commands WHERE NOT ({NOISE}) GROUP BY 1),
l AS (SELECT {DAY.format('start_time')} AS day, coalesce(p.name, 'Other') AS name, start_time, s.id, duration_seconds, '  ' || {CLOCK.format('start_time')} || ' ' || {READABLE} || coalesce(chr(10) || body, '') AS line
  FROM sessions s LEFT JOIN b ON b.session_id = s.id LEFT JOIN projects p ON p.id = s.project_id),
t AS (SELECT day, name, sum(duration_seconds) AS d, string_agg(line, chr(10) ORDER BY start_time, id) AS text FROM l GROUP BY 1, 2) SELECT day, string_agg(name || chr(10) || text, chr(10) ORDER BY -d, name) AS value FROM t GROUP BY 1""")
_also("chronicle", f"""w AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) AS line FROM commands WHERE NOT ({NOISE})),
l AS (SELECT session_id, string_agg({REDACTED} || CASE WHEN exit_code <> 0 THEN ' (Exit Code ' || exit_code || ')' ELSE '' END, '|' ORDER BY line) AS lines FROM w WHERE line <= 15 GROUP BY 1),
f AS (SELECT session_id, bool_or(contains(command, 'test')) AS t, bool_or(contains(command, 'build')) AS b, bool_or(contains(command, 'vim')) AS v, bool_or(contains(command, 'docker')) AS d, bool_or(contains(command, 'git commit')) AS g FROM commands GROUP BY 1),
h AS (SELECT *, hour(make_timestamp(start_time * 1000000)) AS h FROM sessions)
SELECT h.id, CASE WHEN h < 5 THEN 'Late-Night/Goblin Mode' WHEN h < 8 THEN 'Early Bird Coding' WHEN h < 12 THEN 'Morning Session' WHEN h < 14 THEN 'Midday Session' WHEN h < 17 THEN 'Afternoon Session' WHEN h < 21 THEN 'Evening Session' ELSE 'Night Owl Session' END AS context,
  coalesce(p.name, 'Other') AS project, coalesce(nullif(concat_ws(', ', CASE WHEN t THEN 'Debugging/Running Tests' END, CASE WHEN b THEN 'Compiling/Building Code' END, CASE WHEN v THEN 'Deep Focused Editing / Coding' END,
  CASE WHEN d THEN 'Wrangling Containers/Infrastructure' END, CASE WHEN g THEN 'Committing and Pushing Changes' END), ''), 'General Development') AS activity, coalesce(lines, '') AS commands
FROM h JOIN f ON f.session_id = h.id LEFT JOIN l ON l.session_id = h.id LEFT JOIN projects p ON p.id = h.project_id""")
