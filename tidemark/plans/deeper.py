"""Registered queries over stored indexes, neighbours, heavy users, fuzzy matches and allocations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.adapters import COMMANDS_SQL, GAP, Core
from tidemark.functions.text import file_arguments
from tidemark.functions.time import parse_date
from tidemark.operators import attribution, insights, neighbours, payloads, recovery, reports, search, sessions, sketches
from tidemark.operators.index import LAST, StoredIndex, stored_search
from tidemark.plans import more  # noqa: F401  (its SQL is used here)
from tidemark.plans.queries import BM25_SQL, CUTOFF, KEYS, LINKED_SQL, NOW, SQL, linked, query
from tidemark.sources import history
from tidemark.streaming.merge import MergeTable
from tidemark.tables import shared_dir, written


def _folder(c: Core, name: str) -> str:
    return f"{shared_dir(c.spark)}/tidemark-{uuid.uuid4().hex}/{name}"


@query("index_search_stored")
def _stored(c: Core) -> DataFrame:
    """An index of two batches: the first has other texts for a fifth of the sessions, which the second replaces."""
    rows = written(search.index_rows(c.commands, c.commits, c.sessions), "rows")
    stale = (F.col("type") == "command") & (F.col("ref").cast("long") % 5 == 0)
    index = StoredIndex(c.spark, _folder(c, "index"), create=True)
    index.add(rows.withColumn("text", F.when(stale, F.concat(F.lit("git commit old "), "text")).otherwise(F.col("text"))))
    index.add(rows.where(stale), replace=True)
    return stored_search(index, c.sessions, c.commands, c.projects, "git comm").select("id", "tier", F.round("score", 6).alias("score"))


SQL["index_search_stored"] = SQL["index_search"]


def _document_index(c: Core) -> StoredIndex:
    index = StoredIndex(c.spark, _folder(c, "documents"), create=True)
    index.add(c.table("documents").select(F.lit("document").alias("type"), F.col("doc_id").cast("string").alias("ref"), "text"))
    return index


TOP_SQL = f"SELECT doc_id, score FROM ({BM25_SQL.replace('))))), 6)', '))))), 9)')}) ORDER BY score DESC, doc_id::VARCHAR LIMIT 25"


@query("bm25_top_stored", f"SELECT doc_id, round(score, 6) AS score FROM ({TOP_SQL})", bare=True)
def _top(c: Core) -> DataFrame:
    """The best 25 documents, by blocks of postings and their bounds."""
    best = _document_index(c).top(["the", "erth", "thing", "onand"], k=25)
    return best.select(F.col("ref").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query("index_terms", r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents)
SELECT term, count(*) AS docs FROM t WHERE starts_with(term, 'th') GROUP BY 1""", bare=True)
def _terms(c: Core) -> DataFrame:
    """The dictionary's terms with a prefix, and in how many documents each is: from blocks of the prefix only."""
    return _document_index(c).postings([("th", "th" + LAST)]).groupBy("term").agg(F.sum("docs").alias("docs"))


ONE_LOG = """one AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w {wait} OR lag(timestamp) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM raw WINDOW w AS (ORDER BY timestamp, id)),
runs AS (SELECT *, sum(f) OVER (ORDER BY timestamp, id) AS n FROM one),
s AS (SELECT min(id) AS id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS n_commands FROM runs GROUP BY n)"""


def _one_log(c: Core, gap: int) -> DataFrame:
    """All users' commands as one log, whose sessions are found in many tasks."""
    rows = sessions.assign_sessions(c.commands.drop("session_id"), [], gap, spread=True)
    return rows.groupBy(F.col("session_id").alias("id")).agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("n_commands"))


@query("sessions_of_one_log", ONE_LOG.format(wait="> 600") + " SELECT * FROM s")
def _sessions_one(c: Core) -> DataFrame:
    return _one_log(c, 600)


@query("gaps_of_one_log", ONE_LOG.format(wait="> 600") + """, g AS (SELECT *, lead(start_time) OVER (ORDER BY start_time, id) - end_time AS gap_seconds FROM s)
SELECT *, gap_seconds // 86400 AS gap_days FROM g WHERE gap_seconds >= 1200""")
def _gaps_one(c: Core) -> DataFrame:
    return sessions.long_gaps(_one_log(c, 600), [], 1200, spread=True)


@query("chunks_of_one_log", ONE_LOG.format(wait=">= 900") + f" SELECT count(*) AS chunks, max(n_commands) AS largest FROM s WHERE end_time < (SELECT max(end_time) FROM s) OR {NOW} - end_time >= 900")
def _chunks_one(c: Core) -> DataFrame:
    chunks = sessions.idle_chunks(c.commands.drop("session_id"), [], NOW, 900, spread=True)
    return chunks.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("chunks"), F.max("n").alias("largest"))


@query("sessions_spread")
def _sessions_spread(c: Core) -> DataFrame:
    """``sessions_gap`` with every user's rows dealt by range."""
    return sessions.session_rows(sessions.assign_sessions(c.commands.drop("session_id"), KEYS, GAP, spread=True), KEYS)


SQL["sessions_spread"] = SQL["sessions_gap"]


@query("nearest_neighbours", """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, round(CASE WHEN q.n * x.n = 0 THEN 0 ELSE list_dot_product(q.e, x.e) / (q.n * x.n) END, 9) AS score FROM u q, u x WHERE q.vec_id % 50 = 0)
SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""", bare=True)
def _neighbours(c: Core) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, among all vectors."""
    v = c.table("embeddings").select("vec_id", "embedding")
    found = neighbours.nearest_neighbours(neighbours.build_cells(v, "vec_id", "embedding"), v.where("vec_id % 50 = 0"), "vec_id", "embedding")
    return found.withColumn("score", F.round("score", 6))


@query("nearest_in_order")
def _nearest_in_order(c: Core) -> DataFrame:
    """Every third session has a project; the others get theirs in order, each from what is assigned by then."""
    sparse = c.sessions.withColumn("project_id", F.when(F.pmod("id", F.lit(3)) == 0, F.pmod("id", F.lit(4))))
    return attribution.nearest_in_order(sparse, c.commands, KEYS, 86400)


def _in_hours(t: str) -> str:
    """SQL of the working hours rule; days are whole ones before 1970 also."""
    day, second = f"floor(({t}) / 86400)::BIGINT", f"((({t}) % 86400 + 86400) % 86400)"
    on = f"({day} - CASE WHEN {second} < 32400 THEN 1 ELSE 0 END)"
    weekday = f"((({on} + 3) % 7 + 7) % 7)"
    return f"CASE WHEN {second} < 32400 OR {second} >= 64800 OR {weekday} >= 5 THEN ({on} - greatest(0, {weekday} - 4)) * 86400 + 57600 ELSE {t} END"


RECURSIVE_SQL = COMMANDS_SQL.rstrip().replace("WITH", "WITH RECURSIVE", 1)


@query("burst_collisions", f"""{RECURSIVE_SQL},
p AS (SELECT id AS position, command, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM commands),
z AS (SELECT *, greatest(bursts * 86400, 31536000) AS span FROM (SELECT (max(n) + 19) // 20 AS bursts FROM p)),
b AS (SELECT i, trunc({NOW} - 2592000 - span + i::DOUBLE / bursts * span)::BIGINT AS raw FROM z, range(bursts) r(i)),
t AS (SELECT i, ({_in_hours("raw")})::BIGINT AS t FROM b),
w AS (SELECT 0::BIGINT AS i, t AS "at", t + 200 AS ahead FROM t WHERE i = 0
  UNION ALL SELECT t.i, CASE WHEN t.t <= w.ahead THEN ({_in_hours('w."at" - 3600')})::BIGINT ELSE t.t END, CASE WHEN t.t <= w.ahead THEN w.ahead ELSE t.t + 200 END FROM w JOIN t ON t.i = w.i + 1)
SELECT position, command, w."at" + place % 20 * 10 AS timestamp FROM p JOIN w ON w.i = place // 20""", bare=True)
def _collisions(c: Core) -> DataFrame:
    """All commands as one log without times."""
    return recovery.place_bursts_apart(c.commands.select(F.col("id").alias("position"), "command"), [], NOW)


@query("merge_on_read", f"""b0 AS (SELECT user_id, start_time, end_time, 'first' AS summary FROM sessions WHERE start_time < {CUTOFF}),
b1 AS (SELECT user_id, start_time, end_time + 1 AS end_time, 'second' AS summary FROM sessions WHERE start_time >= {CUTOFF} - 604800),
b2 AS (SELECT user_id, start_time, end_time + 2 AS end_time, CASE WHEN id % 2 = 0 THEN 'third' END AS summary FROM sessions WHERE id % 3 = 0),
k AS (SELECT DISTINCT user_id, start_time FROM sessions)
SELECT k.user_id, k.start_time, coalesce(b2.end_time, b1.end_time, b0.end_time) AS end_time, coalesce(b0.summary, b1.summary, b2.summary) AS ai_summary
FROM k LEFT JOIN b0 USING (user_id, start_time) LEFT JOIN b1 USING (user_id, start_time) LEFT JOIN b2 USING (user_id, start_time)""")
def _merge_on_read(c: Core) -> DataFrame:
    """Three batches of sessions, the second and third of which change some of the first; buckets with two batches are put together anew."""
    s = written(c.sessions.select("user_id", "id", "start_time", "end_time"), "sessions")
    part = lambda rows, later, summary: rows.select("user_id", "start_time", (F.col("end_time") + later).alias("end_time"), summary.cast("string").alias("ai_summary"), F.lit(later).alias("nth"))
    batches = [
        part(s.where(F.col("start_time") < CUTOFF), 0, F.lit("first")), part(s.where(F.col("start_time") >= CUTOFF - 604800), 1, F.lit("second")),
        part(s.where("id % 3 = 0"), 2, F.when(F.col("id") % 2 == 0, "third")),
    ]
    table = MergeTable(c.spark, _folder(c, "merged"), batches[0].schema, ["user_id", "start_time"], {"end_time": "new", "ai_summary": "first_old"}, "nth", buckets=8, most=2)
    for number, rows in enumerate(batches):
        table.write(rows, number)
    return table.read()


@query("sketched_ranges", f"""r(first, last) AS (VALUES (DATE '2024-01-01', DATE '2024-01-07'), (DATE '2024-01-10', DATE '2024-01-31'), (DATE '2024-01-15', DATE '2024-01-15')),
x AS (SELECT r.*, c.command FROM r JOIN commands c ON make_timestamp(c.timestamp * 1000000)::DATE BETWEEN first AND last)
SELECT first, last, count(*) AS n, count(DISTINCT command) AS exact, true AS near FROM x GROUP BY ALL""")
def _ranges(c: Core) -> DataFrame:
    """Distinct commands of some ranges of days by day sketches, beside the exact number: ``near`` is within 3 %."""
    days = written(sketches.day_sketches(c.commands, [], "timestamp", "command", "id"), "days")
    out = None
    for first, last in (("2024-01-01", "2024-01-07"), ("2024-01-10", "2024-01-31"), ("2024-01-15", "2024-01-15")):
        a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
        about = sketches.over_days(days, [], a, b)
        exact = c.commands.where(F.to_date(F.timestamp_seconds("timestamp")).between(a, b)).agg(F.countDistinct("command").alias("exact"))
        row = about.crossJoin(F.broadcast(exact)).select(a.alias("first"), b.alias("last"), "n", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def _snapshots(c: Core) -> DataFrame:
    """A snapshot of each event, with keys in one of two orders."""
    k, kind = F.col("k"), F.col("event_type")
    third = F.pmod(k, F.lit(3))
    one = F.to_json(F.struct((k >= 50).alias("high"), F.struct(third.alias("third"), kind.alias("kind")).alias("state")))
    other = F.format_string('{ "state" : {"kind": "%s", "third": %d.0}, "high": %s}', kind, third, (k >= 50).cast("string"))
    return c.events.select(F.col("user_id").alias("session_id"), F.lit("shell").alias("source"), F.when(F.col("event_id") % 2 == 0, one).otherwise(other).alias("payload"), F.struct("t", "event_id").alias("captured_at"))


SNAPSHOTS_SQL = """s AS (SELECT user_id AS session_id, event_id, t, k >= 50 AS high, k % 3 AS third, event_type AS kind FROM ev),
l AS (SELECT *, lag(high) OVER w AS high0, lag(third) OVER w AS third0, lag(kind) OVER w AS kind0 FROM s WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id))"""


@query("snapshots_by_value", SNAPSHOTS_SQL + " SELECT session_id, event_id FROM l WHERE high0 IS NULL OR high <> high0 OR third <> third0 OR kind <> kind0")
def _by_value(c: Core) -> DataFrame:
    """Equal payloads with keys in another order are no change."""
    return payloads.changed_snapshots(_snapshots(c)).select("session_id", "captured_at.event_id")


@query("snapshot_changes", SNAPSHOTS_SQL + """, d AS (
SELECT session_id, event_id, '$' AS path, NULL AS before, '{"high":' || high || ',"state":{"kind":"' || kind || '","third":' || third || '}}' AS after FROM l WHERE high0 IS NULL
UNION ALL SELECT session_id, event_id, '$.high', high0::VARCHAR, high::VARCHAR FROM l WHERE high <> high0
UNION ALL SELECT session_id, event_id, '$.state.third', third0::VARCHAR, third::VARCHAR FROM l WHERE third <> third0
UNION ALL SELECT session_id, event_id, '$.state.kind', '"' || kind0 || '"', '"' || kind || '"' FROM l WHERE kind <> kind0) SELECT * FROM d""")
def _changes(c: Core) -> DataFrame:
    """What changed from each snapshot to the next, by path."""
    rows = payloads.field_changes(_snapshots(c), ["session_id"], ["captured_at"])
    return rows.select("session_id", "captured_at.event_id", "path", "before", "after")


@query("payload_fields", SNAPSHOTS_SQL + " SELECT kind, high, count(*) AS n, sum(third)::BIGINT AS thirds FROM s GROUP BY ALL")
def _fields(c: Core) -> DataFrame:
    """Typed fields out of payloads."""
    rows = payloads.payload_fields(_snapshots(c), {"high": ("$.high", "boolean"), "third": ("$.state.third", "bigint"), "kind": ("$.state.kind", "string")})
    return rows.groupBy("kind", "high").agg(F.count("*").alias("n"), F.sum("third").alias("thirds"))


def _history_files(c: Core, kind: str, which: int, line: Column) -> str:
    """A third of the users' commands as history files of a shell, in order of time."""
    rows = c.commands.where(F.pmod("user_id", F.lit(3)) == which).withColumn("shard", F.pmod("user_id", F.lit(5)))
    folder = _folder(c, kind)
    rows.repartition("shard").sortWithinPartitions("shard", "timestamp", "id").select("shard", line.alias("value")).write.partitionBy("shard").text(folder)
    return folder


@query("histories", "SELECT DISTINCT timestamp, command FROM raw")
def _histories(c: Core) -> DataFrame:
    """Commands written as zsh, bash and fish histories, read back, and merged by time and text."""
    t, command = F.col("timestamp").cast("string"), F.col("command")
    kinds = {"zsh": F.concat(F.lit(": "), t, F.lit(":0;"), command), "bash": F.concat(F.lit("#"), t, F.lit("\n"), command), "fish": F.concat(F.lit("- cmd: "), command, F.lit("\n  when: "), t)}
    found = None
    for which, (kind, line) in enumerate(kinds.items()):
        rows = history.read_histories(c.spark, _history_files(c, kind, which, line), kind)
        found = rows if found is None else found.unionByName(rows)
    return history.merge_histories(found, []).select("timestamp", "command")


@query("histories_stream", "SELECT DISTINCT timestamp, command FROM raw WHERE user_id % 3 < 2")
def _histories_stream(c: Core) -> DataFrame:
    """zsh and bash histories read as a stream, in ranges of 64 KB, into a table."""
    t, command = F.col("timestamp").cast("string"), F.col("command")
    lines = {"zsh": F.concat(F.lit(": "), t, F.lit(":0;"), command), "bash": F.concat(F.lit("#"), t, F.lit("\n"), command)}
    target, found = _folder(c, "streamed"), None
    for which, (kind, line) in enumerate(lines.items()):
        rows = history.stream_histories(c.spark, _history_files(c, kind, which, line), kind, 1 << 16)
        out = rows.writeStream.format("parquet").option("path", f"{target}/{kind}").option("checkpointLocation", f"{target}-{kind}")
        out.trigger(availableNow=True).start().awaitTermination()
        read = c.spark.read.schema(rows.schema).parquet(f"{target}/{kind}")
        found = read if found is None else found.unionByName(read)
    return history.merge_histories(found, []).select("timestamp", "command")


@query("commit_log", "SELECT hash, timestamp, message FROM commits")
def _commit_log(c: Core) -> DataFrame:
    """Commits written as a log of ``hash|epoch|subject`` lines, some of them malformed, and read back."""
    folder = _folder(c, "log")
    lines = c.commits.select(F.concat_ws("|", "hash", F.col("timestamp").cast("string"), "message").alias("value"))
    bad = c.commits.select(F.explode(F.array(F.col("hash"), F.concat("hash", F.lit("|soon|x")), F.lit(""))).alias("value"))
    lines.union(bad).write.text(folder)
    return history.read_commit_log(c.spark, folder)


# SQL that goes row by row, for the queries of the sequential rules.
SQL["neighbour_propagation"] = f"""{RECURSIVE_SQL},
o AS (SELECT user_id, id, start_time, end_time, CASE WHEN id % 3 = 0 THEN id % 4 END AS p, row_number() OVER (PARTITION BY user_id ORDER BY start_time, id) AS n FROM sessions),
f AS (SELECT *, first_value(p IGNORE NULLS) OVER w AS fp, first_value(CASE WHEN p IS NOT NULL THEN start_time END IGNORE NULLS) OVER w - end_time AS ahead
  FROM o WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
r AS (SELECT user_id, n, id, coalesce(p, CASE WHEN ahead < 172800 THEN fp END) AS propagated, CASE WHEN p IS NOT NULL OR ahead < 172800 THEN end_time END AS until, coalesce(p, CASE WHEN ahead < 172800 THEN fp END) AS before FROM f WHERE n = 1
  UNION ALL SELECT x.user_id, x.n, x.id, x.got, CASE WHEN x.got IS NULL THEN x.until ELSE x.end_time END, coalesce(x.got, x.before) FROM (
    SELECT f.*, r.until, r.before, CASE WHEN f.p IS NOT NULL THEN f.p WHEN f.start_time - r.until < 172800 AND (coalesce(f.ahead >= 172800, true) OR f.start_time - r.until <= f.ahead) THEN r.before WHEN f.ahead < 172800 THEN f.fp END AS got
    FROM r JOIN f ON f.user_id = r.user_id AND f.n = r.n + 1) x)
SELECT id, propagated FROM r"""

SQL["rebuild_clusters"] = f"""{RECURSIVE_SQL},
b AS (SELECT user_id, timestamp AS t, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, id) AS nth FROM commands WHERE contains(command, 'npm run build')),
r AS (SELECT user_id, nth, NULL::BIGINT AS start, 0::BIGINT AS n, [t] AS held FROM b WHERE nth = 1
  UNION ALL SELECT x.user_id, x.nth, CASE WHEN x.inside THEN x.start WHEN len(x.wait) >= 3 THEN x.wait[1] END, CASE WHEN x.inside THEN x.n + 1 WHEN len(x.wait) >= 3 THEN len(x.wait) ELSE 0 END, x.wait FROM (
    SELECT b.user_id, b.nth, r.start, r.n, coalesce(b.t - r.start <= 86400, false) AS inside,
      CASE WHEN r.start IS NOT NULL AND b.t - r.start <= 86400 THEN [] WHEN r.start IS NOT NULL THEN [b.t] ELSE list_append(list_filter(r.held, lambda h: b.t - h <= 86400), b.t) END AS wait
    FROM r JOIN b ON b.user_id = r.user_id AND b.nth = r.nth + 1) x)
SELECT user_id, start, max(n) AS n FROM r WHERE start IS NOT NULL GROUP BY 1, 2"""

PLACES_SQL = """z AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w > 86400 OR lag(timestamp) OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM commands WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id)),
y AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY timestamp, id) AS piece FROM z),
places AS (SELECT user_id, id, timestamp, command, '/home/dev' || coalesce(string_agg(CASE WHEN starts_with(command, 'cd ') THEN '/' || command[4:] END, '') OVER (PARTITION BY user_id, piece ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS cwd FROM y)"""
SQL["directory_replay"] = f"{COMMANDS_SQL.rstrip()},\n{PLACES_SQL} SELECT * FROM places"


@query("folder_roots", f"""{PLACES_SQL}, d AS (SELECT DISTINCT cwd AS path FROM places), m AS (SELECT path AS up, id % 2 = 0 AS vcs FROM projects UNION ALL SELECT path || '/project-3', true FROM projects WHERE id = 1),
a AS (SELECT path, n, '/' || array_to_string(string_split(path[2:], '/')[1:n], '/') AS up FROM d, range(1, 200) r(n) WHERE n <= len(string_split(path[2:], '/'))),
h AS (SELECT path, arg_max(up, n) FILTER (vcs) AS v, arg_max(up, n) FILTER (NOT vcs) AS o FROM a LEFT JOIN m USING (up) GROUP BY 1)
SELECT path, coalesce(v, o, nullif(regexp_extract(path, '^(/home/dev(?:/[^/.][^/]*){{1,2}})', 1), '')) AS root FROM h""")
def _roots(c: Core) -> DataFrame:
    """Roots of all folders that commands ran in; projects of even id have version control, others a manifest, and one holds another."""
    placed = attribution.replay_directories(c.commands.select("user_id", "id", "timestamp", "command"), KEYS, "/home/dev", reset_after=86400)
    markers = c.projects.select("path", F.when(F.col("id") % 2 == 0, "vcs").otherwise("manifest").alias("kind"))
    nested = c.projects.where("id = 1").select(F.concat("path", F.lit("/project-3")).alias("path"), F.lit("vcs").alias("kind"))
    return attribution.project_roots(placed.select(F.col("cwd").alias("path")), markers.unionByName(nested), "/home/dev")


NAMED_FILES_SQL = r"""w AS (SELECT session_id, user_id, timestamp, id, unnest(list_filter(regexp_split_to_array(trim(command), '\s+')[2:], lambda x: regexp_matches(x, '[/.]') AND NOT regexp_matches(x, '^-|://|[$=]'))) AS relpath FROM commands),
u AS (SELECT DISTINCT relpath, '/home/dev/project-' || (length(relpath) % 3) AS root FROM w WHERE relpath LIKE '%.py' OR relpath LIKE '%.txt')"""


def _named_files(c: Core) -> DataFrame:
    return c.commands.select("user_id", F.explode(file_arguments(F.col("command"))).alias("relpath"))


@query("file_argument_roots", NAMED_FILES_SQL + r""" SELECT session_id, arg_max(root, (len(string_split(relpath, '/')), -timestamp, -id)) AS root FROM w JOIN u USING (relpath) GROUP BY 1""")
def _file_roots(c: Core) -> DataFrame:
    """A session's project by the files that its commands name."""
    files = _named_files(c).where(r"relpath LIKE '%.py' OR relpath LIKE '%.txt'").select("relpath", F.concat(F.lit("/home/dev/project-"), (F.length("relpath") % 3).cast("string")).alias("root")).distinct()
    return attribution.by_file_arguments(c.commands, files)


@query("project_languages", NAMED_FILES_SQL + r""", f AS (SELECT DISTINCT user_id AS project_id, relpath FROM w),
m AS (SELECT DISTINCT relpath, ['Python', 'Go', 'Rust'][length(relpath) % 3 + 1] AS language, relpath AS priority FROM w WHERE relpath LIKE 'tests/%7.py')
SELECT project_id, arg_min(language, priority) AS language FROM f JOIN m USING (relpath) GROUP BY 1""")
def _project_languages(c: Core) -> DataFrame:
    """A user's files as a project's, some of which count as manifests."""
    files = _named_files(c).select(F.col("user_id").alias("project_id"), "relpath").distinct()
    language = F.element_at(F.array(F.lit("Python"), F.lit("Go"), F.lit("Rust")), F.length("relpath") % 3 + 1)
    manifests = files.where("relpath LIKE 'tests/%7.py'").select("relpath", language.alias("language"), F.col("relpath").alias("priority")).distinct()
    return insights.project_languages(files, manifests)


@query("project_names", """p AS (SELECT id, 'app ' || (id % 4) AS name, CASE WHEN id = 6 THEN '/app' ELSE path || '/app' END AS path FROM projects)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 AND string_split(path, '/')[-2] <> '' THEN name || ' (' || string_split(path, '/')[-2] || ')' ELSE name END AS name FROM p""")
def _project_names(c: Core) -> DataFrame:
    """Names that several projects share get their parent folder."""
    path = F.when(F.col("id") == 6, "/app").otherwise(F.concat("path", F.lit("/app")))
    shared = c.projects.select("id", F.concat(F.lit("app "), (F.col("id") % 4).cast("string")).alias("name"), path.alias("path"))
    return attribution.disambiguate(shared).select("id", "name")


@query("index_differences", """b AS (SELECT 'command' AS type, session_id::VARCHAR AS ref, id, command AS text, session_id % 5 = 0 AS lost FROM commands UNION ALL SELECT 'commit', hash, 0, message, false FROM commits),
i AS (SELECT type, ref, text FROM b WHERE NOT lost UNION ALL SELECT type, ref, 'stale ' || text FROM b WHERE type = 'command' AND id % 97 = 0),
d AS (SELECT type, ref, text, sum(n) AS n FROM (SELECT *, 1 AS n FROM i UNION ALL SELECT type, ref, text, -1 FROM b) GROUP BY ALL HAVING sum(n) <> 0)
SELECT type, ref, sum(greatest(n, 0))::BIGINT AS indexed, sum(greatest(-n, 0))::BIGINT AS found FROM d GROUP BY ALL""")
def _differences(c: Core) -> DataFrame:
    """What an index lacks and what it holds wrongly, after a fifth of the sessions is lost and some stale texts came in."""
    fresh = search.index_rows(c.commands, c.commits, c.sessions)
    lost = fresh.where("NOT (type = 'command' AND cast(ref AS long) % 5 = 0)")
    stale = c.commands.where("id % 97 = 0").select(F.lit("command").alias("type"), F.col("session_id").cast("string").alias("ref"), F.concat(F.lit("stale "), "command").alias("text"))
    return search.index_differences(lost.unionByName(stale), fresh)


@query("date_strings", """SELECT id, CASE WHEN id % 6 IN (2, 3) THEN timestamp // 86400 * 86400 WHEN id % 6 = 4 THEN timestamp - 7200 ELSE timestamp END AS parsed FROM commands WHERE id % 7 <> 0 UNION ALL SELECT id, NULL FROM commands WHERE id % 7 = 0""")
def _date_strings(c: Core) -> DataFrame:
    """The commands' times in six forms, one of them with an offset of two hours, and texts that are no dates; read back."""
    at = F.timestamp_seconds("timestamp")
    day = lambda pattern: F.date_format(at, pattern)
    forms = [day("yyyy-MM-dd'T'HH:mm:ss"), F.concat(day("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), day("yyyy-MM-dd"), day("yyyy_M_d"), F.concat(day("E, d MMM yyyy HH:mm:ss"), F.lit(" +0200")), F.concat(day("E MMM d HH:mm:ss yyyy"), F.lit(" +0000"))]
    text = F.when(F.col("id") % 7 == 0, F.concat(F.lit("on "), forms[0])).otherwise(F.element_at(F.array(*forms), (F.col("id") % 6 + 1).cast("int")))
    return c.commands.select("id", parse_date(text).alias("parsed"))


@query("latest_session", "SELECT id, start_time FROM sessions WHERE id % 5 <> 0 AND NOT is_legacy ORDER BY end_time DESC, start_time DESC, id DESC LIMIT 1")
def _latest(c: Core) -> DataFrame:
    """A fifth of the sessions is open, and legacy ones do not count."""
    rows = reports.without_legacy(c.sessions).withColumn("end_time", F.when(F.col("id") % 5 != 0, F.col("end_time")))
    return reports.latest_session(rows).select("id", "start_time")


@query("own_sessions", "SELECT id FROM sessions s WHERE NOT is_legacy AND EXISTS (SELECT 1 FROM commands c WHERE c.session_id = s.id AND NOT c.is_legacy)")
def _own_sessions(c: Core) -> DataFrame:
    return reports.without_legacy(c.sessions, c.commands).select("id")


@query("dashboard_days", """s AS (SELECT id, make_timestamp(start_time * 1000000)::DATE AS day, duration_seconds >= 172800 AS long, n_commands AS n FROM sessions WHERE NOT is_legacy),
d AS (SELECT day::DATE AS day FROM generate_series(DATE '2024-01-05', DATE '2024-02-03', INTERVAL 1 DAY) g(day)),
p AS (SELECT day, coalesce(sum(n), 0)::BIGINT AS n, coalesce(bool_or(long), false) AS long FROM d LEFT JOIN s USING (day) GROUP BY 1)
SELECT day, n, CASE WHEN n = 0 THEN 0 WHEN n < 5 THEN 1 WHEN n < 20 THEN 2 ELSE 3 END AS level, (n > 0 AND n = max(n) OVER ()) OR long AS highlight FROM p""")
def _dashboard(c: Core) -> DataFrame:
    """Thirty days up to one after the last event; the quiet days at the end have no activity."""
    return insights.dashboard_days(c.sessions, c.commands, "2024-02-03", 30, 172800)


@query("session_lines", f"""{LINKED_SQL},
x AS (SELECT id, CASE id % 4 WHEN 0 THEN 'kept ' || id WHEN 1 THEN 'no label' END AS told FROM sessions),
m AS (SELECT session_id AS id, arg_min(message, (t, hash)) AS message FROM linked GROUP BY 1),
n AS (SELECT *, starts_with(command, 'ls') OR starts_with(command, 'cd ') OR starts_with(command, 'cat ') OR command = 'git status' AS noise FROM commands),
w AS (SELECT session_id AS id, arg_max(command, (length(command), -timestamp, -id)) FILTER (NOT noise) AS work, arg_max(command, (timestamp, id)) AS last FROM n GROUP BY 1),
c AS (SELECT id, coalesce(work, last) AS command FROM w)
SELECT id, coalesce(told, 'P' || regexp_extract(message, ':rocket: p(.*) \\(', 1), CASE WHEN starts_with(command, 'git commit') THEN regexp_extract(command, '"([^"]+)"', 1) WHEN contains(command, ' && ') THEN split_part(command, ' && ', 2) ELSE command END) AS line
FROM x LEFT JOIN m USING (id) JOIN c USING (id)""")
def _session_lines(c: Core) -> DataFrame:
    """A fourth of the sessions has a summary with labels, another one that is a single line."""
    labelled = F.concat(F.lit("[head]\n\n  ├─ 🔨 Built: \n• hacked: ├─ kept "), F.col("id").cast("string"), F.lit("\nmore"))
    rows = c.sessions.withColumn("ai_summary", F.when(F.col("id") % 4 == 0, labelled).when(F.col("id") % 4 == 1, "no label").when(F.col("id") % 4 == 2, ""))
    return insights.session_lines(rows, c.commands, linked(c))


@query("recovered_times", f"""f AS (SELECT command[5:] AS key, min(timestamp) AS ts FROM commands WHERE starts_with(command, 'vim ') GROUP BY 1),
a AS (SELECT user_id, c.id AS i, coalesce(CASE WHEN c.id % 3 = 0 THEN timestamp END, CASE WHEN length(key) % 2 = 0 THEN ts END) AS t FROM commands c LEFT JOIN f ON command = 'vim ' || key),
b AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS bi, first_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ai FROM a)
SELECT i AS id, t AS timestamp, false AS is_legacy FROM a WHERE t IS NOT NULL
UNION ALL SELECT b.i, trunc(x.t + (y.t - x.t) * (b.i - bi) / (ai - bi))::BIGINT, true FROM b JOIN a x ON x.user_id = b.user_id AND x.i = bi JOIN a y ON y.user_id = b.user_id AND y.i = ai WHERE b.t IS NULL""")
def _recovered(c: Core) -> DataFrame:
    """Two thirds of the commands without a time get one from edited files (of which some are too old) or between anchors."""
    rows = c.commands.select("user_id", F.col("id").alias("position"), "command", F.when(F.pmod("id", F.lit(3)) == 0, F.col("timestamp")).alias("timestamp"))
    key = F.expr("substring(command, 5)")
    files = c.commands.where("command LIKE 'vim %'").groupBy(F.lit("file").alias("type"), key.alias("key")).agg(F.min("timestamp").alias("ts"))
    files = files.withColumn("ts", F.when(F.length("key") % 2 == 0, F.col("ts")).otherwise(F.col("ts") - 6 * 366 * 86400))
    found = recovery.recover(rows, KEYS, files, NOW)
    return found.where("recovery_source IS NULL OR recovery_source = 'between anchors'").where("timestamp IS NOT NULL").select(F.col("position").alias("id"), "timestamp", "is_legacy")
