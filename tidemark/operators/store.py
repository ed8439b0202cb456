"""Idempotent writes as joins: upserts, keyed stores, snapshots, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.redact import is_blacklisted, redact
from tidemark.functions.time import timeframe_older_than
from tidemark.operators.joins import by_ids, display_name, with_project
from tidemark.operators.sessions import assign_sessions, idle_chunks

FAR_FUTURE = 9_999_999_999


def _merge(old: DataFrame, new: DataFrame, on: list[str], rules: dict[str, str]) -> DataFrame:
    """Full outer join on the natural key, null-safe. Rules: new, old, min, max, or first_new (new unless null)."""
    o, n = old.select(*on, *[F.col(c).alias(f"__o_{c}") for c in rules], F.lit(True).alias("__o")), new.select(*on, *[F.col(c).alias(f"__n_{c}") for c in rules], F.lit(True).alias("__n"))
    condition = None
    for c in on:
        n = n.withColumnRenamed(c, f"__k_{c}")
        part = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        condition = part if condition is None else condition & part
    joined = o.join(n, condition, "full")
    keys = [F.when(F.col("__o"), F.col(c)).otherwise(F.col(f"__k_{c}")).alias(c) for c in on]
    out = []
    for c, rule in rules.items():
        a, b = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        value = {
            "new": F.when(F.col("__n"), b).otherwise(a), "old": F.when(F.col("__o"), a).otherwise(b),
            "min": F.least(a, b), "max": F.greatest(a, b), "first_new": F.coalesce(b, a), "first_old": F.coalesce(a, b),
        }[rule]
        out.append(value.alias(c))
    return joined.select(*keys, *out)


def upsert_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """By path: the first and last sight widen, the new name wins."""
    return _merge(old, new, ["path"], {"name": "new", "first_seen": "min", "last_seen": "max"})


def upsert_sessions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """By start and project: end and duration are replaced, summary and tags kept."""
    return _merge(old, new, [*keys, "start_time", "project_id"], {"end_time": "new", "duration_seconds": "new", "ai_summary": "old", "tags": "old"})


def upsert_commands(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """By time and text: the new exit code, session, project and legacy mark win, and with any change the recovery source, null included."""
    changed = ["exit_code", "session_id", "project_id", "is_legacy"]
    rules = {c: "new" for c in [*changed, "recovery_source"]}
    return _merge(old, new, [*keys, "timestamp", "command"], rules)


def insert_new(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """The first write of a key stays."""
    first = new.dropDuplicates(on)
    return old.unionByName(first.join(old.select(*on), on, "left_anti"), allowMissingColumns=True)


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of a key stays."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("x")).select(key, "x.*")


def point_updates(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    new = updates.select(key, F.col(column).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def archive(sessions: DataFrame, commands: DataFrame, commits: DataFrame, summaries: DataFrame, cutoff: int) -> dict[str, DataFrame]:
    """Old and kept parts of each table; commands without a session that are old are in neither."""
    old = sessions.where(F.col("start_time") < cutoff)
    of_old = old.select(F.col("id").alias("session_id"))
    date = F.to_date(F.timestamp_seconds(F.lit(cutoff)))
    over = timeframe_older_than(F.col("timeframe_id"), F.col("type"), date)
    loose = F.col("session_id").isNull() & (F.col("timestamp") < cutoff)
    out = {
        "old_sessions": old, "sessions": sessions.where(F.col("start_time") >= cutoff),
        "old_commands": commands.join(of_old, "session_id", "left_semi"), "commands": commands.where(~loose).join(of_old, "session_id", "left_anti"),
        "old_commits": commits.where(F.col("timestamp") < cutoff), "commits": commits.where(F.col("timestamp") >= cutoff),
        "old_summaries": summaries.where(over), "summaries": summaries.where(~over),
    }
    return out


def remap_projects(rows: DataFrame, here: DataFrame, there: DataFrame) -> DataFrame:
    """Project ids of one store become those of another with the same path."""
    ids = here.select(F.col("id").alias("project_id"), "path").join(there.select(F.col("id").alias("__to"), "path"), "path").select("project_id", "__to")
    return rows.join(ids, "project_id", "left").withColumn("project_id", F.col("__to")).drop("__to")


def safe_context(commands: DataFrame, limit: int, user_patterns: list[str] = ()) -> DataFrame:
    """The newest commands, redacted, without any session that has a blacklisted command."""
    blocked = commands.where(is_blacklisted(F.col("command"), list(user_patterns))).select("session_id").distinct()
    return commands.join(blocked, "session_id", "left_anti").orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit).withColumn("command", redact(F.col("command")))


def current_context(sessions: DataFrame, commands: DataFrame, commits: DataFrame, projects: DataFrame, limit: int = 50, user_patterns: list[str] = ()) -> DataFrame:
    """(kind, at, text), newest first: safe commands, as many redacted commits, and the project of the newest session that has one."""
    of_commands = safe_context(commands, limit, user_patterns).select(F.lit("command").alias("kind"), F.col("timestamp").alias("at"), F.col("command").alias("text"))
    newest = commits.where(~is_blacklisted(F.col("message"), list(user_patterns))).orderBy(F.col("timestamp").desc(), "hash").limit(limit)
    of_commits = newest.select(F.lit("commit"), "timestamp", redact(F.col("message")))
    named = sessions.where("project_id IS NOT NULL").orderBy(F.col("start_time").desc(), F.col("id").desc()).limit(1)
    project = named.join(projects.select(F.col("id").alias("project_id"), "name"), "project_id").select(F.lit("project"), "start_time", "name")
    return of_commands.union(of_commits).union(project)


def export_selection(sessions: DataFrame, commands: DataFrame, projects: DataFrame, project: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Sessions that start from ``since`` to ``until``, both included, of a project; reversed bounds are an error."""
    lo, hi = 0 if since is None else since, FAR_FUTURE if until is None else until
    if lo > hi:
        raise ValueError("the start of the range must not be after its end")
    chosen = sessions.where(F.col("start_time").between(lo, hi))
    return matches_project(chosen, commands, projects, project) if project else chosen


def interactive_filter(sessions: DataFrame, commands: DataFrame, linked: DataFrame, projects: DataFrame, memories: DataFrame, query: str) -> DataFrame:
    """Sessions with the query, without case, in their display name, memory, a command or a commit."""
    q = query.lower()
    named = with_project(sessions, projects).where(F.lower(display_name(F.col("project_name"))).contains(q)).select("id")
    found = [df.where(F.lower(c).contains(q)).select(F.col("session_id").alias("id")) for df, c in ((memories, "memory"), (commands, "command"), (linked, "message"))]
    return by_ids(sessions, named.union(found[0]).union(found[1]).union(found[2]))


def command_lookup(commands: DataFrame) -> DataFrame:
    """Sorted times of each command."""
    return commands.groupBy("command").agg(F.array_sort(F.collect_list("timestamp")).alias("times"))


def report_tables(sessions: DataFrame, commands: DataFrame, start: int, end: int, limit: int = 500) -> dict[str, DataFrame]:
    """Totals of the range, its newest sessions in rising order with how many there are, and commands a day."""
    chosen = sessions.where(F.col("start_time").between(start, end))
    total = chosen.agg(F.count("*").alias("total"))
    newest = chosen.orderBy(F.col("start_time").desc(), F.col("id").desc()).limit(limit)
    days = commands.where(F.col("timestamp").between(start, end)).groupBy(F.to_date(F.timestamp_seconds("timestamp")).alias("day")).agg(F.count("*").alias("n"))
    meta = total.select(F.lit(limit).alias("limit"), F.least("total", F.lit(limit)).alias("returned"), "total", (F.col("total") > limit).alias("truncated"))
    kpis = chosen.agg(F.count("*").alias("sessions"), F.countDistinct("project_id").alias("projects"), F.sum("duration_seconds").alias("duration"))
    return {"sessions": newest.orderBy("start_time", "id"), "meta": meta, "days": days, "kpis": kpis}


def report_data(sessions: DataFrame, commands: DataFrame, projects: DataFrame, start: int, end: int, limit: int = 500, highlights: int = 15, days: int = 90) -> dict[str, DataFrame]:
    """The whole data set of a report: ``report_tables`` with projects by time, the newest sessions with a summary, and commands on each of the last ``days`` days."""
    out = report_tables(sessions, commands, start, end, limit)
    chosen = sessions.where(F.col("start_time").between(start, end))
    per = with_project(chosen, projects).groupBy(display_name(F.col("project_name")).alias("project")).agg(F.count("*").alias("sessions"), F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("duration"))
    said = chosen.where("ai_summary IS NOT NULL AND trim(ai_summary) <> ''").orderBy(F.col("start_time").desc(), F.col("id").desc()).limit(highlights)
    last = F.to_date(F.timestamp_seconds(F.lit(end)))
    spine = sessions.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counts = commands.groupBy(F.to_date(F.timestamp_seconds("timestamp")).alias("day")).agg(F.count("*").alias("n"))
    daily = spine.join(counts, "day", "left").fillna(0, ["n"])
    return out | {"projects": per.orderBy(F.col("duration").desc(), "project"), "highlights": said, "daily": daily}


def consolidate(commands: DataFrame, done: DataFrame, keys: list[str], now: int, force: bool = False) -> DataFrame:
    """New consolidated chunks: commands after each key's high-water mark, split where idle, summed up by first words.

    Running it again on what it has written adds nothing.
    """
    mark = done.groupBy(*keys).agg(F.max("end_time").alias("__mark"))
    fresh = commands.join(mark, keys, "left").where(F.col("__mark").isNull() | (F.col("timestamp") > F.col("__mark"))).drop("__mark")
    chunks = idle_chunks(fresh, keys, now, force=force)
    word = F.regexp_extract(F.trim("command"), r"^(\S+)", 1)
    per = chunks.groupBy(*keys, "session_id", word.alias("word")).agg(F.count("*").alias("n"), F.min(F.struct("timestamp", "id")).alias("first"), F.min("timestamp").alias("s"), F.max("timestamp").alias("e"), F.collect_set(F.trim("command")).alias("texts"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", "word", "n"))), lambda x: F.concat(x["word"], F.lit(" x"), x["n"].cast("string")))
    return per.groupBy(*keys, "session_id").agg(F.min("s").alias("start_time"), F.max("e").alias("end_time"), F.array_join(parts, " | ").alias("summary"), F.array_sort(F.flatten(F.collect_list("texts"))).alias("commands")).drop("session_id")


def gate_sessions(commands: DataFrame, marker: str = "[BLOCKED]") -> DataFrame:
    """Redacted commands; every command of a session with a blacklisted one becomes the marker."""
    blocked = commands.where(is_blacklisted(F.col("command"))).select("session_id").distinct().withColumn("blocked", F.lit(True))
    joined = commands.join(blocked, "session_id", "left")
    return joined.withColumn("command", F.when(F.col("blocked"), marker).otherwise(redact(F.col("command")))).withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def matches_project(sessions: DataFrame, commands: DataFrame, projects: DataFrame, wanted: str) -> DataFrame:
    """Sessions whose project, or a command's project, has ``wanted`` in its name or path; other/general/no project mean none."""
    q = wanted.strip().lower()
    if q in ("other", "general", "no project"):
        own, any_command = F.col("project_id").isNull(), F.col("project_id").isNull()
        ids = sessions.where(own).select("id").union(commands.where(any_command).select("session_id"))
    else:
        hit = projects.where(F.lower("name").contains(q) | F.lower(F.coalesce("path", F.lit(""))).contains(q)).select(F.col("id").alias("project_id"))
        ids = sessions.join(hit, "project_id", "left_semi").select("id").union(commands.join(hit, "project_id", "left_semi").select("session_id"))
    return sessions.join(ids.distinct(), "id", "left_semi")


def resession(commands: DataFrame, keys: list[str], gap: int = 1800) -> DataFrame:
    """Sessions anew over merged commands, for rows that came too late for a stream."""
    return assign_sessions(commands.drop("session_id") if "session_id" in commands.columns else commands, keys, gap)
