"""Joins over sessions, commands, commits and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import NO_PROJECT, OTHER

BEFORE, AFTER = 300, 600  # a commit belongs to sessions from so many seconds before their start to after their end
SMALL = 200_000  # rows of a dimension that is sent to every task


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The frame marked for broadcasting, if it is known to have few rows."""
    return F.broadcast(df) if rows is not None and rows <= SMALL else df


def display_name(name: Column) -> Column:
    return F.when(name.isNull() | (F.trim(name) == "") | (name == NO_PROJECT), OTHER).otherwise(name)


def with_project(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    named = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), F.col("path").alias("project_path"))
    return sessions.join(named, "project_id", "left")


def sessions_with_commits(sessions: DataFrame, commits: DataFrame, keys: list[str], open_seconds: int = 0, bucket: int = 86400) -> DataFrame:
    """(session_id, hash): commits of the session's project within the interval around it.

    The interval join is made an equi-join by time buckets: a commit is in one,
    a session in the few that its interval touches, so that neither one project
    nor a long history lands in one task.
    """
    lo = F.col("start_time") - BEFORE
    hi = F.coalesce("end_time", F.col("start_time") + open_seconds) + AFTER
    spans = sessions.where("project_id IS NOT NULL").select(*keys, F.col("id").alias("session_id"), "project_id", lo.alias("lo"), hi.alias("hi"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    points = commits.select(*keys, "project_id", "hash", F.col("timestamp").alias("t")).withColumn("bucket", F.floor(F.col("t") / bucket))
    return spans.join(points, [*keys, "project_id", "bucket"]).where("t BETWEEN lo AND hi").select(*keys, "session_id", "hash", "t")


def nested_sessions(sessions: DataFrame, commands: DataFrame, commits: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions with their commands and commits as ordered arrays; each side is aggregated before it is joined."""
    of_commands = commands.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", "command", "exit_code", "is_legacy"))).alias("commands"))
    linked = sessions_with_commits(sessions, commits, keys).join(commits.select("hash", "message"), "hash")
    of_commits = linked.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("timestamp"), "hash", "message"))).alias("commits"))
    return sessions.withColumnRenamed("id", "session_id").join(of_commands, "session_id", "left").join(of_commits, "session_id", "left").withColumnRenamed("session_id", "id")


def hits_to_sessions(hits: DataFrame, commands: DataFrame, links: DataFrame) -> DataFrame:
    """hits: type, ref, score. Best score per session, each type by a join of its own."""
    by_summary = hits.where("type = 'summary'").select(F.col("ref").cast("long").alias("session_id"), "score")
    by_command = hits.where("type = 'command'").join(commands.select(F.col("id").cast("string").alias("ref"), "session_id"), "ref").select("session_id", "score")
    by_commit = hits.where("type = 'commit'").join(links.select(F.col("hash").alias("ref"), "session_id"), "ref").select("session_id", "score")
    return by_summary.unionByName(by_command).unionByName(by_commit).groupBy("session_id").agg(F.min("score").alias("score"))


def summaries_of_day(summaries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Daily summaries with the sessions of the day on which they were made."""
    of_day = summaries.where("type = 'daily'").withColumn("day", F.to_date(F.timestamp_seconds("created_at")))
    return of_day.join(sessions.withColumn("day", F.to_date(F.timestamp_seconds("start_time"))), "day")


def project_of_first_match(sessions: DataFrame, commands: DataFrame, matches: Column) -> DataFrame:
    """Sessions with the project of their first matching attributed command, else their own."""
    first = commands.where(matches & F.col("project_id").isNotNull()).groupBy("session_id").agg(F.min_by("project_id", F.struct("timestamp", "id")).alias("matched_project"))
    return sessions.join(first.withColumnRenamed("session_id", "id"), "id", "left").withColumn("effective_project", F.coalesce("matched_project", "project_id"))


def prune_orphans(sessions: DataFrame, commands: DataFrame, keys: list[str]) -> DataFrame:
    """Drop sessions without commands that share their start with another session."""
    has = commands.select(F.col("session_id").alias("id")).distinct().withColumn("has", F.lit(True))
    shared = F.count("*").over(Window.partitionBy(*keys, "start_time")) > 1
    marked = sessions.withColumn("__shared", shared).join(has, "id", "left")
    return marked.where(F.col("has") | ~F.col("__shared")).drop("has", "__shared")


def same_ids(a: DataFrame, b: DataFrame, on: str) -> bool:
    """Whether both frames have the same ids (as sets)."""
    return a.join(b, on, "left_anti").isEmpty() and b.join(a, on, "left_anti").isEmpty()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both frames have the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def by_ids(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is listed (in a column of the same name); unknown and repeated ids change nothing."""
    return rows.join(ids.select(id_col).distinct(), id_col, "left_semi")


def project_sessions_since(sessions: DataFrame, project_id: int, since: int) -> DataFrame:
    return sessions.where((F.col("project_id") == project_id) & (F.col("start_time") >= since))


def with_tags(sessions: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Sessions that have every wanted tag; ``tags`` has session_id and tags (array)."""
    has = tags.select(F.col("session_id").alias("id"), "tags")
    for tag in wanted:
        has = has.where(F.array_contains("tags", tag.strip().lower()))
    return sessions.join(has.select("id"), "id", "left_semi") if wanted else sessions


def failures_before_commits(commits: DataFrame, sessions: DataFrame, commands: DataFrame, keys: list[str], lookback: int = 1800) -> DataFrame:
    """For each commit, the failing commands of its project in the time before it, newest first.

    A null exit code is no failure; ``kill -9`` is counted among the failures.
    """
    failing = commands.where("exit_code <> 0").join(sessions.select(F.col("id").alias("session_id"), F.col("project_id").alias("of_session")), "session_id")
    failing = failing.select(*keys, F.col("of_session").alias("project_id"), F.col("timestamp").alias("t"), F.col("id").alias("command_id"), "command")
    bucketed = failing.withColumn("bucket", F.floor(F.col("t") / lookback))
    probes = commits.withColumn("bucket", F.explode(F.array(F.floor(F.col("timestamp") / lookback), F.floor(F.col("timestamp") / lookback) - 1)))
    near = probes.join(bucketed, [*keys, "project_id", "bucket"]).where("t >= timestamp - %d AND t < timestamp" % lookback)
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("t", "command_id", "command"))))
    return near.groupBy(*keys, "hash").agg(F.count("*").alias("failures"), F.count_if(F.col("command").contains("kill -9")).alias("kills"), F.transform(newest, lambda x: x["command"]).alias("commands"))


def interrupted_sessions(sessions: DataFrame, keys: list[str], now: int, wait: int = 43200, horizon: int = 7 * 86400) -> DataFrame:
    """Sessions that ended between ``horizon`` and ``wait`` ago, with no start of their project in the ``wait`` after their end."""
    end = F.coalesce("end_time", "start_time")
    ended = sessions.withColumn("ended", end).where(F.col("ended").between(now - horizon, now - wait))
    starts = sessions.select(*keys, "project_id", F.col("start_time").alias("s")).withColumn("bucket", F.floor(F.col("s") / wait))
    probes = ended.withColumn("bucket", F.explode(F.array(F.floor(F.col("ended") / wait), F.floor(F.col("ended") / wait) + 1)))
    followed = probes.join(starts, [*keys, "project_id", "bucket"]).where(f"s > ended AND s <= ended + {wait}").select("id").distinct()
    return ended.join(followed, "id", "left_anti")


def nth_occurrence(commands: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Give the n-th occurrence of a command the n-th stored time of that command, where there is one."""
    w = Window.partitionBy(*keys, "command")
    a = commands.withColumn("__n", F.row_number().over(w.orderBy("position")))
    b = stored.select(*keys, "command", F.col("timestamp").alias("__stored")).withColumn("__n", F.row_number().over(w.orderBy("__stored")))
    return a.join(b, [*keys, "command", "__n"], "left").withColumn("timestamp", F.coalesce("__stored", "timestamp")).withColumn("locked", F.col("__stored").isNotNull()).drop("__n", "__stored")


def compare_days(today: DataFrame, before: DataFrame, on: list[str], value: str) -> DataFrame:
    """Both days' values and their signed difference, for what either has."""
    b = before.select(*on, F.col(value).alias("previous"))
    return today.select(*on, F.col(value).alias("current")).join(b, on, "full").fillna(0, ["current", "previous"]).withColumn("difference", F.col("current") - F.col("previous"))
