"""Reports that combine sessions, commands and commits: achievements, chronicles, headers, moods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import time as C
from tidemark.functions.redact import is_blacklisted, redact
from tidemark.operators.insights import focus_score, time_of_day_split
from tidemark.operators.joins import display_name, with_project, with_tags

# Fixed values, needed for equal results.
ACTIVITIES = {
    "Debugging/Running Tests": ["test", "pytest", "unittest", "cargo test", "npm test", "go test"],
    "Compiling/Building Code": ["build", "compile", "cargo build", "go build", "npm run build", "make"],
    "Deep Focused Editing / Coding": ["vim", "nvim", "nano", "code", "emacs"],
    "Wrangling Containers/Infrastructure": ["docker", "kubectl", "aws", "terraform", "gcloud"],
    "Committing and Pushing Changes": ["git commit", "git push", "git add"],
}
DAY_PARTS = [(5, "Late-Night/Goblin Mode"), (8, "Early Bird Coding"), (12, "Morning Session"), (14, "Midday Session"), (17, "Afternoon Session"), (21, "Evening Session")]
BUGS = [
    (r"amend|force|reset|revert", "Detached HEAD or Git Desynchronization"),
    (r"git add \.|git add -a|git add --all", "Accidentally Committed Secrets / Build Artifacts"),
    (r"deselect|--ignore|--skip|(?=.* -k )(?=.*not)|skipif|disabled_tests|disable_tests", "Silently Bypassed Test / Mock Leak"),
    (r"test|jest", "Mock Leak or Commented-Out Assertion"),
    (r"docker", "Docker Port Bind Collision / Zombie Container"),
]
# End of fixed values.


def emotion(kills: Column, clusters: Column, errors: Column, message: Column) -> Column:
    """The mood of a commit; a message about a fix, bug, crash or issue decides by itself."""
    patch = F.lower(message).rlike("fix|bug|crash|issue")
    ladder = [
        (patch, "EXHAUSTION / PATCHING SHIT"), (kills >= 2, "FURY / PROCESS WHACK-A-MOLE"), ((clusters >= 1) & (kills == 0), "RECOMPILING IN A PANIC"),
        ((kills >= 1) & (clusters >= 1), "BUILD BROKE & PROCESSES DIED"), (errors > 3, "RAGE & DESPAIR"), (errors >= 1, "FRUSTRATION / WORKAROUND"),
    ]
    return X.one_of(message, ladder, "TRIUMPH / SMOOTH SAILING")


def commit_moods(commits: DataFrame, failures: DataFrame, clusters: DataFrame, keys: list[str], lookback: int) -> DataFrame:
    """Each commit with its failures before (hash, failures, kills), rebuild clusters (start) within ``lookback``, and mood."""
    near = commits.withColumn("bucket", F.explode(F.array(F.floor(F.col("timestamp") / lookback), F.floor(F.col("timestamp") / lookback) - 1)))
    builds = clusters.select(*keys, "start", F.floor(F.col("start") / lookback).alias("bucket"))
    count = near.join(builds, [*keys, "bucket"]).where(f"start >= timestamp - {lookback} AND start < timestamp").groupBy("hash").agg(F.count("*").alias("clusters"))
    rows = commits.join(failures.select("hash", "failures", "kills"), "hash", "left").join(count, "hash", "left").fillna(0, ["failures", "kills", "clusters"])
    return rows.withColumn("emotion", emotion(F.col("kills"), F.col("clusters"), F.col("failures"), F.col("message")))


def likely_bugs(chaotic: DataFrame, commands: DataFrame) -> DataFrame:
    """(id, bug): the first kind of trouble that some command of a chaotic session points to."""
    own = commands.join(chaotic.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    low = F.lower("command")
    per = own.groupBy(F.col("session_id").alias("id")).agg(*[F.bool_or(low.rlike(p)).alias(f"b{i}") for i, (p, _) in enumerate(BUGS)])
    return per.select("id", X.one_of(F.col("id"), [(F.col(f"b{i}"), name) for i, (_, name) in enumerate(BUGS)], "Sleep-Deprived Off-by-One or Typo").alias("bug"))


def chronicle(sessions: DataFrame, commands: DataFrame, projects: DataFrame, most: int = 15) -> DataFrame:
    """One row per session: part of the day, activities, and its first ``most`` redacted commands that are no noise.

    One blacklisted command among all that are no noise hides the commands.
    """
    low, work = F.lower("command"), ~X.is_noise(F.col("command"))
    flags = [F.bool_or(low.rlike("|".join(words))).alias(f"a{i}") for i, words in enumerate(ACTIVITIES.values())]
    line = F.concat(redact(F.col("command")), F.when(F.col("exit_code") != 0, F.concat(F.lit(" (Exit Code "), F.col("exit_code").cast("string"), F.lit(")"))).otherwise(""))
    per = commands.groupBy(F.col("session_id").alias("id")).agg(
        *flags, F.coalesce(F.bool_or(work & is_blacklisted(F.col("command"))), F.lit(False)).alias("hidden"),
        F.array_sort(F.collect_list(F.when(work, F.struct("timestamp", F.col("id").alias("c"), line.alias("line"))))).alias("lines"),
    )
    shown = F.when(F.col("hidden"), F.array(F.lit("[REDACTED: Security/Authentication Operations]"))).otherwise(F.transform(F.slice("lines", 1, most), lambda x: x["line"]))
    named = F.array_compact(F.array(*[F.when(F.col(f"a{i}"), name) for i, name in enumerate(ACTIVITIES)]))
    hour = C.hour(F.col("start_time"))
    part = X.one_of(hour, [(hour < to, name) for to, name in DAY_PARTS], "Night Owl Session")
    rows = with_project(sessions, projects).join(per, "id")
    activity = F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise("General Development")
    return rows.select("id", part.alias("context"), display_name(F.col("project_name")).alias("project"), activity.alias("activity"), shown.alias("commands"))


def main_achievements(sessions: DataFrame, commands: DataFrame, linked: DataFrame) -> DataFrame:
    """Per project: its newest session's newest commit; else the longest work command of its newest session with one; else its newest command."""
    order = F.struct(F.col("start_time"), F.col("session_id"))
    own = sessions.select(F.col("id").alias("session_id"), "project_id", "start_time")
    commit = linked.join(own, "session_id").groupBy("project_id").agg(F.max_by("message", F.struct("start_time", "session_id", "t", "hash")).alias("commit"))
    rows = commands.drop("project_id").join(own, "session_id")
    work = ~X.is_noise(F.col("command"))
    best = rows.groupBy("project_id").agg(
        F.max_by("command", F.when(work, F.struct(order, F.length("command"), -F.col("timestamp"), -F.col("id")))).alias("longest"), F.count_if(work).alias("works"),
        F.max_by("command", F.struct(order, "timestamp", "id")).alias("newest"),
    )
    joined = best.join(commit.withColumnRenamed("project_id", "p"), F.col("project_id").eqNullSafe(F.col("p")), "left")
    return joined.select("project_id", F.coalesce(X.clean_commit(F.col("commit")), F.when(F.col("works") > 0, F.col("longest")), F.col("newest")).alias("achievement"))


def header(sessions: DataFrame, linked: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: time, projects (none counts as one), commits, focus, and the part of the day with most time; the later one wins ties."""
    per = sessions.groupBy(*keys).agg(F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("seconds"), F.size(F.collect_set(F.coalesce(F.col("project_id").cast("string"), F.lit("none")))).alias("projects"))
    commits = linked.groupBy(*keys).agg(F.count("*").alias("commits"))
    parts = time_of_day_split(sessions, keys)
    m, a, e = F.col("morning"), F.col("afternoon"), F.col("evening")
    peak = F.when((a >= m) & (a >= e), "afternoon").when((e >= m) & (e >= a), "evening").otherwise("morning")
    return per.join(commits, keys, "left").fillna(0, ["commits"]).join(focus_score(sessions, keys), keys).join(parts.select(*keys, peak.alias("peak")), keys)


def day_report(sessions: DataFrame, memories: DataFrame, projects: DataFrame, today: Column) -> DataFrame:
    """Per display name on a day: time, difference to the day before, and distinct memories in first-seen order; Other last."""
    day = C.day(F.col("start_time"))
    named = with_project(sessions, projects).withColumn("day", day).withColumn("project", display_name(F.col("project_name"))).where(F.col("day").isin(today, F.date_sub(today, 1)))
    now = F.col("day") == today
    time = named.groupBy("project").agg(F.coalesce(F.sum(F.when(now, F.col("duration_seconds"))), F.lit(0)).alias("seconds"), F.coalesce(F.sum(F.when(~now, F.col("duration_seconds"))), F.lit(0)).alias("before"), F.count_if(now).alias("n"))
    seen = named.where(now).join(memories.withColumnRenamed("session_id", "id"), "id").groupBy("project", "memory").agg(F.min(F.struct("start_time", "id")).alias("first"))
    texts = seen.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "memory"))), lambda x: x["memory"]).alias("memories"))
    rows = time.where("n > 0").join(texts, "project", "left").withColumn("difference", F.col("seconds") - F.col("before"))
    return rows.drop("n").orderBy(F.col("project") == "Other", F.lower("project"))


def recent_sessions(sessions: DataFrame, commands: DataFrame, n: int = 20, cut: int = 40) -> DataFrame:
    """The newest ``n`` sessions with their first command, cut to ``cut`` characters."""
    first = commands.groupBy(F.col("session_id").alias("id")).agg(F.min_by("command", F.struct("timestamp", F.col("id").alias("c"))).alias("first"))
    short = F.when(F.length("first") > cut, F.concat(F.substring("first", 1, cut - 3), F.lit("..."))).otherwise(F.col("first"))
    return sessions.orderBy(F.col("end_time").desc_nulls_last(), F.col("start_time").desc(), F.col("id").desc()).limit(n).join(first, "id", "left").withColumn("first", short)


def latest_session(sessions: DataFrame) -> DataFrame:
    """The session that ended last, of equals the one that started last; open ones come after all others."""
    return sessions.orderBy(F.col("end_time").desc_nulls_last(), F.col("start_time").desc(), F.col("id").desc()).limit(1)


def without_legacy(sessions: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """Sessions that are not legacy (null counts as not); with ``commands``, only those that also have one that is not."""
    own = ~F.coalesce("is_legacy", F.lit(False))
    kept = sessions.where(own)
    return kept if commands is None else kept.join(commands.where(own).select(F.col("session_id").alias("id")).distinct(), "id", "left_semi")


def tag_listing(sessions: DataFrame, commands: DataFrame, tags: DataFrame, projects: DataFrame, tag: str, limit: int = 20, cut: int = 40) -> DataFrame:
    """The newest sessions with a tag: start, display name, time in words, and summary or first command, cut; an unknown tag is an error."""
    tag = tag.strip().lower()
    if tag not in X.TAGS:
        raise ValueError(f"unknown tag {tag!r}; known: {', '.join(X.TAGS)}")
    newest = with_tags(sessions, tags, [tag]).orderBy(F.col("start_time").desc(), F.col("id").desc()).limit(limit)
    first = commands.groupBy(F.col("session_id").alias("id")).agg(F.min_by("command", F.struct("timestamp", F.col("id").alias("c"))).alias("first"))
    said = F.nullif(F.trim(F.replace("ai_summary", F.lit("\n"), F.lit(" "))), F.lit("")) if "ai_summary" in sessions.columns else F.lit(None)
    text = F.coalesce(said, F.col("first"), F.lit(""))
    short = F.when(F.length(text) > cut, F.concat(F.substring(text, 1, cut - 3), F.lit("..."))).otherwise(text)
    rows = with_project(newest, projects).join(first, "id", "left")
    when = F.date_format(C.safe_timestamp(F.col("start_time")), "yyyy-MM-dd HH:mm")
    return rows.select("id", when.alias("start"), display_name(F.col("project_name")).alias("project"), C.format_duration(F.col("duration_seconds")).alias("duration"), short.alias("summary")).orderBy(F.col("start").desc(), F.col("id").desc())


def detailed_rows(commands: DataFrame, linked: DataFrame) -> DataFrame:
    """Each session's commands and commits as rows in order: clock, text, and exit code with recovery source or the commit's first 7 characters."""
    source = F.col("recovery_source") if "recovery_source" in commands.columns else F.lit(None).cast("string")
    code = F.when(F.col("exit_code") != 0, F.concat(F.lit("exit "), F.col("exit_code").cast("string")))
    a = commands.select("session_id", F.lit("command").alias("kind"), F.col("timestamp").alias("at"), F.col("command").alias("text"), F.concat_ws(", ", code, source).alias("note"), F.col("id").cast("string").alias("ref"))
    b = linked.select("session_id", F.lit("commit"), "t", "message", F.substring("hash", 1, 7), "hash")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "kind", "ref"))
    return a.union(b).withColumn("clock", C.format_clock(F.col("at"))).withColumn("place", place)


def commit_digest(linked: DataFrame, by: list[str], n: int = 20) -> DataFrame:
    """The ``n`` commits of each group that differ but for case: feat, fix and refactor first, then by time."""
    once = linked.groupBy(*by, F.lower("message").alias("low")).agg(F.min_by("message", F.struct("t", "hash")).alias("message"), F.min(F.struct("t", "hash")).alias("at"))
    w = Window.partitionBy(*by).orderBy(X.commit_priority(F.col("low")), "at")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*by, "message", "rank")
