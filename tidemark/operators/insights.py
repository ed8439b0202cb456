"""Insights, statistics and reports over sessions and commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import time as C
from tidemark.operators.joins import display_name, with_project
from tidemark.operators.sessions import first_seen_order, last_commands_before_absence, streaks
from tidemark.schemas import NO_PROJECT

# Fixed values, needed for equal results.
TOOLS = ["docker-compose", "docker", "podman", "git", "gh", "npm", "yarn", "pnpm", "npx", "python3", "python", "pytest", "poetry", "pip", "sqlite3", "psql", "mysql", "mongo", "prisma", "sql", "make", "cmake", "gcc", "clang", "cargo", "rustc", "go", "grep", "awk", "sed"]
DAILY_CLASSES = {
    "Docker Demolitionist": ["docker", "docker-compose", "podman"],
    "Version Control Paladin": ["git", "gh"],
    "Regex Sorcerer": ["grep", "awk", "sed"],
    "Python Pyromancer": ["python", "python3", "pytest", "poetry"],
    "Package Potion Master": ["pip"],
    "Frontend Bard": ["npm", "yarn", "pnpm", "npx"],
    "Database Necromancer": ["sqlite3", "psql", "mysql", "mongo", "prisma", "sql"],
    "Systems Ranger": ["make", "cmake", "gcc", "clang"],
    "Rust Ranger": ["cargo", "rustc"],
    "Go Gladiator": ["go"],
    "Kubernetes Knight": ["kubectl"],
    "Vim Vampire": ["vim"],
    "Neovim Ninja": ["nvim"],
    "NodeJS Necromancer": ["node"],
    "Directory Druid": ["ls"],
    "Pathfinder Rogue": ["cd"],
}
CLASSES = {
    "Regex Sorcerer": ["grep", "awk", "sed"],
    "Docker Demolitionist": ["docker", "docker-compose", "podman"],
    "Git Paladin": ["git", "gh"],
    "Frontend Bard": ["npm", "yarn", "pnpm", "npx"],
    "Python Alchemist": ["python", "python3", "pytest", "poetry", "pip"],
    "Database Necromancer": ["sqlite3", "psql", "mysql", "mongo", "prisma", "sql"],
    "Systems Ranger": ["make", "cmake", "gcc", "clang", "cargo", "rustc", "go"],
}
TIERS = [(50, "Dracula Level Vampire"), (20, "Late-Night Bat"), (5, "Midnight Caffeinator")]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# End of fixed values.


def projects_with_stats(projects: DataFrame, sessions: DataFrame) -> DataFrame:
    per = sessions.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("session_count"), F.sum("duration_seconds").alias("total_time"))
    return projects.join(per, "id", "left").fillna(0, ["session_count", "total_time"])


def project_breakdown(sessions: DataFrame, commands: DataFrame, projects: DataFrame, by_id: bool = False) -> DataFrame:
    """Sessions, commands, time and first and last activity per display name, or with ``by_id`` per project.

    Rows without a project are Other; if one of its bounds is null, both take
    the times of its activity.
    """
    s = sessions.groupBy("project_id").agg(F.count("*").alias("sessions"), F.sum("duration_seconds").alias("duration"), F.min("start_time").alias("s0"), F.max(F.coalesce("end_time", "start_time")).alias("s1"))
    c = commands.groupBy(F.col("project_id").alias("of_commands")).agg(F.count("*").alias("commands"), F.min("timestamp").alias("c0"), F.max("timestamp").alias("c1"))
    both = s.join(c, F.col("project_id").eqNullSafe(F.col("of_commands")), "full").select(F.coalesce("project_id", "of_commands").alias("project_id"), "sessions", "commands", "duration", "s0", "s1", "c0", "c1")
    p = projects.select(F.col("id").alias("project_id"), "name", "first_seen", "last_seen")
    named = p.join(both, "project_id", "full")
    named = named.withColumn("name", display_name(F.col("name"))).fillna(0, ["sessions", "commands", "duration"])
    group = ["project_id", "name"] if by_id else ["name"]
    out = named.groupBy(*group).agg(
        F.sum("sessions").alias("sessions"), F.sum("commands").alias("commands"), F.sum("duration").alias("duration"),
        F.min(F.coalesce("first_seen", F.least("s0", "c0"))).alias("first_seen"), F.max(F.coalesce("last_seen", F.greatest("s1", "c1"))).alias("last_seen"),
    )
    return out.where("sessions > 0 OR commands > 0 OR duration > 0")


def activity_window(sessions: DataFrame, commands: DataFrame) -> DataFrame:
    """One row: numbers of sessions and commands, time, and first and last valid moment."""
    times = sessions.select(F.col("start_time").alias("t")).unionAll(sessions.select("end_time")).unionAll(commands.select("timestamp"))
    bounds = times.where(C.safe_timestamp(F.col("t")).isNotNull()).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    s = sessions.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("duration"))
    return s.crossJoin(commands.agg(F.count("*").alias("commands"))).crossJoin(bounds)


def time_distribution(sessions: DataFrame, projects: DataFrame, keys: list[str]) -> DataFrame:
    """Each project's share of the time, in percent; nothing where there is no time."""
    named = with_project(sessions, projects).withColumn("name", F.coalesce("project_name", F.lit(NO_PROJECT)))
    per = named.groupBy(*keys, "name").agg(F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("duration"))
    total = F.sum("duration").over(Window.partitionBy(*keys))
    return per.withColumn("total", total).where("total > 0").select(*keys, "name", "duration", (F.col("duration") / F.col("total") * 100).alias("percent"))


def time_of_day_split(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds in the morning, afternoon and evening, by each session's midpoint."""
    middle = F.floor((F.col("start_time") + F.coalesce("end_time", "start_time")) / 2)
    part = C.time_of_day(middle)
    d = F.coalesce("duration_seconds", F.lit(0))
    return sessions.withColumn("part", part).groupBy(*keys).agg(*[F.sum(F.when(F.col("part") == p, d).otherwise(0)).alias(p) for p in ("morning", "afternoon", "evening")])


def day_of_week_split(sessions: DataFrame, keys: list[str]) -> DataFrame:
    name = F.date_format(C.safe_timestamp(F.col("start_time")), "EEEE")
    d = F.coalesce("duration_seconds", F.lit(0))
    return sessions.withColumn("weekday", name).groupBy(*keys).agg(*[F.sum(F.when(F.col("weekday") == w, d).otherwise(0)).alias(w.lower()) for w in WEEKDAYS])


def focus_score(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """6, less 1.5 for each project a day over one, plus up to 4 for long sessions; 0 to 10. No project is a project."""
    per_day = sessions.groupBy(*keys, C.day(F.col("start_time")).alias("day")).agg(
        F.size(F.collect_set(F.coalesce(F.col("project_id").cast("string"), F.lit("none")))).alias("n"), F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("d"), F.count("*").alias("s")
    )
    total = per_day.groupBy(*keys).agg(F.avg("n").alias("per_day"), (F.sum("d") / F.sum("s") / 60).alias("minutes"))
    score = 6.0 - F.greatest(F.lit(0.0), (F.col("per_day") - 1) * 1.5) + F.least(F.lit(4.0), F.col("minutes") / 20)
    return total.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)).alias("focus"))


def patterns(sessions: DataFrame, commands: DataFrame, keys: list[str]) -> DataFrame:
    """(rule, subject, value): busiest and least busy day, mean time a day, top project and top tool."""
    per_day = sessions.groupBy(*keys, C.day(F.col("start_time")).alias("day")).agg(F.sum("duration_seconds").alias("d"))
    days = per_day.groupBy(*keys).agg(F.max_by("day", F.struct("d", "day")).alias("busiest"), F.max("d").alias("most"), F.min_by("day", F.struct("d", "day")).alias("quietest"), F.min("d").alias("least"), F.avg("d").alias("mean"))
    rows = F.array(
        F.struct(F.lit("busiest_day").alias("rule"), F.col("busiest").cast("string").alias("subject"), F.col("most").cast("double").alias("value")),
        F.struct(F.lit("quietest_day").alias("rule"), F.col("quietest").cast("string").alias("subject"), F.col("least").cast("double").alias("value")),
        F.struct(F.lit("daily_mean").alias("rule"), F.lit(None).cast("string").alias("subject"), F.col("mean").alias("value")),
    )
    of_days = days.select(*keys, F.inline(rows))
    project = sessions.groupBy(*keys, F.col("project_id").cast("string").alias("p")).agg(F.sum("duration_seconds").alias("d")).groupBy(*keys).agg(F.max_by("p", F.struct("d", "p")).alias("subject"), F.max("d").cast("double").alias("value"))
    tool = top_per_group(commands.withColumn("tool", X.classify_command(F.col("command"))), keys, "tool", 1)
    return of_days.unionByName(project.select(*keys, F.lit("top_project").alias("rule"), "subject", "value")).unionByName(tool.select(*keys, F.lit("top_tool").alias("rule"), F.col("tool").alias("subject"), F.col("n").cast("double").alias("value")))


def usage_anomalies(commands: DataFrame, keys: list[str], tools: list[str], split: int, high: float = 1.5, low: float = 0.7) -> DataFrame:
    """Tools whose number of commands since ``split`` is at least ``high`` or at most ``low`` times that before it."""
    tool = commands.withColumn("tool", X.classify_command(F.col("command"))).where(F.col("tool").isin(tools))
    per = tool.groupBy(*keys, "tool").agg(F.count_if(F.col("timestamp") >= split).alias("now"), F.count_if(F.col("timestamp") < split).alias("before"))
    ratio = per.where("before > 0").withColumn("ratio", F.col("now") / F.col("before"))
    return ratio.where((F.col("ratio") >= high) | (F.col("ratio") <= low))


def base_tool(command: Column) -> Column:
    """The first known tool among the words; else grep in a pipe; else the file name of the first word."""
    words = F.split(F.lower(F.trim(command)), r"\s+")
    out = F.when(F.array_contains(words, TOOLS[0]), TOOLS[0])
    for tool in TOOLS[1:]:
        out = out.when(F.array_contains(words, tool), tool)
    return out.when(command.contains("|"), "grep").otherwise(F.lower(F.element_at(F.split(X.first_word(command), "/"), -1)))


def daily_class(commands: DataFrame, keys: list[str]) -> DataFrame:
    """A class from the most used tool (the first seen wins ties) and a level from how often it was used."""
    per = commands.where(F.trim("command") != "").groupBy(*keys, base_tool(F.col("command")).alias("tool")).agg(F.count("*").alias("n"), F.min(F.struct("timestamp", "id")).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first")
    top = per.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    name = F.concat(F.lit("Scripting Shaman ("), F.col("tool"), F.lit(")"))
    for title, tools in DAILY_CLASSES.items():
        name = F.when(F.col("tool").isin(tools), title).otherwise(name)
    level = F.least(F.lit(100), F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    return top.select(*keys, "tool", "n", F.concat(F.lit("Level "), level.cast("string"), F.lit(" "), name).alias("class"))


def class_counts(commands: DataFrame, keys: list[str]) -> DataFrame:
    """How many commands fall into each class (the first that fits), and the largest; the earlier one wins ties."""
    words = F.split(F.lower(F.trim("command")), r"\s+")
    kind = F.when(F.col("command").contains("|"), "Regex Sorcerer")
    for title, tools in CLASSES.items():
        kind = kind.when(F.arrays_overlap(words, F.array(*map(F.lit, tools))), title)
    per = commands.withColumn("kind", kind).groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col("kind") == t).alias(t) for t in CLASSES])
    most = F.greatest(*[F.col(t) for t in CLASSES])
    name = F.when(most == 0, "Terminal Nomad")
    for t in CLASSES:
        name = name.when(F.col(t) == most, t)
    return per.select(*keys, "total", most.alias("most"), name.alias("class_name"), *[F.col(t).alias(t.lower().replace(" ", "_")) for t in CLASSES])


def late_night_index(commands: DataFrame, commits: DataFrame, keys: list[str]) -> DataFrame:
    """Share of commands and of distinct commits from 0 to 5 in the morning, and the tier."""
    night = C.hour(F.col("timestamp")) < 5
    c = commands.groupBy(*keys).agg(F.count("*").alias("commands"), F.count_if(night).alias("late_commands"))
    m = commits.dropDuplicates([*keys, "hash"]).groupBy(*keys).agg(F.count("*").alias("commits"), F.count_if(night).alias("late_commits"))
    both = c.join(m, keys, "full").fillna(0, ["commands", "late_commands", "commits", "late_commits"])
    pct = F.col("late_commands") / F.greatest("commands", F.lit(1)) * 100
    return both.withColumn("percent", pct).withColumn("tier", X.one_of(F.col("percent"), [(F.col("percent") >= at, name) for at, name in TIERS], "Solar Coder"))


def chaotic_sessions(sessions: DataFrame, commands: DataFrame, desperate: str = r"(?i)kill -9|rm -rf|reset --hard|--force|git push -f", many: int = 10, failures: int = 3) -> DataFrame:
    """Late sessions that are not legacy, with many commands, many failures (a null exit code is one) or desperate words."""
    per = commands.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("commands"), F.count_if(F.coalesce(F.col("exit_code") != 0, F.lit(True))).alias("failures"), F.bool_or(F.col("command").rlike(desperate)).alias("desperate"))
    late = sessions.where(~F.col("is_legacy") & C.late_night(F.col("start_time")))
    return late.join(per, "id").where((F.col("commands") >= many) | (F.col("failures") >= failures) | F.col("desperate"))


def language_share(commands: DataFrame, languages: DataFrame) -> DataFrame:
    """Share of each language; ``languages`` (project_id, language) comes before the command's own tool."""
    of_tool = {"Python": r"^(python3?|pip3?|pytest|poetry)\b", "JavaScript": r"^(npm|yarn|pnpm|npx|node)\b", "Rust": r"^(cargo|rustc)\b", "Go": r"^go\b", "Java": r"^(mvn|gradle|java)\b", "C/C++": r"^(gcc|g\+\+|make|cmake|clang)\b"}
    guess = F.lit(None).cast("string")
    for name, pattern in of_tool.items():
        guess = F.when(F.trim("command").rlike(pattern), name).otherwise(guess)
    named = commands.join(languages, "project_id", "left").withColumn("language", F.coalesce("language", guess)).where("language IS NOT NULL")
    per = named.groupBy("language").agg(F.count("*").alias("n"))
    return per.withColumn("percent", F.col("n") * 100 / F.sum("n").over(Window.partitionBy()))


def project_languages(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """files: project_id, relpath; manifests: relpath, language, priority. The language of the first manifest found."""
    named = files.join(manifests, "relpath").groupBy("project_id").agg(F.min_by("language", "priority").alias("named"))
    by_end = X.one_of(F.col("relpath"), [(F.col("relpath").rlike(r"\.(csproj|sln)$"), "C#"), (F.col("relpath") == "Makefile", "C/C++")], "")
    other = files.withColumn("other", F.nullif(by_end, F.lit(""))).where("other IS NOT NULL").groupBy("project_id").agg(F.min("other").alias("other"))
    return named.join(other, "project_id", "full").select("project_id", F.coalesce("named", "other").alias("language"))


def peak_hours(commands: DataFrame, keys: list[str]) -> DataFrame:
    per = commands.groupBy(*keys, C.hour(F.col("timestamp")).alias("hour")).agg(F.count("*").alias("n"))
    return C.fill_hours(per, keys)


def heat_levels(per_day: DataFrame) -> DataFrame:
    n = F.col("n")
    return per_day.withColumn("level", F.when(n == 0, 0).when(n < 5, 1).when(n < 20, 2).otherwise(3))


def daily_totals(sessions: DataFrame, width: int = 40) -> DataFrame:
    """Seconds a day without legacy sessions, and a bar's length relative to the largest."""
    per = sessions.where(~F.col("is_legacy")).groupBy(C.day(F.col("start_time")).alias("day")).agg(F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("seconds"))
    most = F.max("seconds").over(Window.partitionBy())
    return per.withColumn("bar", F.when(most > 0, F.round(F.col("seconds") / most * width)).otherwise(0).cast("int"))


def punch_card(commands: DataFrame, keys: list[str]) -> DataFrame:
    """Commands by weekday and hour, with levels at 0, 10 and 30."""
    per = commands.groupBy(*keys, C.weekday(F.col("timestamp")).alias("weekday"), C.hour(F.col("timestamp")).alias("hour")).agg(F.count("*").alias("n"))
    return per.withColumn("level", F.when(F.col("n") == 0, 0).when(F.col("n") <= 10, 1).when(F.col("n") <= 30, 2).otherwise(3))


def top_per_group(rows: DataFrame, by: list[str], value: str, n: int, order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """The ``n`` most frequent values of each group; of equals, that seen first."""
    per = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("__first"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "__first")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("__first")


def session_tags(commands: DataFrame, linked_commits: DataFrame) -> DataFrame:
    """(session_id, tags): tags of its commands and its commits, in a fixed order."""
    flags = lambda of_commits, c: [F.bool_or(x).alias(t) for t, x in X.tag_flags(F.col(c), of_commits).items()]
    a = commands.groupBy("session_id").agg(*flags(False, "command"))
    b = linked_commits.groupBy("session_id").agg(*flags(True, "message"))
    both = a.unionByName(b).groupBy("session_id").agg(*[F.bool_or(t).alias(t) for t in X.TAGS])
    return both.select("session_id", F.array_compact(F.array(*[F.when(F.col(t), t) for t in X.TAGS])).alias("tags"))


def tag_summary(sessions: DataFrame, tags: DataFrame) -> DataFrame:
    """Sessions and time per tag; each of the five tags has a row."""
    used = tags.select(F.col("session_id").alias("id"), F.explode("tags").alias("tag")).join(sessions, "id").groupBy("tag").agg(F.count("*").alias("sessions"), F.sum("duration_seconds").alias("duration"))
    every = sessions.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, X.TAGS))).alias("tag"))
    return every.join(used, "tag", "left").fillna(0, ["sessions", "duration"])


def week_report(sessions: DataFrame, commands: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project: sessions, time, time by weekday, and its five most frequent command classes."""
    days = [w[:3] for w in WEEKDAYS]
    day = C.weekday(F.col("start_time"))
    per = sessions.groupBy("project_id").agg(F.count("*").alias("sessions"), F.sum("duration_seconds").alias("duration"), *[F.sum(F.when(day == d, F.col("duration_seconds")).otherwise(0)).alias(d.lower()) for d in days])
    top = top_per_group(commands.withColumn("class", X.classify_command(F.col("command"))), ["project_id"], "class", 5)
    top = top.groupBy(F.col("project_id").alias("pid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "class"))), lambda x: x["class"]).alias("top_classes"))
    return with_project(per.join(top, F.col("project_id").eqNullSafe(F.col("pid")), "left").drop("pid"), projects).withColumn("project_name", display_name(F.col("project_name")))


def month_report(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project: days worked, time, and time per day worked."""
    per = sessions.groupBy("project_id").agg(F.countDistinct(C.day(F.col("start_time"))).alias("days"), F.sum("duration_seconds").alias("duration"))
    return with_project(per, projects).select(display_name(F.col("project_name")).alias("name"), "days", "duration", (F.col("duration") / F.col("days")).alias("per_day"))


def session_memory(commands: DataFrame, linked_commits: DataFrame) -> DataFrame:
    """What a session was about: its newest commit, else its longest command that is no noise, else its longest."""
    noise = X.is_noise(F.col("command"))
    longest = F.struct(F.length("command"), -F.col("timestamp"), -F.col("id"))
    c = commands.groupBy("session_id").agg(F.max_by("command", F.when(~noise, longest)).alias("work"), F.count_if(~noise).alias("works"), F.max_by("command", longest).alias("any"))
    m = linked_commits.groupBy("session_id").agg(F.max_by("message", F.struct("t", "hash")).alias("message"))
    return c.join(m, "session_id", "left").select("session_id", F.coalesce(X.clean_commit(F.col("message")), F.when(F.col("works") > 0, F.col("work")), F.col("any")).alias("memory"))


def session_lines(sessions: DataFrame, commands: DataFrame, linked_commits: DataFrame) -> DataFrame:
    """(id, line): the summary's line, else the first commit, the longest command that is no noise, the last command, or a fixed phrase.

    Of equally long commands the first counts; null and empty summaries count as none.
    """
    noise, at = X.is_noise(F.col("command")), F.struct("timestamp", "id")
    work = F.when(~noise, F.struct(F.length("command"), -F.col("timestamp"), -F.col("id")))
    c = commands.groupBy(F.col("session_id").alias("id")).agg(F.max_by("command", work).alias("work"), F.count_if(~noise).alias("works"), F.max_by("command", at).alias("last"))
    m = linked_commits.groupBy(F.col("session_id").alias("id")).agg(F.min_by("message", F.struct("t", "hash")).alias("message"))
    told = F.when(F.col("ai_summary") != "", X.summary_line(F.col("ai_summary")))
    commit = F.coalesce(F.nullif(X.clean_commit(F.col("message")), F.lit("")), "message")
    command = X.command_memory(F.when(F.col("works") > 0, F.col("work")).otherwise(F.col("last")))
    return sessions.join(c, "id", "left").join(m, "id", "left").select("id", F.coalesce(told, X.strip_ansi(commit), X.strip_ansi(command), F.lit(X.NO_MEMORY)).alias("line"))


def project_report(sessions: DataFrame, memories: DataFrame) -> DataFrame:
    """Per project and day, its distinct memories in first-seen order."""
    rows = sessions.join(memories.withColumnRenamed("session_id", "id"), "id").withColumn("day", C.day(F.col("start_time")))
    return first_seen_order(rows, ["project_id", "day"], F.col("memory"), F.struct("start_time", "id"))


def period_telemetry(sessions: DataFrame, commands: DataFrame, commits: DataFrame, keys: list[str]) -> DataFrame:
    """One wide row per key: hours, late share, success share (a null exit code is a success), commits, and an archetype."""
    s = sessions.groupBy(*keys).agg((F.coalesce(F.sum("duration_seconds"), F.lit(0)) / 3600).alias("hours"), F.count("*").alias("sessions"), F.countDistinct("project_id").alias("projects"))
    c = commands.groupBy(*keys).agg(F.count("*").alias("commands"), F.count_if(C.late_night(F.col("timestamp"))).alias("late"), F.count_if(F.coalesce(F.col("exit_code") == 0, F.lit(True))).alias("ok"), F.count_if(F.col("command").contains("--amend")).alias("amends"))
    m = commits.groupBy(*keys).agg(F.countDistinct("hash").alias("commits"))
    wide = s.join(c, keys, "left").join(m, keys, "left").fillna(0, ["commands", "late", "ok", "amends", "commits"])
    share = lambda a: F.col(a) * 100 / F.greatest("commands", F.lit(1))
    wide = wide.withColumn("late_percent", share("late")).withColumn("success_percent", share("ok"))
    ladder = [(F.col("late_percent") >= 30, "Midnight Architect"), (F.col("commits") >= 50, "Commit Machine"), (F.col("success_percent") < 70, "Bug Hunter"), (F.col("projects") >= 4, "Context Juggler")]
    return wide.withColumn("archetype", X.one_of(F.col("late_percent"), ladder, "Steady Builder"))


def highlight_days(sessions: DataFrame, commands: DataFrame, long_session: int = 8 * 3600) -> DataFrame:
    """Days that tie for most commands, and days with a session of eight hours or more."""
    per = commands.groupBy(C.day(F.col("timestamp")).alias("day")).agg(F.count("*").alias("n"))
    most = per.withColumn("m", F.max("n").over(Window.partitionBy())).where("n = m AND n > 0").select("day")
    return most.union(sessions.where(F.col("duration_seconds") >= long_session).select(C.day(F.col("start_time")))).distinct()


def dashboard_days(sessions: DataFrame, commands: DataFrame, today: str, days: int = 30, long_session: int = 8 * 3600) -> DataFrame:
    """(day, n, level, highlight) for the ``days`` days up to ``today``, those without activity too.

    A session's commands count on the day on which it began; legacy sessions do
    not count. A day is highlighted if none in the window has more commands and
    it has some, or if a session of ``long_session`` seconds or more began on it.
    """
    last = F.lit(today).cast("date")
    own = sessions.where(~F.coalesce("is_legacy", F.lit(False))).select("id", C.day(F.col("start_time")).alias("day"), F.coalesce(F.col("duration_seconds") >= long_session, F.lit(False)).alias("long"))
    own = own.where((F.col("day") <= last) & (F.col("day") > F.date_sub(last, days)))
    sizes = commands.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"))
    per = own.join(sizes, "id", "left").groupBy("day").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.bool_or("long").alias("long"))
    spine = sessions.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    rows = spine.join(per, "day", "left").fillna(0, ["n"]).withColumn("best", F.max("n").over(Window.partitionBy()))  # ``days`` rows
    return heat_levels(rows).select("day", "n", "level", (((F.col("n") > 0) & (F.col("n") == F.col("best"))) | F.coalesce("long", F.lit(False))).alias("highlight"))


def edited_files(commands: DataFrame) -> DataFrame:
    """How often each file was opened in an editor; its layer; flags and dots do not count."""
    editor = commands.where(X.classify_command(F.col("command")) == "vim")
    every = F.split(F.trim("command"), r"\s+")
    words = editor.select(F.explode(F.slice(every, 2, F.size(every))).alias("w")).where(~F.col("w").startswith("-"))
    name = words.select(F.element_at(F.split("w", "/"), -1).alias("file")).where(~F.col("file").isin("", ".", ".."))
    return name.groupBy("file").agg(F.count("*").alias("n")).withColumn("layer", X.focus_layer(F.col("file")))


def resurrections(sessions: DataFrame, projects: DataFrame, keys: list[str], days: int = 180) -> DataFrame:
    """Projects (none is one, too) that came back after ``days`` days or more without a session that is not legacy; the score is the number of rows."""
    back = F.lead("start_time").over(Window.partitionBy(*keys, "project_id").orderBy("start_time", "id"))
    last = F.coalesce("end_time", "start_time")
    real = sessions.where(~F.col("is_legacy")).select(*keys, "id", "project_id", last.alias("last_active"), back.alias("resurrected_at"))
    gone = real.withColumn("gap", F.col("resurrected_at") - F.col("last_active")).where(F.col("gap") >= days * 86400)
    return with_project(gone, projects).select(*keys, "project_id", display_name(F.col("project_name")).alias("project"), "last_active", "resurrected_at", F.floor(F.col("gap") / 86400).alias("gap_days"))


def overall(sessions: DataFrame, commands: DataFrame, commits: DataFrame, projects: DataFrame, keys: list[str], now: int, days: int = 90, absence: int = 43200, away: int = 180) -> DataFrame:
    """One insight record per key: totals over everything, the rest over the last ``days`` days.

    Streak, weekday, part of the day, resurrections and last commands before an
    absence look at sessions that aren't legacy; class and late-night index at all.
    Of equal weekdays and parts of the day the earlier one is named.
    """
    since = now - days * 86400
    s, c, m = sessions.where(F.col("start_time") >= since), commands.where(F.col("timestamp") >= since), commits.where(F.col("timestamp") >= since)
    real = s.where(~F.col("is_legacy"))
    totals = sessions.groupBy(*keys).agg(F.count("*").alias("total_sessions")).join(commands.groupBy(*keys).agg(F.count("*").alias("total_commands")), keys, "left")

    def most(df: DataFrame, names: list[str], name: str) -> DataFrame:
        best = F.greatest(*[F.col(n) for n in names])
        named = F.when(best == 0, "N/A")
        for n in names:
            named = named.when(F.col(n) == best, n)
        return df.select(*keys, named.alias(name))

    used = with_project(s, projects).groupBy(*keys, display_name(F.col("project_name")).alias("p")).agg(F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("d"))
    used = used.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "p"))), lambda x: x["p"]).alias("projects"))
    gone = last_commands_before_absence(real, c, keys, absence, by_keys=True)
    gone = gone.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("n"), "command"))), lambda x: x["command"]).alias("before_absence"))
    score = resurrections(s, projects, keys, away).groupBy(*keys).agg(F.count("*").alias("resurrections"))
    parts = [
        most(day_of_week_split(real, keys), [w.lower() for w in WEEKDAYS], "active_day"), most(time_of_day_split(real, keys), ["morning", "afternoon", "evening"], "active_time"),
        used, streaks(real, keys, F.to_date(C.safe_timestamp(F.lit(now)))), class_counts(c, keys).select(*keys, "class_name"),
        late_night_index(c, m, keys).select(*keys, F.col("percent").alias("late_percent"), F.col("tier").alias("late_tier")), score, gone,
    ]
    for part in parts:
        totals = totals.join(part, keys, "left")
    return totals.fillna(0, ["total_commands", "streak", "resurrections"])


def stats_json(sessions: DataFrame, commands: DataFrame, projects: DataFrame) -> DataFrame:
    """One row: totals, first and last valid moment, and each project's statistics with its times, as JSON."""
    iso = lambda c: F.date_format(C.safe_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss")
    per = project_breakdown(sessions, commands, projects, by_id=True).join(projects.select(F.col("id").alias("project_id"), "path"), "project_id", "left")
    one = F.struct(
        F.col("name"), F.col("project_id").alias("id"), F.col("path"), F.col("commands").alias("commands_count"), F.col("duration").alias("total_duration"), F.col("sessions").alias("sessions_count"),
        iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"),
    )
    listed = per.agg(F.array_sort(F.collect_list(one)).alias("projects"))
    window = activity_window(sessions, commands).crossJoin(projects.agg(F.count("*").alias("total_projects"))).crossJoin(listed)
    span = F.struct(iso(F.col("first")).alias("earliest"), iso(F.col("last")).alias("latest"))
    record = F.struct(F.col("sessions").alias("total_sessions"), F.col("commands").alias("total_commands"), "total_projects", span.alias("time_range"), "projects")
    return window.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def query_profile(log: DataFrame) -> DataFrame:
    """log: sql, duration. Count, total and mean per text with white space evened out."""
    same = F.trim(F.regexp_replace("sql", r"\s+", " "))
    return log.groupBy(same.alias("sql")).agg(F.count("*").alias("n"), F.sum("duration").alias("total"), F.avg("duration").alias("mean"))


def calendar_tree(sessions: DataFrame, commands: DataFrame, projects: DataFrame) -> DataFrame:
    """Month, day, project, and the day's sessions as an array with their kind."""
    recovered = commands.groupBy(F.col("session_id").alias("id")).agg(F.bool_or(F.col("recovery_source").isNotNull()).alias("recovered"))
    named = with_project(sessions.join(recovered, "id", "left"), projects)
    kind = F.when(F.col("recovered"), "recovered").when(F.col("is_legacy"), "legacy").otherwise("normal")
    leaf = F.struct("start_time", "id", "duration_seconds", kind.alias("kind"))
    day = C.day(F.col("start_time"))
    return named.groupBy(F.date_format(day, "yyyy-MM").alias("month"), day.alias("day"), display_name(F.col("project_name")).alias("project")).agg(F.array_sort(F.collect_list(leaf)).alias("sessions"))
