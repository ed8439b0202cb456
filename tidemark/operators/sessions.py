"""Gap sessions, streaks and other order-dependent operators.

Every window is partitioned by ``keys``; with ``keys=[]`` all rows form one
partition. ``assign_sessions``, ``idle_chunks``, ``long_gaps`` and
``inferred_breaks`` have a form with ``spread=True`` in which the rows of one
key are dealt over many tasks (see ``scan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.scan import PART, least_of_run, parted, scan


def _over(keys: list[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _runs(commands: DataFrame, keys: list[str], gap: int, inclusive: bool) -> DataFrame:
    """Parted commands with session_id."""
    order = ["timestamp", "id"]
    rows = scan(parted(commands, keys, order), keys, order, previous={"__before": F.col("timestamp")})
    wait = F.col("timestamp") - F.col("__before")
    fresh = F.coalesce((wait < gap) if inclusive else (wait <= gap), F.lit(False)) == False  # noqa: E712
    rows = scan(rows, keys, order, running={"__run": fresh.cast("long")})
    return least_of_run(rows, keys, "__run", "id", "session_id").drop("__before", "__run")


def assign_sessions(commands: DataFrame, keys: list[str], gap: int = 1800, inclusive: bool = False, spread: bool = False) -> DataFrame:
    """Adds session_id, the least id of the run of commands without a gap.

    A gap is more than ``gap`` seconds, or with ``inclusive`` that many already.
    Rows are ordered by (timestamp, id); ids are unique within the keys. A row
    without a timestamp is a gap of its own.
    """
    if spread:
        return _runs(commands, keys, gap, inclusive).drop(PART)
    w = _over(keys, "timestamp", "id")
    before = F.lag("timestamp").over(w)
    wait = F.col("timestamp") - before
    fresh = before.isNull() | ((wait >= gap) if inclusive else (wait > gap))
    run = F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = commands.withColumn("__run", run)
    return numbered.withColumn("session_id", F.min("id").over(Window.partitionBy(*keys, "__run"))).drop("__run")


def session_rows(commands: DataFrame, keys: list[str]) -> DataFrame:
    """One row per session: it ends at its last command and is legacy if all its commands are."""
    return commands.groupBy(*keys, F.col("session_id").alias("id")).agg(
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), (F.max("timestamp") - F.min("timestamp")).alias("duration_seconds"),
        F.min("project_id").alias("project_id"), F.coalesce(F.bool_and("is_legacy"), F.lit(False)).alias("is_legacy"), F.count("*").alias("n_commands"),
    )


def effective_end(end: str = "end_time", start: str = "start_time", open_seconds: int = 0) -> Column:
    """The end of a session; an open one ends ``open_seconds`` after its start."""
    return F.coalesce(F.col(end), F.col(start) + open_seconds)


def idle_chunks(commands: DataFrame, keys: list[str], now: int, idle: int = 1800, force: bool = False, spread: bool = False) -> DataFrame:
    """Chunks split at gaps of ``idle`` seconds or more; the last one only if forced or idle by ``now``."""
    if spread:
        chunks = assign_sessions(commands, keys, idle, inclusive=True, spread=True)
        ends = chunks.groupBy(*keys, "session_id").agg(F.max("timestamp").alias("__last"))
        newest = ends.groupBy(*keys).agg(F.max("__last").alias("__newest"))
        open_ones = ends.join(newest, keys) if keys else ends.crossJoin(F.broadcast(newest))  # without keys: one row
        open_ones = open_ones.where(F.lit(not force) & (F.col("__last") == F.col("__newest")) & (F.lit(now) - F.col("__last") < idle)).select(*keys, "session_id")
        return chunks.join(open_ones, [*keys, "session_id"], "left_anti")  # one chunk of each key at most
    chunks = assign_sessions(commands, keys, idle, inclusive=True)
    last = F.max("timestamp").over(Window.partitionBy(*keys, "session_id"))
    newest = F.max("timestamp").over(Window.partitionBy(*keys))
    done = (F.col("__last") < F.col("__newest")) | F.lit(force) | (F.lit(now) - F.col("__last") >= idle)
    return chunks.withColumn("__last", last).withColumn("__newest", newest).where(done).drop("__last", "__newest")


def _next_start(sessions: DataFrame, keys: list[str], spread: bool) -> DataFrame:
    """Sessions with ``__next``, the start of the one after: the previous row's, in falling order."""
    if not spread:
        return sessions.withColumn("__next", F.lead("start_time").over(_over(keys, "start_time", "id")))
    falling = sessions.withColumn("__back", -F.col("start_time")).withColumn("__back_id", -F.col("id"))
    order = ["__back", "__back_id"]
    return scan(parted(falling, keys, order), keys, order, previous={"__next": F.col("start_time")}).drop(*order, PART)


def long_gaps(sessions: DataFrame, keys: list[str], seconds: int, spread: bool = False) -> DataFrame:
    """Sessions followed by a break of ``seconds`` or more within their keys, with the break's length in whole days."""
    sessions = _next_start(sessions, keys, spread)
    return sessions.withColumn("gap_seconds", F.col("__next") - effective_end()).drop("__next").where(F.col("gap_seconds") >= seconds).withColumn("gap_days", F.floor(F.col("gap_seconds") / 86400))


def last_commands_before_absence(sessions: DataFrame, commands: DataFrame, keys: list[str], seconds: int = 43200, by_keys: bool = False) -> DataFrame:
    """How often each command was the last one before an absence, in all or ``by_keys``; only sessions with commands count."""
    last = commands.groupBy(F.col("session_id").alias("id")).agg(F.max_by("command", F.struct("timestamp", F.col("id").alias("cid"))).alias("command"))
    gone = long_gaps(sessions.join(last.select("id"), "id", "left_semi"), keys, seconds).join(last, "id")
    return gone.groupBy(*(keys if by_keys else []), "command").agg(F.count("*").alias("times"), F.min("start_time").alias("first_seen"))


def streaks(sessions: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """Consecutive days with sessions up to today or yesterday; 0 if the latest day is older."""
    day = F.to_date(F.timestamp_seconds("start_time"))
    days = sessions.select(*keys, day.alias("day")).where(F.col("day") <= today).distinct()
    island = F.date_sub("day", F.row_number().over(_over(keys, "day")))
    runs = days.withColumn("island", island).groupBy(*keys, "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    newest = runs.groupBy(*keys).agg(F.max_by("n", "last").alias("n"), F.max("last").alias("last"))
    return newest.select(*keys, F.when(F.datediff(today, "last") <= 1, F.col("n")).otherwise(0).cast("long").alias("streak"))


def inferred_breaks(sessions: DataFrame, keys: list[str], least: int = 600, spread: bool = False) -> DataFrame:
    """Pauses of ``least`` seconds or more before the next session, named by the hour in which they begin."""
    end = effective_end()
    hour = F.hour(F.timestamp_seconds("break_start"))
    kind = F.when((hour >= 11) & (hour <= 14), "lunch").when((hour >= 18) & (hour <= 21), "dinner").when((hour >= 23) | (hour < 5), "sleep").otherwise("break")
    wait = F.col("__next") - end
    return _next_start(sessions, keys, spread).select(*keys, "id", end.alias("break_start"), wait.alias("seconds")).where(F.col("seconds") >= least).withColumn("kind", kind)


def relative_timeline(commands: DataFrame) -> DataFrame:
    """Seconds since the session's start and since the previous command."""
    w = _over(["session_id"], "timestamp", "id")
    since = F.col("timestamp") - F.min("timestamp").over(Window.partitionBy("session_id"))
    return commands.select("session_id", "id", "command", since.alias("offset"), F.coalesce(F.col("timestamp") - F.lag("timestamp").over(w), F.lit(0)).alias("since_previous"))


def keep_best(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def session_keepers(sessions: DataFrame) -> DataFrame:
    """(id, keeper): sessions of one start and project become that with most commands, then a summary, then the least id."""
    w = Window.partitionBy("start_time", "project_id").orderBy(F.col("n_commands").desc(), F.col("ai_summary").isNull(), "id")
    return sessions.select("id", F.first("id").over(w).alias("keeper"))


def first_seen_order(rows: DataFrame, by: list[str], value: Column, order: Column) -> DataFrame:
    """Distinct values of each group as an array, in the order in which they first occur."""
    seen = rows.select(*by, value.alias("value"), order.alias("order")).groupBy(*by, "value").agg(F.min("order").alias("order"))
    return seen.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "value"))), lambda x: x["value"]).alias("values"))


def collapse_repeats(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Drop rows whose value equals that of the row before."""
    before = F.lag(value).over(_over(keys, *order))
    first = F.row_number().over(_over(keys, *order)) == 1
    return rows.withColumn("__new", first | ~F.col(value).eqNullSafe(before)).where("__new").drop("__new")


def one_per_day(entries: DataFrame, keys: list[str]) -> DataFrame:
    """entries: day, text, from_commit, order. A day's commit text if there is one, then the longest, then the first."""
    best = F.max_by("text", F.struct(F.col("from_commit").cast("int"), F.length("text"), -F.col("order")))
    return entries.groupBy(*keys, "day").agg(best.alias("text"))


def personal_best_days(per_day: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Days that tie for the largest count over 0."""
    most = F.max(count).over(Window.partitionBy(*keys))
    return per_day.withColumn("__most", most).where((F.col(count) == F.col("__most")) & (F.col(count) > 0)).drop("__most")


def repair_sessions(sessions: DataFrame, commands: DataFrame) -> DataFrame:
    """Fill a null end or duration from the session's commands; written values stay."""
    last = commands.groupBy(F.col("session_id").alias("id")).agg(F.max("timestamp").alias("__last"))
    fixed = sessions.join(last, "id", "left")
    end = F.coalesce("end_time", "__last")
    duration = F.coalesce("duration_seconds", F.col("__last") - F.col("start_time"))
    return fixed.withColumn("duration_seconds", duration).withColumn("end_time", end).drop("__last")


def rebuild_clusters(commands: DataFrame, keys: list[str], is_build: Column, window: int = 60, least: int = 3) -> DataFrame:
    """Greedy clusters of ``least`` or more build commands within ``window`` seconds of the cluster's first.

    Builds further apart than ``window`` cannot share a cluster, so the fold runs
    over runs of builds, not over a user's whole history.
    """
    builds = assign_sessions(commands.where(is_build), keys, window)
    times = builds.groupBy(*keys, "session_id").agg(F.array_sort(F.collect_list("timestamp")).alias("times"))
    state = F.expr("named_struct('found', cast(array() as array<struct<start:bigint,n:bigint>>), 'held', cast(array() as array<bigint>), 'open', false)")

    def step(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc["found"], F.lit(-1))
        inside = acc["open"] & (t - last["start"] <= window)
        grown = F.concat(F.slice(acc["found"], 1, F.greatest(F.size(acc["found"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), (last["n"] + 1).alias("n"))))
        held = F.concat(F.when(acc["open"], F.array().cast("array<bigint>")).otherwise(F.filter(acc["held"], lambda x: t - x <= window)), F.array(t))
        enough = F.size(held) >= least
        begun = F.concat(acc["found"], F.array(F.struct(held[0].alias("start"), F.size(held).cast("long").alias("n"))))
        found = F.when(inside, grown).when(enough, begun).otherwise(acc["found"])
        return F.struct(found.alias("found"), F.when(inside, acc["held"]).otherwise(held).alias("held"), (inside | enough).alias("open"))

    folded = times.withColumn("clusters", F.aggregate("times", state, step)["found"])
    return folded.select(*keys, F.explode("clusters").alias("c")).select(*keys, F.col("c.start").alias("start"), F.col("c.n").alias("n"))
