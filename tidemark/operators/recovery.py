"""Recovering missing timestamps from anchors, evidence and stored times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.matching import assign_once, similar_texts
from tidemark.operators.scan import numbered

YEAR = 365 * 86400


def _near_anchors(rows: DataFrame, keys: list[str], order: str, t: str) -> DataFrame:
    """Adds the last anchor before each row and the first one after it, with their positions."""
    w = Window.partitionBy(*keys).orderBy(order)
    anchor = F.when(F.col(t).isNotNull(), F.struct(F.col(order).alias("i"), F.col(t).alias("t")))
    before = F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(anchor, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("__b", before).withColumn("__a", after)


def interpolate(rows: DataFrame, keys: list[str], now: int, order: str = "position", t: str = "timestamp", oldest: int | None = None) -> DataFrame:
    """Fill null times by position between anchors; adds ``recovery_source``.

    Between two anchors the time is linear in the position, truncated. Before
    the first one rows spread from ``oldest`` or, without it, one day each,
    back to five years at most; after the last one they spread over ten seconds
    each or a day, up to ``now``. Without anchors nothing changes.
    """
    found = _near_anchors(rows, keys, order, t)
    every = Window.partitionBy(*keys)
    first_i = F.min(F.when(F.col(t).isNotNull(), F.col(order))).over(every)
    low = F.min(order).over(every)
    high = F.max(order).over(every)
    found = found.withColumn("__n0", first_i - low).withColumn("__low", low).withColumn("__high", high)
    b, a, i = F.col("__b"), F.col("__a"), F.col(order)
    between = (b["t"] + (a["t"] - b["t"]) * (i - b["i"]) / (a["i"] - b["i"])).cast("long")
    floor = now - 5 * YEAR
    start = F.lit(oldest) if oldest is not None else F.greatest(a["t"] - F.col("__n0") * 86400, F.lit(floor) + F.col("__n0"))
    prefix = (start + (a["t"] - start) * (i - F.col("__low")) / F.greatest(F.col("__n0"), F.lit(1))).cast("long")
    n1 = F.col("__high") - b["i"]
    span = F.least(F.greatest(10 * n1, F.lit(86400)), F.greatest(F.lit(now) - b["t"], F.lit(0)))
    suffix = (b["t"] + span * (i - b["i"]) / (n1 + 1)).cast("long")
    value = F.when(b.isNotNull() & a.isNotNull(), between).when(a.isNotNull(), prefix).when(b.isNotNull(), suffix)
    source = F.when(b.isNotNull() & a.isNotNull(), "between anchors").when(a.isNotNull(), "before first anchor").when(b.isNotNull(), "after last anchor")
    missing = F.col(t).isNull()
    return found.withColumn("recovery_source", F.when(missing, source)).withColumn(t, F.coalesce(F.col(t), value)).drop("__b", "__a", "__n0", "__low", "__high")


def fill_bounded_gaps(rows: DataFrame, keys: list[str], now: int, order: str = "position", t: str = "timestamp") -> DataFrame:
    """Null out times outside the last five years, then fill gaps by equal steps of whole seconds, one at least.

    After the last time rows follow at ten seconds, or closer to stay before
    ``now``; before the first one they precede it at ten seconds.
    """
    valid = rows.withColumn(t, F.when(F.col(t).between(now - 5 * YEAR, now), F.col(t)))
    found = _near_anchors(valid, keys, order, t)
    b, a, i = F.col("__b"), F.col("__a"), F.col(order)
    high = F.max(order).over(Window.partitionBy(*keys))
    step = F.greatest(F.lit(1), F.floor((a["t"] - b["t"]) / (a["i"] - b["i"])))
    n1 = F.col("__high") - b["i"]
    tail = F.least(F.lit(10), F.greatest(F.lit(0), F.floor((F.lit(now) - b["t"]) / n1)))
    value = F.when(b.isNotNull() & a.isNotNull(), b["t"] + step * (i - b["i"])).when(a.isNotNull(), a["t"] - 10 * (a["i"] - i)).when(b.isNotNull(), b["t"] + tail * (i - b["i"]))
    filled = found.withColumn("__high", high).withColumn(t, F.coalesce(F.col(t), F.greatest(F.lit(now - 5 * YEAR), F.least(F.lit(now), value)).cast("long")))
    return filled.drop("__b", "__a", "__high")


def place_bursts(rows: DataFrame, keys: list[str], mtime: int, order: str = "position", size: int = 20) -> DataFrame:
    """Times for a log without any: bursts of ``size`` rows, ten seconds apart, on working days at 16:00, one burst a day back from ``mtime``.

    Bursts are numbered from the end and each has a working day of its own, so
    none collides with another.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    back = F.row_number().over(w) - 1
    burst = F.floor(back / size)
    day = F.floor(F.lit(mtime) / 86400)
    weekday = F.pmod(day + 3, F.lit(7))  # 0 is Monday
    last = day - F.greatest(F.lit(0), weekday - 4)
    on = F.least(F.lit(4), weekday)
    # Five working days back are seven days back.
    weeks = F.floor((burst + 4 - on) / 5)
    placed = last - burst - 2 * weeks
    return rows.withColumn("timestamp", (placed * 86400 + 16 * 3600 + (size - 1 - F.pmod(back, F.lit(size))) * 10).cast("long"))


def _in_hours(t: Column) -> Column:
    """The time itself within 9 to 18 o'clock on a working day, else 16 o'clock of the working day before it."""
    day, hour = F.floor(t / 86400), F.floor(F.pmod(t, F.lit(86400)) / 3600)
    on = F.when(hour < 9, day - 1).otherwise(day)
    weekday = F.pmod(on + 3, F.lit(7))  # 0 is Monday
    moved = (hour < 9) | (hour >= 18) | (weekday >= 5)
    return F.when(moved, (on - F.greatest(F.lit(0), weekday - 4)) * 86400 + 16 * 3600).otherwise(t).cast("long")


def place_bursts_apart(rows: DataFrame, keys: list[str], mtime: int, order: str = "position", size: int = 20) -> DataFrame:
    """Times for a log without any, evenly over a year (or a day for each burst of ``size`` rows, if longer) that ends 30 days before ``mtime``.

    A burst begins within working hours, its rows ten seconds apart. One that
    would not begin after the last burst placed forwards has ended takes the next
    free slot backwards instead: an hour before the last one, within working
    hours. Bursts are a day apart before they are moved, and none is moved
    further than four days, so only the few bursts before one decide on its
    place: each burst is worked out by itself, from the last one that is surely
    placed forwards. The first one is placed forwards at any time, also before 1970.
    """
    reach, length = 8, size * 10
    numbered_rows = numbered(rows, keys, [order], "__place")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    if keys:
        counts = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], "__n")
        numbered_rows = numbered_rows.join(counts, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]))
    else:
        numbered_rows = numbered_rows.crossJoin(F.broadcast(counts))  # one row
    bursts = F.ceil(F.col("__n") / size)
    span = F.greatest(bursts * 86400, F.lit(365 * 86400))
    begin = F.lit(mtime - 30 * 86400) - span
    wanted = lambda i: _in_hours((begin + i / bursts * span).cast("long"))

    burst = F.floor(F.col("__place") / size)
    steps = lambda n: F.array(*map(F.lit, range(n)))
    near = F.transform(F.filter(steps(2 * reach), lambda k: burst >= k), lambda k: wanted(burst - k))  # where the burst and those before it would begin
    some = numbered_rows.withColumn("__near", near)
    near = F.col("__near")
    sure = lambda k: (k < F.size(near)) & F.coalesce(F.get(near, k) > F.array_max(F.slice(near, k + 2, reach)) + length, F.lit(True))
    first = F.filter(steps(reach), sure)[0]
    state = F.struct(F.lit(-(2**62)).cast("long").alias("ahead"), F.lit(0).cast("long").alias("behind"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, t: Column) -> Column:
        hit = t <= s["ahead"]
        at = F.when(hit, _in_hours(s["behind"] - 3600)).otherwise(t)
        return F.struct(F.when(hit, s["ahead"]).otherwise(at + length).alias("ahead"), at.alias("behind"), at.alias("at"))

    walked = F.aggregate(F.reverse(F.slice(near, F.lit(1), first + 1)), state, step)["at"]
    return some.withColumn("timestamp", walked + F.pmod("__place", F.lit(size)) * 10).select(*rows.columns, "timestamp")


def inline_date(command: Column) -> Column:
    """The date or epoch that a command spells out, or null."""
    stamp = F.coalesce(
        F.try_to_timestamp(F.nullif(F.regexp_extract(command, r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", 1), F.lit("")).substr(1, 19), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(F.replace(F.nullif(F.regexp_extract(command, r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1), F.lit("")), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(F.nullif(F.regexp_extract(command, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(F.nullif(F.regexp_extract(command, r"\b(20\d{6})\b", 1), F.lit("")), F.lit("yyyyMMdd")),
    )
    excluded = command.rlike(r"(?i)--(?:since|until|after|before)|\bcal\b|\bpip install\b|==")
    return F.when(~excluded, F.unix_timestamp(stamp))


# Which evidence a command leaves, in order of preference; group 1 is the artifact's key.
EVIDENCE = [
    ("clone", r"^git clone \S*?([\w.-]+?)(?:\.git)?/?$"),
    ("package", r"^(?:brew|pip3?|npm|cargo|gem) (?:install|add) (?:-\S+ )*([\w@/.-]+)"),
    ("image", r"^docker (?:pull|build .*-t|run .*) ?([\w./:-]+)"),
    ("venv", r"^python3? -m venv (\S+)"),
    ("file", r"^(?:touch|mkdir(?: -p)?|vim?|nano) (\S+)"),
]


def artifact_evidence(commands: DataFrame, artifacts: DataFrame, now: int, small: bool = False) -> DataFrame:
    """Time of the artifact (type, key, ts) that a command made, if it is in the last five years; the first rule that fits decides."""
    kind, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(EVIDENCE):
        hit = F.nullif(F.regexp_extract("command", pattern, 1), F.lit(""))
        kind, key = F.when(hit.isNotNull(), name).otherwise(kind), F.coalesce(hit, key)
    named = commands.withColumn("type", kind).withColumn("key", key)
    valid = artifacts.where((F.col("ts") > now - 5 * YEAR) & (F.col("ts") <= now)).groupBy("type", "key").agg(F.min("ts").alias("evidence"))
    return named.join(F.broadcast(valid) if small else valid, ["type", "key"], "left")


def match_key(text: Column) -> Column:
    low = F.lower(F.trim(text))
    low = F.regexp_replace(low, r"^(?:feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(?:\([^)]*\))?!?:\s*", "")
    return F.trim(F.regexp_replace(low, "[^\\p{ASCII}]", ""))


def match_commits(commands: DataFrame, commits: DataFrame, by: list[str], threshold: float = 0.85) -> DataFrame:
    """Commit commands (message, position) and commits (message, timestamp, hash) of like messages, each commit used once.

    In the order of positions (unique within the keys), each command takes the
    unused commit with the highest ratio, of equal ones the oldest; a ratio of
    ``threshold`` at least (over 0.7). Empty messages match nothing.
    """
    asking = commands.select(*by, "position", match_key(F.col("message")).alias("a"))
    offers = commits.select(*by, "hash", F.col("timestamp").alias("t"), match_key(F.col("message")).alias("b"))
    return assign_once(asking, offers, similar_texts(asking, offers, by, threshold), by)


def recover(rows: DataFrame, keys: list[str], artifacts: DataFrame, now: int) -> DataFrame:
    """Dates in the command, then artifacts, then interpolation; evidence makes a row sound, interpolated rows stay legacy."""
    dated = artifact_evidence(rows.withColumn("__inline", inline_date(F.col("command"))), artifacts, now)
    evidence = F.coalesce("timestamp", "__inline", "evidence")
    marked = dated.withColumn("sound", evidence.isNotNull()).withColumn("timestamp", evidence).drop("__inline", "evidence", "type", "key")
    return interpolate(marked, keys, now).withColumn("is_legacy", ~F.col("sound")).drop("sound")
