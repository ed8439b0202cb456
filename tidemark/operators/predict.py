"""Which project comes next: recency, hour, weekday and interruption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import time as C
from tidemark.operators.insights import top_per_group
from tidemark.operators.joins import interrupted_sessions

HALF_LIFE = 3 * 86400


def hour_bucket(hour: Column) -> Column:
    """Seven parts of the day."""
    return X.one_of(hour, [(hour < 5, "night"), (hour < 8, "early morning"), (hour < 12, "morning"), (hour < 14, "midday"), (hour < 18, "afternoon"), (hour < 22, "evening")], "late evening")


def prediction_input(sessions: DataFrame, commands: DataFrame, cutoff: int) -> DataFrame:
    """Sessions since ``cutoff`` that are not legacy and have a command that is not; noise is no command."""
    own = commands.where(~F.col("is_legacy"))
    work = own.where(~X.is_noise(F.col("command"))).groupBy(F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("timestamp", "command"))).alias("work"))
    kept = sessions.where(~F.col("is_legacy") & (F.col("start_time") >= cutoff)).join(own.select(F.col("session_id").alias("id")).distinct(), "id", "left_semi")
    return kept.join(work, "id", "left")


def project_signals(sessions: DataFrame, keys: list[str], now: int) -> DataFrame:
    """Per project: decayed time, shares of its sessions at this part of the day and on this weekday, and their weighted sum."""
    past = sessions.where(F.col("start_time") <= now)
    age = (F.lit(now) - F.col("start_time")) / HALF_LIFE
    moment = F.lit(now)
    same_hour = hour_bucket(C.hour(F.col("start_time"))) == hour_bucket(C.hour(moment))
    same_day = C.weekday(F.col("start_time")) == C.weekday(moment)
    per = past.groupBy(*keys, "project_id").agg(
        F.sum(F.pow(F.lit(0.5), age) * (F.coalesce("duration_seconds", F.lit(0)) / 3600 + 0.1)).alias("recency"),
        F.avg(same_hour.cast("double")).alias("hour_share"), F.avg(same_day.cast("double")).alias("day_share"), F.count("*").alias("sessions"),
    )
    most = F.max("recency").over(Window.partitionBy(*keys)) if keys else F.max("recency").over(Window.partitionBy())
    score = 2.0 * F.when(most > 0, F.col("recency") / most).otherwise(0.0) + 1.5 * F.col("hour_share") + 1.0 * F.col("day_share")
    return per.withColumn("score", score)


def top_commands(commands: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent beginnings (one or two words) of each project's commands."""
    words = F.slice(F.split(F.trim("command"), r"\s+"), 1, 2)
    return top_per_group(commands.withColumn("start", F.array_join(words, " ")), ["project_id"], "start", n)


def predict_next(sessions: DataFrame, commands: DataFrame, keys: list[str], now: int, top: int = 3, days: int = 30) -> DataFrame:
    """The ``top`` projects per key with their score and the signals that speak for them."""
    if top < 1 or days < 1:
        raise ValueError("top and days must be positive")
    used = prediction_input(sessions, commands, now - days * 86400)
    broken = interrupted_sessions(used, keys, now).groupBy(*keys, "project_id").agg(F.max("ended").alias("ended"))
    newest = broken.groupBy(*keys).agg(F.max_by("project_id", "ended").alias("project_id")).withColumn("interrupted", F.lit(True))
    scored = project_signals(used, keys, now).join(newest, [*keys, "project_id"], "left").fillna(False, ["interrupted"])
    scored = scored.withColumn("score", F.col("score") + F.when(F.col("interrupted"), 3.0).otherwise(0.0))
    signals = F.array_compact(F.array(F.when(F.col("recency") >= 0.3, "recent"), F.when(F.col("hour_share") >= 0.2, "hour"), F.when(F.col("day_share") >= 0.2, "weekday"), F.when(F.col("interrupted"), "interrupted")))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "project_id")
    return scored.withColumn("signals", signals).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
