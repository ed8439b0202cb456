"""Exports as DataFrames ready to be written as JSON, CSV or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.redact import redact
from tidemark.functions.text import is_noise, markdown_escape, markdown_fence
from tidemark.functions.time import format_clock, format_duration, safe_timestamp
from tidemark.operators.joins import display_name, with_project
from tidemark.operators.store import gate_sessions


def iso(epoch: Column) -> Column:
    return F.date_format(safe_timestamp(epoch), "yyyy-MM-dd'T'HH:mm:ss")


def nested_export(sessions: DataFrame, commands: DataFrame, links: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per session with redacted commands and commits (links: session_id, hash, t, message); write it as JSON."""
    safe = gate_sessions(commands)
    c = safe.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", F.col("id").alias("command_id"), iso(F.col("timestamp")).alias("timestamp_iso"), "command", "exit_code", "is_legacy"))).alias("commands"))
    m = links.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("timestamp"), "hash", iso(F.col("t")).alias("timestamp_iso"), redact(F.col("message")).alias("message")))).alias("commits"))
    named = with_project(sessions, projects).withColumnRenamed("id", "session_id")
    out = named.join(c, "session_id", "left").join(m, "session_id", "left")
    return out.select(
        "session_id", "start_time", iso(F.col("start_time")).alias("start_time_iso"), "end_time", iso(F.col("end_time")).alias("end_time_iso"), "duration_seconds", format_duration(F.col("duration_seconds")).alias("duration_readable"),
        "project_id", display_name(F.col("project_name")).alias("project_name"), "project_path", "is_legacy", "commands", "commits",
    )


def csv_export(nested: DataFrame) -> DataFrame:
    """One row per command, one for an empty session; commits as hash and message."""
    commits = F.array_join(F.transform("commits", lambda x: F.concat(F.substring(x["hash"], 1, 7), F.lit(": "), x["message"])), "; ")
    rows = nested.select("session_id", "start_time_iso", "end_time_iso", "duration_seconds", "project_name", commits.alias("commits"), F.explode_outer("commands").alias("c"))
    return rows.select("session_id", "start_time_iso", "end_time_iso", "duration_seconds", "project_name", "c.timestamp_iso", "c.command", "c.exit_code", "commits")


def markdown_export(nested: DataFrame) -> DataFrame:
    """One document per session; the fence is longer than any run of backticks within."""
    body = F.array_join(F.transform("commands", lambda x: x["command"]), "\n")
    fence = markdown_fence(F.coalesce(body, F.lit("")))
    head = F.concat(F.lit("## "), markdown_escape(F.col("project_name")), F.lit(" - "), F.coalesce("start_time_iso", F.lit("unknown")), F.lit(" ("), F.col("duration_readable"), F.lit(")"))
    commits = F.array_join(F.transform("commits", lambda x: F.concat(F.lit("- "), markdown_escape(x["message"]))), "\n")
    return nested.select("session_id", F.concat_ws("\n", head, fence, body, fence, commits).alias("value"))


def journal(sessions: DataFrame, commands: DataFrame, projects: DataFrame, all_commands: bool = False) -> DataFrame:
    """One document per day: projects by time spent, sessions by start, without noise."""
    kept = commands if all_commands else commands.where(~is_noise(F.col("command")))
    c = kept.groupBy(F.col("session_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", F.col("id").alias("c"), "command"))), lambda x: F.concat(F.lit("    "), x["command"])), "\n").alias("body"))
    day = F.to_date(safe_timestamp(F.col("start_time")))
    named = with_project(sessions, projects).join(c, "id", "left").withColumn("day", day).withColumn("name", display_name(F.col("project_name")))
    line = F.concat_ws("\n", F.concat(F.lit("  "), format_clock(F.col("start_time")), F.lit(" "), format_duration(F.col("duration_seconds"))), "body")
    per = named.groupBy("day", "name").agg(F.sum("duration_seconds").alias("d"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_time", "id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    part = F.struct((-F.coalesce("d", F.lit(0))).alias("o"), "name", F.concat("name", F.lit("\n"), F.col("text")).alias("text"))
    return per.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n").alias("value"))
