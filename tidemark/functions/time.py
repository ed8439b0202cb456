"""Column functions over epoch seconds; the session time zone gives days and hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST_SECOND = 253402300799  # of year 9999


def safe_timestamp(epoch: Column) -> Column:
    """The timestamp, or null outside the years 1970 to 9999."""
    return F.when(epoch.between(0, LAST_SECOND), F.timestamp_seconds(epoch))


def day(epoch: Column) -> Column:
    return F.to_date(safe_timestamp(epoch))


def hour(epoch: Column) -> Column:
    return F.hour(safe_timestamp(epoch))


def weekday(epoch: Column) -> Column:
    """Mon to Sun."""
    return F.date_format(safe_timestamp(epoch), "E")


def calendar_range(now: Column, unit: str) -> tuple[Column, Column]:
    """First and last second of the day, week (from Monday) or month of ``now``."""
    start = F.date_trunc(unit, safe_timestamp(now))
    step = {"day": F.expr("INTERVAL 1 DAY"), "week": F.expr("INTERVAL 7 DAY"), "month": F.expr("INTERVAL 1 MONTH")}[unit]
    return F.unix_timestamp(start), F.unix_timestamp(start + step) - 1


def late_night(epoch: Column) -> Column:
    return (hour(epoch) >= 23) | (hour(epoch) < 5)


def time_of_day(epoch: Column) -> Column:
    h = hour(epoch)
    return F.when((h >= 6) & (h < 12), "morning").when((h >= 12) & (h < 18), "afternoon").otherwise("evening")


def recent(epoch: Column, now: int, days: int = 90) -> Column:
    return epoch >= now - days * 86400


def plausible(epoch: Column, now: int, max_years: int = 5) -> Column:
    return epoch.between(now - max_years * 365 * 86400, now)


def timeframe_older_than(identity: Column, kind: Column, cutoff: Column) -> Column:
    """Whether a day is before the cutoff date, or a month over by it; malformed ones are not."""
    of_day = F.try_to_date(identity, "yyyy-MM-dd") < cutoff
    of_month = F.add_months(F.try_to_date(F.concat(identity, F.lit("-01")), "yyyy-MM-dd"), 1) <= cutoff
    return F.coalesce(F.when(kind == "date", of_day).when(kind == "month", of_month), F.lit(False))


def format_duration(seconds: Column) -> Column:
    """1d 0h, 2h 15m, 12m or 45s; 0s for nothing."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    text = lambda c: F.floor(c).cast("string")
    return (
        F.when(s <= 0, "0s")
        .when(s < 60, F.concat(text(s), F.lit("s")))
        .when(s < 3600, F.concat(text(s / 60), F.lit("m")))
        .when(s < 86400, F.concat(text(s / 3600), F.lit("h "), text(F.pmod(s, F.lit(3600)) / 60), F.lit("m")))
        .otherwise(F.concat(text(s / 86400), F.lit("d "), text(F.pmod(s, F.lit(86400)) / 3600), F.lit("h")))
    )


def format_clock(epoch: Column) -> Column:
    """12-hour time without a leading zero; null is in progress."""
    return F.coalesce(F.date_format(safe_timestamp(epoch), "h:mm a"), F.lit("In progress"))


def format_offset(seconds: Column) -> Column:
    """+mm:ss or +hh:mm:ss, with a minus before the start."""
    s = F.abs(seconds)
    h, m, rest = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%02d:%02d", m, rest)))


def format_range(start: Column, end: Column) -> Column:
    """Month day, year of both ends, without what the first shares with the last."""
    a, b = safe_timestamp(start), safe_timestamp(end)
    last = F.date_format(b, "MMMM dd, yyyy")
    both = lambda first, second: F.concat(F.date_format(a, first), F.lit(" - "), F.date_format(b, second))
    same_year = F.year(a) == F.year(b)
    return (
        F.when(F.to_date(a) == F.to_date(b), last)
        .when(same_year & (F.month(a) == F.month(b)), both("MMMM dd", "dd, yyyy"))
        .when(same_year, both("MMMM dd", "MMMM dd, yyyy"))
        .otherwise(both("MMMM dd, yyyy", "MMMM dd, yyyy"))
    )


def fill_days(per_day: DataFrame, keys: list[str], first: str, last: str, day_col: str = "day", zero: tuple[str, ...] = ("n",)) -> DataFrame:
    """Every day from ``first`` to ``last`` for every key, with 0 where there was none."""
    spark = per_day.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day_col))
    whole = per_day.select(*keys).distinct().crossJoin(F.broadcast(spine)) if keys else spine
    return whole.join(per_day, [*keys, day_col], "left").fillna(0, list(zero))


def fill_hours(per_hour: DataFrame, keys: list[str], zero: tuple[str, ...] = ("n",)) -> DataFrame:
    """All 24 hours for every key."""
    whole = per_hour.select(*keys).distinct() if keys else per_hour.sparkSession.range(1).select(F.lit(1).alias("__one"))
    spine = whole.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return spine.join(per_hour, [*keys, "hour"], "left").fillna(0, list(zero)).drop("__one")


WEEKDAY = "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"


def parse_date(text: Column, now: int | None = None) -> Column:
    """Epoch seconds of a date or time in ISO form (also with ``_``), of a mail header or of a commit log; null for any other text.

    Offsets are Z, +hhmm or +hh:mm; without one the session's time zone holds.
    The weekday's name is not compared with the date. With ``now``, times after
    it or more than five years of 365 days before it are null.
    """
    t = F.regexp_replace(F.regexp_replace(text, "Z$", "+0000"), r"([+-]\d{2}):?(\d{2})$", "$1$2")

    def form(shape: str, pattern: str, prefix: str = "") -> Column:
        bare = F.regexp_replace(t, prefix, "") if prefix else t
        return F.when(t.rlike(prefix + shape if prefix else "^" + shape), F.unix_timestamp(F.try_to_timestamp(bare, F.lit(pattern))))

    clock, zone = r"\d{1,2}:\d{1,2}:\d{1,2}", r" ?[+-]\d{4}$"
    found = F.coalesce(
        form(rf"\d{{4}}-\d{{1,2}}-\d{{1,2}}T{clock}$", "yyyy-M-d'T'H:m:s"),
        form(rf"\d{{4}}-\d{{1,2}}-\d{{1,2}}T{clock}[+-]\d{{4}}$", "yyyy-M-d'T'H:m:sxx"),
        form(r"\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        form(r"\d{4}_\d{1,2}_\d{1,2}$", "yyyy_M_d"),
        form(rf"\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}} {clock}{zone}", "d MMM yyyy H:m:s xx", WEEKDAY + ", "),
        form(rf"[A-Z][a-z]{{2}} \d{{1,2}} {clock} \d{{4}}{zone}", "MMM d H:m:s yyyy xx", WEEKDAY + " "),
    )
    return found if now is None else F.when((found <= now) & (found > now - 5 * 365 * 86400), found)
