"""Opening hours as column expressions.

Hours are a map of weekday (mon to sun) to intervals of HH:MM. A null or empty map, or a day that is missing, is unknown and
counts as open; a day without intervals is closed. An interval that ends at or before its start ends on the next day.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave import config as C

TYPE = "map<string, array<struct<open: string, close: string>>>"
_NONE = "CAST(array() AS array<struct<open: int, close: int>>)"


def day_key(weekday: Column) -> Column:
    """Name of a weekday, 0 being Monday."""
    return F.element_at(F.array(*map(F.lit, C.DAYS)), (F.pmod(weekday, F.lit(7)) + 1).cast("int"))


def minutes(clock: Column) -> Column:
    parts = F.split(clock, ":")
    return F.when(clock.rlike(r"^\s*\d+:\d+\s*$"), F.element_at(parts, 1).try_cast("int") * 60 + F.element_at(parts, 2).try_cast("int"))


def clock(minute: Column) -> Column:
    """HH:MM of a minute of the day, past midnight as well."""
    return F.format_string("%02d:%02d", F.floor(F.pmod(minute, F.lit(1440)) / 60).cast("int"), F.pmod(minute, F.lit(60)).cast("int"))


def duration(minute: Column) -> Column:
    """`Hh MMm`, or `Mm` below an hour."""
    m = F.bround(minute).cast("int")
    return F.when(m >= 60, F.format_string("%dh %02dm", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)).cast("int"))).otherwise(F.format_string("%dm", m))


def intervals(hours: Column, weekday: Column) -> Column:
    """Open intervals of a weekday in minutes, sorted; null if unknown. Malformed ones are skipped."""
    key = day_key(weekday)
    raw = F.coalesce(F.try_element_at(hours, key), F.expr("CAST(array() AS array<struct<open: string, close: string>>)"))
    parsed = F.transform(raw, lambda x: F.struct(minutes(x["open"]).alias("open"), minutes(x["close"]).alias("close")))
    sound = F.filter(parsed, lambda x: x["open"].isNotNull() & x["close"].isNotNull())
    over = F.transform(sound, lambda x: F.struct(x["open"].alias("open"), F.when(x["close"] <= x["open"], x["close"] + 1440).otherwise(x["close"]).alias("close")))
    return F.when(hours.isNotNull() & (F.size(hours) > 0) & F.map_contains_key(hours, key), F.array_sort(over))


def open_during(hours: Column, weekday: Column, start: Column, end: Column) -> Column:
    """Whether a visit fits into one interval; unknown hours allow any."""
    known = intervals(hours, weekday)
    return known.isNull() | F.exists(known, lambda x: (x["open"] <= start) & (end <= x["close"]))


def earliest_open(hours: Column, weekday: Column, minute: Column) -> Column:
    """The first open minute from `minute` on; null if there is none that day."""
    known = intervals(hours, weekday)
    later = F.filter(known, lambda x: x["close"] > minute)
    return F.when(known.isNull(), minute).otherwise(F.greatest(F.try_element_at(later, F.lit(1))["open"], F.when(F.size(later) > 0, minute)))


def _and(keep, day_of, i: int):
    return lambda e: keep(e) & (day_of(e) == i)


def _by_day(entries: Column, day_of, interval_of, keep) -> Column:
    """All seven days, each with the intervals of its entries."""
    pairs = []
    for i, name in enumerate(C.DAYS):
        mine = F.filter(entries, _and(keep, day_of, i))
        pairs += [F.lit(name), F.transform(mine, interval_of)]
    return F.when(entries.isNotNull(), F.create_map(*pairs))


def from_periods(periods: Column) -> Column:
    """Hours of array<struct<open: struct<day, hour, minute>, close: same>>, day 0 being Sunday; no close means all day."""
    two = lambda x: F.lpad(F.coalesce(x, F.lit(0)).cast("string"), 2, "0")
    at = lambda t: F.concat(two(t["hour"]), F.lit(":"), two(t["minute"]))
    whole = lambda e: e["close"].isNull()
    return _by_day(
        periods,
        lambda e: F.pmod(e["open"]["day"] + 6, F.lit(7)),
        lambda e: F.struct(F.when(whole(e), "00:00").otherwise(at(e["open"])).alias("open"), F.when(whole(e), "23:59").otherwise(at(e["close"])).alias("close")),
        lambda e: e["open"]["day"].between(0, 6),
    )


def from_entries(entries: Column) -> Column:
    """Hours of array<struct<day, start: HHMM, end: HHMM>>, day 0 being Monday; malformed ones are skipped."""
    split = lambda s: F.concat(F.substring(s, 1, 2), F.lit(":"), F.substring(s, 3, 2))
    return _by_day(
        entries,
        lambda e: e["day"],
        lambda e: F.struct(split(e["start"]).alias("open"), split(e["end"]).alias("close")),
        lambda e: e["day"].between(0, 6) & (F.length(e["start"]) == 4) & (F.length(e["end"]) == 4),
    )


def all_week(windows: tuple[tuple[str, str], ...]) -> Column:
    spec = F.array(*(F.struct(F.lit(o).alias("open"), F.lit(c).alias("close")) for o, c in windows))
    return F.create_map(*(x for d in C.DAYS for x in (F.lit(d), spec)))


def effective(hours: Column, category: Column) -> tuple[Column, Column]:
    """Hours to plan with, and whether they are the category's default."""
    real = hours.isNotNull() & (F.size(hours) > 0)
    out = F.when(real, hours)
    for name, windows in C.DEFAULT_WINDOWS.items():
        out = out.when(category == name, all_week(windows))
    return out, ~real & category.isin(*C.DEFAULT_WINDOWS)


def parse_text(text: Column) -> Column:
    """Hours of words such as `Mon-Sat 10:00-22:00, Sun 11:00-21:00`; null if nothing is understood. Day ranges may wrap."""
    clause = r"(?i)((?:daily|[a-z]{2,5})(?:\s*[-–]\s*[a-z]{2,5})?\s*\d{1,2}:\d{2}\s*[-–]\s*\d{1,2}:\d{2})"
    clauses = F.regexp_extract_all(text, F.lit(clause), F.lit(1))
    part = lambda c, i: F.regexp_extract(c, r"(?i)^(daily|[a-z]{2,5})(?:\s*[-–]\s*([a-z]{2,5}))?\s*(\d{1,2}:\d{2})\s*[-–]\s*(\d{1,2}:\d{2})$", i)
    pad = lambda t: F.lpad(t, 5, "0")

    def number(name: Column) -> Column:
        out = None
        for i, d in enumerate(C.DAYS):
            names = (d, *{"tue": ("tues",), "wed": ("weds",), "thu": ("thur", "thurs")}.get(d, ()))
            hit = F.lower(F.substring(name, 1, 4)).isin(*names)
            out = F.when(hit, i) if out is None else out.when(hit, i)
        return out

    parsed = F.transform(
        clauses,
        lambda c: F.struct(
            F.when(F.lower(part(c, 1)) == "daily", 0).otherwise(number(part(c, 1))).alias("first"),
            F.when(F.lower(part(c, 1)) == "daily", 6).when(part(c, 2) == "", number(part(c, 1))).otherwise(number(part(c, 2))).alias("last"),
            F.struct(pad(part(c, 3)).alias("open"), pad(part(c, 4)).alias("close")).alias("interval"),
        ),
    )
    sound = F.filter(parsed, lambda x: x["first"].isNotNull() & x["last"].isNotNull())
    # a range that wraps reaches through the end of the week
    on = lambda i: lambda x: F.when(x["last"] >= x["first"], F.lit(i).between(x["first"], x["last"])).otherwise((F.lit(i) >= x["first"]) | (F.lit(i) <= x["last"]))
    pairs = []
    for i, name in enumerate(C.DAYS):
        pairs += [F.lit(name), F.transform(F.filter(sound, on(i)), lambda x: x["interval"])]
    return F.when(F.size(sound) > 0, F.create_map(*pairs))
