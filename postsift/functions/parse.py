"""Salary and date expressions.  All run inside the JVM and never fail a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from postsift.functions.text import col_of, first_int, first_match, first_match_with, let

# Working units per year.
HOURS, DAYS, WEEKS, MONTHS = 2080, 260, 52, 12


@dataclass(frozen=True)
class SalaryStyle:
    """How one portal writes pay: units are (words, factor, only below this mean)."""

    units: tuple[tuple[tuple[str, ...], int, float | None], ...]
    drop_dollar: bool = False
    keep_zero: bool = False


# The five spellings.  An empty word tuple applies without a word.
SALARY_STYLES = {
    "general": SalaryStyle(
        ((("hour",), HOURS, 1000), (("month",), MONTHS, 50_000), (("week",), WEEKS, 10_000)), drop_dollar=True
    ),
    "hour": SalaryStyle(((("hour",), HOURS, 1000),)),
    "unbounded": SalaryStyle(((("hour", "/hr"), HOURS, None), (("month",), MONTHS, None)), keep_zero=True),
    "hour_month": SalaryStyle(((("hour",), HOURS, 1000), (("month",), MONTHS, 50_000))),
    "small_is_hourly": SalaryStyle((((), HOURS, 1000),), drop_dollar=True),
}


def parse_salary(c: Column | str, style: str = "general") -> Column:
    """Yearly amount from free text: mean of all numbers, scaled by the unit named."""
    c, rule = col_of(c), SALARY_STYLES[style]
    digits = F.replace(c, F.lit("$"), F.lit("")) if rule.drop_dollar else c
    numbers = F.transform(
        F.regexp_extract_all(digits, F.lit("[0-9,]+"), F.lit(0)),
        lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("double"),
    )
    total = F.aggregate(
        F.filter(numbers, lambda n: n >= 0 if rule.keep_zero else n > 0),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda acc, n: F.struct((acc["s"] + n).alias("s"), (acc["n"] + 1).alias("n")),
        lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]),
    )
    text = F.lower(c)

    def scale(mean: Column) -> Column:
        factor = F.lit(1)
        for words, times, below in reversed(rule.units):
            test = F.lit(True)
            if words:
                test = F.contains(text, F.lit(words[0]))
                for word in words[1:]:
                    test = test | F.contains(text, F.lit(word))
            if below is not None:
                test = test & (mean < below)
            factor = F.when(test, F.lit(times)).otherwise(factor)
        return (mean * factor).try_cast("int")

    return let(total, scale)


def hashed_amount(c: Column | str) -> Column:
    """Pay inside prose: '$120k' gives 120000, '$150,000' gives 150000, else NULL."""
    c = col_of(c)
    thousands = F.nullif(first_match_with(c, "$", r"(?i)\$([0-9]{2,3})k", 1), F.lit("")).try_cast("int") * 1000
    plain = F.replace(first_match_with(c, "$", r"\$([0-9]{3},?[0-9]{3})", 1), F.lit(","), F.lit(""))
    return F.coalesce(thousands, F.nullif(plain, F.lit("")).try_cast("int"))


def midpoint(low: Column | str, high: Column | str, missing_is_zero: bool = False) -> Column:
    """Middle of a range; one known end stands alone.  With *missing_is_zero* an absent end is 0."""
    low, high = (F.nullif(col_of(x).try_cast("double"), F.lit(0.0)) for x in (low, high))
    if missing_is_zero:
        mean = (F.coalesce(low, F.lit(0.0)) + F.coalesce(high, F.lit(0.0))) / 2
        return F.when(low.isNotNull() | high.isNotNull(), mean).try_cast("int")
    return F.coalesce((low + high) / 2, low, high).try_cast("int")


def interval_salary(low: Column | str, high: Column | str, interval: Column | str) -> Column:
    """Yearly amount from a range and a typed interval ('hourly', 'monthly', ...)."""
    low, high = (F.when(~F.isnan(x), x) for x in (col_of(low).cast("double"), col_of(high).cast("double")))
    mean = F.coalesce((low + high) / 2, low, high)
    unit = F.lower(col_of(interval))
    factor = F.lit(1)
    for word, times in (("day", DAYS), ("week", WEEKS), ("month", MONTHS), ("hour", HOURS)):
        factor = F.when(F.contains(unit, F.lit(word)), F.lit(times)).otherwise(factor)
    return (mean * factor).try_cast("int")


# -- dates --------------------------------------------------------------------
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"
_OFFSET = r"^(.*[T ].*?)(Z+|[+-][0-9]{2}:?[0-9]{2}(:?[0-9]{2})?)$"


def parse_iso(c: Column | str, fallback: Column | None = None, tz: str = "wall") -> Column:
    """ISO text to TIMESTAMP_NTZ.

    tz="wall" drops an explicit offset and keeps the clock reading; tz="convert"
    shifts to UTC.  Unreadable text gives *fallback*.
    """
    c = col_of(c)
    wall = F.regexp_replace(c, _OFFSET, "$1")
    parsed = F.when(wall.rlike(_ISO), wall.try_cast("timestamp_ntz"))
    if tz == "convert":
        shifted = parse_epoch(F.unix_micros(c.try_cast("timestamp")) / F.lit(1_000_000).cast("decimal(7,0)"), F.lit(None).cast("timestamp_ntz"))
        parsed = F.when((wall != c) & wall.rlike(_ISO), shifted).otherwise(parsed)
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def parse_pattern(c: Column | str, pattern: str, fallback: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(col_of(c), F.lit(pattern)).cast("timestamp_ntz"), fallback)


def parse_rfc822(c: Column | str, fallback: Column) -> Column:
    """'Tue, 05 Mar 2024 10:00:00 +0100' to its clock reading; the zone is dropped."""
    core = first_match(c, r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}(:[0-9]{2})?)", 1)
    core = F.when(F.length(F.regexp_replace(core, "[^:]", "")) == 1, F.concat(core, F.lit(":00"))).otherwise(core)
    return parse_pattern(F.nullif(core, F.lit("")), "d MMM yyyy HH:mm:ss", fallback)


def parse_epoch(c: Column | str, fallback: Column) -> Column:
    """Seconds since 1970 to a UTC clock reading."""
    seconds = col_of(c).try_cast("decimal(18,6)")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    usable = seconds.between(-62_135_596_800, 253_402_300_799)
    return F.coalesce(F.when(usable, seconds_after(start, seconds)), fallback)


def seconds_after(start: Column, seconds: Column) -> Column:
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def to_instant(clock: Column | str) -> Column:
    """UTC clock reading (TIMESTAMP_NTZ) to TIMESTAMP, in any session time zone."""
    return F.from_utc_timestamp(col_of(clock).cast("timestamp"), F.current_timezone())


def to_clock(instant: Column | str) -> Column:
    """TIMESTAMP to its UTC clock reading, in any session time zone."""
    return F.to_utc_timestamp(col_of(instant), F.current_timezone()).cast("timestamp_ntz")


_UNIT_SECONDS = {"s": 1, "h": 3600, "d": 86_400, "w": 604_800}
_FIRST_DAY = "0001-01-01 00:00:00"  # the earliest time
_MOST_UNITS = 100_000_000_000  # more than lie between it and any other time
_NOW_WORDS = {
    "general": ("just", "now", "today", "moment"), "hour_day": ("today", "now", "just"), "words": ("just", "today"),
}


def parse_relative(c: Column | str, as_of: Column, style: str = "general") -> Column:
    """'3 hours ago' and the like, counted back from *as_of*; unreadable text is *as_of*.

    A time before year 1 is NULL.
    """
    text = F.lower(col_of(c))
    if style == "general":
        digits = first_match(text, r"([0-9]+)\s*([smhdw])", 1)
        unit = first_match(text, r"([0-9]+)\s*([smhdw])", 2)
        # a bare "m" is a month of 30 days unless "min" appears somewhere
        size = F.when(unit == "m", F.when(F.contains(text, F.lit("min")), F.lit(60)).otherwise(F.lit(2_592_000)))
        for letter, seconds in _UNIT_SECONDS.items():
            size = size.when(unit == letter, F.lit(seconds))
    elif style == "hour_day":
        digits = first_match(text, r"([0-9]+)\s*([hd])", 1)
        size = F.when(first_match(text, r"([0-9]+)\s*([hd])", 2) == "h", F.lit(3600)).otherwise(F.lit(86_400))
    else:  # "words": the unit word decides, one unit if no number is given
        digits = F.coalesce(F.nullif(first_match(text, "[0-9]+"), F.lit("")), F.lit("1"))
        size = F.when(F.contains(text, F.lit("hour")), F.lit(3600)).when(F.contains(text, F.lit("day")), F.lit(86_400))
    is_now = F.lit(False)
    for word in _NOW_WORDS[style]:
        is_now = is_now | F.contains(text, F.lit(word))
    number = digits.try_cast("bigint")
    back = F.when(number <= _MOST_UNITS, number * size)
    back = F.when(back <= age_seconds(F.lit(_FIRST_DAY).cast("timestamp_ntz"), as_of), back)
    back = F.when(is_now | (digits == "") | size.isNull(), F.lit(0)).otherwise(back)
    return seconds_after(as_of, -back)


def age_seconds(ts: Column | str, as_of: Column) -> Column:
    """Exact age with microseconds as DECIMAL; negative for a future time.

    Taken from the interval between two clock readings, so no time zone takes part.
    """
    age = as_of - col_of(ts)
    units = (("DAY", 86_400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))
    return sum((F.extract(F.lit(unit), age).cast("decimal(18,6)") * size for unit, size in units), F.lit(0))


def age_days(ts: Column | str, as_of: Column) -> Column:
    """Whole days, rounded down; a missing time counts as today."""
    return F.coalesce(F.floor(age_seconds(ts, as_of) / 86_400), F.lit(0)).cast("int")


def days_label(ts: Column | str, as_of: Column) -> Column:
    days = age_days(ts, as_of)
    return F.when(days == 0, F.lit("Today")).otherwise(F.concat(days.cast("string"), F.lit("d ago")))


def is_fresh_label(c: Column | str, max_days: int = 2, minutes_are_months: bool = True) -> Column:
    """False for labels like '3d', '1w', '4mo', '1y'; '' and NULL are fresh.

    A label such as '30m' reads as months unless *minutes_are_months* is off.
    """
    c = F.coalesce(col_of(c), F.lit(""))
    text = F.lower(c)
    number, unit = first_match(c, "([0-9]+)([dwmy])", 1), first_match(c, "([0-9]+)([dwmy])", 2)
    old = F.when(unit == "d", F.coalesce(number.try_cast("bigint") > max_days, F.lit(True)))
    if not minutes_are_months:
        old = old.when((unit == "m") & ~first_match(c, "[0-9]+(m[a-z]*)", 1).startswith("mo"), F.lit(False))
    old = old.when(unit != "", F.lit(True)).otherwise(
        F.contains(text, F.lit("month")) | F.contains(text, F.lit("week")) | F.contains(text, F.lit("year"))
    )
    return ~old
