"""Date columns. Listing dates stay ISO strings with an explicit offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import java, let, matches

# Month keys, the local offset and the tokens that mean "no date".
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LOCAL_OFFSET = "+05:30"
LOCAL_OFFSET_MINUTES = 330
NO_DATE = r"^(?:NA|N\/A|Others|-+)$"
ISO_DATE = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?(Z|[+-]\d{2}:\d{2})?)?$"
DAY_FIRST_DATE = (
    r"\b(\d{1,2})[-/. ](\d{1,2}|[A-Za-z]{3,9})[-/. ,]+(\d{4})"
    r"(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?)?\b"
)
CLOCK = r"\d{1,2}:\d{2}"
BARE_DAY = r"^\d{4}-\d{2}-\d{2}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
HAS_OFFSET = r"(?:Z|[+-]\d{2}:\d{2})$"

_MICROS_PER_DAY = 86_400_000_000


def squeeze(text: Column) -> Column:
    """Collapse white space (including no-break space) and trim."""
    return F.trim(F.regexp_replace(text, java(r"\s+", ""), " "))


def parse_listing_date(text: Column, end_of_day: Column | bool = False) -> Column:
    """Read an ISO or day-first listing date; NULL unless it is a real calendar time.

    Values without an offset are local (+05:30). A value without a clock time
    becomes 00:00:00, or 23:59:59 with ``end_of_day``.
    """
    eod = F.lit(end_of_day) if isinstance(end_of_day, bool) else end_of_day
    return let(squeeze(text), lambda value: let(_date_parts(value), lambda p: _listing_date(value, p, eod)))


# Every part in one regex pass: year, month, day, hour, minute, second, half, offset.
_ISO_PARTS = "$1\x01$2\x01$3\x01$4\x01$5\x01$6\x01\x01$7"
_DAY_FIRST_PARTS = "$3\x01$2\x01$1\x01$4\x01$5\x01$6\x01$7\x01"


def _date_parts(value: Column) -> Column:
    return F.when(
        value.rlike(java(ISO_DATE, "")), F.split(F.regexp_replace(value, java(ISO_DATE, ""), _ISO_PARTS), "\x01")
    ).when(
        value.rlike(java(DAY_FIRST_DATE)),
        F.split(
            F.regexp_replace(value, java("^.*?" + DAY_FIRST_DATE + ".*$", "is"), _DAY_FIRST_PARTS), "\x01"
        ),
    )


def _listing_date(value: Column, parts: Column, eod: Column) -> Column:
    # A cast that fails raises and catches an error inside Spark, at many times the cost of the rest: months by name and
    # missing times are not offered to it.
    def whole(text: Column) -> Column:
        return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("int"))

    def number(i: int) -> Column:
        return whole(F.get(parts, F.lit(i)))

    month_text = F.get(parts, F.lit(1))
    half = F.upper(F.get(parts, F.lit(6)))
    raw_hour = number(3)
    month = F.coalesce(
        whole(month_text),
        F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(month_text, F.lit(3)))).cast("int"),
    )
    hour = (
        F.when(raw_hour.isNull(), F.when(eod, 23).otherwise(0))
        .when(half == "", raw_hour)
        .when(raw_hour.between(1, 12), raw_hour % 12 + F.when(half == "PM", 12).otherwise(0))
    )
    end = F.when(eod, 59).otherwise(0)
    offset_text = F.get(parts, F.lit(7))
    fields = F.struct(
        number(0).alias("y"),
        month.alias("m"),
        number(2).alias("d"),
        hour.alias("h"),
        F.when(raw_hour.isNull(), end).otherwise(number(4)).alias("mi"),
        F.when(raw_hour.isNull(), end).otherwise(F.coalesce(number(5), F.lit(0))).alias("s"),
        F.when(offset_text == "", F.lit(LOCAL_OFFSET)).otherwise(offset_text).alias("z"),
    )

    def build(f: Column) -> Column:
        offset_hour = F.substring(f["z"], 2, 2).try_cast("int")
        offset_minute = F.substring(f["z"], 5, 2).try_cast("int")
        good_offset = (f["z"] == "Z") | (
            (offset_minute <= 59) & ((offset_hour < 14) | ((offset_hour == 14) & (offset_minute == 0)))
        )
        midnight = F.lit(0)
        real_day = F.try_make_timestamp(
            f["y"], f["m"], f["d"], midnight, midnight, midnight.cast("decimal(8,6)")
        ).isNotNull()
        ok = f["y"].between(2000, 2100) & real_day & (f["h"] <= 23) & (f["mi"] <= 59) & (f["s"] <= 59) & good_offset
        return F.when(
            ok,
            F.format_string(
                "%04d-%02d-%02dT%02d:%02d:%02d%s", f["y"], f["m"], f["d"], f["h"], f["mi"], f["s"], f["z"]
            ),
        )

    return F.when(parts.isNotNull() & ~matches(value, NO_DATE), let(fields, build))


def day_only(text: Column) -> Column:
    """True when the text shows no clock time."""
    return ~matches(text, CLOCK, "")


def precision(text: Column) -> Column:
    return F.when(day_only(text), F.lit("day")).otherwise(F.lit("minute"))


def bare_day(text: Column) -> Column:
    return matches(text, BARE_DAY, "")


def instant(text: Column) -> Column:
    """Plain timestamp reading: a bare day is 00:00 UTC, no offset means local time."""
    return let(text, _instant)


def _instant(text: Column) -> Column:
    timed = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(?=Z|[+-]|$)", "$1:00")
    full = (
        F.when(bare_day(text), F.concat(text, F.lit("T00:00:00Z")))
        .when(matches(text, HAS_OFFSET, ""), timed)
        .otherwise(F.concat(timed, F.lit(LOCAL_OFFSET)))
    )
    return F.when(matches(text, INSTANT, ""), F.try_to_timestamp(full))


def deadline_instant(text: Column) -> Column:
    """Deadline reading: a bare day lasts until 23:59:59.999 local time."""
    return let(
        text,
        lambda t: F.when(
            bare_day(t), F.try_to_timestamp(F.concat(t, F.lit("T23:59:59.999" + LOCAL_OFFSET)))
        ).otherwise(_instant(t)),
    )


def local_day_number(ts: Column) -> Column:
    """Days since 1970-01-01 on the local (+05:30) calendar; no session zone involved."""
    micros = F.unix_micros(ts) + LOCAL_OFFSET_MINUTES * 60_000_000
    return F.floor(micros / F.lit(_MICROS_PER_DAY)).cast("int")


def local_day(ts: Column) -> Column:
    return F.date_from_unix_date(local_day_number(ts))


def days_until(deadline: Column, now: Column) -> Column:
    """Local calendar days from now to the deadline; NULL for an unreadable deadline."""
    return local_day_number(deadline_instant(deadline)) - local_day_number(now)


def within(ts: Column, now: Column, max_age_seconds: int, max_ahead_seconds: int) -> Column:
    """Observation window: not older than, and not further ahead than, the limits."""
    age = F.unix_micros(now) - F.unix_micros(ts)
    return F.coalesce(
        (age <= max_age_seconds * 1_000_000) & (age >= -max_ahead_seconds * 1_000_000), F.lit(False)
    )


def wall_clock_date(value: Column) -> Column:
    """A ``Z``-suffixed index value that really is local wall-clock time."""
    good = matches(value, r"^20\d{2}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$", "")
    return F.when(good, parse_listing_date(F.regexp_replace(value, r"(?:\.\d+)?Z$", "")))


def deadline_display(deadline: Column, date_precision: Column) -> Column:
    """Text shown for a deadline; day precision never claims a clock time."""
    at = instant(deadline)
    local = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(LOCAL_OFFSET_MINUTES), F.lit(0)
    ) + F.make_dt_interval(secs=(F.unix_micros(at) / 1_000_000).cast("decimal(18,6)"))
    by_day = F.coalesce(date_precision == "day", F.lit(False)) | bare_day(deadline)
    return (
        F.when(at.isNull(), F.lit("Deadline unknown"))
        .when(by_day, F.concat(F.date_format(local, "dd MMM yyyy"), F.lit(" · Time not confirmed")))
        .otherwise(F.concat(
                F.date_format(local, "dd MMM yyyy, hh:mm "), F.lower(F.date_format(local, "a")), F.lit(" IST")
            ))
    )
