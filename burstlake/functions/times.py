"""Column functions on capture times. Times are wall clock: no time zone is ever applied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1970-01-01 to 2001-01-01, from which a foreign catalogue counts.
FOREIGN_EPOCH = 978307200


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01; a day beyond the month's end rolls over."""
    return F.unix_date(F.make_date(year, month, F.lit(1))) + day - 1


def parse_stamp(c: Column) -> Column:
    """Seconds of ``YYYY:MM:DD HH:MM:SS`` (any separators, zone dropped); 31 February rolls over; nonsense is null."""
    got = lambda k: F.try_to_number(F.regexp_extract(c, r"^\s*(\d{4})[:/-](\d{1,2})[:/-](\d{1,2})[ T](\d{1,2}):(\d{1,2}):(\d{1,2})", k), F.lit("9999")).cast("int")
    y, mo, d, h, mi, s = (got(k) for k in range(1, 7))
    good = y.between(1970, 9999) & mo.between(1, 12) & d.between(1, 31)
    return F.when(good, days_from_civil(y, mo, d) * F.lit(86400.0) + h * 3600 + mi * 60 + s)


def with_subseconds(seconds: Column, digits: Column) -> Column:
    return seconds + F.coalesce(F.concat(F.lit("0."), F.trim(digits)).try_cast("double"), F.lit(0.0))


def from_foreign_epoch(c: Column) -> Column:
    return c.try_cast("double") + FOREIGN_EPOCH


def age_seconds(now: Column, then: Column) -> Column:
    return F.greatest(F.round(now - then), F.lit(0.0)).cast("long")


def wall_seconds(ts: Column) -> Column:
    """The wall clock of a timestamp as seconds, with its fraction; for times without zone the session's zone does not matter."""
    whole = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return (whole * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")) / F.lit(1e6)


#: Tags of the capture time and of its fraction, the most exact first.
STAMPS = ("SubSecDateTimeOriginal", "DateTimeOriginal", "DateTimeDigitized", "DateTime")
FRACTIONS = ("SubSecTimeOriginal", "SubSecTime", "SubSecTimeDigitized")


def taken_at(tags: Column) -> Column:
    """Seconds of the first stamp in ``tags`` (a map of text); a fraction of its own is added unless the tag that has both is there, even empty."""
    given = lambda n: F.when(~F.coalesce(F.try_element_at(tags, F.lit(n)), F.lit("")).isin("", "-"), F.try_element_at(tags, F.lit(n)))
    stamp, fraction = F.coalesce(*map(given, STAMPS)), F.coalesce(*map(given, FRACTIONS))
    both = F.concat(F.lit("0."), F.regexp_extract(stamp, r"\.(\d+)", 1)).try_cast("double")
    seconds = parse_stamp(stamp) + F.when(F.regexp_extract(stamp, r"\.(\d+)", 1) != "", both).otherwise(0.0)
    return F.when(F.map_contains_key(tags, F.lit(STAMPS[0])), seconds).otherwise(with_subseconds(seconds, fraction))


def civil_from_days(days: Column) -> Column:
    """The date of days since 1970-01-01."""
    return F.date_from_unix_date(days)


def epoch_of_iso(c: Column) -> Column:
    """Seconds of ``YYYY-MM-DDTHH:MM[:SS]`` with Z, an offset or neither (then UTC); fractions are left out, nonsense is null."""
    pattern = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:\.\d*)?(?:Z|([+-])(\d{1,2}):(\d{1,2}))?\s*$"
    got = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).cast("long"), F.lit(0))
    offset = F.when(F.regexp_extract(c, pattern, 7) == "-", -1).otherwise(1) * (got(8) * 3600 + got(9) * 60)
    days = days_from_civil(got(1).cast("int"), got(2).cast("int"), got(3).cast("int"))
    return F.when(c.rlike(pattern) & got(2).between(1, 12), days * F.lit(86400).cast("long") + got(4) * 3600 + got(5) * 60 + got(6) - offset)


def iso_of_epoch(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of whole seconds, 0 at least; no zone is applied."""
    whole = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    rest = F.pmod(whole, F.lit(86400))
    return F.format_string("%sT%02d:%02d:%02dZ", F.date_from_unix_date(F.floor(whole / 86400).cast("int")).cast("string"), F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60)))
