"""Raw property values to clean columns. Nothing raises: what cannot be read takes its default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: White space of any script: what `\\s` with (?U) matches.
WHITE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def text(value: Column) -> Column:
    """Null is empty; white space of any script goes at both ends. The pattern, which tries every position, runs only where there is some."""
    edge = lambda at: F.lit(WHITE).contains(F.substring(value, at, 1))
    return F.coalesce(F.when(edge(1) | edge(-1), F.regexp_replace(value, r"(?U)^\s+|\s+$", "")).otherwise(value), F.lit(""))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a column that is computed once for each: what is made of it, conditions included, reads it and doesn't repeat it."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], F.inline(F.array(F.struct(value.alias(name)))))


def joined_text(values: Column) -> Column:
    """An array as one text, parts separated by a comma and a space; null is empty."""
    return F.coalesce(F.array_join(values, ", ", ""), F.lit(""))


def integer(value: Column, default: int = 0) -> Column:
    """An integer, or the default. Fractions round half to even; texts with a fraction do not convert."""
    return F.coalesce(value.try_cast("int"), F.lit(default))


def rounded_integer(value: Column, default: int = 0) -> Column:
    """An integer from a double, half to even."""
    return F.coalesce(F.bround(value, 0).try_cast("int"), F.lit(default))


def unsigned(value: Column) -> Column:
    """A whole number from 0 on; negative and unreadable ones are 0."""
    return F.greatest(F.coalesce(value.try_cast("bigint"), F.lit(0)), F.lit(0).cast("bigint"))


def cim_date(value: Column, zone_minutes: int = 0) -> Column:
    """dd.MM.yyyy in a zone that many minutes east of UTC from yyyyMMddHHmmss.ffffff+mmm (minutes east); unreadable: empty."""
    well_formed = value.rlike(r"^[0-9]{14}\.[0-9]{6}[+-][0-9]{3}$")
    part = lambda at, n: F.substring(value, at, n)
    day = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2)).try_cast("date")
    hour, minute, second = (part(i, 2).try_cast("int") for i in (9, 11, 13))
    total = hour * 60 + minute - part(22, 4).try_cast("int") + zone_minutes
    local = F.date_add(day, F.floor(total / 1440).cast("int"))
    valid = well_formed & (hour < 24) & (minute < 60) & (second < 60)
    return F.coalesce(F.when(valid, F.date_format(local, "dd.MM.yyyy")), F.lit(""))


def cim_date_in(value: Column, zone: Column) -> Column:
    """dd.MM.yyyy where the machine is: `zone` names a time zone (null: UTC) whose rules hold at that instant, daylight saving included. Unreadable: empty; an unknown zone is an error."""
    well_formed = value.rlike(r"^[0-9]{14}\.[0-9]{6}[+-][0-9]{3}$")
    part = lambda at, n: F.substring(value, at, n)
    clock = F.concat(F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2)), F.lit(" "), F.concat_ws(":", part(9, 2), part(11, 2), part(13, 2))).try_cast("timestamp_ntz")
    utc = F.timestamp_add("MINUTE", -F.coalesce(part(22, 4).try_cast("int"), F.lit(0)), clock)
    local = F.convert_timezone(F.lit("UTC"), F.coalesce(zone, F.lit("UTC")), utc)
    return F.coalesce(F.when(well_formed, F.date_format(local, "dd.MM.yyyy")), F.lit(""))


# Letters whose capital form is several letters in full case mapping (ß: SS). Compared without case they have at most their one-letter form.
_LONG = [chr(c) for c in range(0x80, 0x110000) if len(chr(c).upper()) > 1]
_SHORT = [c.title() if len(c.title()) == 1 else c for c in _LONG]
_ASIDE = [chr(0x100000 + i) for i in range(len(_LONG))]


def key(device_id: Column) -> Column:
    """What device ids are compared by: case does not count, letter by letter, so that ß is not SS. Grouping and joins hash it like any text."""
    aside = F.upper(F.translate(device_id, "".join(_LONG), "".join(_ASIDE)))
    return F.when(F.octet_length(device_id) == F.length(device_id), F.upper(device_id)).otherwise(F.translate(aside, "".join(_ASIDE), "".join(_SHORT)))


def parts(separator: str, *columns: Column) -> Column:
    """The columns that are not empty, separated."""
    return F.concat_ws(separator, *[F.nullif(c, F.lit("")) for c in columns])


def tenths(value: Column) -> Column:
    """A number rounded to one decimal, as text without a trailing `.0`."""
    return F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")


def gib(n_bytes: Column) -> Column:
    """Units of 2^30 bytes with one decimal, half to even."""
    return F.bround(n_bytes.cast("double") / F.lit(1073741824.0), 1)


def gb(n_bytes: Column) -> Column:
    """Units of 10^9 bytes, whole, half to even."""
    return F.bround(n_bytes.cast("double") / F.lit(1e9), 0)


def percent(done: Column, total: Column) -> Column:
    """Whole percent; -1 where the total is unknown."""
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(-1).cast("int")


def clamp(value: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def justified(value: Column, width: int) -> Column:
    """Filled with blanks to the width; longer texts stay whole."""
    return F.when(F.length(value) < width, F.rpad(value, width, " ")).otherwise(value)
