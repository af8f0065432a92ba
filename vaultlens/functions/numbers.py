"""Numbers: parsing as the tools print them, ratios, units, display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNITS = ("bytes", "KB", "MB", "GB", "TB", "PB")
NAN = float("nan")


def parse_int(text: Column) -> Column:
    """The integer that a text begins with, or null."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def grouped_int(text: Column) -> Column:
    """parse_int without thousands separators."""
    return parse_int(F.replace(text, F.lit(","), F.lit("")))


def sized(value: Column, unit: Column | None = None, fixed: bool = False) -> Column:
    """FN-05: a number with unit, in bytes.

    An unknown unit (the copy tool prints kB) stands one step below bytes, so the value is
    divided by 1024; with ``fixed`` units count without regard to case.
    """
    n = grouped_int(value).cast("double")
    if unit is None:
        return n
    names = F.array(*[F.lit(u.upper() if fixed else u) for u in UNITS])
    at = F.array_position(names, F.upper(unit) if fixed else unit)
    return n * F.pow(F.lit(1024.0), at - 1)


def value_after(line: Column, label: str) -> Column:
    """FN-06: the number after a label and before white space, or null."""
    return grouped_int(F.nullif(F.regexp_extract(line, label + r":\s+([\d+,.]+)\s+.*", 1), F.lit("")))


def or_zero(x: Column) -> Column:
    """Missing, null and NaN are 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def ratio(a: Column, b: Column, strict: bool = False) -> Column:
    """a / b; by zero null, or in strict mode NaN and infinities."""
    a, b = a.cast("double"), b.cast("double")
    plain = F.try_divide(a, b)
    if not strict:
        return plain
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.coalesce(plain, F.lit(NAN)))


def compression_ratio(disk: Column, uncompressed: Column) -> Column:
    """PRJ-12."""
    return ratio(disk, uncompressed)


def used_percent(used: Column, total: Column) -> Column:
    """PRJ-13."""
    return F.try_divide(100.0 * used, total.cast("double"))


def age_days(ms: Column) -> Column:
    """FN-11: milliseconds as days with two decimals."""
    return F.format_string("%.2f", ms / F.lit(86_400_000.0))


def percent_text(x: Column) -> Column:
    """FN-13: of a value in hundredths."""
    return F.format_string("%.2f %%", x.cast("double"))


def number_text(x: Column) -> Column:
    """FN-14: whole number with thousands separators."""
    return F.format_number(x, 0)


def file_size(x: Column) -> Column:
    """FN-12: size in the largest binary unit that leaves at least 1, two decimals at most."""
    size, out = x.cast("double"), None
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB", "PB")))):
        text = F.concat(F.regexp_replace(F.format_string("%.2f", size / F.lit(1024.0**k)), r"\.?0+$", ""), F.lit(f" {unit}"))
        here = F.abs(size) >= F.lit(1024.0**k)
        out = F.when(here, text) if out is None else out.when(here, text)
    return out.when(size == 0, "0 B").when(size.isNotNull(), F.concat(F.regexp_replace(F.format_string("%.2f", size), r"\.?0+$", ""), F.lit(" B")))


def date_text(ms: Column) -> Column:
    """FN-10: date and time in the session's zone; null is empty."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "MM/dd/yyyy HH:mm"), F.lit(""))


def seconds(ms: Column) -> Column:
    """FN-23."""
    return ms / 1000.0


def hours(seconds_: Column) -> Column:
    return seconds_ / 3600.0


def minutes(ms: Column) -> Column:
    return ms / 60000.0


def valid_prefix(address: Column) -> Column:
    """FN-22: three numbers parted by dots."""
    return address.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}$")


def valid_bound(n: Column) -> Column:
    return n.between(0, 255)
