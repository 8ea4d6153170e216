"""Number texts, with the rounding and trimming the published reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grouped(value: Column, decimals: int | Column = 0) -> Column:
    """Thousands separators, fixed decimals, ties to even."""
    places = F.lit(decimals) if isinstance(decimals, int) else decimals
    return F.call_function("format_number", value, places)


def plain(value: Column, decimals: int) -> Column:
    return F.call_function("format_number", value, F.lit(f"0.{'0' * decimals}" if decimals else "0"))


def trimmed(value: Column, decimals: int) -> Column:
    """Like :func:`grouped`, without zeros at the end of the decimals.

    A fixed pattern is read once; a pattern that changes from row to row is read for each.
    """
    return F.call_function("format_number", value, F.lit(f"#,##0.{'#' * decimals}" if decimals else "#,##0"))


def trim_decimal(text: Column) -> Column:
    """Drop trailing zeros after a decimal point, then a bare point."""
    return F.rtrim(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), F.lit("."))


def percent(share: Column) -> Column:
    """Whole percent, ties to even."""
    return F.concat(F.rint(share * 100).cast("int").cast("string"), F.lit("%"))


def significant(value: Column, digits: int = 4) -> Column:
    """General format with ``digits`` significant digits and separators, ties to even.

    The exponent is that of the rounded number. Where rounding can't raise it, it is read off the
    size, so most numbers are formatted once.
    """
    parts = F.split(F.call_function("format_number", value, F.lit("0." + "0" * (digits - 1) + "E0")), "E")
    exponent = F.get(parts, 1).cast("int")
    figures = F.abs(exponent).cast("string")
    power = F.concat(F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
                     F.when(F.length(figures) < 2, F.concat(F.lit("0"), figures)).otherwise(figures))
    fixed = trim_decimal(grouped(value, F.lit(digits - 1) - exponent))
    scaled = F.bround(value / F.pow(F.lit(10.0), exponent - (digits - 1)), 0)
    mantissa = grouped(scaled / float(10 ** (digits - 1)), digits - 1)
    scientific = F.concat(trim_decimal(mantissa), power)
    out, size = F.when(value == 0, F.lit("0")), F.abs(value)
    for e in reversed(range(-4, digits)):
        inside = (size >= float(f"1e{e}")) & (size < float(f"9.{'9' * (digits - 1)}e{e}"))
        out = out.when(inside, trimmed(value, digits - 1 - e))
    return out.when(exponent.between(-4, digits - 1), fixed).otherwise(scientific)


def format_value(value: Column) -> Column:
    """A number for display: the larger, the fewer decimals."""
    size = F.abs(value)
    return F.when(size >= 1000, grouped(value)).when(size >= 1, trimmed(value, 2)).otherwise(trimmed(value, 3))


def display_value(value: Column, unit: Column, port: Column, duration: Column, *, clocks: bool, ports: bool) -> Column:
    """A feature value with its unit; ports as bare integers, long durations in seconds too."""
    shown = F.rtrim(F.concat(format_value(value), F.lit(" "), unit))
    if clocks:
        clock = F.concat(grouped(value, 0), F.lit(" us ("), plain(value / 1_000_000, 3), F.lit(" s)"))
        shown = F.when(duration & (value >= 1000), clock).otherwise(shown)
    if ports:
        shown = F.when(port, value.try_cast("long").cast("string")).otherwise(shown)
    return shown
