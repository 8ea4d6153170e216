"""Ingress: text to typed values. NULL is the only missing value past here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts a CSV reader takes for "missing".
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")
MISSING_WORDS = ("", "nan", "none", "<na>")
MAX_MAGNITUDE = 3.0e38
UNKNOWN_IP, UNKNOWN_PORT = "0.0.0.0", 0


def strip(col: Column) -> Column:
    """Trim every kind of blank, no-break spaces included."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def na_to_null(col: Column) -> Column:
    return F.when(~col.isin(*NA_TOKENS), col)


# A number as CSV readers take it. Java's own parser would also accept '1d' or '0x1p3'.
NUMBER_TEXT = r"(?i)^\s*([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity))\s*$"


def parse_double(col: Column) -> Column:
    """Text to double, junk and NaN to NULL; infinities survive so they can be counted.

    Refers to its input once, so nesting does not multiply the expression.
    """
    return F.regexp_extract(col.cast("string"), NUMBER_TEXT, 1).try_cast("double")


def is_infinite(number: Column) -> Column:
    return F.abs(number) == F.lit(float("inf"))


def to_numeric(col: Column) -> Column:
    """Text to finite double; junk, NaN and infinities become NULL."""
    number = parse_double(col)
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def finite(col: Column) -> Column:
    """A double column with NaN and infinities nulled."""
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)


def coerce_feature(col: Column) -> Column:
    """Like :func:`to_numeric`, also refusing magnitudes beyond float32."""
    number = parse_double(col)
    return F.when(F.abs(number) <= F.lit(MAX_MAGNITUDE), number)


def is_missing_word(col: Column) -> Column:
    return col.isNull() | F.lower(strip(col)).isin(*MISSING_WORDS)


def clean_ip(col: Column) -> Column:
    return F.when(is_missing_word(col), F.lit(UNKNOWN_IP)).otherwise(strip(col))


def optional_text(col: Column) -> Column:
    return F.when(~is_missing_word(col), strip(col))


def whole_number(col: Column) -> Column:
    """Number truncated toward zero; NULL for junk and infinities."""
    return parse_double(col).try_cast("long")


def clean_port(col: Column) -> Column:
    port = whole_number(col)
    return F.when(port.between(0, 65535), port).otherwise(F.lit(UNKNOWN_PORT)).cast("int")


def clamp_confidence(col: Column) -> Column:
    number = parse_double(col)
    return F.coalesce(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def clamp_unit(col: Column) -> Column:
    """Clamp a double column into [0, 1]; NULL and NaN become 0."""
    number = F.when(~F.isnan(col), col)
    return F.coalesce(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
