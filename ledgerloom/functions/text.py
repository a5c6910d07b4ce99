"""Text expressions used by the reports (all JVM built-ins, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import as_col


TAG = "<[^>]+>"  # fixed value: what counts as a tag in a note


def blank_to_null(c: Column | str) -> Column:
    """``NULLIF(TRIM(c), '')``; TRIM removes the space character only."""
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def first_nonblank(*cols: Column | str, default: str | None = "") -> Column:
    """First of ``cols`` that is not NULL or blank after trimming, else ``default``."""
    parts = [blank_to_null(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def localized(c: Column | str, lang: str = "en_US") -> Column:
    """A translatable name: JSON object text -> value of ``lang``; plain text as is."""
    c = as_col(c)
    return F.when(c.startswith("{"), F.get_json_object(c, f"$.{lang}")).otherwise(c)


def strip_html(c: Column | str) -> Column:
    """The text without its tags and without blanks at the ends; '' for NULL."""
    return F.trim(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), TAG, ""))


def py_capitalize(c: Column | str) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    c = as_col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def py_title_words(c: Column | str) -> Column:
    """``s.replace('_', ' ').title()`` for space/underscore separated words.

    Python's ``title`` also capitalises after digits and punctuation; state
    codes are lower-case letters and underscores, where both agree."""
    return F.initcap(F.replace(as_col(c), F.lit("_"), F.lit(" ")))


def py_float_text(c: Column | str) -> Column:
    """Python ``'%s' % float``: '2.0', '12345678.0', '1e-05', '1e+16'.

    Python writes magnitudes from 1e-4 to below 1e16 out, others with an exponent of at
    least two digits; Spark switches at 1e-3 and 1e7, so the first go through a decimal
    and the others rearrange Spark's text."""
    x = as_col(c).cast("double")
    text = x.cast("string")
    plain = (x == 0) | ((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16))
    full = F.regexp_replace(F.when(plain, x).cast("decimal(38,21)").cast("string"), "0+$", "")
    full = F.when(full.endswith("."), F.concat(full, F.lit("0"))).otherwise(full)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1)
    sign = F.when(power.startswith("-"), F.lit("e-")).otherwise(F.lit("e+"))
    digits = F.regexp_replace(power, "-", "")
    wide = F.concat(mantissa, sign, F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits))
    return (F.when(x.isNull(), F.lit(None)).when(F.isnan(x), F.lit("nan"))
            .when(F.abs(x) == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when(text == "-0.0", text).when(text.contains("E") & ~plain, wide).otherwise(full))
