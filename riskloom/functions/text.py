"""Display formats (SC19-SC21 and friends) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TIME = "—"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_inr(amount, symbol: str = "₹") -> Column:
    """Indian digit grouping (12,34,567.5): last three digits, then pairs;
    up to three fraction digits with trailing zeros dropped; null -> 0."""
    v = F.coalesce(_c(amount), F.lit(0.0))
    txt = F.format_string("%.3f", F.round(F.abs(v), 3))
    int_part = F.substring_index(txt, ".", 1)
    frac = F.regexp_replace(F.substring_index(txt, ".", -1), "0+$", "")
    n = F.length(int_part)
    head = F.substring(int_part, F.lit(1), n - 3)
    tail = F.substring(int_part, n - 2, F.lit(3))
    grouped_head = F.reverse(F.regexp_replace(F.regexp_replace(F.reverse(head), r"(\d\d)", "$1,"), ",$", ""))
    grouped = F.when(n > 3, F.concat(grouped_head, F.lit(","), tail)).otherwise(int_part)
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    body = F.concat(sign, grouped, F.when(F.length(frac) > 0, F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    return F.concat(F.lit(symbol), body)


def format_pct(fraction, digits: int = 1) -> Column:
    """fraction -> '12.3%' (formats the rounded value)."""
    v = F.coalesce(_c(fraction), F.lit(0.0)) * 100
    return F.format_string(f"%.{digits}f%%", F.round(v, digits))


def format_fixed(x, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f", F.round(F.coalesce(_c(x), F.lit(0.0)), digits))


def format_time(ts) -> Column:
    """'05 Jan, 03:07 pm' style; placeholder when missing."""
    t = _c(ts)
    txt = F.concat(F.date_format(t, "dd MMM, hh:mm "), F.lower(F.date_format(t, "a")))
    return F.coalesce(txt, F.lit(NO_TIME))


def number_text(x) -> Column:
    """Plain text of a number as a browser prints it for search: integral values
    without a decimal point; 0 and null as empty text."""
    v = _c(x)
    # the shortest decimal form, written out without an exponent
    plain = F.regexp_replace(v.cast("string").try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return (F.when(v.isNull() | (v == 0), F.lit(""))
            .otherwise(F.coalesce(plain, v.cast("string"))))
