"""String helpers (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkstream.constants import CODE_PATTERN, DEFAULT_COUNTRY


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def default_if_empty(col, default: str) -> Column:
    """Empty or NULL -> ``default``."""
    return F.coalesce(F.nullif(_c(col), F.lit("")), F.lit(default))


def default_country(col, default: str = DEFAULT_COUNTRY) -> Column:
    return default_if_empty(col, default)


def valid_code(col, pattern: str = CODE_PATTERN) -> Column:
    c = _c(col)
    return c.isNotNull() & c.rlike(pattern)


def strip_scheme(col) -> Column:
    return F.regexp_replace(_c(col), r"^https?://", "")


def replace_literal(col, old: str, new: str) -> Column:
    """Every ``old`` becomes ``new``; no character of ``old`` is a pattern."""
    return F.replace(_c(col), F.lit(old), F.lit(new))


def build_short_url(base, code) -> Column:
    """``base/code``; a trailing slash on the base is not doubled."""
    b = F.regexp_replace(_c(base), "/+$", "")
    return F.concat(b, F.lit("/"), _c(code))


def blank(col) -> Column:
    c = _c(col)
    return c.isNull() | (c == F.lit(""))


def display_date(col) -> Column:
    """``Mar 14, 2026`` style date."""
    return F.date_format(_c(col), "MMM d, yyyy")


def display_count(col) -> Column:
    """Integer with thousands separators."""
    return F.format_number(_c(col), 0)


def valid_enum(col, allowed) -> Column:
    """Value in the allowed list (NULL is not allowed)."""
    c = _c(col)
    return c.isNotNull() & c.isin(list(allowed))
