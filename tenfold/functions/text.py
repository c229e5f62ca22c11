"""Report strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_number(col: Column, digits: int = 3) -> Column:
    """Rounded number without trailing zeros: ``0.5``, ``0``, ``-1.25``; ``NA`` where missing."""
    fixed = F.format_string(f"%.{digits}f", F.round(col, digits))
    trimmed = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")
    return F.when(col.isNull(), "NA").when(trimmed == "-0", "0").otherwise(trimmed)


def estimate_text(value: Column, spread: Column, stars: Column | None = None) -> Column:
    parts = [short_number(value), F.lit(" ("), short_number(spread), F.lit(")")]
    return F.concat(*parts, *([stars] if stars is not None else []))
