"""Missing-value rules that differ from Spark's defaults.

The statistics follow the convention that an unknown condition gives an
unknown result, that membership tests never do, and that text which is not a
number becomes missing instead of an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def if_known(cond: Column, yes, no) -> Column:
    """``yes`` or ``no``; NULL where the condition itself is NULL."""
    return F.when(cond, yes).when(~cond, no)


def flag(cond: Column) -> Column:
    """1 or 0; NULL where the condition is NULL."""
    return cond.cast("int")


def is_member(col: Column, values: Iterable) -> Column:
    """Membership that is FALSE, not NULL, for a missing value."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def not_member(col: Column, values: Iterable) -> Column:
    """Negated membership that keeps rows with a missing value."""
    return ~is_member(col, values)


def to_number(col: Column) -> Column:
    """Text to double; anything that is not a number, and NaN, is NULL."""
    # Java also reads "1d" and "2f" as numbers; no decimal number holds those letters.
    text = F.translate(F.trim(col.cast("string")), "dDfF", "????")
    return nan_to_null(text.try_cast("double"))


def nan_to_null(col: Column) -> Column:
    return F.nanvl(col, F.lit(None).cast("double"))


def numeric_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Coerce the listed columns to double."""
    return df.withColumns({n: to_number(F.col(n)) for n in names})


def null_tokens(df: DataFrame, tokens: Sequence[str] = ("NA", "")) -> DataFrame:
    """Turn null tokens in string columns into NULL, and NaN in doubles."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            value = c
            for token in tokens:
                probe = F.trim(value) if token == "" else value
                value = F.when(probe != F.lit(token), value)
            c = value
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def blank_nulls(df: DataFrame) -> DataFrame:
    """Every column as text with missing values blank; for exports only."""
    return df.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    )


def ratio(num: Column, den: Column) -> Column:
    """Division that is NULL, not an error, at a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))
