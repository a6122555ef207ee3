"""Column expressions with the null rules of a statistics package.

Each function takes and returns Columns, so it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

AMOUNT_SCALE = 6  # digits after the point for amounts, up to 10^12
LOADING_SCALE = 15  # for loadings and shares, up to 10^7


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice that stays NULL where the condition is NULL."""
    return F.when(condition, yes).when(~condition, no)


def in_set(c: Column | str, values: Sequence) -> Column:
    """Set membership that is never NULL: a missing value is in no set."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def first_match(c: Column | str, pattern: str) -> Column:
    """First substring matching the pattern, NULL where nothing matches."""
    return F.regexp_substr(col(c), F.lit(pattern))


def matches_any(c: Column | str, patterns: Sequence[str]) -> Column:
    """True where any of the patterns is found."""
    return col(c).rlike("|".join(f"(?:{p})" for p in patterns))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def to_number(c: Column | str) -> Column:
    """Text to double; unparsable text becomes NULL."""
    return col(c).try_cast("double")


def to_fixed(c: Column | str, scale: int = AMOUNT_SCALE) -> Column:
    """Decimal with `scale` digits: sums are exact, so a comparison with a mean has no rounding ties."""
    return col(c).cast(DecimalType(18 if scale <= 6 else scale + 7, scale))


def exact(df: DataFrame, c: str, scale: int = AMOUNT_SCALE) -> Column:
    """The column as a decimal: unchanged if it is one, `scale` digits if it is a float, six otherwise."""
    kind = df.schema[c].dataType
    if isinstance(kind, DecimalType):
        return F.col(c)
    return to_fixed(c, scale if isinstance(kind, (DoubleType, FloatType)) else AMOUNT_SCALE)


def mean_type(df: DataFrame, c: str, scale: int = AMOUNT_SCALE) -> DecimalType:
    """One digit more than `exact` has, for a mean of a few columns."""
    kind = df.select(exact(df, c, scale)).schema[0].dataType
    return DecimalType(min(38, kind.precision + 1), kind.scale + 1)


def reaches_mean(value: Column, total: Column, n: Column) -> Column:
    """value >= total / n without the division, exact in decimals."""
    return value * n.cast("decimal(15,0)") >= total


def percent(part: Column | str, whole: Column | str) -> Column:
    """part / whole * 100 as double; NULL where the whole is zero."""
    return F.try_divide(col(part).cast("double"), col(whole).cast("double")) * 100


def years_between(year: Column | str, start: Column | str) -> Column:
    """Whole years from the year that starts one text to the year in another."""
    begin = first_match(start, "[0-9]{1,4}")
    return (to_number(year) - to_number(begin)).cast("long")


def any_flag(columns: Sequence[Column | str]) -> Column:
    """1 if any flag is 1, NULL if none is 1 and one is missing, otherwise 0."""
    flags = [col(c) for c in columns]
    any_missing = reduce(or_, [f.isNull() for f in flags])
    any_one = reduce(or_, [F.coalesce(f == 1, F.lit(False)) for f in flags])
    return F.when(any_one, 1).when(any_missing, None).otherwise(0).cast("int")


def digest_number(*columns: Column | str, seed: int, modulus: int = 10_000) -> Column:
    """Number in [0, modulus) that depends on the values and the seed alone.

    A row keeps its number however the data are partitioned or retried.
    """
    parts = [F.lit(str(seed))] + [F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10)
    return F.pmod(digits.cast("long"), F.lit(modulus))
