"""Row-wise numbers in which missing stays missing: NaN and infinities are NULL, no division or cast raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPLOYED_SENTINEL = 365243


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    wide = x.cast("double")
    return F.when(F.isnan(wide) | (F.abs(wide) == float("inf")), None).otherwise(x)


def clean(df: DataFrame) -> DataFrame:
    """All floating columns finite or NULL."""
    return df.withColumns({c: finite(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def float32(x: Column) -> Column:
    return finite(x.try_cast("float"))


def safe_divide(num: Column, den: Column) -> Column:
    """A float32 quotient; NULL where a side is missing or the denominator is 0. Nothing is clipped."""
    return finite(F.try_divide(float32(num), float32(den)).cast("float"))


def plain_divide(num: Column, den: Column) -> Column:
    """The same in double precision."""
    return finite(F.try_divide(num.cast("double"), den.cast("double")))


def float_difference(a: Column, b: Column) -> Column:
    return finite((float32(a) - float32(b)).cast("float"))


def flag(predicate: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.coalesce(predicate, F.lit(False)).cast("tinyint")


def without_sentinel(x: Column, sentinel: int = EMPLOYED_SENTINEL) -> Column:
    return finite(F.when(x == sentinel, None).otherwise(x))


def at_least_zero(x: Column) -> Column:
    """Clamped at 0; missing stays missing."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0).cast("double")))


def observed(*columns: Column) -> Column:
    return F.filter(F.array(*[c.cast("double") for c in columns]), lambda x: x.isNotNull())


def row_count(*columns: Column) -> Column:
    return F.size(observed(*columns))


def _count_and_sum(columns: tuple[Column, ...]) -> tuple[Column, Column]:
    """How many are there, and their sum: plain arithmetic, so no array is built a row."""
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return count, reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])


def row_mean(*columns: Column) -> Column:
    count, total = _count_and_sum(columns)
    return F.when(count > 0, total / count)


def row_median(*columns: Column) -> Column:
    x = F.array_sort(observed(*columns))
    n = F.size(x)
    low, high = F.try_element_at(x, F.floor((n + 1) / 2).cast("int")), F.try_element_at(x, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


def row_min(*columns: Column) -> Column:
    each = [c.cast("double") for c in columns]
    return F.least(*each) if len(each) > 1 else each[0]


def row_max(*columns: Column) -> Column:
    each = [c.cast("double") for c in columns]
    return F.greatest(*each) if len(each) > 1 else each[0]


def row_std(*columns: Column) -> Column:
    """Of a sample; NULL for fewer than two."""
    count, total = _count_and_sum(columns)
    off = [c.cast("double") - total / F.nullif(count, F.lit(0)) for c in columns]
    squares = reduce(lambda a, b: a + b, [F.coalesce(x * x, F.lit(0.0)) for x in off])
    return F.when(count > 1, F.sqrt(squares / (count - 1)))


def row_product(*columns: Column, least: int = 2) -> Column:
    x = observed(*columns)
    return F.when(F.size(x) >= least, F.aggregate(x, F.lit(1.0), lambda a, v: a * v))


def row_sum(*columns: Column, least: int = 0) -> Column:
    """Missing counts as 0; NULL where fewer than ``least`` are there."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    return F.when(row_count(*columns) >= least, total) if least else total


def pair_features(names: list[str]) -> dict[str, Column]:
    """For each pair of columns the difference and both quotients."""
    out = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            out[f"{a}_MINUS_{b}"] = F.col(a) - F.col(b)
            out[f"{a}_DIV_{b}"] = plain_divide(F.col(a), F.col(b))
            out[f"{b}_DIV_{a}"] = plain_divide(F.col(b), F.col(a))
    return out


def starting_with(df: DataFrame, prefix: str) -> list[str]:
    """The columns of ``prefix``; there must be one."""
    names = [c for c in df.columns if c.startswith(prefix)]
    if not names:
        raise ValueError(f"no column starts with {prefix!r}")
    return names


def require(df: DataFrame, names: list[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def assert_finite(df: DataFrame) -> None:
    """Raise if a floating column holds an infinity: one aggregate over all."""
    names = [c for c, t in df.dtypes if t in ("double", "float")]
    if not names:
        return
    row = df.agg(*[F.max(F.abs(F.col(c)) == float("inf")).alias(c) for c in names]).first()
    bad = [c for c in names if row[c]]
    if bad:
        raise ValueError(f"infinite values in {bad}")
