"""Aggregate expressions with fixed rounding and typing, whatever the input type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Measure, Period, Slice


def quoted(name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def rounded(x: Column, digits: int | None) -> Column:
    """Half away from zero on the scaled double, which is what SQL engines with binary rounding give."""
    if digits is None:
        return x
    scale = F.lit(float(10**digits))
    return F.round(x * scale) / scale


def in_period(time: str, period: Period) -> Column:
    t = quoted(time)
    return (t >= F.lit(period.start)) & (t < F.lit(period.end))


def in_slice(time: str, rows: Slice) -> Column:
    p = in_period(time, rows.period)
    return p if rows.column is None else p & (quoted(rows.column) == F.lit(rows.value))


def total(x: Column, kind: T.DataType, exact: bool = False) -> Column:
    """A sum as double. Whole numbers and decimals are added exactly; doubles too, to 10 decimals, if ``exact``."""
    if isinstance(kind, T.IntegralType):
        return F.sum(x.cast("decimal(38,0)")).cast("double")
    if isinstance(kind, T.DecimalType):
        return F.sum(x).cast("double")
    if exact:
        return F.sum(x.cast("decimal(38,10)")).cast("double")
    return F.sum(x.cast("double"))


def value(measure: Measure, kinds: dict[str, T.DataType], where: Column | None = None, exact: bool = False) -> Column:
    """The measure over all rows, or over those that satisfy ``where`` (in one scan with others)."""
    kept = lambda x: x if where is None else F.when(where, x)
    if measure.agg == "count":
        return F.count(kept(F.lit(1) if measure.column is None else quoted(measure.column)))
    x = quoted(measure.column)
    kind = kinds[measure.column]
    got = total(kept(x), kind, exact) if measure.agg == "sum" else F.avg(kept(x).cast("double"))
    if measure.agg == "avg" and exact:
        got = total(kept(x), kind, True) / F.nullif(F.count(kept(x)), F.lit(0))
    return rounded(got, measure.round)


def used(measure: Measure, where: Column | None = None) -> Column:
    """Rows that the measure really uses: those with a value in its column."""
    x = F.lit(1) if measure.column is None else quoted(measure.column)
    return F.count(x if where is None else F.when(where, x))


def rows(where: Column | None = None) -> Column:
    return F.count(F.lit(1) if where is None else F.when(where, F.lit(1)))
