"""Rejections of wire claims, over tables of them, from the same rules as the driver's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KINDS, Rule, rules, wire_fields


def _broken(rule: Rule) -> Column:
    """Whether a field breaks its rule; where a column is null, a key that may be null is."""
    c = F.col(rule.name)
    out = [F.lit(False)]
    if not rule.null:
        out.append(c.isNull())
    if rule.allowed:
        out.append(~c.isin(*rule.allowed))
    if rule.least is not None:
        out.append((F.length(c) if rule.type is str else c) < rule.least)
    if rule.type is float:
        out.append(F.isnan(c) if rule.least is not None else F.lit(False))
    return F.coalesce(reduce(lambda x, y: x | F.coalesce(y, F.lit(False)), out), F.lit(False))


def rejections(claims: DataFrame) -> DataFrame:
    """Adds ``rejected`` to a table with all wire fields: unknown_type, foreign_field, invalid_claim, or null."""
    kind = F.col("type")
    any_of = lambda checks: reduce(lambda x, y: x | y, checks, F.lit(False))
    out = F.when(kind.isNull() | ~kind.isin(*KINDS), "unknown_type")
    for name in KINDS:
        own = rules(name)
        out = out.when((kind == name) & any_of(F.col(f).isNotNull() for f in wire_fields() if f not in own and f != "type"), "foreign_field")
    for name in KINDS:
        out = out.when((kind == name) & any_of(_broken(r) for r in rules(name).values()), "invalid_claim")
    return claims.withColumn("rejected", out)
