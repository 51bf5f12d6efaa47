"""Policies over a table of checked claims, as native expressions.

Input columns: claim_id, kind (point_value, share, growth, comparison, ranking), stated, decimals
(places as written), direction, polarity, computed. The driver's decimal policy is authoritative;
this form is for tables too large to bring there, and agrees wherever both sides have at most 15
decimals and 22 whole digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(38,15)"


def _within(stated: Column, computed: Column, decimals: Column) -> Column:
    delta = F.abs(stated.cast(EXACT) - computed.cast(EXACT))
    return delta * F.lit(2) <= F.pow(F.lit(10.0), -decimals.cast("double")).cast(EXACT)


def verdicts(claims: DataFrame) -> DataFrame:
    """Adds verdict, policy and abstain_reason."""
    kind, stated, computed, direction = (F.col(c) for c in ("kind", "stated", "computed", "direction"))
    better_up = F.coalesce(F.col("polarity") == "higher_is_better", F.lit(False))
    up = F.when(direction.isin("increase", "higher"), True).when(direction.isin("decrease", "lower"), False).when(direction == "better", better_up).when(direction == "worse", ~better_up)
    turned = kind.isin("growth", "comparison")
    wrong_way = turned & ~F.when(up, computed > 0).otherwise(computed < 0)
    reason = (
        F.when(direction == "unchanged", "ambiguous")
        .when(kind.isin("point_value", "share", "growth") & stated.isNull(), "ambiguous")
        .when(direction.isin("better", "worse") & F.col("polarity").isNull(), "schema_gap")
        .when(computed.isNull(), "no_data")
    )
    passes = F.when(kind == "ranking", stated == computed).when(stated.isNull(), True).otherwise(_within(stated, F.when(turned, F.abs(computed)).otherwise(computed), F.col("decimals")))
    policy = F.when(kind == "ranking", "rank").when(wrong_way | stated.isNull(), "direction").otherwise("half_ulp")
    return claims.withColumn("abstain_reason", reason).withColumn("verdict", F.when(F.col("abstain_reason").isNotNull(), "UNVERIFIABLE").when(wrong_way, "FAIL").when(passes, "PASS").otherwise("FAIL")).withColumn("policy", F.when(F.col("abstain_reason").isNull(), policy))


def exit_code(verdict_table: DataFrame, *, strict: bool = False, unextracted: int = 0) -> int:
    """1 if anything failed (strict: also if anything could not be verified), else 0."""
    counts = {r["verdict"]: r["count"] for r in verdict_table.groupBy("verdict").count().collect()}
    return int(bool(counts.get("FAIL")) or (strict and bool(counts.get("UNVERIFIABLE") or unextracted)))
