"""The five plans as DataFrames: one scan each, filters pushed to the source.

``aggregate``, ``change``, ``rank`` and ``share`` return small tables; nothing here collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import measures as M
from ..model import AggregatePlan, ChangePlan, RankPlan, SharePlan


def _double(x: Column) -> Column:
    return x.cast("double")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole in doubles, null where whole is 0."""
    return F.lit(100.0) * _double(part) / F.nullif(_double(whole), F.lit(0.0))


def kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def aggregate(df: DataFrame, time: str, plan: AggregatePlan, *, exact: bool = False) -> DataFrame:
    """value, n_rows, n_used of one slice."""
    return df.where(M.in_slice(time, plan.rows)).agg(_double(M.value(plan.measure, kinds(df), exact=exact)).alias("value"), M.rows().alias("n_rows"), M.used(plan.measure).alias("n_used"))


def change(df: DataFrame, time: str, plan: ChangePlan, *, exact: bool = False) -> DataFrame:
    """current, baseline, value, n_current, n_baseline; the two periods may overlap and share one scan."""
    now, then = M.in_slice(time, plan.current), M.in_slice(time, plan.baseline)
    both = df.where(now | then).agg(
        _double(M.value(plan.measure, kinds(df), now, exact)).alias("current"),
        _double(M.value(plan.measure, kinds(df), then, exact)).alias("baseline"),
        M.rows(now).alias("n_current"),
        M.rows(then).alias("n_baseline"),
    )
    difference = F.col("current") - F.col("baseline")
    return both.select("current", "baseline", (percent(difference, F.col("baseline")) if plan.kind == "growth" else difference).alias("value"), "n_current", "n_baseline")


def group_key(time: str, plan: RankPlan) -> Column:
    if plan.grain is None:
        return M.quoted(plan.column).cast("string")
    return F.date_trunc(plan.grain, M.quoted(time)).cast("date").cast("string")


def groups(df: DataFrame, time: str, plan: RankPlan, *, exact: bool = False) -> DataFrame:
    """key, value, n_rows of the groups of a ranking; null keys are left out."""
    return df.where(M.in_period(time, plan.period)).groupBy(group_key(time, plan).alias("key")).agg(_double(M.value(plan.measure, kinds(df), exact=exact)).alias("value"), M.rows().alias("n_rows")).where(F.col("key").isNotNull())


def rank(df: DataFrame, time: str, plan: RankPlan, *, exact: bool = False) -> DataFrame:
    """key, value, n_rows, rank, ordered by rank (nulls last) and key.

    Null keys are dropped before ranking, null values rank last, ties share a rank and leave a
    gap. With ``min_rows`` thinner groups are returned unranked. The window holds one row a group,
    all in one task: this is for whole rankings; claims need less (plans.lowering.ranking).
    """
    found = groups(df, time, plan, exact=exact)
    order = F.col("value").desc_nulls_last() if plan.descending else F.col("value").asc_nulls_last()
    if plan.min_rows is None:
        ranked = found.withColumn("rank", F.rank().over(Window.orderBy(order)).cast("long"))
    else:
        enough = F.col("n_rows") >= plan.min_rows
        ranked = found.withColumn("enough", enough).withColumn("rank", F.when(F.col("enough"), F.rank().over(Window.partitionBy("enough").orderBy(order)).cast("long"))).drop("enough")
    return ranked.orderBy(F.col("rank").asc_nulls_last(), "key")


def share(df: DataFrame, time: str, plan: SharePlan, *, exact: bool = False) -> DataFrame:
    """part, whole, value (percent), n_part, n_rows; part and whole share one scan of the period."""
    mine = M.quoted(plan.rows.column) == F.lit(plan.rows.value)
    both = df.where(M.in_period(time, plan.rows.period)).agg(
        _double(M.value(plan.measure, kinds(df), mine, exact)).alias("part"), _double(M.value(plan.measure, kinds(df), exact=exact)).alias("whole"), M.rows(mine).alias("n_part"), M.rows().alias("n_rows")
    )
    return both.select("part", "whole", percent(F.col("part"), F.col("whole")).alias("value"), "n_part", "n_rows")
