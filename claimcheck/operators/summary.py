"""Multi-metric summaries: national, per quarter with change on the row before, per entity with share and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..model import Config, Measure
from .verification import kinds, percent


def _measures(df: DataFrame, config: Config) -> dict:
    k = kinds(df)
    return {name: M.value(Measure("count" if m.agg == "share" else m.agg, m.column, m.round), k).cast("double").alias(name) for name, m in config.metrics.items() if m.agg != "share"}


def national(df: DataFrame, config: Config) -> DataFrame:
    return df.agg(*_measures(df, config).values())


def by_quarter(df: DataFrame, config: Config) -> DataFrame:
    """period, each metric, and its percentage change on the previous row (not the previous calendar quarter)."""
    got = df.groupBy(F.date_trunc("quarter", M.quoted(config.time_column)).cast("date").alias("period")).agg(*_measures(df, config).values())
    before = Window.orderBy("period")
    changes = [percent(F.col(n) - F.lag(n).over(before), F.lag(n).over(before)).alias(f"{n}_change") for n in _measures(df, config)]
    return got.select("*", *changes).orderBy("period")


def by_entity(df: DataFrame, config: Config, dim: str) -> DataFrame:
    """key, each metric, share of rows, and each metric's rank among values that are not null (largest first)."""
    got = df.groupBy(M.quoted(config.entities[dim].column).cast("string").alias("key")).agg(*_measures(df, config).values(), F.count(F.lit(1)).alias("n_rows"))
    share = percent(F.col("n_rows"), F.sum("n_rows").over(Window.partitionBy())).alias("row_share")
    got = got.where(F.col("key").isNotNull()).select("*", share)
    for n in _measures(df, config):
        over = Window.partitionBy(F.col(n).isNull()).orderBy(F.col(n).desc())
        got = got.withColumn(f"{n}_rank", F.when(F.col(n).isNotNull(), F.rank().over(over).cast("long")))
    return got.orderBy("key")
