"""A slice cube: the fact table rolled up once to days and dimensions, from which claims are answered.

Periods are whole days and the measures are sums, counts and averages, so rows, sums and counts
by (day, dimension values) suffice for every plan; cubes of disjoint rows add up by union. A
thousand claims over a very large table cost one scan of it; later claims read only the cube.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import measures as M
from ..model import Computed, Config, Measure, Plan, RankPlan, Slice
from ..sources.dataset import Dataset
from .lowering import answer, ranked, ranking, slices

DAY = "day"


def _columns(config: Config) -> list[str]:
    return sorted({m.column for m in config.metrics.values() if m.column is not None})


def _dims(config: Config) -> list[str]:
    return sorted({e.column for e in config.entities.values()})


def build(ds: Dataset, config: Config) -> DataFrame:
    """day, d0, d1, ... (dimension values as strings), n, and per measure column u0, s0, ...: rows with a value and their sum.

    Partial aggregation keeps the shuffle to one row per day and combination of each task.
    Doubles are added as decimal(38,10), so a cube does not depend on how rows are dealt out.
    """
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(_columns(config)):
        x = M.quoted(c)
        kind = ds.columns[c]
        exact = x.cast("decimal(38,10)") if isinstance(kind, (T.FractionalType, T.IntegralType)) else F.lit(None).cast("decimal(38,10)")
        aggregates += [F.count(x).alias(f"u{k}"), F.sum(exact).alias(f"s{k}")]
    keys = [M.quoted(config.time_column).cast("date").alias(DAY), *(M.quoted(d).cast("string").alias(f"d{k}") for k, d in enumerate(_dims(config)))]
    return ds.df.groupBy(*keys).agg(*aggregates)


def _value(measure: Measure, config: Config, where: Column | None = None) -> tuple[Column, Column, Column]:
    """(value, rows, used rows) from cube rows."""
    kept = lambda x: F.sum(x if where is None else F.when(where, x))
    n = F.coalesce(kept(F.col("n")), F.lit(0)).cast("long")
    if measure.column is None:
        return n.cast("double"), n, n
    k = _columns(config).index(measure.column)
    used = F.coalesce(kept(F.col(f"u{k}")), F.lit(0)).cast("long")
    if measure.agg == "count":
        return used.cast("double"), n, used
    total = kept(F.col(f"s{k}")).cast("double")
    value = total if measure.agg == "sum" else total / F.nullif(used, F.lit(0))
    return M.rounded(value, measure.round), n, used


def _inside(rows: Slice, config: Config) -> Column:
    p = M.in_period(DAY, rows.period)
    return p if rows.column is None else p & (F.col(f"d{_dims(config).index(rows.column)}") == F.lit(rows.value))


def execute(cube: DataFrame, config: Config, plans: list[Plan]) -> list[Computed]:
    """As lowering.execute, from a cube (or a union of cubes)."""
    time = config.time_column
    wanted = list(dict.fromkeys(s for p in plans for s in slices(p)))
    got = {}
    for a in range(0, len(wanted), 300):
        some = wanted[a : a + 300]
        row = cube.agg(*(x.alias(f"{t}{k}") for k, (m, s) in enumerate(some) for t, x in zip("vnu", _value(m, config, _inside(s, config))))).first()
        got |= {key: (row[f"v{k}"], row[f"n{k}"], row[f"u{k}"]) for k, key in enumerate(some)}
    out = []
    for p in plans:
        if not isinstance(p, RankPlan):
            out.append(answer(p, [got[s] for s in slices(p)], time))
            continue
        key = F.date_trunc(p.grain, DAY).cast("date").cast("string") if p.grain else F.col(f"d{_dims(config).index(p.column)}")
        v, n, _ = _value(p.measure, config)
        groups = cube.where(M.in_period(DAY, p.period)).groupBy(key.alias("key")).agg(v.cast("double").alias("value"), n.alias("n_rows")).where("key is not null")
        out.append(ranked(p, ranking(groups, p, [p.key]), time))
    return out
