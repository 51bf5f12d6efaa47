"""Many plans over one table in few jobs: scan sharing before Catalyst sees the query.

Scalar plans (aggregate, change, share) ask for measures over slices: whole days, and at most one
value of a dimension. All of them are answered by one grouped scan, by days (or months, where every
period is of whole months) and by the values asked for, with the union of the periods as a filter
that reaches the source. What comes back is bounded by the calendar and the question, not by the
data, and is added up on the driver, exactly. Where very many combinations of values are asked
for, conditional aggregates in jobs of ``width`` do the same. Ranking plans that differ only in
the asked key are one ranking, and rankings of one dimension share one grouped job.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import measures as M
from ..model import AggregatePlan, ChangePlan, Computed, Measure, Plan, RankPlan, SharePlan, Slice
from ..operators import verification as V
from ..sources.dataset import Dataset
from . import evidence

WIDTH = 300
#: A grouped scan is made for at most so many combinations of asked values, and values of one dimension.
COMBINATIONS, VALUES = 10_000, 500
#: Groups of a ranking that may come to the driver.
FEW_GROUPS = 10_000
#: Rows (a group in a period) that may come where several rankings share a scan.
MANY_GROUPS = 100_000


def slices(plan: Plan) -> list[tuple[Measure, Slice]]:
    """The (measure, slice) pairs that answer a scalar plan, in the order of its formula."""
    if isinstance(plan, AggregatePlan):
        return [(plan.measure, plan.rows)]
    if isinstance(plan, ChangePlan):
        return [(plan.measure, plan.current), (plan.measure, plan.baseline)]
    if isinstance(plan, SharePlan):
        return [(plan.measure, plan.rows), (plan.measure, Slice(plan.rows.period))]
    return []


def _ratio(part: float | None, whole: float | None) -> float | None:
    return None if part is None or not whole else 100.0 * part / whole


def answer(plan: Plan, got: list[tuple[float | None, int, int]], time: str) -> Computed:
    """A scalar plan's result from its slices' (value, rows, used)."""
    sql, params = evidence.render(plan, time)
    if isinstance(plan, AggregatePlan):
        (value, n, used), counts = got[0], {}
        return Computed(value, {"n_rows": n, "n_used": used}, sql=sql, params=params)
    (a, n, _), (b, m, _) = got
    if isinstance(plan, SharePlan):
        return Computed(_ratio(a, b), {"n_part": n, "n_rows": m}, sql=sql, params=params)
    counts = {"n_current": n, "n_baseline": m}
    if a is None or b is None:
        return Computed(None, counts, sql=sql, params=params)
    return Computed(_ratio(a - b, b) if plan.kind == "growth" else a - b, counts, sql=sql, params=params)


def scalars(ds: Dataset, time: str, wanted: list[tuple[Measure, Slice]], *, exact: bool = False, width: int = WIDTH) -> dict[tuple[Measure, Slice], tuple[float | None, int, int]]:
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return {}
    values: dict[str, list[str]] = {}
    for _, r in wanted:
        if r.column is not None and r.value not in values.setdefault(r.column, []):
            values[r.column].append(r.value)
    if math.prod(len(v) + 1 for v in values.values()) <= COMBINATIONS and all(len(v) <= VALUES for v in values.values()):
        return _grouped(ds, time, wanted, values, exact)
    out: dict[tuple[Measure, Slice], tuple[float | None, int, int]] = {}
    for a in range(0, len(wanted), width):
        some = wanted[a : a + width]
        row = batch_frame(ds, time, some, exact=exact).first()
        for k, key in enumerate(some):
            v = row[f"v{k}"]
            out[key] = (None if v is None else float(v), row[f"n{k}"], row[f"u{k}"])
    return out


def _reach(time: str, wanted: list[tuple[Measure, Slice]]) -> Column:
    """Rows of any of the periods, as few ranges as these make."""
    merged: list[list] = []
    for p in sorted({r.period for _, r in wanted}, key=lambda p: (p.start, p.end)):
        if merged and p.start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], p.end)
        else:
            merged.append([p.start, p.end])
    t = M.quoted(time)
    return reduce(lambda x, y: x | y, [(t >= F.lit(s)) & (t < F.lit(e)) for s, e in merged])


def grouped_frame(ds: Dataset, time: str, wanted: list[tuple[Measure, Slice]], values: dict[str, list[str]], *, exact: bool = False) -> tuple[DataFrame, list[str]]:
    """day, d0, d1, ... (which of the asked values a row has), n, and u0, s0, ... of each measured column; and these columns."""
    which = lambda column, asked: F.coalesce(*(F.when(M.quoted(column) == F.lit(v), F.lit(i)) for i, v in enumerate(asked)))
    return rolled(ds, time, wanted, [which(c, asked).alias(f"d{k}") for k, (c, asked) in enumerate(values.items())], exact)


def rolled(ds: Dataset, time: str, wanted: list[tuple[Measure, Slice]], by: list[Column], exact: bool) -> tuple[DataFrame, list[str]]:
    """The rows of any asked period, added up by days (months, where every period is of whole months) and ``by``."""
    months = all(d.day == 1 for _, r in wanted for d in (r.period.start, r.period.end))
    t = M.quoted(time)
    keys = [(F.date_trunc("month", t) if months else t).cast("date").alias("day"), *by]
    columns = sorted({m.column for m, _ in wanted if m.column is not None})
    sums = {m.column for m, _ in wanted if m.agg != "count"}
    aggregates = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(columns):
        x, kind = M.quoted(c), ds.columns[c]
        aggregates.append(F.count(x).alias(f"u{k}"))
        if c in sums:
            as_ = "decimal(38,0)" if isinstance(kind, T.IntegralType) else None if isinstance(kind, T.DecimalType) else "decimal(38,10)" if exact else "double"
            aggregates.append(F.sum(x.cast(as_) if as_ else x).alias(f"s{k}"))
    return ds.df.where(_reach(time, wanted)).groupBy(*keys).agg(*aggregates), columns


def _grouped(ds: Dataset, time: str, wanted: list[tuple[Measure, Slice]], values: dict[str, list[str]], exact: bool) -> dict[tuple[Measure, Slice], tuple[float | None, int, int]]:
    df, columns = grouped_frame(ds, time, wanted, values, exact=exact)
    rows = df.collect()
    day = np.array([r["day"].toordinal() for r in rows], np.int64)
    which = {c: np.array([-1 if r[f"d{k}"] is None else r[f"d{k}"] for r in rows], np.int64) for k, c in enumerate(values)}
    at = {c: k for k, c in enumerate(columns)}
    n = np.array([r["n"] for r in rows], np.int64)
    used = {c: np.array([r[f"u{k}"] for r in rows], np.int64) for c, k in at.items()}
    out = {}
    for measure, s in wanted:
        inside = (day >= s.period.start.toordinal()) & (day < s.period.end.toordinal())
        if s.column is not None:
            inside &= which[s.column] == values[s.column].index(s.value)
        on = np.flatnonzero(inside)
        count, some = int(n[on].sum()), int((n if measure.column is None else used[measure.column])[on].sum())
        if measure.agg == "count":
            out[measure, s] = (float(some), count, some)
            continue
        parts = [x for i in on if (x := rows[i][f"s{at[measure.column]}"]) is not None]
        if not parts:
            out[measure, s] = (None, count, some)
            continue
        total = float(sum(parts, Decimal(0))) if isinstance(parts[0], Decimal) else math.fsum(parts)
        out[measure, s] = (_rounded(total if measure.agg == "sum" else total / some, measure.round), count, some)
    return out


def _rounded(x: float, digits: int | None) -> float:
    """As measures.rounded."""
    if digits is None or not math.isfinite(x):
        return x
    scale = float(10**digits)
    return float(Decimal(repr(x * scale)).quantize(Decimal(1), ROUND_HALF_UP)) / scale


def batch_frame(ds: Dataset, time: str, wanted: list[tuple[Measure, Slice]], *, exact: bool = False):
    """One row: value, rows and used rows (v0, n0, u0, v1, ...) of each pair, from one scan."""
    aggregates = []
    for k, (measure, rows) in enumerate(wanted):
        inside = M.in_slice(time, rows)
        aggregates += [M.value(measure, ds.columns, inside, exact).cast("double").alias(f"v{k}"), M.rows(inside).alias(f"n{k}"), M.used(measure, inside).alias(f"u{k}")]
    return ds.df.where(_reach(time, wanted)).agg(*aggregates)


class Ranking(NamedTuple):
    """What claims about one ranking need of it: rows, ranked and excluded groups, the first three, the rank of each asked key that is there (null: not ranked)."""

    n_rows: int
    n_groups: int
    n_excluded: int
    top: list[tuple[str, float | None, int | None]]
    ranks: dict[str, int | None]


def ranking(groups: DataFrame, plan: RankPlan, keys: list[str], *, few: int | None = None) -> Ranking:
    """One ranking of groups (key, value, n_rows), for all the keys that are asked about.

    A dimension of few groups comes to the driver and is sorted once. Of one with more, only the asked
    groups and the first three come; ranks are counts of better groups, made in one pass without a
    window over all groups.
    """
    few = FEW_GROUPS if few is None else few
    rows = groups.limit(few + 1).collect()
    if len(rows) <= few:
        return of_groups(plan, [(r["key"], r["value"], r["n_rows"]) for r in rows], keys)
    groups = groups.persist()
    try:
        enough = F.lit(True) if plan.min_rows is None else F.col("n_rows") >= plan.min_rows
        mine = {r["key"]: r for r in groups.where(F.col("key").isin(keys)).collect()}
        ranked = {k: r for k, r in mine.items() if plan.min_rows is None or r["n_rows"] >= plan.min_rows}
        values = sorted({r["value"] for r in ranked.values()} - {None})
        better = lambda v: F.col("value") > F.lit(v) if plan.descending else F.col("value") < F.lit(v)
        counted = [F.count_if(enough & better(v)).alias(f"b{i}") for i, v in enumerate(values)]
        sums = groups.agg(F.sum("n_rows").alias("n"), F.count_if(enough).alias("g"), F.count(F.lit(1)).alias("all"), F.count_if(enough & F.col("value").isNotNull()).alias("valued"), *counted).first()
        order = (F.desc_nulls_last if plan.descending else F.asc_nulls_last)("value")
        first = groups.where(enough).orderBy(order, "key").limit(3).collect()
    finally:
        groups.unpersist()
    place = {v: sums[f"b{i}"] + 1 for i, v in enumerate(values)} | {None: sums["valued"] + 1}
    top: list[tuple[str, float | None, int | None]] = []
    for i, r in enumerate(first):
        top.append((r["key"], r["value"], top[-1][2] if top and top[-1][1] == r["value"] else i + 1))
    return Ranking(sums["n"], sums["g"], sums["all"] - sums["g"], top, {k: place[r["value"]] if k in ranked else None for k, r in mine.items()})


def rankings(ds: Dataset, time: str, asked: dict[tuple, list[RankPlan]], *, exact: bool = False) -> dict[tuple, Ranking]:
    """All rankings. Several of one dimension share a scan: it is added up by days and groups, and the periods meet that."""
    out: dict[tuple, Ranking] = {}
    by: dict[tuple, list[tuple]] = {}
    for key, ps in asked.items():
        by.setdefault((ps[0].column, ps[0].grain), []).append(key)
    for keys in by.values():
        if len(keys) > 2:
            out |= _together(ds, time, {k: asked[k] for k in keys}, exact)
    for key, ps in asked.items():
        if key not in out:
            out[key] = ranking(V.groups(ds.df, time, ps[0], exact=exact), ps[0], sorted({p.key for p in ps}))
    return out


def _together(ds: Dataset, time: str, asked: dict[tuple, list[RankPlan]], exact: bool) -> dict[tuple, Ranking]:
    """Rankings of one dimension (or unit of time); none where there are too many groups for the driver."""
    plans = [ps[0] for ps in asked.values()]
    key = None if plans[0].grain else M.quoted(plans[0].column).cast("string").alias("key")
    df, columns = rolled(ds, time, [(p.measure, Slice(p.period)) for p in plans], [] if key is None else [key], exact)
    if key is None:
        df = df.withColumn("key", F.date_trunc(plans[0].grain, "day").cast("date").cast("string"))
    periods = sorted({p.period for p in plans}, key=lambda p: (p.start, p.end))
    spans = df.sparkSession.createDataFrame([(i, p.start, p.end) for i, p in enumerate(periods)], "i int, start date, end date")
    met = df.join(F.broadcast(spans), (F.col("day") >= F.col("start")) & (F.col("day") < F.col("end"))).where("key is not null")
    added = [c for c in df.columns if c not in ("day", "key")]
    rows = met.groupBy("i", "key").agg(*(F.sum(c).alias(c) for c in added)).limit(MANY_GROUPS + 1).collect()
    if len(rows) > MANY_GROUPS:
        return {}
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["i"], []).append(r)
    at = {c: k for k, c in enumerate(columns)}

    def value(r, m: Measure) -> float | None:
        used = r["n"] if m.column is None else r[f"u{at[m.column]}"]
        if m.agg == "count":
            return _rounded(float(used), m.round)
        total = r[f"s{at[m.column]}"]
        return None if total is None or not used else _rounded(float(total) if m.agg == "sum" else float(total) / used, m.round)

    return {k: of_groups(ps[0], [(r["key"], value(r, ps[0].measure), r["n"]) for r in found.get(periods.index(ps[0].period), [])], sorted({p.key for p in ps})) for k, ps in asked.items()}


def of_groups(plan: RankPlan, groups: list[tuple[str, float | None, int]], keys: list[str]) -> Ranking:
    """The same from (key, value, rows) of all groups, sorted once; groups of one value share a rank, those without one come last."""
    fit = [g for g in groups if plan.min_rows is None or g[2] >= plan.min_rows]
    fit.sort(key=lambda g: (g[1] is None, 0 if g[1] is None else -g[1] if plan.descending else g[1], g[0]))
    place: dict[float | None, int] = {}
    for i, g in enumerate(fit, 1):
        place.setdefault(g[1], i)
    there = {g[0]: g for g in groups}
    ranked = {g[0] for g in fit}
    return Ranking(sum(g[2] for g in groups), len(fit), len(groups) - len(fit), [(k, v, place[v]) for k, v, _ in fit[:3]], {k: place[there[k][1]] if k in ranked else None for k in keys if k in there})


def ranked(plan: RankPlan, found: Ranking, time: str) -> Computed:
    sql, params = evidence.render(plan, time)
    counts = {"n_rows": found.n_rows, "n_groups": found.n_groups}
    if plan.min_rows is not None:
        counts["n_groups_excluded"] = found.n_excluded
    rank = found.ranks.get(plan.key)
    return Computed(None if rank is None else float(rank), counts, found.top, sql, params, plan.key in found.ranks)


def execute(ds: Dataset, time: str, plans: list[Plan], *, exact: bool = False) -> list[Computed]:
    """Results of all plans, in their order."""
    got = scalars(ds, time, [s for p in plans for s in slices(p)], exact=exact)
    shared = lambda p: (p.measure, p.period, p.column, p.grain, p.descending, p.min_rows)
    asked: dict[tuple, list[RankPlan]] = {}
    for p in plans:
        if isinstance(p, RankPlan):
            asked.setdefault(shared(p), []).append(p)
    groups = rankings(ds, time, asked, exact=exact)
    return [ranked(p, groups[shared(p)], time) if isinstance(p, RankPlan) else answer(p, [got[s] for s in slices(p)], time) for p in plans]
