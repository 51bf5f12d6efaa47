"""The query of a plan as text with named parameters: evidence for readers, never executed."""

from __future__ import annotations

from datetime import date
from typing import Any

from ..model import AggregatePlan, ChangePlan, Measure, Plan, RankPlan, SharePlan, Slice


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def _value(measure: Measure) -> str:
    x = "COUNT(*)" if measure.column is None else f"{measure.agg.upper()}({_name(measure.column)})"
    return x if measure.round is None or measure.agg == "count" else f"ROUND({x}, :digits)"


def _where(time: str, rows: Slice, tag: str, params: dict[str, Any]) -> str:
    params |= {f"{tag}start": rows.period.start, f"{tag}end": rows.period.end}
    out = f"{_name(time)} >= :{tag}start AND {_name(time)} < :{tag}end"
    if rows.column is not None:
        params["entity"] = rows.value
        out += f" AND {_name(rows.column)} = :entity"
    return out


def render(plan: Plan, time: str) -> tuple[str, dict[str, Any]]:
    params: dict[str, Any] = {}
    v = _value(plan.measure)
    if ":digits" in v:
        params["digits"] = plan.measure.round
    used = "COUNT(*)" if plan.measure.column is None else f"COUNT({_name(plan.measure.column)})"
    if isinstance(plan, AggregatePlan):
        return f"SELECT {v} AS value, COUNT(*) AS n_rows, {used} AS n_used FROM data WHERE {_where(time, plan.rows, '', params)}", params
    if isinstance(plan, ChangePlan):
        now, then = _where(time, plan.current, "", params), _where(time, plan.baseline, "base_", params)
        sides = ", ".join(f"{_value(plan.measure)} FILTER (WHERE {w}) AS {n}" for n, w in (("current", now), ("baseline", then)))
        formula = "100.0 * (current - baseline) / NULLIF(baseline, 0)" if plan.kind == "growth" else "current - baseline"
        return f"SELECT {formula} AS value FROM (SELECT {sides} FROM data WHERE ({now}) OR ({then}))", params
    if isinstance(plan, SharePlan):
        period = _where(time, Slice(plan.rows.period), "", params)
        params["entity"] = plan.rows.value
        return f"SELECT 100.0 * part / NULLIF(whole, 0) AS value FROM (SELECT {v} FILTER (WHERE {_name(plan.rows.column)} = :entity) AS part, {v} AS whole FROM data WHERE {period})", params
    assert isinstance(plan, RankPlan)
    period = _where(time, Slice(plan.period), "", params)
    key = f"CAST({_name(plan.column)} AS STRING)"
    if plan.grain is not None:
        params["grain"] = plan.grain
        key = f"CAST(CAST(DATE_TRUNC(:grain, {_name(time)}) AS DATE) AS STRING)"
    order = f"value {'DESC' if plan.descending else 'ASC'} NULLS LAST"
    groups = f"SELECT {key} AS key, {v} AS value, COUNT(*) AS n_rows FROM data WHERE {period} GROUP BY 1"
    over = f"RANK() OVER (ORDER BY {order})"
    if plan.min_rows is not None:
        params["min_rows"] = plan.min_rows
        over = f"CASE WHEN n_rows >= :min_rows THEN RANK() OVER (PARTITION BY n_rows >= :min_rows ORDER BY {order}) END"
    return f"SELECT key, value, n_rows, {over} AS rank FROM ({groups}) WHERE key IS NOT NULL ORDER BY rank NULLS LAST, key", params


def display(sql: str, params: dict[str, Any]) -> str:
    """The parameters put in, longest name first."""
    for name in sorted(params, key=len, reverse=True):
        x = params[name]
        shown = f"DATE '{x}'" if isinstance(x, date) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
        sql = sql.replace(f":{name}", shown)
    return sql
