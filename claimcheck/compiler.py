"""A claim and a configuration to a plan, or to an abstention with its reason.

The rules are tried in a fixed order, for the first that fails gives the reason: metric, subject,
share, direction and value, periods, ranking; last of all, whether the sentence names the metric.
Each abstention carries the id of its rule (``row``) and the word at fault (``token``).
"""

from __future__ import annotations

from . import vocabulary
from .model import (
    Abstain,
    AggregatePlan,
    ChangePlan,
    Claim,
    Comparison,
    Config,
    Growth,
    Measure,
    Metric,
    Period,
    Plan,
    PointValue,
    Ranking,
    RankPlan,
    Share,
    SharePlan,
    Slice,
)
from .periods import PeriodError, parse_period, unit_grain
from .vocabulary import norm


class _Stop(Exception):
    def __init__(self, reason: str, row: str, detail: str, token: str | None = None) -> None:
        self.abstain = Abstain(reason, detail, row, token)


def compile_claim(claim: Claim, config: Config) -> Plan | Abstain:
    try:
        plan = _compile(claim, config)
        _names_metric(claim, config)
        return plan
    except _Stop as stop:
        return stop.abstain


def _compile(claim: Claim, config: Config) -> Plan:
    name = vocabulary.metric_index(config).get(norm(claim.metric))
    if name is None:
        raise _Stop("schema_gap", "M2", f"no metric is called {claim.metric!r}", claim.metric)
    metric = config.metrics[name]
    subject = _subject(claim.subject, config)
    order = _ranked_by(claim, config, name, metric) if isinstance(claim, Ranking) else None
    if isinstance(claim, Share):
        if metric.agg == "avg":
            raise _Stop("ambiguous", "X2", "a share of an average has no whole")
    elif metric.agg == "share" and not isinstance(claim, Ranking):
        raise _Stop("unsupported_claim_type", "X4", f"{name} is a share; only shares and ranks of it can be checked")
    if isinstance(claim, Comparison):
        if claim.direction == "unchanged":
            raise _Stop("ambiguous", "D1", "how close counts as unchanged is not said")
        if claim.direction in ("better", "worse") and metric.polarity is None:
            raise _Stop("schema_gap", "D4", f"{name} has no polarity, so better and worse mean nothing", name)
    if isinstance(claim, (PointValue, Share, Growth)) and claim.value is None:
        raise _Stop("ambiguous", {"point_value": "V1", "share": "V2", "growth": "V3"}[claim.type], "no figure is stated")
    if isinstance(claim, (Growth, Comparison)) and claim.baseline_period is None:
        raise _Stop("ambiguous", "V5", "no baseline is stated")
    period = _period(claim.period, "period")
    measure = Measure("count" if metric.agg == "share" else metric.agg, metric.column, metric.round)
    rows = Slice(period, *subject) if subject else Slice(period)
    if isinstance(claim, PointValue):
        return AggregatePlan(measure, rows)
    if isinstance(claim, Share):
        return SharePlan(measure, rows)
    if isinstance(claim, (Growth, Comparison)):
        baseline = _period(claim.baseline_period, "baseline")
        if baseline.start >= period.start:
            raise _Stop("ambiguous", "V6", "the baseline does not start before the period")
        kind = "growth" if isinstance(claim, Growth) else "compare"
        return ChangePlan(kind, measure, rows, Slice(baseline, rows.column, rows.value))
    return _rank(claim, config, metric, measure, period, subject, *order)


def _subject(said: str | None, config: Config) -> tuple[str, str] | None:
    if said is None:
        return None
    found = vocabulary.entity_index(config).get(norm(said))
    if found is None:
        raise _Stop("schema_gap", "E4", f"no entity is called {said!r}", said)
    dim, value = found
    return config.entities[dim].column, value


def _period(said: str | None, what: str) -> Period:
    if said is None:
        raise _Stop("ambiguous", "P6", f"no {what} is stated")
    try:
        return parse_period(said)
    except PeriodError as e:
        raise _Stop("ambiguous", "P7", f"{what}: {e}", said) from None


def _ranked_by(claim: Ranking, config: Config, name: str, metric: Metric) -> tuple[str | None, bool]:
    """(unit of time or None, whether the largest comes first)."""
    group = norm(claim.group_by)
    dims = {norm(d): d for d in config.entities}
    grain = group if group in vocabulary.TIME_UNITS else None
    if grain:
        if claim.subject is not None:
            raise _Stop("unsupported_claim_type", "G6", "a ranking of periods for one subject")
        if grain == "year":
            raise _Stop("no_data", "G7", "years are not ranked: no scope holds more than one")
    else:
        if group not in dims:
            raise _Stop("schema_gap", "G3", f"no entity is called {claim.group_by!r}", claim.group_by)
        if claim.subject is None:
            raise _Stop("ambiguous", "G4", "what is ranked is not said")
        dim, _ = vocabulary.entity_index(config)[norm(claim.subject)]
        if dim != dims[group]:
            raise _Stop("schema_gap", "G5", f"{claim.subject!r} is a {dim}, not a {dims[group]}", claim.subject)
    if claim.rank_from is None:
        raise _Stop("ambiguous", "G12", "from which end is ranked is not said")
    if claim.rank_from in ("best", "worst") and metric.polarity is None:
        raise _Stop("schema_gap", "G9", f"{name} has no polarity, so best and worst mean nothing", name)
    high_first = claim.rank_from == "highest" or (claim.rank_from in ("best", "worst") and (claim.rank_from == "best") == (metric.polarity == "higher_is_better"))
    if claim.displaced is not None:
        raise _Stop("unsupported_claim_type", "G10", "a change of rank")
    return grain, high_first


def _rank(claim: Ranking, config: Config, metric: Metric, measure: Measure, period: Period, subject: tuple[str, str] | None, grain: str | None, high_first: bool) -> RankPlan:
    if not grain:
        if claim.scope is not None:
            raise _Stop("ambiguous", "G11", "an entity ranking has its period for a scope")
        column, value = subject
        return RankPlan(measure, period, column, None, high_first, value, metric.min_rows)
    if unit_grain(period) != grain:
        raise _Stop("ambiguous", "G8", f"the period is not one {grain}")
    if claim.scope is None:
        raise _Stop("ambiguous", "G8", "no scope is stated")
    scope = _period(claim.scope, "scope")
    if not (scope.start <= period.start and period.end <= scope.end):
        raise _Stop("ambiguous", "G8", "the scope does not hold the period")
    return RankPlan(measure, scope, config.time_column, grain, high_first, period.start.isoformat(), metric.min_rows)


def _names_metric(claim: Claim, config: Config) -> None:
    """The sentence must name the metric it is bound to, in whole words."""
    name = vocabulary.metric_index(config)[norm(claim.metric)]
    bound = [name]
    if isinstance(claim, Share):
        bound += [k for k, m in config.metrics.items() if m.agg in ("share", "count")]
    words = [w for k in bound for w in (k, *config.metrics[k].aliases)]
    if not any(vocabulary.says(claim.span, w) for w in words):
        raise _Stop("schema_gap", "M3", f"metric_echo_failed: the span does not name {name}", name)
