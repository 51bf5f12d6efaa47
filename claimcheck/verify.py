"""Claims to verdicts: one at a time, or a batch in a few jobs."""

from __future__ import annotations

from . import policy
from .compiler import compile_claim
from .model import PAIRS, Abstain, Claim, Computed, Config, Plan, Verdict
from .plans.lowering import execute
from .sources.dataset import Dataset


class VerifyError(ValueError):
    pass


def check_plan(ds: Dataset, claim: Claim, plan: Plan, time: str) -> None:
    """A plan must be of the claim's kind and may only name columns of the table."""
    kind, sub = PAIRS[type(claim)]
    if not isinstance(plan, kind) or (sub is not None and plan.kind != sub):
        raise VerifyError(f"a {claim.type} claim cannot be checked by {type(plan).__name__}")
    named = {time, plan.measure.column}
    for part in (plan, getattr(plan, "rows", None), getattr(plan, "current", None)):
        named.add(getattr(part, "column", None))
    if unknown := sorted(c for c in named - {None} if c not in ds.columns):
        raise VerifyError(f"no such columns: {', '.join(unknown)}")


def abstained(claim: Claim, a: Abstain) -> Verdict:
    return Verdict(claim.id, "UNVERIFIABLE", claimed=getattr(claim, "value", None), detail=a.detail, abstain_reason=a.reason, row=a.row, token=a.token)


def decided(claim: Claim, plan: Plan, computed: Computed, config: Config) -> Verdict:
    o = policy.judge(claim, computed, config, plan)
    return Verdict(claim.id, o.verdict, o.claimed, o.computed, o.delta, o.policy, o.detail, computed.sql, computed.params, computed.counts, o.reason, o.row)


def failed(claim: Claim, error: Exception) -> Verdict:
    return Verdict(claim.id, "UNVERIFIABLE", policy="error", detail=f"{type(error).__name__}: {str(error)[:300]}")


def verify_claim(ds: Dataset, claim: Claim, config: Config, *, exact: bool = True) -> Verdict:
    """One claim; errors are raised. An abstention runs no query."""
    plan = compile_claim(claim, config)
    if isinstance(plan, Abstain):
        return abstained(claim, plan)
    check_plan(ds, claim, plan, config.time_column)
    return decided(claim, plan, execute(ds, config.time_column, [plan], exact=exact)[0], config)


def _executed(ds: Dataset, time: str, plans: list[Plan], exact: bool) -> list[Computed | Exception]:
    """Results, in halves where a batch fails: one bad plan costs a few jobs more and no other plan's result."""
    try:
        return list(execute(ds, time, plans, exact=exact))
    except Exception as e:
        if len(plans) == 1:
            return [e]
        half = len(plans) // 2
        return _executed(ds, time, plans[:half], exact) + _executed(ds, time, plans[half:], exact)


def verify_claims(ds: Dataset, claims: list[Claim], config: Config, *, exact: bool = True) -> list[Verdict]:
    """All claims, in their order, with scans shared. What goes wrong with one claim stays with it."""
    out: list[Verdict | None] = [None] * len(claims)
    open_: list[tuple[int, Plan]] = []
    for k, claim in enumerate(claims):
        try:
            plan = compile_claim(claim, config)
            if isinstance(plan, Abstain):
                out[k] = abstained(claim, plan)
                continue
            check_plan(ds, claim, plan, config.time_column)
            open_.append((k, plan))
        except Exception as e:
            out[k] = failed(claim, e)
    for (k, plan), computed in zip(open_, _executed(ds, config.time_column, [p for _, p in open_], exact)):
        if isinstance(computed, Exception):
            out[k] = failed(claims[k], computed)
            continue
        try:
            out[k] = decided(claims[k], plan, computed, config)
        except Exception as e:
            out[k] = failed(claims[k], e)
    return out
