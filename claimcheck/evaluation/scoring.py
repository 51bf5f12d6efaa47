"""Which extracted claim carries a variant's corruption, and what became of it; a judging model's answers beside it."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from typing import Any

from ..model import Claim, Config, Verdict
from ..operators.text import close, occurrences
from ..vocabulary import entity_index, norm
from .corrupt import EXACT, Variant

OUTCOMES = {"FAIL": "detected", "UNVERIFIABLE": "abstained", "PASS": "false_accept"}


def altered(variant: Variant) -> Claim | None:
    """The claim that the variant changed, as the variant states it."""
    return next((c for c in variant.claims if c.id == variant.claim_id), None)


def shared(text: str, a: str, b: str) -> int:
    """Characters that two spans have in common where they meet most."""
    return max((min(e, f) - max(s, t) for s, e in occurrences(text, a) for t, f in occurrences(text, b)), default=0)


def carries(cls: str, wrong: Claim, claim: Claim, config: Config) -> bool:
    """Whether a claim says what the corruption made of the statement."""
    if cls == "flipped_direction":
        return getattr(claim, "direction", None) == getattr(wrong, "direction", None)
    if cls == "wrong_ranking":
        who = lambda c: entity_index(config).get(norm(c.subject or ""), norm(c.subject or ""))
        return claim.type == "ranking" and claim.rank == wrong.rank and who(claim) == who(wrong)
    mine, theirs = getattr(claim, "value", None), getattr(wrong, "value", None)
    return mine is None and theirs is None or mine is not None and theirs is not None and close(mine, theirs)


def hit(variant: Variant, claims: list[Claim], config: Config) -> Claim | None:
    """Of the claims that overlap the corrupted statement and carry it, that which overlaps it most; the first of several."""
    wrong = altered(variant)
    if wrong is None:
        return None
    met = [(shared(variant.text, wrong.span, c.span), c) for c in claims if carries(variant.cls, wrong, c, config)]
    return max((x for x in met if x[0] > 0), key=lambda x: x[0], default=(0, None))[1]


def outcome(variant: Variant, claims: list[Claim], verdicts: list[Verdict], config: Config) -> tuple[str, int]:
    """(detected, abstained, false_accept or missed; false alarms among the other claims)."""
    found = hit(variant, claims, config)
    by = {v.claim_id: v.verdict for v in verdicts}
    alarms = sum(v == "FAIL" for k, v in by.items() if found is None or k != found.id)
    return "missed" if found is None else OUTCOMES[by[found.id]], alarms


@dataclass(frozen=True)
class Judged:
    """A judging model's answer on one text."""

    faithful: bool
    problems: tuple[str, ...]

    @classmethod
    def of(cls, answer: dict[str, Any]) -> Judged:
        if set(answer) != {"faithful", "problems"} or not isinstance(answer["faithful"], bool):
            raise ValueError("an answer has faithful and problems")
        return cls(answer["faithful"], tuple(str(p["span"]) for p in answer["problems"]))


def judge_score(suite: list[Variant], answers: dict[str, dict[str, Any]], clean: str) -> dict[str, Any]:
    """Recorded answers by a text's fingerprint: how many corrupted texts were called unfaithful, and for how many a named span meets the corruption."""
    from ..claims import fingerprint

    rows = Counter()
    for v in suite:
        answer = answers.get(fingerprint(v.text))
        if answer is None:
            rows["unanswered"] += 1
            continue
        judged, wrong = Judged.of(answer), altered(v)
        rows["answered"] += 1
        rows["detected"] += not judged.faithful
        rows["localised"] += not judged.faithful and wrong is not None and any(shared(v.text, wrong.span, p) > 0 for p in judged.problems)
    own = answers.get(fingerprint(clean))
    return {k: rows[k] for k in ("answered", "unanswered", "detected", "localised")} | {"false_alarm_on_clean": None if own is None else not Judged.of(own).faithful}


def distinct(suite: list[Variant]) -> dict[str, int]:
    """What the suite holds, copies counted once."""
    return {
        "variants": len(suite),
        "texts": len({v.text for v in suite}),
        "statements": len({(v.text, c.span) for v in suite if (c := altered(v)) is not None}),
        "claims": len({c.model_dump_json() for v in suite for c in v.claims}),
        "exact_match": sum(v.cls in EXACT for v in suite),
    }
