"""Extracted claims against labels: greedy matching by overlap, precision, recall, bindings."""

from __future__ import annotations

from dataclasses import dataclass, field

from typing import Any

from ..model import Claim, Config, Verdict
from ..operators.text import occurrences
from ..periods import PeriodError, parse_period
from ..vocabulary import entity_index, metric_index, norm

BOUND = ("type", "metric", "subject", "period", "value", "direction", "baseline_period", "rank", "rank_from", "group_by", "scope")


@dataclass
class Score:
    pairs: list[tuple[Claim, Claim]] = field(default_factory=list)
    merged: list[Claim] = field(default_factory=list)
    missed: list[Claim] = field(default_factory=list)
    spurious: list[Claim] = field(default_factory=list)

    @property
    def recall(self) -> float:
        n = len(self.pairs) + len(self.merged) + len(self.missed)
        return len(self.pairs) / n if n else 1.0

    @property
    def precision(self) -> float:
        n = len(self.pairs) + len(self.spurious)
        return len(self.pairs) / n if n else 1.0

    def bindings(self, config: Config | None = None) -> dict[str, tuple[int, int]]:
        """Per field, how many matched pairs agree and how many state it; words are resolved through a configuration, if there is one."""
        index = {"metric": metric_index(config), "subject": entity_index(config)} if config else {}

        def meant(field_: str, said: Any) -> Any:
            if not isinstance(said, str):
                return said
            if field_ in ("period", "baseline_period", "scope"):
                try:
                    return parse_period(said)
                except PeriodError:
                    return norm(said)
            return index.get(field_, {}).get(norm(said), norm(said))

        out = {}
        for f in BOUND:
            both = [(getattr(a, f, None), getattr(b, f, None)) for a, b in self.pairs]
            stated = [pair for pair in both if pair != (None, None)]
            out[f] = (sum(meant(f, x) == meant(f, y) for x, y in stated), len(stated))
        return out

    def agreement(self, expected: dict[str, str], verdicts: list[Verdict]) -> tuple[int, int]:
        """(matched labels whose claim got the label's verdict, matched labels with one); ``expected`` by label id, verdicts by claim id."""
        got = {v.claim_id: v.verdict for v in verdicts}
        judged = [(expected[a.id], got.get(b.id)) for a, b in self.pairs if a.id in expected]
        return sum(x == y for x, y in judged), len(judged)


def score(text: str, labels: list[Claim], found: list[Claim]) -> Score:
    """Labels whose span overlaps a claim that another label took are merged, the rest is missed; unmatched claims are spurious."""
    place = lambda c: (occurrences(text, c.span) or [(-1, -1)])[0]
    candidates = []
    for i, a in enumerate(labels):
        for j, b in enumerate(found):
            (s, e), (t, f) = place(a), place(b)
            shared = min(e, f) - max(s, t)
            if s >= 0 and t >= 0 and shared > 0:
                candidates.append((-shared, i, j))
    left, right, out = set(), set(), Score()
    for _, i, j in sorted(candidates):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.pairs.append((labels[i], found[j]))
    touched = {i for _, i, _ in candidates}
    out.merged = [c for i, c in enumerate(labels) if i not in left and i in touched]
    out.missed = [c for i, c in enumerate(labels) if i not in left and i not in touched]
    out.spurious = [c for j, c in enumerate(found) if j not in right]
    return out
