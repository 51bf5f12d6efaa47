"""Periods as reports write them: years, quarters, months, days and ranges of two of these.

Nothing is relative and the clock is never read.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

from .model import Period
from .vocabulary import norm


class PeriodError(ValueError):
    pass


# English names of months (fixed values), whatever the locale; three letters of a name will do.
_NAMES = "january february march april may june july august september october november december".split()
_MONTHS = {said: k for k, name in enumerate(_NAMES, 1) for said in (name, name[:3])}
_NAME = "|".join(sorted(_MONTHS, key=len, reverse=True))
_FORMS = [
    (re.compile(r"(?P<y>\d{4})"), "year"),
    (re.compile(r"(?P<y>\d{4})[ -]?q(?P<q>[1-4])"), "quarter"),
    (re.compile(r"q(?P<q>[1-4])[ -](?P<y>\d{4})"), "quarter"),
    (re.compile(r"(?P<y>\d{4})-(?P<m>\d{2})"), "month"),
    (re.compile(rf"(?P<name>{_NAME}) (?P<y>\d{{4}})"), "month"),
    (re.compile(rf"(?P<y>\d{{4}}) (?P<name>{_NAME})"), "month"),
    (re.compile(r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})"), "day"),
]
_BETWEEN = re.compile(r" to |\.\.| [-–—] ")


def _months(year: int, month: int, n: int) -> Period:
    last = year * 12 + month - 1 + n
    return Period(date(year, month, 1), date(last // 12, last % 12 + 1, 1))


def _unit(text: str) -> Period:
    for pattern, kind in _FORMS:
        m = pattern.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        try:
            year = int(g["y"])
            if kind == "year":
                return _months(year, 1, 12)
            if kind == "quarter":
                return _months(year, 3 * int(g["q"]) - 2, 3)
            if kind == "month":
                return _months(year, _MONTHS[g["name"]] if g.get("name") else int(g["m"]), 1)
            day = date(year, int(g["m"]), int(g["d"]))
            return Period(day, day + timedelta(days=1))
        except (ValueError, OverflowError) as e:
            raise PeriodError(f"{text!r} is not in the calendar") from e
    raise PeriodError(f"{text!r} is not a period")


def parse_period(text: str) -> Period:
    said = norm(text)
    ends = _BETWEEN.split(said)
    if len(ends) == 1:
        return _unit(said)
    if len(ends) != 2:
        raise PeriodError(f"{text!r} has more than two ends")
    first, last = (_unit(x.strip()) for x in ends)
    if last.start < first.start or last.end < first.end:
        raise PeriodError(f"{text!r} goes backwards")
    return Period(first.start, last.end)


def unit_grain(period: Period) -> str | None:
    """month, quarter or year if the period is exactly one of these."""
    if period.start.day != 1:
        return None
    for grain, n in (("month", 1), ("quarter", 3), ("year", 12)):
        if (period.start.month - 1) % n == 0:
            try:
                if _months(period.start.year, period.start.month, n) == period:
                    return grain
            except (ValueError, OverflowError):
                return None
    return None
