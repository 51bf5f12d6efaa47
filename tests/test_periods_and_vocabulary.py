from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pydantic import ValidationError

from claimcheck.model import Config, Entity, Metric, Period
from claimcheck.periods import PeriodError, parse_period, unit_grain
from claimcheck.vocabulary import entity_index, norm, says

D = date


@pytest.mark.parametrize(
    "said, start, end",
    [
        ("2017", D(2017, 1, 1), D(2018, 1, 1)),
        ("2017 Q2", D(2017, 4, 1), D(2017, 7, 1)),
        ("2017Q2", D(2017, 4, 1), D(2017, 7, 1)),
        ("2017-q4", D(2017, 10, 1), D(2018, 1, 1)),
        ("Q1 2017", D(2017, 1, 1), D(2017, 4, 1)),
        ("2017-03", D(2017, 3, 1), D(2017, 4, 1)),
        ("March 2017", D(2017, 3, 1), D(2017, 4, 1)),
        ("2017 dec", D(2017, 12, 1), D(2018, 1, 1)),
        ("2016-02-29", D(2016, 2, 29), D(2016, 3, 1)),
        ("2017-01 to 2017-03", D(2017, 1, 1), D(2017, 4, 1)),
        ("2017 Q1..2017 Q2", D(2017, 1, 1), D(2017, 7, 1)),
        ("2016 – 2017", D(2016, 1, 1), D(2018, 1, 1)),
    ],
)
def test_accepted(said, start, end):
    assert parse_period(said) == Period(start, end)


@pytest.mark.parametrize("said", ["", "last year", "2017-13", "2017 Q5", "2017-02-30", "2016-2017-2018", "17", "0000", "9999", "2018 to 2017", "2017 to 2018 to 2019", "spring 2017", "2017-1"])
def test_rejected(said):
    with pytest.raises(PeriodError):
        parse_period(said)


@given(st.integers(1000, 9998), st.integers(1, 4))
def test_quarters_tile_the_year(y, q):
    p = parse_period(f"{y} Q{q}")
    assert unit_grain(p) == "quarter"
    assert p.start == (D(y, 1, 1) if q == 1 else parse_period(f"{y} Q{q - 1}").end)


def test_grain():
    assert unit_grain(parse_period("2017")) == "year"
    assert unit_grain(parse_period("2017-05")) == "month"
    assert unit_grain(parse_period("2017-02 to 2017-04")) is None


def test_norm_and_whole_words():
    assert norm("  São\tPAULO ") == "sao paulo"
    assert norm("ﬁn ß") == "fin ss"
    assert says("the Revenue rose", "revenue") and not says("revenues rose", "revenue") and not says("x", "")


def _config(**kw):
    return Config(**({"time_column": "t", "metrics": {"revenue": Metric(agg="sum", column="x", aliases=["sales"])}} | kw))


def test_configuration_rules():
    with pytest.raises(ValidationError):
        Metric(agg="sum")
    with pytest.raises(ValidationError):
        Metric(agg="share", column="x")
    with pytest.raises(ValidationError):
        _config(metrics={"a": Metric(agg="count", aliases=["B"]), "b": Metric(agg="count")})
    with pytest.raises(ValidationError):
        _config(entities={"month": Entity(column="c")})
    with pytest.raises(ValidationError):
        _config(entities={"s": Entity(column="c", aliases={"x": "1"}), "z": Entity(column="d", aliases={"X": "2"})})
    with pytest.raises(ValidationError):
        _config(entities={"s": Entity(column="c", aliases={"Unspecified": "1"})})
    with pytest.raises(ValidationError):
        _config(other=1)
    assert entity_index(_config(entities={"s": Entity(column="c", aliases={"Sao": "SP"})})) == {"sao": ("s", "SP"), "sp": ("s", "SP")}
