from datetime import datetime

import pytest

from geolattice.functions.timeranges import add_duration, earlier, instant, parse_range


@pytest.mark.parametrize(
    "text, want",
    [
        ("2020-01-02", "2020-01-02T00:00:00.000000"), ("2020-01-02T03:04:05Z", "2020-01-02T03:04:05.000000"), ("2020-01-02 03:04:05.1234567", "2020-01-02T03:04:05.123457"),
        ("2020-01-02T00:30:00+01:00", "2020-01-01T23:30:00.000000"), ("10000-01-01T00:00:00Z", "10000-01-01T00:00:00.000000"), ("+99999-12-31", "99999-12-31T00:00:00.000000"),
        ("2020-01-01T00:00:00.12345678901234567890123Z", "2020-01-01T00:00:00.123457"),
    ],
)
def test_instants(text, want):
    assert instant(text) == want


@pytest.mark.parametrize("text", ["", "soon", "2020-13-01", "2020-01-01T25:00:00Z"])
def test_no_instants(text):
    with pytest.raises(ValueError):
        instant(text)


A, B = "2001-02-03T00:00:00.000000", "2004-05-06T00:00:00.000000"


@pytest.mark.parametrize(
    "value, want",
    [
        (["2001-02-03", "2004-05-06"], (A, B)), ("2001-02-03/2004-05-06", (A, B)), ("2001-02-03/..", (A, None)), ("2001-02-03/", (A, None)), ("../2004-05-06", (None, B)), ("/2004-05-06", (None, B)),
        ({"interval": ["2001-02-03", ".."]}, (A, None)), ({"timestamp": "2001-02-03"}, (A, A)), ({"date": "2004-05-06"}, (B, B)), ("2001-02-03", (A, A)), (["2001-02-03", None], (A, None)),
        ("2001-02-03/P3Y3M3D", (A, B)), ("P1M/2001-03-31", ("2001-02-28T00:00:00.000000", "2001-03-31T00:00:00.000000")), ("../..", (None, None)),
    ],
)
def test_ranges(value, want):
    assert parse_range(value) == want


def test_relative_to_now():
    assert parse_range("P1D", datetime(2020, 1, 2, 3, 44)) == ("2020-01-01T03:00:00.000000", "2020-01-02T03:00:00.000000")


@pytest.mark.parametrize("value", ["2004-05-06/2001-02-03", "a/b/c", "P1D/P1D"])
def test_no_ranges(value):
    with pytest.raises(ValueError):
        parse_range(value)


def test_months_before_days_and_far_years():
    assert add_duration("2020-01-31T00:00:00.000000", "P1M1D", 1) == "2020-03-01T00:00:00.000000"
    assert add_duration("12000-02-29T00:00:00.000000", "P1Y", 1) == "12001-02-28T00:00:00.000000"
    assert earlier("9999-12-31T00:00:00", "10000-01-01T00:00:00")
