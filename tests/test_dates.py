from datetime import date, datetime, timezone

import pytest

from metricloom.functions.dates import date_range, instant

AT = datetime(2024, 3, 13, 15, 30, 20)  # a Wednesday


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2022-12-31", datetime(2022, 12, 31)),
        ("2022-1-3T04:05:06", datetime(2022, 1, 3, 4, 5, 6)),
        ("2022-01-03 04:05", datetime(2022, 1, 3, 4, 5)),
        ("2022-01-03T04:05:06+02:00", datetime(2022, 1, 3, 2, 5, 6)),
        ("today", datetime(2024, 3, 13)),
        ("yesterday", datetime(2024, 3, 12)),
        ("now", AT),
        ("last month", datetime(2024, 2, 1)),
        ("this quarter", datetime(2024, 1, 1)),
        ("next week", datetime(2024, 3, 18)),
        ("3 days ago", datetime(2024, 3, 10, 15, 30, 20)),
        ("in 2 months", datetime(2024, 5, 13, 15, 30, 20)),
        ("start of last year", datetime(2023, 1, 1)),
        ("end of the month", datetime(2024, 3, 31, 23, 59, 59)),
        ("march 2020", datetime(2020, 3, 1)),
        ("March 5, 2020", datetime(2020, 3, 5)),
        ("2021", datetime(2021, 1, 1)),
        ("two weeks ago", datetime(2024, 2, 28, 15, 30, 20)),
        ("monday", datetime(2024, 3, 11)),
        ("saturday", datetime(2024, 3, 16)),
        ("last wednesday", datetime(2024, 3, 6)),
        ("next tue", datetime(2024, 3, 19)),
        ("this friday at 5pm", datetime(2024, 3, 15, 17)),
        ("yesterday 17:30", datetime(2024, 3, 12, 17, 30)),
        ("12 am", datetime(2024, 3, 13)),
        ("2020-02-03 at noon", datetime(2020, 2, 3, 12)),
        ("5 May 2021", datetime(2021, 5, 5)),
        ("the 3rd of feb 2021", datetime(2021, 2, 3)),
        ("Sept. 5th", datetime(2024, 9, 5)),
        ("12/31/2021", datetime(2021, 12, 31)),
        ("Q2 2021", datetime(2021, 4, 1)),
        ("2021-Q4", datetime(2021, 10, 1)),
        ("end of february", datetime(2024, 2, 29, 23, 59, 59)),
        (date(2020, 2, 29), datetime(2020, 2, 29)),
        (datetime(2020, 1, 1, 12, tzinfo=timezone.utc), datetime(2020, 1, 1, 12)),
    ],
)
def test_instants(text, want):
    assert instant(text, AT) == want


@pytest.mark.parametrize(
    ("value", "low", "high"),
    [
        ("last month", datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59)),
        ("2020-01-01 to 2020-06-30", datetime(2020, 1, 1), datetime(2020, 6, 30)),
        ("from january 2020 to 2021", datetime(2020, 1, 1), datetime(2021, 12, 31, 23, 59, 59)),
        ("last 7 days", datetime(2024, 3, 6, 15, 30, 20), AT),
        ("last monday to friday", datetime(2024, 3, 11), datetime(2024, 3, 15, 23, 59, 59)),
        ("january to march 2020", datetime(2020, 1, 1), datetime(2020, 3, 31, 23, 59, 59)),
        ("Q1 2021", datetime(2021, 1, 1), datetime(2021, 3, 31, 23, 59, 59)),
        ("last two weeks", datetime(2024, 2, 28, 15, 30, 20), AT),
        ({"start_date": "2020-01-01", "end_date": date(2020, 1, 2)}, datetime(2020, 1, 1), datetime(2020, 1, 2)),
    ],
)
def test_ranges(value, low, high):
    assert date_range(value, AT) == (low, high)


@pytest.mark.parametrize("text", ["", "soon", "2020-13-01", "last blue moon", "31 feb 2021", "13 pm", "25:00"])
def test_what_is_no_date(text):
    with pytest.raises(ValueError, match="Invalid date"):
        instant(text, AT)
