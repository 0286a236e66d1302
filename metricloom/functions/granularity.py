"""Parts of dates and times as dimensions of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, result types and the order in which a dimension gets them.
TYPES: dict[str, str] = {
    "time": "time",
    "date": "date",
    "year": "number",
    "quarter": "string",
    "quarter_of_year": "number",
    "month": "string",
    "month_num": "number",
    "week": "string",
    "week_num": "number",
    "day_of_month": "number",
    "hour": "string",
    "hour_of_day": "number",
    "minute": "string",
}
BY_TYPE: dict[str, tuple[str, ...]] = {
    "time": ("hour", "minute"),
    "date": ("year", "quarter", "quarter_of_year", "month", "month_num", "week", "week_num", "day_of_month"),
    "datetime": ("year", "quarter", "quarter_of_year", "month", "month_num", "week", "week_num", "date", "day_of_month", "time", "hour", "hour_of_day", "minute"),
}
#: Levels of the hierarchy that a dimension of the type gets, above the dimension itself.
LEVELS: dict[str, tuple[str, ...]] = {"time": (), "date": ("year", "quarter", "month", "week"), "datetime": ("year", "quarter", "month", "week", "date")}

EXAMPLES: dict[str, str] = {
    "time": "Time of day, as 17:30:00",
    "date": "Day, as 2021-01-31",
    "year": "Year, as 2021",
    "quarter": "Year and quarter, as 2021-Q1",
    "quarter_of_year": "Quarter of the year, 1 to 4",
    "month": "Year and month, as 2021-01",
    "month_num": "Month of the year, 1 to 12",
    "week": "Year and ISO week, as 2021-W05",
    "week_num": "ISO week of the year, 1 to 53",
    "day_of_month": "Day of the month, 1 to 31",
    "hour": "Day and hour, as 2021-01-31 17",
    "hour_of_day": "Hour of the day, 0 to 23",
    "minute": "Day, hour and minute, as 2021-01-31 17:30",
}


def _joined(x: Column, mark: str, part: Column, width: int) -> Column:
    """Null if ``x`` is; the year is the calendar's even next to an ISO week."""
    return F.concat(F.year(x).cast("string"), F.lit(mark), F.lpad(part.cast("string"), width, "0"))


_PARTS: dict[str, Callable[[Column], Column]] = {
    "time": lambda x: F.date_format(x, "HH:mm:ss"),
    "date": lambda x: x.cast("date"),
    "year": F.year,
    "quarter": lambda x: _joined(x, "-Q", F.quarter(x), 1),
    "quarter_of_year": F.quarter,
    "month": lambda x: _joined(x, "-", F.month(x), 2),
    "month_num": F.month,
    "week": lambda x: _joined(x, "-W", F.weekofyear(x), 2),
    "week_num": F.weekofyear,
    "day_of_month": F.dayofmonth,
    "hour": lambda x: F.date_format(x, "yyyy-MM-dd HH"),
    "hour_of_day": F.hour,
    "minute": lambda x: F.date_format(x, "yyyy-MM-dd HH:mm"),
}


def granularity(x: Column, name: str, of_type: str) -> Column:
    """Part ``name`` of a date, time or datetime. A time is the text HH:mm:ss, so its parts are prefixes."""
    if of_type == "time":
        return F.substring(x.cast("string"), 1, {"hour": 2, "minute": 5}[name])
    return _PARTS[name](x)
