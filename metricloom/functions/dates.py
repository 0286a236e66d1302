"""Instants and ranges as filter values: ISO dates and texts as people write them.

Units (``last 3 weeks``, ``two days ago``, ``start of next quarter``), days (``yesterday at 5pm``, ``last friday``), months,
quarters and years (``5 May 2021``, ``Q1 2021``, ``may``), and ranges of all these (``last monday to friday``). A weekday
alone is the nearest one (of two as near the earlier); ``last`` is before today, ``this`` today or after, ``next`` in
the week after this one; behind ``to`` it is the first one from the range's beginning on. Weeks begin on Monday.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

_UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
_ISO = r"\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2})?"
_NUMBERS = {w: str(k) for k, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)} | {"twenty": "20", "thirty": "30"}
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_DAY = "|".join(f"{d[:3]}(?:{d[3:]})?" for d in _DAYS) + "|tues|thurs|wednes"
_CLOCK = re.compile(r"(?:(.+?) )?(?:at )?(?:(\d{1,2})(?::(\d{2})(?::(\d{2}))?)? ?(am|pm)|(\d{1,2}):(\d{2})(?::(\d{2}))?|(noon|midnight))")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _naive(x: datetime) -> datetime:
    return x.astimezone(timezone.utc).replace(tzinfo=None) if x.tzinfo else x


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _shift_months(x: datetime, n: int) -> datetime:
    year, month = divmod(x.year * 12 + x.month - 1 + n, 12)
    for day in (x.day, 30, 29, 28):
        try:
            return x.replace(year=year, month=month + 1, day=day)
        except ValueError:
            continue
    raise ValueError(f"no such month: {n} from {x}")


def shifted(x: datetime, n: int, unit: str) -> datetime:
    if unit in ("month", "quarter", "year"):
        return _shift_months(x, n * {"month": 1, "quarter": 3, "year": 12}[unit])
    return x + timedelta(**{f"{unit}s": n})


def start_of(x: datetime, unit: str) -> datetime:
    """First instant of the unit that holds ``x``; weeks begin on Monday."""
    x = x.replace(microsecond=0)
    if unit == "second":
        return x
    if unit == "minute":
        return x.replace(second=0)
    if unit == "hour":
        return x.replace(minute=0, second=0)
    x = x.replace(hour=0, minute=0, second=0)
    if unit == "week":
        return x - timedelta(days=x.weekday())
    if unit == "month":
        return x.replace(day=1)
    if unit == "quarter":
        return x.replace(month=(x.month - 1) // 3 * 3 + 1, day=1)
    if unit == "year":
        return x.replace(month=1, day=1)
    return x


_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in _MONTHS) + "|sept"


def _weekday(name: str, which: str | None, at: datetime) -> datetime:
    day = next(k for k, d in enumerate(_DAYS) if d.startswith(name[:3]))
    today = start_of(at, "day")
    ahead = (day - today.weekday()) % 7
    if which in ("last", "past", "previous"):
        return today - timedelta(days=(-ahead) % 7 or 7)
    if which == "next":
        return start_of(today, "week") + timedelta(days=7 + day)
    if which in ("this", "coming"):
        return today + timedelta(days=ahead)
    return today + timedelta(days=ahead if ahead < 4 else ahead - 7)


def _calendar(t: str, at: datetime) -> tuple[datetime, str] | None:
    """Days, months and quarters of the calendar: the first instant and the unit."""
    month = lambda name: next(k for k, m in enumerate(_MONTHS, 1) if m.startswith(name[:3]))
    day = r"(\d{1,2})(?:st|nd|rd|th)?"
    try:
        if m := re.fullmatch(rf"(?:the )?{day} (?:of )?({_MONTH})\.?(?: (\d{{4}}))?", t):
            return datetime(int(m[3] or at.year), month(m[2]), int(m[1])), "day"
        if m := re.fullmatch(rf"({_MONTH})\.? {day}(?: (\d{{4}}))?", t):
            return datetime(int(m[3] or at.year), month(m[1]), int(m[2])), "day"
        if m := re.fullmatch(rf"({_MONTH})\.?(?: (?:of )?(\d{{4}}))?", t):
            return datetime(int(m[2] or at.year), month(m[1]), 1), "month"
        if m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", t):
            return datetime(int(m[3]), int(m[1]), int(m[2])), "day"
        if m := re.fullmatch(r"q([1-4])(?: (?:of )?(\d{4}))?|(\d{4})[ -]q([1-4])", t):
            return datetime(int(m[2] or m[3] or at.year), 3 * int(m[1] or m[4]) - 2, 1), "quarter"
    except ValueError:  # no such day
        pass
    return None


def _span(text: str, at: datetime) -> tuple[datetime, datetime] | None:
    """First and last instant (to the second) of what ``text`` names."""
    t = " ".join(_NUMBERS.get(w, w) for w in text.lower().replace(",", " ").split())
    units = "|".join(_UNITS)

    def whole(x: datetime, unit: str) -> tuple[datetime, datetime]:
        low = start_of(x, unit)
        return low, shifted(low, 1, unit) - timedelta(seconds=1)

    if m := re.fullmatch(_ISO, t, re.I):
        x = parse_iso(text.strip())
        return (x, x) if x else None
    if t == "now":
        return at, at
    if t in ("today", "yesterday", "tomorrow"):
        return whole(at + timedelta(days=("yesterday", "today", "tomorrow").index(t) - 1), "day")
    if m := re.fullmatch(rf"(last|previous|past|this|current|next) ({units})", t):
        step = {"last": -1, "previous": -1, "past": -1, "next": 1}.get(m[1], 0)
        return whole(shifted(at, step, m[2]), m[2])
    if m := re.fullmatch(rf"(?:the )?(last|past|next) (\d+) ({units})s?", t):
        x = shifted(at, int(m[2]) * (1 if m[1] == "next" else -1), m[3])
        return (at, x) if m[1] == "next" else (x, at)
    if m := re.fullmatch(rf"(?:(\d+)|an?) ({units})s? (ago|from now)|in (?:(\d+)|an?) ({units})s?", t):
        n = int(m[1] or m[4] or 1)
        x = shifted(at, -n if m[3] == "ago" else n, m[2] or m[5])
        return x, x
    if m := re.fullmatch(r"(?:the )?(start|beginning|end) of (.+)", t):
        inner = re.sub(r"^(the )?", "", m[2])
        inner = f"this {inner}" if inner in _UNITS else inner
        if span := _span(inner, at):
            x = span[1] if m[1] == "end" else span[0]
            return x, x
        return None
    if m := re.fullmatch(r"\d{4}", t):
        return whole(datetime(int(t), 1, 1), "year")
    if m := re.fullmatch(rf"(?:on )?(?:(last|past|previous|this|coming|next) )?({_DAY})", t):
        return whole(_weekday(m[2], m[1], at), "day")
    if found := _calendar(t, at):
        return whole(*found)
    if m := _CLOCK.fullmatch(t):
        day = _span(m[1], at) if m[1] else whole(at, "day")
        hour, minute, second = (int(x or 0) for x in ((m[2], m[3], m[4]) if m[2] else (m[6], m[7], m[8])))
        if m[5] and not 1 <= hour <= 12:
            return None
        hour = {"noon": 12, "midnight": 0}[m[9]] if m[9] else hour % 12 + 12 * (m[5] == "pm") if m[5] else hour
        if day and max(hour - 23, minute - 59, second - 59) <= 0:
            x = start_of(day[0], "day").replace(hour=hour, minute=minute, second=second)
            return x, x
    return None


def parse_iso(text: str) -> datetime | None:
    m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})(.*)", text.strip())
    if not m:
        return None
    try:
        return _naive(datetime.fromisoformat(f"{m[1]}-{int(m[2]):02}-{int(m[3]):02}{m[4].strip() and 'T' + m[4].lstrip(' Tt')}"))
    except ValueError:
        return None


def instant(value: str | date | datetime, at: datetime | None = None) -> datetime:
    """UTC without a zone. A text that names a span is its first instant."""
    if isinstance(value, datetime):
        return _naive(value)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    if isinstance(value, str) and (span := _span(value, at or now())):
        return span[0]
    raise ValueError(f"Invalid date: {value}")


def date_range(value: str | dict, at: datetime | None = None) -> tuple[datetime, datetime]:
    """First and last instant, both inside. In a text, ``a to b`` goes from a's first to b's last one; an
    ISO day is its midnight."""
    at = at or now()
    if isinstance(value, str):
        parts = [value]
        if m := re.fullmatch(r"\s*(?:from |between )?(.+?)\s+(?:to|until|till|through|and|-|–)\s+(.+?)\s*", value, re.I):
            parts = [m[1], m[2]]
        spans = [_span(p, at) for p in parts]
        if len(parts) == 2 and spans[0] and re.fullmatch(_DAY, parts[1].lower()):
            spans[1] = _span(f"this {parts[1]}", spans[0][0])
        elif len(parts) == 2 and spans[1] and re.fullmatch(rf"({_MONTH})\.?( \d{{1,2}})?", parts[0].lower()) and re.search(r"\d{4}$", parts[1]):
            spans[0] = _span(f"{parts[0]} {spans[1][1].year}", at)  # january to march 2020
        if None in spans:
            raise ValueError(f"Invalid date: {value}")
        return spans[0][0], spans[-1][1]
    return instant(value["start_date"], at), instant(value["end_date"], at)
