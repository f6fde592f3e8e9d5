"""Instants, intervals and durations of search requests.

Bounds are text, ISO-8601 in UTC to the microsecond, since years beyond 9999 are valid
and Python's datetime can't hold them; an open bound is None.
"""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta, timezone
from typing import Any

_DURATION = re.compile(r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$", re.I)
_INSTANT = re.compile(r"^\+?(\d{4,6})-(\d\d)(?:-(\d\d))?(?:[T ](\d\d):?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?)?\s*(Z|[+-]\d\d(?::?\d\d)?)?$", re.I)

Range = tuple[str | None, str | None]


def instant(text: str) -> str:
    """Canonical form of an instant; a zone is turned to UTC, digits beyond microseconds are rounded off."""
    m = _INSTANT.match(text.strip())
    if not m:
        raise ValueError(f"not an instant: {text!r}")
    year, month, day, hour, minute, second = (int(x) if x else d for x, d in zip(m.groups()[:6], (0, 1, 1, 0, 0, 0)))
    micros = round(int(m[7]) / 10 ** (len(m[7]) - 6)) if m[7] else 0
    zone = (m[8] or "Z").upper()
    # 400 years hold a whole number of weeks, so far years are reckoned in a near one.
    shift = (year - 2000) // 400 if year > 9999 else 0
    at = datetime(year - 400 * shift, month, day, hour, minute, second) + timedelta(microseconds=micros)
    if zone != "Z":
        sign, digits = (-1 if zone[0] == "-" else 1), zone[1:].replace(":", "").ljust(4, "0")
        at -= sign * timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
    return _text(at, shift)


def _text(at: datetime, shift: int = 0) -> str:
    if not shift:
        return at.isoformat(timespec="microseconds")
    return f"{at.year + 400 * shift:04d}-{at:%m-%dT%H:%M:%S}.{at.microsecond:06d}"


def add_duration(at: str, duration: str, sign: int) -> str:
    """Months first, clipped to the month's end, then days and time."""
    m = _DURATION.match(duration.strip())
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {duration!r}")
    years, months, weeks, days, hours, minutes = (int(x or 0) for x in m.groups()[:6])
    whole = re.match(r"(\d+)-(\d\d)-(\d\d)T(.*)", at)
    shift = (int(whole[1]) - 2000) // 400 if int(whole[1]) > 9999 else 0
    when = datetime.fromisoformat(f"{int(whole[1]) - 400 * shift:04d}-{whole[2]}-{whole[3]}T{whole[4]}")
    total = when.year * 12 + when.month - 1 + sign * (12 * years + months)
    year, month = divmod(total, 12)
    when = when.replace(year=year, month=month + 1, day=min(when.day, calendar.monthrange(year, month + 1)[1]))
    return _text(when + sign * timedelta(weeks=weeks, days=days, hours=hours, minutes=minutes, seconds=float(m[7] or 0)), shift)


def parse_range(value: Any, now: datetime | None = None) -> Range:
    """(lowest, highest) of a string, pair, {timestamp}, {date} or {interval}."""
    if isinstance(value, dict):
        if "timestamp" in value or "date" in value:
            value = value.get("timestamp", value.get("date"))
        elif "interval" in value:
            value = value["interval"]
    parts = [str(x) if x is not None else ".." for x in value] if isinstance(value, (list, tuple)) else str(value).split("/")
    parts = [p["timestamp"] if isinstance(p, dict) else p for p in parts]
    is_duration = [p[:1].upper() == "P" for p in parts]
    if len(parts) == 1:
        if is_duration[0]:
            base = (now or datetime.now(timezone.utc)).replace(minute=0, second=0, microsecond=0, tzinfo=None)
            return add_duration(_text(base), parts[0], -1), _text(base)
        return (at := instant(parts[0])), at
    if len(parts) != 2:
        raise ValueError("a time range has at most two ends")
    start, end = parts
    low, high = start in ("", ".."), end in ("", "..")
    if low or high:
        return None if low else instant(start), None if high else instant(end)
    if is_duration[0] and not is_duration[1]:
        return add_duration(instant(end), start, -1), instant(end)
    if is_duration[1] and not is_duration[0]:
        return instant(start), add_duration(instant(start), end, 1)
    lo, hi = instant(start), instant(end)
    if order_key(lo) > order_key(hi):
        raise ValueError("a time range must not end before it starts")
    return lo, hi


def order_key(at: str) -> tuple[int, str]:
    """Sorts instants; years may have more than four digits."""
    year, _, rest = at.lstrip("+").partition("-")
    return int(year), rest


def earlier(a: str, b: str) -> bool:
    return order_key(a) < order_key(b)
