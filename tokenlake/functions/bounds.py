"""Time bounds of a user's words: instants, local dates, spans back from now, named periods."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

#: Seconds of units; a month is 30 days and a year 365.
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800, "mo": 2_592_000, "y": 31_536_000}
#: How units are written.
_UNITS = {
    "s": "s sec secs second seconds", "m": "m min mins minute minutes", "h": "h hr hrs hour hours", "d": "d day days", "w": "w wk wks week weeks",
    "mo": "mo month months", "y": "y yr yrs year years",
}
UNITS = {name: _SECONDS[unit] for unit, names in _UNITS.items() for name in names.split()}


def midnight(day: date, tz: str) -> datetime:
    """When a local day begins: the earlier of two midnights; where there is none, midnight in UTC."""
    local = datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(tz))
    utc = local.astimezone(timezone.utc)
    there = utc.astimezone(ZoneInfo(tz)).replace(tzinfo=None) == local.replace(tzinfo=None)
    return utc if there else datetime(day.year, day.month, day.day, tzinfo=timezone.utc)


def _date(text: str) -> date | None:
    try:
        return date.fromisoformat(text) if re.fullmatch(r"\d{4}-\d\d-\d\d", text) else None
    except ValueError:
        return None


def when(text: str, now: datetime, tz: str = "UTC") -> datetime:
    """An instant with its offset, a local date (its begin) or clock time, or a span back from now such as 7d, 24h, 2w, 1mo."""
    text = text.strip()
    if day := _date(text):
        return midnight(day, tz)
    if re.match(r"\d{4}-\d\d-\d\d[ Tt]", text):
        try:
            at = datetime.fromisoformat(text)
            return (at if at.tzinfo else at.replace(tzinfo=ZoneInfo(tz))).astimezone(timezone.utc)
        except ValueError:
            pass
    span = re.fullmatch(r"(\d+)\s*([A-Za-z]+)", text)
    if span and span[2].lower() in UNITS:
        return now - timedelta(seconds=int(span[1]) * UNITS[span[2].lower()])
    raise ValueError(f"no time: {text!r} (a date, an instant, or a span such as 7d, 24h, 2w, 1mo)")


def until(text: str, now: datetime, tz: str = "UTC") -> tuple[datetime, bool]:
    """(upper bound, whether it is itself within): a date covers its whole local day."""
    day = _date(text.strip())
    return (midnight(day + timedelta(days=1), tz), False) if day else (when(text, now, tz), True)


def period(text: str, now: datetime, tz: str = "UTC") -> datetime:
    """When a period begins: today, week (from Monday), month, 1m (30 days), or as when()."""
    name, today = text.strip().lower(), now.astimezone(ZoneInfo(tz)).date()
    if name == "1m":
        return now - timedelta(days=30)
    first = {"today": today, "week": today - timedelta(days=today.weekday()), "month": today.replace(day=1)}.get(name)
    return midnight(first, tz) if first else when(text, now, tz)
