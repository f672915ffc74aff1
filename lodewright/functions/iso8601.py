"""Strict ISO 8601 date-times with a zone."""

from __future__ import annotations

import re
from datetime import date

_EXTENDED = re.compile(
    r"(\d{4})-(?:(\d\d)-(\d\d)|W(\d\d)-(\d)|(\d{3}))"
    r"T(\d\d)(?::(\d\d)(?::(\d\d))?)?(?:[.,]\d+)?(?:Z|[+-](\d\d)(?::(\d\d))?)",
    re.ASCII,
)
_BASIC = re.compile(
    r"(\d{4})(?:(\d\d)(\d\d)|W(\d\d)(\d)|(\d{3}))"
    r"T(\d\d)(?:(\d\d)(?:(\d\d))?)?(?:[.,]\d+)?(?:Z|[+-](\d\d)(?:(\d\d))?)",
    re.ASCII,
)


def names_instant(text: str) -> bool:
    """True if text is one existing ISO 8601 date and time with its zone, and nothing else.

    Calendar, week and ordinal dates count, in extended or basic form (not mixed), with a time to the
    hour, minute, second or a fraction of it. 24:00 is the end of a day; a second of 60 is refused.
    """
    m = _EXTENDED.fullmatch(text) or _BASIC.fullmatch(text)
    if not m:
        return False
    year, month, day, week, weekday, ordinal, hour, minute, second, off_h, off_m = (
        None if g is None else int(g) for g in m.groups()
    )
    try:
        if month is not None:
            date(year, month, day)
        elif week is not None:
            date.fromisocalendar(year, week, weekday)
        elif not 1 <= ordinal <= 365 + (year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)):
            return False
    except ValueError:
        return False
    minute, second = minute or 0, second or 0
    if hour == 24:
        return minute == 0 and second == 0 and not re.search(r"[.,]0*[1-9]", text)
    return hour < 24 and minute < 60 and second < 60 and (off_h or 0) < 24 and (off_m or 0) < 60
