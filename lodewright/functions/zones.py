"""Zone transition tables, built once per zone from one version of the IANA data."""

from __future__ import annotations

from bisect import bisect_left
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

# Fixed range of the tables. Before it no zone had left its local mean time; past it every zone repeats its yearly rule, so a
# later year is looked up as one of the table's last 28, which hold every pair of first weekday and length a year can have.
FIRST_YEAR, LAST_YEAR, CYCLE = 1800, 2130, 28
US = 1_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def data_version() -> str:
    """The version of the zone data this process reads."""
    for root in TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            path = Path(root, name)
            if path.exists():
                with path.open() as f:
                    return f.readline().replace("# version", "").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def _calendars() -> tuple[np.ndarray, np.ndarray]:
    """For each year to 9999, by its number, the day it begins on and how many days before it the table's like year begins."""
    first = (np.arange(10_001) - 1970).astype("M8[Y]").astype("M8[D]").astype(np.int64)
    kind = (first[:-1] % 7) * 2 + (np.diff(first) == 366)
    like = {int(kind[y]): y for y in range(LAST_YEAR - CYCLE - 1, LAST_YEAR - 1)}
    back = [0 if y < LAST_YEAR - 1 else int(first[y] - first[like[int(kind[y])]]) for y in range(10_000)]
    return first, np.array(back, dtype=np.int64)


_FIRST_DAYS, _DAYS_BACK = _calendars()
_DAY_US = 86_400 * US


def _to_table(wall: np.ndarray) -> np.ndarray:
    """How far back the like time within the table lies; 0 for times within it."""
    year = np.clip(np.searchsorted(_FIRST_DAYS, wall // _DAY_US, side="right") - 1, 0, 9999)
    return _DAYS_BACK[year] * _DAY_US


class ZoneTable:
    """The periods of one zone: UTC starts, offsets in microseconds and abbreviations."""

    def __init__(self, key: str):
        zone = ZoneInfo(key)

        def state(second: int) -> tuple[int, str]:
            at = (_EPOCH + timedelta(seconds=second)).astimezone(zone)
            return int(at.utcoffset().total_seconds()), at.tzname()

        first = int(datetime(FIRST_YEAR, 1, 1, tzinfo=UTC).timestamp())
        last = int(datetime(LAST_YEAR, 1, 1, tzinfo=UTC).timestamp())
        starts, states = [first], [state(first)]
        step = 14 * 86400
        for right in range(first + step, last + step, step):
            left = right - step
            while (seen := states[-1]) != state(right):
                # the first second in (left, right] at which the state differs from the last one seen
                at = left + 1 + bisect_left(range(left + 1, right + 1), True, key=lambda s: state(s) != seen)
                starts.append(at)
                states.append(state(at))
                left = at
        offsets = np.array([s[0] for s in states], dtype=np.int64) * US
        self.starts = np.array(starts, dtype=np.int64) * US
        self.offsets = offsets
        self.names = np.array([s[1] for s in states], dtype=object)
        # Wall-clock time from which a period's offset applies: the later of both offsets, so the first
        # pass of a repeated hour and the offset before a skipped hour win.
        self.walls = self.starts[1:] + np.maximum(offsets[1:], offsets[:-1])

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """UTC of wall-clock microseconds."""
        return wall - self.offsets[np.searchsorted(self.walls, wall - _to_table(wall), side="right")]

    def abbreviated(self, wall: np.ndarray, name: str) -> np.ndarray | None:
        """UTC of wall-clock microseconds under an abbreviation of this zone; None if it has no such one.

        Where the abbreviation is in force at that time its offset is certain; elsewhere the offset it
        last had before then (else first has) is meant.
        """
        periods = np.flatnonzero(self.names == name)
        if not len(periods):
            return None
        back = _to_table(wall)
        wall = wall - back
        utc = wall - self.offsets[periods[np.maximum(np.searchsorted(self.starts[periods], self.to_utc(wall), side="right") - 1, 0)]]
        for offset in np.unique(self.offsets[periods]):
            at = np.searchsorted(self.starts, wall - offset, side="right") - 1
            fits = (at >= 0) & (self.names[at] == name) & (self.offsets[at] == offset)
            utc = np.where(fits, wall - offset, utc)
        return utc + back


@lru_cache(maxsize=1024)
def zone_table(key: str) -> ZoneTable | None:
    """The table of an IANA zone; None if there is no such zone."""
    try:
        return ZoneTable(key)
    except (KeyError, ValueError, OSError):  # ZoneInfoNotFoundError is a KeyError
        return None
