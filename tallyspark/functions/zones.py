"""Zone transition tables: instants at which an offset changes, as arrays that convert whole columns at once.

The tables are derived from the installed time zone database by probing it, so they don't depend on its file format, and
carry the version of that database.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib import metadata
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

#: Years whose transitions are known: all that a date may have (see ``instants``).
FIRST_YEAR, LAST_YEAR = 1899, 2202
#: Marks wall times that never occur.
NEVER = np.iinfo(np.int64).min
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def database_version() -> str:
    """The version of the time zone database, or 'unknown'."""
    for folder in TZPATH:
        for name in ("tzdata.zi", "+VERSION", "version"):
            if (p := Path(folder, name)).is_file():
                return p.read_text(errors="replace").split("\n", 1)[0].removeprefix("# version ").strip()
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    """starts[k]: the UTC second from which offsets[k] (seconds east) and names[k] hold; starts[0] is the far past."""

    zone: str
    version: str
    starts: np.ndarray
    offsets: np.ndarray
    names: tuple[str, ...]

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """UTC microseconds of wall-clock microseconds: the earlier instant where two fit, NEVER where none does."""
        best = np.full(wall.shape, NEVER, np.int64)
        guess = np.searchsorted(self.starts, wall // 1_000_000, side="right") - 1
        for step in (1, 0, -1):  # a later segment first, so that an earlier instant replaces it
            k = np.clip(guess + step, 0, len(self.starts) - 1)
            utc = wall - self.offsets[k] * 1_000_000
            fits = np.searchsorted(self.starts, np.floor_divide(utc, 1_000_000), side="right") - 1 == k
            best = np.where(fits & ((best == NEVER) | (utc < best)), utc, best)
        return best

    def offset_of(self, name: str, wall_us: np.ndarray) -> np.ndarray | None:
        """The offset in seconds that an abbreviation has nearest to each wall time; None if the zone has no such name."""
        own = [k for k, n in enumerate(self.names) if n.upper() == name.upper()]
        if not own:
            return None
        if len({int(self.offsets[k]) for k in own}) == 1:
            return np.full(wall_us.shape, self.offsets[own[0]], np.int64)
        starts = self.starts[own]
        ends = np.append(self.starts[1:], np.iinfo(np.int64).max // 4)[own]
        sec = wall_us // 1_000_000
        away = np.maximum(0, np.maximum(starts[None, :] - sec[:, None], sec[:, None] - ends[None, :]))
        return self.offsets[own][away.argmin(axis=1)]


@lru_cache(maxsize=700)
def zone_table(zone: str) -> ZoneTable | None:
    """The table of an IANA zone, or None if there is no such zone."""
    try:
        z = ZoneInfo(zone)
    except Exception:  # noqa: BLE001 - zoneinfo raises several kinds for bad keys
        return None

    def at(sec: int) -> tuple[int, str]:
        t = (_EPOCH + timedelta(seconds=sec)).astimezone(z)
        return int(t.utcoffset().total_seconds()), t.tzname() or ""

    first = int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    last = int((datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    starts, found, step = [-(1 << 53)], [at(first)], 7 * 86_400
    for lo in range(first, last, step):
        while at(lo + step) != found[-1]:  # the first change within the step, to the second
            now = found[-1]
            begin = max(lo, starts[-1])
            change = begin + bisect_left(range(lo + step - begin + 1), True, key=lambda s, b=begin, n=now: at(b + s) != n)
            starts.append(change)
            found.append(at(change))
    return ZoneTable(zone, database_version(), np.array(starts, np.int64), np.array([o for o, _ in found], np.int64), tuple(n for _, n in found))
