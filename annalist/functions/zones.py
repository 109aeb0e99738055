"""Versioned zone transition tables, read from the IANA database of the driver.

One row per zone and local year, from the first change of the zone on: the offset at the start of that year and every
change in it, each with the local clock reading from which the new offset holds.  Zones of equal content share their rows.  For a change at UTC second T from offset a to offset b that
reading is T + max(a, b): clock readings that occur twice then mean their first occurrence, and readings that are
skipped count with the offset before the change.
"""

from __future__ import annotations

import datetime as dt
import functools
import importlib.resources
import os
import struct
import zoneinfo
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Last years of the tables: of zones whose changes are listed up to 2037, and of those with later ones (the latest are
#: of 2087).  The 28 years up to each lie behind the listed changes and within one century, so that every later year has
#: one of the same calendar among them, and the rule of the zone holds for both.
LAST_YEAR, FAR_YEAR = 2065, 2128
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _second(year: int) -> int:
    return int((dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds())


def january(year: int) -> int:
    """Days from the first of January of year 1 to that of ``year``."""
    y = year - 1
    return 365 * y + y // 4 - y // 100 + y // 400


def kind(year: int) -> int:
    """Leap years and weekdays of the first of January: years of one kind have the same calendar."""
    return 7 * (january(year + 1) - january(year) - 365) + january(year) % 7


def _raw(key: str) -> bytes:
    for root in zoneinfo.TZPATH:
        p = os.path.join(root, key)
        if os.path.isfile(p):
            with open(p, "rb") as f:
                return f.read()
    package, _, name = f"tzdata.zoneinfo.{key.replace('/', '.')}".rpartition(".")
    return importlib.resources.files(package).joinpath(name).read_bytes()


def version() -> str:
    """Release of the zone database the tables are built from."""
    for root in zoneinfo.TZPATH:
        p = os.path.join(root, "tzdata.zi")
        if os.path.isfile(p):
            with open(p) as f:
                return f.readline().removeprefix("# version").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def _explicit(key: str) -> tuple[list[int], list[int], int]:
    """Transition seconds, the offset from each on, and the offset before the first (TZif, 64-bit block)."""
    raw = _raw(key)
    head = struct.Struct(">4sc15x6l")

    def counts(at: int) -> tuple[int, ...]:
        return head.unpack_from(raw, at)[2:]

    isut, isstd, leap, times, types, chars = counts(0)
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut
    isut, isstd, leap, times, types, chars = counts(at)
    at += 44
    seconds = list(struct.unpack_from(f">{times}q", raw, at))
    index = raw[at + times * 8 : at + times * 9]
    offsets = [struct.unpack_from(">lBB", raw, at + times * 9 + i * 6) for i in range(types)]
    first = next((o for o, dst, _ in offsets if not dst), 0)
    return seconds, [offsets[i][0] for i in index], first


def _by_rule(key: str, since: int, until: int) -> list[tuple[int, int]]:
    """Changes after the last listed one, found by halving between monthly probes."""
    zone = zoneinfo.ZoneInfo(key)

    def offset(s: int) -> int:
        return int((_EPOCH + dt.timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())

    out, lo, o = [], since, offset(since)
    while lo < until:
        hi = min(until, lo + 28 * 86400)
        if (p := offset(hi)) != o:
            a, b = lo, hi
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if offset(m) == o else (a, m)
            out.append((b, p))
            o = p
        lo = hi
    return out


def last_year(seconds: list[int]) -> int:
    return FAR_YEAR if seconds and seconds[-1] >= _second(2038) else LAST_YEAR


def transitions(key: str) -> tuple[list[int], list[int], int]:
    seconds, offsets, first = _explicit(key)
    last = seconds[-1] if seconds else 0
    end = _second(last_year(seconds) + 1) - 1
    # Without a comma the rule behind the listed changes is one fixed offset.
    if last < end and b"," in _raw(key).rstrip(b"\n").rpartition(b"\n")[2]:
        for s, o in _by_rule(key, max(last, 0), end):
            seconds.append(s)
            offsets.append(o)
    return seconds, offsets, first


@functools.lru_cache(maxsize=1)
def rows() -> tuple[pa.Table, pa.Table, int]:
    """Zone names with their number and first and last year, the changes by number and year, the most changes in a year.

    The key of the second table is number * 10,000 + year.  Before its first year a zone has the offset before all its
    changes.  The size is fixed by the zone database: about 600 names, and 350 contents times 170 years.
    """
    numbers: dict[bytes, int] = {}
    names: list[tuple[str, int, int, int]] = []
    spans: list[tuple[int, int]] = []
    found: list[tuple[int, int, list[tuple[int, int]]]] = []
    for key in sorted(zoneinfo.available_timezones()):
        if key.startswith(("posix/", "right/")) or key in ("localtime", "posixrules"):
            continue
        try:
            raw = _raw(key)
            if raw not in numbers:
                seconds, offsets, first = transitions(key)
                numbers[raw] = len(numbers)
                before = [first, *offsets]
                local = [s + max(before[i], before[i + 1]) for i, s in enumerate(seconds)]
                last = last_year(_explicit(key)[0])
                since = (_EPOCH + dt.timedelta(seconds=local[0])).year if local else last
                spans.append((since, last))
                for y in range(since, last + 1):
                    i, j = bisect_right(local, _second(y) - 1), bisect_right(local, _second(y + 1) - 1)
                    found.append((numbers[raw] * 10_000 + y, before[i], [(local[k], before[k + 1]) for k in range(i, j)]))
        except (OSError, struct.error, ModuleNotFoundError, zoneinfo.ZoneInfoNotFoundError):
            continue
        names.append((key.lower(), numbers[raw], *spans[numbers[raw]]))
    width = max((len(r[2]) for r in found), default=0)
    columns = {"zone_slot": pa.array([r[0] for r in found], pa.int64()), "zone_o0": pa.array([r[1] for r in found], pa.int32())}
    for k in range(width):
        columns[f"zone_t{k + 1}"] = pa.array([r[2][k][0] if k < len(r[2]) else None for r in found], pa.int64())
        columns[f"zone_o{k + 1}"] = pa.array([r[2][k][1] if k < len(r[2]) else None for r in found], pa.int32())
    heads = {"zone_key": [n[0] for n in names]} | {c: pa.array([n[i] for n in names], pa.int64()) for i, c in ((1, "zone_number"), (2, "zone_since"), (3, "zone_last"))}
    return pa.table(heads), pa.table(columns), width


def zone_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, int]:
    """(names, changes, most changes in a year), both tables made once a session."""
    names, changes, width = rows()
    held = getattr(spark, "_annalist_zones", None)
    if held is None:
        held = spark._annalist_zones = (spark.createDataFrame(names), spark.createDataFrame(changes))
    return *held, width
