"""Zone-offset intervals in local time, the table that local times are joined to."""

from __future__ import annotations

import os
import struct
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from importlib import resources
from zoneinfo import TZPATH, ZoneInfo, available_timezones

from pyspark.sql import DataFrame, SparkSession

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
#: Years for which intervals are built; wall times outside have no zone rule and give no row.
FIRST_YEAR, LAST_YEAR = 1850, 2199


def _offset(zone: ZoneInfo, second: int) -> int:
    moment = (_EPOCH + timedelta(seconds=second)).astimezone(zone)
    return int(moment.utcoffset().total_seconds())


@lru_cache(maxsize=1)
def zone_names() -> dict[str, str]:
    """The names of the zone database by their upper-case form."""
    return {name.upper(): name for name in available_timezones() if "/" in name}


def _stored(name: str) -> bytes | None:
    """The zone's file of the system or of the tzdata package."""
    for root in TZPATH:
        path = os.path.join(root, *name.split("/"))
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    try:
        return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()
    except (ModuleNotFoundError, OSError):
        return None


def _listed(data: bytes) -> list[int]:
    """The moments of change a zone file lists (RFC 8536: its 64-bit block)."""
    counts = lambda at: struct.unpack(">6l", data[at + 20 : at + 44])
    if data[:4] != b"TZif" or data[4:5] < b"2":
        return []
    ut, std, leap, times, types, chars = counts(0)
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + std + ut
    times = counts(at)[3]
    return list(struct.unpack(f">{times}q", data[at + 44 : at + 44 + 8 * times]))


@lru_cache(maxsize=1024)
def intervals(name: str) -> tuple[tuple[int, int, int], ...]:
    """(local start, local end, offset) in seconds, in order; an interval holds its start but not its end.

    Local starts and ends are wall-clock seconds: where clocks go back two intervals overlap,
    where they go forward there is a gap between them.
    """
    zone = ZoneInfo(name)
    low = int((datetime(FIRST_YEAR, 1, 1, tzinfo=UTC) - _EPOCH).total_seconds())
    high = int((datetime(LAST_YEAR + 1, 1, 1, tzinfo=UTC) - _EPOCH).total_seconds())
    data = _stored(name)
    listed = [t for t in _listed(data) if low < t < high] if data else []
    changes = [low, *(t for t in listed if _offset(zone, t) != _offset(zone, t - 1))]
    # beyond the list a yearly rule holds; without a list every few days are looked at
    at, step = (listed[-1], 20 * 86400) if listed else (low, 3 * 86400)
    before = _offset(zone, at)
    while at < high:
        at += step
        if _offset(zone, at) != before:
            a, b = at - step, at
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if _offset(zone, mid) == before else (a, mid)
            if b < high:
                changes.append(b)
            before = _offset(zone, at)
    ends = [*changes[1:], high]
    return tuple((a + (o := _offset(zone, a)), b + o, o) for a, b in zip(changes, ends))


def interval_table(spark: SparkSession, zones: dict[str, str]) -> DataFrame:
    """(zone, year, spans) of zones {key: name}: the intervals exploded to the local years they touch, those before a gap included.

    Its size is bounded: (LAST_YEAR - FIRST_YEAR + 1) rows a zone of the zone database, so it may be broadcast.
    """
    rows = []
    for key, name in sorted(zones.items()):
        spans = intervals(name)
        k = 0
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            a = int((datetime(year, 1, 1, tzinfo=UTC) - _EPOCH).total_seconds()) - 86400
            b = int((datetime(year + 1, 1, 1, tzinfo=UTC) - _EPOCH).total_seconds()) + 86400
            while k + 1 < len(spans) and spans[k][1] <= a:
                k += 1
            end = k
            while end < len(spans) and spans[end][0] < b:
                end += 1
            rows.append((key, year, spans[k:end]))
    return spark.createDataFrame(rows, "zone string, year int, spans array<struct<local_start:bigint,local_end:bigint,offset:bigint>>")
