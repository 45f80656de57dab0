"""Problem 5 against a plain Python reading of the rules."""

import re
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from loomline.functions.zones import intervals
from loomline.operators import timestamps as T

CASES = {
    "2023-12-29": ("2023-12-29", "date"),
    "21/05/2025": ("2025-05-21", "date"),
    "5.6.2024": ("2024-06-05", "date"),
    "25-03-2025": ("2025-03-25", "date"),
    "25 March 2023": ("2023-03-25", "date"),
    "14 лютого 2023 р.": ("2023-02-14", "date"),
    "30 września 2024": ("2024-09-30", "date"),
    "March 5, 2024": ("2024-03-05", "date"),
    "2024-01-01T01:37:04Z": ("2024-01-01T01:37:04Z", "fixed"),
    "2023-06-06T17:34:15.999431Z": ("2023-06-06T17:34:15Z", "fixed"),
    "2024-09-21T19:19:58+05:30": ("2024-09-21T13:49:58Z", "fixed"),
    "2023-06-28T01:12:12.250+0530": ("2023-06-27T19:42:12Z", "fixed"),
    "2024-01-25T09:54:34.250-05:00": ("2024-01-25T14:54:34Z", "fixed"),
    "2024-09-26 16:44:45 UTC+2": ("2024-09-26T14:44:45Z", "fixed"),
    "2024-06-07 12:02:49 UTC": ("2024-06-07T12:02:49Z", "fixed"),
    "2023-12-22 00:25:05 EEST": ("2023-12-21T21:25:05Z", "fixed"),
    "2024-01-02 05:53:30 BST": ("2024-01-02T04:53:30Z", "fixed"),
    "Sun, 26 Mar 2023 02:26:29 GMT": ("2023-03-26T02:26:29Z", "fixed"),
    "1758715909": ("2025-09-24T12:11:49Z", "epoch"),
    "1719272701917": ("2024-06-24T23:45:01Z", "epoch"),
    "-86401": ("1969-12-30T23:59:59Z", "epoch"),
    "2024-07-30 08:17": ("2024-07-30T07:17:00Z", "direct"),
    "2024-11-28T03:27:04[Europe/Kyiv]": ("2024-11-28T01:27:04Z", "direct"),
    "2024-07-15 21:25:24 Europe/Kyiv": ("2024-07-15T18:25:24Z", "direct"),
    "18/04/2023 15:57": ("2023-04-18T14:57:00Z", "direct"),
    "13 жовтня 2023, 09:33": ("2023-10-13T08:33:00Z", "direct"),
    "23 March 2024, 2:02am": ("2024-03-23T02:02:00Z", "direct"),
    "13 September 2023, 7:04pm": ("2023-09-13T18:04:00Z", "direct"),
    "1 January 2024, 12:05am": ("2024-01-01T00:05:00Z", "direct"),
    # clocks go back at 02:00 on 27 October 2024 in London: 01:30 occurs twice
    "2024-10-27 01:30:00": ("2024-10-27T00:30:00Z", "ambiguous"),
    "2024-10-27 03:30:00 Europe/Kyiv": ("2024-10-27T00:30:00Z", "ambiguous"),
    # clocks go forward at 01:00 on 31 March 2024 in London: 01:30 never occurs
    "2024-03-31 01:30:00": ("2024-03-31T01:30:00Z", "nonexistent"),
    "2024-03-31 03:30:00 Europe/Kyiv": ("2024-03-31T01:30:00Z", "nonexistent"),
    "2024-07-01 12:00:00 America/New_York": ("2024-07-01T16:00:00Z", "direct"),
    "2024-01-01T00:30:00[Asia/Tokyo]": ("2023-12-31T15:30:00Z", "direct"),
    "2024-05-05 10:00 america/argentina/buenos_aires\u00a0": ("2024-05-05T13:00:00Z", "direct"),
    "1 July 2150, 12:00 Europe/Madrid": ("2150-07-01T10:00:00Z", "direct"),
    "2024-03-31 02:00:00": ("2024-03-31T01:00:00Z", "direct"),
}
JUNK = ["", "  ", None, "unknown", "n/a", "not dated", "recently", "вчора", "null", "2024-02-30", "2024-02-30 10:00:00", "31/04/2023",
        "2024-13-01", "32 March 2024", "12 marathons 2024", "2024-01-01 25:00:00", "2024-01-01 10:61", "2024-01-01 10:10:60", "2024-01-01 10:00:00 Etc", "1 May 2024, 13:05pm",
        "2024-01-01 10:00:00 XYZ", "2024-01-01 10:00:00 Mars/Phobos", "1/2"]


def test_known_values(spark):
    rows = [(k, k) for k in CASES] + [(f"junk {k}", v) for k, v in enumerate(JUNK)]
    got = {r.key: (r.utc, r.status) for r in T.normalise(spark.createDataFrame(rows, "key string, value string"), "value").collect()}
    for k, want in CASES.items():
        assert got[k] == want, k
    for k, v in enumerate(JUNK):
        assert got[f"junk {k}"] == (None, None), v


def _plain(value):
    """The wall-time rules by a scan of the zone's offsets, for ISO wall times only."""
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d)(?:\[(\S+)\]| (\S+/\S+))?", value)
    wall = datetime.fromisoformat(f"{m[1]}T{m[2]}")
    zone = ZoneInfo(m[3] or m[4] or "Europe/London")
    found = []
    for minutes in range(-300, 301, 15):
        moment = (wall - timedelta(minutes=minutes)).replace(tzinfo=UTC)
        if moment.astimezone(zone).replace(tzinfo=None) == wall:
            found.append(moment)
    if not found:  # the offset half a day earlier is the one before the change
        found = [(wall - (wall - timedelta(hours=12)).replace(tzinfo=zone).utcoffset()).replace(tzinfo=UTC)]
    return min(found).strftime("%Y-%m-%dT%H:%M:%SZ")


@pytest.mark.parametrize("zone", ["", "[Europe/Kyiv]"])
def test_every_quarter_hour_around_changes(spark, zone):
    days = [date(y, m, d) for y in (2023, 2024, 2025) for m in (3, 10) for d in range(24, 32)]
    rows = [(f"{d} {h:02}:{q:02}:00{zone}",) for d in days for h in range(5) for q in (0, 15, 30, 45)]
    for r in T.normalise(spark.createDataFrame(rows, "value string"), "value").collect():
        assert r.utc == _plain(r.value), r.value


def test_intervals_cover_local_time():
    for name in ("Europe/London", "America/New_York", "Asia/Kathmandu", "Africa/Casablanca", "Pacific/Apia", "Europe/Dublin"):
        spans, zone = intervals(name), ZoneInfo(name)
        for year in (1930, 1975, 2011, 2024, 2040, 2100):
            for day in range(0, 365, 5):
                at = datetime(year, 1, 1, 12, tzinfo=UTC) + timedelta(days=day)
                second = int(at.timestamp())
                inside = [o for a, b, o in spans if a - o <= second < b - o]
                assert inside == [int(at.astimezone(zone).utcoffset().total_seconds())]
    spans = intervals("Europe/London")
    assert all(a[1] - a[2] == b[0] - b[2] for a, b in zip(spans, spans[1:]))


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, 1, "x"), ("2024-01-01", 2, "y"), ("2024-01-01", 2, "y")]
    df = spark.createDataFrame(rows, "value string, zone int, spans string")
    got = T.normalise(df, "value").orderBy("zone").collect()
    assert [(r.utc, r.zone, r.spans) for r in got] == [(None, 1, "x"), ("2024-01-01", 2, "y"), ("2024-01-01", 2, "y")]
    assert T.normalise(df.limit(0), "value").count() == 0
