"""Problem 5: mixed timestamp formats and time zones, as one UTC form.

A value is parsed into wall-clock fields and a zone by one regular expression for each
family of formats, all native. A wall time with a zone is then joined as-of to the zone's
offset intervals, which are exploded to (zone, year) rows so that the join has equality
keys: one matching interval gives the offset, two mean the time occurs twice (the earlier
moment is taken), none means it never occurs (the offset before the change is taken). The
interval table has a fixed size and is broadcast; the values are never shuffled.

Rules for what the value leaves open are parameters or documented here: all-digit dates are
day first unless the year comes first; no zone means ``default_zone``; abbreviations are
fixed offsets; named zones are those of the zone database ("Region/City", in any case); bare
numbers are seconds, or milliseconds from 10**11 on; fractions are cut; a second 60 is impossible.
Null, blank, unreadable and impossible values, unknown zones and years outside the interval
table have a null result; ``normalise`` keeps such rows, ``readable`` drops them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.zones import interval_table, zone_names
from loomline.session import spread

#: Month names: nominative, genitive and short forms, from January on.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "uk": "січня лютого березня квітня травня червня липня серпня вересня жовтня листопада грудня",
    "uk nominative": "січень лютий березень квітень травень червень липень серпень вересень жовтень листопад грудень",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "ru nominative": "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "pl nominative": "styczeń luty marzec kwiecień maj czerwiec lipiec sierpień wrzesień październik listopad grudzień",
    "ro": "ianuarie februarie martie aprilie mai iunie iulie august septembrie octombrie noiembrie decembrie",
}
#: Abbreviations with a fixed offset in seconds.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 3600, "WEST": 3600, "CET": 3600, "CEST": 7200, "EET": 7200, "EEST": 10800, "MSK": 10800,
}
DEFAULT_ZONE = "Europe/London"

_ZONE = r"((?:UTC|GMT|utc|gmt)?[+-]\d{1,2}(?::?\d{2})?(?:\[[A-Za-z0-9_/+\-]+\])?|\[?[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+\]?|[A-Z]{1,5}|z)?"
_CLOCK = r"(\d{1,2})[:.](\d{2})(?::(\d{2})(?:[.,]\d+)?)? ?([AaPp]\.?[Mm]\.?(?![A-Za-z]))? ?"
#: Each family with the order of its groups as year|month|day|hour|minute|second|am or pm|zone.
_FORMATS = [
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[Tt ] ?" + _CLOCK + _ZONE + r")?$", "$1|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2}):?(\d{2}):?(\d{2})?(?:[.,]\d+)? ?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6||$7"),
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?: ?[рг]\.)?(?:,? ?(?:[Tt]|о|at|в)? ?" + _CLOCK + _ZONE + r")?$", "$4|$3|$1|$5|$6|$7|$8|$9"),
    (r"^(?:\p{L}+\.?,? )?(\d{1,2})(?:st|nd|rd|th)?\.?[ -](?:of )?(\p{L}+)\.?,?[ -](\d{4})(?: ?(?:року|года|р|г|r)\.?)?"
     r"(?:,? ?(?:о|об|в|at|godz\.|ora)? ?" + _CLOCK + _ZONE + r")?$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (r"^(?:\p{L}+\.?,? )?(\p{L}+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?:,? ?(?:at)? ?" + _CLOCK + _ZONE + r")?$", "$3|$1|$2|$4|$5|$6|$7|$8"),
]


def _tidy(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[\s\u00a0\u2000-\u200b\u202f\ufeff]+", " "))


def _lookup(pairs: dict[str, int | str]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


def _parsed(tidy: Column) -> Column:
    """array<string> of the eight fields, or null."""
    forms = [F.when(tidy.rlike(p), F.regexp_replace(tidy, p, order)) for p, order in _FORMATS]
    return F.split(F.coalesce(*forms), r"\|", -1)


def with_fields(df: DataFrame, value: str) -> DataFrame:
    """Adds __day (date), __clock (seconds of the day), __epoch, __offset and __zone; at most one way of reading is filled."""
    months = {name: k + 1 for names in MONTHS.values() for k, name in enumerate(names.split())}
    df = df.withColumn("__tidy", _tidy(F.col(value)))
    df = df.withColumn("__f", _parsed(F.col("__tidy")))
    f = [F.col("__f")[k] for k in range(8)]
    month = F.coalesce(F.expr("try_cast(__f[1] as int)"), F.try_element_at(_lookup(months), F.lower(f[1])))
    hour = F.expr("try_cast(__f[3] as int)")
    noon = F.upper(F.substring(f[6], 1, 1))
    hour = F.when(noon == "", hour).when(~hour.between(1, 12), None).when(noon == "A", hour % 12).otherwise(hour % 12 + 12)
    minute, second = F.expr("try_cast(__f[4] as int)"), F.coalesce(F.expr("try_cast(__f[5] as int)"), F.lit(0))
    clock = F.when((hour <= 23) & (minute <= 59) & (second <= 59), hour * 3600 + minute * 60 + second)
    # columns of their own, so that each is worked out once
    df = df.withColumn("__named", F.upper(F.regexp_replace(f[7], r"^\[|\]$|(?<=\d)\[.*$", "")))
    df = df.withColumn("__signed", F.regexp_replace("__named", r"^(?:UTC|GMT)(?=[+-])", ""))
    zone, signed = F.col("__named"), F.col("__signed")
    number = r"^([+-])(\d{1,2}?):?(\d{2})?$"
    size = F.regexp_extract(signed, number, 2).try_cast("int") * 3600 + F.coalesce(F.regexp_extract(signed, number, 3).try_cast("int"), F.lit(0)) * 60
    offset = F.when(signed.rlike(number) & (size <= 64800), F.when(signed.startswith("-"), -size).otherwise(size))
    offset = F.coalesce(offset, F.try_element_at(_lookup(ABBREVIATIONS), zone))
    digits = F.regexp_extract("__tidy", r"^(-?\d{1,17})(?:\.\d*)?$", 1).try_cast("bigint")
    df = df.withColumns(
        {
            "__day": F.concat(f[0], F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(f[2], 2, "0")).try_cast("date"),
            "__has_clock": f[3] != "",
            "__clock": clock.cast("bigint"),
            "__epoch": F.when(F.abs(digits) >= 100_000_000_000, F.floor(digits / 1000)).otherwise(digits).cast("bigint"),
            "__offset": offset.cast("bigint"),
            "__zone": F.when(zone == "", F.lit(DEFAULT_ZONE.upper())).otherwise(zone),
        }
    )
    return df.drop("__tidy", "__f", "__named", "__signed")


def _utc_text(second: Column) -> Column:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86400).cast("int"))
    rest = F.pmod(second, F.lit(86400))
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), part(rest / 3600), F.lit(":"), part(rest % 3600 / 60), F.lit(":"), part(rest % 60), F.lit("Z"))


def _named_zones(df: DataFrame, value: str) -> dict[str, str]:
    """The zones of the zone database that values name, {upper-case name: name}: so many at most come to the driver."""
    known = zone_names()
    named = F.upper(F.regexp_extract(value, r"([A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+)\]?[\s\u00a0\u2000-\u200b\u202f\ufeff]*$", 1))
    found = df.select(named.alias("zone")).where("zone <> ''").where(F.col("zone").isin(*known)).distinct().collect()
    return {name: known[name] for name in (DEFAULT_ZONE.upper(), *(r.zone for r in found))}


def normalise(df: DataFrame, value: str, utc: str = "utc", status: str = "status") -> DataFrame:
    """Adds the UTC form and how it was found: date, epoch, fixed, direct, ambiguous, nonexistent, or null."""
    kept = df.columns
    parsed = with_fields(spread(df), value)
    parsed = parsed.withColumn("__wall", F.datediff("__day", F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.col("__clock"))
    spans = interval_table(df.sparkSession, _named_zones(df, value)).select(
        F.col("zone").alias("__zone"), F.col("year").alias("__year"), F.col("spans").alias("__spans")
    )
    parsed = parsed.withColumn("__year", F.when(F.col("__offset").isNull() & F.col("__wall").isNotNull(), F.year("__day")))
    joined = parsed.join(F.broadcast(spans), ["__zone", "__year"], "left")
    wall = F.col("__wall")
    joined = joined.withColumn("__hit", F.filter("__spans", lambda s: (s["local_start"] <= wall) & (wall < s["local_end"])))
    # array elements are in order, so the last that ended before a gap is the offset before the change
    before = F.element_at(F.filter("__spans", lambda s: s["local_end"] <= wall), -1)["offset"]
    hits = F.size("__hit")
    by_zone = F.when(hits == 0, before).when(hits > 0, F.array_max(F.transform("__hit", lambda s: s["offset"])))
    moment = F.coalesce(F.col("__epoch"), wall - F.coalesce(F.col("__offset"), by_zone))
    date_only = F.col("__day").isNotNull() & ~F.col("__has_clock")
    found = (
        F.when(date_only, "date")
        .when(F.col("__epoch").isNotNull(), "epoch")
        .when(wall.isNull(), None)
        .when(F.col("__offset").isNotNull(), "fixed")
        .when(hits == 0, "nonexistent")
        .when(hits == 1, "direct")
        .when(hits > 1, "ambiguous")
    )
    return joined.select(
        *kept, F.when(date_only, F.col("__day").cast("string")).otherwise(_utc_text(moment)).alias(utc), found.alias(status)
    )


def stated_times(table: DataFrame, rec_table: str, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(rec_table, rec_id, field, value): one row for each non-null value of the fields {name: column}."""
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("value")) for k, c in fields.items()])
    long = table.select(F.lit(rec_table).alias("rec_table"), F.col(id_col).cast("long").alias("rec_id"), F.inline(cells))
    return long.where("value is not null")


def readable(tables: list[DataFrame]) -> DataFrame:
    """(rec_table, rec_id, field, utc, status) of the readable values of several ``stated_times``."""
    long = reduce(DataFrame.unionByName, tables)
    return normalise(long, "value").where("utc is not null").select("rec_table", "rec_id", "field", "utc", "status")
