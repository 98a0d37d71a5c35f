"""Mixed date and time texts to one unambiguous value (problem 4).

``parse_dates`` reads a text of unknown form with JVM expressions only: each
form is a pattern with its groups, and the first that fits gives the parts
(year, month, day, hour, minute, second, offset). Parts are checked by
arithmetic, so an impossible date gives null and never an exception, and no
step depends on the session time zone.

``estimate_zones`` finds the zone of feeds that state none: the local clock
readings of a feed are set against the times at which they were ingested; a
reading cannot be later than its ingestion. Among candidate zones (each a whole
offset history with its daylight-saving changes) it picks the one with the
fewest violations, and of those the one that leaves the least waiting time.

Cases. Null, empty and junk texts, relative times, impossible dates: no row.
``a; b`` states two dates and gives two rows. A text in any other form gives no
row. Repeated rows collapse. Years with two digits are 19xx for births and
20xx elsewhere. Zone names unknown to the platform count as missing.
"""

from __future__ import annotations

from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# English month names and the offsets, in minutes, of zone abbreviations.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "GST": 240, "PKT": 300, "IST": 330, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
CANDIDATE_ZONES = ("America/New_York", "America/Chicago", "America/Los_Angeles", "Europe/London", "Europe/Berlin", "Europe/Moscow", "Asia/Dubai", "Asia/Karachi", "Asia/Kolkata", "Asia/Shanghai")

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([AaPp][Mm])?\s*(Z|z|[+-]\d{2}:?\d{2}|[A-Za-z]{2,4})?"
_MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
# Form name -> (pattern, group of year, month, day; then of hour, minute, second, am/pm, zone where the form has a time).
FORMS: dict[str, tuple[str, dict[str, int]]] = {
    "iso_time": (r"^\+?(\d{4})[-/](\d{2})[-/](\d{2})[Tt ]\s*" + _TIME + "$", dict(y=1, m=2, d=3, hour=4, minute=5, second=6, ap=7, z=8)),
    "iso": (r"^\+?(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", dict(y=1, m=2, d=3)),
    "day_month_year": (
        r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})(?:st|nd|rd|th)?[\s-]+" + _MON + r",?[\s-]+(\d{4}|\d{2})(?:,?\s+" + _TIME + ")?$",
        dict(d=1, mon=2, y=3, hour=4, minute=5, second=6, ap=7, z=8),
    ),
    "month_day_year": (
        r"(?i)^(?:[a-z]{3,9},\s+)?" + _MON + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?:,?\s+" + _TIME + ")?$",
        dict(mon=1, d=2, y=3, hour=4, minute=5, second=6, ap=7, z=8),
    ),
    "month_year": (r"(?i)^" + _MON + r",?[\s-]+(\d{4})$", dict(mon=1, y=2)),
    "numeric": (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})$", dict(a=1, b=2, y=3)),
    "year_month": (r"^(\d{4})[-/](\d{2})$", dict(y=1, m=2)),
    "placeholder_year": (r"(?i)^(?:dd|mm|xx|\?\?)[/.-](?:dd|mm|xx|\?\?)[/.-](\d{4})$", dict(y=1)),
    "year": (r"^(\d{4})$", dict(y=1)),
    "compact": (r"^(\d{4})(\d{2})(\d{2})$", dict(y=1, m=2, d=3)),
}
_SPAN = r"(?i)^(?:between\s+)?(\d{4})\s*(?:-|–|to|and|/)\s*(\d{4})$"


def _clean(text: Column) -> Column:
    """Notes in brackets and words for 'about' removed, blanks tidied, full-width digits made plain."""
    s = F.translate(text, "０１２３４５６７８９", "0123456789")
    s = F.regexp_replace(s, r"\([^)]*\)", " ")
    s = F.regexp_replace(s, r"(?i)^\s*(?:circa|about|approximately|approx\.?|around|ca\.|c\.|dob:?)\s*", "")
    return F.trim(F.regexp_replace(s, r"[\s\h]+", " "))


def _int(text: Column) -> Column:
    return F.when(text != "", text.cast("int"))


def _days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by arithmetic alone."""
    a = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(a / 400)
    yoe = a - era * 400
    doy = F.floor((F.when(m > 2, m - 3).otherwise(m + 9) * 153 + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("long")


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


_GROUPS = ("y", "m", "d", "mon", "a", "b", "hour", "minute", "second", "ap", "z")


def _groups(s: Column) -> Column:
    """struct(form, one text for each of the groups) of the first form that fits, else null."""
    out = None
    for name, (pattern, at) in FORMS.items():
        parts = [(F.regexp_extract(s, pattern, at[k]) if k in at else F.lit("")).alias(f"g_{k}_") for k in _GROUPS]
        hit = F.struct(F.lit(name).alias("form"), *parts)
        out = F.when(s.rlike(pattern), hit) if out is None else out.when(s.rlike(pattern), hit)
    return out


def _parts(order: Column, birth: Column) -> Column:
    """struct(y, m, d, hh, mi, ss, offset in minutes, zoned) of the groups in ``_g``."""
    g = lambda k: F.col(f"_g.g_{k}_")
    y = _int(g("y")) + F.when(F.length(g("y")) == 2, F.when(birth, 1900).otherwise(2000)).otherwise(0)
    a, b = _int(g("a")), _int(g("b"))
    month_first = (order == "month first") | (order.isNull() & (a <= 12) & (b > 12))
    # A numeric date whose order is unknown and that can be read either way states no date.
    unclear = order.isNull() & (a <= 12) & (b <= 12) & (a != b)
    numeric = F.col("_g.form") == "numeric"
    m = F.when(numeric, F.when(month_first, a).otherwise(b)).when(g("mon") != "", _month_no(g("mon"))).otherwise(_int(g("m")))
    d = F.when(numeric, F.when(month_first, b).otherwise(a)).otherwise(_int(g("d")))
    hour, ap, zone = _int(g("hour")), F.upper(g("ap")), F.upper(g("z"))
    hour = F.when(ap == "", hour).when((hour < 1) | (hour > 12), 99).otherwise(hour % 12 + F.when(ap == "PM", 12).otherwise(0))
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    size = F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, -2, 2).cast("int")
    offset = F.when(zone.rlike(r"^[+-]\d"), F.when(zone.startswith("-"), -size).otherwise(size)).otherwise(F.try_element_at(known, zone))
    return F.struct(
        F.when(numeric & unclear, F.lit(None)).otherwise(y).cast("int").alias("y"),
        m.cast("int").alias("m"),
        d.cast("int").alias("d"),
        hour.cast("int").alias("hh"),
        _int(g("minute")).alias("mi"),
        F.coalesce(_int(g("second")), F.lit(0)).alias("ss"),
        offset.cast("int").alias("offset"),
        (zone != "").alias("zoned"),
    )


def _month_no(name: Column) -> Column:
    out = None
    for i, m in enumerate(MONTHS, 1):
        hit = F.lower(F.substring(name, 1, 3)) == m
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def parse_dates(df: DataFrame, text: str, order: Column, birth: Column) -> DataFrame:
    """Explode ``text`` into the dates it states; adds ``_p`` with

    kind ('date', 'span', 'local', 'instant'), value (text of a date or span),
    and epoch (seconds: of the local clock for 'local', in UTC for 'instant').
    """
    s = F.col("_s")
    pieces = F.transform(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), ";"), _clean)
    rows = df.select("*", F.explode(F.filter(pieces, lambda x: x.rlike(r"\d{2}"))).alias("_s"))
    # Each stage is a one-element generator: the optimizer then cannot copy its expression into every later use.
    rows = rows.select("*", F.explode(F.array(_groups(s))).alias("_g"))
    rows = rows.select("*", F.explode(F.array(_parts(order, birth))).alias("_q"))
    q = lambda k: F.col(f"_q.{k}")
    y, m, d = q("y"), q("m"), q("d")
    m = F.when(m == 0, F.lit(None)).otherwise(m)
    d = F.when(d == 0, F.lit(None)).otherwise(d)
    year_ok = (y >= 1000) & (y <= 2200)
    month_ok = m.isNull() | ((m >= 1) & (m <= 12))
    day_ok = d.isNull() | (m.isNotNull() & (d >= 1) & (d <= _month_days(y, m)))
    date_text = F.concat(
        F.lpad(y.cast("string"), 4, "0"),
        F.when(m.isNotNull(), F.concat(F.lit("-"), F.lpad(m.cast("string"), 2, "0"))).otherwise(""),
        F.when(d.isNotNull(), F.concat(F.lit("-"), F.lpad(d.cast("string"), 2, "0"))).otherwise(""),
    )
    hh, mi, ss = q("hh"), q("mi"), q("ss")
    timed = hh.isNotNull()
    time_ok = ~timed | ((hh <= 23) & (mi <= 59) & (ss <= 59) & d.isNotNull())
    ok = q("y").isNotNull() & year_ok & month_ok & day_ok
    clock = _days_from_civil(y, m, d) * 86400 + hh * 3600 + mi * 60 + ss
    stated = F.when(q("zoned"), q("offset")).cast("int")
    struct = lambda kind, value, epoch: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), epoch.cast("long").alias("epoch"), stated.alias("offset"))
    none_text, none_long = F.lit(None).cast("string"), F.lit(None).cast("long")
    first, second = F.regexp_extract(s, _SPAN, 1), F.regexp_extract(s, _SPAN, 2)
    span = s.rlike(_SPAN)
    out = F.when(span & (first > "0999") & (second >= first), struct("span", F.concat(first, F.lit("/"), second), none_long))
    out = out.when(birth & s.rlike(r"^\d{5}$"), struct("date", F.date_from_unix_date(F.when(s.rlike(r"^\d{5}$"), s).cast("int") - 25569).cast("string"), none_long))
    out = out.when(~birth & s.rlike(r"^\d{10}(?:\d{3})?$"), struct("instant", none_text, F.when(s.rlike(r"^\d{10}"), F.substring(s, 1, 10)).cast("long")))
    out = out.when(ok & ~span & (birth | ~timed), struct("date", date_text, none_long))
    out = out.when(ok & timed & time_ok & ~q("zoned"), struct("local", none_text, clock))
    out = out.when(ok & timed & time_ok & q("offset").isNotNull(), struct("instant", none_text, clock - q("offset") * 60))
    return rows.select("*", F.explode(F.array(out)).alias("_p")).filter("_p IS NOT NULL").drop("_s", "_g", "_q")


def utc_text(epoch: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of seconds since 1970 in UTC, whatever the session zone."""
    day, rest = F.floor(epoch / 86400), F.pmod(epoch, F.lit(86400))
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(rest / 60) % 60), two(rest % 60))
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), clock, F.lit("Z"))


def known_zone(zone: Column) -> Column:
    """The zone name if the platform knows it, else null."""
    return F.when(zone.isin(sorted(available_timezones())), zone)


def to_utc(local_epoch: Column, zone: Column) -> Column:
    """Seconds in UTC of a local clock reading; null where that clock showed the time twice or never."""
    local = F.timestamp_seconds(local_epoch)
    utc = F.to_utc_timestamp(local, zone)
    shown = lambda shift: F.from_utc_timestamp(F.timestamp_seconds(F.unix_seconds(utc) + shift), zone) == local
    twice = reduce(lambda a, b: a | b, [shown(x) for x in (-7200, -3600, -1800, 1800, 3600, 7200)])
    return F.when(shown(0) & ~twice, F.unix_seconds(utc))


def estimate_zones(readings: DataFrame, feed: str, candidates: tuple[str, ...] = CANDIDATE_ZONES) -> DataFrame:
    """(feed, zone, violations, readings, least_wait): for each feed the candidate offset history that fits its readings best.

    ``readings``: feed, epoch (seconds; of the local clock where ``offset`` is null, else in UTC), offset
    (minutes stated with the reading, or null) and ingested (seconds in UTC). A local reading that would lie
    after its ingestion is a violation, and so is a stated offset that the candidate did not have at that
    instant; a stated offset of 0 says nothing, as many feeds convert to UTC.
    One partially aggregated pass: each reading meets the fixed candidates, never other readings.
    Ties go to the least wait, then to alphabetical order. Null feeds are left out.
    """
    local = F.col("offset").isNull()
    usable = F.col(feed).isNotNull() & F.col("epoch").isNotNull() & ((local & F.col("ingested").isNotNull()) | (F.col("offset") != 0))
    tried = readings.filter(usable).select(feed, "epoch", "offset", "ingested", F.explode(F.array(*[F.lit(z) for z in candidates])).alias("zone"))
    at = F.timestamp_seconds("epoch")
    wait = F.when(local, F.col("ingested") - F.unix_seconds(F.to_utc_timestamp(at, F.col("zone"))))
    differs = F.when(~local, (F.unix_seconds(F.from_utc_timestamp(at, F.col("zone"))) - F.col("epoch")) / 60 != F.col("offset"))
    fit = tried.withColumn("wait", wait).withColumn("differs", differs).groupBy(feed, "zone").agg(
        F.sum(F.when((F.col("wait") < 0) | F.col("differs"), 1).otherwise(0).cast("long")).alias("violations"),
        F.count("*").alias("readings"),
        F.min(F.when(F.col("wait") >= 0, F.col("wait"))).alias("least_wait"),
    )
    best = W.partitionBy(feed).orderBy("violations", F.col("least_wait").asc_nulls_last(), "zone")
    return fit.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def field_texts(df: DataFrame, key: str, text: str, field_name: str, order: Column, birth: bool, zone: Column | None = None) -> DataFrame:
    """The narrow form that ``standardise`` reads; the fields of several tables are united in it and parsed once."""
    return df.select(
        F.lit(field_name).alias("field_name"),
        F.col(key).cast("string").alias("row_key"),
        F.col(text).cast("string").alias("text"),
        order.cast("string").alias("date_order"),
        F.lit(birth).alias("birth"),
        (zone if zone is not None else F.lit(None)).cast("string").alias("zone"),
    )


def standardise(texts: DataFrame, clocks: bool = True) -> DataFrame:
    """(field_name, row_key, std_value, zone_basis): one row for each date stated in a row of ``field_texts``.

    zone_basis is 'none' for dates and spans, 'stated' for times that carry their zone,
    'home' for those read in the zone of the row. Without ``clocks`` only dates and spans
    are returned, by a much smaller plan.
    """
    rows = parse_dates(texts.filter("row_key IS NOT NULL AND text IS NOT NULL"), "text", F.col("date_order"), F.col("birth"))
    kind, epoch = F.col("_p.kind"), F.col("_p.epoch")
    if not clocks:
        return rows.filter("_p.value IS NOT NULL").select("field_name", "row_key", F.col("_p.value").alias("std_value"), F.lit("none").alias("zone_basis"))
    rows = rows.select("*", F.explode(F.array(F.when(kind == "local", to_utc(epoch, known_zone(F.col("zone")))).otherwise(epoch))).alias("_utc"))
    value = F.when(kind.isin("date", "span"), F.col("_p.value")).otherwise(utc_text(F.col("_utc")))
    basis = F.when(kind == "instant", "stated").when(kind == "local", "home").otherwise("none")
    made = rows.select("field_name", "row_key", F.explode(F.array(F.struct(value.alias("std_value"), basis.alias("zone_basis")))).alias("_v"))
    return made.select("field_name", "row_key", "_v.std_value", "_v.zone_basis").filter(F.col("std_value").isNotNull())
