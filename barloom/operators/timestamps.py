"""Timestamps in mixed formats, precisions and zones, normalised to one UTC instant.

A text runs through an ordered cascade of anchored patterns. The first that matches the whole text rewrites it into one
canonical list of fields, which is then parsed strictly (no lenient roll-over of days, hours or seconds). The zone is, in this
order: an offset in the text, a bracketed region, UTC/GMT, an abbreviation of the source's home zone, the source's default
zone. Wall times that a clock change skips or repeats follow an explicit policy.

Everything is a column expression, so the scan stays one stage; the only join is with the small source table.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import broadcast_if_small

#: Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_BLANK = r"[\s\p{Z}\x{FEFF}\x{200B}]+"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_HALF = r"(?:\s*([AaPp][Mm]))?"
_ZONE = r"\s*([Zz]|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5})?(?:\[([A-Za-z0-9_+\-/]+)\])?"


@dataclass(frozen=True)
class TextPattern:
    """An anchored pattern; `fields` rewrites a match as year|month|day|hour|minute|second|fraction|half|zone|region|order."""

    name: str
    regex: str
    fields: str


#: In the order in which they are tried.
PATTERNS = (
    TextPattern("year_first", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[Tt]|\s+){_CLOCK}{_HALF}{_ZONE}$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11|ymd"),
    TextPattern("compact", r"^(\d{4})(\d{2})(\d{2})[Tt]?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?([Zz]|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6|$7||$8||ymd"),
    TextPattern("year_last", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:,?\s+|[Tt]){_CLOCK}{_HALF}{_ZONE}$", "$4|$1|$3|$5|$6|$7|$8|$9|$10|$11|any"),
    TextPattern("day_name_month", rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]([A-Za-z]{{3,9}})\.?,?[\s-](\d{{4}}),?\s+{_CLOCK}{_HALF}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|ymd"),
    TextPattern("name_month_day", rf"^(?:[A-Za-z]{{3,9}},?\s+)??([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}{_HALF}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10|ymd"),
)

#: A count since 1970; the unit follows from the magnitude.
EPOCH = r"^\d{9,20}(?:\.\d{1,9})?$|^\d(?:\.\d{1,18})?[Ee]\+?\d{1,2}$"

RESULT = "struct<utc_us:bigint,status:string,pattern:string>"


@lru_cache(maxsize=None)
def _zone_rules(name: str, first: int, last: int) -> dict[str, list[int]]:
    """The UTC offsets in seconds of each abbreviation of a zone in the given years, the latest last."""
    zone, seen = zoneinfo.ZoneInfo(name), {}
    for year in range(first, last + 1):
        for month in (1, 4, 7, 10):
            t = datetime(year, month, 15, tzinfo=timezone.utc).astimezone(zone)
            offset, own = int(t.utcoffset().total_seconds()), seen.setdefault(t.tzname().upper(), [])
            if offset in own:
                own.remove(offset)
            own.append(offset)
    return seen


@lru_cache(maxsize=None)
def _regions() -> tuple[str, ...]:
    """Zone names that both Python and the JVM know, those without a slash included."""
    names = set(zoneinfo.available_timezones())
    spark = SparkSession.getActiveSession()
    if spark is not None and hasattr(spark, "sparkContext"):
        names &= set(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    return tuple(sorted(names))


def zone_table(spark: SparkSession, names: Iterable[str], first: int = 1990, last: int = 2037) -> DataFrame:
    """(zone, abbreviations): the named IANA zones, about 600 at most, each with the UTC offsets that its abbreviations had in the
    given years; an abbreviation may have had several. Unknown names have no row."""
    schema = T.StructType([T.StructField("zone", T.StringType()), T.StructField("abbreviations", T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))])
    return spark.createDataFrame([(z, _zone_rules(z, first, last)) for z in sorted(set(names) & set(_regions()))], schema)


def _at(fields: Column, i: int) -> Column:
    x = fields.getItem(i)
    return F.when(x != "", x)


def _texts(t: Column) -> Column:
    """The canonical fields of a trimmed text and the name of its pattern."""
    canon = F.lit(None).cast("string")
    for p in reversed(PATTERNS):
        hit = t.rlike(p.regex)
        canon = F.when(hit, F.concat(F.lit(p.name + "|"), F.regexp_replace(t, p.regex, p.fields))).otherwise(canon)
    return F.split(canon, r"\|", -1)


def _wall(f: Column, month_first: Column) -> Column:
    """The wall time that the fields name, parsed strictly; null for impossible dates and times."""
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for key in dict.fromkeys((m[:3], m)) for x in (key, i + 1)], F.lit("sept"), F.lit(9))
    swap = (_at(f, 11) == "any") & ~month_first
    a, b = F.when(swap, _at(f, 3)).otherwise(_at(f, 2)), F.when(swap, _at(f, 2)).otherwise(_at(f, 3))
    month = F.coalesce(a.try_cast("int"), F.try_element_at(names, F.lower(a)))
    day, hour, minute = b.try_cast("int"), _at(f, 4).try_cast("int"), _at(f, 5).try_cast("int")
    second, half = F.coalesce(_at(f, 6).try_cast("int"), F.lit(0)), F.upper(_at(f, 8))
    ok = (minute < 60) & (second < 60) & F.when(half.isNull(), hour < 24).otherwise(hour.between(1, 12))
    hour24 = F.when(half.isNull(), hour).otherwise(hour % 12 + F.when(half == "PM", 12).otherwise(0))
    return F.when(ok, F.try_make_timestamp(_at(f, 1).try_cast("int"), month, day, hour24, minute, second.cast("decimal(16,6)"), F.lit("UTC")))


def _offset(zone: Column, region: Column) -> Column:
    """The offset in seconds that the text itself settles, whatever the source; else null."""
    signed = zone.rlike(r"^[+-]")
    hh, mm = F.substring(zone, 2, 2).try_cast("int"), F.coalesce(F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    number = F.when((hh <= 18) & (mm < 60), (hh * 3600 + mm * 60) * F.when(zone.startswith("-"), -1).otherwise(1))
    return F.when(signed, number).when(zone.isin("Z", "UTC", "GMT", "UT") | (zone.isNull() & region.isin("UTC", "GMT")), 0)


def _epoch(t: Column) -> Column:
    """Microseconds of a count since 1970 in s, ms, us or ns, told by its magnitude; finer parts are cut off."""
    number = F.coalesce(t.try_cast("decimal(38,9)"), t.try_cast("double").try_cast("decimal(38,9)"))
    unit = F.when(number < 10**11, F.lit(1_000_000)).when(number < 10**14, F.lit(1_000)).when(number < 10**17, F.lit(1))
    us = F.when(unit.isNotNull(), F.floor(number * unit)).otherwise(F.floor(number / 1_000)).try_cast("bigint")
    return F.when(t.rlike(EPOCH) & (number >= 10**8), us)


def normalize_timestamps(df: DataFrame, sources: DataFrame, columns: Mapping[str, str | None], source_col: str = "feed_id", zone_col: str = "home_zone", order_col: str = "date_order", received_col: str = "received_at", suffix: str = "_instant", ambiguous: str = "later_not_after", nonexistent: str = "null") -> DataFrame:
    """df with `<column><suffix>`, a struct (utc_us, status, pattern), for each text column.

    columns: text column to zone of its texts without one, or None for the zone of the row's source. sources: one row for each
    source with its zone and `dmy` or `mdy`; where a source is repeated, its smallest zone and order count. received_col: a
    later known time, such as that of receipt.

    ambiguous: for a wall time that occurs twice, `later_not_after` (the later instant not after the time of receipt; if both
    are after it, the earlier; the later where it is null), `earlier`, `later` or `null`. nonexistent: for a skipped wall time,
    `null` or `shift` (moved forward by the length of the gap).

    An abbreviation means the offset that it had, by the rules of the source's zone, at the time it names; where the zone used it at
    another time of the year only, the last offset that it had.

    status: `exact` (epoch, offset, UTC or abbreviation), `zoned` (a wall time with one instant), `ambiguous`, `skipped`,
    `no_zone` (the default zone or abbreviation isn't known), `unreadable`; a null or blank text gives a null struct. Rows whose
    source is null or unknown keep what their texts settle themselves. Other columns of `sources` aren't taken, so equal names
    in df don't clash. Rows are never dropped or repeated; an empty table stays empty.
    """
    own = sources.where(F.col(source_col).isNotNull()).groupBy(F.col(source_col).alias("_src")).agg(F.min(zone_col).alias("_zone"), F.min(order_col).alias("_order"))
    # Rules are made for the zones that the sources name, of which there are no more than zones of the world.
    named = [r[0] for r in own.where(F.col("_zone").isin(*_regions())).select("_zone").distinct().collect()]
    own = own.join(F.broadcast(zone_table(df.sparkSession, named)), F.col("_zone") == F.col("zone"), "left").select("_src", F.col("zone").alias("_zone"), F.coalesce(F.col("_order") == "mdy", F.lit(False)).alias("_mdy"), F.col("abbreviations").alias("_abbr"))
    # Columns go by their place until the end, so that no name of df meets one of the steps.
    place = {n: f"c{i}" for i, n in enumerate(df.columns)}
    source, received_at = F.col(place[source_col]), F.col(place[received_col])
    out = df.toDF(*place.values()).join(broadcast_if_small(own), source == F.col("_src"), "left")
    # One projection for each step: Catalyst doesn't merge them while a step is used more than once, so nothing is computed twice.
    each = [(i, n, z) for i, (n, z) in enumerate(columns.items())]
    out = out.withColumns({f"_t{i}": F.regexp_replace(F.col(place[n]), rf"^{_BLANK}|{_BLANK}$", "") for i, n, _ in each})
    out = out.withColumns({f"_f{i}": _texts(F.col(f"_t{i}")) for i, *_ in each})
    out = out.withColumns({f"_w{i}": _wall(F.col(f"_f{i}"), F.coalesce("_mdy", F.lit(False))) for i, *_ in each} | {f"_z{i}": F.upper(_at(F.col(f"_f{i}"), 9)) for i, *_ in each} | {f"_r{i}": _at(F.col(f"_f{i}"), 10) for i, *_ in each})
    known = F.split(F.lit(",".join(_regions())), ",")  # folded to one literal array
    # An abbreviation is one of the source's own zone, whatever the column's default.
    offsets = lambda i: F.try_element_at(F.col("_abbr"), F.col(f"_z{i}"))
    tz = lambda i, default: F.when(F.col(f"_z{i}").isNotNull(), F.when(offsets(i).isNotNull(), F.col("_zone"))).when(F.col(f"_r{i}").isNull(), default).when(F.array_contains(known, F.col(f"_r{i}")), F.col(f"_r{i}"))
    out = out.withColumns({f"_o{i}": _offset(F.col(f"_z{i}"), F.col(f"_r{i}")) for i, *_ in each} | {f"_zone{i}": tz(i, F.lit(z) if z else F.col("_zone")) for i, _, z in each} | {f"_n{i}": offsets(i) for i, *_ in each})
    # The offsets in force a day before and a day after the wall time cover at most one change of the clock.
    day = F.expr("interval 1 day")
    shifted = lambda w, z, d: w - (F.from_utc_timestamp(w + d, z) - (w + d))
    zone = lambda i: F.coalesce(F.col(f"_zone{i}"), F.lit("UTC"))
    out = out.withColumns({f"_b{i}": shifted(F.col(f"_w{i}"), zone(i), -day) for i, *_ in each} | {f"_a{i}": shifted(F.col(f"_w{i}"), zone(i), day) for i, *_ in each})
    out = out.withColumns({f"_fb{i}": F.from_utc_timestamp(F.col(f"_b{i}"), zone(i)) == F.col(f"_w{i}") for i, *_ in each} | {f"_fa{i}": F.from_utc_timestamp(F.col(f"_a{i}"), zone(i)) == F.col(f"_w{i}") for i, *_ in each})
    # An abbreviation had other offsets at other times: it settles those instants whose offset it had by the zone's rules.
    said = lambda i, at: F.col(f"_n{i}").isNull() | F.array_contains(F.col(f"_n{i}"), (F.unix_seconds(F.col(f"_w{i}")) - F.unix_seconds(F.col(at))).cast("int"))
    out = out.withColumns({f"_sb{i}": F.col(f"_fb{i}") & said(i, f"_b{i}") for i, *_ in each} | {f"_sa{i}": F.col(f"_fa{i}") & said(i, f"_a{i}") for i, *_ in each})
    # A filter on the result would be pushed below these steps with all of them written out in it, again and again for each use;
    # a generator of one row stops that and stays in the same stage.
    kept = [f"_{k}{i}" for i, *_ in each for k in ("t", "f", "w", "o", "zone", "n", "b", "a", "sb", "sa")]
    out = out.select(*place.values(), F.explode(F.array(F.struct(*kept))).alias("_steps")).select(*place.values(), *[F.col(f"_steps.{c}").alias(c) for c in kept])
    none = F.lit(None).cast("bigint")

    def instant(i: int) -> Column:
        t, f, w, offset, before, after, fb, fa = (F.col(f"_{k}{i}") for k in ("t", "f", "w", "o", "b", "a", "sb", "sa"))
        named, abbreviated = F.element_at(F.col(f"_n{i}"), -1), F.col(f"_n{i}").isNotNull()
        micro = F.coalesce(F.substring(F.rpad(_at(f, 7), 6, "0"), 1, 6).try_cast("bigint"), F.lit(0))
        first, last = F.unix_micros(F.least(before, after)) + micro, F.unix_micros(F.greatest(before, after)) + micro
        received = F.unix_micros(received_at)
        picks = {"later_not_after": F.when(received.isNull() | (last <= received), last).otherwise(first), "earlier": first, "later": last, "null": none}
        gap = F.unix_micros(before) + micro if nonexistent == "shift" else none
        epoch = _epoch(t)
        out = lambda us, status, pattern=_at(f, 0): F.struct(us.alias("utc_us"), (F.lit(status) if isinstance(status, str) else status).alias("status"), pattern.alias("pattern"))
        return (
            F.when(t.isNull() | (t == ""), F.lit(None).cast(RESULT))
            .when(f.isNull() & epoch.isNotNull(), out(epoch, "exact", F.lit("epoch")))
            .when(w.isNull(), out(none, "unreadable"))
            .when(offset.isNotNull(), out(F.unix_micros(w) - offset.cast("bigint") * 1_000_000 + micro, "exact"))
            .when(F.col(f"_zone{i}").isNull(), out(none, "no_zone"))
            .when(fb & fa & (before != after), out(picks[ambiguous], "ambiguous"))
            .when(fb | fa, out(F.when(fb, F.unix_micros(before)).otherwise(F.unix_micros(after)) + micro, F.when(abbreviated, "exact").otherwise("zoned")))
            .when(abbreviated, out(F.unix_micros(w) - named.cast("bigint") * 1_000_000 + micro, "exact"))
            .otherwise(out(gap, "skipped"))
        )

    return out.select(*[F.col(c).alias(n) for n, c in place.items()], *[instant(i).alias(n + suffix) for i, n, _ in each])


def agreed_instant(structs: list[Column]) -> Column:
    """One instant from several texts of a row: settled texts go before wall times with a policy, finer ones before coarser, then the order given."""
    rank = {"exact": 0, "zoned": 1, "ambiguous": 2}
    ranks = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    cells = F.array(*[F.struct(F.try_element_at(ranks, s["status"]).alias("r"), F.when(s["utc_us"] % 1_000_000 != 0, 0).otherwise(1).alias("coarse"), F.lit(i).alias("i"), s["utc_us"].alias("us")) for i, s in enumerate(structs)])
    good = F.filter(cells, lambda c: c["us"].isNotNull())
    return F.array_min(good)["us"]
