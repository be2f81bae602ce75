"""Mixed timestamp texts to one unambiguous form, inside the JVM.

An ordered cascade of anchored patterns recognises a text. The first pattern that matches rewrites the text into ten
fields joined by ``|``; the fields are then validated strictly, so a matching shape with an impossible day or hour gives
no result. The default zone comes from a lookup by local day.

Policies: a written offset, zone or abbreviation wins; a local time that occurs twice is the first occurrence; a local
time that was skipped takes the offset from before the change; digits beyond milliseconds are cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import computed_once
from ..session import lookup_rows

MOST_ZONE_RULES = 500
MOST_ABBREVIATIONS = 500

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"(?: ?(Z|z|[+-]\d{2}:?\d{2}|[A-Za-z]{1,5}|[A-Za-z_]+/[A-Za-z_/+-]+[0-9]*))?"
_TIME = rf"(?:[T ] ?{_CLOCK}{_ZONE})?"
_DAY_NAME = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? )?"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"

# pattern, template of year|month|day|hour|minute|second|fraction|meridiem|zone|epoch
CASCADE = (
    (r"^(\d{10})$", "|||||||||$1|"),
    (r"^(\d{13})$", "||||||||||$1"),
    (r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?)?$", "$1|$2|$3|$4|$5|$6|||$7||"),
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){_TIME}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9||"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_TIME}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9||"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_TIME}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9||"),
    (rf"(?i)^{_DAY_NAME}(\d{{1,2}}) {_MONTH},? (\d{{4}}){_TIME}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9||"),
    (rf"(?i)^{_DAY_NAME}{_MONTH} (\d{{1,2}}),? (\d{{4}}){_TIME}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9||"),
    (rf"^{_CLOCK}{_ZONE}$", "|||$1|$2|$3|$4|$5|$6||"),
)

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


@dataclass(frozen=True)
class ZoneRules:
    """The lookups a normalisation needs, checked to be small: home zones by first day, offsets by abbreviation."""

    home: tuple[tuple[str, str], ...]
    offsets: tuple[tuple[str, int], ...]
    known: tuple[str, ...]

    @staticmethod
    def load(spark: SparkSession, home_zones: DataFrame, zone_names: DataFrame) -> ZoneRules:
        home = lookup_rows(home_zones.select("valid_from", "iana_zone").dropna(), MOST_ZONE_RULES, "home_zones")
        names = lookup_rows(zone_names.select("abbreviation", "utc_offset_minutes").dropna(), MOST_ABBREVIATIONS, "zone_names")
        known = sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
        unknown = sorted({r[1] for r in home} - set(known))
        if unknown:
            raise ValueError(f"home_zones names unknown zones: {unknown}")
        return ZoneRules(
            tuple(sorted((r[0], r[1]) for r in home)), tuple(sorted((r[0].upper(), r[1]) for r in names)), tuple(known)
        )

    def home_zone(self, day: Column) -> Column:
        """Zone of the latest rule not after the local day (``YYYY-MM-DD``); null before the first rule."""
        out = F.lit(None).cast("string")
        for valid_from, zone in self.home:  # the last rule that applies is the outermost branch
            out = F.when(day >= valid_from, F.lit(zone)).otherwise(out)
        return out


def _canonical(text: Column) -> Column:
    text = F.regexp_replace(F.trim(F.regexp_replace(text, r"[\s ]+", " ")), r"^ | $", "")
    out = F.lit(None).cast("string")
    for pattern, template in reversed(CASCADE):
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, template)).otherwise(out)
    return out


def _month_number(text: Column) -> Column:
    by_name = reduce(lambda rest, m: F.when(F.lower(text) == m[1], F.lit(m[0])).otherwise(rest), enumerate(_MONTHS, 1), F.lit(None).cast("int"))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).otherwise(by_name)


def parse_parts(df: DataFrame, value: str, prefix: str = "_t") -> DataFrame:
    """Add the recognised and validated parts of ``value``; all null where nothing matches or a part is impossible.

    Columns: ``{prefix}_day`` (date text), ``_clock`` (seconds of the day), ``_ms``, ``_zone`` (text), ``_epoch`` (ms).
    """
    raw = f"{prefix}_raw"
    df = computed_once(df, **{raw: F.split(_canonical(F.col(value).cast("string")), r"\|")})
    part = lambda i: F.nullif(F.col(raw)[i], F.lit(""))
    number = lambda i: part(i).try_cast("int")
    midnight = (F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    day = F.try_make_timestamp_ntz(number(0), _month_number(part(1)), number(2), *midnight)
    hour = F.when(part(7).isNull(), F.when(number(3) <= 23, number(3))).otherwise(
        F.when(number(3).between(1, 12), number(3) % 12 + F.when(F.lower(part(7)) == "p", 12).otherwise(0))
    )
    second = F.coalesce(number(5), F.lit(0))
    df = computed_once(
        df,
        **{
            f"{prefix}_day": F.substring(day.cast("string"), 1, 10),
            f"{prefix}_clock": F.when((number(4) <= 59) & (second <= 59), hour * 3600 + number(4) * 60 + second),
            f"{prefix}_ms": F.rpad(F.substring(F.coalesce(part(6), F.lit("")), 1, 3), 3, "0"),
            f"{prefix}_zone": part(8),
            f"{prefix}_epoch": F.coalesce(part(9).try_cast("bigint") * 1000, part(10).try_cast("bigint")),
            f"{prefix}_has_day": part(0).isNotNull(),
            f"{prefix}_has_clock": part(3).isNotNull(),
        },
    )
    c = lambda name: F.col(f"{prefix}_{name}")
    good = c("epoch").isNotNull() | (
        (~c("has_day") | c("day").isNotNull()) & (~c("has_clock") | c("clock").isNotNull()) & (c("has_day") | c("has_clock"))
    )
    fields = {n: F.when(good, c(n)) for n in ("day", "clock", "ms", "zone", "epoch")}
    out = computed_once(df, **{f"{prefix}_good_{n}": v for n, v in fields.items()})
    made = [f"{prefix}_{n}" for n in (*fields, "has_day", "has_clock")]
    return out.drop(raw, *made).withColumnsRenamed({f"{prefix}_good_{n}": f"{prefix}_{n}" for n in fields})


def normalize_times(
    df: DataFrame, value: str, rules: ZoneRules, day_column: str | None = None, default_zone: str | None = None
) -> DataFrame:
    """Add ``instant`` (timestamp_ntz in UTC), ``ms`` text and ``normal`` text for the times written in ``value``.

    ``default_zone`` is the zone of values without one; ``None`` means the owner's zone of the local day. A time of day
    takes its day from ``day_column`` if that holds a readable plain day, else it has no result. Null, blank, wordy and
    impossible values give null in all three columns. Plain days give ``normal`` only. Rows and other columns are kept.
    """
    keep = df.columns
    df = parse_parts(df, value, "_t")
    if day_column:
        df = parse_parts(df, day_column, "_d")
        other = F.when(F.col("_d_clock").isNull() & F.col("_d_epoch").isNull(), F.col("_d_day"))
    else:
        other = F.lit(None).cast("string")
    t = lambda f: F.col(f"_t_{f}")
    df = computed_once(df, _day=F.coalesce(t("day"), other))
    zone = t("zone")
    upper = F.upper(zone)
    offset = F.lit(None).cast("int")
    for name, minutes in rules.offsets:
        offset = F.when(upper == name, F.lit(minutes)).otherwise(offset)
    digits = F.regexp_replace(zone, ":", "")
    size = F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")
    numeric = F.when(
        (F.substring(digits, 2, 2).try_cast("int") <= 18) & (F.substring(digits, 4, 2).try_cast("int") <= 59),
        F.when(F.substring(zone, 1, 1) == "-", -size).otherwise(size),
    )
    df = computed_once(df, _offset=F.when(zone.rlike(r"^[+-]\d"), numeric).when(upper == "Z", F.lit(0)).otherwise(offset))
    home = F.lit(default_zone) if default_zone else rules.home_zone(F.col("_day"))
    df = computed_once(df, _zone=F.when(zone.isNull(), home).when(F.col("_offset").isNull() & zone.isin(*rules.known), zone))
    local = (F.col("_day").try_cast("timestamp_ntz") + F.make_dt_interval(secs=t("clock").cast("decimal(18,6)")))
    by_offset = local - F.make_dt_interval(mins=F.col("_offset"))
    by_zone = F.convert_timezone(F.col("_zone"), F.lit("UTC"), local)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=F.floor(t("epoch") / 1000).cast("decimal(18,6)")
    )
    df = computed_once(
        df,
        instant=F.when(t("epoch").isNotNull(), epoch)
        .when(t("clock").isNull(), F.lit(None).cast("timestamp_ntz"))
        .when(F.col("_offset").isNotNull(), by_offset)
        .when(F.col("_zone").isNotNull(), by_zone),
        ms=F.when(t("epoch").isNotNull(), F.lpad((t("epoch") % 1000).cast("string"), 3, "0")).otherwise(t("ms")),
    )
    df = computed_once(df, ms=F.when(F.col("instant").isNotNull(), F.col("ms")))
    whole = F.regexp_replace(F.substring(F.col("instant").cast("string"), 1, 19), " ", "T")
    plain_day = F.when(t("epoch").isNull() & t("clock").isNull(), t("day"))
    df = computed_once(df, normal=F.coalesce(F.concat(whole, F.lit("."), F.col("ms"), F.lit("Z")), plain_day))
    return df.select(*[c for c in keep if c not in ("instant", "ms", "normal")], "instant", "ms", "normal")


SOURCES = (
    ("messages", "timestamp", "date", None),
    ("tastings", "tasted_at", None, None),
    ("people", "created_at", None, "UTC"),
    ("files", "date", None, None),
)


def normalized_sources(spark: SparkSession, load, rules: ZoneRules) -> DataFrame:
    """All dated columns of the knowledge base as (source_table, row_id, normal); ``load(name)`` gives a table."""
    parts = []
    for name, column, day, zone in SOURCES:
        df = load(name).select(F.col("id").alias("row_id"), F.col(column).alias("_value"), *([F.col(day).alias("_date")] if day else []))
        out = normalize_times(df, "_value", rules, "_date" if day else None, zone)
        parts.append(out.where("normal is not null").select(F.lit(name).alias("source_table"), "row_id", "normal"))
    return reduce(DataFrame.unionAll, parts)
