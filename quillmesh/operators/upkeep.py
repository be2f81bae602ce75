"""Maintenance of notes and catalogues: entries, metadata, migrations, re-attribution, attachments, reports.
[DML14-15, DML21-22, DML27, SCA09, SCA22-27, SCA35, SCA40-43, SCA50-54, TGF09, TGF11, SNK06, SNK11]"""

from __future__ import annotations

import html
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions.columns import ascii_lower, numbered
from ..functions.text import attachment_kind, flag, minute_of_day, slug

_HEADING = r"(?m)^## (\d{1,2}:\d{2}) [A-Z]{2,4}"


def with_entry(text: Column, day: Column, time: Column, entry: Column) -> Column:
    """Day file with an entry put before the first one of a later minute, else at the end; a file without front matter gets
    the header of the day. Existing order is kept, even where it isn't sorted. [DML14, WIN09, SCA58]"""
    full = F.when(F.coalesce(text, F.lit("")).startswith("---"), text).otherwise(F.concat(fm.new_header(day), F.coalesce(text, F.lit(""))))
    block = F.concat(F.lit("## "), time, F.lit("\n"), entry)
    minutes = F.transform(F.regexp_extract_all(full, F.lit(_HEADING), 1), minute_of_day)
    # each existing entry is cut off at its heading; the new block goes before the first later one
    parts = F.split(F.regexp_replace(full, r"(?m)^(## \d{1,2}:\d{2} [A-Z]{2,4})", "\u0001$1"), "\u0001")
    later = F.filter(F.transform(minutes, lambda m, i: F.when(m > minute_of_day(time), i + 2)), lambda i: i.isNotNull())
    at = F.when(F.size(later) > 0, later[0])
    trimmed = F.regexp_replace(full, r"\n+$", "")
    inside = F.concat(F.array_join(F.slice(parts, F.lit(1), at - 1), ""), block, F.lit("\n\n"), F.array_join(F.slice(parts, at, F.size(parts)), ""))
    return F.when(at.isNull(), F.concat(trimmed, F.lit("\n\n"), block, F.lit("\n"))).otherwise(inside)


# Front-matter keys that name topics, by section.
TOPIC_KEYS = {"cellar": ("vintner", "distillery", "shipper", "region", "country"), "people": ("name", "role", "company", "location")}


def derived_metadata(text: Column, section: Column) -> Column:
    """Struct (people, topics, action_items, dates_mentioned) from the front matter of journal, cellar and people notes; null for
    others. Up to 8 topics, each once. [SCA09, AGG11]"""
    low = F.lower(F.coalesce(section, F.lit("")))
    listed = lambda key: F.when(F.size(fm.list_field(text, key)) > 0, fm.list_field(text, key)).otherwise(F.filter(F.split(F.coalesce(fm.get_field(text, key), F.lit("")), r"\s*,\s*"), lambda x: (x != "") & ~x.startswith("[")))
    scalars = lambda keys: F.filter(F.array(*[fm.get_field(text, k) for k in keys]), lambda x: x.isNotNull())
    more = F.when(low.startswith("cellar/"), F.concat(F.array(F.substring_index(low, "/", -1)), scalars(TOPIC_KEYS["cellar"])))
    more = F.coalesce(more.when(low == "people", scalars(TOPIC_KEYS["people"])), F.array().cast("array<string>"))
    people = F.transform(listed("people"), lambda x: F.trim(F.regexp_replace(x, r"\s*\(\d+\)\s*$", "")))
    dates = F.transform(F.filter(scalars(("date", "date_tasted", "created")), lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}")), lambda x: F.substring(x, 1, 10))
    topics = F.slice(F.array_distinct(F.filter(F.concat(listed("tags"), more), lambda x: x != "")), 1, 8)
    out = F.struct(people.alias("people"), topics.alias("topics"), F.array().cast("array<string>").alias("action_items"), dates.alias("dates_mentioned"))
    return F.when(low.startswith("journal") | low.startswith("cellar/") | low.startswith("people"), out)


def days_of_spec(spec: Column) -> Column:
    """Sorted days of ``day``, ``a..b`` and comma-separated mixes of both; ranges in either order; a bad token raises. [TGF09, SET09]"""
    one = r"\s*\d{4}-\d{2}-\d{2}\s*"
    good = spec.rlike(rf"^(?:{one}(?:\.\.{one})?|\s*)(?:,(?:{one}(?:\.\.{one})?|\s*))*$") & spec.rlike(r"\d")
    tokens = F.filter(F.transform(F.split(spec, ","), lambda t: F.trim(t)), lambda t: t != "")
    ends = F.transform(tokens, lambda t: F.transform(F.split(t, r"\s*\.\.\s*"), lambda x: x.cast("date")))
    spans = F.transform(ends, lambda e: F.sequence(F.array_min(e), F.array_max(e)))
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(spans)))).otherwise(F.raise_error(F.concat(F.lit("bad dates: "), F.coalesce(spec, F.lit("")))).cast("array<date>"))


def last_days(today: Column, n: int) -> Column:
    """The n days that end with today. [SCA25-26]"""
    return F.sequence(F.date_sub(today, n - 1), today)


def local_time(utc: Column, zone: Column) -> Column:
    """Struct (date, time, offset_minutes) of a UTC time (without zone) in an IANA zone. [SCA22-23]"""
    local = F.convert_timezone(F.lit("UTC"), zone, utc)
    seconds = F.timestamp_diff("SECOND", utc, local)
    text = local.cast("string")
    return F.struct(F.substring(text, 1, 10).alias("date"), F.substring(text, 12, 5).alias("time"), F.floor(seconds / 60).cast("int").alias("offset_minutes"))


def mail_text(raw: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, header, body): the part before the first blank line, and the rest without tags, with entities read. [SCA35]"""

    @F.pandas_udf("string")
    def unescaped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if t is not None else None)

    t = F.col(text_column)
    at = F.instr(t, "\n\n")
    header = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
    body = F.when(at > 0, F.substring(t, at, F.length(t))).otherwise(t)
    rows = raw.select(F.col(id_column).alias("id"), F.trim(header).alias("header"), unescaped(F.regexp_replace(body, "<[^>]+>", " ")).alias("body"))
    return rows.withColumn("body", F.trim(F.regexp_replace("body", r"\s+", " ")))


def derived_status(in_cellar: Column, quantity: Column) -> Column:
    """[SCA41]"""
    return F.when(F.coalesce(~flag(in_cellar), F.lit(False)) | F.coalesce(quantity.try_cast("int") == 0, F.lit(False)), F.lit("consumed")).otherwise(F.lit("in-cellar"))


def iso_day(text: Column) -> Column:
    """The text where it is a real ISO day, else null. [SCA40, SCA49]"""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & t.try_cast("date").isNotNull(), t)


def split_records(records: DataFrame, record: str, item_fields: Mapping[str, str], event_fields: Mapping[str, str]) -> DataFrame:
    """Add ``item`` and ``event`` (maps by target name, blank values dropped) and ``leftover`` (``key: value`` lines of all other
    keys, by key) of a map column. [SCA42, TGF11]"""
    m = F.col(record)
    filled = F.map_filter(m, lambda k, v: v.isNotNull() & (F.trim(v) != ""))

    def part(fields: Mapping[str, str]) -> Column:
        names = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
        inside = F.map_filter(filled, lambda k, v: F.map_contains_key(names, k))
        return F.transform_values(F.transform_keys(inside, lambda k, v: names[k]), lambda k, v: F.trim(v))

    known = F.array(*[F.lit(k) for k in ("name", *item_fields, *event_fields)])
    rest = F.array_sort(F.map_entries(F.map_filter(filled, lambda k, v: ~F.array_contains(known, k))))
    lines = F.transform(rest, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return records.withColumn("item", part(item_fields)).withColumn("event", part(event_fields)).withColumn("leftover", lines)


def prose_by_heading(body: Column) -> Column:
    """Map of the text under each level-2 heading, without a leading ``Notes:``; empty sections are left out. [SCA43]"""
    sections = F.slice(F.split(F.concat(F.lit("\n"), body), r"\n## "), 2, 1_000_000)
    pairs = F.transform(sections, lambda s: F.struct(F.trim(F.substring_index(s, "\n", 1)).alias("k"), F.regexp_replace(F.regexp_replace(s, r"(?s)\A[^\n]*\n?", ""), r"(?s)\A\s*(?:Notes:\s*)?|\s+\z", "").alias("v")))
    kept = F.filter(pairs, lambda p: p["v"] != "")
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def opening_prose(body: Column) -> Column:
    """Text before the first level-2 heading, without a leading level-1 heading. [SCA43]"""
    head = F.substring_index(F.concat(F.lit("\n"), body), "\n## ", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"\A\n", ""), r"\A#\s.+?(\n|\z)", ""), r"^\s+|\s+$", "")


def reattribute(items: DataFrame, producers: DataFrame, parses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, producers, tastings): calendar items moved to the producers that were read from their names. [DML15, JOI21]

    ``parses`` has (id, producer, item, day). Items without a producer, or whose producer stays, are kept. New producers get
    the next ids in name order. An item whose name the target has already is dropped, and its tasting goes to the target's.
    """
    key = lambda c: ascii_lower(F.col(c))
    own = producers.select(F.col("id").alias("producer_id"), F.col("name").alias("old_name"))
    moves = items.select("id", "producer_id").join(parses.where("producer is not null"), "id").join(own, "producer_id").where(key("producer") != key("old_name"))
    top = producers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = moves.groupBy(key("producer").alias("k")).agg(F.min("producer").alias("name")).join(producers.select(key("name").alias("k")), "k", "left_anti")
    fresh = numbered(fresh, "n", "k").join(top, F.lit(True)).select((F.col("top") + F.col("n")).alias("id"), "name")
    everyone = producers.unionByName(fresh, allowMissingColumns=True)
    target = everyone.select(F.col("id").alias("to"), key("name").alias("k"))
    moves = moves.withColumn("k", key("producer")).join(target, "k").select("id", "to", F.coalesce("item", "producer").alias("to_name"), "old_name", "day")
    there = items.select(F.col("producer_id").alias("to"), key("name").alias("nk"), F.col("id").alias("stays"))
    moves = moves.withColumn("nk", key("to_name")).join(there, ["to", "nk"], "left").withColumn("stays", F.when(F.col("stays") != F.col("id"), F.col("stays")))
    out = items.join(moves.select("id", "to", "to_name", "stays"), "id", "left").where("stays is null")
    out = out.withColumn("producer_id", F.coalesce("to", "producer_id")).withColumn("name", F.coalesce("to_name", "name")).select(*items.columns)
    tastings = moves.select(F.coalesce("stays", "id").alias("bottle_id"), F.col("old_name").alias("location"), F.when(F.col("day").isNotNull(), F.concat(F.lit("Day "), F.col("day").cast("string"))).alias("notes"))
    return out, everyone, tastings


def attachment_rows(sources: DataFrame, day: str = "day", clock: str = "clock") -> DataFrame:
    """(path, kind, name, wikilink) of attachments (path, day, clock, title): month folder by kind; names that repeat get a
    counter in path order. [SNK06, SNK13, SCA55]"""
    kind = attachment_kind(F.col("path"))
    suffix = F.coalesce(F.nullif(F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)), F.lit("")), F.lit(".bin"))
    base = F.concat_ws("-", F.date_format(day, "yyyy-MM-dd"), F.regexp_replace(clock, ":", ""), slug(F.col("title")))
    rows = sources.select("path", kind.alias("kind"), F.date_format(day, "yyyy/MM").alias("month"), base.alias("base"), suffix.alias("suffix"))
    n = F.row_number().over(Window.partitionBy("month", "kind", "base", "suffix").orderBy("path"))
    name = F.concat("base", F.when(n > 1, F.concat(F.lit("-"), (n - 1).cast("string"))).otherwise(F.lit("")), "suffix")
    rows = rows.withColumn("name", name)
    return rows.select("path", "kind", "name", F.concat(F.lit("![["), "month", F.lit("/"), "kind", F.lit("/"), "name", F.lit("]]")).alias("wikilink"))


def weather_line(days: DataFrame) -> DataFrame:
    """Add ``precipitation`` and ``wind_text`` to day figures. [SCA52]"""
    rain = F.concat(F.lit("Rain: "), F.col("rain").cast("int").cast("string"), F.lit("%"), F.when(F.col("precip") > 0, F.concat(F.lit(", "), F.format_string('%.2f"', "precip"))).otherwise(F.lit("")))
    text = F.when((F.col("snow") > F.col("rain")) & (F.col("snow") > 10), F.concat(F.lit("Snow: "), F.col("snow").cast("int").cast("string"), F.lit("%"))).when(F.col("rain") > 10, rain).otherwise(F.lit("Precip: <10%"))
    whole = lambda c: F.col(c).cast("int").cast("string")
    speed = F.when(F.col("min_wind") == F.col("max_wind"), whole("max_wind")).otherwise(F.concat(whole("min_wind"), F.lit("–"), whole("max_wind")))
    gusts = F.when(F.col("gust") > F.col("max_wind") + 5, F.concat(F.lit(" (gusts "), whole("gust"), F.lit("mph)"))).otherwise(F.lit(""))
    return days.withColumn("precipitation", text).withColumn("wind_text", F.concat(speed, F.lit("mph"), gusts))


def to_log(days: DataFrame, notes: DataFrame, key: str, text_column: str, markers: tuple[str, ...], force: bool = False) -> DataFrame:
    """Days whose note holds none of the markers yet, all of them where forced. [FLT25, DML27]"""
    if force:
        return days
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(F.col(text_column), F.lit(m))
    return days.join(notes.where(hit).select(key), key, "left_anti")


def record_block(kind: str, **columns: Column) -> Column:
    """Front matter of a note that belongs to a catalogue row; null values are left out. [SCA54]"""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in columns.items()]
    return F.concat_ws("\n", F.lit("---"), F.lit(f"kind: {kind}"), *lines, F.lit("---"), F.lit(""), F.lit(""))
