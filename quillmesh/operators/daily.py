"""Daily logs and checklists: parsing, editing, completion figures, rollover. [TGF05-06, AGG04-05, AGG09-10, JOI17-18, DML14, DML19-20]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import minute_of_day

_SECTION = r"(?m)^## Priorities[ \t]*\n((?:- \[[ xX]\] .*(?:\n|\z)|[ \t]*\n)*)"
ITEM = r"^- \[([ xX])\] (.+)$"


def checklist_items(text: Column) -> Column:
    """Array of (done, task) of all checkbox lines of a text, in order; other lines are ignored. [TGF05]"""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(ITEM))
    return F.transform(lines, lambda x: F.struct((F.lower(F.regexp_extract(x, ITEM, 1)) == "x").alias("done"), F.regexp_extract(x, ITEM, 2).alias("task")))


def priorities(text: Column) -> Column:
    """Items of the first ``## Priorities`` block; empty where there is none. [SRC17]"""
    return checklist_items(F.regexp_extract(text, _SECTION, 1))


def template_labels(text: Column) -> Column:
    """Labels of a template: checkbox lines and bare bullets; their state is ignored. [SRC18]"""
    line = r"^- (?:\[[ xX]\] )?(\S.*)$"
    lines = F.filter(F.split(F.regexp_replace(text, r"(?m)[ \t]+$", ""), "\n"), lambda x: x.rlike(line))
    return F.transform(lines, lambda x: F.trim(F.regexp_extract(x, line, 1)))


def rendered(items: Column) -> Column:
    """Checkbox lines of an array of items. [SCA34]"""
    return F.array_join(F.transform(items, lambda i: F.concat(F.lit("- ["), F.when(i["done"], F.lit("x")).otherwise(F.lit(" ")), F.lit("] "), i["task"])), "\n")


def with_priorities(text: Column, items: Column) -> Column:
    """Text with the block replaced, or inserted behind the front matter; the rest stays as it is. [SCA34]"""
    section = F.concat(F.lit("## Priorities\n"), rendered(items), F.lit("\n"))
    has = text.rlike(r"(?m)^## Priorities[ \t]*$")
    header = F.regexp_extract(text, r"(?s)\A(---\n.*?---\n)", 1)
    rest = F.substring(text, F.length(header) + 1, F.length(text))
    replaced = F.replace(F.regexp_replace(text, _SECTION, "\u0000"), F.lit("\u0000"), section)
    return F.when(has, replaced).otherwise(F.concat(header, F.lit("\n"), section, F.lit("\n"), rest))


def set_items(old: Column, labels: Column) -> Column:
    """New list of labels; a label keeps the state it had (the last one, where it stood twice). [JOI18]"""
    state = lambda label: F.element_at(F.filter(old, lambda i: i["task"] == label), -1)["done"]
    known = lambda label: F.exists(old, lambda i: i["task"] == label)
    return F.transform(labels, lambda x: F.struct(F.when(known(x), state(x)).otherwise(F.lit(False)).alias("done"), x.alias("task")))


def add_items(old: Column, labels: Column) -> Column:
    """Labels that aren't in the list yet, appended as open items; repeats inside the new labels stay. [SET08]"""
    fresh = F.filter(labels, lambda x: ~F.exists(old, lambda i: i["task"] == x))
    return F.concat(old, F.transform(fresh, lambda x: F.struct(F.lit(False).alias("done"), x.alias("task"))))


def remove_item(old: Column, label: Column) -> Column:
    return F.filter(old, lambda i: i["task"] != label)


def mark(old: Column, query: str, done: bool = True) -> Column:
    """List with the one matching item marked: an exact match (case ignored) wins, else a single substring match; none or
    several raise at run time. [FLT07, DML19]"""
    q = F.lit(query.lower())
    exact = F.filter(old, lambda i: F.lower(i["task"]) == q)
    part = F.filter(old, lambda i: F.contains(F.lower(i["task"]), q))
    hits = F.when(F.size(exact) > 0, exact).otherwise(part)
    one = F.when(F.size(hits) == 1, hits[0]["task"]).otherwise(F.raise_error(F.when(F.size(hits) == 0, F.lit(f"No priority matching {query}")).otherwise(F.lit(f"Ambiguous: {query}"))).cast("string"))
    return F.transform(old, lambda i: F.struct(F.when(i["task"] == one, F.lit(done)).otherwise(i["done"]).alias("done"), i["task"].alias("task")))


def rollover(items: DataFrame) -> DataFrame:
    """(day, pos, task): open items of a day that the next day doesn't have, appended to it in order, each once. [JOI17, DML20]

    ``items`` has day (date), pos, done, task. Days without any own item get none.
    """
    open_before = items.where("not done").groupBy(F.date_add("day", 1).alias("day"), "task").agg(F.min("pos").alias("pos"))
    target = items.select("day").distinct()
    return open_before.join(target, "day", "left_semi").join(items.select("day", "task"), ["day", "task"], "left_anti").select("day", "pos", "task")


def daily_completion(items: DataFrame) -> DataFrame:
    """(day, total, completed, open, rate) of every day with items. [AGG04]"""
    per_day = items.groupBy("day").agg(F.count("*").alias("total"), F.count_if("done").alias("completed"))
    return per_day.withColumn("open", F.col("total") - F.col("completed")).withColumn("rate", F.round(F.col("completed") / F.col("total"), 3))


def range_completion(items: DataFrame, first: str, last: str) -> DataFrame:
    """One row: days, total, completed, open, rate between two days in either order; the rate is null without items. [AGG04]"""
    low, high = sorted((first, last))
    rows = items.where(F.col("day").between(F.lit(low).cast("date"), F.lit(high).cast("date")))
    out = rows.agg(F.countDistinct("day").alias("days"), F.count("*").alias("total"), F.count_if("done").alias("completed"))
    return out.withColumn("open", F.col("total") - F.col("completed")).withColumn("rate", F.round(F.try_divide(F.col("completed"), F.col("total")), 3))


def frequently_open(items: DataFrame, n: int = 10, least: int = 2) -> DataFrame:
    """(task, days): tasks open on most days, at least ``least``; ties by task. [AGG05, SRT13]"""
    days = items.where("not done").groupBy("task").agg(F.countDistinct("day").alias("days"))
    return days.orderBy(F.desc("days"), "task").limit(n).where(F.col("days") >= least)


_ENTRY = r"(?m)^## (\d{1,2}:\d{2} [A-Z]{2,4})[ \t]*\n"


def journal_entries(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pos, time, minute, text, photos): entries under ``## HH:MM ZONE`` headings; other headings belong to the entry
    before them, and text before the first entry is dropped. ``photos`` has (alt, filename) of images in photos/; images,
    details blocks and italics leave the text. [TGF06, AGG12, SCA50]"""
    marked = F.regexp_replace(F.col(text_column), _ENTRY, "\u0001$1\u0002")
    parts = F.slice(F.split(marked, "\u0001"), 2, 1_000_000)
    rows = texts.where(F.col(text_column).rlike(_ENTRY)).select(F.col(id_column).alias("id"), F.posexplode(parts).alias("pos", "part"))
    out = rows.select("id", "pos", F.substring_index("part", "\u0002", 1).alias("time"), F.substring_index("part", "\u0002", -1).alias("body"))
    image = r"!\[([^\]]*)\]\(photos/([^)]+)\)"
    found = F.arrays_zip(F.regexp_extract_all("body", F.lit(image), 1).alias("alt"), F.regexp_extract_all("body", F.lit(image), 2).alias("filename"))
    text = F.regexp_replace("body", r"!\[[^\]]*\]\([^)]+\)\n?", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<details>.*?</details>", ""), r"\*([^*]+)\*", "$1")
    return out.select("id", "pos", "time", minute_of_day(F.col("time")).alias("minute"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"), found.alias("photos"))


def day_photos(entries: DataFrame) -> DataFrame:
    """(id, time, alt, filename): the middle photo of each text, captioned photos preferred. [WIN03]"""
    photos = entries.select("id", "time", "pos", F.posexplode("photos").alias("n", "photo"))
    photos = photos.select("id", "time", "photo.alt", "photo.filename", (F.col("pos") * 10_000 + F.col("n")).alias("place"))
    captioned = (F.col("alt") != "") & ~F.col("alt").rlike(r"\.(jpg|png|jpeg)$")
    return middle_of_day(photos, "id", "place", captioned).drop("place")


def insertion_place(entries: Column, minute: Column) -> Column:
    """0-based place of a new entry: before the first one with a later minute, else at the end. [WIN09]"""
    later = F.filter(F.transform(entries, lambda e, i: F.when(e["minute"] > minute, i)), lambda i: i.isNotNull())
    return F.when(F.size(later) > 0, later[0]).otherwise(F.size(entries))


def middle_of_day(rows: DataFrame, day: str, order: str, better: Column) -> DataFrame:
    """One row a day: the middle one (n div 2) of the better rows, or of all rows where there is no better one. [WIN03]"""
    tier = F.when(better, 0).otherwise(1)
    w = Window.partitionBy(day, "_tier")
    ranked = rows.withColumn("_tier", tier).withColumn("_rn", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    picked = ranked.where(F.col("_rn") == F.floor(F.col("_n") / 2) + 1)
    best = picked.groupBy(day).agg(F.min_by(F.struct(*rows.columns), "_tier").alias("r"))
    return best.select("r.*")


def expand_days(spans: DataFrame, first: str, last: str) -> DataFrame:
    """(day): all days of all spans (in either order), each once. [SET09, TGF09, SRT14]"""
    low, high = F.least(first, last), F.greatest(first, last)
    return spans.where(low.isNotNull()).select(F.explode(F.sequence(low, high)).alias("day")).distinct()


def contiguous(days: DataFrame, day: str) -> DataFrame:
    """One row: first, last, n and whether no day between is missing. [WIN11]"""
    out = days.select(day).distinct().agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n"))
    return out.withColumn("contiguous", F.datediff("last", "first") + 1 == F.col("n"))


def weather_day(hours: DataFrame, key: str) -> DataFrame:
    """Day figures of hourly rows (hour, temp, rain, snow, precip, wind, gust, direction): extremes with their first hour,
    sums, and the most frequent wind direction (ties by name). [AGG09-10]"""
    first_at = lambda sign: F.min_by("hour", F.struct(sign * F.col("temp"), F.col("hour")))
    base = hours.groupBy(key).agg(
        F.max("temp").alias("max_temp"), first_at(-1).alias("max_hour"), F.min("temp").alias("min_temp"), first_at(1).alias("min_hour"),
        F.max("rain").alias("rain"), F.max("snow").alias("snow"), F.round(F.sum("precip"), 2).alias("precip"),
        F.min("wind").alias("min_wind"), F.max("wind").alias("max_wind"), F.max("gust").alias("gust"),
    )
    votes = hours.where("direction is not null").groupBy(key, "direction").count()
    mode = votes.groupBy(key).agg(F.min_by("direction", F.struct(-F.col("count"), F.col("direction"))).alias("direction"))
    return base.join(mode, key, "left")
