"""Chat transcripts: parsing of day files, search, recency and summaries. [TGF07, FLT15-16, AGG06, WIN04-06, WIN12, RET08]"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import speaker_label

_HEADING = r"^## (\d{1,2}:\d{2}(?: [A-Z]{2,4})?)\s*$"
_SPEAKER = r"^\*\*([^*]+?):\*\*\s*(.*)$"
_PHOTO = r"!\[\[([^\]]+)\]\]"


def parse_day_files(files: DataFrame, key: str, text_column: str) -> DataFrame:
    """(key, pos, time, sender, text, photos): messages of day files. [TGF07, WIN05-06]

    A ``**Name:**`` line starts a message under the heading above it; following lines belong to it; blank lines and lines
    before the first speaker are dropped; attachments come out of the text. Windows run within one file.
    """
    lines = files.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text_column), "\n")).alias("line_no", "line")).where(r"line rlike '\\S'")
    order = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.nullif(F.regexp_extract("line", _HEADING, 1), F.lit(""))
    marked = lines.withColumn("heading", heading).withColumn("is_start", F.col("line").rlike(_SPEAKER).cast("int"))
    marked = marked.withColumn("time", F.last("heading", ignorenulls=True).over(order)).withColumn("pos", F.sum("is_start").over(order))
    kept = marked.where("heading is null and pos > 0")
    part = F.when(F.col("is_start") == 1, F.regexp_extract("line", _SPEAKER, 2)).otherwise(F.trim("line"))
    photos = F.regexp_extract_all("line", F.lit(_PHOTO), 1)
    rows = kept.select("key", "pos", "time", "line_no", "is_start", F.regexp_extract("line", _SPEAKER, 1).alias("sender"), F.trim(F.regexp_replace(part, _PHOTO, "")).alias("part"), photos.alias("photos"))
    grouped = rows.groupBy("key", "pos").agg(
        F.min_by("time", "line_no").alias("time"), F.max("sender").alias("sender"),
        F.array_sort(F.collect_list(F.struct("line_no", "part"))).alias("parts"), F.array_sort(F.collect_list(F.struct("line_no", "photos"))).alias("pictures"),
    )
    text = F.array_join(F.filter(F.transform("parts", lambda p: p["part"]), lambda x: x != ""), "\n")
    return grouped.select("key", "pos", "time", "sender", text.alias("text"), F.flatten(F.transform("pictures", lambda p: p["photos"])).alias("photos"))


def day_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, day) of files named YYYY-MM-DD.md, in any folder. [SRC19]"""
    return paths.where(F.col(path).rlike(r"(^|/)[0-9]{4}-[0-9]{2}-[0-9]{2}\.md$")).select(F.col(path).alias("path"), F.regexp_extract(path, r"([0-9-]{10})\.md$", 1).alias("day"))


def search(messages: DataFrame, query: str, since: str | None = None, until: str | None = None, sender: str | None = None) -> DataFrame:
    """Messages whose text holds the query (case ignored, any script), by day range and sender. An empty query finds none. [FLT15]"""
    if not query:
        return messages.limit(0)
    out = messages.where(F.lower("text").contains(query.lower()))
    if since:
        out = out.where(F.col("day") >= since)
    if until:
        out = out.where(F.col("day") <= until)
    return out if sender is None else out.where(F.col("sender") == sender)


def days_with_chats(messages: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """(day) [FLT16]"""
    days = messages.select("day").where("day is not null").distinct()
    if year:
        days = days.where(F.year(F.col("day").cast("date")) == year)
    return days if not month else days.where(F.month(F.col("day").cast("date")) == month)


def last_messages(messages: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The last n messages of every group. [WIN12]"""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    return messages.withColumn("place", place).where(F.col("place") <= n)


def summary(messages: DataFrame) -> DataFrame:
    """(sender, n, days, photos): one row a sender and one over all with sender '*'. [AGG06]"""
    counts = (F.count("*").alias("n"), F.countDistinct("day").alias("days"), F.sum(F.coalesce(F.greatest(F.size("photos"), F.lit(0)), F.lit(0))).alias("photos"))
    each = messages.groupBy(F.coalesce("sender", F.lit("")).alias("sender")).agg(*counts)
    return each.unionAll(messages.agg(*counts).select(F.lit("*").alias("sender"), "n", "days", "photos"))


def rendered(messages: DataFrame, owner: str) -> DataFrame:
    """(day, pos, line): Markdown of a day, with a heading only where the minute changes. [WIN04, SCA45, DML23]"""
    order = Window.partitionBy("day").orderBy("pos")
    label = speaker_label(F.col("sender"), F.col("agent"), owner)
    body = F.concat(F.lit("**"), label, F.lit(":** "), F.coalesce("text", F.lit("")))
    fresh = ~F.coalesce(F.lag("time").over(order) == F.col("time"), F.lit(False))
    return messages.select("day", "pos", F.when(fresh, F.concat(F.lit("## "), "time", F.lit("\n\n"), body)).otherwise(body).alias("line"))
