"""Star-schema queries and maintenance of producers, their items and tastings. [JOI07-11, SRT05-07, SET05, DML09-13]"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ascii_lower, numbered


def find_by_name(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose any given column holds the query (ASCII case ignored, % and _ are wildcards). [FLT01-03]"""
    from .search import substring_like

    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(substring_like(F.col(c), query), F.lit(False))
    return df.where(hit)


def resolve(df: DataFrame, key: str | int, name_column: str = "name") -> DataFrame:
    """The one row with this id or exact name (ASCII case ignored); none or several raise. [FLT04-06]"""
    text = str(key)
    hit = (F.col("id") == int(text)) if text.isdigit() else (ascii_lower(F.col(name_column)) == "".join(c.lower() if c.isascii() else c for c in text))
    rows = df.where(hit).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{'no' if not rows else 'more than one'} row for {key!r}")
    return df.where(F.col("id") == rows[0]["id"])


def with_children(parents: DataFrame, children: DataFrame, key: str, order: Iterable[str], name: str = "items") -> DataFrame:
    """Parents with their children as an ordered array of structs; parents without any have an empty array. [JOI11]"""
    others = [c for c in children.columns if c != key and c not in tuple(order)]
    packed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *others))).alias(name))
    out = parents.join(packed, key, "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.array()))


def of_kind(parents: DataFrame, children: DataFrame, key: str, condition: Column) -> DataFrame:
    """Parents that have a child under the condition, each once. [JOI08]"""
    return parents.join(children.where(condition).select(key), key, "left_semi")


def without_events(rows: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Rows that no event names. [JOI10]"""
    return rows.join(events.select(key), key, "left_anti")


def recent(events: DataFrame, n: int, since: str | None = None, at: str = "tasted_at", fallback: str = "created_at") -> DataFrame:
    """The n latest events by written date, else by creation, as texts; ties by larger id. [JOI09, SRT05]"""
    when = F.coalesce(F.nullif(F.col(at), F.lit("")), F.col(fallback))
    rows = events if since is None else events.where(when >= since)
    return rows.withColumn("at", when).orderBy(F.desc_nulls_last("at"), F.desc("id")).limit(n)


def last_per_group(events: DataFrame, key: str, n: int, at: str = "tasted_at") -> DataFrame:
    """The n latest events of every group, undated ones last. [SRT06]"""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.desc("id"))
    return events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def vocabulary(df: DataFrame, column: str, constant: Iterable[str]) -> DataFrame:
    """Values in use and the fixed vocabulary, each once. [AGG15, SET02]"""
    fixed = df.sparkSession.createDataFrame([(v,) for v in constant], "value string")
    return df.select(F.col(column).alias("value")).where("value is not null").union(fixed).distinct()


def by_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Rows with ``place`` by name, ASCII case ignored, then id. [SRT07]"""
    return numbered(df.withColumn("_k", ascii_lower(F.col(name))), "place", "_k", "id").drop("_k")


def with_producer(items: DataFrame, producers: DataFrame, query: str, kind: str | None = None, status: str | None = None) -> DataFrame:
    """Items with ``producer_name`` whose own or producer's name holds the query, of a kind (ASCII case ignored) and status. [JOI07, FLT03]"""
    both = items.join(producers.select(F.col("id").alias("producer_id"), F.col("name").alias("producer_name")), "producer_id")
    both = find_by_name(both, query, "name", "producer_name")
    if kind is not None:
        both = both.where(ascii_lower(F.col("type")) == "".join(c.lower() if c.isascii() else c for c in kind))
    return both if status is None else both.where(F.col("status") == status)


# States of an item.
STATUSES = ("wishlist", "acquired", "in-cellar", "consumed", "gifted")


def checked_items(rows: DataFrame) -> DataFrame:
    """New items with their defaults: quantity 1, status in-cellar; a row without name or producer, or with an unknown status or a
    negative quantity, raises. [DML10]"""
    full = rows.withColumn("quantity", F.coalesce("quantity", F.lit(1))).withColumn("status", F.coalesce("status", F.lit("in-cellar")))
    good = F.col("name").isNotNull() & F.col("producer_id").isNotNull() & F.col("status").isin(*STATUSES) & (F.col("quantity") >= 0)
    return full.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad item: "), F.coalesce("name", F.lit(""))))))


def event_fault(rating: Column, day: Column) -> Column:
    """What is wrong with a tasting: a rating outside 0 to 100, a day that is none; null where nothing is. [DML12]"""
    real = F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.lit(False))
    return F.when((rating < 0) | (rating > 100), F.lit("rating")).when(day.isNotNull() & (day != "") & ~real, F.lit("day"))


def add_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """Events with the new ones, whose ids follow the largest, in the order of ``bottle_id`` and day; a faulty one raises. [DML12]"""
    fault = event_fault(F.col("rating"), F.col("tasted_at"))
    good = new.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault)))
    top = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = numbered(good, "_n", "bottle_id", "tasted_at").join(top, F.lit(True)).withColumn("id", F.col("_top") + F.col("_n"))
    return events.unionByName(fresh.drop("_n", "_top"), allowMissingColumns=True)


def rate(items: DataFrame, events: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, events): a tasting for each row of ``ratings`` (bottle_id, tasted_at, rating), and the latest of them on the item. [DML12]"""
    last = ratings.where("rating is not null").groupBy("bottle_id").agg(F.max_by("rating", F.struct("tasted_at", "rating")).alias("rating"))
    return update(items, last.withColumnRenamed("bottle_id", "id"), ["rating"]), add_events(events, ratings)


def search_both(producers: DataFrame, items: DataFrame, query: str) -> DataFrame:
    """(kind, id, name) of producers and items whose name holds the query. [SET05, RET09]"""
    tag = lambda df, kind: find_by_name(df, query, "name").select(F.lit(kind).alias("kind"), "id", "name")
    return tag(producers, "producer").unionAll(tag(items, "item"))


def invalid_ratings(events: DataFrame) -> DataFrame:
    """Events whose rating is outside 0 to 100; a missing rating is fine."""
    return events.where("rating is not null and (rating < 0 or rating > 100)")


def upsert(table: DataFrame, new: DataFrame, name_column: str = "name") -> DataFrame:
    """Table with the new rows whose name (ASCII case ignored) isn't there yet; ids follow the largest in name order. [DML09-10]"""
    key = ascii_lower(F.col(name_column))
    fresh = new.withColumn("_k", key).dropDuplicates(["_k"]).join(table.select(key.alias("_k")), "_k", "left_anti")
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = numbered(fresh, "_n", "_k").join(top, F.lit(True)).withColumn("id", F.col("_top") + F.col("_n"))
    return table.unionByName(fresh.drop("_k", "_n", "_top"), allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Table with the not-null values of ``changes`` (id, columns) written over it. [DML02, DML09]"""
    new = changes.select("id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = table.join(new, "id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c))
    return out.select(*table.columns)


def delete_cascade(producers: DataFrame, items: DataFrame, events: DataFrame, producer_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without a producer, its items and their events. [DML09]"""
    gone = items.where(F.col("producer_id") == producer_id).select(F.col("id").alias("bottle_id"))
    return producers.where(F.col("id") != producer_id), items.where(F.col("producer_id") != producer_id), events.join(gone, "bottle_id", "left_anti")


def consume(items: DataFrame, item_id: int) -> DataFrame:
    """One piece less, at least 0; status ``consumed`` at 0. [DML11]"""
    hit = F.col("id") == item_id
    left = F.greatest(F.lit(0), F.coalesce("quantity", F.lit(0)) - 1)
    return items.withColumn("status", F.when(hit & (left == 0), F.lit("consumed")).otherwise(F.col("status"))).withColumn("quantity", F.when(hit, left).otherwise(F.col("quantity")))


def remap(df: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """``df`` with ids of ``key`` replaced by ``mapping`` (old, new); other ids stay."""
    m = mapping.select(F.col("old").alias(key), F.col("new").alias("_new"))
    return df.join(m, key, "left").withColumn(key, F.coalesce("_new", key)).select(*df.columns)


def merge_producers(producers: DataFrame, items: DataFrame, events: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Producers ``old`` folded into ``new``: items move; an item whose name its new producer already has is dropped and its
    events go to the item that stays (the target's own, else the smallest id). [DML13]"""
    kept = producers.join(mapping.select(F.col("old").alias("id")), "id", "left_anti")
    moved = mapping.select(F.col("old").alias("producer_id"), F.col("new").alias("_new"))
    placed = items.join(moved, "producer_id", "left").withColumn("_target", F.coalesce("_new", "producer_id")).withColumn("_k", ascii_lower(F.col("name")))
    first = Window.partitionBy("_target", "_k").orderBy(F.col("_new").isNotNull(), "id")
    placed = placed.withColumn("_stay", F.first("id").over(first))
    new_items = placed.where("id = _stay").withColumn("producer_id", F.col("_target")).select(*items.columns)
    collisions = placed.where("id <> _stay").select(F.col("id").alias("old"), F.col("_stay").alias("new"))
    return kept, new_items, remap(events, "bottle_id", collisions)


def split_record(record: Column, item_keys: Iterable[str], event_keys: Iterable[str]) -> tuple[Column, Column, Column]:
    """(item, event, leftover) maps of one wide record. [SCA42]"""
    items, events = F.array(*[F.lit(k) for k in item_keys]), F.array(*[F.lit(k) for k in event_keys])
    inside = lambda keys: F.map_filter(record, lambda k, v: F.array_contains(keys, k))
    rest = F.map_filter(record, lambda k, v: ~F.array_contains(items, k) & ~F.array_contains(events, k))
    return inside(items), inside(events), rest
