"""Adapters for records of other services, on supplied JSON, and offline stand-ins for models. [FLT10-13, SRC23-29, SRC32, DML25, UDF01-06]"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup_rows

MOST_ALIASES = 50_000
TASK_SCHEMA = "struct<id:string,content:string,description:string,project_id:string,labels:array<string>,priority:int,due:struct<date:string,string:string>,is_completed:boolean>"


def tasks(lines: DataFrame, column: str = "json") -> DataFrame:
    """Compact task rows of JSON records, with defaults for missing parts. [FLT10]"""
    t = lines.select(F.from_json(F.col(column), TASK_SCHEMA).alias("t"))
    return t.select(
        "t.id", F.coalesce("t.content", F.lit("")).alias("content"), F.col("t.project_id").alias("project_id"), F.coalesce("t.labels", F.array().cast("array<string>")).alias("labels"),
        F.coalesce("t.priority", F.lit(1)).alias("priority"), F.col("t.due.date").alias("due"),
    )


def select_tasks(rows: DataFrame, project: str | None = None, label: str | None = None, n: int | None = None) -> DataFrame:
    """Tasks by project and label, with ``matching`` = their number before the limit. [FLT11-12]"""
    if project is not None:
        rows = rows.where(F.col("project_id") == project)
    if label is not None:
        rows = rows.where(F.array_contains("labels", label))
    total = rows.agg(F.count("*").alias("matching"))
    out = rows.join(total, F.lit(True)).orderBy("id")
    return out if n is None else out.limit(n)


def due(rows: DataFrame, today: str, overdue: bool = False) -> DataFrame:
    """Tasks due on a day, or before it. [FLT13]"""
    return rows.where(F.col("due") < today) if overdue else rows.where(F.col("due") == today)


def hashing_embedding(text: str, dimensions: int = 64) -> list[float]:
    """Deterministic stand-in for an embedding model: signed word hashes, unit length. [UDF01]"""
    out = [0.0] * dimensions
    for word in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        out[h % dimensions] += 1.0 if h >> 63 else -1.0
    norm = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / norm for x in out]


def embedded(rows: DataFrame, text_column: str, embed: Callable[[str], list[float]] = hashing_embedding) -> DataFrame:
    """Rows with ``embedding`` of a text column, in batches inside the partitions; null texts have none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: embed(t) if t is not None else None)

    return rows.withColumn("embedding", run(F.col(text_column)))


def resolved_locations(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query, zone, n): zone of the alias that equals the query, else of the one alias that holds it, or that it holds, as
    whole words; ``n`` counts the zones found (more than one is ambiguous and gives no zone). [SCA24]

    ``aliases`` is a dimension (alias, zone) of at most ``MOST_ALIASES`` rows; more raise.
    """
    q = queries.select("query", F.lower(F.trim("query")).alias("_q")).distinct()
    a = aliases.select(F.lower(F.trim("alias")).alias("_a"), "zone")
    words = lambda c: F.concat(F.lit(" "), F.array_join(F.split(c, r"\W+"), " "), F.lit(" "))
    lookup_rows(a, MOST_ALIASES, "aliases")
    pairs = q.join(F.broadcast(a), (F.col("_q") == F.col("_a")) | words(F.col("_q")).contains(words(F.col("_a"))) | words(F.col("_a")).contains(words(F.col("_q"))), "left")
    exact = F.max(F.when(F.col("_q") == F.col("_a"), F.col("zone")))
    out = pairs.groupBy("query").agg(exact.alias("exact"), F.countDistinct("zone").alias("n"), F.min("zone").alias("any"))
    return out.select("query", F.coalesce("exact", F.when(F.col("n") == 1, F.col("any"))).alias("zone"), F.when(F.col("exact").isNotNull(), F.lit(1).cast("long")).otherwise(F.col("n")).alias("n"))


def looked_up(rows: DataFrame, column: str, fetch: Callable[[list[str]], list[str | None]], out: str, batch: int = 50) -> DataFrame:
    """Rows with the text that ``fetch`` gives for each value of a column, in batches inside the partitions: the adapter for
    geocoding, zones, mail threads, photo metadata, hosted extraction and models. A call that fails is
    repeated value by value, and only values that fail by themselves have nulls. [SRC25, SRC28-29, UDF02-06]"""

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in series:
            found: list[str | None] = []
            for k in range(0, len(values), batch):
                part = values.iloc[k : k + batch].tolist()
                try:
                    found += fetch(part)
                except Exception:  # noqa: BLE001
                    found += one_by_one(part)
            yield pd.Series(found, dtype=object)

    def one_by_one(part: list[str]) -> list[str | None]:
        again: list[str | None] = []
        for value in part:
            try:
                again += fetch([value])
            except Exception:  # noqa: BLE001
                again.append(None)
        return again

    return rows.withColumn(out, run(F.col(column)))


def first_known(*columns: str) -> Column:
    """The first source that has a value, for chains of fallbacks. [SRC29, SCA53]"""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


def changed_tasks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action, body): what a task service must be told: create, update or complete, with the JSON to send. [DML25]"""
    columns = [c for c in new.columns if c != "id"]
    body = lambda p: F.to_json(F.struct(*[F.col(f"{p}.{c}").alias(c) for c in columns]))
    both = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    action = F.when(F.col("o.id").isNull(), F.lit("create")).when(F.col("n.id").isNull(), F.lit("complete")).when(body("o") != body("n"), F.lit("update"))
    out = both.select(F.coalesce("o.id", "n.id").alias("id"), action.alias("action"), F.when(F.col("n.id").isNotNull(), body("n")).alias("body"))
    return out.where("action is not null")
