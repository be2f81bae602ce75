"""Looking up, adding and showing people; alias and catalogue dimensions. [DML01, DML24, FLT08-09, FLT23, JOI20, JOI22, JOI24, SRT08, AGG19]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import numbered
from .inventory import find_by_name
from .kinship import ancestors
from .relations import VALID_TYPES

# Columns that a search for people shows.
SHOWN = ("id", "name", "gender", "birthdate", "location", "profession", "phone", "aliases")


def find(people: DataFrame, query: str) -> DataFrame:
    """People whose name holds the query, by name; the few shown columns only reach the scan. [FLT09]"""
    return find_by_name(people.select(*SHOWN), query, "name").orderBy("name")


def resolve_person(people: DataFrame, key: str | int, listed: int = 20) -> DataFrame:
    """The one person with this id, or whose name holds the text; none or several raise, naming up to ``listed`` matches. [FLT06]"""
    text = str(key)
    hits = people.where(F.col("id") == int(text)) if text.isdigit() else find_by_name(people, text, "name")
    found = [f"{r['id']} {r['name']}" for r in hits.select("id", "name").orderBy("name", "id").limit(listed + 1).collect()]
    if len(found) != 1:
        raise LookupError(f"No person found matching {key!r}" if not found else f"Ambiguous person {key!r}, matches: {found[:listed]}")
    return hits


def as_json(rows: DataFrame) -> DataFrame:
    """(id, record): each row as JSON without its nulls. [FLT08, SNK09]"""
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("record"))


def add(people: DataFrame, new: DataFrame) -> DataFrame:
    """People with the new rows whose exact name isn't there; ids follow the largest, in name order. [DML01]"""
    fresh = new.dropDuplicates(["name"]).join(people.select("name"), "name", "left_anti")
    top = people.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = numbered(fresh, "_n", "name").join(top, F.lit(True)).withColumn("id", F.col("_top") + F.col("_n"))
    return people.unionByName(fresh.drop("_n", "_top"), allowMissingColumns=True)


def relatives_in_order(named: DataFrame) -> DataFrame:
    """Named edges with their place among the person's, by type and name. [SRT08]"""
    order = Window.partitionBy("person_id").orderBy("relative_is", "relative_name", "id")
    return named.withColumn("place", F.row_number().over(order))


def of_sort(edges: DataFrame, sort: str) -> DataFrame:
    """Edges for a graph: ``family`` (inferred or parent), ``explicit`` or one type; anything else raises. [FLT23]"""
    inferred = F.coalesce("inferred", F.lit(False))
    if sort == "family":
        return edges.where(inferred | (F.col("relative_is") == "parent"))
    if sort == "explicit":
        return edges.where(~inferred)
    if sort not in VALID_TYPES:
        raise ValueError(f"unknown relation type {sort!r}")
    return edges.where(F.col("relative_is") == sort)


def types_in_use(edges: DataFrame) -> DataFrame:
    """[AGG19]"""
    return edges.select("relative_is").where("relative_is is not null").distinct().orderBy("relative_is")


def common_ancestors(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(ancestor_id, gen_a, gen_b), nearest first. [JOI24, SET03]"""
    up = ancestors(edges)
    side = lambda person, name: up.where(F.col("person_id") == person).select("ancestor_id", F.col("gen").alias(name))
    return side(a, "gen_a").join(side(b, "gen_b"), "ancestor_id").orderBy(F.col("gen_a") + F.col("gen_b"), "gen_a", "ancestor_id")


def links_inferred_first(explicit: DataFrame, inferred: DataFrame) -> DataFrame:
    """(person_id, relative_name, relation): inferred relations, and explicit ones for names that have none. [JOI20]"""
    known = inferred.select("person_id", "relative_name").distinct()
    rest = explicit.join(known, ["person_id", "relative_name"], "left_anti")
    pick = lambda df: df.select("person_id", "relative_name", "relation")
    return pick(inferred).unionAll(pick(rest)).distinct()


def with_prose(items: DataFrame, prose: DataFrame, name: str = "name", fallback: str = "expression") -> DataFrame:
    """Items with the prose of their name, else of their second name. ``prose`` has (title, text), titles once. [JOI22]"""
    by = lambda c: prose.select(F.col("title").alias(c), F.col("text").alias(f"_{c}"))
    out = items.join(by(name), name, "left").join(by(fallback), fallback, "left")
    return out.withColumn("prose", F.coalesce(f"_{name}", f"_{fallback}")).select(*items.columns, "prose")


def learn_alias(aliases: DataFrame, alias: str, zone: str) -> DataFrame:
    """Aliases with one set; an alias (case ignored) keeps its last zone. [DML24]"""
    one = aliases.sparkSession.createDataFrame([(alias, zone)], "alias string, zone string")
    return aliases.select("alias", "zone").where(F.lower("alias") != alias.lower()).unionAll(one)


def is_iso_day(text: Column) -> Column:
    """Whether a text is a real day as YYYY-MM-DD. [FLT27]"""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def embed_link(path: Column) -> Column:
    """A path as an embedded link; links stay as they are. [SCA46]"""
    return F.when(path.startswith("![["), path).when(path.startswith("[["), F.concat(F.lit("!"), path)).otherwise(F.concat(F.lit("![["), path, F.lit("]]")))
