"""Typed relationship edges: reciprocals, integrity, repair, neighbourhoods, merging and export.

An edge (person_id, relative_id, relative_is) reads "relative is person's <relative_is>". [JOI01-06, GRA09-15, DML03-08]
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numbered

# Relation types that may be stored.
VALID_TYPES = (
    "spouse", "parent", "friend", "ex-friend", "acquaintance", "coworker", "manager", "report", "neighbor", "boyfriend", "girlfriend",
    "ex-boyfriend", "ex-girlfriend", "ex-spouse", "accountant", "financial advisor", "client", "pet", "owner", "godfather", "godmother",
    "godson", "goddaughter", "courtesy-cousin", "courtesy-aunt", "courtesy-uncle", "courtesy-niece", "courtesy-nephew", "artist", "celebrity",
)
# Types that may stand in both directions.
SYMMETRIC_TYPES = (
    "spouse", "ex-spouse", "friend", "ex-friend", "acquaintance", "coworker", "neighbor", "courtesy-cousin", "artist", "celebrity",
    "boyfriend", "girlfriend", "ex-boyfriend", "ex-girlfriend",
)
# Reciprocal of a type whatever the genders.
RECIPROCAL = {
    "spouse": "spouse", "ex-spouse": "ex-spouse", "friend": "friend", "ex-friend": "ex-friend", "acquaintance": "acquaintance",
    "coworker": "coworker", "neighbor": "neighbor", "manager": "report", "report": "manager", "accountant": "client", "client": "accountant",
    "financial advisor": "client", "pet": "owner", "owner": "pet", "courtesy-cousin": "courtesy-cousin", "artist": "artist", "celebrity": "celebrity",
}
# Reciprocal of a type by the person's gender: (for M, for all others).
RECIPROCAL_BY_GENDER = {
    "boyfriend": ("boyfriend", "girlfriend"), "girlfriend": ("boyfriend", "girlfriend"),
    "ex-boyfriend": ("ex-boyfriend", "ex-girlfriend"), "ex-girlfriend": ("ex-boyfriend", "ex-girlfriend"),
    "godfather": ("godson", "goddaughter"), "godmother": ("godson", "goddaughter"),
    "godson": ("godfather", "godmother"), "goddaughter": ("godfather", "godmother"),
    "courtesy-aunt": ("courtesy-nephew", "courtesy-niece"), "courtesy-uncle": ("courtesy-nephew", "courtesy-niece"),
    "courtesy-niece": ("courtesy-uncle", "courtesy-aunt"), "courtesy-nephew": ("courtesy-uncle", "courtesy-aunt"),
}
# Filter words that mean a stored type and a gender.
TYPE_ALIASES = {"husband": ("spouse", "M"), "wife": ("spouse", "F"), "ex-husband": ("ex-spouse", "M"), "ex-wife": ("ex-spouse", "F")}

KEY = ["person_id", "relative_id", "relative_is"]


def reciprocal_type(relation: Column, person_gender: Column) -> Column:
    """Type of the edge back, or null where none is kept (as for ``parent``). [GRA15]"""
    out = F.lit(None).cast("string")
    for name, back in RECIPROCAL.items():
        out = F.when(relation == name, F.lit(back)).otherwise(out)
    for name, (male, other) in RECIPROCAL_BY_GENDER.items():
        out = F.when(relation == name, F.when(person_gender == "M", F.lit(male)).otherwise(F.lit(other))).otherwise(out)
    return out


def with_names(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Edges with both names; edges to missing people fall out. [JOI01, JOI03]"""
    a = people.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    b = people.select(F.col("id").alias("relative_id"), F.col("name").alias("relative_name"), F.col("gender").alias("relative_gender"))
    return edges.join(a, "person_id").join(b, "relative_id")


def of_type(edges: DataFrame, wanted: str) -> DataFrame:
    """Edges of one type; ``husband`` and the like mean a type and the relative's gender. [FLT21]"""
    if wanted in TYPE_ALIASES:
        relation, gender = TYPE_ALIASES[wanted]
        return edges.where((F.col("relative_is") == relation) & (F.col("relative_gender") == gender))
    return edges.where(F.col("relative_is") == wanted)


def without_way_back(edges: DataFrame) -> DataFrame:
    """Edges between two different people without any edge back, of whatever type; inferred ones, too. [DML08]"""
    back = edges.select(F.col("relative_id").alias("person_id"), F.col("person_id").alias("relative_id")).distinct()
    return edges.join(back, ["person_id", "relative_id"], "left_anti")


def _told(edges: DataFrame) -> DataFrame:
    return edges.where(~F.coalesce("inferred", F.lit(False)))


def _between_known(edges: DataFrame, people: DataFrame) -> DataFrame:
    ids = people.select(F.col("id").alias("person_id")).distinct()
    return edges.join(ids, "person_id", "left_semi").join(ids.withColumnRenamed("person_id", "relative_id"), "relative_id", "left_semi")


def missing_reciprocals(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Edges of existing people that somebody told (not inferred) and that have no edge back. [JOI05]"""
    return _between_known(_told(without_way_back(edges)), people)


def conflicting_directions(edges: DataFrame, people: DataFrame) -> DataFrame:
    """(id, person_id, relative_id, relative_is): told edges from a smaller to a larger id whose type stands in the other
    direction, too, though it isn't symmetric; one row for each edge back. [JOI04]"""
    one_way = edges.where(~F.col("relative_is").isin(*SYMMETRIC_TYPES))
    up = _between_known(_told(one_way.where("person_id < relative_id")), people)
    down = one_way.where("person_id > relative_id").select(F.col("relative_id").alias("person_id"), F.col("person_id").alias("relative_id"), "relative_is")
    return up.join(down, KEY).select("id", *KEY)


def orphan_edges(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Edges whose person or relative doesn't exist, with the missing side; one row per missing side. [JOI06, SET01]"""
    ids = people.select("id")
    person = edges.join(ids, edges["person_id"] == ids["id"], "left_anti").select("id", F.col("person_id").alias("missing_id"), F.lit("person").alias("side"))
    relative = edges.join(ids, edges["relative_id"] == ids["id"], "left_anti").select("id", F.col("relative_id").alias("missing_id"), F.lit("relative").alias("side"))
    return person.unionAll(relative)


def integrity_issues(edges: DataFrame, people: DataFrame) -> DataFrame:
    """(severity, issue, item_id): every finding of the six checks. Edges are named by id, people by id. [DML07]

    Inferred edges carry computed names, so they are exempt from the checks of types, of directions and of edges back.
    """
    tag = lambda df, issue, severity="error": df.select(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), F.col("id").alias("item_id"))
    loops = _between_known(edges.where("person_id = relative_id"), people)
    return (
        tag(missing_reciprocals(edges, people), "missing_reciprocal")
        .unionAll(tag(conflicting_directions(edges, people), "conflicting_direction"))
        .unionAll(tag(_told(edges.where(~F.col("relative_is").isin(*VALID_TYPES))), "unknown_type"))
        .unionAll(tag(orphan_edges(edges, people), "orphan"))
        .unionAll(tag(loops, "self_relationship"))
        .unionAll(tag(people.where(F.col("gender").isNull() | ~F.col("gender").isin("M", "F", "NB")), "missing_gender", "warning"))
    )


def integrity_summary(issues: DataFrame) -> DataFrame:
    """(severity, issue, n)"""
    return issues.groupBy("severity", "issue").agg(F.count("*").alias("n"))


def integrity_verdict(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, and ok where there is no error. [AGG14]"""
    out = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return out.withColumn("ok", F.col("errors") == 0)


def repaired(edges: DataFrame, people: DataFrame) -> DataFrame:
    """(person_id, relative_id, relative_is): edges without loops, with all reciprocals that were missing. [DML08]"""
    kept = edges.where("person_id <> relative_id").select(*KEY).distinct()
    genders = people.select(F.col("id").alias("person_id"), "gender")
    lost = without_way_back(edges).join(genders, "person_id", "left")
    back = lost.select(F.col("relative_id").alias("person_id"), F.col("person_id").alias("relative_id"), reciprocal_type(F.col("relative_is"), F.col("gender")).alias("relative_is"))
    return kept.unionAll(back.where("relative_is is not null")).distinct()


def insert_edge(edges: DataFrame, people: DataFrame, person_id: int, relative_id: int, relation: str) -> DataFrame:
    """Edges with a new one and its reciprocal; unknown types and repeated edges raise. [DML04]"""
    if relation not in VALID_TYPES:
        raise ValueError(f"unknown relation type {relation!r}")
    same = (F.col("person_id") == person_id) & (F.col("relative_id") == relative_id) & (F.col("relative_is") == relation)
    if not edges.where(same).isEmpty():
        raise ValueError("the edge already exists")
    one = edges.sparkSession.createDataFrame([(person_id, relative_id, relation)], "person_id long, relative_id long, relative_is string")
    back = one.join(people.select(F.col("id").alias("person_id"), "gender"), "person_id", "left")
    back = back.select(F.col("relative_id").alias("person_id"), F.col("person_id").alias("relative_id"), reciprocal_type(F.col("relative_is"), F.col("gender")).alias("relative_is"))
    return edges.select(*KEY).unionAll(one).unionAll(back.where("relative_is is not null")).distinct()


def _between(a: int, b: int) -> Column:
    p, r = F.col("person_id"), F.col("relative_id")
    return ((p == a) & (r == b)) | ((p == b) & (r == a))


def change_edge(edges: DataFrame, people: DataFrame, person_id: int, relative_id: int, relation: str) -> DataFrame:
    """All edges between the two, of any type and direction, replaced by one of the new type. [DML05]"""
    return insert_edge(edges.where(~_between(person_id, relative_id)), people, person_id, relative_id, relation)


def delete_edge(edges: DataFrame, people: DataFrame, person_id: int, relative_id: int, relation: str | None = None) -> DataFrame:
    """Edges without one and its reciprocal; without a type only where there is exactly one. [DML06]"""
    here = edges.where((F.col("person_id") == person_id) & (F.col("relative_id") == relative_id)).select("relative_is").distinct()
    types = [r[0] for r in here.orderBy("relative_is").limit(len(VALID_TYPES) + 1).collect()]
    if relation is None:
        if len(types) != 1:
            raise ValueError(f"Multiple or no relations between the two: {types}")
        relation = types[0]
    gender = people.where(F.col("id") == person_id).select("gender").first()
    gone = edges.sparkSession.createDataFrame([(person_id, relative_id, relation, gender[0] if gender else None)], "person_id long, relative_id long, relative_is string, gender string")
    back = gone.select(F.col("relative_id").alias("person_id"), F.col("person_id").alias("relative_id"), reciprocal_type(F.col("relative_is"), F.col("gender")).alias("relative_is"))
    return edges.join(gone.select(*KEY).unionAll(back), KEY, "left_anti")


def delete_person(people: DataFrame, edges: DataFrame, person_id: int) -> tuple[DataFrame, DataFrame]:
    """(people, edges) without the person. [DML03]"""
    touches = (F.col("person_id") == person_id) | (F.col("relative_id") == person_id)
    return people.where(F.col("id") != person_id), edges.where(~touches)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n): edges that a person is on, on either side; a loop counts once. [AGG03]"""
    ends = edges.select(F.explode(F.array_distinct(F.array("person_id", "relative_id"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("n"))


def between(edges: DataFrame, a: int, b: int) -> DataFrame:
    """Types of all edges from a's side to b. [GRA14]"""
    return edges.where((F.col("person_id") == a) & (F.col("relative_id") == b)).select("relative_is").distinct()


def neighbourhood(edges: DataFrame, root: int, hops: int = 2) -> DataFrame:
    """Edges between people at most ``hops`` undirected steps from ``root``. [GRA11]"""
    ways = edges.select("person_id", "relative_id").unionAll(edges.select("relative_id", "person_id")).distinct().toDF("a", "b")
    seen = edges.sparkSession.createDataFrame([(root,)], "a long")
    for _ in range(hops):
        seen = seen.unionAll(seen.join(ways, "a").select(F.col("b").alias("a"))).distinct()
    near = edges.join(seen.withColumnRenamed("a", "person_id"), "person_id", "left_semi")
    return near.join(seen.withColumnRenamed("a", "relative_id"), "relative_id", "left_semi").select(*KEY)


def undirected_once(edges: DataFrame) -> DataFrame:
    """Edges for drawing: symmetric types once per pair (the first by person, relative), others as they are. [SET10]"""
    symmetric = F.col("relative_is").isin(*SYMMETRIC_TYPES)
    low, high = F.least("person_id", "relative_id"), F.greatest("person_id", "relative_id")
    keyed = edges.select(*KEY, F.when(symmetric, low).otherwise(F.col("person_id")).alias("_a"), F.when(symmetric, high).otherwise(F.col("relative_id")).alias("_b"))
    first = keyed.groupBy("_a", "_b", "relative_is").agg(F.min(F.struct("person_id", "relative_id")).alias("e"))
    return first.select("e.person_id", "e.relative_id", "relative_is")


def drawable(edges: DataFrame) -> DataFrame:
    """Edges for drawing without inferred ones to descendants, which the edge of the other side shows already. [GRA12]"""
    down = F.col("relative_is").rlike("son|daughter|child|nephew|niece")
    return edges.where(~(F.coalesce("inferred", F.lit(False)) & F.coalesce(down, F.lit(False))))


def mermaid(edges: DataFrame, people: DataFrame) -> DataFrame:
    """(line_no, line): a Mermaid graph, one row per line in order, for a text sink. [SNK03]"""
    named = with_names(undirected_once(edges), people)
    tidy = lambda c: F.regexp_replace(c, r'["\[\]]', "'")
    arrow = F.when(F.col("relative_is").isin(*SYMMETRIC_TYPES), F.lit("---")).otherwise(F.lit("-->"))
    line = F.concat(
        F.lit("    p"), F.col("person_id").cast("string"), F.lit('["'), tidy(F.col("person_name")), F.lit('"] '), arrow, F.lit("|"), "relative_is", F.lit("| p"),
        F.col("relative_id").cast("string"), F.lit('["'), tidy(F.col("relative_name")), F.lit('"]'),
    )
    head = edges.sparkSession.createDataFrame([(0, "graph LR")], "line_no long, line string")
    lines = numbered(named.withColumn("line", line), "line_no", "person_id", "relative_id", "relative_is")
    return head.unionAll(lines.select("line_no", "line"))


def merge_relatives(explicit: DataFrame, inferred: DataFrame) -> DataFrame:
    """(person_id, relative_id, relation, inferred): explicit types and, for pairs without any, the inferred one. [GRA13, JOI19]"""
    known = explicit.select("person_id", "relative_id").distinct()
    rest = inferred.join(known, ["person_id", "relative_id"], "left_anti")
    told = explicit.select("person_id", "relative_id", F.col("relative_is").alias("relation"), F.lit(False).alias("inferred")).distinct()
    return told.unionAll(rest.select("person_id", "relative_id", "relation", F.lit(True).alias("inferred")))


def wiki_links(relatives: DataFrame, people: DataFrame) -> DataFrame:
    """(person_id, section): the Markdown section with a link for each relative, sorted by type and name; placeholder people
    (names starting with Unknown) are left out. [SNK04, FLT24]"""
    names = people.select(F.col("id").alias("relative_id"), "name").where(~F.col("name").startswith("Unknown"))
    lines = relatives.join(names, "relative_id").select("person_id", F.struct("relation", "name").alias("l")).distinct()
    grouped = lines.groupBy("person_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: F.concat(F.lit("- "), x["relation"], F.lit(": [["), x["name"], F.lit("]]"))), "\n")
    return grouped.select("person_id", F.concat(F.lit("## Relationships\n"), text).alias("section"))
