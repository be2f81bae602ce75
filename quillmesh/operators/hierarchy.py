"""Full paths of parent-child links of unknown depth, by splitters and a reduced pointer graph.

1. Deterministic hash splitters: a node is a stop if it has no parent or its id hashes into one of ``SPLIT`` classes.
2. Every node walks up its parents to the next stop. That gives short exact segments (stop, ..., node) and also finds the
   cycles that hold no stop besides the walker.
3. The segments between stops form the reduced graph. It is solved by doubling: after k rounds every way is either complete
   (starts at a root) or 2**k segments long. Two simple halves that share a node close a cycle, which is recorded.
4. Ways through cycle members are removed, and every node's segments are put behind the complete ways of their stops.

All rounds are joins on ids; nothing is collected. The number of rounds follows the gap between splitters and the logarithm
of the depth. The number of rows never exceeds the number of partial ways of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SPLIT = 3
STEPS_PER_ROUND = 4


def parent_edges(relationships: DataFrame, people: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct (parent, child) facts between existing people; null ids and unknown terms give none."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    terms = terms.select(clean(F.col("term")).alias("_term"), "means").where(F.col("means").isin("parent", "child")).distinct()
    facts = (
        relationships.select("person_id", "relative_id", clean(F.col("relative_is")).alias("_term"))
        .join(terms, "_term")
        .select(
            F.when(F.col("means") == "parent", F.col("relative_id")).otherwise(F.col("person_id")).alias("parent"),
            F.when(F.col("means") == "parent", F.col("person_id")).otherwise(F.col("relative_id")).alias("child"),
        )
        .distinct()
    )
    ids = people.select(F.col("id")).distinct()
    facts = facts.join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")
    return facts.join(ids.withColumnRenamed("id", "child"), "child", "left_semi").select("parent", "child")


def _has_splitter_hash(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(SPLIT)) == 0


def _from_smallest(path: Column) -> Column:
    """The ring of ids in ``path`` (each once, parent before child) turned so that it starts with its smallest id."""
    at = F.array_position(path, F.array_min(path)).cast("int")
    return F.concat(F.slice(path, at, F.size(path)), F.slice(path, F.lit(1), at - 1))


def _walk_to_stops(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (top, bottom, path from top to bottom) and rings found on the way."""
    children = edges.select(F.col("child").alias("_has_parent")).distinct()
    # up: child -> parent, with whether that parent is a stop
    up = edges.join(children, edges["parent"] == children["_has_parent"], "left").select(
        F.col("child").alias("_from"),
        F.col("parent").alias("_to"),
        (F.col("_has_parent").isNull() | _has_splitter_hash(F.col("parent"))).alias("_stop"),
    )
    up = cut_lineage(up)
    walks = up.select(
        F.col("_to").alias("at"),
        F.col("_from").alias("bottom"),
        F.array("_to", "_from").alias("path"),
        F.when(F.col("_to") == F.col("_from"), F.lit("ring")).when(F.col("_stop"), F.lit("done")).otherwise(F.lit("on")).alias("state"),
    ).withColumn("path", F.when(F.col("state") == "ring", F.array("bottom")).otherwise(F.col("path")))
    ended = []
    while True:
        for _ in range(STEPS_PER_ROUND):
            joined = walks.join(up, (F.col("at") == F.col("_from")) & (F.col("state") == "on"), "left")
            moved = F.col("_to").isNotNull()
            walks = joined.select(
                F.when(moved, F.col("_to")).otherwise(F.col("at")).alias("at"),
                "bottom",
                F.when(moved & (F.col("_to") != F.col("bottom")), F.concat(F.array("_to"), "path")).otherwise(F.col("path")).alias("path"),
                F.when(~moved, F.col("state"))
                .when(F.col("_to") == F.col("bottom"), F.lit("ring"))
                .when(F.array_contains("path", F.col("_to")), F.lit("lost"))  # it met a ring that it is not part of
                .when(F.col("_stop"), F.lit("done"))
                .otherwise(F.lit("on"))
                .alias("state"),
            ).where("state <> 'lost'")
        walks = cut_lineage(walks)
        ended.append(walks.where("state <> 'on'"))
        walks = walks.where("state = 'on'")
        if walks.isEmpty():
            break
    ended = reduce(DataFrame.unionAll, ended)
    segments = ended.where("state = 'done'").select(F.col("at").alias("top"), "bottom", "path")
    rings = ended.where("state = 'ring'").select(_from_smallest(F.col("path")).alias("ring"))
    return segments, rings


def _solve_reduced(segments: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete ways (stop, path from a root to it) to every splitter, and rings through two or more splitters."""
    roots = edges.select(F.col("parent").alias("top")).distinct().join(edges.select(F.col("child").alias("top")).distinct(), "top", "left_anti")
    roots = roots.withColumn("_root", F.lit(True))
    ways = segments.where(_has_splitter_hash(F.col("bottom"))).join(roots, "top", "left")
    ways = cut_lineage(ways.select("top", "bottom", "path", F.col("_root").isNotNull().alias("complete")))
    done, rings = [ways.where("complete")], []
    ways = ways.where("not complete")
    closed = F.col("upper_path")  # both halves are simple; the lowest shared node of the upper half closes the ring
    while not ways.isEmpty():
        # a longer way = an open lower half below any upper half that ends at its top
        known = reduce(DataFrame.unionAll, [*done, ways])
        upper = known.select(
            F.col("bottom").alias("_at"), F.col("top").alias("upper_top"), F.col("path").alias("upper_path"), F.col("complete").alias("upper_complete")
        )
        joined = ways.join(upper, ways["top"] == upper["_at"]).withColumn("_below", F.slice("path", 2, 1_000_000_000))
        joined = joined.select(
            F.col("upper_top").alias("top"),
            "bottom",
            "path",
            "upper_path",
            "_below",
            F.col("upper_complete").alias("complete"),
            F.array_intersect("upper_path", "_below").alias("_shared"),
        )
        joined = cut_lineage(joined)
        low = F.array_max(F.transform("_shared", lambda x: F.array_position("upper_path", x)))
        ring = joined.where(F.size("_shared") > 0).select("upper_path", "_below", low.cast("int").alias("_low"))
        ring = ring.select(
            F.slice(closed, F.col("_low"), 1_000_000_000).alias("_high_part"),
            F.expr("slice(_below, 1, cast(array_position(_below, upper_path[_low - 1]) as int) - 1)").alias("_low_part"),
        )
        rings.append(ring.select(_from_smallest(F.concat("_high_part", "_low_part")).alias("ring")))
        longer = joined.where(F.size("_shared") == 0).select("top", "bottom", F.concat("upper_path", "_below").alias("path"), "complete")
        done.append(longer.where("complete"))
        ways = longer.where("not complete")
    return reduce(DataFrame.unionAll, done).select(F.col("bottom").alias("stop"), "path"), reduce(DataFrame.unionAll, rings) if rings else segments.select(F.col("path").alias("ring")).limit(0)


def lines_of_descent(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ways down and all rings of ``edges`` (parent, child).

    Returns (ways, rings): ways = (person_id, path) with one row per different way from a root to a person, roots
    included; rings = (ring), one row per cycle, turned to its smallest id. Empty input gives empty results. A node below
    or on a ring has only the ways that avoid ring members.
    """
    edges = cut_lineage(edges.select("parent", "child").dropna().distinct())
    segments, rings = _walk_to_stops(edges)
    ways, more = _solve_reduced(segments, edges)
    rings = cut_lineage(rings.unionAll(more).distinct())
    if not rings.isEmpty():
        # a way that avoids all members is one of segments that do, so the solution is filtered, not made again
        members = rings.select(F.explode("ring").alias("member")).distinct()
        apart = lambda df: df.join(df.select("path", F.explode("path").alias("member")).join(members, "member", "left_semi").select("path").distinct(), "path", "left_anti").select(*df.columns)
        segments, ways = cut_lineage(apart(segments)), cut_lineage(apart(ways))
    children = edges.select(F.col("child").alias("stop")).distinct()
    roots = edges.select(F.col("parent").alias("stop")).distinct().join(children, "stop", "left_anti").select("stop", F.array("stop").alias("path"))
    tops = roots.unionAll(ways)
    below = segments.select(F.col("top").alias("stop"), "bottom", F.slice("path", 2, 1_000_000_000).alias("_below"))
    lower = below.join(tops, "stop").select(F.col("bottom").alias("person_id"), F.concat("path", "_below").alias("path"))
    return roots.select(F.col("stop").alias("person_id"), "path").unionAll(lower), rings


def _joined(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


def family_lines(edges: DataFrame) -> DataFrame:
    """(kind, person_id, root_id, depth, path) of all ways ('path') and all members of rings ('cycle')."""
    ways, rings = lines_of_descent(edges)
    paths = ways.select(
        F.lit("path").alias("kind"), "person_id", F.col("path")[0].alias("root_id"), (F.size("path") - 1).cast("long").alias("depth"), _joined(F.col("path")).alias("path")
    )
    cycles = rings.select(F.explode("ring").alias("person_id"), "ring").select(
        F.lit("cycle").alias("kind"), "person_id", F.col("ring")[0].alias("root_id"), F.size("ring").cast("long").alias("depth"), _joined(F.col("ring")).alias("path")
    )
    return paths.unionAll(cycles)


def descendants(edges: DataFrame) -> DataFrame:
    """(person_id, descendant_id, nearest): everyone below a person along counted ways, with the fewest steps down."""
    ways, _ = lines_of_descent(edges)
    pairs = ways.select("path", F.posexplode("path").alias("_pos", "person_id"))
    pairs = pairs.select("person_id", F.element_at("path", -1).alias("descendant_id"), (F.size("path") - 1 - F.col("_pos")).alias("steps"))
    return pairs.where("steps > 0").groupBy("person_id", "descendant_id").agg(F.min("steps").cast("long").alias("nearest"))
