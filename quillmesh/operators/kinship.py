"""Ancestors, common ancestors and the names of kin. [GRA01-10, AGG16-17]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Fixed values: (for M, for F, otherwise)
SIBLING = ("brother", "sister", "sibling")
UNCLE = ("uncle", "aunt", "uncle/aunt")
NEPHEW = ("nephew", "niece", "nephew/niece")
PARENT = ("father", "mother", "parent")
GRANDPARENT = ("grandfather", "grandmother", "grandparent")
CHILD = ("son", "daughter", "child")
GRANDCHILD = ("grandson", "granddaughter", "grandchild")

# Words that a filter matches in an inferred name, and the gender it asks for.
INFERRED_FILTERS = {
    "child": (("son", "daughter", "child"), None), "children": (("son", "daughter", "child"), None),
    "son": (("son", "grandson", "child"), "M"), "daughter": (("daughter", "granddaughter", "child"), "F"),
    "sibling": (("brother", "sister", "sibling"), None), "brother": (("brother", "sibling"), "M"), "sister": (("sister", "sibling"), "F"),
    "cousin": (("cousin",), None), "uncle": (("uncle",), None), "aunt": (("aunt",), None), "nephew": (("nephew",), None), "niece": (("niece",), None),
    "grandparent": (("grandfather", "grandmother", "grandparent"), None), "grandfather": (("grandfather", "grandparent"), None),
    "grandmother": (("grandmother", "grandparent"), None), "grandchild": (("grandson", "granddaughter", "grandchild"), None),
    "grandson": (("grandson", "grandchild"), None), "granddaughter": (("granddaughter", "grandchild"), None),
    "father": (("father",), None), "mother": (("mother",), None),
    "parent": (("father", "mother", "parent"), None), "parents": (("father", "mother", "parent"), None),
}


def ancestors(edges: DataFrame) -> DataFrame:
    """(person_id, ancestor_id, gen): fewest generations up to every other ancestor. [GRA02, AGG16]

    ``edges`` has (parent, child). Doubling: after k rounds all ancestors within 2**k generations are known, so the rounds
    follow the logarithm of the depth; cycles end as no shorter way appears.
    """
    known = cut_lineage(edges.where("parent <> child").select(F.col("child").alias("person_id"), F.col("parent").alias("ancestor_id"), F.lit(1).alias("gen")).distinct())
    size = None
    while True:
        upper = known.select(F.col("person_id").alias("ancestor_id"), F.col("ancestor_id").alias("_top"), F.col("gen").alias("_more"))
        longer = known.join(upper, "ancestor_id").where("person_id <> _top").select("person_id", F.col("_top").alias("ancestor_id"), (F.col("gen") + F.col("_more")).alias("gen"))
        known = cut_lineage(known.unionAll(longer).groupBy("person_id", "ancestor_id").agg(F.min("gen").alias("gen")))
        now = known.agg(F.count("*"), F.sum("gen")).first()
        if now == size:
            return known
        size = now


def _gendered(words: tuple[str, str, str], gender: Column) -> Column:
    return F.when(gender == "M", F.lit(words[0])).when(gender == "F", F.lit(words[1])).otherwise(F.lit(words[2]))


def _greats(n: Column, words: tuple[str, str, str], gender: Column) -> Column:
    return F.concat(F.repeat(F.lit("great-"), n), _gendered(words, gender))


def collateral_name(gen_a: Column, gen_b: Column, gender: Column) -> Column:
    """Name of the relative (gender given) whose closest common ancestor is gen_a above the person and gen_b above it. [GRA06]"""
    degree, removed = F.least(gen_a, gen_b) - 1, F.abs(gen_a - gen_b)
    ordinal = F.when(degree == 1, F.lit("1st")).when(degree == 2, F.lit("2nd")).when(degree == 3, F.lit("3rd")).otherwise(F.concat(degree.cast("string"), F.lit("th")))
    times = F.when(removed == 1, F.lit("once")).when(removed == 2, F.lit("twice")).otherwise(F.concat(removed.cast("string"), F.lit("x")))
    cousin = F.concat(ordinal, F.lit(" cousin"), F.when(removed == 0, F.lit("")).otherwise(F.concat(F.lit(" "), times, F.lit(" removed"))))
    return (
        F.when((gen_a == 1) & (gen_b == 1), _gendered(SIBLING, gender))
        .when(gen_a == 1, _greats(gen_b - 2, NEPHEW, gender))
        .when(gen_b == 1, _greats(gen_a - 2, UNCLE, gender))
        .otherwise(cousin)
    )


def direct_name(gen: Column, upward: Column, gender: Column) -> Column:
    """Name of an ancestor (``upward``) or a descendant ``gen`` generations away. [GRA07]"""
    up = F.when(gen == 1, _gendered(PARENT, gender)).otherwise(_greats(gen - 2, GRANDPARENT, gender))
    down = F.when(gen == 1, _gendered(CHILD, gender)).otherwise(_greats(gen - 2, GRANDCHILD, gender))
    return F.when(upward, up).otherwise(down)


def kinship(edges: DataFrame, people: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """(person_id, relative_id, relation): what each relative is to each person of ``persons`` (id; all by default).

    Direct lines come first, an ancestor before a descendant; else the closest common ancestor, ties by (generations of the
    person, ancestor id). [GRA03-05, GRA08, AGG17]
    """
    up = ancestors(edges)
    mine = up if persons is None else up.join(persons.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    above = mine.select("person_id", F.col("ancestor_id").alias("relative_id"), F.lit(0).alias("tier"), "gen", F.lit(0).alias("gen_b"), F.lit(0).cast("long").alias("via"))
    wanted = up if persons is None else up.join(persons.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_semi")
    below = wanted.select(F.col("ancestor_id").alias("person_id"), F.col("person_id").alias("relative_id"), F.lit(1).alias("tier"), "gen", F.lit(0).alias("gen_b"), F.lit(0).cast("long").alias("via"))
    other = up.select(F.col("person_id").alias("relative_id"), "ancestor_id", F.col("gen").alias("gen_b"))
    side = mine.join(other, "ancestor_id").where("person_id <> relative_id")
    side = side.select("person_id", "relative_id", F.lit(2).alias("tier"), "gen", "gen_b", F.col("ancestor_id").alias("via"))
    rank = F.struct("tier", (F.col("gen") + F.col("gen_b")).alias("total"), "gen", "via", "gen_b")
    best = above.unionAll(below).unionAll(side).groupBy("person_id", "relative_id").agg(F.min(rank).alias("r"))
    named = best.join(people.select(F.col("id").alias("relative_id"), "gender"), "relative_id", "left")
    relation = F.when(F.col("r.tier") == 2, collateral_name(F.col("r.gen"), F.col("r.gen_b"), F.col("gender"))).otherwise(direct_name(F.col("r.gen"), F.col("r.tier") == 0, F.col("gender")))
    return named.select("person_id", "relative_id", relation.alias("relation"))


def inferred_filter(wanted: str, relation: Column, gender: Column) -> Column:
    """Whether an inferred name matches a filter word. [FLT22]"""
    words, needed = INFERRED_FILTERS.get(wanted, ((wanted,), None))
    hit = F.lit(False)
    for w in words:
        hit = hit | relation.contains(w)
    return hit if needed is None else hit & (gender == needed)


def inferred_cache(edges: DataFrame, kin: DataFrame) -> DataFrame:
    """Inferred pairs that have no explicit edge of any type, as rows for the edge table. [GRA09-10]"""
    explicit = edges.where(~F.coalesce("inferred", F.lit(False))).select("person_id", "relative_id").distinct()
    rest = kin.join(explicit, ["person_id", "relative_id"], "left_anti")
    return rest.select("person_id", "relative_id", F.col("relation").alias("relative_is"), F.lit(True).alias("inferred"))
