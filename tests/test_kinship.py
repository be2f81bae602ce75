import pytest

from quillmesh.operators import kinship, relations

PEOPLE = [(1, "Grandpa", "M"), (2, "Grandma", "F"), (3, "Dad", "M"), (4, "Mom", "F"), (5, "Uncle", "M"), (6, "Child1", "M"), (7, "Child2", "F"), (8, "Cousin", "F")]
PARENTS = [(1, 3), (2, 3), (1, 5), (2, 5), (3, 6), (4, 6), (3, 7), (4, 7), (5, 8)]


@pytest.fixture(scope="module")
def family(spark):
    return spark.createDataFrame(PARENTS, "parent long, child long"), spark.createDataFrame(PEOPLE, "id long, name string, gender string")


def test_ancestors(family):
    found = {(r.ancestor_id, r.gen) for r in kinship.ancestors(family[0]).where("person_id = 6").collect()}
    assert found == {(3, 1), (4, 1), (1, 2), (2, 2)}


def test_names_of_a_family(family):
    kin = {(r.person_id, r.relative_id): r.relation for r in kinship.kinship(*family).collect()}
    assert {r: n for (p, r), n in kin.items() if p == 6} == {7: "sister", 3: "father", 4: "mother", 1: "grandfather", 2: "grandmother", 5: "uncle", 8: "1st cousin"}
    assert kin[3, 6] == "son" and kin[5, 6] == "nephew" and kin[1, 6] == "grandson" and (4, 8) not in kin


def test_persons_restrict(family, spark):
    kin = kinship.kinship(*family, persons=spark.createDataFrame([(6,)], "id long")).collect()
    assert {r.person_id for r in kin} == {6} and len(kin) == 7


@pytest.mark.parametrize("a,b,gender,name", [
    (1, 1, "M", "brother"), (1, 1, None, "sibling"), (2, 1, "F", "aunt"), (1, 2, "M", "nephew"), (2, 2, "F", "1st cousin"), (3, 3, "M", "2nd cousin"),
    (4, 4, None, "3rd cousin"), (2, 3, "M", "1st cousin once removed"), (2, 4, "M", "1st cousin twice removed"), (3, 4, "F", "2nd cousin once removed"),
    (3, 1, "M", "great-uncle"), (1, 3, "F", "great-niece"), (4, 1, "M", "great-great-uncle"), (6, 6, "M", "5th cousin"), (2, 6, "M", "1st cousin 4x removed"),
])
def test_collateral_names(spark, a, b, gender, name):
    df = spark.createDataFrame([(a, b, gender)], "a int, b int, g string")
    assert df.select(kinship.collateral_name(df.a, df.b, df.g)).first()[0] == name


def test_cycle_and_tie(spark):
    loop = spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long")
    assert {tuple(r) for r in kinship.ancestors(loop).collect()} == {(1, 2, 1), (2, 1, 1)}
    # common ancestors at (1, 3) and (2, 2): the person's fewer generations win
    edges = [(10, 1), (10, 21), (21, 22), (22, 2), (30, 31), (31, 1), (30, 32), (32, 2)]
    people = spark.createDataFrame([(2, "M")], "id long, gender string")
    kin = kinship.kinship(spark.createDataFrame(edges, "parent long, child long"), people)
    assert kin.where("person_id = 1 and relative_id = 2").first()["relation"] == "great-nephew"


def test_inferred_filters(spark):
    df = spark.createDataFrame([("2nd cousin twice removed", "M"), ("great-grandmother", "F"), ("uncle", "M")], "r string, g string")
    hits = lambda w: [r.r for r in df.where(kinship.inferred_filter(w, df.r, df.g)).collect()]
    assert hits("cousin") == ["2nd cousin twice removed"] and hits("grandparent") == ["great-grandmother"] and hits("sibling") == []


EDGE = "id long, person_id long, relative_id long, relative_is string, inferred boolean"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "A", "M"), (2, "B", "F"), (3, "C", None)], "id long, name string, gender string")


def triples(df):
    return {(r.person_id, r.relative_id, r.relative_is) for r in df.collect()}


def test_insert_delete_change(spark, people):
    none = spark.createDataFrame([], EDGE)
    two = relations.insert_edge(none, people, 1, 2, "godmother")
    assert triples(two) == {(1, 2, "godmother"), (2, 1, "godson")}
    assert triples(relations.insert_edge(none, people, 1, 2, "parent")) == {(1, 2, "parent")}
    with pytest.raises(ValueError, match="unknown"):
        relations.insert_edge(none, people, 1, 2, "cousin")
    with pytest.raises(ValueError, match="already exists"):
        relations.insert_edge(two, people, 1, 2, "godmother")
    more = relations.insert_edge(two, people, 1, 2, "friend")
    with pytest.raises(ValueError, match="Multiple"):
        relations.delete_edge(more, people, 1, 2)
    assert triples(relations.delete_edge(more, people, 1, 2, "friend")) == triples(two)
    assert triples(relations.change_edge(more, people, 1, 2, "spouse")) == {(1, 2, "spouse"), (2, 1, "spouse")}


def test_check_and_repair(spark, people):
    rows = [(1, 1, 2, "friend", False), (2, 2, 3, "parent", None), (3, 3, 2, "parent", False), (4, 1, 1, "friend", False), (5, 1, 9, "boss", True)]
    edges = spark.createDataFrame(rows, EDGE)
    found = {(r.issue, r.item_id) for r in relations.integrity_issues(edges, people).collect()}
    assert found == {("missing_reciprocal", 1), ("conflicting_direction", 2), ("orphan", 5), ("self_relationship", 4), ("missing_gender", 3)}
    fixed = triples(relations.repaired(edges, people))
    assert (2, 1, "friend") in fixed and (1, 1, "friend") not in fixed


def test_graph_export(spark, people):
    edges = spark.createDataFrame([(1, 1, 2, "friend", False), (2, 2, 1, "friend", False), (3, 2, 3, "parent", False)], EDGE)
    lines = [r.line for r in relations.mermaid(edges, people).orderBy("line_no").collect()]
    assert lines == ["graph LR", '    p1["A"] ---|friend| p2["B"]', '    p2["B"] -->|parent| p3["C"]']
    links = relations.wiki_links(edges.select("person_id", "relative_id", edges.relative_is.alias("relation")), people)
    assert {r.person_id: r.section for r in links.collect()}[2] == "## Relationships\n- friend: [[A]]\n- parent: [[C]]"
    assert triples(relations.neighbourhood(edges, 3, 1)) == {(2, 3, "parent")}
    people2, edges2 = relations.delete_person(people, edges, 3)
    assert people2.count() == 2 and triples(edges2) == {(1, 2, "friend"), (2, 1, "friend")}
