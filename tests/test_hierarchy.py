import random

from quillmesh.operators.hierarchy import descendants, family_lines, parent_edges


def brute(edges):
    edges = set(edges)
    parents, children = {}, {}
    for p, c in edges:
        parents.setdefault(c, set()).add(p)
        children.setdefault(p, set()).add(c)
    nodes = set(parents) | set(children)
    rings = set()
    for n in nodes:  # a simple ring through n, each node is on one at most
        stack = [(n, (n,))]
        while stack:
            at, way = stack.pop()
            for c in children.get(at, ()):
                if c == n:
                    k = way.index(min(way))
                    rings.add(way[k:] + way[:k])
                elif c not in way:
                    stack.append((c, (*way, c)))
    on_ring = {x for r in rings for x in r}
    out = {("cycle", x, r[0], len(r), ">".join(map(str, r))) for r in rings for x in r}
    stack = [(n, (n,)) for n in nodes if n not in parents]
    while stack:
        at, way = stack.pop()
        out.add(("path", at, way[0], len(way) - 1, ">".join(map(str, way))))
        stack += [(c, (*way, c)) for c in children.get(at, ()) if c not in on_ring]
    return out


def run(spark, edges):
    df = spark.createDataFrame(edges, "parent long, child long")
    rows = family_lines(df).collect()
    found = {(r.kind, r.person_id, r.root_id, r.depth, r.path) for r in rows}
    assert len(found) == len(rows)
    return found


def test_random_forests_with_rings(spark):
    rng = random.Random(3)
    edges = [(p, c) for c in range(2, 120) for p in {rng.randrange(max(1, c - 9), c) for _ in range(rng.choice((1, 1, 2)))}]
    edges += [(500 + k, 501 + k) for k in range(40)]  # a long line
    edges += [(601, 602), (602, 603), (603, 601), (603, 604), (604, 605), (10, 602)]  # a ring with ways in and out
    edges += [(700, 700), (700, 701), (800, 801), (801, 800)]
    edges += [(900 + k, 900 + (k + 1) % 11) for k in range(11)]  # a long ring
    assert run(spark, edges) == brute(edges)


def test_repeated_facts_and_nothing(spark):
    assert run(spark, [(1, 2), (1, 2), (1, 3), (2, 4), (3, 4)]) == brute([(1, 2), (1, 3), (2, 4), (3, 4)])
    assert run(spark, []) == set()
    assert family_lines(spark.createDataFrame([(None, 1), (2, None)], "parent long, child long")).count() == 0


def test_facts_from_tables(spark):
    people = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")], "id long, name string, parent string")
    terms = spark.createDataFrame([("father", "parent"), ("son", "child"), ("friend", "other")], "term string, means string")
    rows = [(1, 1, 2, " Father "), (2, 2, 1, "SON"), (3, 1, 3, "friend"), (4, 1, 99, "father"), (5, 3, 1, None), (6, None, 1, "son"), (7, 3, 2, "\tfather\n")]
    rel = spark.createDataFrame(rows, "id long, person_id long, relative_id long, relative_is string")
    assert {tuple(r) for r in parent_edges(rel, people, terms).collect()} == {(2, 1), (2, 3)}


def test_descendants(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "parent long, child long")
    found = {tuple(r) for r in descendants(edges).collect()}
    assert found == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 3, 1), (2, 4, 2), (3, 4, 1)}
