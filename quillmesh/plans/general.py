"""Queries of the general data-processing problems."""

from __future__ import annotations

from ..operators.hierarchy import descendants, family_lines, parent_edges
from ..operators.timestamps import ZoneRules, normalized_sources
from ..session import table


def _edges(spark, sf_dir):
    return parent_edges(*(table(spark, sf_dir, n) for n in ("relationships", "people", "relation_terms")))


def p1_found(spark, sf_dir):
    return family_lines(_edges(spark, sf_dir))


def p1_descendants(spark, sf_dir):
    return descendants(_edges(spark, sf_dir))


def p3_found(spark, sf_dir):
    rules = ZoneRules.load(spark, table(spark, sf_dir, "home_zones"), table(spark, sf_dir, "zone_names"))
    return normalized_sources(spark, lambda name: table(spark, sf_dir, name), rules)


QUERIES = {"p1_found": p1_found, "p1_descendants": p1_descendants, "p3_found": p3_found}

_EDGES = """edges AS (SELECT DISTINCT CASE WHEN t.means = 'parent' THEN r.relative_id ELSE r.person_id END AS parent, CASE WHEN t.means = 'parent' THEN r.person_id ELSE r.relative_id END AS child
  FROM relationships r JOIN relation_terms t ON lower(trim(t.term)) = lower(trim(r.relative_is)) AND t.means IN ('parent', 'child') JOIN people p ON p.id = r.person_id JOIN people q ON q.id = r.relative_id),
walks AS (SELECT parent AS start, child AS here, [parent] AS path FROM edges
  UNION ALL SELECT start, e.child, list_append(path, here) FROM walks JOIN edges e ON e.parent = here WHERE here <> start AND NOT list_contains(path, here)),
rings AS (SELECT DISTINCT path FROM walks WHERE here = start AND start = list_min(path)),
members AS (SELECT DISTINCT unnest(path) AS id FROM rings),
roots AS (SELECT DISTINCT parent AS id FROM edges WHERE parent NOT IN (SELECT child FROM edges)),
ways AS (SELECT id AS person_id, [id] AS path FROM roots
  UNION ALL SELECT e.child, list_append(path, e.child) FROM ways JOIN edges e ON e.parent = person_id WHERE e.child NOT IN (SELECT id FROM members))"""

ORACLE = {
    "p1_found": f"""WITH RECURSIVE {_EDGES}
SELECT 'path' AS kind, person_id, path[1] AS root_id, CAST(len(path) - 1 AS BIGINT) AS depth, array_to_string(path, '>') AS path FROM ways
UNION ALL SELECT 'cycle', unnest(path), path[1], CAST(len(path) AS BIGINT), array_to_string(path, '>') FROM rings""",
    "p1_descendants": f"""WITH RECURSIVE {_EDGES}
SELECT a AS person_id, b AS descendant_id, CAST(min(d) AS BIGINT) AS nearest FROM (
  SELECT path[i] AS a, path[len(path)] AS b, len(path) - i AS d FROM (SELECT path, unnest(range(1, len(path))) AS i FROM ways)) GROUP BY a, b""",
}
