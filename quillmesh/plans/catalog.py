"""Queries over the engine's own operators, with the SQL they are held against.

Every query reads whole tables. The TPC-H-like tables stand in where the domain has no table of the needed shape.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frontmatter, text
from ..operators import chat, daily, indexing, inventory, kinship, people, relations, search
from ..operators.hierarchy import parent_edges
from ..session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


_T = table


# --- relationships -------------------------------------------------------------------------------------------------

# Fixed value: the types that may stand in both directions, as SQL
_SYMMETRIC = ", ".join(f"'{t}'" for t in relations.SYMMETRIC_TYPES)
_VALID = ", ".join(f"'{t}'" for t in relations.VALID_TYPES)


@query(
    "relatives_named",
    "SELECT r.id, p.name AS person_name, q.name AS relative_name, r.relative_is FROM relationships r JOIN people p ON p.id = r.person_id JOIN people q ON q.id = r.relative_id",
)
def relatives_named(spark, d):
    return relations.with_names(_T(spark, d, "relationships"), _T(spark, d, "people")).select("id", "person_name", "relative_name", "relative_is")


@query(
    "relatives_wives",
    "SELECT r.id, q.name AS relative_name FROM relationships r JOIN people p ON p.id = r.person_id JOIN people q ON q.id = r.relative_id WHERE r.relative_is = 'spouse' AND q.gender = 'F'",
)
def relatives_wives(spark, d):
    named = relations.with_names(_T(spark, d, "relationships"), _T(spark, d, "people"))
    return relations.of_type(named, "wife").select("id", "relative_name")


_KNOWN = "person_id IN (SELECT id FROM people) AND relative_id IN (SELECT id FROM people)"
_LONE = "SELECT person_id, relative_id FROM relationships EXCEPT SELECT relative_id, person_id FROM relationships"
_MISSING = f"SELECT id FROM relationships JOIN ({_LONE}) lone USING (person_id, relative_id) WHERE NOT coalesce(inferred, false) AND {_KNOWN}"
# edges grouped by their unordered pair: those up that were told, times those down
_CONFLICT = f"""SELECT least(person_id, relative_id) AS person_id, greatest(person_id, relative_id) AS relative_id, relative_is,
    count(*) FILTER (person_id < relative_id AND NOT coalesce(inferred, false)) * count(*) FILTER (person_id > relative_id) AS n
  FROM relationships WHERE {_KNOWN} AND relative_is NOT IN ({_SYMMETRIC}) GROUP BY 1, 2, 3 HAVING n > 0"""
_ORPHAN = """SELECT r.id, r.person_id AS missing_id, 'person' AS side FROM relationships r WHERE r.person_id NOT IN (SELECT id FROM people)
  UNION ALL SELECT r.id, r.relative_id, 'relative' FROM relationships r WHERE r.relative_id NOT IN (SELECT id FROM people)"""


@query("edges_missing_reciprocal", _MISSING)
def edges_missing_reciprocal(spark, d):
    return relations.missing_reciprocals(_T(spark, d, "relationships"), _T(spark, d, "people")).select("id")


@query("edges_conflicting", _CONFLICT)
def edges_conflicting(spark, d):
    found = relations.conflicting_directions(_T(spark, d, "relationships"), _T(spark, d, "people"))
    return found.groupBy("person_id", "relative_id", "relative_is").agg(F.count("*").alias("n"))


@query("edges_orphaned", _ORPHAN)
def edges_orphaned(spark, d):
    return relations.orphan_edges(_T(spark, d, "relationships"), _T(spark, d, "people"))


_ISSUES = f"""SELECT 'error' AS severity, 'missing_reciprocal' AS issue, count(*) AS n FROM ({_MISSING})
      UNION ALL SELECT 'error', 'conflicting_direction', sum(n)::BIGINT FROM ({_CONFLICT})
      UNION ALL SELECT 'error', 'unknown_type', count(*) FROM relationships WHERE NOT coalesce(inferred, false) AND relative_is NOT IN ({_VALID})
      UNION ALL SELECT 'error', 'orphan', count(*) FROM ({_ORPHAN})
      UNION ALL SELECT 'error', 'self_relationship', count(*) FROM relationships WHERE person_id = relative_id AND {_KNOWN}
      UNION ALL SELECT 'warning', 'missing_gender', count(*) FROM people WHERE coalesce(gender, '') NOT IN ('M', 'F', 'NB')"""


@query("integrity_summary", f"SELECT * FROM ({_ISSUES}) WHERE n > 0")
def integrity_summary(spark, d):
    return relations.integrity_summary(relations.integrity_issues(_T(spark, d, "relationships"), _T(spark, d, "people")))


@query(
    "integrity_verdict",
    f"SELECT coalesce(sum(n) FILTER (severity = 'error'), 0)::BIGINT AS errors, coalesce(sum(n) FILTER (severity = 'warning'), 0)::BIGINT AS warnings, coalesce(sum(n) FILTER (severity = 'error'), 0) = 0 AS ok FROM ({_ISSUES})",
)
def integrity_verdict(spark, d):
    return relations.integrity_verdict(relations.integrity_issues(_T(spark, d, "relationships"), _T(spark, d, "people")))


def _case(relation: str, gender: str) -> str:
    plain = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in relations.RECIPROCAL.items())
    by = " ".join(f"WHEN '{k}' THEN CASE WHEN {gender} = 'M' THEN '{m}' ELSE '{o}' END" for k, (m, o) in relations.RECIPROCAL_BY_GENDER.items())
    return f"CASE {relation} {plain} {by} END"


@query("edges_reciprocal", f"SELECT r.id, {_case('r.relative_is', 'p.gender')} AS reciprocal FROM relationships r LEFT JOIN people p ON p.id = r.person_id")
def edges_reciprocal(spark, d):
    genders = _T(spark, d, "people").select(F.col("id").alias("person_id"), "gender")
    edges = _T(spark, d, "relationships").join(genders, "person_id", "left")
    return edges.select("id", relations.reciprocal_type(F.col("relative_is"), F.col("gender")).alias("reciprocal"))


@query(
    "edges_repaired",
    f"""SELECT DISTINCT person_id, relative_id, relative_is FROM (
      SELECT person_id, relative_id, relative_is FROM relationships WHERE person_id <> relative_id
      UNION ALL SELECT r.relative_id, r.person_id, {_case('r.relative_is', 'p.gender')} FROM relationships r
        JOIN ({_LONE}) lone USING (person_id, relative_id) LEFT JOIN people p ON p.id = r.person_id WHERE {_case('r.relative_is', 'p.gender')} IS NOT NULL)""",
)
def edges_repaired(spark, d):
    return relations.repaired(_T(spark, d, "relationships"), _T(spark, d, "people"))


@query(
    "edges_drawn_once",
    f"""SELECT arg_min(person_id, k) AS person_id, arg_min(relative_id, k) AS relative_id, relative_is FROM (
      SELECT *, person_id * 1000000000 + relative_id AS k, CASE WHEN relative_is IN ({_SYMMETRIC}) THEN least(person_id, relative_id) ELSE person_id END AS a,
        CASE WHEN relative_is IN ({_SYMMETRIC}) THEN greatest(person_id, relative_id) ELSE relative_id END AS b FROM relationships) GROUP BY a, b, relative_is""",
)
def edges_drawn_once(spark, d):
    return relations.undirected_once(_T(spark, d, "relationships"))


@query("edges_per_person", "SELECT id, count(*) AS n FROM (SELECT person_id AS id FROM relationships UNION ALL SELECT relative_id FROM relationships WHERE relative_id <> person_id) GROUP BY id")
def edges_per_person(spark, d):
    return relations.degrees(_T(spark, d, "relationships"))


@query(
    "two_hops",
    """WITH ways AS (SELECT person_id a, relative_id b FROM relationships UNION SELECT relative_id, person_id FROM relationships),
      near AS (SELECT 1 AS a UNION SELECT b FROM ways WHERE a = 1 UNION SELECT y.b FROM ways x JOIN ways y ON y.a = x.b WHERE x.a = 1)
      SELECT person_id, relative_id, relative_is FROM relationships WHERE person_id IN (SELECT a FROM near) AND relative_id IN (SELECT a FROM near)""",
)
def two_hops(spark, d):
    return relations.neighbourhood(_T(spark, d, "relationships"), 1, 2)


_EDGES = """edges AS (SELECT DISTINCT CASE WHEN t.means = 'parent' THEN r.relative_id ELSE r.person_id END AS parent, CASE WHEN t.means = 'parent' THEN r.person_id ELSE r.relative_id END AS child
      FROM relationships r JOIN relation_terms t ON t.term = lower(trim(r.relative_is)) AND t.means IN ('parent', 'child') JOIN people p ON p.id = r.person_id JOIN people q ON q.id = r.relative_id)"""
_CLOSURE = f"""{_EDGES}, up AS (SELECT child AS person_id, parent AS ancestor_id, 1 AS gen FROM edges WHERE parent <> child
      UNION SELECT u.person_id, e.parent, u.gen + 1 FROM up u JOIN edges e ON e.child = u.ancestor_id WHERE u.gen < 150),
      closure AS (SELECT person_id, ancestor_id, min(gen) AS gen FROM up WHERE person_id <> ancestor_id GROUP BY ALL)"""


def _parents(spark, d):
    return parent_edges(*(_T(spark, d, n) for n in ("relationships", "people", "relation_terms")))


@query("ancestor_closure", f"WITH RECURSIVE {_CLOSURE} SELECT person_id, ancestor_id, gen FROM closure")
def ancestor_closure(spark, d):
    return kinship.ancestors(_parents(spark, d))


def _words(words: tuple[str, str, str]) -> str:
    return f"CASE gender WHEN 'M' THEN '{words[0]}' WHEN 'F' THEN '{words[1]}' ELSE '{words[2]}' END"


_KIN = f"""WITH RECURSIVE {_CLOSURE}, options AS (
      SELECT person_id, ancestor_id AS relative_id, 0 AS tier, gen AS a, 0 AS b, 0 AS via FROM closure
      UNION ALL SELECT ancestor_id, person_id, 1, gen, 0, 0 FROM closure
      UNION ALL SELECT x.person_id, y.person_id, 2, x.gen, y.gen, x.ancestor_id FROM closure x JOIN closure y ON y.ancestor_id = x.ancestor_id AND y.person_id <> x.person_id),
      best AS (SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY person_id, relative_id ORDER BY tier, a + b, a, via) = 1)
      SELECT person_id, relative_id, CASE
        WHEN tier = 0 AND a = 1 THEN {_words(kinship.PARENT)} WHEN tier = 0 THEN repeat('great-', a - 2) || {_words(kinship.GRANDPARENT)}
        WHEN tier = 1 AND a = 1 THEN {_words(kinship.CHILD)} WHEN tier = 1 THEN repeat('great-', a - 2) || {_words(kinship.GRANDCHILD)}
        WHEN a = 1 AND b = 1 THEN {_words(kinship.SIBLING)} WHEN a = 1 THEN repeat('great-', b - 2) || {_words(kinship.NEPHEW)}
        WHEN b = 1 THEN repeat('great-', a - 2) || {_words(kinship.UNCLE)}
        ELSE CASE least(a, b) - 1 WHEN 1 THEN '1st' WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' ELSE (least(a, b) - 1) || 'th' END || ' cousin' ||
          CASE abs(a - b) WHEN 0 THEN '' WHEN 1 THEN ' once removed' WHEN 2 THEN ' twice removed' ELSE ' ' || abs(a - b) || 'x removed' END END AS relation
      FROM best LEFT JOIN people ON people.id = relative_id"""


@query("kinship_names", _KIN)
def kinship_names(spark, d):
    return kinship.kinship(_parents(spark, d), _T(spark, d, "people"))


@query(
    "relatives_merged",
    f"""WITH kin AS ({_KIN}) SELECT DISTINCT person_id, relative_id, relative_is AS relation, false AS inferred FROM relationships
      UNION ALL SELECT person_id, relative_id, relation, true FROM kin k WHERE NOT EXISTS (SELECT 1 FROM relationships r WHERE r.person_id = k.person_id AND r.relative_id = k.relative_id)""",
)
def relatives_merged(spark, d):
    return relations.merge_relatives(_T(spark, d, "relationships"), kinship.kinship(_parents(spark, d), _T(spark, d, "people")))


# --- inventory -----------------------------------------------------------------------------------------------------


@query("houses_found", "SELECT id, name FROM producers WHERE lower(name) LIKE '%casa%' OR lower(coalesce(region, '')) LIKE '%casa%'")
def houses_found(spark, d):
    return inventory.find_by_name(_T(spark, d, "producers"), "casa", "name", "region").select("id", "name")


@query(
    "recent_tastings",
    "SELECT id, coalesce(nullif(tasted_at, ''), created_at) AS \"at\" FROM tastings ORDER BY 2 DESC NULLS LAST, id DESC LIMIT 50",
)
def recent_tastings(spark, d):
    return inventory.recent(_T(spark, d, "tastings"), 50).select("id", "at")


@query(
    "last_tastings_per_bottle",
    "SELECT id, bottle_id, place FROM (SELECT *, row_number() OVER (PARTITION BY bottle_id ORDER BY tasted_at DESC NULLS LAST, id DESC) AS place FROM tastings) WHERE place <= 3",
)
def last_tastings_per_bottle(spark, d):
    return inventory.last_per_group(_T(spark, d, "tastings"), "bottle_id", 3).select("id", "bottle_id", F.col("place").cast("long").alias("place"))


@query("invalid_ratings", "SELECT id, rating FROM tastings WHERE rating < 0 OR rating > 100")
def invalid_ratings(spark, d):
    return inventory.invalid_ratings(_T(spark, d, "tastings")).select("id", "rating")


@query("chunks_without_vector", "SELECT id FROM chunks WHERE id NOT IN (SELECT chunk_id FROM chunk_embeddings WHERE chunk_id IS NOT NULL)")
def chunks_without_vector(spark, d):
    vectors = _T(spark, d, "chunk_embeddings").select(F.col("chunk_id").alias("id"))
    return inventory.without_events(_T(spark, d, "chunks"), vectors, "id").select("id")


@query("customers_without_urgent", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def customers_without_urgent(spark, d):
    urgent = _T(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return inventory.without_events(_T(spark, d, "customer"), urgent, "c_custkey").select("c_custkey")


@query("suppliers_with_returns", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def suppliers_with_returns(spark, d):
    lines = _T(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    return inventory.of_kind(_T(spark, d, "supplier"), lines, "s_suppkey", F.col("l_returnflag") == "R").select("s_suppkey", "s_name")


@query(
    "recent_lines",
    """SELECT l_orderkey, l_linenumber, p_name, s_name, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
      ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, p_name, s_name, l_quantity LIMIT 100""",
)
def recent_lines(spark, d):
    star = _T(spark, d, "lineitem").join(_T(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(_T(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    keys = ("l_orderkey", "l_linenumber", "p_name", "s_name", "l_quantity")
    return star.orderBy(F.desc("l_shipdate"), *keys).limit(100).select(*keys)


@query("files_with_chunks", "SELECT f.id, count(c.id) AS n, coalesce(sum(length(c.content)), 0) AS chars FROM files f LEFT JOIN chunks c ON c.file_id = f.id GROUP BY f.id")
def files_with_chunks(spark, d):
    children = _T(spark, d, "chunks").select("file_id", "chunk_index", F.col("id").alias("chunk_id"), F.length("content").alias("chars"))
    full = inventory.with_children(_T(spark, d, "files").select(F.col("id").alias("file_id")), children, "file_id", ("chunk_index", "chunk_id"))
    return full.select(F.col("file_id").alias("id"), F.size("items").cast("long").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["chars"], F.lit(0))).alias("chars"))


@query("region_vocabulary", "SELECT DISTINCT value FROM (SELECT country AS value FROM producers WHERE country IS NOT NULL UNION ALL SELECT unnest(['FR', 'IT', 'NZ']))")
def region_vocabulary(spark, d):
    return inventory.vocabulary(_T(spark, d, "producers"), "country", ("FR", "IT", "NZ"))


@query(
    "suppliers_merged",
    """SELECT CASE WHEN l_suppkey % 10 = 0 AND l_suppkey > 1 THEN 1 ELSE l_suppkey END AS s_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1""",
)
def suppliers_merged(spark, d):
    mapping = _T(spark, d, "supplier").where("s_suppkey % 10 = 0 and s_suppkey > 1").select(F.col("s_suppkey").alias("old"), F.lit(1).cast("long").alias("new"))
    moved = inventory.remap(_T(spark, d, "lineitem"), "l_suppkey", mapping)
    return moved.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("parts_by_number", "SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(p_brand, '(\\d+)$', 1), '') AS INTEGER), 0) AS number FROM part")
def parts_by_number(spark, d):
    return _T(spark, d, "part").select("p_partkey", text.embedded_number(F.col("p_brand"), r"(\d+)$").alias("number"))


# --- search --------------------------------------------------------------------------------------------------------


def _query_vector(spark, d):
    return [float(x) for x in _T(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query(
    "nearest_vectors",
    """SELECT vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: power(z[1]::DOUBLE - z[2]::DOUBLE, 2)))), 6) AS distance,
      row_number() OVER (ORDER BY sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: power(z[1]::DOUBLE - z[2]::DOUBLE, 2)))), vec_id) AS rank
      FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY rank LIMIT 30""",
)
def nearest_vectors(spark, d):
    near = search.nearest_rows(_T(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 30)
    return near.select("id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


_BM25 = """docs AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(content, '') || chr(10) || coalesce(heading, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS ts FROM chunks),
      s AS (SELECT id, len(ts) AS n, len(list_filter(ts, lambda t: t = 'cellar')) AS a, len(list_filter(ts, lambda t: t = 'barrel')) AS b FROM docs),
      g AS (SELECT count(*) AS c, avg(n) AS l, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM s),
      k AS (SELECT id, greatest(1e-6, ln((c - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / l)) + greatest(1e-6, ln((c - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / l)) AS score
        FROM s, g WHERE a > 0 AND b > 0)"""


def _keyword_leg(spark, d, n):
    return search.bm25(_T(spark, d, "chunks"), "id", ("content", "heading"), "cellar barrel", n)


@query("keyword_top", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM k ORDER BY k.score DESC, id LIMIT 30")
def keyword_top(spark, d):
    return _keyword_leg(spark, d, 30).select("id", F.round("score", 6).alias("score"))


_VECTOR_LEG = """q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
      v AS (SELECT chunk_id AS id, sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: power(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS dist FROM chunk_embeddings, q
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
      vr AS (SELECT id, row_number() OVER (ORDER BY dist, id) AS r FROM v QUALIFY r <= 30),
      kr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM k QUALIFY r <= 30),
      f AS (SELECT coalesce(vr.id, kr.id) AS id, coalesce(1.0 / (60 + vr.r), 0) + coalesce(1.0 / (60 + kr.r), 0) AS score, vr.r AS v, kr.r AS k FROM vr FULL JOIN kr ON kr.id = vr.id),
      cut AS (SELECT * FROM f ORDER BY score DESC, v NULLS LAST, k NULLS LAST LIMIT 20)"""


def _legs(spark, d):
    return search.nearest_rows(_T(spark, d, "chunk_embeddings"), "chunk_id", "embedding", _query_vector(spark, d), 30), _keyword_leg(spark, d, 30)


@query("hybrid_fused", f"WITH {_BM25}, {_VECTOR_LEG} SELECT id, round(score::DOUBLE, 8) AS score FROM cut")
def hybrid_fused(spark, d):
    return search.fuse(*_legs(spark, d), 20).select("id", F.round("score", 8).alias("score"))


@query(
    "hybrid_filtered",
    f"WITH {_BM25}, {_VECTOR_LEG} SELECT cut.id, round(score::DOUBLE, 8) AS score, file_id FROM cut JOIN chunks ON chunks.id = cut.id WHERE page_num IS NULL ORDER BY cut.score DESC, v NULLS LAST, k NULLS LAST LIMIT 10",
)
def hybrid_filtered(spark, d):
    rows = _T(spark, d, "chunks").select("id", "file_id", "page_num")
    return search.hybrid(*_legs(spark, d), rows, 10, F.col("page_num").isNull()).select("id", F.round("score", 8).alias("score"), "file_id")


@query("index_sections", "SELECT section AS value, count(*) AS n FROM files GROUP BY section")
def index_sections(spark, d):
    return search.group_counts(_T(spark, d, "files"), "section")


@query(
    "index_status",
    "SELECT (SELECT count(*) FROM files) AS n_files, (SELECT max(indexed_at) FROM files) AS last_indexed, (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM chunks WHERE metadata IS NULL) AS pending, (SELECT count(*) FROM chunk_embeddings) AS n_vectors",
)
def index_status(spark, d):
    return search.index_status(*(_T(spark, d, n) for n in ("chunks", "files", "chunk_embeddings")))


@query(
    "line_excerpts",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE regexp_matches(text, '(?i)walnut')),
      h AS (SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '(?i)walnut'))[1:2] AS hits FROM l)
      SELECT doc_id AS id, array_to_string(list_transform(hits, lambda i: array_to_string(ls[greatest(i - 2, 1):i + 2], chr(10))), chr(10) || '…' || chr(10)) AS excerpt FROM h WHERE len(hits) > 0""",
)
def line_excerpts(spark, d):
    return search.regex_excerpts(_T(spark, d, "documents"), "doc_id", "text", "walnut")


# --- text ----------------------------------------------------------------------------------------------------------


@query("token_estimates", "SELECT id, CAST(greatest(1, length(content) // 4) AS INTEGER) AS tokens FROM chunks")
def token_estimates(spark, d):
    return _T(spark, d, "chunks").select("id", text.token_estimate(F.col("content")).alias("tokens"))


@query(
    "duplicate_fingerprints",
    "SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))))) GROUP BY n",
)
def duplicate_fingerprints(spark, d):
    rows = _T(spark, d, "documents").where("text is not null").groupBy(text.fingerprint(F.col("text"))).agg(F.count("*").alias("n"))
    return rows.groupBy("n").agg(F.count("*").alias("groups"))


@query(
    "file_paths",
    """SELECT id, CASE WHEN len(string_split(path, '/')) = 1 THEN 'root' WHEN lower(string_split(path, '/')[1]) = 'cellar' AND len(string_split(path, '/')) > 2 THEN 'cellar/' || lower(string_split(path, '/')[2])
      ELSE lower(string_split(path, '/')[1]) END AS section, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'md' THEN 'md' WHEN 'markdown' THEN 'md' WHEN 'txt' THEN 'txt' WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'pdf' THEN 'pdf' END AS ext FROM files""",
)
def file_paths(spark, d):
    return _T(spark, d, "files").select("id", text.section_of(F.col("path")).alias("section"), text.extension_of(F.col("path")).alias("ext"))


@query("file_tags", "SELECT tag, count(*) AS n FROM (SELECT trim(unnest(string_split(tags, ','))) AS tag FROM files WHERE tags <> '') WHERE tag <> '' GROUP BY tag")
def file_tags(spark, d):
    tags = _T(spark, d, "files").where("tags <> ''").select(F.explode(F.split("tags", ",")).alias("tag")).select(F.trim("tag").alias("tag"))
    return tags.where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


@query("house_slugs", "SELECT id, nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug FROM producers")
def house_slugs(spark, d):
    return _T(spark, d, "producers").select("id", text.slug(F.col("name")).alias("slug"))


@query("event_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def event_properties(spark, d):
    return _T(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    "note_headers",
    """SELECT doc_id, nullif(trim(regexp_extract(text, '^---\\n(?:.*\\n)*?date:[ \\t]*(.*)\\n', 1)), '') AS day,
      CASE WHEN regexp_matches(text, '^---\\n(?:.*\\n)*?tags:') THEN list_filter(list_transform(string_split(regexp_extract(text, '^---\\n(?:.*\\n)*?tags:[ \\t]*\\[(.*)\\][ \\t]*\\n', 1), ','), lambda x: trim(x)), lambda x: x <> '') ELSE [] END::VARCHAR AS tags
      FROM documents WHERE regexp_matches(text, '^---\\n')""",
)
def note_headers(spark, d):
    t = F.col("text")
    rows = _T(spark, d, "documents").where(t.startswith("---\n"))
    tags = frontmatter.list_field(t, "tags")
    return rows.select("doc_id", frontmatter.get_field(t, "date").alias("day"), F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]")).alias("tags"))


# --- daily logs and checklists -------------------------------------------------------------------------------------


@query(
    "checklist_items",
    """SELECT doc_id, lower(regexp_extract(line, '^- \\[([ xX])\\] (.+)$', 1)) = 'x' AS done, regexp_extract(line, '^- \\[([ xX])\\] (.+)$', 2) AS task
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^- \\[([ xX])\\] (.+)$')""",
)
def checklist_items(spark, d):
    rows = _T(spark, d, "documents").select("doc_id", F.explode(daily.checklist_items(F.col("text"))).alias("i"))
    return rows.select("doc_id", "i.done", "i.task")


@query(
    "journal_entry_counts",
    r"SELECT doc_id AS id, len(regexp_extract_all(text, '(?m)^## \d{1,2}:\d{2} [A-Z]{2,4}[ \t]*\n')) AS n FROM documents WHERE regexp_matches(text, '(?m)^## \d{1,2}:\d{2} [A-Z]{2,4}[ \t]*\n')",
)
def journal_entry_counts(spark, d):
    return daily.journal_entries(_T(spark, d, "documents"), "doc_id", "text").groupBy("id").agg(F.count("*").alias("n"))


def _event_items(spark, d):
    e = _T(spark, d, "events")
    return e.select(F.to_date("ts").alias("day"), F.col("event_id").alias("pos"), (F.col("event_type") == "purchase").alias("done"), F.col("user_id").cast("string").alias("task"))


@query(
    "daily_completion",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type <> 'purchase') AS open, round(count(*) FILTER (event_type = 'purchase') / count(*), 3) AS rate FROM events GROUP BY 1",
)
def daily_completion(spark, d):
    return daily.daily_completion(_event_items(spark, d))


@query(
    "frequently_open",
    "SELECT task, days FROM (SELECT CAST(user_id AS VARCHAR) AS task, count(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE event_type <> 'purchase' GROUP BY 1 ORDER BY days DESC, task LIMIT 10) WHERE days >= 2",
)
def frequently_open(spark, d):
    return daily.frequently_open(_event_items(spark, d))


@query(
    "rolled_over",
    """WITH i AS (SELECT CAST(ts AS DATE) AS day, event_id AS pos, event_type = 'purchase' AS done, CAST(user_id AS VARCHAR) AS task FROM events)
      SELECT day + 1 AS day, min(pos) AS pos, task FROM i WHERE NOT done AND day + 1 IN (SELECT day FROM i) AND NOT EXISTS (SELECT 1 FROM i j WHERE j.day = i.day + 1 AND j.task = i.task) GROUP BY i.day, task""",
)
def rolled_over(spark, d):
    return daily.rollover(_event_items(spark, d))


@query(
    "middle_of_day",
    """WITH t AS (SELECT CAST(ts AS DATE) AS day, event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS tier FROM events),
      r AS (SELECT *, row_number() OVER (PARTITION BY day, tier ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY day, tier) AS n FROM t)
      SELECT day, arg_min(event_id, tier) AS event_id FROM r WHERE rn = n // 2 + 1 GROUP BY day""",
)
def middle_of_day(spark, d):
    rows = _T(spark, d, "events").select(F.to_date("ts").alias("day"), "event_id", "event_type")
    return daily.middle_of_day(rows, "day", "event_id", F.col("event_type") == "purchase").select("day", "event_id")


@query("tasted_span", "SELECT min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, count(DISTINCT CAST(ts AS DATE)) AS n, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 = count(DISTINCT CAST(ts AS DATE)) AS contiguous FROM events")
def tasted_span(spark, d):
    return daily.contiguous(_T(spark, d, "events").select(F.to_date("ts").alias("day")), "day")


@query(
    "days_expanded",
    "SELECT DISTINCT CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 2, INTERVAL 1 DAY)) AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def days_expanded(spark, d):
    spans = _T(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 2).alias("b"))
    return daily.expand_days(spans, "b", "a")


@query(
    "day_extremes",
    """WITH h AS (SELECT CAST(ts AS DATE) AS day, event_id AS hour, value AS temp, event_type AS direction FROM events),
      m AS (SELECT day, direction, n FROM (SELECT day, direction, count(*) AS n FROM h GROUP BY day, direction) QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, direction) = 1),
      x AS (SELECT day, hour FROM h QUALIFY row_number() OVER (PARTITION BY day ORDER BY temp DESC, hour) = 1), y AS (SELECT day, hour FROM h QUALIFY row_number() OVER (PARTITION BY day ORDER BY temp, hour) = 1)
      SELECT h.day, max(temp) AS max_temp, any_value(x.hour) AS max_hour, min(temp) AS min_temp, any_value(y.hour) AS min_hour, any_value(m.direction) AS direction
      FROM h JOIN m USING (day) JOIN x USING (day) JOIN y USING (day) GROUP BY h.day""",
)
def day_extremes(spark, d):
    e = _T(spark, d, "events")
    zero = F.lit(0.0)
    hours = e.select(F.to_date("ts").alias("day"), F.col("event_id").alias("hour"), F.col("value").alias("temp"), zero.alias("rain"), zero.alias("snow"), zero.alias("precip"), zero.alias("wind"), zero.alias("gust"), F.col("event_type").alias("direction"))
    return daily.weather_day(hours, "day").select("day", "max_temp", "max_hour", "min_temp", "min_hour", "direction")


# --- chats ---------------------------------------------------------------------------------------------------------


def _messages(spark, d):
    return _T(spark, d, "messages").withColumn("day", F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date")))


_DAY = "CASE WHEN regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') THEN date END"


@query(
    "chat_summary",
    f"""WITH m AS (SELECT coalesce(sender, '') AS sender, {_DAY} AS day, coalesce(len(photos), 0) AS p FROM messages)
      SELECT sender, count(*) AS n, count(DISTINCT day) AS days, CAST(sum(p) AS BIGINT) AS photos FROM m GROUP BY sender UNION ALL SELECT '*', count(*), count(DISTINCT day), CAST(sum(p) AS BIGINT) FROM m""",
)
def chat_summary(spark, d):
    return chat.summary(_messages(spark, d))


@query("chat_search", f"SELECT id FROM messages WHERE contains(lower(text), 'walnut') AND {_DAY} >= '2023-06-01' AND {_DAY} <= '2024-12-31'")
def chat_search(spark, d):
    return chat.search(_messages(spark, d), "Walnut", "2023-06-01", "2024-12-31").select("id")


@query("chat_days", f"SELECT DISTINCT {_DAY} AS day FROM messages WHERE year(CAST({_DAY} AS DATE)) = 2024")
def chat_days(spark, d):
    return chat.days_with_chats(_messages(spark, d), 2024)


@query("last_messages", "SELECT chat, id FROM (SELECT chat, id, row_number() OVER (PARTITION BY chat ORDER BY id DESC) AS place FROM messages) WHERE place <= 5")
def last_messages(spark, d):
    return chat.last_messages(_T(spark, d, "messages"), "chat", 5, "id").select("chat", "id")


@query(
    "parsed_transcripts",
    r"SELECT doc_id AS key, len(regexp_extract_all(text, '(?m)^\*\*[^*\n]+?:\*\*')) AS n FROM documents WHERE regexp_matches(text, '(?m)^\*\*[^*\n]+?:\*\*')",
)
def parsed_transcripts(spark, d):
    return chat.parse_day_files(_T(spark, d, "documents"), "doc_id", "text").groupBy("key").agg(F.count("*").alias("n"))


# --- index maintenance ---------------------------------------------------------------------------------------------


@query(
    "index_diff",
    """WITH o AS (SELECT path, content_hash FROM files WHERE id % 7 <> 0), n AS (SELECT CASE WHEN id % 5 = 0 THEN path || '.moved' ELSE path END AS path, CASE WHEN id % 11 = 0 THEN content_hash || 'x' ELSE content_hash END AS content_hash FROM files WHERE id % 13 <> 0),
      b AS (SELECT n.path AS np, o.path AS op, n.content_hash AS nh, o.content_hash AS oh FROM n FULL JOIN o ON o.path = n.path),
      f AS (SELECT nh AS h, np, row_number() OVER (PARTITION BY nh ORDER BY np) AS k FROM b WHERE op IS NULL), g AS (SELECT oh AS h, op, row_number() OVER (PARTITION BY oh ORDER BY op) AS k FROM b WHERE np IS NULL)
      SELECT status, count(*) AS n FROM (SELECT CASE WHEN nh = oh THEN 'unchanged' ELSE 'updated' END AS status FROM b WHERE np IS NOT NULL AND op IS NOT NULL
        UNION ALL SELECT CASE WHEN np IS NULL THEN 'deleted' WHEN op IS NULL THEN 'new' ELSE 'moved' END FROM f FULL JOIN g ON f.h = g.h AND f.k = g.k) GROUP BY status""",
)
def index_diff(spark, d):
    files = _T(spark, d, "files").select("id", "path", "content_hash")
    old = files.where("id % 7 <> 0")
    new = files.where("id % 13 <> 0").select(
        F.when(F.col("id") % 5 == 0, F.concat("path", F.lit(".moved"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("id") % 11 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"),
    )
    return indexing.scan_diff(old, new).groupBy("status").agg(F.count("*").alias("n"))


@query("note_chunks")
def note_chunks(spark, d):
    return indexing.chunked(_T(spark, d, "documents"), "doc_id", "text")


@query(
    "ignored_files",
    "SELECT id, CASE WHEN regexp_matches(path, '^Journal/2024/.*$') THEN false WHEN starts_with(path, 'Journal/') OR starts_with(path, 'Cellar/2023/') THEN true ELSE false END AS ignored FROM files",
)
def ignored_files(spark, d):
    rules = [("Journal", False), ("Cellar/2023", False), ("Journal/2024/*", True)]
    return indexing.ignored(_T(spark, d, "files"), rules).select("id", "ignored")


@query("user_sessions", "SELECT user_id, count(*) AS n FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS s FROM events) WHERE s GROUP BY user_id")
def user_sessions(spark, d):
    from ..streaming.windows import sessions

    return sessions(_T(spark, d, "events"), "user_id", "ts").groupBy("user_id").agg(F.count("*").alias("n"))



# --- people --------------------------------------------------------------------------------------------------------


@query("people_found", "SELECT id, name, gender, birthdate, location, profession, phone, aliases FROM people WHERE lower(name) LIKE '%greta%'")
def people_found(spark, d):
    return people.find(_T(spark, d, "people"), "Greta")


@query(
    "relatives_ordered",
    "SELECT r.id, row_number() OVER (PARTITION BY person_id ORDER BY relative_is, q.name, r.id) AS place FROM relationships r JOIN people p ON p.id = r.person_id JOIN people q ON q.id = r.relative_id",
)
def relatives_ordered(spark, d):
    named = relations.with_names(_T(spark, d, "relationships"), _T(spark, d, "people"))
    return people.relatives_in_order(named).select("id", F.col("place").cast("long").alias("place"))


@query("edges_of_family", "SELECT id FROM relationships WHERE coalesce(inferred, false) OR relative_is = 'parent'")
def edges_of_family(spark, d):
    return people.of_sort(_T(spark, d, "relationships"), "family").select("id")


@query("iso_days", "SELECT id, coalesce(regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') AND try_cast(date AS DATE) IS NOT NULL, false) AS iso FROM messages")
def iso_days(spark, d):
    return _T(spark, d, "messages").select("id", people.is_iso_day(F.col("date")).alias("iso"))


@query(
    "links_inferred_first",
    f"""WITH kin AS ({_KIN}), i AS (SELECT person_id, name AS relative_name, relation FROM kin JOIN people ON people.id = relative_id),
      e AS (SELECT person_id, q.name AS relative_name, relative_is AS relation FROM relationships r JOIN people p ON p.id = r.person_id JOIN people q ON q.id = r.relative_id)
      SELECT DISTINCT * FROM (SELECT * FROM i UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.person_id = e.person_id AND i.relative_name = e.relative_name))""",
)
def links_inferred_first(spark, d):
    everyone = _T(spark, d, "people")
    kin = kinship.kinship(_parents(spark, d), everyone).join(everyone.select(F.col("id").alias("relative_id"), F.col("name").alias("relative_name")), "relative_id")
    told = relations.with_names(_T(spark, d, "relationships"), everyone).withColumn("relation", F.col("relative_is"))
    return people.links_inferred_first(told, kin)
