"""Further queries, one operator each where the catalogue has none, with the SQL they are held against; all over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frontmatter, text
from ..operators import chat, daily, indexing, inventory, kinship, people, relations, search, upkeep
from ..session import table as _T
from ..sources import external
from . import catalog, jobs
from .catalog import _EDGES, _KIN, _event_items, _parents, query

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_low = lambda c: f"translate({c}, '{_UPPER}', '{_LOWER}')"
_E = "SELECT person_id, relative_id, relative_is FROM relationships"

# --- edges ---------------------------------------------------------------------------------------------------------


@query("edges_inserted", f"SELECT DISTINCT * FROM ({_E} UNION ALL VALUES (1, 4, 'accountant'), (4, 1, 'client'))")
def edges_inserted(spark, d):
    return relations.insert_edge(_T(spark, d, "relationships"), _T(spark, d, "people"), 1, 4, "accountant")


@query("edges_changed", f"SELECT DISTINCT * FROM ({_E} WHERE NOT (person_id = 1 AND relative_id = 2) AND NOT (person_id = 2 AND relative_id = 1) UNION ALL VALUES (1, 2, 'pet'), (2, 1, 'owner'))")
def edges_changed(spark, d):
    return relations.change_edge(_T(spark, d, "relationships"), _T(spark, d, "people"), 1, 2, "pet")


@query("edges_after_delete", "SELECT id FROM relationships WHERE NOT (person_id = 1 AND relative_id = 2 AND relative_is = 'friend') AND NOT (person_id = 2 AND relative_id = 1 AND relative_is = 'friend')")
def edges_after_delete(spark, d):
    return relations.delete_edge(_T(spark, d, "relationships"), _T(spark, d, "people"), 1, 2, "friend").select("id")


@query("edges_after_person", "SELECT id FROM relationships WHERE person_id <> 7 AND relative_id <> 7 UNION ALL SELECT -id FROM people WHERE id <> 7")
def edges_after_person(spark, d):
    everyone, edges = relations.delete_person(_T(spark, d, "people"), _T(spark, d, "relationships"), 7)
    return edges.select("id").unionAll(everyone.select((-F.col("id")).alias("id")))


@query("edges_between", "SELECT DISTINCT relative_is FROM relationships WHERE person_id = 3 AND relative_id = (SELECT min(relative_id) FROM relationships WHERE person_id = 3)")
def edges_between(spark, d):
    edges = _T(spark, d, "relationships")
    other = edges.where("person_id = 3").agg(F.min("relative_id")).first()[0]
    return relations.between(edges, 3, other if other is not None else -1)


@query("edges_drawable", "SELECT id FROM relationships WHERE NOT (coalesce(inferred, false) AND coalesce(regexp_matches(relative_is, 'son|daughter|child|nephew|niece'), false))")
def edges_drawable(spark, d):
    return relations.drawable(_T(spark, d, "relationships")).select("id")


@query("types_in_use", "SELECT DISTINCT relative_is FROM relationships WHERE relative_is IS NOT NULL")
def types_in_use(spark, d):
    return people.types_in_use(_T(spark, d, "relationships"))


@query("inferred_edges", f"WITH kin AS ({_KIN}) SELECT person_id, relative_id, relation AS relative_is, true AS inferred FROM kin WHERE NOT EXISTS (SELECT 1 FROM relationships r WHERE r.person_id = kin.person_id AND r.relative_id = kin.relative_id AND NOT coalesce(inferred, false))")
def inferred_edges(spark, d):
    return kinship.inferred_cache(_T(spark, d, "relationships"), kinship.kinship(_parents(spark, d), _T(spark, d, "people")))


@query("cousins", f"WITH kin AS ({_KIN}) SELECT person_id, relative_id FROM kin WHERE contains(relation, 'cousin')")
def cousins(spark, d):
    kin = kinship.kinship(_parents(spark, d), _T(spark, d, "people"))
    return kin.where(kinship.inferred_filter("cousin", F.col("relation"), F.lit(None).cast("string"))).select("person_id", "relative_id")


@query(
    "ancestors_shared",
    f"""WITH RECURSIVE {_EDGES}, up AS (SELECT child AS person_id, parent AS ancestor_id, 1 AS gen FROM edges WHERE parent <> child UNION SELECT u.person_id, e.parent, u.gen + 1 FROM up u JOIN edges e ON e.child = u.ancestor_id WHERE u.gen < 150),
      closure AS (SELECT person_id, ancestor_id, min(gen) AS gen FROM up WHERE person_id <> ancestor_id GROUP BY ALL),
      pick AS (SELECT min(person_id) AS a, max(person_id) AS b FROM closure WHERE ancestor_id = (SELECT ancestor_id FROM closure GROUP BY ancestor_id ORDER BY count(*) DESC, ancestor_id LIMIT 1))
      SELECT x.ancestor_id, x.gen AS gen_a, y.gen AS gen_b FROM pick JOIN closure x ON x.person_id = a JOIN closure y ON y.person_id = b AND y.ancestor_id = x.ancestor_id""",
)
def ancestors_shared(spark, d):
    up = kinship.ancestors(_parents(spark, d))
    widest = up.groupBy("ancestor_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ancestor_id").limit(1)
    a, b = up.join(widest, "ancestor_id", "left_semi").agg(F.min("person_id"), F.max("person_id")).first()
    return people.common_ancestors(_parents(spark, d), a, b)


@query(
    "wiki_sections",
    """SELECT person_id, '## Relationships' || chr(10) || string_agg('- ' || relative_is || ': [[' || name || ']]', chr(10) ORDER BY relative_is, name) AS section
      FROM (SELECT DISTINCT r.person_id, r.relative_is, p.name FROM relationships r JOIN people p ON p.id = r.relative_id WHERE NOT starts_with(p.name, 'Unknown')) GROUP BY person_id""",
)
def wiki_sections(spark, d):
    told = _T(spark, d, "relationships").select("person_id", "relative_id", F.col("relative_is").alias("relation"))
    return relations.wiki_links(told, _T(spark, d, "people"))


@query("person_by_id", "SELECT id, name FROM people WHERE id = 5")
def person_by_id(spark, d):
    return people.resolve_person(_T(spark, d, "people"), 5).select("id", "name")


@query("people_updated", "SELECT id, coalesce(nullif(phone, ''), 'none') AS phone, profession FROM people")
def people_updated(spark, d):
    rows = _T(spark, d, "people").select("id", "phone", "profession")
    changes = rows.where("phone is null or phone = ''").select("id", F.lit("none").alias("phone"), F.lit(None).cast("string").alias("profession"))
    return inventory.update(rows, changes, ["phone", "profession"])


@query("people_added", "SELECT id, name FROM people UNION ALL SELECT (SELECT max(id) FROM people) + row_number() OVER (ORDER BY name), name FROM (SELECT DISTINCT name FROM producers WHERE name NOT IN (SELECT name FROM people))")
def people_added(spark, d):
    return people.add(_T(spark, d, "people").select("id", "name"), _T(spark, d, "producers").where("name is not null").select("name"))


# --- inventory -----------------------------------------------------------------------------------------------------


@query("houses_in_order", f"SELECT id, row_number() OVER (ORDER BY {_low('name')} COLLATE \"binary\" NULLS FIRST, id) AS place FROM producers".replace(' COLLATE "binary"', ""))
def houses_in_order(spark, d):
    return inventory.by_name(_T(spark, d, "producers")).select("id", F.col("place").cast("long").alias("place"))


@query("orders_of_customers", "SELECT o_orderkey AS id, c_name AS producer_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE contains(lower(c_name), '#00000001') AND o_orderstatus = 'F' OR contains(lower(o_orderpriority), '#00000001') AND o_orderstatus = 'F'")
def orders_of_customers(spark, d):
    items = _T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("producer_id"), F.col("o_orderpriority").alias("name"), F.lit("order").alias("type"), F.col("o_orderstatus").alias("status"))
    houses = _T(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return inventory.with_producer(items, houses, "#00000001", "ORDER", "F").select("id", "producer_name")


@query("houses_upserted", f"SELECT id, name FROM producers UNION ALL SELECT (SELECT max(id) FROM producers) + row_number() OVER (ORDER BY k), name FROM (SELECT {_low('n_name')} AS k, min(n_name) AS name FROM nation GROUP BY 1) WHERE k NOT IN (SELECT {_low('name')} FROM producers WHERE name IS NOT NULL)")
def houses_upserted(spark, d):
    return inventory.upsert(_T(spark, d, "producers").select("id", "name"), _T(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("item_consumed", "SELECT p_partkey AS id, CASE WHEN p_partkey = 3 THEN greatest(0, p_size - 1) ELSE p_size END AS quantity, CASE WHEN p_partkey = 3 AND p_size <= 1 THEN 'consumed' ELSE p_brand END AS status FROM part")
def item_consumed(spark, d):
    items = _T(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("quantity"), F.col("p_brand").alias("status"))
    return inventory.consume(items, 3)


@query(
    "copies_merged",
    f"""WITH m AS (SELECT id AS old, min(id) OVER (PARTITION BY content_hash) AS new FROM files WHERE content_hash IS NOT NULL), s AS (SELECT * FROM m WHERE old <> new),
      p AS (SELECT c.id, coalesce(s.new, c.file_id) AS producer_id, first_value(c.id) OVER (PARTITION BY coalesce(s.new, c.file_id), {_low('c.heading')} ORDER BY s.new IS NOT NULL, c.id) AS stay FROM chunks c LEFT JOIN s ON s.old = c.file_id)
      SELECT id, producer_id, (SELECT count(*) FROM chunk_embeddings e JOIN p q ON q.id = e.chunk_id WHERE q.stay = p.id) AS n FROM p WHERE id = stay""",
)
def copies_merged(spark, d):
    files = _T(spark, d, "files").where("content_hash is not null").select("id", "content_hash")
    first = files.groupBy("content_hash").agg(F.min("id").alias("new"))
    mapping = files.join(first, "content_hash").where("id <> new").select(F.col("id").alias("old"), "new")
    items = _T(spark, d, "chunks").select("id", F.col("file_id").alias("producer_id"), F.col("heading").alias("name"))
    events = _T(spark, d, "chunk_embeddings").select(F.col("chunk_id").alias("bottle_id"))
    _, kept, moved = inventory.merge_producers(files.select("id"), items, events, mapping)
    n = moved.groupBy(F.col("bottle_id").alias("id")).agg(F.count("*").alias("n"))
    return kept.join(n, "id", "left").select("id", "producer_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("tastings_faulty", "SELECT id, CASE WHEN rating < 0 OR rating > 100 THEN 'rating' WHEN tasted_at <> '' AND NOT coalesce(regexp_matches(tasted_at, '^\\d{4}-\\d{2}-\\d{2}$') AND try_cast(tasted_at AS DATE) IS NOT NULL, false) THEN 'day' END AS fault FROM tastings")
def tastings_faulty(spark, d):
    return _T(spark, d, "tastings").select("id", inventory.event_fault(F.col("rating"), F.col("tasted_at")).alias("fault"))


@query("tastings_added", "SELECT id, bottle_id FROM tastings UNION ALL SELECT (SELECT max(id) FROM tastings) + row_number() OVER (ORDER BY p_partkey), p_partkey FROM part")
def tastings_added(spark, d):
    new = _T(spark, d, "part").select(F.col("p_partkey").alias("bottle_id"), F.lit("2024-05-01").alias("tasted_at"), F.lit(80).alias("rating"))
    return inventory.add_events(_T(spark, d, "tastings"), new).select("id", "bottle_id")


@query("parts_rated", "SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 1) THEN (SELECT max(l_quantity)::INTEGER FROM lineitem WHERE l_partkey = p_partkey) END AS rating FROM part")
def parts_rated(spark, d):
    items = _T(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(None).cast("int").alias("rating"))
    best = _T(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("bottle_id")).agg(F.max("l_quantity").cast("int").alias("rating")).withColumn("tasted_at", F.lit("2024-01-01"))
    events = spark.createDataFrame([], "id long, bottle_id long, tasted_at string, rating int")
    return inventory.rate(items, events, best)[0]


@query("names_in_both", "SELECT 'producer' AS kind, id, name FROM producers WHERE contains(lower(name), 'bra') UNION ALL SELECT 'item', id, name FROM people WHERE contains(lower(name), 'bra')")
def names_in_both(spark, d):
    return inventory.search_both(_T(spark, d, "producers"), _T(spark, d, "people"), "bra")


@query("nations_with_prose", "SELECT n_nationkey AS id, coalesce(a.r_regionkey, b.r_regionkey)::VARCHAR AS prose FROM nation JOIN region b ON b.r_regionkey = n_regionkey LEFT JOIN region a ON a.r_name = n_name")
def nations_with_prose(spark, d):
    region = _T(spark, d, "region")
    items = _T(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("expression"))
    prose = region.select(F.col("r_name").alias("title"), F.col("r_regionkey").cast("string").alias("text"))
    return people.with_prose(items, prose).select("id", "prose")


@query("aliases_learned", "SELECT abbreviation AS alias, CAST(utc_offset_minutes AS VARCHAR) AS zone FROM zone_names WHERE lower(abbreviation) <> 'pst' UNION ALL SELECT 'PST', 'Etc/GMT+8'")
def aliases_learned(spark, d):
    known = _T(spark, d, "zone_names").select(F.col("abbreviation").alias("alias"), F.col("utc_offset_minutes").cast("string").alias("zone"))
    return people.learn_alias(known, "PST", "Etc/GMT+8")


# --- index ---------------------------------------------------------------------------------------------------------


@query("paths_unseen", "SELECT id, path FROM files WHERE path NOT IN (SELECT path FROM files WHERE indexed_at IS NOT NULL AND modified_at <= indexed_at)")
def paths_unseen(spark, d):
    files = _T(spark, d, "files")
    return jobs.unseen(files, files.where("indexed_at is not null and modified_at <= indexed_at")).select("id", "path")


_CHANGED = "WITH n AS (SELECT CASE WHEN starts_with(path, 'Journal') THEN path || '.moved' ELSE path END AS path, CASE WHEN file_type = 'pdf' THEN content_hash || 'x' ELSE content_hash END AS content_hash FROM files), o AS (SELECT path, content_hash FROM files)"
_DIFF = f"""{_CHANGED}, b AS (SELECT n.path AS np, o.path AS op, n.content_hash AS nh, o.content_hash AS oh FROM n FULL JOIN o ON o.path = n.path),
      f AS (SELECT nh AS h, np, row_number() OVER (PARTITION BY nh ORDER BY np) AS k FROM b WHERE op IS NULL), g AS (SELECT oh AS h, op, row_number() OVER (PARTITION BY oh ORDER BY op) AS k FROM b WHERE np IS NULL),
      x AS (SELECT np AS path, op AS old_path, CASE WHEN nh = oh THEN 'unchanged' ELSE 'updated' END AS status FROM b WHERE np IS NOT NULL AND op IS NOT NULL
        UNION ALL SELECT np, op, CASE WHEN np IS NULL THEN 'deleted' WHEN op IS NULL THEN 'new' ELSE 'moved' END FROM f FULL JOIN g ON f.h = g.h AND f.k = g.k)"""


def _diff(spark, d):
    files = _T(spark, d, "files").select("id", "path", "content_hash", "file_type")
    new = files.select(
        F.when(F.col("path").startswith("Journal"), F.concat("path", F.lit(".moved"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("file_type") == "pdf", F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"),
    )
    return files.select("id", "path", "content_hash"), indexing.scan_diff(files, new)


@query("index_changes", f"{_DIFF} SELECT path, old_path, status FROM x")
def index_changes(spark, d):
    return _diff(spark, d)[1].select("path", "old_path", "status")


@query("index_applied", f"{_DIFF} SELECT c.id FROM chunks c JOIN files ON files.id = c.file_id JOIN x ON x.old_path = files.path WHERE status NOT IN ('updated', 'deleted')")
def index_applied(spark, d):
    files, diff = _diff(spark, d)
    return indexing.apply_diff(files, diff, _T(spark, d, "chunks").select("id", "file_id"))[1].select("id")


@query("status_counts", f"{_DIFF} SELECT status, count(*) AS n FROM x GROUP BY status")
def status_counts(spark, d):
    return jobs.status_counts(_diff(spark, d)[1])


@query("pdfs_last", "SELECT id, row_number() OVER (ORDER BY file_type = 'pdf', path) AS place FROM files")
def pdfs_last(spark, d):
    from ..functions.columns import numbered

    rows = _T(spark, d, "files").withColumn("ext", F.col("file_type")).withColumn("is_pdf", F.col("ext") == "pdf")
    return numbered(jobs.corpus_order(rows), "place", "is_pdf", "path").select("id", F.col("place").cast("long").alias("place"))


@query("recent_journal", "SELECT id FROM files WHERE section = 'journal' AND date >= '2024-01-15'")
def recent_journal(spark, d):
    return _T(spark, d, "files").where(search.recent_condition("date", "2024-07-13", 180)).select("id")


@query("first_matches", """WITH l AS (SELECT heading AS path, id, string_split(content, chr(10)) AS ls FROM chunks WHERE regexp_matches(content, '(?i)walnut')) SELECT CAST(id AS VARCHAR) AS id FROM l ORDER BY CAST(id AS VARCHAR) LIMIT 20""")
def first_matches(spark, d):
    notes = _T(spark, d, "chunks").select(F.col("id").cast("string").alias("path"), F.col("content").alias("text"))
    return jobs.search_in_path_order(notes, "walnut", 20).select("id")


_PARAGRAPHS = r"list_filter(string_split(regexp_replace(regexp_replace(text, '\n\n+', chr(1), 'g'), '\n([A-Z])', chr(1) || '\1', 'g'), chr(1)), lambda p: regexp_matches(p, '\S'))"


@query(
    "paragraph_windows",
    f"""WITH RECURSIVE t AS (SELECT doc_id, ps, list_transform(ps, lambda p: greatest(1, length(p) // 4)) AS ns FROM (SELECT doc_id, {_PARAGRAPHS} AS ps FROM documents) WHERE len(ps) > 0),
      w AS (SELECT doc_id, ps, ns, 0 AS k, 1 AS a, coalesce(list_max(list_filter(range(1, len(ns) + 1), lambda e: e = 1 OR list_sum(ns[1:e]) <= 500)), 1) AS e FROM t
        UNION ALL SELECT doc_id, ps, ns, k + 1, CASE WHEN ns[e] < 200 THEN e ELSE e + 1 END,
          list_max(list_filter(range(e + 1, len(ns) + 1), lambda x: x = e + 1 OR list_sum(ns[(CASE WHEN ns[e] < 200 THEN e ELSE e + 1 END):x]) <= 500)) FROM w WHERE e < len(ns))
      SELECT doc_id AS id, k AS pos, length(regexp_replace(array_to_string(ps[a:e], chr(10) || chr(10)), '^[\\s\\p{{Z}}\\x0B\\x{{85}}\\x1C-\\x1F]+|[\\s\\p{{Z}}\\x0B\\x{{85}}\\x1C-\\x1F]+$', '', 'g')) AS chars FROM w""",
)
def paragraph_windows(spark, d):
    rows = indexing.chunked(_T(spark, d, "documents"), "doc_id", "text", lambda t: [("", w) for w in indexing.paragraph_windows(t)])
    return rows.select("id", F.col("chunk_index").alias("pos"), F.length("content").cast("long").alias("chars"))


# --- text and notes ------------------------------------------------------------------------------------------------


@query("first_headings", "SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^#[ \\t]+(.+)$', 1)), ''), 'none') AS title FROM documents WHERE text IS NOT NULL")
def first_headings(spark, d):
    return _T(spark, d, "documents").where("text is not null").select("doc_id", text.first_heading(F.col("text"), F.lit("none")).alias("title"))


@query("file_dates", r"SELECT id, CASE WHEN regexp_matches(regexp_extract(path, '([^/]+)$', 1), '^\d{4}-\d{2}-\d{2}') AND try_cast(regexp_extract(path, '([^/]+)$', 1)[1:10] AS DATE) IS NOT NULL THEN regexp_extract(path, '([^/]+)$', 1)[1:10] WHEN regexp_matches(date, '^\d{4}-\d{2}-\d{2}') AND try_cast(date[1:10] AS DATE) IS NOT NULL THEN date[1:10] END AS day FROM files")
def file_dates(spark, d):
    return _T(spark, d, "files").select("id", text.document_date(F.col("path"), F.col("date")).alias("day"))


@query("journal_files", r"SELECT path, regexp_extract(path, '(\d{4}-\d{2}-\d{2})\.md$', 1) AS day FROM files WHERE regexp_matches(path, '(^|/)\d{4}-\d{2}-\d{2}\.md$')")
def journal_files(spark, d):
    return chat.day_files(_T(spark, d, "files"))


@query("safe_names", r"""SELECT id, coalesce(nullif(regexp_replace(regexp_replace(name, '[/:<>"\\|?*]', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), ''), 'untitled') AS name FROM producers""")
def safe_names(spark, d):
    return _T(spark, d, "producers").select("id", text.safe_name(F.col("name")).alias("name"))


@query("person_notes", r"SELECT id, 'People/' || CASE WHEN len(ws) > 1 THEN ws[-1] || ', ' || array_to_string(ws[1:len(ws) - 1], ' ') ELSE trim(name) END || '.md' AS path FROM (SELECT id, name, regexp_split_to_array(trim(name), '\s+') AS ws FROM people)")
def person_notes(spark, d):
    return _T(spark, d, "people").select("id", text.person_note_path(F.col("name")).alias("path"))


@query("photo_kinds", r"SELECT photo, CASE WHEN regexp_matches(lower(photo), '\.(jpg|jpeg|png|gif|webp|heic|heif|bmp|tiff|tif|svg)$') THEN 'image' WHEN regexp_matches(lower(photo), '\.(mp3|m4a|aac|ogg|opus|wav|flac|oga)$') THEN 'audio' WHEN regexp_matches(lower(photo), '\.(mp4|mov|webm|avi|mkv|m4v|3gp)$') THEN 'video' ELSE 'file' END AS kind, CASE WHEN starts_with(photo, '![[') THEN photo WHEN starts_with(photo, '[[') THEN '!' || photo ELSE '![[' || photo || ']]' END AS link, count(*) AS n FROM (SELECT unnest(photos) AS photo FROM messages) GROUP BY ALL")
def photo_kinds(spark, d):
    rows = _T(spark, d, "messages").select(F.explode("photos").alias("photo"))
    p = F.col("photo")
    return rows.groupBy("photo", text.attachment_kind(p).alias("kind"), people.embed_link(p).alias("link")).agg(F.count("*").alias("n"))


@query("minutes_of_day", r"SELECT id, try_cast(nullif(regexp_extract(timestamp, '^(\d{1,2}):(\d{2})', 1), '') AS INTEGER) * 60 + try_cast(nullif(regexp_extract(timestamp, '^(\d{1,2}):(\d{2})', 2), '') AS INTEGER) AS minute FROM messages")
def minutes_of_day(spark, d):
    return _T(spark, d, "messages").select("id", text.minute_of_day(F.col("timestamp")).alias("minute"))


@query("hour_labels", "SELECT DISTINCT hour(ts) AS h, CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS label, dayname(ts) AS day FROM events")
def hour_labels(spark, d):
    h = F.hour("ts")
    return _T(spark, d, "events").select(h.cast("long").alias("h"), text.hour_label((h * 100).cast("string")).alias("label"), F.date_format("ts", "EEEE").alias("day")).distinct()


@query("yaml_names", r"""SELECT id, CASE WHEN regexp_matches(name, '[:#\[\]{}&*!|>''"%@`,]|^[\s?-]|\s$') THEN '"' || replace(replace(name, '\', '\\'), '"', '\"') || '"' ELSE name END AS name FROM people""")
def yaml_names(spark, d):
    return _T(spark, d, "people").select("id", text.yaml_scalar(F.col("name")).alias("name"))


@query("conversion_states", "SELECT id, CASE WHEN indexed_at IS NULL THEN 'convert' WHEN indexed_at = modified_at THEN 'unchanged' ELSE 'stale' END AS state FROM files")
def conversion_states(spark, d):
    return _T(spark, d, "files").select("id", text.conversion_state(F.col("modified_at"), F.col("indexed_at")).alias("state"))


@query("sparse_files", "SELECT id, length(trim(content)) < 100 * greatest(page_num, 1) AS sparse FROM chunks WHERE page_num IS NOT NULL AND content IS NOT NULL AND NOT regexp_matches(content, '^\\s|\\s$')")
def sparse_files(spark, d):
    rows = _T(spark, d, "chunks").where("page_num is not null and content is not null").where(~F.col("content").rlike(r"^\s|\s$"))
    return rows.select("id", text.sparse_text(F.col("content"), F.col("page_num")).alias("sparse"))


@query("speaker_labels", "SELECT id, CASE WHEN lower(k) = 'me' THEN k WHEN agent IS NOT NULL AND agent <> 'main' THEN k || ' (' || agent || ')' ELSE k END AS label FROM (SELECT *, coalesce(nullif(trim(sender), ''), 'unknown') AS k FROM messages)")
def speaker_labels(spark, d):
    return _T(spark, d, "messages").select("id", text.speaker_label(F.col("sender"), F.col("agent"), "me").alias("label"))


@query("days_titled", "SELECT user_id, CASE WHEN n = date_diff('day', a, b) + 1 THEN CASE WHEN year(a) = year(b) THEN strftime(a, '%B %-d') ELSE strftime(a, '%B %-d, %Y') END || ' – ' || strftime(b, '%B %-d, %Y') ELSE n || ' days, ' || strftime(a, '%B %-d, %Y') || ' – ' || strftime(b, '%B %-d, %Y') END AS title, year(a) || '/pdf/' || CASE WHEN n = 1 THEN a::VARCHAR WHEN n = date_diff('day', a, b) + 1 THEN a || '_to_' || b ELSE a || '_plus_' || (n - 1) END || '.pdf' AS file FROM (SELECT user_id, min(ts::DATE) AS a, max(ts::DATE) AS b, count(DISTINCT ts::DATE) AS n FROM events GROUP BY user_id)")
def days_titled(spark, d):
    days = _T(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.to_date("ts"))).alias("days"))
    return days.select("user_id", text.days_title(F.col("days")).alias("title"), text.days_file(F.col("days")).alias("file"))


_TAGS = r"list_filter(list_transform(string_split(regexp_extract(text, '^---\n(?:.*\n)*?tags:[ \t]*\[(.*)\][ \t]*\n', 1), ','), lambda x: trim(x)), lambda x: x <> '')"


@query("tags_added", f"SELECT doc_id, array_to_string(CASE WHEN list_contains({_TAGS}, 'archived') THEN {_TAGS} ELSE list_append({_TAGS}, 'archived') END, ',') AS tags FROM documents WHERE regexp_matches(text, '^---\\n(?:.*\\n)*?---\\n') AND regexp_matches(text, '^---\\n(?:.*\\n)*?tags:[ \\t]*\\[')")
def tags_added(spark, d):
    t = F.col("text")
    rows = _T(spark, d, "documents").where(frontmatter.block(t).rlike(r"(?m)^tags:[ \t]*\["))
    return rows.select("doc_id", frontmatter.tags_csv(frontmatter.add_to_list(t, "tags", F.lit("archived"))).alias("tags"))


@query("tags_replaced", "SELECT doc_id, 'a,b c' AS tags FROM documents WHERE starts_with(text, '---' || chr(10)) AND regexp_matches(text, '^---\\n(?:.*\\n)*?---\\n')")
def tags_replaced(spark, d):
    t = F.col("text")
    rows = _T(spark, d, "documents").where(t.startswith("---\n") & frontmatter.block(t).isNotNull())
    return rows.select("doc_id", frontmatter.tags_csv(frontmatter.set_list(t, "tags", F.array(F.lit("a"), F.lit("b c")))).alias("tags"))


@query("opted_out", "SELECT doc_id, false AS out FROM documents WHERE starts_with(text, '---' || chr(10)) AND NOT regexp_matches(text, '\\nembed:')")
def opted_out(spark, d):
    t = F.col("text")
    return _T(spark, d, "documents").where(t.startswith("---\n") & ~t.rlike(r"\nembed:")).select("doc_id", frontmatter.opted_out(t).alias("out"))


# --- daily logs ----------------------------------------------------------------------------------------------------

_ITEM = r"'^- \[([ xX])\] (.+)$'"
_OPEN = f"(SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_ITEM})), lambda x: {{'done': lower(regexp_extract(x, {_ITEM}, 1)) = 'x', 'task': regexp_extract(x, {_ITEM}, 2)}}) AS items FROM documents WHERE regexp_matches(text, '(?m)^- \\[[ xX]\\] .'))"


def _lists(spark, d):
    return _T(spark, d, "documents").where(F.col("text").rlike(r"(?m)^- \[[ xX]\] .")).select("doc_id", daily.checklist_items(F.col("text")).alias("items")).where("size(items) > 0")


@query("lists_set", f"SELECT doc_id, '- [' || CASE WHEN list_filter(items, lambda i: i.task = items[1].task)[-1].done THEN 'x' ELSE ' ' END || '] ' || items[1].task || chr(10) || '- [ ] call the cooper' AS list FROM {_OPEN} WHERE len(items) > 0 AND NOT list_contains(list_transform(items, lambda i: i.task), 'call the cooper')")
def lists_set(spark, d):
    rows = _lists(spark, d).where(~F.exists("items", lambda i: i["task"] == "call the cooper"))
    return rows.select("doc_id", daily.rendered(daily.set_items(F.col("items"), F.array(F.col("items")[0]["task"], F.lit("call the cooper")))).alias("list"))


@query("lists_extended", f"SELECT doc_id, len(items) + CASE WHEN list_contains(list_transform(items, lambda i: i.task), 'call the cooper') THEN 0 ELSE 1 END AS n FROM {_OPEN} WHERE len(items) > 0")
def lists_extended(spark, d):
    return _lists(spark, d).select("doc_id", F.size(daily.add_items(F.col("items"), F.array(F.lit("call the cooper"), F.col("items")[0]["task"]))).cast("long").alias("n"))


@query("lists_shortened", f"SELECT doc_id, len(list_filter(items, lambda i: i.task <> items[1].task)) AS n FROM {_OPEN} WHERE len(items) > 0")
def lists_shortened(spark, d):
    return _lists(spark, d).select("doc_id", F.size(daily.remove_item(F.col("items"), F.col("items")[0]["task"])).cast("long").alias("n"))


@query("range_figures", "SELECT count(DISTINCT ts::DATE) AS days, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type <> 'purchase') AS open, round(count(*) FILTER (event_type = 'purchase') / nullif(count(*), 0), 3) AS rate FROM events WHERE ts::DATE BETWEEN '2024-01-05' AND '2024-01-20'")
def range_figures(spark, d):
    return daily.range_completion(_event_items(spark, d), "2024-01-20", "2024-01-05")


_ENTRY = r"'(?m)^## (\d{1,2}:\d{2} [A-Z]{2,4})[ \t]*\n'"


@query("journal_times", rf"SELECT doc_id AS id, unnest(range(len(ts))) AS pos, unnest(ts) AS time, unnest(list_transform(ts, lambda t: regexp_extract(t, '^(\d+)', 1)::INTEGER * 60 + regexp_extract(t, ':(\d+)', 1)::INTEGER)) AS minute FROM (SELECT doc_id, regexp_extract_all(text, {_ENTRY}, 1) AS ts FROM documents WHERE regexp_matches(text, {_ENTRY}))")
def journal_times(spark, d):
    return daily.journal_entries(_T(spark, d, "documents"), "doc_id", "text").select("id", F.col("pos").cast("long").alias("pos"), "time", "minute")


@query("entry_places", rf"SELECT doc_id AS id, coalesce(list_min(list_filter(range(len(ms)), lambda i: ms[i + 1] > 720)), len(ms)) AS place FROM (SELECT doc_id, list_transform(regexp_extract_all(text, {_ENTRY}, 1), lambda t: regexp_extract(t, '^(\d+)', 1)::INTEGER * 60 + regexp_extract(t, ':(\d+)', 1)::INTEGER) AS ms FROM documents WHERE regexp_matches(text, {_ENTRY}))")
def entry_places(spark, d):
    entries = daily.journal_entries(_T(spark, d, "documents"), "doc_id", "text")
    listed = entries.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "minute"))).alias("es"))
    return listed.select("id", daily.insertion_place(F.col("es"), F.lit(720)).cast("long").alias("place"))


@query("chat_headings", "SELECT id, coalesce(lag(timestamp) OVER (PARTITION BY chat ORDER BY id) = timestamp, false) AS same FROM messages WHERE timestamp IS NOT NULL")
def chat_headings(spark, d):
    rows = _T(spark, d, "messages").where("timestamp is not null").select(F.col("chat").alias("day"), F.col("id").alias("pos"), F.col("timestamp").alias("time"), "sender", "agent", F.lit("x").alias("text"))
    return chat.rendered(rows, "me").select(F.col("pos").alias("id"), (~F.col("line").startswith("## ")).alias("same"))


@query("session_starts", "SELECT user_id, ts FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS s FROM events) WHERE s")
def session_starts(spark, d):
    from ..streaming.windows import sessions

    found = sessions(_T(spark, d, "events"), "user_id", "ts")
    return found.select("user_id", F.col("start").alias("ts"))


@query("days_to_log", "SELECT DISTINCT ts::DATE AS day FROM events WHERE ts::DATE NOT IN (SELECT ts::DATE FROM events WHERE contains(event_type, 'error'))")
def days_to_log(spark, d):
    notes = _T(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("text"))
    return upkeep.to_log(notes.select("day").distinct(), notes, "day", "text", ("error",))


@query("task_records", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS content, CAST(o_custkey AS VARCHAR) AS project_id, 1 AS priority, strftime(o_orderdate, '%Y-%m-%d') AS due FROM orders")
def task_records(spark, d):
    o = _T(spark, d, "orders")
    record = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("content"), F.col("o_custkey").cast("string").alias("project_id"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("due"))
    return external.tasks(o.select(F.to_json(record).alias("json"))).select("id", "content", "project_id", "priority", "due")


@query("tasks_overdue", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') < '1995-03-05'")
def tasks_overdue(spark, d):
    rows = _T(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("due"))
    return external.due(rows, "1995-03-05", overdue=True).select("id")


QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE
