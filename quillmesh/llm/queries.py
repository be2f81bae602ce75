"""Queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.timestamps import ZoneRules, normalize_times
from ..session import table
from . import conversations, encoding, leakage, names, neighbors, pii, splitting, stuffing


def _timed_messages(spark, sf_dir):
    rules = ZoneRules.load(spark, table(spark, sf_dir, "home_zones"), table(spark, sf_dir, "zone_names"))
    rows = table(spark, sf_dir, "messages").select("id", "chat", "sender", "text", "photos", "timestamp", "date")
    return normalize_times(rows, "timestamp", rules, "date")


def _turns(spark, sf_dir):
    return conversations.rebuild_conversations(_timed_messages(spark, sf_dir), table(spark, sf_dir, "speakers"))


def p2_turns(spark, sf_dir):
    return conversations.with_texts(_turns(spark, sf_dir), table(spark, sf_dir, "messages"))


def p2_found(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", "message_id")


def p4_pieces(spark, sf_dir):
    return splitting.split_oversized(table(spark, sf_dir, "chunks"))


def p4_found(spark, sf_dir):
    return p4_pieces(spark, sf_dir).where("piece = 0 and n_pieces > 1").select("chunk_id")


def p4_cover(spark, sf_dir):
    """Of every oversized chunk: characters that its pieces cover in order, pieces over the limit, gaps, overlaps over the limit."""
    end = F.col("start") + F.length("content")
    before = F.lag(end).over(Window.partitionBy("chunk_id").orderBy("piece"))
    rows = p4_pieces(spark, sf_dir).where("n_pieces > 1").withColumn("_end", end).withColumn("_before", F.coalesce(before, F.lit(0)))
    return rows.groupBy("chunk_id").agg(
        F.max("_end").cast("long").alias("chars"), F.count_if(F.col("token_count") > 500).alias("oversized"), F.count_if(F.col("start") > F.col("_before")).alias("gaps"), F.count_if(F.col("_before") - F.col("start") > 200).alias("wide"),
    )


def _fields_and_model(spark, sf_dir):
    fields = pii.text_fields(lambda name: table(spark, sf_dir, name))
    return fields, pii.fit_model(fields, table(spark, sf_dir, "people"))


def p5_found(spark, sf_dir):
    return pii.find_personal(*_fields_and_model(spark, sf_dir))


def p5_redacted(spark, sf_dir):
    return pii.redact(*_fields_and_model(spark, sf_dir))


def p6_neighbors(spark, sf_dir):
    return neighbors.nearest(table(spark, sf_dir, "chunk_embeddings"), "chunk_id", "embedding")


def p6_found(spark, sf_dir):
    return neighbors.neighbor_pairs(p6_neighbors(spark, sf_dir))


def p7_found(spark, sf_dir):
    return names.linked_pairs(table(spark, sf_dir, "people"), table(spark, sf_dir, "producers"))


def p7_classes(spark, sf_dir):
    return names.entity_classes(table(spark, sf_dir, "people"), table(spark, sf_dir, "producers"))


def p8_ids(spark, sf_dir):
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p8_decoded(spark, sf_dir):
    return encoding.decode_corpus(p8_ids(spark, sf_dir))


def _leaks(spark, sf_dir):
    return leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark, sf_dir):
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_clean(spark, sf_dir):
    return leakage.clean_documents(table(spark, sf_dir, "documents"), _leaks(spark, sf_dir))


def p10_found(spark, sf_dir):
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_turns": p2_turns,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_cover": p4_cover,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p6_neighbors": p6_neighbors,
    "p7_found": p7_found,
    "p7_classes": p7_classes,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
    "p10_found": p10_found,
}
ORACLE: dict[str, str] = {
    "p4_cover": "SELECT id AS chunk_id, length(content) AS chars, 0::BIGINT AS oversized, 0::BIGINT AS gaps, 0::BIGINT AS wide FROM chunks WHERE greatest(1, length(content) // 4) > 500",
    "p6_found": """WITH v AS (SELECT chunk_id, embedding::DOUBLE[] AS e FROM chunk_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      p AS (SELECT a.chunk_id AS x, b.chunk_id AS y, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
      r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS place FROM p)
      SELECT DISTINCT least(x, y) AS chunk_id, greatest(x, y) AS neighbor_id FROM r WHERE place <= 5""",
    "p4_found": "SELECT id AS chunk_id FROM chunks WHERE greatest(1, length(content) // 4) > 500",
    "p9_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM eval_items),
      dg AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 8), lambda k: array_to_string(ws[k:k + 9], ' '))) AS gram FROM d WHERE len(ws) >= 10),
      ig AS (SELECT item_id, unnest(list_transform(range(1, len(ws) - 8), lambda k: array_to_string(ws[k:k + 9], ' '))) AS gram FROM i WHERE len(ws) >= 10)
      SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (gram)""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
