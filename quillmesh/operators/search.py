"""Hybrid search: exact vector neighbours, BM25 keywords, reciprocal rank fusion, filters; regex search. [RET01-10]"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
FUSION = 60


def distance(vector: Column, query: Sequence[float]) -> Column:
    """Euclidean distance in 64 bit."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def nearest_rows(vectors: DataFrame, id_column: str, vector_column: str, query: Sequence[float], n: int) -> DataFrame:
    """(id, distance, rank) of the n nearest rows; vectors of another length, null or not finite are left out. [RET01, SRT01, WIN01]"""
    v = F.col(vector_column)
    good = F.coalesce((F.size(v) == len(query)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    top = vectors.where(good).select(F.col(id_column).alias("id"), distance(v, query).alias("distance")).orderBy("distance", "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, as an array. [tokenizer of RET02]"""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def parse_query(text: str) -> list[list[str]] | None:
    """Phrases of a query (single words are phrases of one); None where the syntax is malformed. [RET02]

    Words are joined by AND; double quotes enclose phrases. A query with an unbalanced quote, a bare AND, OR or NOT at an end,
    or signs outside of words is malformed, and its keyword leg is empty.
    """
    if text.count('"') % 2 or not text.strip():
        return None
    parts = [p for k, piece in enumerate(text.split('"')) for p in ([piece] if k % 2 else piece.split())]
    words = [re.findall(r"\w+", p.lower()) for p in parts if p not in ("AND",)]
    bare = [p for k, piece in enumerate(text.split('"')) if k % 2 == 0 for p in piece.split()]
    if any(not re.fullmatch(r"\w+", p) for p in bare) or (bare and bare[-1] in ("AND", "OR", "NOT")):
        return None
    return [w for w in words if w]


def bm25(texts: DataFrame, id_column: str, columns: Sequence[str], query: str, n: int) -> DataFrame:
    """(id, score, rank) of the n best rows that hold all words (and phrases) of the query. [RET02-03, SRT02, WIN02]

    Statistics are over all rows. idf = ln((N - df + 0.5) / (df + 0.5)), at least 1e-6.
    """
    phrases = parse_query(query)
    joined = F.concat_ws("\n", *[F.col(c) for c in columns])
    # one pass: only the counts of the query's phrases leave the text
    rows = texts.select(F.col(id_column).alias("id"), F.size(terms(joined)).alias("length"), *[terms(F.coalesce(c, F.lit(""))).alias(f"ts_{c}") for c in columns])
    if not phrases:
        return rows.select("id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    phrases = [list(p) for p in dict.fromkeys(map(tuple, phrases))]

    def hits(column: str, phrase: list[str]) -> Column:
        ts = F.col(column)
        if len(phrase) == 1:
            return F.size(F.filter(ts, lambda t: t == phrase[0]))
        places = F.sequence(F.lit(1), F.greatest(F.size(ts) - len(phrase) + 1, F.lit(1)))
        whole = F.array(*[F.lit(w) for w in phrase])
        return F.size(F.filter(places, lambda k: F.slice(ts, k, F.lit(len(phrase))) == whole))

    counts = [reduce(Column.__add__, [hits(f"ts_{c}", p) for c in columns]).alias(f"tf{k}") for k, p in enumerate(phrases)]
    counted = rows.select("id", "length", *counts)
    there = reduce(Column.__and__, [F.col(f"tf{k}") > 0 for k in range(len(phrases))])
    stats = counted.agg(F.count("*").alias("N"), F.avg("length").alias("avg"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(phrases))]).first()
    score = F.lit(0.0)
    for k in range(len(phrases)):
        df = stats[f"df{k}"]
        idf = max(1e-6, math.log((stats["N"] - df + 0.5) / (df + 0.5)))
        tf = F.col(f"tf{k}")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(stats["avg"] or 1.0))))
    top = counted.where(there).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(vector_leg: DataFrame, keyword_leg: DataFrame, n: int) -> DataFrame:
    """(id, score): reciprocal rank fusion of two ranked legs, best n; ties: vector rank, then keyword rank. [RET04, JOI13, AGG18, SRT03]"""
    v = vector_leg.select("id", F.col("rank").alias("v"))
    k = keyword_leg.select("id", F.col("rank").alias("k"))
    both = v.join(k, "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (FUSION + F.col(c)), F.lit(0.0))
    return both.select("id", (part("v") + part("k")).alias("score"), "v", "k").orderBy(F.desc("score"), F.asc_nulls_last("v"), F.asc_nulls_last("k")).limit(n)


def hybrid(vector_leg: DataFrame, keyword_leg: DataFrame, rows: DataFrame, limit: int, condition: Column | None = None) -> DataFrame:
    """Fused candidates (2 x limit), joined with their ``rows`` (id, ...), filtered, best ``limit``. [RET05, FLT14, JOI12]

    The filter comes after the cut, so fewer than ``limit`` rows may be left although more would match; put the condition on
    the legs' inputs instead for better recall.
    """
    hits = fuse(vector_leg, keyword_leg, 2 * limit)
    full = hits.join(rows, "id")
    if condition is not None:
        full = full.where(condition)
    return full.orderBy(F.desc("score"), F.asc_nulls_last("v"), F.asc_nulls_last("k")).limit(limit)


def recent_condition(date_column: str, today: str, days: int) -> Column:
    """Journal rows of the last days; rows without a date never match. [RET06]"""
    return (F.col("section") == "journal") & (F.col(date_column) >= F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd"))


def index_status(chunks: DataFrame, files: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts: files, chunks, vectors, chunks without metadata, last index time. [RET10, AGG02]"""
    f = files.agg(F.count("*").alias("n_files"), F.max("indexed_at").alias("last_indexed"))
    c = chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("metadata").isNull()).alias("pending"))
    v = vectors.agg(F.count("*").alias("n_vectors"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(f).join(one(c), "_k").join(one(v), "_k").drop("_k")


def group_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) [AGG01]"""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def regex_excerpts(texts: DataFrame, id_column: str, text_column: str, pattern: str, context: int = 2, most: int = 2) -> DataFrame:
    """(id, excerpt): lines around the first ``most`` matching lines of each text; an invalid pattern is taken literally.
    Windows are cut at the ends of the text and not merged. [RET07, WIN08, FLT17]"""
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    insensitive = "(?i)" + pattern
    lines = F.split(F.col(text_column), "\n")
    rows = texts.where(F.col(text_column).rlike(insensitive)).select(F.col(id_column).alias("id"), lines.alias("ls"))
    hits = F.slice(F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(insensitive), i)), lambda i: i.isNotNull()), 1, most)
    rows = rows.select("id", "ls", hits.alias("hits")).where("size(hits) > 0")
    around = F.transform("hits", lambda i: F.array_join(F.slice(F.col("ls"), F.greatest(i - context, F.lit(0)) + 1, i + context + 1 - F.greatest(i - context, F.lit(0))), "\n"))
    return rows.select("id", F.array_join(around, "\n…\n").alias("excerpt"))


def substring_like(column: Column, query: str) -> Column:
    """ASCII case-insensitive substring match in which % and _ of the query are wildcards. [FLT01-03]"""
    from ..functions.columns import ascii_lower

    lowered = "".join(c.lower() if c.isascii() else c for c in query)
    return ascii_lower(column).like("%" + lowered.replace("\\", "\\\\") + "%")
