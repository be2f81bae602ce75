"""The k most similar vectors of every vector, by multi-index hashing.

Vectors become binary codes by rotations learned on a bounded sample (principal axes, then iterative quantisation). A code is
split into substrings, and each of them is an index: rows with equal substrings share a bucket. By the pigeonhole principle every
two codes that differ in fewer bits than there are substrings meet in some bucket. Every row is a query and a candidate alike, so
a bucket's rows are ranked against each other there by their float vectors, last of all in 64 bit, and the best of all buckets of
a row are put together.

The number of bits of a substring follows the logarithm of the number of rows, so that a bucket keeps about ``BUCKET_ROWS`` rows at
every size, and the number of substrings grows with their bits. A row is shuffled once a substring: data moved and work done
grow with the rows (times that logarithm), not with their square. Buckets that are much larger than that are split into blocks,
and each pair of blocks is a task of its own, so nothing in them is lost. Exact copies are one row of the index. Nothing is
broadcast but the rotations.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DIMENSIONS = 64
SAMPLE_ROWS = 20_000
BUCKET_ROWS = 2_048
SUBSTRINGS_PER_BIT = 2.4  # 12 substrings of 5 bits at 60,000 rows
MOST_BITS = 24
SPLIT_ROWS, BLOCK_ROWS = 12_288, 6_144  # larger buckets are split, into blocks of about this size
SHORTLIST = 16
ROUNDING = 1e-5  # two 32-bit cosines of 64 dimensions that lie further apart are in the right order
PRODUCT_CELLS = 4_194_304  # of a block of cosines


def valid_vectors(vectors: DataFrame, id_column: str, vector_column: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, vector): rows whose vector has ``dimensions`` finite values that are not all zero."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.where(good & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), v.cast("array<float>").alias("vector"))


def code_layout(n: int, dimensions: int = DIMENSIONS) -> tuple[int, int, int]:
    """(bits of a substring, substrings, rotations needed) for ``n`` rows."""
    bits = min(MOST_BITS, dimensions, max(0, math.ceil(math.log2(max(1, n) / BUCKET_ROWS))))
    if not bits:
        return 0, 1, 0
    substrings = math.ceil(SUBSTRINGS_PER_BIT * bits)
    return bits, substrings, math.ceil(substrings / (dimensions // bits))


def learn_rotations(sample: np.ndarray, tables: int, rounds: int = 30) -> tuple[np.ndarray, list[np.ndarray]]:
    """(mean, rotations): projections whose signs lose least of the sample."""
    mean, dimensions = sample.mean(axis=0), sample.shape[1]
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred / max(1, len(sample)) + 1e-9 * np.eye(dimensions))
    axes = axes[:, ::-1]
    projected, out = centred @ axes, []
    for t in range(tables):
        turn = np.linalg.qr(np.random.default_rng(t).standard_normal((dimensions, dimensions)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(projected.T @ np.where(projected @ turn > 0, 1.0, -1.0))
            turn = left @ right
        out.append(axes @ turn)
    return mean, out


def substring_keys(unit: np.ndarray, mean: np.ndarray, rotations: list[np.ndarray], bits: int, substrings: int) -> np.ndarray:
    """(rows, substrings): number of the bucket of each substring; buckets of different substrings have different numbers."""
    if not bits:
        return np.zeros((len(unit), 1), np.int64)
    each = unit.shape[1] // bits  # substrings of a rotation
    out = []
    for s in range(substrings):
        axes = rotations[s // each][:, (s % each) * bits : (s % each + 1) * bits]
        out.append((((unit - mean) @ axes) > 0) @ (1 << np.arange(bits, dtype=np.int64)) + (s << bits))
    return np.stack(out, axis=1)


def _crowded(score: np.ndarray, k: int) -> np.ndarray:
    """Rows of a full shortlist whose last score can't be told from that of the ``k`` best other rows."""
    kth = np.partition(score, SHORTLIST - k - 1, axis=1)[:, SHORTLIST - k - 1]
    last = score.min(axis=1)
    return np.flatnonzero((last > -2) & (last >= kth - np.float32(ROUNDING)))


def _best_exact(exact: np.ndarray) -> np.ndarray:
    """Columns of the SHORTLIST largest values of each row, of equal ones the first."""
    cut = -np.partition(-exact, SHORTLIST - 1, axis=1)[:, SHORTLIST - 1 : SHORTLIST]
    above, level = exact > cut, exact == cut
    chosen = above | (level & (np.cumsum(level, axis=1) <= SHORTLIST - above.sum(axis=1, keepdims=True)))
    return np.nonzero(chosen)[1].reshape(-1, SHORTLIST)


def best_in_bucket(queries: np.ndarray, query_ids: np.ndarray, index: np.ndarray, index_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the up to ``k`` best other rows of ``index`` for each query, best first, equal ones by smaller id; id -1
    where there are fewer. Cosines are 64-bit, rounded to 9 decimals."""
    by_id = np.argsort(index_ids, kind="stable")  # so that of equal rows the first has the smallest id
    index, index_ids = index[by_id], index_ids[by_id]
    norm = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    q64, x64 = norm(queries.astype(np.float64)), norm(index.astype(np.float64))
    q32, x32 = q64.astype(np.float32), x64.astype(np.float32)
    n, short = len(q32), min(SHORTLIST, len(x32))
    best, score = np.empty((n, short), np.int64), np.empty((n, short), np.float32)
    step = max(1, PRODUCT_CELLS // len(x32))
    for a in range(0, n, step):
        near = q32[a : a + step] @ x32.T
        top = np.argpartition(near, len(x32) - short, axis=1)[:, len(x32) - short :]
        best[a : a + step], score[a : a + step] = top, np.take_along_axis(near, top, 1)
    if len(x32) > SHORTLIST:
        crowded = _crowded(score, k)
        for a in range(0, len(crowded), step):
            who = crowded[a : a + step]
            best[who] = _best_exact(np.round(q64[who] @ x64.T, 9))
    ids = index_ids[best]
    exact = np.stack([np.einsum("ij,ij->i", q64, x64[best[:, c]]) for c in range(short)], axis=1)
    exact = np.where(ids == query_ids[:, None], -3.0, np.round(exact, 9))
    place = np.lexsort((ids, -exact), axis=1)[:, :k]
    ids, exact = np.take_along_axis(ids, place, 1), np.take_along_axis(exact, place, 1)
    return np.where(exact > -3, ids, -1), exact


def _matrix(t: pa.Table, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    vectors = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return vectors, t.column("uid").to_numpy()


def nearest(vectors: DataFrame, id_column: str, vector_column: str, k: int = 5, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, neighbor_id, cosine): for every valid vector the ``k`` most similar other rows found, rounded to 9 decimals.

    Ties go to the smaller id. Invalid vectors (null, other lengths, not finite, all zero) have no rows; copies of one
    vector are neighbours of each other with cosine 1. The search is approximate; see the module's docstring. ``k`` is at most
    ``SHORTLIST`` - 1.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(valid_vectors(vectors, id_column, vector_column, dimensions))
    # copies: one row of the index, known by its smallest id, with the k + 1 smallest ids
    place = Window.partitionBy("vector").orderBy("id")
    first_ids = rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1)
    unique = cut_lineage(first_ids.groupBy("vector").agg(F.min("id").alias("uid"), F.array_sort(F.collect_list("id")).alias("copies")))
    n = unique.count()
    if not n:
        return spark.createDataFrame([], "id long, neighbor_id long, cosine double")
    bits, substrings, tables = code_layout(n, dimensions)
    mean, rotations = None, []
    if tables:
        sample = unique.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE_ROWS).select("vector").toArrow()
        unit = sample.column(0).combine_chunks().flatten().to_numpy().reshape(-1, dimensions).astype(np.float64)
        mean, rotations = learn_rotations(unit / np.linalg.norm(unit, axis=1, keepdims=True), tables)

    def keyed(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float64)
            found = substring_keys(x / np.linalg.norm(x, axis=1, keepdims=True), mean, rotations, bits, substrings)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], names=["uid", "vector", "keys"])

    coded = cut_lineage(unique.select("uid", "vector").mapInArrow(keyed, "uid long, vector array<float>, keys array<long>"))
    hot = cut_lineage(coded.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_ROWS))
    members = coded.select("uid", "vector", F.explode("keys").alias("key"))
    one = F.lit(0).cast("long")
    if hot.isEmpty():
        members = members.select("uid", "vector", "key", one.alias("low"), one.alias("high"), one.alias("block"))
    else:
        members = members.join(hot, "key", "left").withColumn("_g", F.coalesce(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1)).cast("long"))
        members = members.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("_g"))).withColumn("_other", F.explode(F.sequence(one, F.col("_g") - 1)))
        members = members.select("uid", "vector", "key", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block")

    def task(key: tuple, t: pa.Table) -> pa.Table:
        x, ids = _matrix(t, dimensions)
        blocks = t.column("block").to_numpy()
        low, high = key[1].as_py(), key[2].as_py()
        sides = [(blocks == low, blocks == low)] if low == high else [(blocks == low, blocks == high), (blocks == high, blocks == low)]
        parts = []
        for who, whom in sides:
            if who.any() and whom.any():
                found, cosines = best_in_bucket(x[who], ids[who], x[whom], ids[whom], k)
                there = found >= 0
                parts.append((np.repeat(ids[who], there.sum(axis=1)), found[there], cosines[there]))
        uid, near, cosine = (np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"uid": pa.array(uid, pa.int64()), "near": pa.array(near, pa.int64()), "cosine": pa.array(cosine, pa.float64())})

    found = members.groupBy("key", "low", "high").applyInArrow(task, "uid long, near long, cosine double")
    per_query = found.groupBy("uid").agg(F.collect_set(F.struct((-F.col("cosine")).alias("far"), F.col("near").alias("id"))).alias("found"))
    per_query = per_query.select("uid", F.explode(F.slice(F.array_sort("found"), 1, k)).alias("hit"))
    # put the copies of each found vector in, then each row's own copies
    spread = per_query.join(unique.select(F.col("uid").alias("_uid"), "copies"), F.col("hit.id") == F.col("_uid"))
    spread = spread.select("uid", F.col("hit.far").alias("far"), F.explode("copies").alias("id"))
    own = unique.select("uid", F.lit(-1.0).alias("far"), F.explode("copies").alias("id"))
    lists = spread.unionAll(own).groupBy("uid").agg(F.collect_list(F.struct("far", "id")).alias("hits"))
    lists = lists.select("uid", F.slice(F.array_sort("hits"), 1, k + 1).alias("hits"))
    members = rows.select("id", "vector").join(unique.select("uid", "vector"), "vector").select("id", "uid")
    hits = F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k)
    out = members.join(lists, "uid").select("id", F.explode(hits).alias("hit"))
    return out.select("id", F.col("hit.id").alias("neighbor_id"), (-F.col("hit.far")).alias("cosine"))


def neighbor_pairs(near: DataFrame) -> DataFrame:
    """(chunk_id, neighbor_id): each pair of ``nearest`` once, smaller id first."""
    return near.select(F.least("id", "neighbor_id").alias("chunk_id"), F.greatest("id", "neighbor_id").alias("neighbor_id")).distinct()
