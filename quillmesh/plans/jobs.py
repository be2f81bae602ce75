"""Whole jobs made of the operators: indexing runs, rollover, migration dry runs, reports, notifications.
[AGG08, AGG13, SRT04, SRT10-12, SRT15-16, SET04, SNK05, SNK07, SNK10, SNK12, STR06-07, STR10-11]"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import numbered
from ..operators import daily, indexing
from ..operators.search import regex_excerpts
from ..session import cut_lineage
from ..sources.files import Snapshots


def corpus_order(files: DataFrame) -> DataFrame:
    """Files that aren't PDFs first, then by path. [SRT10]"""
    return files.orderBy(F.col("ext") == "pdf", "path")


def unseen(index: DataFrame, scan: DataFrame) -> DataFrame:
    """Index rows whose path the scan doesn't have. [SET04]"""
    return index.join(scan.select("path"), "path", "left_anti")


def index_run(store: Snapshots, scan: DataFrame, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], whole: bool = True) -> DataFrame:
    """One incremental run: diff against the snapshot, chunk and embed only new and updated files, commit atomically.
    Returns the histogram of statuses. ``texts`` has (path, text); ``embed`` adds ``embedding`` to chunks. [STR06-07, AGG07]

    Metadata stays null and is filled by a later job over the same snapshot, which can be resumed.
    """
    spark = scan.sparkSession
    base = store.version()
    first = base == 0
    files = spark.createDataFrame([], "id long, path string, content_hash string") if first else store.read("files")
    chunks = None if first else store.read("chunks")
    diff = cut_lineage(indexing.scan_diff(files, scan, whole))  # used several times; the scan hashes files once
    kept_files, kept_chunks = indexing.apply_diff(files, diff, chunks if chunks is not None else files.select(F.col("id").alias("file_id")).limit(0))
    fresh = diff.where("status = 'new'").select("path", "content_hash")
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    with_ids = numbered(fresh, "_n", "path").join(top, F.lit(True)).select((F.col("_top") + F.col("_n")).alias("id"), "path", "content_hash")
    all_files = kept_files.select("id", "path", "content_hash").unionAll(with_ids)
    changed = diff.where("status in ('new', 'updated')").select("path").join(all_files, "path").join(texts, "path")
    made = indexing.chunked(changed, "id", "text").withColumnRenamed("id", "file_id").withColumn("metadata", F.lit(None).cast("string"))
    made = embed(made)
    new_chunks = made if chunks is None else kept_chunks.unionByName(made)
    counts = diff.groupBy("status").agg(F.count("*").alias("n"))
    rows = counts.collect()
    if set(r["status"] for r in rows) - {"unchanged"} or first:
        store.commit(base, files=all_files, chunks=new_chunks)
    return spark.createDataFrame(rows, counts.schema)


def enrich_run(store: Snapshots, describe: Callable[[list[str]], list[str | None]], most: int | None = None) -> int:
    """Fill missing metadata of the snapshot, of the first ``most`` chunks where given (the feature's own limit); returns what is
    still missing. [STR07, SRT16, DML18]"""
    chunks = store.read("chunks")
    pending = chunks.where("metadata is null")
    if most is not None:
        chosen = pending.orderBy("file_id", "chunk_index").limit(most)
        rest = pending.join(chosen.select("file_id", "chunk_index"), ["file_id", "chunk_index"], "left_anti")
        chunks = chunks.where("metadata is not null").unionByName(chosen)
    else:
        rest = pending.limit(0)
    store.commit(chunks=indexing.enriched(chunks, describe).unionByName(rest))
    return store.read("chunks").where("metadata is null").count()


def rollover_job(items: DataFrame, today: str) -> DataFrame:
    """Items to append to a day; none where the day has no list of its own. [STR10, DML20]"""
    return daily.rollover(items).where(F.col("day") == F.lit(today).cast("date"))


def status_counts(rows: DataFrame) -> DataFrame:
    """[AGG08, AGG13]"""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def dry_run(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Row counts that a migration would write. [SNK12]"""
    return {name: df.count() for name, df in tables.items()}


def search_in_path_order(notes: DataFrame, pattern: str, most: int) -> DataFrame:
    """(id, excerpt) of the first notes in path order that match. [SRT11, RET07]"""
    return regex_excerpts(notes, "path", "text", pattern).orderBy("id").limit(most)


def calendar_lines(moves: DataFrame) -> DataFrame:
    """Cross-reference lines by day, rows without a day first. [SRT12]"""
    day = F.coalesce("day", F.lit(0))
    return moves.orderBy(day, "item").select(F.concat(F.lit("- Day "), day.cast("string"), F.lit(": "), F.col("item")).alias("line"))


def digest(mails: DataFrame, most: int = 5) -> DataFrame:
    """The newest mails with ``more`` = how many are left out. [SRT15]"""
    total = mails.agg(F.count("*").alias("_n"))
    return mails.join(total, F.lit(True)).withColumn("more", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n").orderBy(F.desc("at"), "id").limit(most)


def day_pages(entries: DataFrame) -> DataFrame:
    """(id, html): a simple page of each day's entries in order, for a renderer. [SNK05, SCA51]"""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = F.concat(F.lit("<h2>"), safe(F.col("time")), F.lit("</h2><p>"), safe(F.col("text")), F.lit("</p>"))
    grouped = entries.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("ps"))
    return grouped.select("id", F.array_join(F.transform("ps", lambda p: p["part"]), "\n").alias("html"))


def notify(stream: DataFrame, send: Callable[[list[dict]], None], checkpoint: str) -> StreamingQuery:
    """Start a query that hands every batch's rows to ``send``; batches are small by the source's limits. [SNK10]"""

    def deliver(batch: DataFrame, _: int) -> None:
        send([r.asDict() for r in batch.toLocalIterator()])

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict:
    """Rows read in the last batch and whether the query runs. [STR11, SNK08]"""
    last = query.lastProgress
    return {"active": query.isActive, "batch": last.batchId if last else None, "rows": last.numInputRows if last else 0}
