"""Evaluation passages inside training documents, by generalised suffix automata of the items.

Items are divided into blocks of bounded size. The corpus is read once, whatever their number: a filter of fixed size over all
runs of ``min_words`` item words, built on the executors, lets through the few documents that may hold a passage, and an exact
join of those documents' runs with the items' finds the blocks that each of them concerns. There the automaton of the block is
built over the normalised words, and the documents are streamed through it word by word; the longest match that ends at each word
is tracked, and where it reaches ``min_words`` the items that hold it are read off the state. Spans are cut out of the text, and
documents covered beyond the coverage limit are marked to be dropped.

The driver sees no item and no document, only the bits of the filter. A block that concerns many documents is shared by several
tasks of bounded size.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .automaton import TokenAutomaton

MIN_WORDS = 10
BLOCK_WORDS = 200_000
TASK_CHARS = 32_000_000  # of documents that are streamed through one automaton in one task
FILTER_BITS, FILTER_HASHES = 32, 5  # bits a run of item words and marks that it sets
MOST_FILTER_BITS = 2**29  # 64 MB; a fuller filter lets more documents through, but loses none
MOST_COVERAGE = 0.5

_WORD = re.compile(r"[^\W_]+")


class PassageAutomaton(TokenAutomaton):
    """Automaton over the words of items. A state with its suffix link stands for the passages between their lengths."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        super().__init__([[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items])
        # items of the states that can stand for min_words words: the first one in an array, further ones beside it
        self.first = array("q", [-1]) * len(self.length)
        self.further: dict[int, set[int]] = {}
        self.ids = [item for item, _ in items]
        for k, at in enumerate(self.ends):
            for state in at:
                self._hold(state, k)
        for state in sorted((s for s in range(1, len(self.length)) if self.length[self.link[s]] >= min_words), key=lambda s: -self.length[s]):
            for k in self._held(state):
                self._hold(self.link[state], k)

    def _held(self, state: int) -> list[int]:
        return [self.first[state], *self.further.get(state, ())] if self.first[state] >= 0 else []

    def _hold(self, state: int, k: int) -> None:
        if self.length[state] < self.min_words or self.first[state] == k:
            return
        if self.first[state] < 0:
            self.first[state] = k
        else:
            self.further.setdefault(state, set()).add(k)

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(position of the last word, length, state) wherever the longest match reaches ``min_words``."""
        get, move, link, length, least = self.vocabulary.get, self.move, self.link, self.length, self.min_words
        state = n = 0
        for k, w in enumerate(words):
            c = get(w)
            if c is None:
                state = n = 0
                continue
            while (to := move(state, c)) < 0 and state:
                state = link[state]
                n = length[state]
            if to < 0:
                n = 0
                continue
            state, n = to, n + 1
            if n >= least:
                yield k, n, state

    def items_at(self, state: int, n: int) -> Iterator[tuple[int, int]]:
        """(item, words it shares with the match of length ``n`` at ``state``), longest first, each item once."""
        seen: set[int] = set()
        while state and min(n, self.length[state]) >= self.min_words:
            for k in self._held(state):
                if (item := self.ids[k]) not in seen:
                    seen.add(item)
                    yield item, min(n, self.length[state])
            state = self.link[state]


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class _RunHashes:
    """64-bit hashes of all runs of ``min_words`` words of a text."""

    MOST_WORDS = 500_000  # kept with their hashes, then forgotten and hashed again

    def __init__(self, min_words: int):
        self.factors = np.array([pow(0x9E3779B97F4A7C15, j + 1, 2**64) | 1 for j in range(min_words)], dtype=np.uint64)
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(words) < len(self.factors):
            return np.empty(0, np.int64)
        if len(self.known) > self.MOST_WORDS:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        n = len(words) - len(self.factors) + 1
        out = np.zeros(n, np.uint64)
        for j, f in enumerate(self.factors):
            out += h[j : j + n] * f
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return (out ^ (out >> np.uint64(32))).view(np.int64)


def _slot(runs: np.ndarray, bits: int, j: int) -> np.ndarray:
    """Position of the j-th mark of each run in a filter of ``bits`` bits (a power of two)."""
    low, high = runs.view(np.uint64) & np.uint64(0xFFFFFFFF), runs.view(np.uint64) >> np.uint64(32)
    return ((low + np.uint64(j) * (high | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def _item_runs(items: DataFrame, min_words: int, blocks: int) -> DataFrame:
    """(run, block): hashes of the runs of item words and the block of their item, each once."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _RunHashes(min_words)
        for batch in batches:
            found = [(block, np.unique(hasher.of(_words(text)))) for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            runs = np.concatenate([r for _, r in found]) if found else np.empty(0, np.int64)
            whose = np.repeat([b for b, _ in found], [len(r) for _, r in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(whose, pa.int64())], names=["run", "block"])

    placed = items.select(_block_of(blocks).alias("block"), "text")
    return placed.mapInArrow(hashes, "run long, block long").distinct()


def _block_of(blocks: int):
    return F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("long")


def _filter(runs: DataFrame) -> tuple[np.ndarray, int]:
    """The marks of all runs, as bytes, and their number; only the bitmap comes to the driver."""
    n = runs.count()
    bits = min(MOST_FILTER_BITS, 2 ** max(15, math.ceil(math.log2(max(1, n) * FILTER_BITS))))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique([_slot(batch.column(0).to_numpy(), bits, j) for j in range(FILTER_HASHES)]), pa.int64())], names=["slot"])

    marked = runs.select("run").mapInArrow(slots, "slot long").groupBy(F.shiftright("slot", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("marks"))
    out = np.zeros(bits // 8, np.uint8)
    for r in marked.collect():
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = np.frombuffer(bytes(r["marks"]), np.uint8)[:4096]
    return out, bits


def _spans(automaton: PassageAutomaton, doc: int, text: str) -> list[tuple[int, int, int, int, int]]:
    rows: list[tuple[int, int, int, int, int]] = []
    open_spans: dict[int, list[int]] = {}
    for k, n, state in automaton.matches(_words(text)):
        for item, m in automaton.items_at(state, n):
            span = open_spans.get(item)
            if span and k - m + 1 <= span[1] + 1:
                span[0], span[1], span[2] = min(span[0], k - m + 1), k, max(span[2], m)
            else:
                if span:
                    rows.append((doc, item, *span))
                open_spans[item] = [k - m + 1, k, m]
    rows += [(doc, item, *span) for item, span in open_spans.items()]
    if not rows:
        return rows
    place = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    return [(d, i, place[a][0], place[b][1], m) for d, i, a, b, m in rows]


def leaked_spans(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, start, end, words): longest stretches of a document that an item shares, in characters.

    Stretches of one item that overlap are one row, ``words`` being the longest run in it. Null and blank texts and items
    shorter than ``min_words`` give no row.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, start int, end int, words int"
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0)))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_words))
    runs = cut_lineage(_item_runs(items, min_words, blocks))
    marks, bits = _filter(runs)
    shared = spark.sparkContext.broadcast(marks)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = _RunHashes(min_words), shared.value
        for batch in batches:
            kept, hits = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = np.unique(hasher.of(_words(text)))
                for j in range(FILTER_HASHES):
                    if not len(found):
                        break
                    slot = _slot(found, bits, j)
                    found = found[(known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                if len(found):
                    kept.append(k), hits.append(found)
            at = pa.array(np.cumsum([0, *map(len, hits)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(hits) if hits else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), batch.column(1).take(pa.array(kept, pa.int32())), lists], names=["doc_id", "text", "runs"])

    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    maybe = cut_lineage(texts.mapInArrow(sift, "doc_id long, text string, runs array<long>"))
    concerned = maybe.select("doc_id", F.explode("runs").alias("run")).join(runs, "run").select("doc_id", "block").distinct()
    routed = cut_lineage(maybe.select("doc_id", "text").join(concerned, "doc_id"))
    shares = routed.groupBy("block").agg(F.ceil(F.sum(F.length("text")) / TASK_CHARS).cast("long").alias("shares"))
    routed = routed.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares"))).select("block", "share", "doc_id", "text")
    one = F.lit(0).cast("long")
    placed = items.withColumn("block", _block_of(blocks)).join(shares, "block").withColumn("share", F.explode(F.sequence(one, F.col("shares") - 1))).select("block", "share", "item_id", "text")

    def scan(docs: pa.Table, held: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, int, int]] = []
        words = [(item, w) for item, text in zip(held.column("item_id").to_pylist(), held.column("text").to_pylist()) if len(w := _words(text)) >= min_words]
        if words and docs.num_rows:
            automaton = PassageAutomaton(words, min_words)
            for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
                rows += _spans(automaton, doc, text)
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "start", "end", "words"])

    return routed.groupBy("block", "share").cogroup(placed.groupBy("block", "share")).applyInArrow(scan, schema)


def clean_documents(documents: DataFrame, spans: DataFrame, most_coverage: float = MOST_COVERAGE) -> DataFrame:
    """(doc_id, n_spans, covered, drop, text): leaked spans cut out; ``drop`` if they cover more than ``most_coverage``."""
    merged = F.expr(
        """aggregate(array_sort(collect_list(struct(start, end))), cast(array() as array<struct<start:int,end:int>>),
           (done, s) -> if(size(done) > 0 and element_at(done, -1).end >= s.start,
             concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start, greatest(element_at(done, -1).end, s.end) as end))),
             concat(done, array(s))))"""
    )
    found = spans.groupBy("doc_id").agg(merged.alias("spans"))
    out = documents.select("doc_id", "text").join(found, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")))
    covered = F.expr("aggregate(spans, 0, (n, s) -> n + s.end - s.start)")
    kept = F.expr(
        """if(size(spans) = 0, text, concat_ws('', transform(sequence(0, size(spans)), k ->
           substring(text, if(k = 0, 1, get(spans, k - 1).end + 1),
             coalesce(get(spans, k).start, length(text)) - if(k = 0, 0, get(spans, k - 1).end)))))"""
    )
    return out.select("doc_id", F.size("spans").alias("n_spans"), covered.alias("covered"), F.coalesce(covered > most_coverage * F.length("text"), F.lit(False)).alias("drop"), kept.alias("text"))
