"""Encoding of a corpus with a public byte-level tokenizer, each distinct word once.

Pre-tokens are exploded with their positions, per document and word. Every distinct pre-token of the corpus is encoded once
(a global shuffle of words with partial aggregation), its ids are joined back, and the documents are put together by
position. Words that make up at least one part in ``FREQUENT_SHARE`` of all (document, word) rows number at most
``FREQUENT_SHARE``; this bounded dictionary is broadcast, so hot words never meet in one task; only the rest is joined.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

TOKENIZER = os.environ.get("QUILLMESH_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
FREQUENT_SHARE = 16_384

# Scripts on which the pattern below and the byte-level splitter agree for every code point; texts with other characters, and
# all texts of tokenizers with another splitter, go through the tokenizer's own.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER = r"[^\u0000-ԯ֐-߿ -₀₠-₰℀-⏿─-⟿　-ヿ一-龥가-힣＀-ﾟ]"
_PROBE = "It's don't we'LL a1_b  12 3456 3.5\n\n x\t\tÜnder, (été)…  日本語の 가나! --\r\n end  "


class _Splitter:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pattern, self.other = regex.compile(_PATTERN), regex.compile(_OTHER)
        if self.tokenizer.pre_tokenizer is None or self.tokenizer.normalizer is not None:
            raise ValueError("only tokenizers that split words and leave the text as it is can encode word by word")
        self.fast = self._split(_PROBE) == self.pattern.findall(_PROBE)  # another tokenizer has other words

    def _split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        return self.pattern.findall(text) if self.fast and not self.other.search(text) else self._split(text)


def word_dictionary(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(word, n_docs, ids): every distinct pre-token of ``text``, with the ids it encodes to."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _Splitter(path)
        for batch in batches:
            counts: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for w in set(splitter.words(text)):
                    counts[w] = counts.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n_docs"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _Splitter(path).tokenizer
        for batch in batches:
            found = tokenizer.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            ids = pa.array([e.ids for e in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["word", "n_docs", "ids"])

    words = documents.where("text <> ''").select("text").mapInArrow(distinct, "word string, n_docs long")
    words = words.groupBy("word").agg(F.sum("n_docs").alias("n_docs"))
    return words.mapInArrow(encode, "word string, n_docs long, ids array<int>")


def encode_corpus(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) of every document; null and empty texts have an empty list. Special tokens are ordinary text."""
    dictionary = cut_lineage(word_dictionary(documents, path))
    total = dictionary.agg(F.sum("n_docs")).first()[0] or 0
    least = max(2.0, total / FREQUENT_SHARE)
    frequent = {r.word: r.ids for r in dictionary.where(F.col("n_docs") >= least).select("word", "ids").collect()}
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each document its ids by position, with -slot in place of a rare word, and a row for each rare word
        splitter, known = _Splitter(path), shared.value
        for batch in batches:
            docs, words, slots, ids = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[int] = []
                rare: dict[str, int] = {}
                for w in splitter.words(text or ""):
                    if (hit := known.get(w)) is None:
                        out.append(-rare.setdefault(w, len(rare) + 1))
                    else:
                        out += hit
                docs.append(doc), words.append(None), slots.append(None), ids.append(out)
                for w, slot in rare.items():
                    docs.append(doc), words.append(w), slots.append(slot), ids.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(words, pa.string()), pa.array(slots, pa.int32()), pa.array(ids, pa.list_(pa.int32()))],
                names=["doc_id", "word", "slot", "line"],
            )

    placed = documents.select("doc_id", "text").mapInArrow(place, "doc_id long, word string, slot int, line array<int>")
    # rows without a word need no partner; a key of their own spreads them (no pre-token is NUL followed by digits)
    placed = placed.withColumn("_word", F.coalesce("word", F.concat(F.lit("\0"), F.col("doc_id").cast("string"))))
    rare = dictionary.where(F.col("n_docs") < least).select(F.col("word").alias("_word"), "ids")
    joined = placed.join(rare, "_word", "left")
    slot = F.when(F.col("word").isNotNull(), F.struct("slot", "ids"))
    gathered = joined.groupBy("doc_id").agg(F.max("line").alias("line"), F.array_sort(F.collect_list(slot)).alias("slots"))
    filled = F.flatten(F.transform("line", lambda x: F.when(x < 0, F.get(F.col("slots"), -x - 1)["ids"]).otherwise(F.array(x))))
    return gathered.select("doc_id", F.when(F.size("slots") == 0, F.col("line")).otherwise(filled).alias("ids"))


def token_bytes(spark, path: str = TOKENIZER) -> DataFrame:
    """(id, bytes as hex) of every token of the vocabulary; its size is that of the vocabulary."""
    from tokenizers import Tokenizer

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    rows = [(i, bytes(table[c] for c in token).hex()) for token, i in vocabulary.items() if all(c in table for c in token)]
    return spark.createDataFrame(rows, "id int, hex string")


def decode_corpus(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) of encoded documents: ids joined with the token-byte table and put together by position."""
    ids = encoded.select("doc_id", F.posexplode_outer("ids").alias("at", "id"))
    parts = ids.join(F.broadcast(token_bytes(encoded.sparkSession, path)), "id", "left")
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "hex")))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")), "UTF-8")
    return whole.select("doc_id", text.alias("text"))
