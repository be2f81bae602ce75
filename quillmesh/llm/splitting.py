"""Cutting oversized texts at natural boundaries, with overlap.

The size of a text is its number of code points divided by 4, rounded down, at least 1. Boundaries (paragraph, line,
sentence, clause and word ends) are found once per text, as sorted arrays of offsets; the last boundary under the limit is
found by binary search, strongest kind first; without any the cut is hard. The next piece starts ``overlap`` tokens
before the cut, or at the first boundary of any kind behind that place, so the overlap never shrinks by more than a word. As the token offset of a character is its position divided by 4, the prefix
sums of the token offsets are the positions themselves.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT_TOKENS = 500
OVERLAP_TOKENS = 50
CHARS_PER_TOKEN = 4

# ends of natural units, strongest first; a cut falls behind the match
BOUNDARIES = (
    regex.compile(r"\n[ \t]*\n\s*"),
    regex.compile(r"\n"),
    regex.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』）]*"),
    regex.compile(r"[;:,]\s+|[、，；：]"),
    regex.compile(r"\s+"),
)


def token_size(text: Column) -> Column:
    """Size of a text in tokens; null for null."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("int")


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``: every piece at most ``limit`` tokens, all characters covered."""
    most, back = limit * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1, overlap * CHARS_PER_TOKEN
    n = len(text)
    if n <= most:
        return [(0, n)]
    ends = [[m.end() for m in p.finditer(text)] for p in BOUNDARIES]
    any_end = sorted({e for offsets in ends for e in offsets})
    pieces, start = [], 0
    while n - start > most:
        high, low = start + most, start + most // 2
        cut = high
        for offsets in ends:
            k = bisect_right(offsets, high) - 1
            if k >= 0 and offsets[k] > low:
                cut = offsets[k]
                break
        pieces.append((start, cut))
        # step back by the whole overlap, then on to the next boundary of whatever kind
        k = bisect_left(any_end, cut - back)
        again = any_end[k] if k < len(any_end) and any_end[k] < cut else cut - back
        start = max(again, start + 1)
    pieces.append((start, n))
    return pieces


def split_oversized(chunks: DataFrame, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Pieces of the rows of ``chunks`` whose content exceeds ``limit`` tokens, cut text by text.

    ``chunks`` has id, content, heading and page_num; other columns are left out. Result: chunk_id, piece, n_pieces,
    start, content, heading, page_num, token_count. Null and short contents give no row; stored token counts are ignored.
    """
    big = chunks.where(token_size(F.col("content")) > limit).select("id", "content", "heading", F.col("page_num").cast("int").alias("page_num"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, text, heading, page in zip(*(c.to_pylist() for c in batch.columns)):
                spans = cut_points(text, limit, overlap)
                k = len(spans)
                parts = [text[a:b] for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk_id] * k, pa.int64()),
                        pa.array(range(k), pa.int32()),
                        pa.array([k] * k, pa.int32()),
                        pa.array([a for a, _ in spans], pa.int32()),
                        pa.array(parts, pa.string()),
                        pa.array([heading] * k, pa.string()),
                        pa.array([page] * k, pa.int32()),
                        pa.array([max(1, len(p) // CHARS_PER_TOKEN) for p in parts], pa.int32()),
                    ],
                    names=["chunk_id", "piece", "n_pieces", "start", "content", "heading", "page_num", "token_count"],
                )

    schema = "chunk_id long, piece int, n_pieces int, start int, content string, heading string, page_num int, token_count int"
    return big.mapInArrow(cut, schema)
