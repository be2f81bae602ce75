"""Pages of repeated keywords, bare links or product tags instead of sentences.

The suffix automaton of every page, over its words and signs, gives the characters that lie in repeated maximal substrings.
Clause structure comes from the corpus: the words that make up the first ``FUNCTION_MASS`` of all running words of a page
language are its function words, counted over all sentences of all pages (Japanese has hiragana for that). A page is cut
into segments at line and sentence ends; a segment in which no language's function words reach a share of what its prose has is
no clause. A page is stuffed if most of it has no clause and most of that part is covered by repeats, beyond what a text of
its length repeats anyway. Both are needed: prose in a language that the corpus doesn't know has no known clauses, but doesn't
repeat itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .automaton import TokenAutomaton

MIN_CHARS = 200
MIN_WORDS = 12
MIN_REPEAT = 4  # characters of a repeat that counts
FUNCTION_MASS = 0.25
FUNCTION_LETTERS = 6
LEAST_FUNCTION_WORDS = FUNCTION_MASS / 2  # of the words of a clause; half of what running text has
LEAST_HIRAGANA = 0.25  # of the signs of a Japanese clause
MOST_CLAUSELESS = 0.5
LEAST_PAGES = 0.2  # share of the pages of its language that a function word is on
SIGNS_BY_CHANCE = 0.7  # times the logarithm of the length: longer runs of characters hardly repeat by chance
COVERED_BASE, COVERED_GROWTH = 0.55, 0.02  # repeats of a text: a share of the first 256 characters, more with each doubling

_SEGMENT = re.compile(r"[^\n]+?(?:[.!?。！？…](?=\s)|[。！？]|(?=\n)|$)")
_SENTENCE = re.compile(r"([^\n.!?。！？…]*)([.!?。！？…]?)")
_LINK = re.compile(r"https?://\S+|www\.\S+")
_CJK = "぀-ヿ㐀-鿿"
_PARTS = re.compile(rf"\s+|\d+|[{_CJK}]|[^\W\d_{_CJK}]+|[^\w\s]|_|.", re.DOTALL)
_WORD = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+")
_LONG_RUN = re.compile(r"(.)\1{3,}")
_FRONT_MATTER = re.compile(r"\A---\n.*?\n---\n", re.DOTALL)


def words_of(text: str) -> list[str]:
    """Words in lower case without links; signs of Chinese and Japanese script one by one."""
    if "http" in text or "www." in text:
        text = _LINK.sub(" ", text)
    return _WORD.findall(text.lower())


class RepeatAutomaton(TokenAutomaton):
    """Which runs of tokens occur twice."""

    def longest_repeats(self) -> Iterator[tuple[int, int, int]]:
        """(run, k, n) from the end: the last n of the first k + 1 tokens of the run occur elsewhere, too (n is largest)."""
        length, link, twice = self.length, self.link, self.twice
        for r in range(len(self.ends) - 1, -1, -1):
            at = self.ends[r]
            for k in range(len(at) - 1, -1, -1):
                state = at[k]
                yield r, k, length[state] if twice[state] else length[link[state]]


def _marks(size: int, spans: list[tuple[int, int]], tokens: list[str], least: int) -> bytearray:
    """A mark for each of ``size`` characters inside repeated runs of tokens of at least ``least`` characters."""
    counts = Counter(tokens)
    # a token that occurs once is in no repeat, so it ends a run
    numbers: dict[str, int] = {}
    runs: list[list[int]] = []
    firsts: list[int] = []
    inside = False
    for k, t in enumerate(tokens):
        if counts[t] == 1:
            inside = False
            continue
        if not inside:
            runs.append([]), firsts.append(k)
            inside = True
        runs[-1].append(numbers.setdefault(t, len(numbers)))
    marks = bytearray(size)
    reach = size  # everything from here on is decided
    for r, k, n in RepeatAutomaton(runs).longest_repeats():
        end = firsts[r] + k
        low, high = spans[end - n + 1][0], spans[end][1]
        if high - low >= least and low < (high := min(high, reach)):
            marks[low:high] = b"\1" * (high - low)
            reach = low
    return marks


def repeated_words(text: str, least: int = MIN_REPEAT) -> bytearray:
    """Marks of the characters of ``text`` in repeated runs of words and signs; all numbers are alike."""
    parts = _PARTS.findall(text)
    ends = list(accumulate(map(len, parts)))
    spans = [(e - len(p), e) for p, e in zip(parts, ends) if not p.isspace()]
    return _marks(len(text), spans, ["0" if p.isdigit() else p.lower() for p in parts if not p.isspace()], least)


def repeated_signs(text: str, least: int) -> bytearray:
    """Marks of the characters of ``text`` in repeated runs of characters; all digits are alike."""
    return _marks(len(text), [(k, k + 1) for k in range(len(text))], ["0" if c.isdigit() else c for c in text], least)


def usual_cover(n_chars: int) -> float:
    """Share of a text of this length that may be covered by repeats though nothing is stuffed."""
    return min(0.65, COVERED_BASE + COVERED_GROWTH * max(0.0, math.log2(n_chars / 256)))


def _page_language(lang: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]{2})", 1), F.lit("")), F.lit("--"))


def function_words(documents: DataFrame) -> dict[str, int]:
    """Function words as bits of the languages they belong to.

    They are the most frequent short words of a language's pages that are on ``LEAST_PAGES`` of them, up to ``FUNCTION_MASS``
    of all running words of sentences, which end with a sentence sign. Sentences that a page repeats count
    once. Languages are the first two letters of ``lang`` (at most 26 * 26 + 1), all one where there is no such column.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            running: dict[str, Counter] = {}
            pages: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for s in {sentence for sentence, end in _SENTENCE.findall(text) if end} for w in words_of(s)]
                found = Counter(w for w in words if len(w) <= FUNCTION_LETTERS)
                found[""] = len(words)
                running.setdefault(lang, Counter()).update(found)
                pages.setdefault(lang, Counter()).update(found.keys())
            rows = [(lang, w, n, pages[lang][w]) for lang, c in running.items() for w, n in c.items()]
            columns = list(zip(*rows)) or [()] * 4
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "word", "n", "pages"])

    lang = _page_language(F.col("lang")) if "lang" in documents.columns else F.lit("--")
    texts = documents.where(f"length(text) >= {MIN_CHARS}").select(lang.alias("lang"), "text")
    counts = texts.mapInArrow(count, "lang string, word string, n long, pages long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    counts = cut_lineage(counts)  # read twice below; the texts are read once
    whole = counts.where("word = ''").select("lang", F.col("n").alias("all_n"), F.col("pages").alias("all_pages"))
    # a word under a five-hundredth of the running words is not among the first; so at most 500 a language reach the window
    frequent = counts.where("word <> ''").join(F.broadcast(whole), "lang").where((F.col("n") >= F.col("all_n") / 500) & (F.col("pages") >= LEAST_PAGES * F.col("all_pages")))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, -1))
    kept = frequent.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < FUNCTION_MASS * F.col("all_n"))
    out: dict[str, int] = {}
    bits: dict[str, int] = {}
    for r in kept.select("lang", "word").collect():
        out[r.word] = out.get(r.word, 0) | 1 << bits.setdefault(r.lang, len(bits))
    return out


def has_clause(words: list[str], known: dict[str, int]) -> bool:
    """Whether the words of a segment read like part of a sentence of some language; a longer one has several function words."""
    signs = sum(len(w) == 1 and "぀" <= w <= "鿿" for w in words)
    if 2 * signs > len(words):  # Japanese writes its grammar in hiragana
        return sum(len(w) == 1 and "぀" <= w <= "ゟ" for w in words) >= LEAST_HIRAGANA * signs
    found = Counter(w for w in words if w in known)
    least, several = max(1.0, LEAST_FUNCTION_WORDS * len(words)), 2 if len(words) >= MIN_WORDS else 1
    if len(found) < several or found.total() < least:
        return False
    every = 0
    for w in found:
        every |= known[w]
    for k in range(every.bit_length()):
        if every >> k & 1:
            own = [n for w, n in found.items() if known[w] >> k & 1]
            if len(own) >= several and sum(own) >= least:
                return True
    return False


def page_measures(text: str, known: dict[str, int]) -> tuple[int, int, int]:
    """(characters, characters in segments without a clause, of those covered by repeats) without white space at ends.

    Where words and signs repeat too little, as in tags that are written in one word, runs of characters are measured, too;
    they count from the length on that chance gives in a text of this length.
    """
    text = _FRONT_MATTER.sub("", text)
    marks = repeated_words(text)
    total = words = 0
    bare: list[tuple[int, int]] = []
    for m in _SEGMENT.finditer(text):
        segment = m[0].strip()
        total += len(segment)
        if segment and not has_clause(found := words_of(segment), known):
            a = m.start() + len(m[0]) - len(m[0].lstrip())
            bare.append((a, a + len(segment)))
            words += len(found) + segment.count("://")
    n = sum(b - a for a, b in bare)
    covered = sum(marks.count(1, a, b) for a, b in bare)
    if total >= MIN_CHARS and n > MOST_CLAUSELESS * total and covered <= usual_cover(total) * n:
        part = _LONG_RUN.sub(r"\1", "\n".join(text[a:b] for a, b in bare))
        marks = repeated_signs(part, math.ceil(SIGNS_BY_CHANCE * math.log2(len(part))))
        covered = max(covered, n * marks.count(1) // len(part))
    return total, n, covered if words >= MIN_WORDS else 0


def is_stuffed(total: int, bare: int, covered: int) -> bool:
    return total >= MIN_CHARS and bare > MOST_CLAUSELESS * total and covered > usual_cover(total) * bare


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, clauseless, covered) of the stuffed pages; ``documents`` has doc_id, text and lang.

    Null, blank and texts under ``MIN_CHARS`` give no row: the task counts short texts among the pages that are none.
    """
    known = documents.sparkSession.sparkContext.broadcast(function_words(documents))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if is_stuffed(*(m := page_measures(text, known.value))):
                    rows.append((doc, *m))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_chars", "clauseless", "covered"])

    return documents.where(f"length(text) >= {MIN_CHARS}").select("doc_id", "text").mapInArrow(judge, "doc_id long, n_chars long, clauseless long, covered long")
