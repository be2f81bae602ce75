"""Personal information in free text, by a skip-chain conditional random field.

The nodes of a document's field are its candidate tokens: all capitalised words that stand next to each other (and lower-case ones
around a known given name), and the segments that the grammars of e-mail addresses, numbers, codes and street addresses cut out as
one token each; all other text can only be outside. Neighbouring words of a run are linked in a chain; equal and similar tokens
(a slip, accents or hyphens apart) anywhere in the field are linked by skip edges that reward equal labels. Loopy sum-product
message passing gives the labels.

The parameters are trained here, piecewise: node potentials as a logistic model over sparse features, chain potentials from
label bigrams, the skip weight from how often similar tokens agree, on a bounded sample of fields that the people table and
announcing words label. Given names and endings of family names, counted over the whole people table, are features and nothing
more: in half of the sample a part of them is hidden, so the model learns to tell names it never met by their surroundings.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import TITLES, folded, person_tokens

MOST_GIVEN_NAMES = 5_000
MOST_ENDINGS = 1_000
ENDING, LEAST_LETTERS = 4, 7
SAMPLE_FIELDS = 6_000
ROUNDS = 6
PASSES = 4
HIDDEN = 2  # one in so many given names and endings is hidden in half of the sample
LEAST_SIMILAR = 6  # letters of tokens that are similar with a slip between them

FIELDS = (("people", "biography"), ("people", "notes"), ("messages", "text"), ("chunks", "content"))
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}

# labels of words in a run, and of segments
WORD_LABELS = ("O", "given", "initial", "family")
SEGMENT_LABELS = {"mail": ("O", "email"), "number": ("O", "phone", "id_number"), "place": ("O", "street_address")}

# grammars; fixed values inside them: street kinds, French and German street words, spoken signs of addresses
_WORD = r"\p{Lu}[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*"
_DOT = r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?)"
_MAIL = rf"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+|[\w.+-]+ ?(?:\(at\)|\[at\]|\{{at\}}) ?[\w-]+(?:(?:\.|{_DOT})[\w-]+)+|[\w.+-]+ at [\w-]+(?:{_DOT}[\w-]+)+"
_STREET_KINDS = "Street|Avenue|Road|Lane|Drive|Court|Way|Terrace|Row|Mews|Close|Place|Square|Crescent|Boulevard|St\\.|Ave\\.|St|Ave|Rd|Dr|Ln|Ct|Blvd"
_PLACE = (
    rf"\d{{1,5}}[a-z]? (?:\p{{Lu}}[\p{{L}}'’-]+ ){{1,3}}(?:{_STREET_KINDS})(?![\p{{L}}\d])(?:,? (?:Apt|Apartment|Unit|Suite|Ste|Flat)\.? ?#?\w{{1,4}}\b| ?#\d+)?"
    r"|\p{Lu}\p{Ll}+(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring) \d{1,4}(?: ?[a-z](?![\p{L}\d]))?"
    r"|\d{1,4}(?: (?:bis|ter|quater))?,? (?:rue|avenue|quai|impasse|boulevard|place|chemin|allée|cours|route)(?: (?:de|du|des|la|le|les|aux|au|à))*(?: (?:l'|d'))? ?\p{Lu}[\p{L}'’-]+"
)
_EXTENSION = r"(?:,? (?:ext|Ext|x|Durchwahl|poste)\.? ?\d{1,5})?"
_PHONE = (
    rf"(?:\+?1[ .-]?)?(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}{_EXTENSION}(?![.-]?\d)"
    rf"|(?:\+?\d+|\(\d{{2,5}}\))(?:[ .-]?(?:\(\d{{1,4}}\) ?\d+|\d+)){{0,7}}{_EXTENSION}"
)
_CODE = (
    r"\p{Lu}{2} ?\d\d ?\d\d ?\d\d ?\p{Lu}(?![\p{L}\d])"
    r"|(?!(?:ID|NI|No|Nr|ISO) )\p{Lu}{1,2}[ -]?\d[\d -]*\d(?:-?\p{Lu}(?![\p{L}\d]))?"
)
SEGMENT = regex.compile(rf"(?<![\w@.+-])(?:(?P<place>{_PLACE})|(?P<number>{_CODE}|{_PHONE}))(?![\w@])")
MAIL = regex.compile(rf"(?<![\w@.+-])(?P<mail>{_MAIL})(?![\w@])")
# where a place or a number may stand: long numbers, groups of digits, a number before or behind a street
_STREET_WORDS = "rue|avenue|quai|impasse|boulevard|place|chemin|allée|cours|route|bis|ter|quater"
_ANCHOR = re.compile(rf"\d{{4,}}|\d\)?[ .-]\(?\d|\d[a-z]?,? (?=[A-ZÀ-Þ]|{_STREET_WORDS})|\d[A-Z]|(?:stra(?:ß|ss)e|str\.|gasse|weg|allee|platz|ufer|damm|ring) \d")
_BEFORE_ANCHOR, _BEHIND_ANCHOR = 60, 90
_AT = re.compile(r"@| at |[(\[{]at[)\]}]")
RUN = regex.compile(rf"(?<![\w@.'’-])(?:{_WORD}|\p{{Lu}}\.)(?:(?:, ?| )(?:{_WORD}|\p{{Lu}}\.(?! *$)))+")
TOKEN = regex.compile(rf"{_WORD}|\p{{Lu}}\.")
_HINT = regex.compile(r"\d|@| dot |[(\[{](?:dot|at)[)\]}]|\p{Lu}(?:[\p{L}\p{M}'’-]*|\.),? \p{Lu}")
_LOWER = regex.compile(r"[\p{L}-]+")
_NEXT = regex.compile(r"[ \t]*(?:([\p{L}-]+)|(\S))")
# around a given name in lower case
_BEHIND_NAME, _BEFORE_NAME = regex.compile(r",? (?:\p{Ll}\. )?\p{Ll}{6,}(?![\w@])"), regex.compile(r"(?<!\p{Ll})\p{Ll}{6,}, $")
_GLUE, _GLUE_BEFORE = regex.compile(r"[\w@]"), regex.compile(r"[\w@.'’-]")
_SPLIT, _LOWER_TOKEN = re.compile(r"[\s,;:]+"), regex.compile(r"\p{Ll}\.|\p{Ll}+")

# fixed values: words that announce a number of each label, for the training sample
ANNOUNCE = {
    "id_number": "passport licence license insurance ssn security steuer-id steuernummer tax ni id card ausweis personalausweis nif dni".split(),
    "O": "order lot tracking isbn score batch build version revision page iso room chapter ratio paid sku invoice ticket".split(),
}
# fixed values: texts with what looks like an address and is none, a share of the training sample
ADDRESS_LIKE = ("install parser@2.0.1 first", "see icon@2x.png in the folder", "pin cask@1.4.beta here", "tag v2@next.build now", "we meet at noon dot then", "chapter 12 Winter Road", "track 7 Long Way", "scene 3 Old Court", "verse 14 Narrow Lane", "season 2 Garden Row")
NOT_ADDRESSES = 100  # examples to one of these


def shape(text: str) -> str:
    return regex.sub(r"\p{Lu}", "A", regex.sub(r"\p{Ll}+", "a", regex.sub(r"\d", "9", text)))[:24]


class Node:
    __slots__ = ("start", "end", "text", "labels", "features", "previous", "key")

    def __init__(self, start: int, end: int, text: str, labels: tuple[str, ...], features: list[str], previous: int, key: str):
        self.start, self.end, self.text, self.labels, self.features, self.previous, self.key = start, end, text, labels, features, previous, key


def _segments(text: str) -> list[regex.Match]:
    """E-mail addresses, then places and numbers around anchors, in order and without overlaps."""
    found = list(MAIL.finditer(text)) if _AT.search(text) else []
    windows: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        low, high = max(0, m.start() - _BEFORE_ANCHOR), m.end() + _BEHIND_ANCHOR
        if windows and low <= windows[-1][1]:
            windows[-1][1] = high
        else:
            windows.append([low, high])
    mails = [m.span() for m in found]
    for low, high in windows:
        for m in SEGMENT.finditer(text, low, high):
            k = bisect_right(mails, (m.start(), math.inf)) - 1
            if not (k >= 0 and mails[k][1] > m.start()) and not (k + 1 < len(mails) and mails[k + 1][0] < m.end()):
                found.append(m)
    return sorted(found, key=lambda m: m.start())


def _free(runs: Iterator[list[tuple[int, int, str]]], taken: list[tuple[int, int]]) -> Iterator[list[tuple[int, int, str]]]:
    """Runs without the tokens that a segment took, cut there, as far as two tokens stay together."""
    for tokens in runs:
        part: list[tuple[int, int, str]] = []
        for token in tokens:
            k = bisect_right(taken, (token[0], math.inf)) - 1
            if (k >= 0 and taken[k][1] > token[0]) or (k + 1 < len(taken) and taken[k + 1][0] < token[1]):
                if len(part) > 1:
                    yield part
                part = []
            else:
                part.append(token)
        if len(part) > 1:
            yield part


def _runs(text: str, met: frozenset[str], common: frozenset[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Runs of words that may be a name, with their tokens: capitalised, or around a given name (of those met) in lower case."""
    for m in RUN.finditer(text):
        tokens = [(t.start() + m.start(), t.end() + m.start(), t[0]) for t in TOKEN.finditer(m[0])]
        if len(tokens) > 1:
            yield tokens
    for name in met:
        at = text.find(name) if len(name) >= 3 else -1
        while at >= 0:
            end = at + len(name)
            low, high = at, 0
            if m := _BEHIND_NAME.match(text, end):
                high = m.end()
            elif (m := _BEFORE_NAME.search(text, max(0, at - 40), at)) and not _GLUE.match(text, end):
                low, high = m.start(), end
            if high and not (low and _GLUE_BEFORE.match(text, low - 1)):
                tokens = [(t.start() + low, t.end() + low, t[0]) for t in _LOWER_TOKEN.finditer(text[low:high])]
                if any(t[-ENDING:] in common and len(t) >= LEAST_LETTERS for *_, t in tokens):
                    yield tokens
            at = text.find(name, end)


def nodes_of(text: str, given: frozenset[str], endings: frozenset[str], common: frozenset[str], hide: Callable[[str], bool] = lambda word: False) -> list[Node]:
    """Candidate tokens of one field with their features; ``previous`` is the chain neighbour (or -1).

    ``common`` are the endings that a word in lower case needs beside a given name. Given names and endings for which ``hide`` holds are candidates, but their features are those of unknown words.
    """
    met = given.intersection(_SPLIT.split(text))
    if not met and not _HINT.search(text):
        return []
    nodes, taken = [], []
    for m in _segments(text):
        kind, (a, b) = m.lastgroup, m.span()
        digits = sum(map(str.isdigit, m[0]))
        if kind == "number" and not (6 if m[0][0].isalpha() else 7) <= digits <= 18:
            continue
        if kind == "number" and text[b : b + 1] in (".", "-", ":") and text[b + 1 : b + 2].isdigit():
            continue
        words = [w.lower() for w in _LOWER.findall(text[max(0, a - 40) : a].rpartition("\n")[2])[-3:]]
        form = shape(m[0])
        features = [f"{kind}", f"{kind}|{form}", f"{kind}|{min(digits, 16)}"] + [f"{kind}<{w}" for w in words] + [f"{kind}<1{words[-1]}" if words else f"{kind}<1"]
        nodes.append(Node(a, b, m[0], SEGMENT_LABELS[kind], features, -1, m[0]))
        taken.append((a, b))
    for tokens in _free(_runs(text, met, common), taken):
        head = text[max(0, tokens[0][0] - 30) : tokens[0][0]]
        line = head.rpartition("\n")[2]
        before = _LOWER.findall(line)
        before = before[-1].lower() if before else "^"
        behind = _NEXT.match(text, tokens[-1][1])
        behind = (behind[1] or behind[2] or "$").lower() if behind else "$"
        titled = before in TITLES
        opening = not titled and not head.rstrip(" \t\"'“(-*") or not titled and head.rstrip(" \t\"'“(-*")[-1:] in ".!?:\n"
        title = line.lstrip().startswith("#")
        lows = [t.lower() for *_, t in tokens]
        named = [low in given and not hide(low) for low in lows]
        ended = [low[-ENDING:] in endings and not hide(low[-ENDING:]) for low in lows]
        unknown = [not (low in given or low[-ENDING:] in endings) for low in lows]
        for k, (a, b, t) in enumerate(tokens):
            low = lows[k]
            f = ["w", f"lower{t.islower()}", f"short{len(t) <= 2}", f"at{k}of{min(len(tokens), 4)}", f"opening{opening and k == 0}", f"end|{low[-ENDING:] if ended[k] else '-'}",
                 f"given{named[k]}", f"caps{t.isupper()}", f"size{min(len(t), 12) if named[k] or ended[k] else '-'}", f"dot{t.endswith('.')}", f"title{title}", f"titled{titled}", f"titled{titled}{k}"]
            f.append(f"before|{before if k == 0 else '+'}")
            f.append(f"run|{min(len(tokens), 4)}|{before}")
            f.append(f"behind|{behind}")
            f.append(f"left|{'g' if k and named[k - 1] else 'x'}")
            f.append(f"right|{'e' if k + 1 < len(tokens) and ended[k + 1] else 'x'}")
            f.append(f"comma{text[b : b + 1] == ','}")
            if unknown[k]:  # words of names have no features of their own, or the model would only know those it has met
                f += [f"word|{low}", f"tail|{low[-3:]}"]
            if k and unknown[k - 1]:
                f.append(f"left|{lows[k - 1]}")
            if k + 1 < len(tokens) and unknown[k + 1]:
                f.append(f"right|{lows[k + 1]}")
            nodes.append(Node(a, b, t, WORD_LABELS, f, len(nodes) - 1 if k else -1, low))
    return nodes


def similar_tokens(nodes: list[Node]) -> list[tuple[int, int]]:
    """Pairs of nodes of one kind whose tokens are equal or similar: to the last one before it by each way of being similar."""
    last: dict[tuple, int] = {}
    pairs: set[tuple[int, int]] = set()
    for k, n in enumerate(nodes):
        if n.labels is WORD_LABELS and len(n.text) <= 2:
            continue
        plain = folded(n.key).replace("-", "").replace("'", "").replace("’", "")
        keys = {plain}
        if n.labels is WORD_LABELS and len(plain) >= LEAST_SIMILAR:
            keys |= {plain[:j] + plain[j + 1 :] for j in range(len(plain))}
        for key in keys:
            other = last.get((n.labels, key))
            if other is not None:
                pairs.add((other, k))
            last[n.labels, key] = k
    return sorted(pairs)


class SkipChain:
    """Parameters and inference. ``weights[feature][label]``, ``chain[(left, right)]``."""

    def __init__(self, given: frozenset[str], endings: frozenset[str], common: frozenset[str]):
        self.given, self.endings, self.common = given, endings, common
        self.weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self.chain: dict[tuple[str, str], float] = {}
        self.skip = 0.0

    def potentials(self, node: Node) -> list[float]:
        out = [0.0] * len(node.labels)
        for f in node.features:
            if w := self.weights.get(f):
                for k, label in enumerate(node.labels):
                    out[k] += w.get(label, 0.0)
        return out

    def fit(self, examples: list[list[tuple[Node, str | None]]]) -> None:
        """Piecewise training: logistic node potentials by stochastic gradient, chain potentials by log odds of bigrams."""
        rng = random.Random(7)
        flat = [x for field in examples for x in field if x[1] is not None]
        for turn in range(ROUNDS):
            rng.shuffle(flat)
            rate = 0.5 / (1 + turn)
            for node, truth in flat:
                kept = [f for f in node.features if not (f.startswith(("given", "end|", "word|")) and rng.random() < 0.2)]
                score = [sum(self.weights[f][label] for f in kept) for label in node.labels]
                top = max(score)
                mass = [math.exp(s - top) for s in score]
                total = sum(mass)
                for label, p in zip(node.labels, mass):
                    step = rate * ((label == truth) - p / total)
                    if abs(step) > 1e-3:
                        for f in kept:
                            self.weights[f][label] += step
        pair, left, right = defaultdict(float), defaultdict(float), defaultdict(float)
        for field in examples:
            for k, (node, truth) in enumerate(field):
                if node.previous >= 0 and truth is not None:
                    was = field[node.previous][1]
                    pair[was, truth] += 1
                    left[was] += 1
                    right[truth] += 1
        total = sum(left.values()) + 1
        for a in WORD_LABELS:
            for b in WORD_LABELS:
                self.chain[a, b] = math.log((pair[a, b] + 0.5) * total / ((left[a] + 2) * (right[b] + 2)))
        self.weights = {f: dict(w) for f, w in self.weights.items()}
        # how much likelier similar tokens of a field agree than any two
        agree, all_pairs = 1.0, 2.0
        for field in examples:
            for a, b in similar_tokens([n for n, _ in field]):
                if field[a][1] is not None and field[b][1] is not None:
                    agree += field[a][1] == field[b][1]
                    all_pairs += 1
        usual = Counter(truth for _, truth in flat)
        chance = sum((n / max(1, len(flat))) ** 2 for n in usual.values()) or 0.5
        self.skip = max(0.0, math.log(max(agree / all_pairs, 1e-3) / min(max(chance, 1e-3), 1.0)))

    def label(self, nodes: list[Node]) -> list[str]:
        """Labels of the nodes of one field, by loopy sum-product over chain and skip edges."""
        score = [self.potentials(n) for n in nodes]
        edges: list[tuple[int, int, bool]] = [(n.previous, k, True) for k, n in enumerate(nodes) if n.previous >= 0]
        edges += [(a, b, False) for a, b in similar_tokens(nodes)]
        if not edges:
            return [n.labels[max(range(len(s)), key=s.__getitem__)] for n, s in zip(nodes, score)]
        incoming: dict[int, list[int]] = defaultdict(list)
        for e, (a, b, _) in enumerate(edges):
            incoming[a].append(2 * e + 1), incoming[b].append(2 * e)
        message = [[0.0] * len(nodes[edges[m // 2][1 if m % 2 == 0 else 0]].labels) for m in range(2 * len(edges))]
        passes = 2 if all(c for *_, c in edges) else PASSES
        for _ in range(passes):
            # forward in order, backward in reverse: exact on chains, loopy with skip edges
            for m in [*range(0, len(message), 2), *range(len(message) - 1, 0, -2)]:
                a, b, chained = edges[m // 2]
                source, target = (a, b) if m % 2 == 0 else (b, a)
                belief = score[source][:]
                for other in incoming[source]:
                    if other // 2 != m // 2:
                        belief = [x + y for x, y in zip(belief, message[other])]
                top = max(belief)
                out = []
                for y in nodes[target].labels:
                    if chained:
                        sums = sum(math.exp(v - top + self.chain[(x, y) if m % 2 == 0 else (y, x)]) for x, v in zip(nodes[source].labels, belief))
                    else:
                        sums = sum(math.exp(v - top + (self.skip if x == y else 0.0)) for x, v in zip(nodes[source].labels, belief))
                    out.append(math.log(sums))
                base = max(out)
                message[m] = [x - base for x in out]
        labels = []
        for k, n in enumerate(nodes):
            belief = score[k][:]
            for m in incoming[k]:
                belief = [x + y for x, y in zip(belief, message[m])]
            labels.append(n.labels[max(range(len(belief)), key=belief.__getitem__)])
        return labels

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the personal information in ``text``, in order, without overlaps."""
        nodes = nodes_of(text, self.given, self.endings, self.common)
        if not nodes:
            return []
        labels = self.label(nodes)
        out, k = [], 0
        while k < len(nodes):
            n = nodes[k]
            if n.labels is not WORD_LABELS:
                if labels[k] != "O":
                    out.append((n.start, n.end, labels[k]))
                k += 1
                continue
            j = k  # the longest stretch of one run that is labelled
            while j < len(nodes) and nodes[j].labels is WORD_LABELS and labels[j] != "O" and (j == k or nodes[j].previous == j - 1):
                j += 1
            kinds = labels[k:j]
            if "family" in kinds and ("given" in kinds or "initial" in kinds):
                f = k + kinds.index("family")
                behind_it = f + 1 + kinds[f + 1 - k :].index("family") if "family" in kinds[f + 1 - k :] else j
                if f == k and behind_it < j and text[nodes[f].end : nodes[f].end + 1] == ",":
                    if nodes[behind_it].key[-ENDING:] in self.endings or nodes[f].key[-ENDING:] not in self.endings:
                        k, f, behind_it = k + 1, behind_it, j  # a town before a whole name
                # the given name stands on one side of the family name: behind it after a comma, or where none stands before
                last_first = j > f + 1 and (f == k or text[nodes[f].end : nodes[f].end + 1] == ",")
                a, b = (f, behind_it) if last_first else (k, f + 1)
                if b - a > 1:
                    out.append((nodes[a].start, nodes[b - 1].end, "person_name"))
            k = max(j, k + 1)
        return sorted(out)


def _weak_labels(nodes: list[Node], given: frozenset[str], endings: frozenset[str], families: frozenset[str]) -> list[tuple[Node, str | None]]:
    """Labels of a sample field from the people table (words) and from announcing words and shapes (segments).

    A run with a word that looks like a family name but is none of the table's has no labels (None).
    """
    labels = ["O"] * len(nodes)
    for k, n in enumerate(nodes):
        if n.labels is WORD_LABELS:
            low = n.key
            if low in families:
                j = k - 1
                while j >= 0 and nodes[j + 1].previous == j and nodes[j].text.endswith(".") and labels[j] == "O":
                    j -= 1
                if nodes[k].previous >= 0 and j >= 0 and nodes[j + 1].previous == j and nodes[j].key in given:
                    labels[j] = "given"
                    for i in range(j + 1, k):
                        labels[i] = "initial"
                    labels[k] = "family"
                elif j + 1 < k:
                    for i in range(j + 1, k):
                        labels[i] = "initial"
                    labels[k] = "family"
                elif k + 1 < len(nodes) and nodes[k + 1].previous == k and (nodes[k + 1].key in given or nodes[k + 1].text.endswith(".")):
                    labels[k] = "family"
            elif n.previous == k - 1 and k and labels[k - 1] == "family" and (low in given or n.text.endswith(".")):
                labels[k] = "initial" if n.text.endswith(".") else "given"
        elif n.labels == SEGMENT_LABELS["number"]:
            words = {f.partition("<")[2] for f in n.features if "<" in f and "<1" not in f}
            if words & set(ANNOUNCE["O"]):
                labels[k] = "O"
            elif words & set(ANNOUNCE["id_number"]):
                labels[k] = "id_number"
            else:
                plain = regex.fullmatch(r"(?:\+\d{1,3}|00\d{2}|0\d{2,4}|1|\(?\d{3}\)?)(?:[ .-]?\(?\d+\)?)+(?: ext\. \d+)?|\+\d{11}", n.text)
                year = regex.match(r"(?:19|20)\d\d[-./]\d\d", n.text)
                labels[k] = "phone" if plain and not year else "O"
        else:
            labels[k] = n.labels[1]
    out: list[tuple[Node, str | None]] = list(zip(nodes, labels))
    for k, n in enumerate(nodes):
        if n.labels is WORD_LABELS and n.previous < 0:
            j = k + 1
            while j < len(nodes) and nodes[j].previous == j - 1:
                j += 1
            if any(len(x.key) >= LEAST_LETTERS and x.key[-ENDING:] in endings and x.key not in families for x in nodes[k:j]):
                out[k:j] = [(x, None) for x in nodes[k:j]]
    return out


def text_fields(load) -> DataFrame:
    """(source_table, row_id, field_name, text) of the four free-text fields; ``load(name)`` gives a table."""
    parts = None
    for table, column in FIELDS:
        part = load(table).select(F.lit(table).alias("source_table"), F.col("id").alias("row_id"), F.lit(column).alias("field_name"), F.col(column).alias("text"))
        parts = part if parts is None else parts.unionAll(part)
    return parts.where("text is not null and text <> ''")


def fit_model(fields: DataFrame, people: DataFrame) -> SkipChain:
    """Train on a bounded sample. Lexicons are counted over the whole people table and cut at a fixed size."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t for name in batch.column(0).to_pylist() if name and (t := person_tokens(name)) and len(t[0]) > 1]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in found], pa.string()), pa.array([t[1] for t in found], pa.string())], names=["head", "core"])

    names = people.select("name").mapInArrow(split, "head string, core string")
    heads = names.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "head").limit(MOST_GIVEN_NAMES).collect()
    ends = names.where("length(core) > 4").groupBy(F.right("core", F.lit(ENDING)).alias("end")).agg(F.count("*").alias("n"))
    endings = ends.orderBy(F.desc("n"), "end").limit(MOST_ENDINGS).collect()
    least = max(2, sum(r[1] for r in endings) / 400)
    nicknames = people.select(F.explode(F.split("aliases", ",")).alias("w")).select(F.lower(F.trim("w")).alias("w")).where(r"w rlike '^\\p{L}{2,}$'")
    nicknames = nicknames.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(MOST_GIVEN_NAMES).collect()
    given = frozenset(r[0] for r in heads) | frozenset(r[0] for r in nicknames)
    model = SkipChain(given, frozenset(r[0] for r in endings), frozenset(r[0] for r in endings if r[1] >= least))
    place = F.xxhash64("source_table", "row_id", "field_name")
    share = max(1, fields.count() // (8 * SAMPLE_FIELDS))  # thins the fields first, so that little goes to the driver
    hinted = fields.where(F.pmod(place, F.lit(share)) == 0).where(r"text rlike '[0-9@]|\\p{Lu}\\S* \\p{Lu}'")
    sample = hinted.orderBy(place).limit(SAMPLE_FIELDS).select("text").collect()
    words = {t.lower() for r in sample for t in TOKEN.findall(r.text)}
    families = frozenset(r[0] for r in names.select("core").distinct().join(people.sparkSession.createDataFrame([(w,) for w in sorted(words)] or [("",)], "core string"), "core").collect())
    examples = []
    for k, r in enumerate(sample):
        hide = (lambda word: zlib.crc32(word.encode()) % HIDDEN == 0) if k % 2 else (lambda word: False)
        if nodes := nodes_of(r.text, model.given, model.endings, model.common, hide):
            examples.append(_weak_labels(nodes, model.given, model.endings, families))
    for k in range(len(examples) // NOT_ADDRESSES):  # what looks like an address and is none is rare in the sample
        text = ADDRESS_LIKE[k % len(ADDRESS_LIKE)]
        examples.append([(n, "O" if n.labels is not WORD_LABELS else None) for n in nodes_of(text, model.given, model.endings, model.common)])
    model.fit(examples)
    return model


def find_personal(fields: DataFrame, model: SkipChain) -> DataFrame:
    """(source_table, row_id, field_name, kind, value): each different value of each field once, as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [c.to_pylist() for c in batch.columns]
            for table, row, field, text in zip(*columns):
                rows += sorted({(table, row, field, kind, text[a:b]) for a, b, kind in model.find(text)})
            cells = list(zip(*rows)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=["source_table", "row_id", "field_name", "kind", "value"])

    return fields.mapInArrow(run, "source_table string, row_id long, field_name string, kind string, value string")


def redact(fields: DataFrame, model: SkipChain) -> DataFrame:
    """(source_table, row_id, field_name, text): the fields with typed placeholders in place of personal information."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(3).to_pylist():
                parts, at = [], 0
                for a, b, kind in model.find(text):
                    parts += [text[at:a], PLACEHOLDERS[kind]]
                    at = b
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=["source_table", "row_id", "field_name", "text"])

    return fields.mapInArrow(run, "source_table string, row_id long, field_name string, text string")
