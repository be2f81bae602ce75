"""Variant spellings of persons and houses, linked.

A name becomes two tokens: a head (the given name, or the trade of a house) and a core (the family name, or what is left of a
house's name), after titles, legal forms, accents, case, order and stray hyphens are undone. Nicknames are learned from the
corpus: an alias that goes with one given name in most rows stands for it. So are the trades of houses (words that a share of
all houses has) and their abbreviations.

Different names are joined by a prefix-filtered set-similarity join on q-grams of both tokens: of each token only the rarest
grams are kept, as many as a slip can spoil and one more, so names a slip apart in either or both tokens share a pair of them.
Lengths and the overlap are checked, and candidates are verified by a soft weighted token similarity in which rare tokens count
more. Whether two tokens are one is decided by shares alone, which don't change as the table grows: of the names that have the
rarer token, most must stand beside a like name with the commoner one, beyond what chance gives. Linked names form components
by label propagation. Rows of a component are divided into entities by equal keys only (birth date, then place, then nothing
known), so no group is ever compared pair by pair; initials join the one entity that fits.

Null, blank and unreadable names link to nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HEAD_GRAM = 2
CORE_GRAMS = ((3, 1, 8), (4, 8, 10), (5, 10, 1_000))  # q of cores from and up to so many letters; borders belong to both
LEAST_CORE = 5  # letters of a core that may be misspelt
LEAST_SIMILARITY = 0.7
LEAST_SHARED = 0.5  # of the names of a rarer token that have a like one with the commoner token, beyond chance
TRADE_SHARE = 0.004  # of all houses have a word that names a trade
MOST_TRADES = 1_000

# fixed values: words around a person's name
TITLES = frozenset("dr prof mr mrs ms miss rev sir dame herr frau mme m.".split())
SUFFIXES = frozenset("jr sr msc bsc phd md ii iii esq".split())
# fixed values: words of a house's name that name its trade, behind and in front of the rest; more of them, other endings and
# abbreviations are learned
TRADES_BEHIND = "vineyards distillery spirits estate brewery brewing cellars winery".split()
TRADES_IN_FRONT = "chateau weingut saint casa quinta bodegas domaine".split()
# fixed values: other words of a house's name that name nothing
HOUSE_FILLERS = frozenset("the and sons daughters son co company ltd limited llc inc gmbh kg sa srl plc de del du la le of old label export bottler no".split())

_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "æ": "ae", "œ": "oe"})


def folded(text: str) -> str:
    """Without accents and stray spaces; the case stays."""
    text = unicodedata.normalize("NFKD", text.translate(_PLAIN))
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


def person_tokens(name: str) -> tuple[str, str] | None:
    """(given name or initial, family name) in lower case, or None where there are not both."""
    name = re.sub(r"\s*(\([^()]*\)|\s-\s.*)\s*$", "", folded(name))
    last_first = "," in name
    if last_first:
        family, _, given = name.partition(",")
        if given.strip(" .").lower() in SUFFIXES:
            name, last_first = family, False
    words = lambda s: [w for w in re.split(r"\s+", s.replace("-", "").replace("'", "")) if w]
    bare = lambda w: w.rstrip(".").lower()
    drop = lambda ws: [w for w in ws if bare(w) not in TITLES and bare(w) not in SUFFIXES]
    if last_first:
        first, rest = drop(words(given)), drop(words(family))
        if not first or not rest:
            return None
        return bare(first[0]), "".join(map(bare, rest))
    parts = drop(words(name))
    if len(parts) < 2:
        return None
    if parts[0].isupper() and len(parts[0].rstrip(".")) > 1 and not parts[-1].isupper():  # FAMILY Given
        return bare(parts[-1]), "".join(map(bare, parts[:-1]))
    middle = [w for w in parts[1:-1] if len(w.rstrip(".")) > 1]
    return bare(parts[0]), "".join(map(bare, [*middle, parts[-1]]))


def house_words(name: str) -> list[str]:
    """Words of a house's name in lower case without remarks in brackets; behind a comma stands what belongs in front."""
    name = re.sub(r"\([^()]*\)", " ", folded(name)).lower().replace("-", "").replace("'", "")
    name = re.sub(r"(?<=\b\w)\.(?=\w\b)", "", name)  # S.A. is one word
    front, _, back = name.partition(",")
    words = [w for w in _LETTERS.findall(f"{back} {front}") if w not in HOUSE_FILLERS]
    return words


def _short_for(word: str, trade: str) -> bool:
    """Whether a word may stand for a trade: its first letter and some of the others in order, another ending, or a slip."""
    if word == trade or word[0] != trade[0]:
        return word == trade
    if len(word) > 1 and len(word) < len(trade):
        rest = iter(trade)
        if all(c in rest for c in word):
            return True
    shared = 0
    while shared < min(len(word), len(trade)) and word[shared] == trade[shared]:
        shared += 1
    if shared >= 4 and max(len(word), len(trade)) - shared <= 4:
        return True
    if len(trade) > 5 and abs(len(word) - len(trade)) <= 1:
        tail = 0
        while tail < min(len(word), len(trade)) - shared and word[-1 - tail] == trade[-1 - tail]:
            tail += 1
        middle = (word[shared : len(word) - tail], trade[shared : len(trade) - tail])
        return max(map(len, middle)) <= 1 or (len(middle[0]) == 2 and middle[0] == middle[1][::-1])
    return False


class Trades:
    """Trade words of houses, learned: (word, share of the houses where it stands first)."""

    def __init__(self, words: list[tuple[str, float]]):
        self.first = {w: share > 0.5 for w, share in words}
        self.same: dict[str, str] = {}
        for w, _ in words:  # in order of weight; later ones may be another ending of an earlier one
            self.same[w] = next((t for t in self.same if self.first[t] == self.first[w] and _short_for(w, t)), w)

    def of(self, word: str, first: bool) -> str:
        """The trade that a word names or shortens at its place in the name, or ''."""
        if word in self.same:
            return self.same[word]
        if len(word) < 2:
            return ""
        fits = {self.same[t] for t in self.same if self.first[t] == first and _short_for(word, t)}
        if not fits and len(word) >= 5:  # long enough to be told at the other place, too
            fits = {self.same[t] for t in self.same if _short_for(word, t)}
        return fits.pop() if len(fits) == 1 else ""

    def tokens(self, name: str) -> tuple[str, str] | None:
        """(trade, '' if none is named, or an initial), (the rest of the name); None where nothing is left."""
        words = house_words(name)
        trade, core = "", []
        for k, w in enumerate(words):
            found = self.of(w, k == 0) if len(words) > 1 and not trade and k in (0, len(words) - 1) or w in self.same else ""
            if found:
                trade = trade or found
            elif len(w) == 1 and not trade:
                trade = w
            elif len(w) > 1:
                core.append(w)
        return (trade, "".join(core)) if core else None


def learn_trades(producers: DataFrame) -> Trades:
    """The trade words of the fixed list, and words beside which at least ``TRADE_SHARE`` of all houses (and three) have another
    word each time. The name of a house has few other words beside it, however many rows it has."""
    fixed = [(w, 0.0) for w in TRADES_BEHIND] + [(w, 1.0) for w in TRADES_IN_FRONT]

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Trades(fixed)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                words = house_words(name)
                rest = [w for k, w in enumerate(words) if len(w) > 1 and not known.of(w, k == 0)]
                rows += {(w, other, w == words[0]) for w in rest for other in rest if w != other}
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], names=["word", "other", "first"])

    named = producers.where("name is not null").select("name")
    least = max(3.0, TRADE_SHARE * named.count())
    counts = named.mapInArrow(beside, "word string, other string, first boolean").groupBy("word", "other").agg(F.max("first").cast("int").alias("first"))
    counts = counts.groupBy("word").agg(F.count("*").alias("n"), F.avg("first").alias("first")).where(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "word").limit(MOST_TRADES).collect()  # a share of 1/250 leaves few hundred
    return Trades(fixed + [(r["word"], r["first"]) for r in rows])


def _parsed(df: DataFrame, kind: str, parse) -> DataFrame:
    """(id, head, core, form): the tokens of ``name`` (form 0) and of full names among ``aliases`` (form 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, name, aliases in zip(*(c.to_pylist() for c in batch.columns)):
                if name and (t := parse(name)):
                    rows.append((row, *t, 0))
                    for alias in (aliases or "").split(","):
                        if " " in alias.strip() and (t := parse(alias)) and len(t[0]) > 1:
                            rows.append((row, *t, 1))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32())],
                names=["id", "head", "core", "form"],
            )

    aliases = F.col("aliases") if kind == "people" else F.lit(None).cast("string").alias("aliases")
    return df.select(F.col("id").cast("long"), "name", aliases).mapInArrow(run, "id long, head string, core string, form int")


def learn_nicknames(people: DataFrame, names: DataFrame) -> DataFrame:
    """(nick, given): single-word aliases that go with one given name in at least two rows and in most of their rows."""
    short = people.select("id", F.explode(F.split("aliases", ",")).alias("nick")).select("id", F.lower(F.trim("nick")).alias("nick")).where(r"nick rlike '^\\p{L}{2,}$'")
    pairs = short.join(names.where("form = 0").select("id", F.col("head").alias("given")), "id").where("nick <> given and length(given) > 1")
    counted = pairs.groupBy("nick", "given").count()
    best = counted.groupBy("nick").agg(F.max_by("given", F.struct("count", "given")).alias("given"), F.max("count").alias("n"), F.sum("count").alias("total"))
    own = names.where("form = 0").groupBy(F.col("head").alias("nick")).agg(F.count("*").alias("own"))
    return best.join(own, "nick", "left").where("n >= 2 and n > 0.6 * total and coalesce(own, 0) <= n").select("nick", "given")


def _grams(token: Column, q: int) -> Column:
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - q + 1)), lambda k: F.substring(padded, k, F.lit(q))))


def _same_but_a_slip(a: Column, b: Column) -> Column:
    """One letter more, less or other, or two swapped."""
    sorted_letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    distance = F.levenshtein(a, b)
    return (distance <= 1) | ((distance == 2) & (F.length(a) == F.length(b)) & (sorted_letters(a) == sorted_letters(b)))


def _prefixes(nodes: DataFrame, tokens: DataFrame, token: str, gram: Column, keep: int) -> DataFrame:
    """(kind, ``token``, prefix): the ``keep`` rarest grams of every token, counted over the tokens of the kind, and its sorted
    letters, which stay where two of them change places."""
    grams = tokens.select("kind", token, F.explode(gram).alias("gram"))
    counts = grams.groupBy("kind", "gram").agg(F.count("*").alias("df"))
    listed = grams.join(counts, ["kind", "gram"]).groupBy("kind", token).agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    letters = F.concat(F.lit("*"), F.array_join(F.array_sort(F.split(token, "")), ""))
    return listed.select("kind", token, F.array_append(F.transform(F.slice("g", 1, keep), lambda x: x["gram"]), letters).alias(f"{token}_prefix"))


def _candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a < b) of node ids that may be a slip apart in the head, in the core or in both, or of one core with one head
    the beginning of the other.

    A letter more, less or other spoils at most q of a token's q-grams, so such tokens share one of their q + 1 rarest; swapped
    letters leave the sorted ones. The elements of the join are pairs of an element of the head and one of the core.
    """
    heads = nodes.where("length(head) > 1").select("kind", "head").distinct()
    cores = nodes.select("kind", "core").distinct()
    head_prefix = _prefixes(nodes, heads, "head", _grams(F.col("head"), HEAD_GRAM), HEAD_GRAM + 1)
    parts = []
    for q, low, high in CORE_GRAMS:
        here = cores.where(F.length("core").between(low, high))
        parts.append(_prefixes(nodes, here, "core", F.transform(_grams(F.col("core"), q), lambda g, q=q: F.concat(F.lit(str(q)), g)), q + 1))
    core_prefix = parts[0].unionAll(parts[1]).unionAll(parts[2])
    rows = nodes.select("node", "kind", "head", "core").join(head_prefix, ["kind", "head"]).join(core_prefix, ["kind", "core"])
    rows = rows.select("node", "kind", F.length("head").alias("hn"), F.length("core").alias("cn"), "head_prefix", F.explode("core_prefix").alias("cg"))
    rows = cut_lineage(rows.select("node", "hn", "cn", F.explode("head_prefix").alias("hg"), "kind", "cg").select("node", "hn", "cn", F.xxhash64("kind", "hg", "cg").alias("key")))
    other = rows.select(F.col("node").alias("b"), F.col("hn").alias("hn2"), F.col("cn").alias("cn2"), "key")
    near = (F.col("node") < F.col("b")) & (F.abs(F.col("hn") - F.col("hn2")) <= 1) & (F.abs(F.col("cn") - F.col("cn2")) <= 1)
    slips = rows.join(other, "key").where(near).select(F.col("node").alias("a"), "b")
    # one core, the head cut short; only the shorter one is a whole head on its side
    whole = nodes.where("length(head) > 1").select(F.col("node").alias("x"), F.xxhash64("kind", "core", "head").alias("key"))
    begins = F.transform(F.sequence(F.lit(2), F.length("head") - 1), lambda k: F.substring("head", F.lit(1), k))
    cut = nodes.where("length(head) > 2").select(F.col("node").alias("y"), "kind", "core", F.explode(begins).alias("begin")).select("y", F.xxhash64("kind", "core", "begin").alias("key"))
    clipped = whole.join(cut, "key").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return slips.unionAll(clipped).distinct()


def _alike(pairs: DataFrame, token: str, sizes: dict[str, float]) -> DataFrame:
    """(kind, ``token``, common): different near tokens of ``pairs`` that are one: of the nodes with the rarer of both, at least
    ``LEAST_SHARED`` beyond chance have a partner with the commoner one. Doubling all rows changes nothing."""
    c = F.col
    a, b = f"a_{token}", f"b_{token}"
    lower = (c(f"{a}_df") < c(f"{b}_df")) | ((c(f"{a}_df") == c(f"{b}_df")) & (c(a) < c(b)))
    pick = lambda x, y: F.when(lower, x).otherwise(y)
    rows = pairs.where(c(a) != c(b)).select(
        c("a_kind").alias("kind"), pick(c(a), c(b)).alias(token), pick(c(b), c(a)).alias("common"), pick(c(f"{a}_df"), c(f"{b}_df")).alias("df"), pick(c(f"{b}_df"), c(f"{a}_df")).alias("common_df"), pick(c("a"), c("b")).alias("node")
    )
    shared = rows.groupBy("kind", token, "common").agg(F.count_distinct("node").alias("shared"), F.max("df").alias("df"), F.max("common_df").alias("common_df"))
    whole = F.coalesce(*[F.when(c("kind") == kind, F.lit(n)) for kind, n in sizes.items()], F.lit(1.0))
    chance = F.least(F.lit(1.0), c("common_df") / whole)
    return shared.where(c("shared") / c("df") >= chance + LEAST_SHARED * (1 - chance)).select("kind", token, "common")


def link_names(names: DataFrame) -> DataFrame:
    """(a, b): ids of different full names (node, kind, head, core) that are spellings of one name of one kind."""
    c = F.col
    sizes = names.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("core").alias("cores"), F.count_distinct("head").alias("heads")).collect()  # two kinds
    n = F.lit(float(max(1, sum(r["n"] for r in sizes))))
    head_cores = names.groupBy("kind", "head").agg(F.count("*").alias("head_df"))
    core_heads = names.groupBy("kind", "core").agg(F.count("*").alias("core_df"))
    nodes = cut_lineage(names.join(head_cores, ["kind", "head"]).join(core_heads, ["kind", "core"]))
    side = lambda p: nodes.select(c("node").alias(p), *[c(x).alias(f"{p}_{x}") for x in ("kind", "head", "core", "head_df", "core_df")])
    pairs = _candidates(nodes).join(side("a"), "a").join(side("b"), "b")
    same_head, same_core = c("a_head") == c("b_head"), c("a_core") == c("b_core")
    clipped = same_core & (c("b_head").startswith(c("a_head")) | c("a_head").startswith(c("b_head")))
    grams = lambda x: _grams(c(x), 2)
    # two swapped letters spoil at most twice two bigrams
    overlap = F.size(F.array_intersect(grams("a_core"), grams("b_core"))) >= F.greatest(F.lit(1), F.least(F.size(grams("a_core")), F.size(grams("b_core"))) - 4)
    heads_near = same_head | clipped | ((F.least(F.length("a_head"), F.length("b_head")) >= 3) & _same_but_a_slip(c("a_head"), c("b_head")))
    cores_near = same_core | ((F.least(F.length("a_core"), F.length("b_core")) >= LEAST_CORE) & overlap & _same_but_a_slip(c("a_core"), c("b_core")))
    pairs = pairs.where((c("a_kind") == c("b_kind")) & heads_near & cores_near)
    alike = lambda t: 1 - F.levenshtein(c(f"a_{t}"), c(f"b_{t}")) / F.greatest(F.length(f"a_{t}"), F.length(f"b_{t}"), F.lit(1))
    weight = lambda t: F.log1p(n / F.least(f"a_{t}_df", f"b_{t}_df"))
    similarity = (weight("head") * F.greatest(alike("head"), F.lit(0.7)) + weight("core") * alike("core")) / (weight("head") + weight("core"))
    pairs = cut_lineage(pairs.where(similarity >= LEAST_SIMILARITY).withColumn("sure", same_head | same_core))
    for token, size in (("head", "cores"), ("core", "heads")):
        other = "core" if token == "head" else "head"
        one = _alike(pairs, token, {r["kind"]: float(r[size]) for r in sizes}).withColumn(f"{token}_ok", F.lit(True))
        low, high = F.least(f"a_{token}", f"b_{token}"), F.greatest(f"a_{token}", f"b_{token}")
        one = one.select(c("kind").alias("a_kind"), F.least(token, "common").alias("_low"), F.greatest(token, "common").alias("_high"), f"{token}_ok")
        pairs = pairs.withColumn("_low", low).withColumn("_high", high).join(one, ["a_kind", "_low", "_high"], "left").drop("_low", "_high")
    return pairs.where((same_head | c("head_ok").isNotNull()) & (same_core | c("core_ok").isNotNull())).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest id of the component of every linked node, by label propagation with shortcuts."""
    both = cut_lineage(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = labels.join(seen, "node").join(far, "label", "left")
        step = cut_lineage(step.select("node", F.col("label").alias("old"), F.least("label", "near", F.coalesce("further", "label")).alias("label")))
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels


def _filled(column: str) -> Column:
    text = F.lower(F.trim(F.col(column).cast("string")))
    return F.when(~text.isin("", "unknown", "n/a", "none"), text)


def _entities(rows: DataFrame) -> DataFrame:
    """Add ``entity`` to rows (row, label, exact, place): by exact key, else by place, else the only entity of the label."""
    # a place that rows with one exact key hold belongs to that key; a place of two keys to neither
    by_place = rows.where("exact is not null and place is not null").groupBy("label", "place").agg(F.min("exact").alias("low"), F.max("exact").alias("high"))
    keys = rows.where("exact is not null").groupBy("label", "exact").agg(F.max("place").alias("place"))
    per_label = keys.groupBy("label").agg(F.min(F.when(F.col("place").isNull(), F.col("exact"))).alias("free"), F.count_if(F.col("place").isNull()).alias("n_free"))
    out = cut_lineage(rows.join(by_place, ["label", "place"], "left").join(per_label, "label", "left"))
    # places that no exact key holds
    lone = out.where("exact is null and place is not null and low is null").groupBy("label").agg(F.min("place").alias("lone_low"), F.max("place").alias("lone_high"))
    out = out.join(lone, "label", "left")
    key = (
        F.when(F.col("exact").isNotNull(), F.col("exact"))
        .when(F.col("place").isNull(), F.lit(None).cast("string"))
        .when(F.col("low") == F.col("high"), F.col("low"))
        .when(F.col("low").isNull() & (F.col("n_free") == 1) & (F.col("lone_low") == F.col("lone_high")), F.col("free"))
        .otherwise(F.concat(F.lit("@"), "place"))
    )
    out = cut_lineage(out.select("row", "label", "exact", "place", key.alias("key")))
    sole = out.where("key is not null").groupBy("label").agg(F.min("key").alias("sole_low"), F.max("key").alias("sole_high"))
    out = out.join(sole, "label", "left")
    last = F.when(F.col("sole_low") == F.col("sole_high"), F.col("sole_low")).when(F.col("sole_low").isNull(), F.lit("?"))
    # a row of which nothing is known stays alone where its name has several owners
    key = F.coalesce("key", last, F.concat(F.lit("#"), "row"))
    return out.select("row", "exact", "place", F.concat_ws("\u0001", F.col("label").cast("string"), key).alias("entity"))


def _evidence(core: Column, head: Column, exact: Column, extra: Column, place: Column, trait: Column) -> Column:
    """What ties an abbreviated name to an entity, strongest first, as (rank, key)."""
    item = lambda rank, *parts: F.when(F.concat(*parts).isNotNull(), F.struct(F.lit(rank).alias("rank"), F.concat_ws("\u0001", core, head, *parts).alias("key")))
    items = F.array(item(1, exact), item(2, extra), item(3, place), item(4, place, trait), F.struct(F.lit(5).alias("rank"), F.concat_ws("\u0001", core, head).alias("key")))
    return F.filter(items, lambda x: x.isNotNull())


def _slip_keys(token: Column) -> Column:
    """The token with each one of its letters left out, and itself: tokens a slip apart share one of them."""
    less = F.transform(F.sequence(F.lit(1), F.length(token)), lambda k: F.concat(F.substring(token, F.lit(1), k - 1), F.substring(token, k + 1, F.length(token))))
    return F.array_distinct(F.concat(less, F.array(token)))


def _known_cores(short: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (row, core, head) with a core that no full name of their letter has put to the one known core a slip away."""
    lost = cut_lineage(short.join(known, ["core", "head"], "left_anti"))
    keys = lambda df, name: df.select("core", "head", F.explode(_slip_keys(F.col("core"))).alias("key")).withColumnRenamed("core", name)
    wanted = keys(lost.where(F.length("core") > LEAST_CORE).select("core", "head").distinct(), "core")
    near = wanted.join(keys(known.where(F.length("core") > LEAST_CORE), "other"), ["head", "key"]).where(_same_but_a_slip(F.col("core"), F.col("other")))
    sole = near.groupBy("core", "head").agg(F.min("other").alias("other"), F.max("other").alias("_high")).where("other = _high").select("core", "head", "other")
    mended = lost.join(sole, ["core", "head"], "left").select("row", F.coalesce("other", "core").alias("core"), "head")
    return short.join(known, ["core", "head"], "left_semi").select("row", "core", "head").unionAll(mended)


def link_rows(people: DataFrame, producers: DataFrame) -> DataFrame:
    """(row, entity): rows of both tables ('p' or 'h' and the id) with the entity they stand for."""
    names = _parsed(people, "people", person_tokens).withColumn("kind", F.lit("p"))
    nicks = learn_nicknames(people, names)
    names = names.join(nicks.withColumnRenamed("nick", "head"), "head", "left").withColumn("head", F.coalesce("given", "head")).drop("given")
    names = names.unionByName(_parsed(producers, "producers", learn_trades(producers).tokens).withColumn("kind", F.lit("h")))
    row = F.concat("kind", F.col("id").cast("string"))
    names = cut_lineage(names.select(row.alias("row"), "kind", "head", "core", "form", F.xxhash64("kind", "head", "core").alias("node")))

    c = F.col
    own = people.select(F.concat(F.lit("p"), c("id").cast("string")).alias("row"), _filled("birthdate").alias("exact"), _filled("location").alias("place"), _filled("phone").alias("extra"), _filled("profession").alias("trait"))
    house = producers.select(F.concat(F.lit("h"), c("id").cast("string")).alias("row"), _filled("region").alias("exact"), _filled("country").alias("place"), _filled("website").alias("extra"), F.lit(None).cast("string").alias("trait"))
    details = own.unionAll(house).dropDuplicates(["row"])

    initial = F.length("head") <= 1
    full = names.where(~initial)
    links = link_names(full.select("node", "kind", "head", "core").distinct())
    alias = full.where("form = 1").select("row", c("node").alias("y")).join(full.where("form = 0").select("row", c("node").alias("x")), "row")
    alias = alias.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    labels = components(links.unionAll(alias).distinct())
    rows = full.where("form = 0").join(labels, "node", "left").select("row", "kind", "head", "core", F.coalesce("label", "node").alias("label"))
    rows = cut_lineage(rows.join(details, "row"))
    found = cut_lineage(_entities(rows.select("row", "label", "exact", "place")).join(rows.select("row", "kind", "head", "core", "extra", "trait"), "row"))

    # initials, and houses that name no trade, join the one entity that fits; the strongest evidence that is unique decides
    kind_core = F.concat("kind", "core")
    letters = F.when(c("kind") == "p", F.array(F.substring("head", 1, 1))).otherwise(F.array(F.substring("head", 1, 1), F.lit("")))
    facts = found.select("entity", "exact", "place", "extra", "trait", kind_core.alias("core"), F.explode(letters).alias("head"))
    facts = facts.select("entity", "exact", "place", F.explode(_evidence(*[c(x) for x in ("core", "head", "exact", "extra", "place", "trait")])).alias("e"))
    unique = facts.groupBy("e.rank", "e.key").agg(F.min("entity").alias("found"), F.max("entity").alias("_high"), F.max("exact").alias("_exact"), F.max("place").alias("_place")).where("found = _high")
    short = names.where(initial & (c("form") == 0)).select("row", kind_core.alias("core"), "head")
    short = cut_lineage(_known_cores(short, found.select(kind_core.alias("core"), F.explode(letters).alias("head")).distinct()).join(details, "row"))
    asked = short.select("row", "exact", "place", F.explode(_evidence(*[c(x) for x in ("core", "head", "exact", "extra", "place", "trait")])).alias("e"))
    asked = asked.select("row", "exact", "place", "e.rank", "e.key").join(unique, ["rank", "key"])
    fits = F.coalesce(c("exact") == c("_exact"), F.lit(True)) & F.coalesce(c("place") == c("_place"), F.lit(True))
    best = asked.where((c("rank") < 5) | fits).groupBy("row").agg(F.min_by("found", "rank").alias("entity"))
    return found.select("row", "entity").unionAll(best)


def linked_pairs(people: DataFrame, producers: DataFrame) -> DataFrame:
    """(source_table, id_a, id_b): all pairs of rows that stand for one person or one house, smaller id first."""
    rows = cut_lineage(link_rows(people, producers).select(F.left("row", F.lit(1)).alias("kind"), F.expr("cast(substring(row, 2) as long)").alias("id"), "entity"))
    several = rows.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity")
    rows = rows.join(several, "entity", "left_semi")
    table = F.when(F.col("kind") == "p", F.lit("people")).otherwise(F.lit("producers"))
    other = rows.select("entity", F.col("id").alias("id_b"))
    return rows.join(other, "entity").where("id < id_b").select(table.alias("source_table"), F.col("id").alias("id_a"), "id_b")


def entity_classes(people: DataFrame, producers: DataFrame) -> DataFrame:
    """(source_table, id, entity, n_links): the class of every readable row by its smallest id, and how many others it has.

    One row an id, whatever the size of its class: the form to use where an entity may hold a large part of all rows.
    """
    rows = link_rows(people, producers).select(F.left("row", F.lit(1)).alias("kind"), F.expr("cast(substring(row, 2) as long)").alias("id"), F.col("entity").alias("key"))
    sizes = rows.groupBy("key").agg(F.min("id").alias("entity"), (F.count("*") - 1).alias("n_links"))
    table = F.when(F.col("kind") == "p", F.lit("people")).otherwise(F.lit("producers"))
    return rows.join(sizes, "key").select(table.alias("source_table"), "id", "entity", "n_links")
