"""Ordered conversations from single message rows.

Each thread is exported in fragments: runs of messages of one thread and one time bucket without a long pause, together with the
messages of the last ``gap`` before the bucket, so that a conversation that crosses the border is the end of one fragment and the
beginning of another. ``overlap_links`` knows nothing of threads and buckets: it sees fragments as sequences of message hashes and
finds every pair in which a suffix of one is a prefix of the other. That is the overlap graph. Where a fragment has several
predecessors or successors, nothing is merged; unambiguous paths are merged by pointer doubling. A fragment that begins with
borrowed messages but has no predecessor left has a gap, and its conversation is dropped like those that are broken.

Message hashes are made of the content (thread, instant, sender, digest of the text). Texts are never shuffled. No task sorts more
than one bucket of one thread, so one thread may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

GAP_MINUTES = 60
BUCKET_HOURS = 6
ROLES = {"user": 1, "assistant": 2, "system": 3}


def speaker_roles(messages: DataFrame, speakers: DataFrame) -> DataFrame:
    """Add ``role`` by sender: trimmed, lower-cased, without a final part in round brackets; unknown senders have none."""
    label = F.lower(F.trim(F.regexp_replace(F.trim("sender"), r"\s*\([^()]*\)\s*$", "")))
    roles = speakers.select(F.col("label").alias("_label"), F.col("speaker_role").alias("role")).dropDuplicates(["_label"])
    return messages.withColumn("_label", label).join(roles, "_label", "left").drop("_label")


def _broken_json(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.coalesce(trimmed.startswith('{"type"') & F.try_parse_json(trimmed).isNull(), F.lit(False))


def with_digests(rows: DataFrame, fragment: str = "fragment", pos: str = "pos") -> DataFrame:
    """Add ``n`` (messages of the fragment) and ``digest`` to rows (fragment, pos, hash): at each place the sum of the hashes of all
    neighbouring pairs up to there. As messages are different, the pairs, the first and the last of a sequence give its order."""
    along = Window.partitionBy(fragment).orderBy(pos)
    pair = F.shiftrightunsigned(F.xxhash64(F.lag("hash").over(along), "hash"), 24)
    rows = rows.withColumn("_pair", F.when(F.col(pos) > 1, pair).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("digest", F.sum("_pair").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(fragment))).drop("_pair")


def overlap_links(rows: DataFrame) -> DataFrame:
    """(up, down): fragments of which a suffix of ``up`` equals a prefix of ``down``, message by message.

    ``rows`` has (fragment, pos from 1, hash, n, digest). The first hash of ``down`` finds the suffixes it may continue; length,
    last message and the digest of the order in between decide.
    """
    firsts = rows.where("pos = 1").select(F.col("fragment").alias("down"), "hash")
    lasts = rows.where("pos = n").select(F.col("fragment").alias("up"), F.col("hash").alias("last_hash"), F.col("digest").alias("total"))
    starts = rows.select(F.col("fragment").alias("up"), "hash", (F.col("n") - F.col("pos") + 1).alias("length"), F.col("digest").alias("before"))
    maybe = starts.join(firsts, "hash").where("up <> down").join(lasts, "up")
    maybe = maybe.select("up", "down", F.col("length").alias("pos"), F.col("last_hash").alias("hash"), (F.col("total") - F.col("before")).alias("digest"))
    return maybe.join(rows.select(F.col("fragment").alias("down"), "pos", "hash", "digest"), ["down", "pos", "hash", "digest"]).select("up", "down").distinct()


def merged_paths(links: DataFrame) -> DataFrame:
    """(fragment, head): the first fragment of the path of every fragment with a predecessor. Links of fragments with several
    predecessors or successors are left out; what is on a ring has no first fragment and is left out, too."""
    several_up = links.groupBy("down").agg(F.count("*").alias("k")).where("k > 1").select("down")
    several_down = links.groupBy("up").agg(F.count("*").alias("k")).where("k > 1").select("up")
    sole = links.join(several_up, "down", "left_anti").join(several_down, "up", "left_anti")
    paths = cut_lineage(sole.select(F.col("down").alias("fragment"), F.col("up").alias("head")))
    left = paths.count()
    moved, steps = True, 1
    while moved and steps <= 2 * max(1, left):
        higher = paths.select(F.col("fragment").alias("head"), F.col("head").alias("_next"))
        jumped = cut_lineage(paths.join(higher, "head", "left").select("fragment", F.coalesce("_next", "head").alias("head"), F.col("_next").isNotNull().alias("_moved")))
        paths = jumped.select("fragment", "head")
        moved, steps = not jumped.where("_moved").isEmpty(), 2 * steps
    return paths if not moved else jumped.where("not _moved").select("fragment", "head")


def rebuild_conversations(messages: DataFrame, speakers: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """(conv_id, turn, message_id, role) of all whole conversations.

    ``messages`` has id, chat, instant (timestamp_ntz; rows without one are left out), ms, sender, text and photos. A null
    chat is a thread of its own. Copies (equal chat, instant, sender and text) count once, as their smallest id.
    """
    c = F.col
    bucket_ms, gap_ms = BUCKET_HOURS * 3_600_000, gap_minutes * 60_000
    at = (F.unix_date(c("instant").cast("date")).cast("long") * 86_400_000 + (F.hour("instant") * 3600 + F.minute("instant") * 60 + F.second("instant")) * 1000 + c("ms").cast("int")).cast("long")
    blank = F.coalesce(~c("text").rlike(r"\S"), F.lit(True))
    has_photos = F.coalesce(F.size("photos") > 0, F.lit(False))
    rows = speaker_roles(messages.where("instant is not null").select("id", "chat", at.alias("at"), "sender", "text", "photos"), speakers)
    role = F.coalesce(*[F.when(c("role") == name, F.lit(code)) for name, code in ROLES.items()], F.lit(0))
    rows = rows.select("chat", "at", "sender", F.md5("text").alias("text_digest"), role.alias("role"), blank.alias("blank"), _broken_json(c("text")).alias("broken"), (c("id") * 2 + has_photos.cast("int")).alias("_id_photos"))
    # one row per different message, with the photos of the copy that is kept
    rows = rows.groupBy("chat", "at", "sender", "text_digest").agg(F.min("_id_photos").alias("_kept"), F.max("role").alias("role"), F.max("blank").alias("blank"), F.max("broken").alias("broken"))
    left = (c("role") != ROLES["system"]) & ~(c("blank") & (c("_kept") % 2 == 0))
    rows = rows.select("chat", "at", F.shiftright("_kept", 1).alias("id"), F.xxhash64("chat", "at", "sender", "text_digest").alias("hash"), "role", (c("broken") | (c("role") == 0)).alias("bad"), left.alias("left"))

    # fragments: the messages of a bucket and, borrowed, those of the last `gap` before it
    bucket = F.floor(c("at") / bucket_ms).cast("long")
    rows = rows.withColumn("bucket", bucket).withColumn("own", F.explode(F.when(c("at") >= (c("bucket") + 1) * bucket_ms - gap_ms, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    rows = rows.withColumn("bucket", F.when(c("own"), c("bucket")).otherwise(c("bucket") + 1))
    in_order = Window.partitionBy("chat", "bucket").orderBy("at", "id")
    pause = F.coalesce((c("at") - F.lag("at").over(in_order) > gap_ms).cast("int"), F.lit(1))
    rows = rows.withColumn("_start", pause).withColumn("run", F.sum("_start").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("chat", "bucket", "run")
    rows = rows.withColumn("fragment", F.min(F.when(c("own"), c("id"))).over(in_run)).withColumn("pos", F.row_number().over(in_run.orderBy("at", "id")).cast("long"))
    rows = rows.where("fragment is not null").select("fragment", "bucket", "pos", "id", "hash", "role", "bad", "left", "own")
    rows = cut_lineage(with_digests(rows))

    links = cut_lineage(overlap_links(rows.select("fragment", "pos", "hash", "n", "digest")))
    mine = c("own") & c("left")
    runs = rows.groupBy("fragment").agg(
        F.min("bucket").alias("bucket"), F.max(c("own") & c("bad")).alias("bad"), F.count_if(mine).alias("n_left"), F.max((c("pos") == 1) & ~c("own")).alias("borrows"),
        F.min_by("id", F.when(mine, c("pos"))).alias("first_id"), F.min_by("role", F.when(mine, c("pos"))).alias("first_role"), F.max_by("role", F.when(mine, c("pos"))).alias("last_role"),
    )
    runs = runs.join(merged_paths(links), "fragment", "left")
    # a fragment that goes on from another one which can't be told has a gap
    runs = runs.withColumn("bad", c("bad") | (c("borrows") & c("head").isNull())).withColumn("conv", F.coalesce("head", "fragment"))
    runs = cut_lineage(runs.select("fragment", "conv", "bucket", "bad", "n_left", "first_id", "first_role", "last_role"))
    place = F.when(c("n_left") > 0, c("bucket"))
    whole = runs.groupBy("conv").agg(F.max("bad").alias("bad"), F.min_by("first_id", place).alias("conv_id"), F.min_by("first_role", place).alias("opens"), F.max_by("last_role", place).alias("closes"))
    whole = whole.where(~c("bad") & (c("opens") == ROLES["user"]) & (c("closes") == ROLES["assistant"])).select("conv", "conv_id")
    # turns: position within the fragment after the messages of the fragments before it
    along = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("n_left").over(along), F.lit(0))).join(whole, "conv").select("fragment", "conv_id", "_before")
    kept = rows.where(mine).select("fragment", "pos", "id", "role").join(runs, "fragment")
    turn = c("_before") + F.row_number().over(Window.partitionBy("fragment").orderBy("pos")) - 1
    names = F.coalesce(*[F.when(c("role") == code, F.lit(name)) for name, code in ROLES.items()])
    return kept.select("conv_id", turn.cast("long").alias("turn"), c("id").alias("message_id"), names.alias("role"))


def with_texts(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """Turns with the text of their message."""
    return turns.join(messages.select(F.col("id").alias("message_id"), "text"), "message_id").select("conv_id", "turn", "message_id", "role", "text")
