import datetime
import random

from pyspark.sql import functions as F

from quillmesh.llm import conversations
from quillmesh.llm.conversations import merged_paths, overlap_links, rebuild_conversations, with_digests

SCHEMA = "id long, chat string, instant timestamp_ntz, ms string, sender string, text string, photos array<string>, at long, role string"
BASE = datetime.datetime(2024, 1, 1, 5, 0)


def brute(rows):
    roles = {"me": "user", "bot": "assistant", "sys": "system"}
    kept = {}
    for i, chat, at, ms, sender, text, photos, *_ in sorted(rows, key=lambda r: r[0]):
        if at is not None:
            kept.setdefault((chat, at, ms, sender, text), (i, photos))
    chats = {}
    for (chat, at, ms, sender, text), (i, photos) in kept.items():
        chats.setdefault(chat, []).append((at + datetime.timedelta(milliseconds=int(ms)), i, sender, text, photos))
    out = set()
    for msgs in chats.values():
        msgs.sort(key=lambda m: m[:2])
        groups = []
        for m in msgs:
            if groups and m[0] - groups[-1][-1][0] <= datetime.timedelta(minutes=60):
                groups[-1].append(m)
            else:
                groups.append([m])
        for g in groups:
            role = lambda s: roles.get(s.split(" (")[0].strip().lower()) if s else None
            broken = any(role(m[2]) is None or (m[3] or "").strip().startswith('{"type"') and not m[3].strip().endswith("}") for m in g)
            left = [m for m in g if role(m[2]) != "system" and ((m[3] or "").strip() or m[4])]
            if left and not broken and role(left[0][2]) == "user" and role(left[-1][2]) == "assistant":
                out |= {(left[0][1], k, m[1]) for k, m in enumerate(left)}
    return out


def run(spark, rows):
    speakers = spark.createDataFrame([("me", "user"), ("bot", "assistant"), ("sys", "system")], "label string, speaker_role string")
    found = [(r.conv_id, r.turn, r.message_id) for r in rebuild_conversations(spark.createDataFrame(rows, SCHEMA), speakers).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_random_threads_against_brute_force(spark):
    rng, rows, at = random.Random(5), [], {}
    for i in range(1500):
        chat = rng.choice(["a", "a", "a", "b", None])
        at[chat] = at.get(chat, BASE) + datetime.timedelta(minutes=rng.choice([0, 1, 7, 30, 59, 60, 61, 300]))
        text = rng.choice(["hi", "yes", " ", None, '{"type": "x"}', '{"type": "x', "ok"]) if rng.random() < 0.3 else f"t{i}"
        sender = rng.choice(["me", "Me (app)", " bot ", "bot", "bot", "sys", None]) if rng.random() < 0.3 else rng.choice(["me", "bot"])
        rows.append((i, chat, at[chat], rng.choice(["000", "250"]), sender, text, rng.choice([None, [], ["p.jpg"]]), 7, "clash"))
        if rng.random() < 0.05:
            rows.append((5000 + i, *rows[-1][1:]))
    rows.append((9999, "a", None, None, "me", "no time", None, None, None))
    assert run(spark, rows) == brute(rows)


def test_a_conversation_over_many_borders(spark):
    rows = [(i, "long", BASE + datetime.timedelta(minutes=50 * i), "000", "me" if i % 2 == 0 else "bot", f"m{i}", None, None, None) for i in range(100)]
    assert run(spark, rows) == brute(rows) and len(run(spark, rows)) == 100


def test_empty(spark):
    assert run(spark, []) == set()


def sequences(spark, **fragments):
    rows = [(name, k, hash(("m", h)) % 10**12) for name, hs in fragments.items() for k, h in enumerate(hs, 1)]
    return with_digests(spark.createDataFrame(rows, "fragment string, pos long, hash long"))


def test_overlaps_by_message_hashes(spark):
    rows = sequences(spark, a="abcde", b="defg", c="gh", d="xdefg", e="dexfg", f="edq", lone="z")
    links = overlap_links(rows)
    # "f" has its messages in another order and shares the last one of "a" only; all of "b" is the end of "d"
    assert {tuple(r) for r in links.collect()} == {("a", "b"), ("a", "e"), ("a", "f"), ("d", "b"), ("b", "c"), ("d", "c"), ("e", "c")}
    # every link here touches a fragment with several partners
    assert merged_paths(links).collect() == []
    clean = overlap_links(sequences(spark, a="abcde", b="defg", c="gh", d="hijk", e="kl"))
    assert {tuple(r) for r in merged_paths(clean).collect()} == {("b", "a"), ("c", "a"), ("d", "a"), ("e", "a")}
    # a wrong hash breaks the chain there
    broken = overlap_links(sequences(spark, a="abcde", b="dXfg", c="gh", d="hijk", e="kl"))
    assert {tuple(r) for r in merged_paths(broken).collect()} == {("c", "b"), ("d", "b"), ("e", "b")}
    ring = overlap_links(sequences(spark, a="abc", b="cda"))
    assert merged_paths(ring).collect() == []


def test_a_changed_hash_drops_the_conversation(spark, monkeypatch):
    rows = [(i, "long", BASE + datetime.timedelta(minutes=50 * i), "000", "me" if i % 2 == 0 else "bot", f"m{i}", None, None, None) for i in range(40)]
    assert len(run(spark, rows)) == 40
    make = conversations.with_digests
    crossing = {i for i in range(40) if (BASE + datetime.timedelta(minutes=50 * i)).hour % 6 == 5}
    assert crossing
    monkeypatch.setattr(conversations, "with_digests", lambda df: make(df.withColumn("hash", F.when(F.col("id").isin(*crossing) & ~F.col("own"), F.col("hash") + 1).otherwise(F.col("hash")))))
    # what begins with borrowed messages that no fragment ends with has a gap; the first fragment doesn't
    assert run(spark, rows) == {(0, 0, 0), (0, 1, 1)}
