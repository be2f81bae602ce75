import datetime

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import frontmatter as fm
from quillmesh.functions import text as tx
from quillmesh.operators import chat, daily, indexing, inventory

NOTE = "---\ndate: 2024-05-01\ntags: [a, 'b c']\npeople: [Ann (3), Bob]\nsize: 1\nsize: 2\n---\n\n## 09:05 CET\nFirst\n![pic](photos/a.jpg)\n\n## Not a time\nmore\n## 16:13 CET\nSecond\n"


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return df.select(column).first()[0]


def test_front_matter(spark):
    t = F.col("t")
    assert value(spark, fm.get_field(t, "date"), t=NOTE) == "2024-05-01"
    assert value(spark, fm.list_field(t, "tags"), t=NOTE) == ["a", "b c"]
    assert value(spark, fm.list_field(t, "tags"), t="---\ntags:\n  - x\n  - \"y\"\n---\nbody") == ["x", "y"]
    assert value(spark, fm.list_field(t, "none"), t=NOTE) == []
    assert [(p.name, p.id) for p in value(spark, fm.people_field(t), t=NOTE)] == [("Ann", 3), ("Bob", None)]
    assert value(spark, fm.scalars(t), t=NOTE)["size"] == "2"
    changed = value(spark, fm.set_field(t, "date", F.lit("2024-06-02")), t=NOTE)
    assert changed == NOTE.replace("2024-05-01", "2024-06-02")
    assert value(spark, fm.set_field(t, "mood", F.lit("fine")), t="plain") == "---\nmood: fine\n---\nplain"
    assert value(spark, fm.body(t), t=NOTE).startswith("\n## 09:05") and value(spark, fm.block(t), t="no fence") is None
    assert value(spark, fm.opted_out(t), t="---\nembed: No\n---\n") is True and value(spark, fm.opted_out(t), t=NOTE) is False


def test_scalars(spark):
    c = F.col("t")
    for text, want in (("1:39 PM PDT", "13:39 PDT"), ("12:00 AM PDT", "00:00 PDT"), ("12:30 PM PDT", "12:30 PDT"), ("7:14 PDT", "07:14 PDT"), ("soon", "soon")):
        assert value(spark, tx.clock_24h(c), t=text) == want
    assert value(spark, tx.token_estimate(c), t="") == 1 and value(spark, tx.token_estimate(c), t="é" * 2004) == 501
    assert value(spark, tx.section_of(c), t="Cellar/Red/a.md") == "cellar/red" and value(spark, tx.section_of(c), t="a.md") == "root"
    assert value(spark, tx.first_heading(c, F.lit("x")), t="a\n## no\n# Yes it is\n") == "Yes it is"
    assert value(spark, tx.document_date(c, F.lit("2020-02-30"), F.lit("2020-02-03T10")), t="a/note.md") == "2020-02-03"
    assert value(spark, tx.document_date(c), t="a/2024-01-02.md") == "2024-01-02"
    assert value(spark, tx.safe_name(c), t=" a/b:c.. ") == "a_b_c" and value(spark, tx.safe_name(c), t="///") == "untitled"
    assert value(spark, tx.item_note_path(c, F.lit("A/B"), F.lit("x")), t="red WINE") == "Cellar/Red wine/A_B/x.md"
    assert value(spark, tx.person_note_path(c), t="Ann B Cole") == "People/Cole, Ann B.md"
    assert value(spark, tx.slug(c), t="Ab -- c!") == "ab-c" and value(spark, tx.slug(c), t="!!") is None
    assert value(spark, tx.hour_label(c), t="1500") == "3pm" and value(spark, tx.hour_label(c), t="0") == "12am"
    assert value(spark, tx.fingerprint(c), t=" A  b\n") == value(spark, tx.fingerprint(c), t="a B")
    assert value(spark, tx.fence_stripped(c), t="```json\n{}\n```") == "{}"
    assert value(spark, tx.without_metadata_blocks(c), t="<metadata>\nx\n</metadata>\nhello") == "hello"
    assert value(spark, tx.yaml_scalar(c), t="a: b") == '"a: b"' and value(spark, tx.yaml_scalar(c), t="plain") == "plain"


def test_checklists(spark):
    text = "# x\n## Priorities\n- [ ] Call & ask (twice)\n- [x] Done\n\n## 10:00 CET\n- [ ] other\n"
    items = value(spark, daily.priorities(F.col("t")), t=text)
    assert [(i.done, i.task) for i in items] == [(False, "Call & ask (twice)"), (True, "Done")]
    assert value(spark, daily.rendered(daily.priorities(F.col("t"))), t=text) == "- [ ] Call & ask (twice)\n- [x] Done"
    assert value(spark, daily.priorities(F.col("t")), t="## Priorities\n") == [] and value(spark, daily.priorities(F.col("t")), t="none") == []
    new = F.split(F.lit("Done|New"), r"\|")
    assert [(i.done, i.task) for i in value(spark, daily.set_items(daily.priorities(F.col("t")), new), t=text)] == [(True, "Done"), (False, "New")]
    assert [i.task for i in value(spark, daily.add_items(daily.priorities(F.col("t")), new), t=text)] == ["Call & ask (twice)", "Done", "New"]
    assert [i.done for i in value(spark, daily.mark(daily.priorities(F.col("t")), "call"), t=text)] == [True, True]
    with pytest.raises(Exception, match="No priority matching"):
        value(spark, daily.mark(daily.priorities(F.col("t")), "zebra"), t=text)
    inserted = value(spark, daily.with_priorities(F.col("t"), daily.checklist_items(F.lit("- [ ] A"))), t=NOTE)
    assert "---\n\n## Priorities\n- [ ] A\n\n\n## 09:05" in inserted and inserted.endswith("Second\n")


def test_completion(spark):
    day = lambda n: datetime.date(2024, 1, n)
    rows = [(day(1), 0, True, "a"), (day(1), 1, False, "b"), (day(3), 0, False, "b"), (day(3), 1, False, "c")]
    items = spark.createDataFrame(rows, "day date, pos int, done boolean, task string")
    assert tuple(daily.range_completion(items, "2024-01-31", "2024-01-01").first()) == (2, 4, 1, 3, 0.25)
    assert tuple(daily.range_completion(items, "2023-01-31", "2023-01-01").first()) == (0, 0, 0, 0, None)
    assert [tuple(r) for r in daily.frequently_open(items).collect()] == [("b", 2)]
    later = items.unionAll(spark.createDataFrame([(day(2), 0, False, "z")], items.schema))
    assert {tuple(r) for r in daily.rollover(later).collect()} == {(day(2), 1, "b"), (day(3), 0, "z")}


def test_journal_and_chat(spark):
    notes = spark.createDataFrame([(1, NOTE), (2, None), (3, "")], "id long, t string")
    entries = daily.journal_entries(notes, "id", "t").orderBy("pos").collect()
    assert [(e.time, e.minute, e.photos) for e in entries] == [("09:05 CET", 545, [("pic", "a.jpg")]), ("16:13 CET", 973, [])]
    assert "Not a time" in entries[0].text and "pic" not in entries[0].text
    assert [tuple(r) for r in daily.day_photos(daily.journal_entries(notes, "id", "t")).collect()] == [(1, "09:05 CET", "pic", "a.jpg")]
    day = "lost\n## 10:00 CET\n**Ann:** hi ![[p.jpg]]\nmore\n\n**Bob:** yes\n## 11:00 CET\n**Ann:** bye\n"
    found = chat.parse_day_files(spark.createDataFrame([("d", day)], "k string, t string"), "k", "t").orderBy("pos").collect()
    assert [(m.time, m.sender, m.text, m.photos) for m in found] == [("10:00 CET", "Ann", "hi\nmore", ["p.jpg"]), ("10:00 CET", "Bob", "yes", []), ("11:00 CET", "Ann", "bye", [])]
    messages = spark.createDataFrame([("É vero", "2024-01-01", "Ann")], "text string, day string, sender string")
    assert chat.search(messages, "é VERO").count() == 1 and chat.search(messages, "").count() == 0


def test_index_diff_and_chunks(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("e", "3"), ("f", "5")], "path string, content_hash string")
    status = lambda df: {r.path or r.old_path: r.status for r in df.collect()}
    diff = indexing.scan_diff(old, new)
    assert status(diff) == {"a": "unchanged", "b": "updated", "e": "moved", "f": "new", "d": "deleted"}
    assert set(status(indexing.scan_diff(new, new)).values()) == {"unchanged"}
    files = old.withColumn("id", F.ascii("path").cast("long"))
    chunks = files.select(F.col("id").alias("file_id"))
    kept, left = indexing.apply_diff(files, diff, chunks)
    assert {r.path for r in kept.collect()} == {"a", "b", "e"} and {r[0] for r in left.collect()} == {ord("a"), ord("c")}
    long = "## Only two\n" + "word " * 300 + "\n\n" + "word " * 300 + "\n\n" + "end " * 50
    pieces = indexing.markdown_chunks(long)
    assert len(pieces) == 2 and all(h == "# Only two" for h, _ in pieces)
    assert indexing.markdown_chunks("x" * 2003) == [("", "x" * 2003)] and indexing.markdown_chunks("") == []
    assert indexing.paragraph_windows("\n\n".join(["a" * 1200, "b" * 1200, "c" * 400]))[1].startswith("b" * 1200)
    rules = [("A*", False), ("A/keep.md", True)]
    paths = spark.createDataFrame([("A/x.md",), ("A/keep.md",), ("B/Ax",), ("B/y",)], "path string")
    assert {r.path: r.ignored for r in indexing.ignored(paths, rules).collect()} == {"A/x.md": True, "A/keep.md": False, "B/Ax": True, "B/y": False}


def test_inventory(spark):
    producers = spark.createDataFrame([(1, "Casa A"), (2, "casa b"), (3, "É")], "id long, name string")
    items = spark.createDataFrame([(10, 1, "Red", 2, "cellar"), (11, 2, "red", 1, "cellar"), (12, 2, "White", 0, "cellar")], "id long, producer_id long, name string, quantity int, status string")
    events = spark.createDataFrame([(1, 10), (2, 11), (3, 11)], "id long, bottle_id long")
    assert inventory.find_by_name(producers, "CASA _", "name").count() == 2 and inventory.find_by_name(producers, "é", "name").count() == 0
    with pytest.raises(LookupError):
        inventory.resolve(producers, "none")
    assert inventory.resolve(producers, "CASA A").first()["id"] == 1 and inventory.resolve(producers, 2).first()["name"] == "casa b"
    p, i, e = inventory.merge_producers(producers, items, events, spark.createDataFrame([(2, 1)], "old long, new long"))
    assert {r.id for r in p.collect()} == {1, 3} and {(r.id, r.producer_id) for r in i.collect()} == {(10, 1), (12, 1)} and {(r.id, r.bottle_id) for r in e.collect()} == {(1, 10), (2, 10), (3, 10)}
    after = {r.id: (r.quantity, r.status) for r in inventory.consume(inventory.consume(items, 11), 12).collect()}
    assert after == {10: (2, "cellar"), 11: (0, "consumed"), 12: (0, "consumed")}
    more = inventory.upsert(producers, spark.createDataFrame([("CASA A",), ("New",)], "name string"))
    assert {(r.id, r.name) for r in more.collect()} == {(1, "Casa A"), (2, "casa b"), (3, "É"), (4, "New")}
    assert {r.id for r in inventory.without_events(items.withColumnRenamed("id", "bottle_id"), events, "bottle_id").select(F.col("bottle_id").alias("id")).collect()} == {12}
