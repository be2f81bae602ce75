import json

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import frontmatter, text
from quillmesh.operators import daily, indexing, inventory, people, relations
from quillmesh.plans import jobs
from quillmesh.sources import external, files


def test_people(spark):
    rows = spark.createDataFrame([(1, "Ann", None), (2, "Bob", "M")], "id long, name string, gender string")
    assert json.loads(people.as_json(rows).where("id = 1").first()["record"]) == {"id": 1, "name": "Ann"}
    more = people.add(rows, spark.createDataFrame([("Zoe",), ("Ann",), ("ann",), ("Zoe",)], "name string"))
    assert {(r.id, r.name) for r in more.collect()} == {(1, "Ann"), (2, "Bob"), (3, "Zoe"), (4, "ann")}
    edges = spark.createDataFrame([(1, 3), (2, 3), (1, 4), (3, 5)], "parent long, child long")
    assert [tuple(r) for r in people.common_ancestors(edges, 5, 4).collect()] == [(1, 2, 1)]
    with pytest.raises(ValueError):
        people.of_sort(spark.createDataFrame([], "relative_is string, inferred boolean"), "x'; drop")
    items = spark.createDataFrame([("Red", "R1"), ("None", "R2"), ("No", "no")], "name string, expression string")
    prose = spark.createDataFrame([("Red", "a"), ("R2", "b")], "title string, text string")
    assert {r.name: r.prose for r in people.with_prose(items, prose).collect()} == {"Red": "a", "None": "b", "No": None}
    aliases = people.learn_alias(spark.createDataFrame([("Home", "Europe/Berlin"), ("work", "UTC")], "alias string, zone string"), "home", "Asia/Tokyo")
    assert {tuple(r) for r in aliases.collect()} == {("work", "UTC"), ("home", "Asia/Tokyo")}
    links = spark.createDataFrame([("a.jpg",), ("[[a]]",), ("![[a]]",)], "p string").select(people.embed_link(F.col("p"))).collect()
    assert [r[0] for r in links] == ["![[a.jpg]]", "![[a]]", "![[a]]"]


def test_index_runs(spark, tmp_path):
    store = files.Snapshots(spark, str(tmp_path / "store"))
    assert store.open("files", "id long").count() == 0
    schema = "path string, content_hash string, text string"
    first = spark.createDataFrame([("a.md", "1", "# A\nhello there"), ("b.md", "2", "second")], schema)
    embed = lambda df: external.embedded(df, "content")
    run = lambda df: {r.status: r.n for r in jobs.index_run(store, df.select("path", "content_hash"), df.select("path", "text"), embed).collect()}
    assert run(first) == {"new": 2}
    assert run(first) == {"unchanged": 2} and store.read("chunks").count() == 2
    ids = {r.path: r.id for r in store.read("files").collect()}
    later = spark.createDataFrame([("c.md", "1", "# A\nhello there"), ("d.md", "4", "new one")], schema)
    assert run(later) == {"moved": 1, "deleted": 1, "new": 1}
    found = {r.path: r.id for r in store.read("files").collect()}
    assert found["c.md"] == ids["a.md"] and set(found) == {"c.md", "d.md"} and store.read("chunks").count() == 2
    assert jobs.enrich_run(store, lambda texts: ['{"n": 1}' for _ in texts], most=1) == 1
    assert jobs.enrich_run(store, lambda texts: 1 / 0) == 0


def test_reports_and_adapters(spark, tmp_path):
    mails = spark.createDataFrame([(i, f"2024-01-0{i}") for i in range(1, 8)], "id long, at string")
    top = jobs.digest(mails).collect()
    assert [r.id for r in top] == [7, 6, 5, 4, 3] and top[0].more == 2
    entries = spark.createDataFrame([(1, 1, "10:00", "b"), (1, 0, "09:00", "a<b")], "id long, pos int, time string, text string")
    assert jobs.day_pages(entries).first()["html"] == "<h2>09:00</h2><p>a&lt;b</p>\n<h2>10:00</h2><p>b</p>"
    assert [r.line for r in jobs.calendar_lines(spark.createDataFrame([(2, "x"), (None, "y")], "day int, item string")).collect()] == ["- Day 0: y", "- Day 2: x"]
    assert jobs.dry_run({"a": mails}) == {"a": 7}
    rows = external.looked_up(mails, "at", lambda xs: [x[-1] for x in xs], "last").select("last", external.first_known("last", "at").alias("k")).collect()
    assert [r.last for r in rows][:2] == ["1", "2"]
    failed = external.looked_up(mails, "at", lambda xs: 1 / 0, "last").where("last is not null").count()
    assert failed == 0
    task = "id string, content string"
    changes = external.changed_tasks(spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], task), spark.createDataFrame([("1", "a"), ("2", "B"), ("4", "d")], task))
    assert {r.id: r.action for r in changes.collect()} == {"2": "update", "3": "complete", "4": "create"}
    pytest.importorskip("yaml")
    root = str(tmp_path / "n")
    files.write_note(root, "P/a.md", "---\nname: X\nbottles:\n  - name: B\n---\nbody")
    files.write_note(root, "P/b.md", "---\nname: [\n---\nbody")
    found = {r.path: (r.record, r.body) for r in files.catalogue(spark, root).collect()}
    assert found["P/a.md"] == ({"name": "X", "bottles": '[{"name": "B"}]'}, "body") and found["P/b.md"][0] == {}
    out = []
    spark.createDataFrame([("p",)], "path string").write.parquet(str(tmp_path / "src"), mode="overwrite")
    stream = spark.readStream.schema("path string").parquet(str(tmp_path / "src"))
    q = jobs.notify(stream, out.extend, str(tmp_path / "ck"))
    assert q.awaitTermination(60) and out == [{"path": "p"}] and jobs.progress(q)["active"] is False


def test_person_by_part_of_the_name(spark):
    rows = spark.createDataFrame([(1, "Greta Kosbalatlow"), (2, "Gretel Wolf"), (12, "Ann")], "id long, name string")
    assert people.resolve_person(rows, "kosba").first()["id"] == 1 and people.resolve_person(rows, 12).first()["name"] == "Ann"
    with pytest.raises(LookupError, match="1 Greta Kosbalatlow.*2 Gretel Wolf"):
        people.resolve_person(rows, "gret")
    with pytest.raises(LookupError, match="No person"):
        people.resolve_person(rows, "nobody")


def test_items_and_tastings(spark):
    items = spark.createDataFrame([("Red", 1, None, None), ("White", 1, 3, "wishlist")], "name string, producer_id long, quantity int, status string")
    assert [(r.quantity, r.status) for r in inventory.checked_items(items).orderBy("name").collect()] == [(1, "in-cellar"), (3, "wishlist")]
    with pytest.raises(Exception, match="bad item"):
        inventory.checked_items(items.withColumn("status", F.lit("lost"))).collect()
    events = spark.createDataFrame([(4, 1, "2024-01-01", 80)], "id long, bottle_id long, tasted_at string, rating int")
    new = spark.createDataFrame([(1, "2024-02-01", 90), (2, None, None)], "bottle_id long, tasted_at string, rating int")
    stock = spark.createDataFrame([(1, 70), (2, 60)], "id long, rating int")
    rated, all_events = inventory.rate(stock, events, new)
    assert {(r.id, r.rating) for r in rated.collect()} == {(1, 90), (2, 60)} and {(r.id, r.bottle_id) for r in all_events.collect()} == {(4, 1), (5, 1), (6, 2)}
    for bad in ((1, "2024-02-30", 50), (1, "2024-02-01", 101)):
        with pytest.raises(Exception):
            inventory.add_events(events, spark.createDataFrame([bad], "bottle_id long, tasted_at string, rating int")).collect()


def test_two_writers_of_one_version(spark, tmp_path):
    store = files.Snapshots(spark, str(tmp_path / "store"))
    base = store.commit(a=spark.range(3), b=spark.range(5))
    assert store.commit(base, a=spark.range(4)) == 2 and store.read("b").count() == 5 and store.read("a").count() == 4
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(base, a=spark.range(9))
    assert store.version() == 2 and store.read("a").count() == 4


def test_note_lists_and_titles(spark):
    note = "---\ndate: 2024-01-02\ntags:\n- a\n- b\npeople:\n- Ann Cole (3)\n- Bob\n---\nBody\n"
    row = spark.createDataFrame([(note,)], "t string").select(
        frontmatter.tags_csv(F.col("t")).alias("csv"), frontmatter.set_list(F.col("t"), "tags", F.array(F.lit("x"))).alias("set"), frontmatter.add_to_list(F.col("t"), "tags", F.lit("a")).alias("same"),
        frontmatter.migrated_people(F.col("t")).alias("people"), text.days_title(F.sequence(F.lit("2023-12-30").cast("date"), F.lit("2024-01-02").cast("date"))).alias("title"),
        text.days_file(F.array(F.lit("2024-01-02").cast("date"), F.lit("2024-01-09").cast("date"))).alias("file"), daily.template_labels(F.lit("x\n- [x] one \n- two\n-three\n")).alias("labels"),
    ).first()
    assert row.csv == "a,b" and row.same == note and row.set == "---\ndate: 2024-01-02\ntags: [x]\npeople:\n- Ann Cole (3)\n- Bob\n---\nBody\n"
    assert "people: [Ann Cole (3), Bob]\n" in row.people and row.title == "December 30, 2023 – January 2, 2024" and row.file == "2024/pdf/2024-01-02_plus_1.pdf" and row.labels == ["one", "two"]


def test_integrity_exempts_inferred_edges(spark):
    edges = spark.createDataFrame([(1, 1, 2, "cousin", True), (2, 1, 2, "cousin", False), (3, 1, 9, "friend", False), (4, 2, 3, "parent", None), (5, 3, 2, "parent", True)], "id long, person_id long, relative_id long, relative_is string, inferred boolean")
    everyone = spark.createDataFrame([(1, "M"), (2, "X"), (3, "NB")], "id long, gender string")
    issues = relations.integrity_issues(edges, everyone)
    assert {(r.issue, r.item_id) for r in issues.collect()} == {("missing_reciprocal", 2), ("unknown_type", 2), ("conflicting_direction", 4), ("orphan", 3), ("missing_gender", 2)}
    assert tuple(relations.integrity_verdict(issues).first()) == (4, 1, False)


def test_paragraph_window_bounds():
    assert indexing.window_bounds([100, 300, 200, 600, 50], 500, 200) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert indexing.window_bounds([300, 150, 150, 400], 500, 200) == [(0, 2), (1, 3), (2, 4)] and indexing.window_bounds([], 500, 200) == []
