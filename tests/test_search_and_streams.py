import sqlite3

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import search
from quillmesh.sources import external, files
from quillmesh.streaming.tail import parsed_records, tail, write_jsonl

TEXTS = [(1, "barrel cellar barrel", "A"), (2, "the cellar of the oak barrel", None), (3, "oak", "barrel"), (4, "cellar", "cellar barrel oak oak"), (5, None, None), (6, "", "")]


def test_bm25_like_sqlite(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content, heading)")
    con.executemany("INSERT INTO f(rowid, content, heading) VALUES (?, ?, ?)", TEXTS)
    texts = spark.createDataFrame(TEXTS, "id long, content string, heading string")
    for q in ("cellar barrel", "oak", '"oak barrel"', "none"):
        want = {r[0]: -r[1] for r in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (q,))}
        got = {r.id: r.score for r in search.bm25(texts, "id", ("content", "heading"), q, 10).collect()}
        assert got == pytest.approx(want, abs=1e-9)
    for malformed in ('what?', 'a "b', "it's", "a AND", ""):
        assert search.bm25(texts, "id", ("content",), malformed, 5).count() == 0


def test_fusion_order_and_filter(spark):
    leg = lambda *ids: spark.createDataFrame([(i, k) for k, i in enumerate(ids, 1)], "id long, rank int")
    fused = search.fuse(leg(1, 2), leg(2, 3), 10).collect()
    assert [r.id for r in fused] == [2, 1, 3] and fused[0].score == pytest.approx(1 / 62 + 1 / 61)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, section string")
    assert [r.id for r in search.hybrid(leg(1, 2), leg(2, 3), rows, 1, F.col("section") == "a").collect()] == [1]
    assert search.hybrid(leg(2), leg(2), rows, 1, F.col("section") == "a").count() == 0


def test_nearest_rows_and_excerpts(spark):
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [float("nan"), 0.0])], "id long, v array<double>")
    assert [(r.id, r.rank) for r in search.nearest_rows(vectors, "id", "v", [0.0, 1.0], 5).collect()] == [(1, 1), (2, 2)]
    texts = spark.createDataFrame([(1, "a\nb\nHIT\nc\nd\ne"), (2, "none"), (3, "a(b")], "id long, t string")
    assert {r.id: r.excerpt for r in search.regex_excerpts(texts, "id", "t", "hit").collect()} == {1: "a\nb\nHIT\nc\nd"}
    assert search.regex_excerpts(texts, "id", "t", "a(b").count() == 1


def message(role, content, at="2024-01-01T10:00:00Z", kind="message"):
    return {"type": kind, "timestamp": at, "message": {"role": role, "content": content}}


def test_tail_resumes_and_waits_for_whole_lines(spark, tmp_path):
    log, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    (tmp_path / "in").mkdir()
    write_jsonl(f"{log}/a.jsonl", [message("user", "hello"), message("tool", "x"), message("user", "  ", "t"), message("assistant", [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b"}])])
    with open(f"{log}/a.jsonl", "a") as f:
        f.write('{"type": "message", "time')  # torn

    def run():
        rows = parsed_records(tail(spark, f"{log}/*.jsonl"))
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r.role, r.text) for r in spark.read.parquet(out).collect())

    assert run() == [("assistant", "a\n\nb"), ("user", "hello")]
    with open(f"{log}/a.jsonl", "a") as f:
        f.write('stamp": "2024", "message": {"role": "user", "content": "late"}}\nnot json\n')
    assert run() == [("assistant", "a\n\nb"), ("user", "hello"), ("user", "late")]
    assert len(run()) == 3


def test_files_and_snapshots(spark, tmp_path):
    root = str(tmp_path / "notes")
    files.write_note(root, "Journal/2024-01-01.md", "# Hi\n")
    files.append_note(root, "Journal/2024-01-01.md", "more")
    files.write_note(root, ".git/x.md", "no")
    files.write_note(root, "b.bin", "no")
    with pytest.raises(FileExistsError):
        files.write_note(root, "b.bin", "again")
    with pytest.raises(ValueError):
        files.inside(root, "../notes2/x")
    found = files.scan(spark, root).collect()
    assert [(r.path, r.ext, r.section) for r in found] == [("Journal/2024-01-01.md", "md", "journal")]
    assert files.notes(spark, root).first()["text"] == "# Hi\n\nmore"
    assert files.ignore_rules("# c\n\nA*/\n!A/k\n") == [("A*", False), ("A/k", True)]
    store = files.Snapshots(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.commit(t=spark.range(3)) == 1 and store.read("t").count() == 3
    with pytest.raises(ValueError):
        files.assert_unique(spark.createDataFrame([(1,), (1,)], "id long"), "id")
    page = files.html_to_markdown("<html><title>T</title><meta name='author' content='A'><script>x</script><h1>H</h1><p>a <b>b</b></p><ul><li>c</li></ul></html>")
    assert (page["title"], page["author"], page["text"]) == ("T", "A", "# H\n\na b\n\n- c")


def test_adapters(spark):
    lines = spark.createDataFrame([('{"id": "1", "content": "c", "due": {"date": "2024-01-01"}}',), ('{"id": "2", "labels": ["x"], "project_id": "p"}',), ("junk",)], "json string")
    rows = external.tasks(lines).where("id is not null")
    assert external.select_tasks(rows, label="x").first()["matching"] == 1 and external.due(rows, "2024-01-02", overdue=True).first()["id"] == "1"
    aliases = spark.createDataFrame([("New York", "America/New_York"), ("York", "Europe/London"), ("Berlin", "Europe/Berlin")], "alias string, zone string")
    asked = spark.createDataFrame([("york",), ("berlin mitte",), ("new york city",), ("mars",)], "query string")
    assert {r.query: r.zone for r in external.resolved_locations(asked, aliases).collect()} == {"york": "Europe/London", "berlin mitte": "Europe/Berlin", "new york city": None, "mars": None}
    vectors = external.embedded(spark.createDataFrame([("a b",), (None,)], "t string"), "t").collect()
    assert len(vectors[0].embedding) == 64 and vectors[1].embedding is None
