"""File sources and sinks: corpus scans, notes, rules, HTML, sidecars, snapshots. [SRC04-21, SRC24, SNK01-02, SNK08-09, DML26]"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension_of, section_of


def scan(spark: SparkSession, root: str, skip: tuple[str, ...] = (".git", ".obsidian", ".trash")) -> DataFrame:
    """(path, content_hash, modified_at, ext, section, content): all indexable files under root, by relative path. [SRC04-05, SCA03]"""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = os.path.abspath(root).rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    rows = raw.select(path.alias("path"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified_at"), "content")
    rows = rows.withColumn("ext", extension_of(F.col("path"))).where("ext is not null").withColumn("section", section_of(F.col("path")))
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in skip])))


def notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, section) of the Markdown and text files, whole. [SRC07, SRC10-11]"""
    return scan(spark, root).where("ext in ('md', 'txt')").select("path", F.decode("content", "UTF-8").alias("text"), "section")


def note_list(spark: SparkSession, root: str, folder: str = "") -> DataFrame:
    """(path) of the notes under a folder, sorted; contents aren't read. [SRC12]"""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = os.path.abspath(root).rstrip("/") + "/"
    return rows.select(F.substring_index("path", base, -1).alias("path")).where(F.col("path").startswith(folder)).orderBy("path")


def inside(root: str, path: str) -> str:
    """Absolute path of a note; paths that leave the root raise. [SRC13, JOI23]"""
    full, base = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path!r} is outside of the notes")
    return full


def write_note(root: str, path: str, text: str, overwrite: bool = False) -> None:
    """[SRC14]"""
    full = inside(root, path)
    if os.path.exists(full) and not overwrite:
        raise FileExistsError(path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8") as f:
        f.write(text)


def append_note(root: str, path: str, text: str) -> None:
    """Text behind a note that must exist, after one blank line. [SRC15]"""
    full = inside(root, path)
    with open(full, encoding="utf-8") as f:
        old = f.read()
    write_note(root, path, old.rstrip("\n") + ("\n\n" if old.strip() else "") + text, overwrite=True)


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern, negated) of an ignore file, in order; comments and blank lines are skipped. [SRC06]"""
    lines = (line.strip() for line in text.splitlines())
    kept = (line for line in lines if line and not line.startswith("#"))
    return [(p[1:].rstrip("/"), True) if p.startswith("!") else (p.rstrip("/"), False) for p in kept]


def journal_path(day: str) -> str:
    """``YYYY/YYYY-MM-DD.md`` [SRC16]"""
    return f"{day[:4]}/{day}.md"


_DROPPED = frozenset("script style nav footer header aside form iframe noscript svg button".split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.title, self.meta, self.lines, self.open, self.hidden = "", {}, [], "", 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _DROPPED:
            self.hidden += 1
        elif tag == "meta" and a.get("name", "").lower() in ("description", "author"):
            self.meta[a["name"].lower()] = a.get("content") or ""
        elif tag in ("title", "h1", "h2", "h3", "h4", "p", "li", "blockquote", "td", "pre"):
            self.open = tag
            if tag != "title":
                self.lines.append([tag, ""])

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag == self.open:
            self.open = ""

    def handle_data(self, data):
        if self.hidden:
            return
        if self.open == "title":
            self.title += data
        elif self.lines and self.open:
            self.lines[-1][1] += data
        elif data.strip():
            self.lines.append(["p", data])


def html_to_markdown(html: str) -> dict[str, str]:
    """title, description, author and Markdown text of a page; scripts, styles and navigation are dropped. [SRC09, SCA36, TGF08]"""
    reader = _Reader()
    reader.feed(html)
    marks = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "li": "- ", "blockquote": "> "}
    tidy = lambda s: re.sub(r"\s+", " ", s).strip()
    lines = [marks.get(tag, "") + tidy(text) for tag, text in reader.lines if tidy(text)]
    return {"title": tidy(reader.title), "description": reader.meta.get("description", ""), "author": reader.meta.get("author", ""), "text": "\n\n".join(lines)}


def converted_html(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(id, title, description, author, text) of HTML pages. [SNK01]"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [html_to_markdown(h or "") for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], pa.string()) for k in ("title", "description", "author", "text")]], names=["id", "title", "description", "author", "text"])

    return pages.select(F.col(id_column).cast("long").alias("id"), F.col(html_column).alias("html")).mapInArrow(run, "id long, title string, description string, author string, text string")


class Snapshots:
    """Versions of tables under one folder of any Hadoop file system.

    A version is a marker file that names the folder of each table. Markers are created exclusively, so of two writers that start
    from one version the second one fails and nothing of it is seen; no lock can be left behind by a dead one. [DML26, STR08]
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"version-(\d+)\.json", n))), default=0)

    def _folders(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/version-{version}.json", wholetext=True).first()[0])

    def open(self, table: str, schema: str) -> DataFrame:
        """The table, or an empty one of the schema where the store doesn't have it yet. [SRC01-03]"""
        folder = self._folders(self.version()).get(table)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._folders(self.version())[table]}")

    def commit(self, base: int | None = None, **tables: DataFrame) -> int:
        """Write tables and make them the version after ``base`` (the current one by default); tables that aren't given stay as
        they are and are not written again. Raises where another writer was first."""
        base = self.version() if base is None else base
        folders, run = self._folders(base), uuid.uuid4().hex[:12]
        for name, df in tables.items():
            folders[name] = f"{name}-{base + 1}-{run}"
            df.write.parquet(f"{self.root}/{folders[name]}")
        try:
            out = self._fs.create(self._path(f"{self.root}/version-{base + 1}.json"), False)
        except Exception as e:
            raise RuntimeError(f"version {base + 1} was written by another writer") from e
        out.write(json.dumps(folders).encode())
        out.close()
        return base + 1


def assert_unique(df: DataFrame, *keys: str) -> None:
    """Raise where a key repeats; run before a commit."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{keys} is not unique")


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(path, record, body): front matter of notes as a map, nested values as JSON text; a block that isn't YAML gives an empty
    map. Needs PyYAML. [SRC30]"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            records = []
            for text in batch.column(1).to_pylist():
                m = re.match(r"(?s)\A---\n(.*?\n)?---(?:\n|\Z)", text or "")
                try:
                    found = yaml.safe_load(m[1] or "") if m else {}
                except yaml.YAMLError:
                    found = {}
                found = found if isinstance(found, dict) else {}
                records.append([(str(k), v if v is None or isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False)) for k, v in found.items()])
            bodies = [re.sub(r"(?s)\A---\n(.*?\n)?---(?:\n|\Z)", "", t or "", count=1) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(records, pa.map_(pa.string(), pa.string())), pa.array(bodies, pa.string())], names=["path", "record", "body"])

    return notes(spark, root).where("path like '%.md'").select("path", "text").mapInArrow(run, "path string, record map<string,string>, body string")
