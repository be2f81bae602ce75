"""A streaming source that tails growing JSONL files by byte offsets, and the parsing of chat session records. [STR01-05, SRC21-22, FLT28, SCA47-48]

Offsets are kept per file in the query's checkpoint. A batch never ends inside a line, so a torn last line is read once it is
whole; a file that shrank is read again from its start. Rows carry (file, byte_offset), a key for idempotent sinks.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, byte_offset long, line string"
MOST_BYTES = 64 << 20  # of one file in one batch


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for file in sorted(glob.glob(self.pattern)):
            out[file] = os.path.getsize(file)
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = []
        for file, size in end.items():
            begin = start.get(file, 0)
            begin = 0 if begin > size else begin
            for low in range(begin, size, MOST_BYTES):
                ranges.append(_Range(file, low, min(size, low + MOST_BYTES)))
        return ranges

    def read(self, partition: _Range) -> Iterator[tuple]:
        # A range owns the lines that end inside it; a line that began before is completed by looking back.
        with open(partition.file, "rb") as f:
            low = partition.start
            while low > 0:
                step = min(low, 1 << 16)
                f.seek(low - step)
                cut = f.read(step).rfind(b"\n")
                if cut >= 0:
                    low = low - step + cut + 1
                    break
                low -= step
            f.seek(low)
            while low < partition.end:
                line = f.readline()
                if not line.endswith(b"\n") or low + len(line) > partition.end:
                    return
                yield partition.file, low, line[:-1].decode("utf-8", "replace")
                low += len(line)


class TailSource(DataSource):
    """``spark.readStream.format("jsonl_tail").load("/folder/*.jsonl")``"""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _TailReader:  # noqa: N802
        return _TailReader(self.options)


def tail(spark: SparkSession, pattern: str) -> DataFrame:
    """Streaming rows (file, byte_offset, line) of all files that match."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("jsonl_tail").load(pattern)


def text_of(content: str | list | None) -> str:
    """Text of a message's content: a string, or the text parts of a list joined by blank lines. [SCA48]"""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n\n".join(p.get("text", "") for p in content if isinstance(p, dict) and p.get("type") == "text" and p.get("text"))
    return ""


def parsed_records(lines: DataFrame, kickoff: str = "A new session was started") -> DataFrame:
    """(file, byte_offset, at, role, text) of the user and assistant messages among session records.

    Other record types and roles, blank texts, records without a time, lines that aren't JSON and the synthetic first message
    are left out. Runs inside the JVM, the same on batch and streaming rows. [FLT28, STR05]
    """
    v = F.try_parse_json("line")
    rows = lines.withColumn("_v", v).where("_v is not null")
    get = lambda p, t="string": F.try_variant_get("_v", p, t)
    parts = F.try_variant_get("_v", "$.message.content", "array<struct<type:string,text:string>>")
    kept = F.filter(parts, lambda p: (p["type"] == "text") & (F.coalesce(p["text"], F.lit("")) != ""))
    joined = F.array_join(F.transform(kept, lambda p: p["text"]), "\n\n")
    plain = F.when(F.schema_of_variant(F.try_variant_get("_v", "$.message.content", "variant")) == "STRING", get("$.message.content"))
    out = rows.select("file", "byte_offset", get("$.timestamp").alias("at"), get("$.type").alias("kind"), get("$.message.role").alias("role"), F.trim(F.coalesce(plain, joined)).alias("text"))
    good = (F.col("kind") == "message") & F.col("role").isin("user", "assistant") & F.col("at").isNotNull() & (F.coalesce("text", F.lit("")) != "")
    return out.where(good & ~F.col("text").startswith(kickoff)).drop("kind")


def write_jsonl(path: str, records: list[dict]) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)
