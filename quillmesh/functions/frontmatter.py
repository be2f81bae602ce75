"""Front matter of notes: reading, setting and rendering fields. [SCA28-33, SCA58, SET06-07]"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block(text: Column) -> Column:
    """Raw text between the fences at the very start, or null. [SCA28]"""
    return F.when(text.rlike(r"(?s)\A---\n(.*?\n)?---(\n|\z)"), F.regexp_extract(text, r"(?s)\A---\n(.*?\n)?---(\n|\z)", 1))


def body(text: Column) -> Column:
    """Text behind the front matter."""
    return F.regexp_replace(text, r"(?s)\A---\n(.*?\n)?---(\n|\z)", "")


def scalars(text: Column) -> Column:
    """Map of the ``key: value`` lines of the block; a repeated key keeps its last value. [SCA29]"""
    lines = F.filter(F.split(F.coalesce(block(text), F.lit("")), "\n"), lambda x: x.rlike(r"^\w+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("k"), F.trim(F.regexp_replace(x, r"^\w+:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def get_field(text: Column, name: str) -> Column:
    """Value of one field, trimmed, or null. [SCA33]"""
    return F.nullif(F.trim(F.regexp_extract(block(text), rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


def list_field(text: Column, name: str) -> Column:
    """Items of an inline list or of a block of dashes, without quotes; an empty list where the field is missing. [SCA30, SCA32]"""
    raw = F.coalesce(block(text), F.lit(""))
    inline = F.regexp_extract(raw, rf"(?m)^{name}:[ \t]*\[(.*)\][ \t]*$", 1)
    dashed = F.regexp_extract(raw, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[ \t]+.*\n?)+)", 1)
    tidy = lambda items: F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")), lambda x: x != "")
    from_dashes = F.transform(F.split(dashed, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]*-[ \t]+", ""))
    return F.when(inline != "", tidy(F.split(inline, ","))).otherwise(tidy(from_dashes))


def people_field(text: Column) -> Column:
    """``people`` as structs (name, id): items are ``Name`` or ``Name (id)``. [SCA31]"""
    parse = lambda x: F.struct(F.trim(F.regexp_replace(x, r"\s*\(\d+\)$", "")).alias("name"), F.regexp_extract(x, r"\((\d+)\)$", 1).try_cast("long").alias("id"))
    return F.transform(list_field(text, "people"), parse)


def set_field(text: Column, name: str, value: Column) -> Column:
    """Text with one field replaced, or added as the last line of the block; a note without a block gets one. [SCA33]"""
    line = F.concat(F.lit(f"{name}: "), value)
    has = block(text).rlike(rf"(?m)^{name}:")
    marked = F.regexp_replace(block(text), rf"(?m)^{name}:.*$", "\u0000")
    changed = F.when(has, F.replace(marked, F.lit("\u0000"), line)).otherwise(F.concat(F.coalesce(block(text), F.lit("")), line, F.lit("\n")))
    return F.concat(F.lit("---\n"), changed, F.lit("---\n"), F.when(block(text).isNull(), text).otherwise(body(text)))


def with_item(items: Column, item: Column) -> Column:
    """List with the item appended unless it is there. [SET06]"""
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))


def tags_csv(text: Column) -> Column:
    """Tags joined by commas, an empty text where there are none. [SCA08]"""
    listed = F.array_join(list_field(text, "tags"), ",")
    plain = F.coalesce(get_field(text, "tags"), F.lit(""))
    return F.when((listed == "") & ~plain.startswith("["), plain).otherwise(listed)


def set_list(text: Column, name: str, items: Column) -> Column:
    """Text with a list field replaced by an inline list, whatever form it had. [SET07, DML22]"""
    dashes = F.regexp_replace(block(text), rf"(?m)^{name}:[ \t]*\n(?:[ \t]*-[ \t]+.*\n?)+", f"{name}: []\n")
    flat = F.when(block(text).isNull(), text).otherwise(F.concat(F.lit("---\n"), dashes, F.lit("---\n"), body(text)))
    return set_field(flat, name, inline_list(items))


def add_to_list(text: Column, name: str, item: Column) -> Column:
    """Text with an item in a list field; one that is there already changes nothing. [SET06, DML22, SCA57]"""
    return F.when(F.array_contains(list_field(text, name), item), text).otherwise(set_list(text, name, with_item(list_field(text, name), item)))


def migrated_people(text: Column) -> Column:
    """Text with ``people`` as an inline list of ``Name`` or ``Name (id)``; texts without the field stay. [DML21]"""
    shown = F.transform(people_field(text), lambda p: F.when(p["id"].isNull(), p["name"]).otherwise(F.concat(p["name"], F.lit(" ("), p["id"].cast("string"), F.lit(")"))))
    return F.when(F.coalesce(block(text).rlike("(?m)^people:"), F.lit(False)), set_list(text, "people", shown)).otherwise(text)


def inline_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def opted_out(text: Column) -> Column:
    """Whether the front matter asks not to be indexed. [FLT20]"""
    return F.coalesce(F.lower(get_field(text, "embed")).isin("false", "no", "off", "0"), F.lit(False))


def new_header(day: Column) -> Column:
    """Front matter of a new day file. [SCA58, SCA20]"""
    return F.concat(F.lit("---\ndate: "), F.date_format(day, "yyyy-MM-dd"), F.lit("\nday: "), F.date_format(day, "EEEE"), F.lit("\ntags: []\npeople: []\n---\n\n"))
