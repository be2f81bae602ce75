"""Scalar functions on text, as column expressions. [SCA*]"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kind of an attachment by extension.
ATTACHMENT_KINDS = {
    "image": "jpg jpeg png gif webp heic heif bmp tiff tif svg", "audio": "mp3 m4a aac ogg opus wav flac oga", "video": "mp4 mov webm avi mkv m4v 3gp",
}
# Canonical extensions of indexable files.
EXTENSIONS = {"md": "md", "markdown": "md", "txt": "txt", "html": "html", "htm": "html", "pdf": "pdf"}


def token_estimate(text: Column) -> Column:
    """Code points divided by 4, at least 1. [SCA01]"""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text with white space collapsed, trimmed, in lower case. [SCA02]"""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def section_of(path: Column) -> Column:
    """``root`` for top-level files, ``cellar/<folder>`` below cellar, else the first folder in lower case. [SCA04]"""
    parts = F.split(path, "/")
    first = F.lower(parts[0])
    return F.when(F.size(parts) == 1, F.lit("root")).when((first == "cellar") & (F.size(parts) > 2), F.concat(F.lit("cellar/"), F.lower(parts[1]))).otherwise(first)


def extension_of(path: Column) -> Column:
    """Canonical extension, or null for files that aren't indexed. [SCA05]"""
    raw = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for written, canonical in EXTENSIONS.items():
        out = F.when(raw == written, F.lit(canonical)).otherwise(out)
    return out


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def first_heading(text: Column, fallback: Column) -> Column:
    """First level-1 heading, else the fallback. [SCA06, SCA11]"""
    found = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(fallback)


def document_date(path: Column, *written: Column) -> Column:
    """ISO date at the start of the file name, else the first written value that starts with one. [SCA07]"""
    iso = lambda c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    guarded = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), iso(c))
    return F.date_format(F.coalesce(guarded(stem(path)), *[guarded(w) for w in written]), "yyyy-MM-dd")


def fence_stripped(text: Column) -> Column:
    """Text without a surrounding Markdown code fence. [SCA10]"""
    return F.regexp_replace(F.trim(text), r"(?s)\A```\w*\s*|\s*```\z", "")


def safe_name(text: Column) -> Column:
    """File-system safe name: forbidden characters become underscores, blanks, dots and underscores at the ends go. [SCA12, SCA17]"""
    clean = F.regexp_replace(text, r'[/\x00:<>"\\|?*]', "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, r"^[ ._]+|[ ._]+$", ""), F.lit("")), F.lit("untitled"))


def producer_note_path(name: Column) -> Column:
    """[SCA13]"""
    return F.concat(F.lit("Cellar/Producer/"), safe_name(name), F.lit(".md"))


def item_note_path(kind: Column, producer: Column, name: Column) -> Column:
    """Folder by kind with a capital, then producer, then item. [SCA13]"""
    safe = safe_name(kind)
    folder = F.concat(F.upper(F.substring(safe, 1, 1)), F.lower(F.substring(safe, 2, 1_000)))
    return F.concat(F.lit("Cellar/"), folder, F.lit("/"), safe_name(producer), F.lit("/"), safe_name(name), F.lit(".md"))


def person_note_path(name: Column) -> Column:
    """``People/Last, First.md`` of a name, or ``People/Name.md`` of a single word. [SCA14]"""
    words = F.split(F.trim(name), r"\s+")
    first = F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")
    return F.concat(F.lit("People/"), F.when(F.size(words) > 1, F.concat(F.element_at(words, -1), F.lit(", "), first)).otherwise(F.trim(name)), F.lit(".md"))


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by single hyphens; null where nothing is left. [SCA15]"""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def attachment_kind(path: Column) -> Column:
    """image, audio, video or file, by extension. [SCA16]"""
    raw, out = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit("file")
    for kind, names in ATTACHMENT_KINDS.items():
        out = F.when(raw.isin(*names.split()), F.lit(kind)).otherwise(out)
    return out


def clock_24h(text: Column) -> Column:
    """``1:39 PM PDT`` as ``13:39 PDT``; 24-hour times get two digits; other texts stay. [SCA18]"""
    hour = F.regexp_extract(text, r"^(\d{1,2}):\d{2}", 1).try_cast("int")
    minute, half, zone = (F.regexp_extract(text, r"(?i)^\d{1,2}:(\d{2})(?:\s*([AP])M)?(?:\s+([A-Z]{2,4}))?\s*$", k) for k in (1, 2, 3))
    hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(F.upper(half) == "P", 12).otherwise(0))
    made = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute, F.when(zone != "", F.concat(F.lit(" "), zone)).otherwise(F.lit("")))
    return F.when(minute != "", made).otherwise(text)


def _long_day(day: Column, year: bool) -> Column:
    return F.date_format(day, "MMMM d, yyyy" if year else "MMMM d")


def days_title(days: Column) -> Column:
    """Title of a sorted array of days: a span where none is missing, else their number and the ends. [SCA27]"""
    first, last = F.element_at(days, 1), F.element_at(days, -1)
    whole = F.datediff(last, first) + 1 == F.size(days)
    span = F.concat(F.when(F.year(first) == F.year(last), _long_day(first, False)).otherwise(_long_day(first, True)), F.lit(" – "), _long_day(last, True))
    return F.when(whole, span).otherwise(F.concat(F.size(days).cast("string"), F.lit(" days, "), _long_day(first, True), F.lit(" – "), _long_day(last, True)))


def days_file(days: Column) -> Column:
    """``YYYY/pdf/...`` of a sorted array of days. [SCA27]"""
    first, last = F.element_at(days, 1).cast("string"), F.element_at(days, -1).cast("string")
    whole = F.datediff(F.element_at(days, -1), F.element_at(days, 1)) + 1 == F.size(days)
    name = F.when(F.size(days) == 1, first).when(whole, F.concat(first, F.lit("_to_"), last)).otherwise(F.concat(first, F.lit("_plus_"), (F.size(days) - 1).cast("string")))
    return F.concat(F.substring(first, 1, 4), F.lit("/pdf/"), name, F.lit(".pdf"))


def minute_of_day(text: Column) -> Column:
    """Minutes after midnight of a text that starts with HH:MM, else null. [SCA19]"""
    part = lambda k: F.regexp_extract(text, r"^(\d{1,2}):(\d{2})", k).try_cast("int")
    return part(1) * 60 + part(2)


def hour_label(hhmm: Column) -> Column:
    """``1500`` as ``3pm``, ``0`` as ``12am``. [SCA21]"""
    hour = F.floor(hhmm.cast("int") / 100)
    return F.concat(F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12).cast("string"), F.when(hour < 12, F.lit("am")).otherwise(F.lit("pm")))


def yaml_scalar(text: Column) -> Column:
    """Quoted where a YAML reader would take it for something else. [SCA37]"""
    odd = text.rlike(r"""[:#\[\]{}&*!|>'"%@`,]|^[\s?-]|\s$""")
    return F.when(odd, F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text)


def conversion_state(source_hash: Column, stored_hash: Column) -> Column:
    """convert, unchanged or stale, of a source and the hash kept in its converted sidecar. [SCA38-39]"""
    return F.when(stored_hash.isNull(), F.lit("convert")).when(stored_hash == source_hash, F.lit("unchanged")).otherwise(F.lit("stale"))


def flag(text: Column) -> Column:
    """yes/no, true/false, 1/0 as a boolean, else null. [SCA40]"""
    low = F.lower(F.trim(text))
    return F.when(low.isin("yes", "true", "1", "y"), F.lit(True)).when(low.isin("no", "false", "0", "n"), F.lit(False))


def speaker_label(sender: Column, agent: Column, owner: str) -> Column:
    """Name shown for a message: unknown senders are marked, agents carry their name. [SCA45]"""
    known = F.coalesce(F.nullif(F.trim(sender), F.lit("")), F.lit("unknown"))
    return F.when(F.lower(known) == owner.lower(), known).when(agent.isNotNull() & (agent != "main"), F.concat(known, F.lit(" ("), agent, F.lit(")"))).otherwise(known)


def without_metadata_blocks(text: Column, names: tuple[str, ...] = ("system-reminder", "metadata", "context")) -> Column:
    """Text without ``<name> ... </name>`` blocks that start a line. [SCA47]"""
    tags = "|".join(names)
    return F.trim(F.regexp_replace(text, rf"(?ms)^<({tags})>.*?</\1>\s*", ""))


def sparse_text(text: Column, pages: Column) -> Column:
    """Whether an extracted document has fewer than 100 characters a page. [FLT26]"""
    return F.length(F.trim(text)) < 100 * F.greatest(pages, F.lit(1))


def embedded_number(text: Column, pattern: str) -> Column:
    """First group of ``pattern`` as a number, 0 where there is none. [SRT09, SCA44]"""
    return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("int"), F.lit(0))
