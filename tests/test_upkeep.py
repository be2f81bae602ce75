import datetime

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import daily, upkeep


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)).select(column).first()[0]


def test_entries_are_inserted_in_time_order(spark):
    day = F.lit("2024-01-02").cast("date")
    new = upkeep.with_entry(F.col("t"), day, F.lit("10:00 CET"), F.lit("now"))
    text = "---\ndate: 2024-01-02\n---\n\n## 09:00 CET\na\n\n## 11:00 CET\nb\n"
    assert value(spark, new, t=text) == "---\ndate: 2024-01-02\n---\n\n## 09:00 CET\na\n\n## 10:00 CET\nnow\n\n## 11:00 CET\nb\n"
    late = upkeep.with_entry(F.col("t"), day, F.lit("23:00 CET"), F.lit("late"))
    assert value(spark, late, t=text).endswith("b\n\n## 23:00 CET\nlate\n")
    assert value(spark, new, t=None) == "---\ndate: 2024-01-02\nday: Tuesday\ntags: []\npeople: []\n---\n\n## 10:00 CET\nnow\n"


def test_metadata_and_days(spark):
    text = "---\npeople: [Ann (3), Bob]\ntags: [x, y, x]\ndate: 2024-05-01T10\nregion: Douro\n---\n"
    got = value(spark, upkeep.derived_metadata(F.col("t"), F.lit("cellar/wine")), t=text)
    assert (got.people, got.topics, got.dates_mentioned) == (["Ann", "Bob"], ["x", "y", "wine", "Douro"], ["2024-05-01"])
    assert value(spark, upkeep.derived_metadata(F.col("t"), F.lit("work")), t=text) is None
    d = lambda n: datetime.date(2024, 1, n)
    assert value(spark, upkeep.days_of_spec(F.col("t")), t="2024-01-05..2024-01-03, 2024-01-04 ,2024-01-01") == [d(1), d(3), d(4), d(5)]
    for bad in ("2024-01-05..x", "", "2024-13-01"):
        with pytest.raises(Exception):
            value(spark, upkeep.days_of_spec(F.col("t")), t=bad)
    assert value(spark, upkeep.last_days(F.lit("2024-01-02").cast("date"), 2), t="") == [d(1), d(2)]
    local = value(spark, upkeep.local_time(F.col("t").cast("timestamp_ntz"), F.lit("Asia/Kolkata")), t="2024-01-01 20:00:00")
    assert tuple(local) == ("2024-01-02", "01:30", 330)


def test_mail_and_prose(spark):
    raw = spark.createDataFrame([(1, "From: a\n\n<p>Tom &amp;\n Ann</p>"), (2, None)], "id long, t string")
    rows = {r.id: (r.header, r.body) for r in upkeep.mail_text(raw, "id", "t").collect()}
    assert rows[1] == ("From: a", "Tom & Ann") and rows[2] == (None, None)
    body = "# House\nold place\n\n## Red\nNotes: dark\n\n## White\n\n## Rosé\nlight\nfresh\n"
    assert value(spark, upkeep.prose_by_heading(F.col("t")), t=body) == {"Red": "dark", "Rosé": "light\nfresh"}
    assert value(spark, upkeep.opening_prose(F.col("t")), t=body) == "old place"
    assert value(spark, upkeep.derived_status(F.col("t"), F.lit("2")), t="no") == "consumed" and value(spark, upkeep.derived_status(F.col("t"), F.lit(None)), t=None) == "in-cellar"
    assert value(spark, upkeep.iso_day(F.col("t")), t="2024-02-30") is None


def test_records_and_reattribution(spark):
    records = spark.createDataFrame([({"name": "n", "age": " 12 ", "score": "90", "odd": "x", "blank": " "},)], "r map<string,string>")
    row = upkeep.split_records(records, "r", {"age": "years"}, {"score": "rating"}).first()
    assert (row.item, row.event, row.leftover) == ({"years": "12"}, {"rating": "90"}, ["odd: x"])
    producers = spark.createDataFrame([(1, "Calendar"), (2, "Real")], "id long, name string")
    items = spark.createDataFrame([(10, 1, "Day 1 Real Dry"), (11, 1, "Day 2 New"), (12, 2, "dry"), (13, 1, "Day 3")], "id long, producer_id long, name string")
    parses = spark.createDataFrame([(10, "Real", "Dry", 1), (11, "New House", None, 2), (13, None, None, 3)], "id long, producer string, item string, day int")
    left, houses, tastings = upkeep.reattribute(items, producers, parses)
    assert {(r.id, r.producer_id, r.name) for r in left.collect()} == {(11, 3, "New House"), (12, 2, "dry"), (13, 1, "Day 3")}
    assert {(r.id, r.name) for r in houses.collect()} == {(1, "Calendar"), (2, "Real"), (3, "New House")}
    assert {tuple(r) for r in tastings.collect()} == {(12, "Calendar", "Day 1"), (11, "Calendar", "Day 2")}


def test_attachments_and_weather(spark):
    day = datetime.date(2024, 1, 2)
    rows = spark.createDataFrame([("a.JPG", day, "10:00:00", "My Dog!"), ("b.jpg", day, "10:00:00", "my dog"), ("c", day, "10:00:00", None)], "path string, day date, clock string, title string")
    found = {r.path: (r.kind, r.name) for r in upkeep.attachment_rows(rows).collect()}
    assert found == {"a.JPG": ("image", "2024-01-02-100000-my-dog.jpg"), "b.jpg": ("image", "2024-01-02-100000-my-dog-1.jpg"), "c": ("file", "2024-01-02-100000.bin")}
    hours = [(day, h, t, r, 0.0, p, w, g, d) for h, t, r, p, w, g, d in [(0, 1.0, 5.0, 0.1, 3.0, 4.0, "N"), (3, 9.0, 40.0, 0.2, 7.0, 20.0, "S"), (6, 9.0, 0.0, 0.0, 5.0, 6.0, "S")]]
    df = spark.createDataFrame(hours, "day date, hour int, temp double, rain double, snow double, precip double, wind double, gust double, direction string")
    r = upkeep.weather_line(daily.weather_day(df, "day")).first()
    assert (r.max_hour, r.min_hour, r.direction, r.precipitation, r.wind_text) == (3, 0, "S", 'Rain: 40%, 0.30"', "3–7mph (gusts 20mph)")
    notes = spark.createDataFrame([(day, "seen ☀ today")], "day date, t string")
    days = spark.createDataFrame([(day,), (datetime.date(2024, 1, 3),)], "day date")
    assert upkeep.to_log(days, notes, "day", "t", ("☀",)).count() == 1 and upkeep.to_log(days, notes, "day", "t", ("☀",), force=True).count() == 2
    block = upkeep.record_block("item", id=F.lit(3), name=F.lit(None).cast("string"))
    assert value(spark, block, t="") == "---\nkind: item\nid: 3\n---\n\n"
