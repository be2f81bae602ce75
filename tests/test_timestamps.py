import pytest
from pyspark.sql import functions as F

from quillmesh.operators.timestamps import ZoneRules, normalize_times

CASES = [
    # value, date, normal
    ("2023-01-01T15:37:45.012Z", None, "2023-01-01T15:37:45.012Z"),
    ("2022-12-31T22:07:51-08:00", None, "2023-01-01T06:07:51.000Z"),
    ("2023-01-01T03:23:20.079692-08:00", None, "2023-01-01T11:23:20.079Z"),
    ("2023-01-01 07:00:38", None, "2023-01-01T15:00:38.000Z"),
    ("1672552563", "junk", "2023-01-01T05:56:03.000Z"),
    ("1672607971331", None, "2023-01-01T21:19:31.331Z"),
    ("20230104T131923Z", None, "2023-01-04T13:19:23.000Z"),
    ("20230104", None, "2023-01-04"),
    ("01.02.2023 03:25:23", None, "2023-02-01T11:25:23.000Z"),
    ("03/21/2025", None, "2025-03-21"),
    ("Sat, 31 Dec 2022 22:12:37 -0800", None, "2023-01-01T06:12:37.000Z"),
    ("Thu, 18 September 2025", None, "2025-09-18"),
    ("October 27, 2023 13:16:45 WEST", None, "2023-10-27T12:16:45.000Z"),
    ("2023-01-02 05:30:35 America/Los_Angeles", None, "2023-01-02T13:30:35.000Z"),
    ("2023-01-02 05:30:35 Europe/Nowhere", None, None),
    ("21:32 PST", "2023-01-01", "2023-01-02T05:32:00.000Z"),
    ("5:13 PM PDT", "01/15/2023", "2023-01-16T00:13:00.000Z"),
    ("12:05 AM PDT", "2023-06-01", "2023-06-01T07:05:00.000Z"),
    ("16:43", "20230110", "2023-01-11T00:43:00.000Z"),
    ("16:43", None, None),
    ("16:43", "2023-01-01 10:00", None),
    # twice: the first; skipped: the offset from before
    ("2025-11-02 01:30:00", None, "2025-11-02T08:30:00.000Z"),
    ("2023-03-12 02:30:00", None, "2023-03-12T10:30:00.000Z"),
    # the owner's zone changes
    ("2025-02-01 12:00:00", None, "2025-02-01T06:30:00.000Z"),
    ("1999-01-01 12:00:00", None, None),
    ("25:71 PDT", "2023-01-01", None), ("13:75", "2023-01-01", None), ("2025-02-30T10:00:00Z", None, None), ("13:10 PM", "2023-01-01", None),
    ("yesterday 9ish", None, None), ("spring 2024", None, None), ("", "2023-01-01", None), (None, None, None), ("  2024-02-29 ", None, "2024-02-29"),
    ("2023-02-29", None, None), ("x" * 50_000, None, None),
]


@pytest.fixture(scope="module")
def rules(spark):
    home = spark.createDataFrame([("2005-01-01", "America/Los_Angeles"), ("2025-01-11", "Asia/Kolkata"), ("2025-03-01", "America/Los_Angeles")], "valid_from string, iana_zone string")
    names = spark.createDataFrame([("UTC", 0), ("PST", -480), ("PDT", -420), ("WEST", 60), (None, None)], "abbreviation string, utc_offset_minutes int")
    return ZoneRules.load(spark, home, names)


def test_formats(spark, rules):
    df = spark.createDataFrame([(i, v, d, "kept") for i, (v, d, _) in enumerate(CASES)], "id int, value string, date string, normal string")
    out = {r.id: r.normal for r in normalize_times(df, "value", rules, "date").collect()}
    wrong = [(CASES[i], n) for i, n in out.items() if n != CASES[i][2]]
    assert not wrong and len(out) == len(CASES)


def test_default_zone_and_empty(spark, rules):
    df = spark.createDataFrame([("2023-01-01 07:00:38",)], "v string")
    assert normalize_times(df, "v", rules, default_zone="UTC").first()["normal"] == "2023-01-01T07:00:38.000Z"
    assert normalize_times(df.where(F.lit(False)), "v", rules).count() == 0


def test_lookup_must_be_small(spark):
    many = spark.range(2000).select(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("valid_from"), F.lit("UTC").alias("iana_zone"))
    with pytest.raises(ValueError):
        ZoneRules.load(spark, many, spark.createDataFrame([], "abbreviation string, utc_offset_minutes int"))
