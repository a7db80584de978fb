from datetime import datetime, timezone

from pyspark.sql import functions as F

from barloom.operators.timestamps import agreed_instant, normalize_timestamps

FEEDS = [("paris", "Europe/Paris", "dmy"), ("ny", "America/New_York", "mdy"), ("paris", "Europe/Paris", "dmy"), (None, "UTC", "dmy")]
UTC = timezone.utc


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000 + micro


def run(spark, rows, **policy):
    feeds = spark.createDataFrame(FEEDS, "feed_id string, home_zone string, date_order string")
    # extra columns that bear names of the operator's own steps
    df = spark.createDataFrame([(i, f, t, r) for i, (f, t, r) in enumerate(rows)], "id int, feed_id string, text string, received_at timestamp")
    df = df.withColumns({"_zone": F.lit("x"), "home_zone": F.lit(1), "zone": F.lit(2), "_t0": F.lit(3)})
    out = normalize_timestamps(df, feeds, {"text": None}, **policy)
    assert out.columns == [*df.columns, "text_instant"]
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows) and all(r["_zone"] == "x" and r["_t0"] == 3 for r in got.values())
    return [(got[i]["text_instant"].utc_us, got[i]["text_instant"].status) if got[i]["text_instant"] else None for i in range(len(rows))]


def test_formats(spark):
    at = us(2021, 3, 4, 5, 6, 7)
    cases = {
        "2021-03-04T05:06:07Z": at, "2021-03-04 05:06:07 UTC": at, " \t2021-03-04 05:06:07.250+00:00\n": at + 250_000, "20210304T050607Z": at,
        "1614834367": at, "1614834367.5": at + 500_000, "1614834367000": at, "1614834367000001": at + 1, "1614834367000001999": at + 1, "1.614834367000E12": at,
        "Thu, 04 Mar 2021 05:06:07 GMT": at, "2021-03-04T06:06+0100": us(2021, 3, 4, 5, 6), "2021-03-04T06:06:07[Europe/Paris]": at, "2021-03-04 06:06:07 CET": at,
        "04/03/2021 06:06:07": at, "4 Mar 2021 06:06:07": at, "Mar 4, 2021 6:06:07 AM": at, "04.03.2021 06:06": us(2021, 3, 4, 5, 6), "20210304060607": at, "2021-03-04 06:06:07,123": at + 123_000,
        "Mar 4, 2021 12:00:00 AM": us(2021, 3, 3, 23), "2021-03-04 13:06:07 +08": at, "2021-03-04T06:06:07.1234567": at + 123_456,
    }
    got = run(spark, [("paris", t, datetime(2022, 1, 1)) for t in cases])
    assert {t: g[0] for t, g in zip(cases, got)} == cases


def test_unreadable_and_blank(spark):
    texts = ["soon", "2023-02-30 08:00:00", "2024-05-17 25:61:00", "2024-13-05T04:00:00Z", "-", "12345", "2021-03-04 05:06:07 XYZ", "13/13/2021 00:00:00", "2021-03-04T05:06:07[Mars/Base]", "9" * 30000, "1e999", "13:00 PM"]
    got = run(spark, [("paris", t, None) for t in texts])
    assert all(g is not None and g[0] is None for g in got)
    assert run(spark, [("paris", None, None), ("paris", "", None), ("paris", "  \n", None)]) == [None] * 3


def test_day_and_month_by_feed(spark):
    got = run(spark, [("paris", "02/03/2021 00:00:00", None), ("ny", "02/03/2021 00:00:00", None)])
    assert [g[0] for g in got] == [us(2021, 3, 1, 23), us(2021, 2, 3, 5)]


def test_clock_changes(spark):
    early, late = us(2021, 10, 31, 0, 30), us(2021, 10, 31, 1, 30)
    text = "2021-10-31 02:30:00"
    rows = [("paris", text, datetime(2021, 10, 31, 0, 45)), ("paris", text, datetime(2021, 10, 31, 2)), ("paris", text, None), ("paris", text + " CEST", None), ("paris", text + " CET", None), ("paris", "2021-03-28 02:30:00", None)]
    got = run(spark, rows)
    assert [g[0] for g in got] == [early, late, late, early, late, None]
    assert [g[1] for g in got] == ["ambiguous"] * 3 + ["exact"] * 2 + ["skipped"]
    assert run(spark, rows[:1], ambiguous="later")[0][0] == late and run(spark, rows[1:2], ambiguous="earlier")[0][0] == early
    assert run(spark, rows[1:2], ambiguous="null")[0][0] is None
    assert run(spark, rows[5:], nonexistent="shift")[0][0] == us(2021, 3, 28, 1, 30)


def test_zones_without_a_slash_and_changed_abbreviations(spark):
    feeds = spark.createDataFrame([("jp", "Japan", "dmy"), ("est", "EST5EDT", "mdy"), ("msk", "Europe/Moscow", "dmy")], "feed_id string, home_zone string, date_order string")
    texts = [("jp", "2021-03-04 09:00:00"), ("est", "2021-07-04 08:00:00"), ("msk", "2012-06-01 12:00:00 MSK"), ("msk", "2016-06-01 12:00:00 MSK"), ("msk", "2009-01-01 12:00:00 MSK"), ("msk", "2014-10-26 01:30:00 MSK"), ("msk", "2014-10-26 01:30:00")]
    df = spark.createDataFrame([(i, f, t, datetime(2022, 1, 1)) for i, (f, t) in enumerate(texts)], "id int, feed_id string, text string, received_at timestamp")
    got = [(r.text_instant.utc_us, r.text_instant.status) for r in normalize_timestamps(df, feeds, {"text": None}).orderBy("id").collect()]
    assert got == [
        (us(2021, 3, 4, 0), "zoned"), (us(2021, 7, 4, 12), "zoned"), (us(2012, 6, 1, 8), "exact"), (us(2016, 6, 1, 9), "exact"), (us(2009, 1, 1, 9), "exact"),
        (us(2014, 10, 25, 22, 30), "ambiguous"), (us(2014, 10, 25, 22, 30), "ambiguous"),  # both instants are MSK, at four and at three hours
    ]
    assert run(spark, [("paris", "2021-03-04 09:00:00[Japan]", None)])[0] == (us(2021, 3, 4, 0), "zoned")


def test_unknown_source(spark):
    got = run(spark, [(None, "2021-03-04 05:06:07", None), ("other", "2021-03-04 05:06:07", None), ("other", "2021-03-04T05:06:07Z", None)])
    assert [g[1] for g in got] == ["no_zone", "no_zone", "exact"]


def test_empty_table_and_agreement(spark):
    feeds = spark.createDataFrame([], "feed_id string, home_zone string, date_order string")
    df = spark.createDataFrame([], "feed_id string, text string, received_at timestamp")
    assert normalize_timestamps(df, feeds, {"text": "UTC"}).count() == 0
    one = lambda us_, status: F.struct(F.lit(us_).cast("bigint").alias("utc_us"), F.lit(status).alias("status"), F.lit("x").alias("pattern"))
    row = spark.range(1).select(agreed_instant([one(5_000_000, "ambiguous"), one(None, "unreadable"), one(7_000_000, "exact"), one(7_000_001, "exact")]).alias("a"), agreed_instant([one(None, "skipped")]).alias("b")).first()
    assert row.a == 7_000_001 and row.b is None
