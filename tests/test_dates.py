"""Lenient dates by form, and arithmetic on them."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates

#: Order of day and month, text, and the timestamp it stands for.
FORMS = [
    ("Auto", '2009-03-24T21:48:25Z', '2009-03-24 21:48:25'),
    ("Auto", '2009-03-24T21:48:25-07:00', '2009-03-24 21:48:25'),
    ("Auto", '2009-03-24T21:48:25.123Z', '2009-03-24 21:48:25'),
    ("Auto", 'Apr12-11', '2011-04-12 00:00:00'),
    ("Auto", '11-Apr-2016', '2016-04-11 00:00:00'),
    ("Auto", '05/06/1993', '1993-05-06 00:00:00'),
    ("Auto", '04/08/2009 18:17:08 -0700', '2009-04-08 18:17:08'),
    ("Auto", '04/12/1992 01:58 PM', '1992-04-12 13:58:00'),
    ("Auto", '2009/03/30 22:10:03', '2009-03-30 22:10:03'),
    ("Auto", '2009/03/24 21:48:25.0', '2009-03-24 21:48:25'),
    ("Auto", 'May 16, 2014', '2014-05-16 00:00:00'),
    ("Auto", 'May 12, 2024 2:30 PM', '2024-05-12 14:30:00'),
    ("Auto", 'May 16,2014', '2014-05-16 00:00:00'),
    ("Auto", 'Mon, 01 Jan 2001 12:34:56 -0700', '2001-01-01 12:34:56'),
    ("Auto", 'Mon, 01 Jan 2001 12:34:56 -0700 (MDT)', '2001-01-01 12:34:56'),
    ("Auto", '01 Jan 2001 12:34:56 -0700', '2001-01-01 12:34:56'),
    ("Auto", 'Fri Jan 10 2014 2:34:17 PM EST', '2014-01-10 14:34:17'),
    ("Auto", '2009-03-24', '2009-03-24 00:00:00'),
    ("Auto", 'Sun, 12 May 2024 14:30:00 +0000', '2024-05-12 14:30:00'),
    ("Auto", 'Sun, 12 May 2024 14:30:00 GMT', '2024-05-12 14:30:00'),
    ("Auto", '1992/04/13 23:59', '1992-04-13 23:59:00'),
    ("Auto", '04/08 18:17:08 2009', '2009-04-08 18:17:08'),
    ("Auto", '01 Jan 2001 12:34:56 -0700 (MDT)', '2001-01-01 12:34:56'),
    ("Auto", '01 Jan 2001 12:34:56 -0700 MDT', '2001-01-01 12:34:56'),
    ("Auto", 'Mon,  1 Jan 2001 12:34:56 -0700', '2001-01-01 12:34:56'),
    ("Auto", 'Mon,  1 Jan 2001 12:34:56 -0700 (MDT)', '2001-01-01 12:34:56'),
    ("Auto", '9/29/2008 2:19:51 PM', '2008-09-29 14:19:51'),
    ("Auto", 'Wed Apr 08 18:17:08 2009', '2009-04-08 18:17:08'),
    ("Auto", 'Wed, Apr 08 18:17:08 2009', '2009-04-08 18:17:08'),
    ("Auto", 'Aug 18 22:29:47 2018', '2018-08-18 22:29:47'),
    ("Auto", '20240512', '2024-05-12 00:00:00'),
    ("Auto", '20240512 1430', '2024-05-12 14:30:00'),
    ("Auto", '20240512 1430 MST', '2024-05-12 14:30:00'),
    ("Auto", '13:45 2020-01-02', '2020-01-02 13:45:00'),
    ("Auto", '9:05 12/31/1999', '1999-12-31 09:05:00'),
    ("Auto", '2020-01-02 14:30 (MST)', '2020-01-02 14:30:00'),
    ("Auto", '12 May 2024 14:30 (UTC+7)', '2024-05-12 14:30:00'),
    ("Auto", '2011-12-03T10:15:30', '2011-12-03 10:15:30'),
    ("Auto", '2024-05-12T14:30', '2024-05-12 14:30:00'),
    ("Auto", '2024-05-12T14:30:00.123456789', '2024-05-12 14:30:00'),
    ("Auto", '2024-05-12T14:30:00+02:00', '2024-05-12 14:30:00'),
    ("Auto", 'Tuesday, May 12, 2024', '2024-05-12 00:00:00'),
    ("Auto", 'tue 05/12/2024', '2024-05-12 00:00:00'),
    ("Auto", '', None),
    ("Auto", 'hello world', None),
    ("AutoDayPref", '04/05/2001', '2001-05-04 00:00:00'),
    ("MonthFirst", '04/05/2001', '2001-04-05 00:00:00'),
    ("DayFirst", '04/05/2001', '2001-05-04 00:00:00'),
    ("AutoDayPref", '2001-04-05', '2001-04-05 00:00:00'),
    ("MonthFirst", '2001-04-05', '2001-04-05 00:00:00'),
    ("DayFirst", '2001-04-05', '2001-04-05 00:00:00'),
    ("MonthFirst", '13/05/2001', None),
    ("DayFirst", '05/13/2001', None),
    ("Auto", '20240512 2560', None),
    ("Auto", 'Feb 30, 2020', None),
]
SHAPES = {
    "2009-03-24T21:48:25Z": "ISO8601", "2009-03-24T21:48:25-07:00": "YMD", "Apr12-11": "MonthDayYear", "11-Apr-2016": "DayMonthYear", "05/06/1993": "MDY", "13/06/1993": "DMY", "04/12/1992 01:58 PM": "MDY",
    "04/08 18:17:08 2009": "MDYWithTime", "Wed Apr 08 18:17:08 2009": "MDYWithTime", "9:05 12/31/1999": "MDY", "13:45 2020-01-02": "YMD", "20241301": "Unknown", "12/34/5678": "Unknown", "": "Unknown",
}


def test_forms(spark):
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(FORMS)], "k int, mode string, x string, want string")
    modes = {"Auto": {}, "AutoDayPref": {"day_first": True}, "MonthFirst": {"enforce": True}, "DayFirst": {"day_first": True, "enforce": True}}
    got = df.select("mode", "x", "want", *[F.date_format(dates.parse("x", **o), "yyyy-MM-dd HH:mm:ss").alias(m) for m, o in modes.items()]).collect()
    assert [(r["x"], r[r["mode"]]) for r in got] == [(x, want) for _, x, want in FORMS]


def test_shapes(spark):
    df = spark.createDataFrame(list(SHAPES.items()), "x string, want string")
    assert {r["x"]: r["s"] for r in df.select("x", dates.classify("x").alias("s")).collect()} == SHAPES


def test_durations_and_fields(spark):
    df = spark.createDataFrame([("2024-01-31 12:00:00", "2024-02-01 11:59:58"), ("2024-01-01 00:00:00", "2023-12-31 19:00:00"), ("2024-03-01 00:00:00", "2024-02-27 22:00:01"), (None, "2024-01-01 00:00:00")], "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    got = [r["d"] and tuple(r["d"]) for r in df.select(dates.duration("a", "b").alias("d")).collect()]
    assert got[:3] == [(0, 23, 59, 58), (0, -5, 0, 0), (-2, 1, 59, 59)] and got[3] in (None, (None,) * 4)
    row = df.select(dates.plus("a", 1, "month").alias("m"), dates.plus("a", -3, "day").alias("d"), dates.with_field("a", day=31, month=2).alias("bad"), dates.with_field("a", year=2023).alias("y"), dates.formatted("a", "EEE d MMM yy 'at' h a").alias("t"), dates.minutes_between("a", "b").alias("n")).first()
    assert (str(row["m"]), str(row["d"]), row["bad"], str(row["y"]), row["t"], round(row["n"], 3)) == ("2024-02-29 12:00:00", "2024-01-28 12:00:00", None, "2023-01-31 12:00:00", "Wed 31 Jan 24 at 12 PM", 1439.967)
    with pytest.raises(ValueError):
        dates.formatted("a", "YYYY")
    with pytest.raises(ValueError):
        dates.plus("a", 1, "fortnight")
    texts = spark.createDataFrame([("20240512",), ("2024-05-12",), ("2024.05.12 10:11",), (None,)], "x string")
    assert [r[0] and str(r[0]) for r in texts.select(dates.strict("x")).collect()] == ["2024-05-12 00:00:00", "2024-05-12 00:00:00", "2024-05-12 10:11:00", None]
    with pytest.raises(Exception, match="no date"):
        spark.createDataFrame([("12 May",)], "x string").select(dates.strict("x")).collect()
