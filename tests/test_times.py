"""Leap seconds both ways, and times of scan lines."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from halocline.functions import times
from halocline.sources import decoders


def _atomic(minute, second):
    """Seconds by counting leap dates that are over by the minute."""
    own = datetime.fromisoformat(minute)
    leaps = sum(datetime.fromisoformat(d) <= own for d in times.LEAP_DATES) - 17
    return (own - datetime(1993, 1, 1)).total_seconds() + leaps + second


def test_leap_seconds_both_ways(spark):
    rows = [("1993-01-01 00:00", 0.0, 0.0), ("1993-06-30 23:59", 59.5, 15638399.5), ("1993-06-30 23:59", 60.25, 15638400.25), ("1993-07-01 00:00", 0.0, 15638401.0), ("2008-12-31 23:59", 60.0, 504921606.0), ("2016-12-31 23:59", 60.75, None), ("2017-01-01 00:00", 0.0, None), ("1992-06-30 23:59", 60.5, None), ("1970-05-05 05:05", 5.5, None), ("2030-03-01 12:30", 30.0, None)]
    df = spark.createDataFrame([(m, s) for m, s, _ in rows], "m string, s double")
    out = df.withColumn("tai", times.utc_to_tai93(F.col("m").cast("timestamp_ntz"), F.col("s"))).withColumn("u", times.tai93_to_utc(F.col("tai"))).collect()
    for (m, s, known), r in zip(rows, out):
        assert r.tai == _atomic(m, s) and known in (None, r.tai)
        assert (r.u.minute, r.u.second) == (datetime.fromisoformat(m), s)
    assert df.select(times.tai93_to_utc(F.lit(None).cast("double")).alias("u")).first().u is None
    # 23:59:60 where there is no leap second is the next minute's first second.
    none = df.limit(1).select(times.tai93_to_utc(times.utc_to_tai93(F.lit("2001-06-30 23:59").cast("timestamp_ntz"), F.lit(60.5))).alias("u")).first().u
    assert (none.minute, none.second) == (datetime(2001, 7, 1), 0.5)
    assert times.leap_starts()[17:24] == [15638400, 47174401, 94608002, 141868803, 189302404, 410227205, 504921606]


def test_lines_between_known_ones(spark):
    lines = spark.createDataFrame([(1, k, {2: 10.0, 6: 12.0, 7: 20.5}.get(k)) for k in range(1, 9)] + [(2, 1, None)], "swath int, line int, seconds double")
    got = {(r.swath, r.line): r.time for r in decoders.line_times(lines).collect()}
    at = lambda s: datetime(2015, 1, 1) + timedelta(seconds=s)
    assert [got[1, k] for k in range(1, 9)] == [None, at(10), at(11), at(11), at(12), at(12), at(21), None] and got[2, 1] is None
    pixels = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 7, "c"), (1, 8, "d"), (2, 1, "e")], "swath int, line int, p string")
    out = decoders.timed_swath(pixels, lines, F.lit(at(10)), 2.0).collect()
    assert sorted((r.p, r.time) for r in out) == [("a", at(10)), ("b", at(12))]


def test_ranges_and_fill_values_of_salinity(spark):
    rows = [(1.0, 2.0, 35.0, 0.1, 0), (-9999.2, 2.0, 35.0, 1.0, 0), (1.0, 2.0, 41.0, 1.0, 0), (1.0, 2.0, 35.0, 1.9, 0), (1.0, 2.0, 35.0, 1.0, 1 << 9), (1.0, 2.0, -9999.0, 1.0, 0), (1.0, 2.0, 34.0, 1.0, 1 << 10)]
    df = spark.createDataFrame(rows, "lon double, lat double, sss double, err double, flags int")
    out = decoders.swath_salinity(df, (), (30.0, 40.0), (0.0, 1.5), -9999.0).collect()
    assert [(r.dat, r.err) for r in out] == [(35.0, 0.2), (34.0, 1.0)]
