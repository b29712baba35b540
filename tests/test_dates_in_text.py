from datetime import datetime as dt

from pyspark.sql import functions as F

from millrace.functions.dates import find_datetime

TEXTS = {
    "Today is January 1, 2047 at 8:21:00am": dt(2047, 1, 1, 8, 21),
    "the 3rd of Sept. 1999, noon": dt(1999, 9, 3),
    "on 2024-02-29T23:59:58Z it ended": dt(2024, 2, 29, 23, 59, 58),
    "paid 12/25/2020": dt(2020, 12, 25),
    "paid 25.12.2020 12:30 am": dt(2020, 12, 25, 0, 30),
    "5-Mar-2001 12:05 p.m": dt(2001, 3, 5, 12, 5),
    "since MAY 2010": dt(2010, 5, 1),
    "version 1.2.3 of 2011.11.12, not 2012": dt(2011, 11, 12),
    "30 Feb 2020": None,
    "13/13/2020": None,
    "may be 12 or 14": None,
    "": None,
    "20240101": None,
    "Dec 7th 1941 07:48": dt(1941, 12, 7, 7, 48),
}


def test_dates_in_sentences(spark):
    rows = [*TEXTS, None, "word " * 20000 + "on 1 June 1980"]
    got = {r.s: r.t for r in spark.createDataFrame([(s,) for s in rows], "s string").select("s", find_datetime(F.col("s")).alias("t")).collect()}
    assert {s: got[s] for s in TEXTS} == TEXTS
    assert got[None] is None and got[rows[-1]] == dt(1980, 6, 1)
