import os

import pytest

from conftest import rows
from quire.operators import moments as M


@pytest.mark.parametrize(
    "text, tz, want, prec",
    [
        ("2011-09-03T06:51:00Z", None, "2011-09-03T06:51:00Z", "second"),
        ("2012-11-04T03:41:00-0800", None, "2012-11-04T11:41:00Z", "second"),
        ("20151025T042259Z", None, "2015-10-25T04:22:59Z", "second"),
        ("2019-006T20:49:00Z", None, "2019-01-06T20:49:00Z", "second"),
        ("2017-W36-2T20:36:00Z", None, "2017-09-05T20:36:00Z", "second"),
        ("D:20180311105121+02'00'", None, "2018-03-11T08:51:21Z", "second"),
        ("/Date(1364685060000)/", None, "2013-03-30T23:11:00Z", "second"),
        ("1679787928", None, "2023-03-25T23:45:28Z", "second"),
        ("1679797500277", None, "2023-03-26T02:25:00Z", "second"),
        ("Tue, 9 Jun 2020 07:25:00 +0300", None, "2020-06-09T04:25:00Z", "second"),
        ("Sun Mar 11 11:15:00 CET 2012", None, "2012-03-11T10:15:00Z", "second"),
        ("April 28, 2015 at 9:46:52 AM", "UTC", "2015-04-28T09:46:52Z", "second"),
        ("1/28/2013 4:55:36 PM", "UTC", "2013-01-28T16:55:36Z", "second"),
        ("28/10/2018 12:16:00", "UTC", "2018-10-28T12:16:00Z", "second"),
        ("07.06.2021 08:11:00", "Europe/Berlin", "2021-06-07T06:11:00Z", "second"),
        ("2019-05-04 10:22", "UTC", "2019-05-04T10:22Z", "minute"),
        ("2023-04-06 21:27:00 Asia/Tokyo", "UTC", "2023-04-06T12:27:00Z", "second"),
        ("2019-07-24 18:47:00 America/New_York", "UTC", "2019-07-24T22:47:00Z", "second"),
        ("2019-11-03T04:59:43-05:00[America/New_York]", None, "2019-11-03T09:59:43Z", "second"),
        ("2018-10-28 02:30:00", "Europe/Berlin", None, "second"),
        ("2018-03-25 02:30:00", "Europe/Berlin", None, "second"),
        ("2018-03-25 02:30:00", None, None, "second"),
        ("12 Feb 1989", None, "1989-02-12", "day"),
        ("04.01.1974", None, "1974-01-04", "day"),
        ("1977/12", None, "1977-12", "month"),
        ("March 1970", None, "1970-03", "month"),
        ("Spring 1991", None, "1991-spring", "season"),
        ("c. 1977", None, "1977", "year"),
        ("'83", None, "1983", "year"),
        ("[1997?]", None, "1997", "year"),
        ("1988-1989", None, "1988/1989", "range"),
        ("03/04/2001", None, None, "ambiguous"), ("03/04/2001 10:00:00", "UTC", None, "ambiguous"), ("3/4/2001 1:00 PM", "UTC", None, "ambiguous"), ("04/04/2001", None, "2001-04-04", "day"),
        ("1679787928.25", None, "2023-03-25T23:45:28.250000Z", "fraction"), ("-1.5", None, None, "none"), ("12. März 1989", None, "1989-03-12", "day"), ("12 de março de 1989", None, "1989-03-12", "day"), ("1 août 1990", None, "1990-08-01", "day"), ("3 juin 1990", None, "1990-06-03", "day"),
        ("3 juillet 1990", None, "1990-07-03", "day"), ("9 мая 1945", None, "1945-05-09", "day"), ("15 października 2001", None, "2001-10-15", "day"), ("maart 2004", None, "2004-03", "month"), ("4 mei 2010 10:20:30", "Europe/Amsterdam", "2010-05-04T08:20:30Z", "second"),
        ("n.d.", None, None, "none"),
        ("", None, None, "none"),
        ("2011-13-45T99:99:99Z", None, None, "none"),
    ],
)
def test_forms(text, tz, want, prec):
    p = M.parse(text)
    assert (M.show(p, M.to_utc(p, tz)), p[0]) == (want, prec)


def test_pairs_nulls_and_missing_zones(spark, make, noon):
    d = make(
        books=[
            {"book_id": 1, "folder_id": 1, "published": "2020-06-01T10:00:00Z", "ingested_at": noon},
            {"book_id": 2, "folder_id": 2, "published": "2020-06-01 10:00:00", "ingested_at": noon},
            {"book_id": 3, "folder_id": None, "published": None},
            {"book_id": 4, "folder_id": 1, "published": "2020-06-01"},
            {"book_id": None, "folder_id": 1, "published": "2020-06-01T10:00:00Z"},
        ],
        opf_metadata=[{"book_id": 1, "dates": ["2020-06-01T12:00:00+02:00", None, "2020-06-01T10:00:00Z"]}, {"book_id": 2, "dates": ["2020-06-01T08:00:00Z"]}, {"book_id": 4, "dates": []}],
        comic_info=[{"book_id": 2, "issue_year": "1591005600"}],
        folders=[{"folder_id": 1, "tz_name": "Europe/Berlin"}, {"folder_id": 2, "tz_name": None}],
    )
    assert rows(M.p2_found(spark, d), "book_id", "slot_a", "slot_b") == [(1, "date1", "date3"), (1, "date1", "published"), (2, "date1", "published")]
    best = [r for r in M.p2_zones(spark, d).collect() if r["folder_id"] == 2 and r["ranking"] == 1]
    assert best[0]["zone"] == "Europe/Berlin" and best[0]["agreements"] == 1


def test_empty_tables(spark, make):
    d = make(books=[], opf_metadata=[], comic_info=[], folders=[])
    assert M.p2_found(spark, d).count() == 0
    assert M.p2_normalise(spark, d).count() == 0


def test_all_dates_are_normalised(spark, make, noon):
    d = make(books=[{"book_id": 1, "folder_id": 1, "published": None, "ingested_at": noon}], opf_metadata=[{"book_id": 1, "dates": ["2001", None, "2002", "2003", "2004-05"]}], comic_info=[], folders=[{"folder_id": 1, "tz_name": "UTC"}])
    assert rows(M.p2_normalise(spark, d), "slot", "value") == [("date1", "2001"), ("date3", "2002"), ("date4", "2003"), ("date5", "2004-05")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_withheld_zones_are_estimated(spark):
    d = "/root/testdata/sf0.1"
    declared = {r[0]: r[1] for r in spark.read.parquet(f"{d}/folders.parquet").select("folder_id", "tz_name").collect()}
    best = [r for r in M.p2_zones(spark, d).where("ranking = 1").collect() if r["agreements"]]
    assert len(best) > 50 and sum(declared[r["folder_id"]] == r["zone"] for r in best) >= 0.95 * len(best)
