from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodewright.functions.zones import zone_table
from lodewright.operators.instants import normalise, parse_instants, unnormalised_instants

NY, BERLIN = "America/New_York", "Europe/Berlin"


def at(text, zone=NY, locale="en_US"):
    out = parse_instants(pd.Series([text]), pd.Series([zone]), pd.Series([locale]))[0]
    return None if out is pd.NA else datetime.fromtimestamp(out / 1e6, UTC).strftime("%Y-%m-%d %H:%M:%S.%f").removesuffix(".000000")


CASES = [
    ("2024-05-20T10:00:00.123456Z", NY, "en_US", "2024-05-20 10:00:00.123456"),
    (" 2024-05-20t10:00:00,5z ", NY, "en_US", "2024-05-20 10:00:00.500000"),
    ("2024-05-20T10:00Z", None, None, "2024-05-20 10:00:00"),
    ("2024-05-20T10:00:00.123456789+0530", None, None, "2024-05-20 04:30:00.123456"),
    ("2024-05-20T10:00:00-04", None, None, "2024-05-20 14:00:00"),
    ("2024-05-20 10:00:00 -0400", None, None, "2024-05-20 14:00:00"),
    ("2024-05-20 10:00:00 UTC+5:30", None, None, "2024-05-20 04:30:00"),
    ("2024-05-20 10:00:00 UTC", None, None, "2024-05-20 10:00:00"),
    ("2024-05-20 10:00:00 EDT", NY, "en_US", "2024-05-20 14:00:00"),
    ("2024-05-20 10:00:00 EDT", BERLIN, "de_DE", None),
    ("2024-05-20 10:00:00 EDT", None, None, None),
    ("2024-11-03 01:30:00 EDT", NY, "en_US", "2024-11-03 05:30:00"),
    ("2024-11-03 01:30:00 EST", NY, "en_US", "2024-11-03 06:30:00"),
    ("2024-11-03 01:30:00", NY, "en_US", "2024-11-03 05:30:00"),  # repeated hour: the first pass
    ("2024-03-10 02:30:00", NY, "en_US", "2024-03-10 07:30:00"),  # skipped hour: the offset before
    ("2024-10-27 02:30:00 Europe/Berlin", NY, "en_US", "2024-10-27 00:30:00"),
    ("2024-05-20T10:00:00.5-04:00[America/New_York]", BERLIN, "de_DE", "2024-05-20 14:00:00.500000"),
    ("2024-05-20 10:00:00 Mars/Phobos", NY, "en_US", None),
    ("05/06/2024 10:00:00", BERLIN, "de_DE", "2024-06-05 08:00:00"),
    ("5/6/2024 1:00:00 PM", NY, "en_US", "2024-05-06 17:00:00"),
    ("2024/05/06 10:00:00", "Asia/Tokyo", "ja_JP", "2024-05-06 01:00:00"),
    ("05/06/2024", "Asia/Tokyo", "ja_JP", None),
    ("6.5.2024", BERLIN, "de_DE", "2024-05-05 22:00:00"),
    ("06.05.2024 10:00", BERLIN, "en_US", "2024-05-06 08:00:00"),
    ("Mon May  6 10:00:00 2024", NY, "en_US", "2024-05-06 14:00:00"),
    ("Mon, 06 May 2024 10:00:00 +0200", NY, "en_US", "2024-05-06 08:00:00"),
    ("6 May 2024 10:00:00", "UTC", "en_GB", "2024-05-06 10:00:00"),
    ("May 6, 2024 12:05 AM", "UTC", "en_GB", "2024-05-06 00:05:00"),
    ("July 3rd, 2024", "UTC", "en_GB", "2024-07-03 00:00:00"),
    ("20240506T100000Z", None, None, "2024-05-06 10:00:00"),
    ("1715000000", None, None, "2024-05-06 12:53:20"),
    ("1715000000123", None, None, "2024-05-06 12:53:20.123000"),
    ("1715000000123456", None, None, "2024-05-06 12:53:20.123456"),
    ("2024-05-06", None, None, None),
    ("2024-02-29T24:00:00Z", None, None, "2024-03-01 00:00:00"),
]


@pytest.mark.parametrize(("text", "zone", "locale", "expected"), CASES)
def test_notations(text, zone, locale, expected):
    assert at(text, zone, locale) == expected


@pytest.mark.parametrize("text", ["2024-02-30T10:00:00Z", "2024-13-01", "0000-00-00 00:00:00", "25:61", "2024-04-10T24:71:00Z", "", "-", "TBD", "last sprint", "null", "2024-05-06 10:00:00 PM XYZ", "13/13/2024", "May 6nd 2024x", "x" * 100_000, "9" * 40])
def test_no_instant(text):
    assert at(text) is None


@settings(max_examples=300, deadline=None)
@given(
    st.one_of(st.datetimes(datetime(1950, 1, 1), datetime(2090, 1, 1)), st.datetimes(datetime(1, 1, 3), datetime(9999, 12, 28))),
    st.sampled_from([NY, BERLIN, "Australia/Lord_Howe", "America/Sao_Paulo", "Asia/Kolkata", "Africa/Casablanca", "Asia/Manila", "America/Godthab"]),
)
def test_tables_agree_with_zoneinfo(wall, key):
    expected = int(wall.replace(tzinfo=ZoneInfo(key), microsecond=0).timestamp())
    got = zone_table(key).to_utc(pd.Series([int(wall.replace(tzinfo=UTC, microsecond=0).timestamp()) * 1_000_000]).to_numpy())[0]
    assert got == expected * 1_000_000


@pytest.mark.parametrize("text", ["2105-07-01 12:00:00", "2400-02-29 23:30:00", "9999-07-01 00:00:00", "2131-03-11 02:30:00", "1800-06-01 12:00:00", "0001-06-01 12:00:00", "1883-11-18 12:01:00"])
def test_years_far_away(text):
    wall = datetime.fromisoformat(text)
    offset = wall.replace(tzinfo=ZoneInfo(NY)).utcoffset()
    assert parse_instants(pd.Series([text]), pd.Series([NY]), pd.Series(["en_US"]))[0] == (wall - offset - datetime(1970, 1, 1)).total_seconds() * 1e6
    summer = [n for n in ("EDT", "EST", "LMT") if zone_table(NY).abbreviated(pd.Series([0]).to_numpy(), n) is not None]
    assert summer == ["EDT", "EST", "LMT"]
    assert at("2105-07-01 12:00:00 EDT") == "2105-07-01 16:00:00" and at("2105-01-01 12:00:00 EST") == "2105-01-01 17:00:00"


def test_operator(spark):
    projects = spark.createDataFrame([(1, NY, "en_US"), (2, BERLIN, "de_DE")], "project_id long, time_zone string, locale string")
    rows = [(1, 1, "2024-05-20 10:00:00", "a"), (2, 2, "05/06/2024", None), (3, None, "2024-05-20 10:00:00", "a"), (4, 1, None, "a"), (5, 1, "2024-05-20T10:00:00.000000Z", "a"), (5, 1, "bad", "a")]
    df = spark.createDataFrame(rows, "id long, project_id long, when string, time_zone string")
    got = sorted((r.id, r.instant_us, r.time_zone) for r in normalise(df, "when", projects).where("instant_us is not null").collect())
    assert got == [(1, 1716213600000000, "a"), (2, 1717538400000000, None), (5, 1716199200000000, "a")]
    found = unnormalised_instants([("t", df, "id", "when")], projects).collect()
    assert sorted((r.rec_table, r.rec_id) for r in found) == [("t", 1), ("t", 2)]
    assert unnormalised_instants([("t", df.limit(0), "id", "when")], projects.limit(0)).count() == 0
