import pytest

from sparkrel.sources.catalog import database_url
from sparkrel.sources.geometry import Geometry, from_twkb, parse

TEXTS = [
    "POINT(1 2)", "POINT Z (1 2 3)", "POINT ZM (1 2 3 4)", "POINT EMPTY", "LINESTRING(0 0,1.5 -2)", "POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1))", "MULTIPOINT(1 2,3 4)", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))",
    "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))", "LINESTRING M (0 0 7,1 1 8)",
]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trips(text):
    g = parse(text)
    assert g.wkt() == text
    assert parse(g.wkb()) == g and parse(g.ewkb().hex()).coordinates == g.coordinates
    assert parse(g.ewkt()) == Geometry(g.kind, g.coordinates, g.z, g.m, 0)
    back = from_twkb(g.twkb())
    assert back.wkt() == text
    if not g.m and not g.empty:
        assert parse(g.geojson()).coordinates == g.coordinates


def test_known_bytes_and_forms():
    assert parse("POINT(1 2)").wkb().hex() == "0101000000000000000000f03f0000000000000040"
    assert parse("SRID=4326;POINT(1 2)").ewkb().hex() == "0101000020e6100000000000000000f03f0000000000000040"
    assert parse("00000000013ff00000000000004000000000000000").wkt() == "POINT(1 2)"
    assert parse("MULTIPOINT((1 2),(3 4))") == parse("multipoint (1 2, 3 4)")
    for bad in ("POINT(1)", "CIRCLE(1 2)", "POINT(1 2", "POINT(1 2) x"):
        with pytest.raises(ValueError):
            parse(bad)


def test_database_url():
    assert database_url("h", "d b", user="u@", password="p/", ssl=True) == "postgresql://u%40:p%2F@h:5432/d%20b?sslmode=require"
    with pytest.raises(ValueError):
        database_url("h", "d", ssl={"ca": "x"})
