"""Scalar functions against hand-made cases."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeloom.functions import geometry, images, normalize, text
from noticeloom.operators import boxes, fuzzy

TODAY = datetime.date(2018, 6, 15)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given_, expected", [
    ("12.05.2018", "2018-05-12"), ("12. Mai 2018", "2018-05-12"), ("12.05.18", "2018-05-12"), ("12.05.07", ""), ("2018", ""), ("14.06.", "2019-06-14"), ("15.06.", "2018-06-15"), ("1.2.2020", "2020-02-01"), ("40.13.2018", ""), ("", ""), ("abc", ""), (None, ""), ("1. abc", "")])
def test_dates(spark, given_, expected):
    assert one(spark, normalize.normal_date(F.lit(given_).cast("string"), TODAY)) == expected


@pytest.mark.parametrize("given_, expected, compat", [("20:30 Uhr", "20:30", None), ("930", "09:30", None), ("20 Uhr", "20:00", None), ("20:33", "", None), ("9 Uhr", "09:00", ""), ("", "", None)])
def test_times(spark, given_, expected, compat):
    assert one(spark, normalize.normal_time(F.lit(given_))) == expected
    assert one(spark, normalize.normal_time(F.lit(given_), compat=True)) == (expected if compat is None else compat)


@pytest.mark.parametrize("given_, expected", [("Sa", "Samstag"), ("SAMSTAG", "Samstag"), ("xx", ""), ("Do.", "Donnerstag")])
def test_days(spark, given_, expected):
    assert one(spark, normalize.day_name(F.lit(given_))) == expected


def test_urls(spark):
    assert one(spark, normalize.normal_url(F.lit("HTTPS://Foo.de/x"))) == "http://foo.de/x"
    assert one(spark, normalize.normal_url(F.lit("foo.de"))) == "http://foo.de"
    assert one(spark, normalize.url_host(F.lit("http://foo.de:80/x"))) == "foo.de"
    assert one(spark, normalize.repair_url(F.lit("WWW Foo de"))) == "www.foo.de"


def test_tickets(spark):
    assert tuple(one(spark, normalize.ticket(F.lit("12,50 €")))) == ("12,50", "€")
    assert tuple(one(spark, normalize.ticket(F.lit("12 EUR")))) == ("12", "EUR")
    assert tuple(one(spark, normalize.ticket(F.lit("12,50 €"), compat=True))) == ("12,50 ", "€")
    assert tuple(one(spark, normalize.ticket(F.lit("12 EUR"), compat=True))) == ("12 E", "UR")


def test_filters(spark):
    for word, repetitive, triple in (("Illi", True, False), ("Konzert", False, False), ("aaa", False, True), ("aab", False, False), ("a", False, False)):
        assert one(spark, boxes.is_repetitive(F.lit(word))) is repetitive
        assert one(spark, boxes.has_triple(F.lit(word))) is triple
    assert one(spark, boxes.is_garbage(F.lit("xxxxx"))) and not one(spark, boxes.is_garbage(F.lit("xxxxx"), compat=True))
    assert one(spark, boxes.is_garbage(F.lit("xxxxy"), compat=True)) and not one(spark, boxes.is_garbage(F.lit("xxxy")))
    keep = [one(spark, boxes.acceptable(F.lit(t), F.lit(c))) for t, c in (("a", 99), ("ab", 50), ("aa", 99), ("abc", 59), ("abc", 60), ("Konzert", 51))]
    assert keep == [False, False, False, False, True, True]


def test_texts(spark):
    assert one(spark, text.ngrams(text.tokens(F.lit(" a b\tc ")))) == ["a", "a b", "a b c", "b", "b c", "c"]
    assert one(spark, text.ngrams(text.tokens(F.lit("  ")))) == []
    assert one(spark, text.escape_umlauts(F.lit("ß€$"))) == "'s'e't"
    assert one(spark, text.unescape_umlauts(F.lit("'s'e't"))) == "ß€$"
    assert one(spark, text.url_encode(F.lit("A b/ä%"))) == "a%20b%2F%C3%A4%25"
    assert one(spark, text.url_encode(F.lit("<|>*"))) == "<%7C>%2A"
    assert one(spark, text.split_fields(F.lit("a|b|"), "|")) == ["a", "b"]
    assert one(spark, text.split_fields(F.lit("a||b"), "|")) == ["a", "", "b"]
    assert one(spark, text.strip_data_url(F.lit("data:image/png;base64,QUJD"))) == "QUJD"
    assert one(spark, text.venue_label(F.lit(None).cast("string"), text.address_line(F.lit("X 1"), F.lit("1"), F.lit("Y")), F.lit("T"))) == "X 1, 1 Y"
    assert one(spark, text.geo_uri(F.lit(1.5), F.lit(2.0), F.lit("n"))) == "geo://0,0?q=1.5,2.0(n)"
    assert len(one(spark, text.record_id(F.lit("a"), F.lit("b")))) == 36


def test_starts_and_places(spark):
    two = F.array(F.lit("20:00"), F.lit("21:00"))
    none = F.array().cast("array<string>")
    assert one(spark, normalize.start_times(F.lit("2018-01-02"), two)) == ["2018-01-02T20:00:00.000", "2018-01-02T21:00:00.000"]
    assert one(spark, normalize.start_times(F.lit("2018-01-02"), none)) == ["2018-01-02"]
    assert one(spark, normalize.start_times(F.lit(""), two)) == []
    assert one(spark, normalize.weekday_of(F.lit("2018-05-12"))) == "Samstag"
    got = one(spark, normalize.geocode_fields(F.lit('{"lat":"1.5","lon":"2","address":{"village":"V","road":"R","house_number":"3"}}')))
    assert (got.latitude, got.longitude, got.city, got.address, got.country) == (1.5, 2.0, "V", "R 3", None)
    at = F.to_timestamp(F.lit("2018-05-12 20:30:00"))
    assert one(spark, normalize.display_date(at, F.lit(False))) == "12.05.2018, 20:30 Uhr" and one(spark, normalize.display_date(at, F.lit(True))) == "12.05.2018"


def test_geometry(spark):
    v = lambda *x: [F.lit(float(i)) for i in x]
    assert one(spark, geometry.overlap_share(*v(0, 0, 10, 10, 0, 0, 10, 5))) == 0.5
    assert one(spark, geometry.overlap_share(*v(0, 0, 1, 1, 5, 5, 1, 1))) == 0.0
    assert one(spark, geometry.rectangles_touch(*v(0, 0, 1, 1, 1, 1, 1, 1))) is True
    assert tuple(one(spark, geometry.line_crossing(*v(0, 0, 2, 2, 0, 2, 2, 0)))) == (1.0, 1.0)
    assert one(spark, geometry.line_crossing(*v(0, 0, 1, 1, 0, 1, 1, 2))) is None
    x, y = geometry.unit_direction(F.lit(-3.0), F.lit(4.0))
    assert one(spark, F.array(x, y)) == [0.6, -0.8]
    assert one(spark, geometry.unit_direction(F.lit(0.0), F.lit(0.0))[0]) is None
    assert one(spark, F.array(*geometry.mirrored(*v(0, 0, 4, 0, 1, 1)))) == [3.0, -1.0]
    assert tuple(one(spark, geometry.end_crossing(*v(0, 0, 0, 100, 0, 5, 100, 5)))) == (0.0, 5.0)
    assert one(spark, geometry.end_crossing(*v(0, 0, 0, 100, 0, 50, 100, 50))) is None and one(spark, geometry.end_crossing(*v(0, 0, 9, 10, 0, 5, 10, 14))) is None
    assert one(spark, geometry.end_crossing(*v(0, 0, 0, 100, -50, 50, 50, 50), far=True)) is not None
    corner = lambda *c: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in c))
    assert [tuple(c) for c in one(spark, geometry.corners_in_order(corner((9, 9), (0, 0), (8, 1), (1, 8))))] == [(0, 0), (8, 1), (9, 9), (1, 8)]
    assert one(spark, geometry.corners_in_order(corner((0, 0), (1, 0), (2, 0), (3, 0)))) is None
    p = spark.createDataFrame([(1, (5.0, 5.0)), (1, (1.0, 1.0)), (1, None), (2, (9.0, 9.0))], "k int, point struct<x:double,y:double>")
    assert {r.k: tuple(r.point) for r in geometry.nearest_point(p, F.lit(0.0), F.lit(0.0), ("k",)).collect()} == {1: (1.0, 1.0), 2: (9.0, 9.0)}


def test_alignment_and_costs():
    assert boxes.alignment("abc", "abc") == ["a", "b", "c"]
    assert "".join(boxes.alignment("Konzert", "Konzort")) == "Konzort"
    assert boxes.alignment("", "x") == []
    table = {("rn", "m"): 0.1, ("i", "l"): 0.0}
    far = lambda a, b, costs: fuzzy.weighted_distances([a], [b], fuzzy.CostTable([(x, y, c) for (x, y), c in costs.items()]))[0]
    assert far("kern", "kem", table) == pytest.approx(0.1)
    assert far("bild", "blld", table) == 0.0
    assert far("", "ab", {}) == 2.0 and far("", "", {}) == 0.0
    assert far("a b", "ab", {(" ", ""): 0.5}) == 0.5 and far("ab", "a", {("b", ""): 3.0}) == 2.0  # by way of a swap: a for nothing, b for a


def test_alignment_by_hand():
    # each character takes one, or two where that gains the bonus of what follows
    assert boxes.alignment("ab", "xab") == ["", "x"] or boxes.alignment("ab", "xab")[-1] != ""
    assert boxes.alignment("Konzert", "Konzort") == list("Konzort")
    assert boxes.alignment("a", "") == [""] and len(boxes.alignment("abc", "abcdefgh")) == 3


@settings(max_examples=40, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_weighted_distance_is_edit_distance_without_costs(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert fuzzy.weighted_distances([a], [b], fuzzy.CostTable([]))[0] == row[-1]


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_transposition_distance(spark):
    import random

    r = random.Random(5)
    pairs = [("ab", "ba"), ("", ""), ("", "abc"), ("abc", ""), ("ca", "abc")] + [tuple("".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in "xy") for _ in range(60)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.transposition_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in rows] == [osa(r["a"], r["b"]) for r in rows]


def test_images(spark):
    row = [(bytes([1, 2, 3, 4, 5, 6]),)]
    df = spark.createDataFrame(row, "d binary").select(F.struct(F.lit(2).alias("rows"), F.lit(3).alias("cols"), F.lit(1).alias("elem_size"), F.col("d").alias("data")).alias("i"))
    turned = df.select(images.rotated(F.col("i"), 1).alias("r"), images.thumbnail(F.col("i"), 1, 1).alias("t"), images.apply_orientation(F.col("i"), F.lit(2)).alias("m")).first()
    assert bytes(turned.r.data) == bytes([4, 1, 5, 2, 6, 3]) and (turned.r.rows, turned.r.cols) == (3, 2)
    assert (turned.t.rows, turned.t.cols) == (1, 1) and bytes(turned.m.data) == bytes([3, 2, 1, 6, 5, 4])
    back = df.select(images.image_from_json(images.image_to_json(F.col("i"))).alias("b")).first().b
    assert bytes(back.data) == row[0][0] and back.rows == 2
    exif = b"\xff\xd8\xff\xe1\x00\x22Exif\x00\x00II*\x00\x08\x00\x00\x00\x01\x00\x12\x01\x03\x00\x01\x00\x00\x00\x06\x00\x00\x00"
    assert images.orientation_tag(exif) == 6 and images.orientation_tag(b"x") == -2 and images.orientation_tag(b"\xff\xd8\xff\xdb\x00\x02") == -1
