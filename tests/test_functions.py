"""Scalar, path, shape and text functions on hand-made rows."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaywise.functions import geo, paths, scalars, shapes, stemming
from quaywise.operators import text

CHARGER = {
    "catalogs": [
        {
            "id": "cat-ev",
            "isActive": True,
            "resources": [
                {"id": "r1", "resourceAttributes": {"connectorType": "CCS2", "maxPowerKW": 60, "label": "60", "opens": "06:00:00Z"}},
                {"id": "r2", "resourceAttributes": {"connectorType": "Type2", "maxPowerKW": 22.5, "ext:kind": "AC"}},
            ],
            "offers": [{"id": "o1", "price": {"value": 18, "currency": "INR"}}, {"id": "o2", "price": {"value": 25}}],
        }
    ]
}


@pytest.mark.parametrize(
    ("expression", "keeps"),
    [
        (None, True),
        ("  ", True),
        ('$.catalogs[*].resources[*] ? (@.resourceAttributes.connectorType == "CCS2" && @.resourceAttributes.maxPowerKW >= 60)', True),
        ("$.catalogs[*].resources[*] ? (@.resourceAttributes.connectorType == 'CCS2' && @.resourceAttributes.maxPowerKW < 60)", False),
        ("$.catalogs[*].offers[*] ? (@.price.value < 20)", True),
        ("$.catalogs[*].offers[*] ? (@.price.value < 18)", False),
        ("$.catalogs[*] ? (exists(@.resources[*] ? (@.id == 'r2')) && exists(@.offers[*] ? (@.id == 'o2')))", True),
        ("$.catalogs[*] ? (@.isActive == true)", True),
        ("$.catalogs[*].resources[*] ? (@.resourceAttributes.label == 60)", False),  # a text is no number
        ("$.catalogs[*].resources[*] ? (!(@.resourceAttributes.label == 60))", True),  # r2 has no label: not unknown
        ("$.catalogs[*].resources[*] ? (@.id == 'r1' && !(@.resourceAttributes.label == 60))", False),  # unknown does not negate
        ("$.catalogs[*].resources[*] ? (@.resourceAttributes.ext:kind == 'AC')", True),
        ("$.catalogs[*].resources[*] ? (@.resourceAttributes.connectorType like_regex \"^CC\")", True),
        ("$.catalogs[*].resources[*] ? (@.resourceAttributes.connectorType starts with \"Ty\" || @.id == 'zz')", True),
        ("$.catalogs[*].missing[*]", False),
        ("$.catalogs.resources.id", False),  # members of lists are reached with [*]
        ("exists($.catalogs[*] ? (@.id == 'cat-ev'))", True),
        ("$.catalogs[*].id == 'cat-ev'", True),
    ],
)
def test_path_filter(spark, expression, keeps):
    row = spark.createDataFrame([(json.dumps(CHARGER),)], "j string").select(F.parse_json("j").alias("payload"))
    assert row.where(paths.path_filter(F.col("payload"), expression)).count() == int(keeps)


@pytest.mark.parametrize("bad", ["$.a[?", "$.a ? (@.b ==", "catalogs[*]", "$.a ? (@.b ~ 1)", "$.a $.b"])
def test_bad_paths_are_named(spark, bad):
    assert paths.path_problem(bad)


def test_path_values_and_selection(spark):
    row = spark.createDataFrame([(json.dumps(CHARGER),)], "j string").select(F.parse_json("j").alias("payload"))
    ids = row.select(F.transform(paths.path_values(F.col("payload"), "$.catalogs[*].offers[*] ? (@.price.value < 20)"), lambda o: F.try_variant_get(o, "$.id", "string")).alias("i")).first()["i"]
    assert ids == ["o1"] and paths.selects("$.catalogs[*]") and not paths.selects("@.a == 1")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text_in", "out"), [("2024-01-02T03:04:05Z", datetime.datetime(2024, 1, 2, 3, 4, 5)), ("06:00:00Z", None), ("soon", None), ("2024-13-45", None), (None, None)])
def test_try_timestamp(spark, text_in, out):
    assert one(spark, scalars.try_timestamp(F.col("t")), t=text_in) == out
    scalars.register_sql_functions(spark)
    spark.createDataFrame([(text_in,)], "t string").createOrReplaceTempView("ts_in")
    assert spark.sql("SELECT try_to_timestamptz(t) AS x FROM ts_in").first()["x"] == out


def test_context_and_index_names(spark):
    assert one(spark, scalars.context_base(F.col("u")), u="https://x/y#T") == "https://x/y"
    assert one(spark, scalars.context_base(F.col("u")), u="#T") == "#T"
    assert one(spark, scalars.context_type(F.col("u")), u="https://x/y#") is None
    assert one(spark, scalars.index_key(F.col("k")), k="EV Charger:v2") == "catalog-ev-charger-v2"
    assert one(spark, scalars.index_key(F.col("k")), k=" ") is None
    assert one(spark, scalars.index_key(F.col("k"), default="Misc"), k=None) == "catalog-misc"
    assert one(spark, scalars.location_field(F.col("p")), p="$.catalogs[*].resources[*].ext:at.geo") == "loc_catalogs_resources_ext_at"
    assert one(spark, scalars.redact_url(F.col("u")), u="https://me:pw@h.example:8443/a/b?q=1#f") == "https://h.example/a/b"
    assert one(spark, scalars.endpoint_for_action(F.col("b"), F.lit("on_discover")), b="https://h/") == "https://h/on_discover"
    assert one(spark, scalars.ack_outcome(F.col("b")), b='{"message":{"status":"NACK"}}') == "NACK"
    assert one(spark, scalars.ack_outcome(F.col("b")), b=" ") == "BLANK"
    assert one(spark, scalars.ack_outcome(F.col("b")), b="fine") == "ACK"


@pytest.mark.parametrize(("most", "out"), [(100, "one two thrée"), (11, "one two"), (7, "one"), (2, "on"), (12, "one two")])
def test_truncate_words(spark, most, out):
    assert one(spark, scalars.truncate_words(F.col("t"), most), t="one two thrée") == out


def test_checksums_and_expiry(spark):
    df = spark.createDataFrame([(bytearray(b"abc"), "SHA256:BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD")], "c binary, d string")
    assert df.select(scalars.sha256_matches(F.col("c"), F.col("d")).alias("x")).first()["x"]
    now = F.lit("2024-01-01").cast("timestamp")
    assert one(spark, scalars.is_expired(F.col("t"), now), t="2023-12-31T00:00:00Z") and one(spark, scalars.is_expired(F.col("t"), now), t="junk")
    assert not one(spark, scalars.is_expired(F.col("t"), now), t="2024-02-01T00:00:00Z")


def test_gps_and_geojson(spark):
    assert one(spark, geo.parse_gps(F.col("g")), g="12.97, 77.59").asDict() == {"x": 77.59, "y": 12.97}
    assert one(spark, geo.parse_gps(F.col("g")), g="97,1") is None and one(spark, geo.parse_gps(F.col("g")), g="1") is None
    point = one(spark, geo.parse_geojson(F.parse_json("j")), j='{"type":"Point","coordinates":[77.5,12.9]}')
    assert point["kind"] == "Point" and point["ring"][0]["x"] == 77.5
    assert one(spark, geo.parse_geojson(F.parse_json("j")), j='{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}') is None
    assert one(spark, geo.parse_geojson(F.parse_json("j")), j='{"type":"LineString","coordinates":[[0,0],[1,0]]}') is None


def test_circles_cover_their_points(spark):
    """Every point within a circle lies in one of its cells, at the poles and across 180 degrees too."""
    r = np.random.default_rng(1)
    circles = [(n, *c) for n, c in enumerate([(0.0, 0.0, 2e5), (179.9, 10.0, 3e5), (-179.95, -60.0, 4e5), (20.0, 88.5, 3e5), (20.0, -89.9, 1e5), (77.59, 12.97, 1e4)])]
    points = []
    for n, lon, lat, m in circles:
        for _ in range(300):
            points.append((n, float(lon + r.normal() * m / 6e4 / max(np.cos(np.radians(lat)), 0.05)), float(np.clip(lat + r.normal() * m / 8e4, -90, 90))))
    points = [(n, (x + 180) % 360 - 180, y) for n, x, y in points]
    c = spark.createDataFrame(circles, "n int, lon double, lat double, m double")
    p = spark.createDataFrame(points, "n int, x double, y double").join(c, "n").where(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")) <= F.col("m"))
    inside = p.select(F.array_contains(geo.cells_of_circle(F.col("lon"), F.col("lat"), F.col("m")), geo.cell_of(F.col("x"), F.col("y"))).alias("ok"))
    assert inside.count() > 300 and inside.where("not ok").count() == 0


SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)


@pytest.mark.parametrize(
    ("ring", "true"),
    [
        (SQUARE + 10, {"s_disjoint"}),
        (SQUARE + 2, {"s_intersects", "s_overlaps"}),
        (SQUARE / 4 + 1, {"s_intersects", "s_contains"}),
        (SQUARE * 3 - 4, {"s_intersects", "s_within"}),
        (SQUARE + [4, 0], {"s_intersects", "s_touches"}),
        (SQUARE + [4, 4], {"s_intersects", "s_touches"}),
        (SQUARE[[2, 3, 0, 1, 2]], {"s_intersects", "s_equals", "s_contains", "s_within"}),
        (np.array([[1.0, 1.0]]), {"s_intersects", "s_contains"}),
        (np.array([[4.0, 1.0]]), {"s_intersects", "s_touches"}),
        (np.array([[9.0, 1.0]]), {"s_disjoint"}),
        (np.array([(1, -1), (3, -1), (3, 5), (1, 5), (1, -1)], float), {"s_intersects", "s_overlaps"}),
    ],
)
def test_relations(ring, true):
    assert {name for name, f in shapes.RELATIONS.items() if f(SQUARE, ring)} == true


def test_analysis_and_stems(spark):
    assert one(spark, text.analyse(F.col("t")), t="The charging stations & parties were here") == ["charging", "stations", "parties", "were", "here"]


def test_stems_are_the_published_ones(spark):
    """The examples that the algorithm's description gives for each of its steps."""
    pairs = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
      conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
      relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile
      analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
      sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
      revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
      dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
      probate probat rate rate cease ceas controll control roll roll is is by by naïve naïve a1s a1s generalizations gener oscillators oscil""".split()
    for word, want in zip(pairs[::2], pairs[1::2], strict=True):
        assert stemming.stem(word) == want, word
    docs = spark.createDataFrame([(1, "Painted walls, painting"), (2, "paints the wall")], "k int, t string")
    assert {(r["term"], r["k"], r["tf"], r["length"]) for r in text.postings(docs, "k", "t", stem=True).collect()} == {("paint", 1, 2, 3), ("wall", 1, 1, 3), ("paint", 2, 1, 2), ("wall", 2, 1, 2)}


def test_best_fields(spark):
    df = spark.createDataFrame([(2.0, 1.0, None)], "a double, b double, c double")
    assert df.select(text.best_fields([F.col("a"), F.col("b"), F.col("c")], [1.0, 3.0, 5.0], 0.3).alias("x")).first()["x"] == pytest.approx(3.0 + 0.3 * 2.0)


def test_relations_of_lines_and_equal_shapes():
    import numpy as np

    from quaywise.functions import shapes

    a = lambda *p: np.array(p, float)
    square = a((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
    same = a((2, 2), (0, 2), (0, 1), (0, 0), (1, 0), (2, 0), (2, 2))  # other start, with corners on straight stretches
    turned = square[::-1]
    bow, hull = a((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)), square  # the same corners in another order
    assert shapes.equals(square, same) and shapes.equals(square, turned) and not shapes.equals(bow, hull)
    through, along, inner, outer = a((-1, 1), (3, 1)), a((0, 0), (2, 0)), a((0.5, 1), (1, 1.5)), a((5, 5), (6, 6))
    assert shapes.crosses(through, square) and shapes.crosses(square, through) and shapes.crosses(through, a((1, 0), (1, 3)))
    assert not any(shapes.crosses(x, square) for x in (along, inner, outer, square))
    assert shapes.contains(square, inner) and shapes.within(inner, square) and not shapes.contains(square, along) and not shapes.contains(square, through)
    assert shapes.touches(along, square) and shapes.disjoint(outer, square) and not shapes.touches(inner, square)
    assert shapes.equals(inner, inner[::-1]) and shapes.contains(through, a((0, 1), (1, 1))) and not shapes.contains(through, a((3, 1)))
