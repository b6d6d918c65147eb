"""Pulled catalogues, external results, tree walks and the default embedding."""

import datetime
import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaywise.functions import embedding, walks
from quaywise.sources import pull


def test_inline_pull(spark):
    bodies = [json.dumps({"message": {"catalogs": [{"id": "a"}, {"id": "b"}]}}), json.dumps({"status": "failed", "catalogs": [{"id": "c"}]}), "[", "{}"]
    rows = pull.read_pull_inline(spark.createDataFrame([(b,) for b in bodies], "value string"))
    got = [tuple(r) for r in rows.select(F.try_variant_get("catalog", "$.id", "string"), "reject_reason").collect()]
    assert sorted(got, key=repr) == sorted([("a", None), ("b", None), (None, "pull failed"), (None, "not JSON"), (None, "no catalogues")], key=repr)


def test_manifest_pull(spark, tmp_path):
    body = json.dumps({"catalogs": [{"id": "a"}, {"id": "b"}]}).encode()
    files = {"ok.json": body, "ok.json.gz": gzip.compress(body), "broken.json.gz": b"\x1f\x8bjunk", "none.json": b"{}", "wrong.json": body, "big.json.gz": gzip.compress(b" " * 5000 + body)}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    sum_of = lambda n: hashlib.sha256(files[n]).hexdigest()
    later = "2030-01-01T00:00:00Z"
    rows = [(n, "json.gz" if n.endswith("gz") else "json", "SHA256:" + sum_of(n).upper(), later) for n in files if n != "wrong.json"]
    rows += [("wrong.json", "json", "00", later), ("gone.json", "json", "00", later), ("old.json", "json", "00", "2020-01-01T00:00:00Z"), ("blank.json", "json", " ", later), ("never.json", "json", "00", None)]
    got = pull.read_pull_manifest(spark, spark.createDataFrame(rows, pull.MANIFEST), str(tmp_path), F.lit(datetime.datetime(2025, 1, 1)), cap=1000)
    by = {}
    for name, i, why in got.select("name", F.try_variant_get("catalog", "$.id", "string"), "reject_reason").collect():
        by.setdefault(name, []).append(i or why)
    assert {k: sorted(v) for k, v in by.items()} == {"ok.json": ["a", "b"], "ok.json.gz": ["a", "b"], "broken.json.gz": ["no catalogues"], "none.json": ["no catalogues"], "wrong.json": ["checksum differs"], "gone.json": ["no such file"], "old.json": ["expired"], "blank.json": ["no checksum"], "never.json": ["no expiry"], "big.json.gz": ["no catalogues"]}


def test_external_results(spark):
    r = lambda s: {"score": s, "schema_object": {"catalogs": [{"id": "x"}]}}
    bodies = [{"content": [r(90), r(10)]}, [{"content": [r(80)]}, {"other": 1}], {"messages": [{"content": [r(70)]}, {"content": [r(60)]}]}, {"nothing": 1}]
    rows = pull.external_results(spark.createDataFrame([(json.dumps(b),) for b in bodies], "value string"))
    assert sorted(x["score"] for x in rows.collect()) == [10, 60, 70, 80, 90]


PAYLOAD = {
    "a": [{"geo": {"type": "Point", "coordinates": [77.5, 12.9]}, "address": "x"}, {"gps": "12.9, 77.5"}, {"gps": "99,1"}],
    "b": {"polygon": [[0, 0], [1, 0], [1, 1], [0, 0]], "deep": {"geo": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]], [[1, 1]]]}}},
    "c": {"geo": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
}


def test_geometry_walk(spark):
    df = spark.createDataFrame([("i", json.dumps(PAYLOAD)), ("j", None)], "id string, p string").select("id", F.try_parse_json("p").alias("p"))
    got = walks.extract_geometries(df, ["id"], F.col("p")).orderBy("pos").collect()
    assert {(r["path"], r["geometry"]["kind"], len(r["geometry"]["ring"])) for r in got} == {("$.a[*].geo", "Point", 1), ("$.a[*].gps", "Point", 1), ("$.b.polygon", "Polygon", 4), ("$.b.deep.geo", "Polygon", 4)}
    assert [p for p, _ in walks.geo_objects(PAYLOAD)] == ["$.a[*]", "$.a[*]", "$.b"]


@pytest.mark.parametrize(("target", "patch", "out"), [({"a": {"b": 1, "c": 2}}, {"a": {"b": None, "d": {"e": None}}}, {"a": {"c": 2, "d": {}}}), ({"a": [1]}, {"a": [2, None]}, {"a": [2, None]}), ([1], {"a": 1}, {"a": 1}), ({"a": 1}, 7, 7)])
def test_deep_patch(spark, target, patch, out):
    df = spark.createDataFrame([(json.dumps(target), json.dumps(patch))], "t string, p string")
    assert json.loads(walks.patched(df, "t", "p", "m").first()["m"]) == out


def test_embedding(spark):
    df = spark.createDataFrame([(1, "red fast car"), (2, "fast red car"), (3, "something else entirely"), (4, "")], "id int, t string")
    got = {r["id"]: np.array(r["vector"]) for r in embedding.hashed_embedding(df, "id", "t").collect()}
    assert set(got) == {1, 2, 3} and np.allclose(got[1], got[2]) and np.isclose(np.linalg.norm(got[3]), 1, atol=1e-6) and got[1] @ got[3] < 0.6
    terms = spark.range(1).select(embedding.enrich_query(F.array(F.lit("ev"), F.lit("fast")), {"ev": ["electric", "fast"]}).alias("x")).first()["x"]
    assert terms == ["ev", "fast", "electric"]


def test_patches_in_turn_read_a_payload_once(spark):
    rows = [('{"catalogs":[{"offers":[{"id":"a","x":1}],"resources":[{"id":"r"}]}]}', '{"id":"a","x":null}', "offer", '{"id":"b","y":null}', "offer without nulls"), ('{"catalogs":[{"resources":[{"id":"r"}]}]}', '{"z":1}', "value", '{"n":2}', "resource"), ("broken", "{}", "value", "{}", "value"), ("{}", "{}", "value", None, "value")]
    df = spark.createDataFrame(rows, "t string, p string, hp string, q string, hq string")
    both = walks.patched_in_turn(df, "t", [("p", "hp"), ("q", "hq")], "m")
    got = [r["m"] and json.loads(r["m"]) for r in both.collect()]
    assert got == [{"catalogs": [{"offers": [{"id": "a"}, {"id": "b"}], "resources": [{"id": "r"}]}]}, {"catalogs": [{"resources": [{"id": "r", "n": 2}]}], "z": 1}, None, None]


def test_payload_patches_merge_in_one_pass(spark, data):
    import quaywise.plans.operator_queries  # noqa: F401  registers the query
    from quaywise.plans.catalogue_queries import QUERIES

    plan = QUERIES["payload_patches"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_patched_members_are_those_of_the_patched_payload(spark):
    """Offers and resource alone come out as they would in the whole payload; what no patch meets keeps its text."""
    offers = ['{"id": "a", "x": {"y": 1, "z": 2}}', '{"id":"\\u0062","w":1.50}', '[1]', '{"id":7}']
    resource = '{"id":"r","descriptor":{"name":"n","docs":[1]}}'
    both = [
        ('{"id":"a","x":{"y":null,"n":{"m":null}}}', "offer", '{"id":"b","w":null}', "offer"),
        ('{"id":"c","l":[null],"d":{"e":null}}', "offer without nulls", '{"id":"c","d":{"e":5}}', "offer"),
        ('{"descriptor":{"name":"m"}}', "resource", '{"id":null,"descriptor":{"docs":null}}', "resource"),
        ('{"id":7,"w":1}', "offer", '{"q":1}', "resource"),
        ("broken", "offer", "{}", "resource"),
        (None, "resource", "{}", "resource"),
    ]
    kind = "n int, offers array<string>, resource string, p string, hp string, q string, hq string"
    lists = [(n, offers, resource, *b) for n, b in enumerate(both)]
    lists += [(6, None, None, '{"id":"a"}', "offer", "{}", "resource"), (7, ["{}", None], resource, None, None, ' {"id":"a"} ', "offer"), (8, [], None, "{}", None, None, None)]
    patches = [("p", "hp"), ("q", "hq")]
    got = {r["n"]: r for r in walks.patched_members(spark.createDataFrame(lists, kind), "offers", "resource", patches).collect()}
    texts = ",".join(offers)
    whole = spark.createDataFrame([(n, f'{{"catalogs":[{{"offers":[{texts}],"resources":[{resource}]}}]}}', *b) for n, b in enumerate(both)], "n int, t string, p string, hp string, q string, hq string")
    for r in walks.patched_in_turn(whole, "t", patches, "m").collect():
        mine = got[r["n"]]
        if r["m"] is None:
            assert mine["offers"] is None and mine["resource"] is None
        else:
            want = json.loads(r["m"])["catalogs"][0]
            assert [json.loads(o) for o in mine["offers"]] == want["offers"] and [json.loads(mine["resource"])] == want["resources"]
    assert got[2]["offers"] == offers and got[0]["resource"] == resource
    assert (got[6]["offers"], got[6]["resource"]) == (['{"id":"a"}'], None)
    assert got[7]["offers"] == ["{}", None, '{"id":"a"}'] and got[7]["resource"] == resource
    assert (got[8]["offers"], got[8]["resource"]) == ([], None)


def test_payload_patches_read_what_patches_change(spark, data):
    """No payload is put together and written as text for patches of its offers and resource."""
    import quaywise.plans.operator_queries  # noqa: F401  registers the query
    from quaywise.plans.catalogue_queries import QUERIES

    assert "to_variant_object" not in QUERIES["payload_patches"](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_geometries_leave_python_as_rows(spark):
    """Shapes come out of the walk one a row, not as a list of each payload that is exploded afterwards."""
    texts = ['{"a":[{"gps":"5,60"},[{"geo":{"type":"Point","coordinates":[true,1]}}],{"polygon":[[0,0],[1,0],[1,1],[0,0]]}]}', '{"gps":"91,0"}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.try_parse_json("t").alias("p"))
    found = walks.extract_geometries(df, ["id"], F.col("p"))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r["id"], r["path"], r["pos"], r["geometry"]["kind"], len(r["geometry"]["ring"])) for r in found.orderBy("id", "pos").collect()]
    assert got == [(0, "$.a[*].gps", 0, "Point", 1), (0, "$.a[*].polygon", 1, "Polygon", 4)]
