"""Publish, respond, dispatch, audit and discover on hand-made rows."""

import datetime
import json

from pyspark.sql import functions as F

from quaywise.operators import audit, dispatch, filters, payloads, publish, respond, spatial, text
from quaywise.plans import discover as plan
from quaywise.sources import derived

OFFER = "struct<offer_id:string,resource_ids:array<string>,price:double>"


def message(catalogs, directives=()):
    return json.dumps({"context": {"messageId": "m", "transactionId": "t"}, "message": {"catalogs": catalogs, "publishDirectives": list(directives)}})


def test_messages_become_rows(spark):
    good = message([{"id": "c1", "provider": {"id": "p"}, "resources": [{"id": "r1", "descriptor": {"name": "A"}}, {"id": "r2", "resourceAttributes": {"@type": "x"}}], "offers": [{"id": "o1", "resourceIds": "r1"}, {"id": "o2"}]}, {"descriptor": {}}], [{"catalogId": "c1", "updateMode": "FULL", "visibleTo": ["n1", " "]}, {"catalogId": "c1", "updateMode": "MERGE"}])
    rows = [(1, good), (2, "{"), (3, '{"message":{}}'), (4, json.dumps({"catalogs": [{"id": "c9"}]}))]
    parsed = publish.parse_messages(spark.createDataFrame(rows, "seq long, value string"))
    assert {r["seq"]: r["reject_reason"] for r in parsed.collect()} == {1: None, 2: "not JSON", 3: "no catalogues", 4: None}
    split = publish.split_catalogs(parsed)
    got = {r["catalog_id"]: r for r in split.collect()}
    assert got["c1"]["update_mode"] == "FULL" and got["c1"]["visible_to"] == ["n1"] and got[None]["reject_reason"] == "no catalogue id" and got["c9"]["update_mode"] == "MERGE"
    assert [r["id"] for r in publish.catalog_resources(split).collect()] == ["r1"]  # r2 is a stub
    offers = publish.catalog_offers(split)
    listed, whole = publish.offer_index(offers)
    assert [(r["offer_id"], r["id"]) for r in listed.collect()] == [("o1", "r1")] and [r["offer_id"] for r in whole.collect()] == ["o2"]
    assert publish.rejects(parsed).count() == 2
    verdicts = publish.landing_verdict(spark.createDataFrame([(good,), ("{",), ('{"a":1}',), ('{"context":{}}',)], "value string"))
    assert [(r["verdict"], r["nack_reason"]) for r in verdicts.collect()] == [("ACK", None), ("NACK", "not JSON"), ("NACK", "no context"), ("NACK", "no message or transaction id")]


def test_merge_keeps_unstated_offers(spark):
    schema = "catalog_id string, id string, version int, offer_ids array<string>"
    old = spark.createDataFrame([("c", "r1", 0, ["o1", "o2"]), ("c", "r2", 0, ["o1"]), ("d", "r1", 0, [])], schema)
    new = spark.createDataFrame([("c", "r1", 1, ["o3"]), ("c", "r9", 1, [])], schema)
    restated = spark.createDataFrame([("c", "o3"), ("c", "o2")], "catalog_id string, offer_id string")
    got = {(r["catalog_id"], r["id"]): (r["version"], r["offer_ids"]) for r in publish.publish_merge(old, new, restated).collect()}
    assert got == {("c", "r1"): (1, ["o3", "o1"]), ("c", "r2"): (0, ["o1"]), ("d", "r1"): (0, []), ("c", "r9"): (1, [])}
    counts = publish.change_counts(old, new, spark.createDataFrame([("c",)], "catalog_id string"))
    assert {tuple(r) for r in counts.collect()} == {("c", 1, 1, 1), ("d", 0, 0, 0)}


def test_merge_patch_and_nulls(spark):
    df = spark.createDataFrame([('{"a":1,"b":2,"c":{"x":1}}', '{"b":null,"c":7,"d":"n"}')], "t string, p string").select(F.parse_json("t").alias("t"), F.parse_json("p").alias("p"))
    assert json.loads(df.select(F.to_json(publish.merge_patch(F.col("t"), F.col("p")))).first()[0]) == {"a": 1, "c": 7, "d": "n"}
    assert json.loads(df.select(F.to_json(publish.strip_nulls(F.col("p")))).first()[0]) == {"c": 7, "d": "n"}


def catalogs(spark, rows):
    return spark.createDataFrame(rows, f"intent_id int, catalog_id string, provider_id string, rank int, resources array<struct<id:string,name:string>>, offers array<{OFFER}>")


def test_mutual_pruning(spark):
    rows = [
        (1, "a", "p", 1, [("r1", "n"), ("r2", "n")], [("o1", ["r1"], 1.0), ("o1", ["r2"], 2.0), ("o2", ["zz"], 1.0)]),
        (1, "b", "p", 2, [("r1", "n")], [("o3", [], 1.0)]),
        (1, "c", "q", 3, [("r5", "n")], [("o4", ["other"], 1.0)]),
    ]
    got = {r["catalog_id"]: ([x["id"] for x in r["resources"]], [x["offer_id"] for x in r["offers"]]) for r in respond.mutual_pruning(catalogs(spark, rows)).collect()}
    assert got == {"a": (["r1"], ["o1"]), "b": (["r1"], [])}


def test_enrichment_and_broken_answers(spark):
    rows = [(1, "a", "p", 1, [("r1", "n")], []), (2, "b", "none", 1, [("r1", "n")], []), (3, "c", "p", 1, [], []), (3, "d", "p", 2, [("r", "n")], [])]
    offers = spark.createDataFrame([("x", "p", [], 1.0), ("y", "p", ["r1"], 1.0), ("z", None, [], 1.0)], "offer_id string, provider_id string, resource_ids array<string>, price double")
    rich = respond.enrich_with_provider_offers(catalogs(spark, rows), offers)
    assert {r["catalog_id"]: [o["offer_id"] for o in r["offers"]] for r in rich.collect()} == {"a": ["x"], "b": [], "c": ["x"], "d": ["x"]}
    assert {r["catalog_id"] for r in respond.discard_without_offers(rich).collect()} == {"a", "c", "d"}
    assert {r["intent_id"] for r in respond.drop_broken_answers(rich).collect()} == {1, 2}
    merged = respond.merge_catalogs_by_provider(catalogs(spark, [(1, "a", "p", 2, [("r1", "n")], []), (1, "b", "p", 1, [("r1", "n"), ("r2", "n")], []), (1, "c", None, 3, [("r3", "n")], [])]))
    assert {r["merge_key"]: (r["catalog_id"], [x["id"] for x in r["resources"]]) for r in merged.collect()} == {"p": ("b", ["r1", "r2"]), "c": ("c", ["r3"])}


def test_offer_counts_equal_the_enriched_lists(spark):
    rows = [(1, "a", "p", 1, [("r1", "n")], [("x", ["r1"], 1.0), ("w", ["r1"], 1.0), (None, ["r1"], 1.0)]), (1, "b", "p", 2, [("r1", "n")], []), (2, "a", "none", 1, [("r1", "n")], [])]
    offers = spark.createDataFrame([("x", "p", [], 1.0), ("y", "p", [], 1.0), ("y", "p", None, 2.0), (None, "p", [], 1.0), (None, "p", [], 2.0), ("z", "p", ["r1"], 1.0), ("v", None, [], 1.0)], "offer_id string, provider_id string, resource_ids array<string>, price double")
    some = catalogs(spark, rows)
    key = lambda r: (r["intent_id"], r["catalog_id"])
    listed = {key(r): len(r["offers"]) for r in respond.enrich_with_provider_offers(some, offers).collect()}
    counted = respond.with_offer_counts(some, offers)
    assert {key(r): r["n_offers"] for r in counted.collect()} == listed == {(1, "a"): 6, (1, "b"): 4, (2, "a"): 0}
    # no provider's offers are collected
    assert "collect_" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_delivery(spark):
    env = spark.createDataFrame([("s1", "r", "on_discover"), ("s2", "r", "on_discover"), ("s3", "r", "other"), ("s4", "r", "publish")], "subscriber_id string, record_id string, action string")
    reg = spark.createDataFrame([("s1", "r", "http://10.0.0.1"), ("s3", "r", "https://h"), ("s4", "r", "https://h/x/")], "subscriber_id string, record_id string, base_url string")
    got = {r["subscriber_id"]: (r["callback_url"], r["dead_reason"]) for r in dispatch.resolve_callbacks(env, reg).collect()}
    assert got == {"s1": ("http://10.0.0.1/on_discover", "address refused"), "s2": (None, "unknown subscriber"), "s3": (None, "unknown action"), "s4": ("https://h/x/catalog/on_publish", None)}
    tries = spark.createDataFrame([("a", 1, 500), ("a", 2, 409), ("b", 1, 503), ("b", 2, 503), ("b", 3, 503), ("c", 1, 404), ("d", 1, 429)], "message_id string, attempt int, status int")
    assert {tuple(r) for r in dispatch.delivery_results(tries).collect()} == {("a", 2, 1.0, "DELIVERED"), ("b", 3, 3.0, "DEAD"), ("c", 1, 0.0, "DEAD"), ("d", 1, 0.0, "PENDING")}
    again, dead = dispatch.next_attempts(spark.createDataFrame([("x", 4), ("y", None)], "doc_key string, attempt int"))
    assert [tuple(r) for r in again.collect()] == [("y", 1)] and [tuple(r) for r in dead.collect()] == [("x", 5)]


def test_audits(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert audit.same_final_state(a, a.orderBy(F.desc("k"))).first()["same"] and not audit.same_final_state(a, a.limit(1)).first()["same"]
    day = datetime.date(2024, 5, 1)
    checks = spark.createDataFrame([("a", day, 10), ("b", day, 3)], "c string, last_checked date, valid_days int")
    assert [r["status"] for r in audit.freshness(checks, F.lit(datetime.date(2024, 5, 6))).collect()] == ["FRESH", "STALE"]
    parts = spark.createDataFrame([("c", "p1", "d1", 2, "ACTIVE"), ("c", "p2", "d2", 1, "ACTIVE"), ("c", "p3", "d3", 9, "ACTIVE"), ("r", "p1", "d", 9, "RETIRED")], "catalog_id string, part string, digest string, version int, status string")
    known = spark.createDataFrame([("c", "p1", "d0", 1), ("c", "p2", "d0", 1)], "catalog_id string, part string, digest string, version int")
    assert {r["part"] for r in audit.digest_skip(parts, known).collect()} == {"p1", "p3"}


def test_external_results_and_urls(spark):
    rows = spark.createDataFrame([(90, ["c"]), (70, ["c"]), (95, None), (None, ["c"])], "score int, catalogs array<string>")
    assert [r["reject_reason"] for r in filters.external_score_threshold(rows).collect()] == [None, "score too low", "no catalogues", "no score"]
    urls = spark.createDataFrame([("https://a.example/x",), ("ftp://a",), ("http://localhost:1",), ("https://[::1]/",), ("https://172.20.1.1",), ("http://",)], "u string")
    assert [r[0] for r in urls.select(filters.callback_url_allowed(F.col("u"))).collect()] == [True, False, False, False, False, False]


def test_synonyms(spark):
    q = spark.createDataFrame([(1, "ev"), (1, "fast")], "query_id int, term string")
    s = spark.createDataFrame([("ev", "electric")], "term string, synonym string")
    assert {tuple(r) for r in text.with_synonyms(q, s).collect()} == {(1, "ev", "ev"), (1, "ev", "electric"), (1, "fast", "fast")}


def test_discover_routes(spark, data):
    """One call answers intents of all routes; each answer equals its parts computed alone."""
    items = derived.with_payload(derived.items(spark, data)).cache()
    names = items.select("id", "name").distinct()
    posted = text.postings(names, "id", "name")
    shape = names.agg(F.count("*").alias("n"), F.avg(F.size(text.analyse(F.col("name")))).alias("a")).first()
    tables = plan.Tables(items, derived.locations(items), derived.offers(spark, data), posted, shape["n"], shape["a"])
    size = "$.catalogs[*].resources[*] ? (@.resourceAttributes.size >= 25)"
    intents = spark.createDataFrame(
        [("B", size, None, None, None, None), ("A", size, None, 10.0, 10.0, 3e6), ("C", None, None, 10.0, 10.0, 3e6), ("D", None, "small", None, None, None), ("chain", size, "small", None, None, None), ("bad", "$.a[?", None, None, None, None)],
        "intent_id string, expression string, text_search string, lon double, lat double, metres double",
    ).withColumns({"network": F.lit(None).cast("string"), "schema_urls": F.lit(None).cast("array<string>"), "active": F.lit(True), "valid": F.lit(None).cast("boolean")})
    now = F.lit("1998-06-01").cast("timestamp")
    answers = plan.discover(intents.withColumn("valid", F.lit(True)), tables, now, limit=40, on_answer=lambda df: df).cache()
    got = {r["intent_id"] for r in answers.select("intent_id").distinct().collect()}
    assert got == {"A", "B", "C", "D", "chain"}
    kept = items.where(filters.active_filter(F.col("is_active"), F.lit(True)) & filters.validity_filter(F.col("start_text"), F.col("end_text"), F.lit(True), now))
    newest = respond.newest_first(kept.where("size >= 25"), 40)
    want = {(r["catalog_id"]) for r in newest.collect()}
    assert {r["catalog_id"] for r in answers.where("intent_id = 'B'").collect()} == want
    near = spatial.within_distance(tables.locations, spark.createDataFrame([(1, 10.0, 10.0, 3e6)], "intent_id int, lon double, lat double, metres double"))
    both = spatial.keep_matching(kept.where("size >= 25"), near)
    assert {r["catalog_id"] for r in answers.where("intent_id = 'A'").collect()} == {r["catalog_id"] for r in respond.newest_first(both, 40).collect()}
    names_hit = answers.where("intent_id in ('D', 'chain')").select(F.explode("resources.name").alias("n")).distinct().collect()
    assert names_hit and all("small" in r["n"] for r in names_hit)
    routes = intents.select("intent_id", plan.route_of(F.col("expression").isNotNull(), F.col("lon").isNotNull(), F.col("text_search").isNotNull()).alias("r")).where("intent_id <> 'bad'").collect()
    assert all(r["r"] == r["intent_id"] for r in routes)


def test_more_audits(spark):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    req = spark.createDataFrame([(1, "a", t(10)), (1, "b", t(10)), (2, "a", t(10)), (3, "a", t(99)), (3, "b", t(99)), (4, "a", t(99))], "request_id int, provider string, deadline timestamp")
    ans = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(50)), (3, "b", t(20))], "request_id int, provider string, ts timestamp")
    assert sorted(map(tuple, audit.fanout_status(req, ans, F.lit(t(60))).collect())) == [(1, "COMPLETE", 1, 1), (2, "COMPLETE", 0, 1), (3, "PARTIAL", 1, 0), (4, "INITIATED", 0, 0)]
    steps = spark.createDataFrame([(1, "start", t(0)), (1, "parse", t(1)), (1, "save", t(3)), (1, "parse", t(4))], "request_id int, step string, ts timestamp")
    assert {r["step"]: r["elapsed_ms"] for r in audit.step_latency(steps).collect()} == {"parse": 2000.0, "save": 2000.0}
    pulled = spark.createDataFrame([("inline", None), ("inline", "expired"), ("inline", None)], "mode string, reject_reason string")
    assert {tuple(r) for r in audit.pull_stats(pulled).collect()} == {("inline", None, 2), ("inline", "expired", 1)}
    found = spark.createDataFrame([("text", 5.0, 0, 10), ("text", 9.0, 10, 10)], "engine string, ms double, results int, limit int")
    assert audit.engine_stats(found).first()[3:] == (9.0, 9.0, 1, 1)


def test_normalising_and_rules(spark):
    rows = spark.createDataFrame([("a", None, [(" ", "x"), ("r", None), ("s", "p2")]), (" ", "p", [])], "catalog_id string, provider_id string, resources array<struct<id:string,provider_id:string>>")
    got = respond.normalise_catalogs(rows).collect()
    assert [(r["catalog_id"], r["provider_id"], [x["id"] for x in r["resources"]]) for r in got] == [("a", "p2", ["r", "s"])]
    bad = spark.createDataFrame([('{"id":7,"offers":{}}',), ('{"id":"x","isActive":true}',), ("{}",)], "j string").select(publish.catalog_problems(F.parse_json("j")).alias("p"))
    assert [r["p"] for r in bad.collect()] == [["id: wrong type", "offers: wrong type"], [], ["id: missing"]]
    docs = spark.createDataFrame([("k", str(n)) for n in range(5)], "index_key string, doc_key string")
    assert sorted(r["bulk"] for r in publish.sized_batches(docs, 2).collect()) == [0, 0, 1, 1, 2]


def test_index_side_of_space(spark):
    at = lambda x, y: ("Point", [(x, y)])
    schema = "item_id string, catalog_id string, path string, seq short, geometry struct<kind:string,ring:array<struct<x:double,y:double>>>"
    loc = spark.createDataFrame([("i", "c", "$.a", 0, at(1.0, 1.0)), ("j", "c", "$.b", 0, at(1.0, 1.0))], schema)
    circle = spark.createDataFrame([(1, 1.0, 1.0, 1000.0)], "intent_id int, lon double, lat double, metres double")
    near = spatial.index_spatial(loc, {"op": "s_dwithin", "targets": ["$.a", "$.b"]}, circle)
    assert [r["item_id"] for r in near.collect()] == ["i"]
    assert spatial.index_spatial(loc, {"op": "s_dwithin", "quantifier": "all"}, circle) is None and spatial.index_spatial(loc, {"op": "s_touches"}, circle) is None


def test_engines_and_missing_index(spark, tmp_path):
    from quaywise.functions.embedding import hashed_embedding
    from quaywise.plans import discover

    items = spark.createDataFrame([("i1", "c", "u", "T", 1, "red desk lamp"), ("i2", "c", "u", "S", 2, "red desk lamp"), ("i3", "c", "u", "T", 3, "blue garden chair")], "id string, catalog_id string, context_url string, type string, vec_id long, name string")
    engine = discover.VectorHits(hashed_embedding(items, "vec_id", "name"), items.select("vec_id", "id", "catalog_id"), limit=5, least=0.9)
    intents = spark.createDataFrame([("q", "red desk lamp", ["u#T"]), ("blank", " ", None)], "intent_id string, text_search string, schema_urls array<string>")
    assert sorted(r["id"] for r in engine(intents).collect()) == ["i1", "i2"]
    found = discover.hits_of(engine, intents, items)
    assert [(r["intent_id"], r["id"]) for r in found.collect()] == [("q", "i1")]
    assert discover.matched_ids(engine(intents)).first()["ids"] == ["i1", "i2"]
    assert discover.index_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    import pytest

    with pytest.raises(Exception):
        discover.index_or_empty(spark, str(tmp_path / "bad"), "a int").count()


def test_no_like_vector_is_cut_before_ties_are_decided(spark):
    """Twenty items are equally like the query; the newest has the largest vector id."""
    from pyspark.sql import functions as F

    from quaywise.plans import discover

    n = F.col("id")
    item = spark.range(20).select(F.concat(F.lit("r"), n).alias("id"), F.lit("c").alias("catalog_id"), n.alias("vec_id"), F.timestamp_seconds(n).alias("updated_at"))
    null = lambda kind: F.lit(None).cast(kind)
    items = item.select("id", "catalog_id", "updated_at", null("variant").alias("payload"), null("array<string>").alias("network_id"), null("string").alias("context_url"), null("string").alias("type"), null("boolean").alias("is_active"), null("string").alias("start_text"), null("string").alias("end_text"))
    vectors = item.select("vec_id", "id", "catalog_id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    places = spark.createDataFrame([], "item_id string, catalog_id string, path string, seq short, geometry struct<kind:string,ring:array<struct<x:double,y:double>>>")
    posted = spark.createDataFrame([], "term string, id string, length int, tf long")
    intents = spark.createDataFrame([(1, "word", [1.0, 2.0])], "intent_id int, text_search string, query_vector array<double>")
    for name, kind in [("expression", "string"), ("lon", "double"), ("lat", "double"), ("metres", "double"), ("network", "string"), ("schema_urls", "array<string>"), ("active", "boolean"), ("valid", "boolean")]:
        intents = intents.withColumn(name, null(kind))
    tables = discover.Tables(items, places, None, posted, 1, 1.0, vectors, 0.72)
    hits = discover.discover_hits(intents, tables, F.lit("2020-01-01").cast("timestamp"), limit=1)
    assert [r["id"] for r in hits.collect()] == ["r19"]


def test_documents_read_an_owner_once(spark):
    """Members of another JSON type are null and spoil no other member; no member is looked up in the whole payload."""
    from pyspark.sql import functions as F

    from quaywise.operators import documents

    one = '{"catalogs":[{"id":"c","descriptor":"text","provider":"p","isActive":"yes","offers":[{"id":"o"}],"resources":[{"id":"r","descriptor":{"name":"n","shortDesc":5,"docs":{}},"category":[],"rating":{"ratingValue":2.5,"ratingCount":"3"},"provider":"q","resourceAttributes":{"@type":"t"}}]}]}'
    items = spark.createDataFrame([("r", "c", "t", ["N"], one), ("r", "c", "t", ["N"], '{"catalogs":[7]}')], "id string, catalog_id string, type string, network_id array<string>, payload string").withColumn("payload", F.parse_json("payload"))
    docs = documents.search_documents(items)
    r = docs.where("catalog_id is not null").first()
    assert (r["catalog_id"], r["provider_id"], r["resource_name"], r["resource_rating_value"], r["attributes_type"], r["offers"]) == ("c", "p", "n", 2.5, "t", ['{"id":"o"}'])
    assert not [c for c in ("catalog_name", "catalog_is_active", "resource_short_desc", "resource_docs", "resource_category_code", "resource_rating_count", "resource_provider_id") if r[c] is not None]
    assert docs.where("catalog_id is null").count() == 1
    assert "$.descriptor" not in docs._jdf.queryExecution().optimizedPlan().toString()


def test_documents_from_published_texts(spark, data):
    """Resource and offers given as JSON texts make the document that the payload makes; a text is told from other types without
    its type being looked up."""
    from pyspark.sql import functions as F

    from quaywise.operators import documents
    from quaywise.plans.catalogue_queries import QUERIES

    resource = '{"descriptor":{"docs":["a",{"b":1}],"longDesc":["l"],"name":"5","shortDesc":5},"id":"r","provider":{"descriptor":{"name":true},"id":""},"rateable":"true","rating":{"ratingCount":2,"ratingValue":"2"},"resourceAttributes":{"@type":{"t":"t"},"w":1.5}}'
    catalog = '{"descriptor":{"code":2.5,"name":"\\u00e9 \\"q\\""},"id":7,"isActive":true,"offers":[{"id":"o"},"p",3],"provider":{"id":"v"},"resources":[%s],"validity":{"endDate":1999,"startDate":"1998-01-01T00:00:00Z"}}'
    rows = [("r", "c", "t", ["N"], '{"catalogs":[%s]}' % (catalog % resource), resource, ['{"id":"o"}', '"p"', "3"])]
    items = spark.createDataFrame(rows, "id string, catalog_id string, type string, network_id array<string>, payload string, r string, o array<string>").withColumn("payload", F.parse_json("payload"))
    plain, given = documents.search_documents(items).first(), documents.search_documents(items, "r", "o").first()
    assert plain.asDict() == given.asDict()
    assert (given["catalog_name"], given["resource_name"], given["resource_provider_id"], given["resource_rating_count"], given["catalog_is_active"], given["provider_id"]) == ('\u00e9 "q"', "5", "", 2, True, "v")
    assert given["resource_docs"] == ['"a"', '{"b":1}'] and given["offers"] == rows[0][-1] and given["catalog_start"] is not None
    assert not [c for c in ("catalog_id", "catalog_descriptor_code", "resource_short_desc", "resource_long_desc", "resource_provider_name", "resource_rateable", "resource_rating_value", "attributes_type", "catalog_end") if given[c] is not None]
    plan = _optimized(QUERIES["document_build"](spark, data))
    assert plan.count("schema_of_variant(") <= 8 and "to_json(_resource" not in plan


def test_text_blobs_of_copies_and_odd_members(spark, data):
    """Copies of a resource with the same or other offers, lists that are null or hold nulls, resources that are none."""
    from quaywise.operators import documents
    from quaywise.plans.catalogue_queries import QUERIES

    r = '{"descriptor":{"name":"n","docs":["d"," "]},"provider":{"gps":"x","id":"p","@c":"q","l":["http://u",5,true]},"resourceAttributes":{"@t":"t","w":true,"geo":"g","":{"z":false,"s":"\\u001f"}},"policies":"text"}'
    rows = [(1, r, ["{broken", '{"id":"o","v":1.0}']), (2, r, None), (3, r, [None, '"one"', "true"]), (4, "[1]", ["{}"]), (5, None, ["{}"]), (6, " {} ", []), (7, r, ["{broken", '{"id":"o","v":1.0}'])]
    df = spark.createDataFrame(rows, "n int, r string, o array<string>").repartition(1)
    got = {x["n"]: x["b"] for x in documents.text_blobs(df, "r", "o", "b").collect()}
    own = "n p 5 w text d"
    assert got == {1: f"{own} o 1.0", 2: own, 3: f"{own} one", 4: None, 5: None, 6: "", 7: f"{own} o 1.0"}
    plan = _optimized(QUERIES["text_blob"](spark, data))
    assert "to_variant_object" not in plan and "Sort" in plan  # texts are not written from variants, copies of a resource stand together


def test_place_alone_reads_items_beside_their_locations(spark):
    """Items with two points in a circle are answered once; no payload is built and all items are not looked through where
    only a place is asked for."""
    from pyspark.sql import functions as F

    from quaywise.plans import discover

    null = lambda kind: F.lit(None).cast(kind)
    n = F.col("n")
    item = spark.range(4).withColumnRenamed("id", "n").select(F.concat(F.lit("r"), n).alias("id"), F.lit("c").alias("catalog_id"), F.timestamp_seconds(n).alias("updated_at"), null("array<string>").alias("network_id"), null("string").alias("context_url"), null("string").alias("type"), (n != 2).alias("is_active"), null("string").alias("start_text"), null("string").alias("end_text"))
    at = lambda x: F.struct(F.lit("Point").alias("kind"), F.array(F.struct(F.lit(x).alias("x"), F.lit(1.0).alias("y"))).alias("ring"))
    places = item.select(F.col("id").alias("item_id"), "catalog_id", F.struct(*item.columns).alias("item"), F.explode(F.array(at(1.0), at(1.001))).alias("geometry"), F.lit("$.a").alias("path"))
    intents = spark.createDataFrame([(1, 1.0, 1.0, 1000.0), (2, 50.0, 50.0, 1000.0)], "intent_id int, lon double, lat double, metres double")
    for name, kind in [("expression", "string"), ("text_search", "string"), ("network", "string"), ("schema_urls", "array<string>"), ("active", "boolean"), ("valid", "boolean")]:
        intents = intents.withColumn(name, null(kind))

    def payload(rows):
        raise AssertionError("no filter asks for payloads")

    tables = discover.Tables(item, places, None, None, 1, 1.0, with_payload=payload)
    hits = discover.discover_hits(intents, tables, F.lit("2020-01-01").cast("timestamp"))
    assert sorted((r["intent_id"], r["id"], r["rank"]) for r in hits.collect()) == [(1, "r0", 3), (1, "r1", 2), (1, "r3", 1)]


def test_scores_are_summed_where_postings_are(spark):
    """Pairs of queries and documents are not shuffled for their sums, nor sorted by query for a relative cut."""
    import re

    posted = spark.createDataFrame([("a", 1, 2, 1), ("b", 1, 2, 1), ("a", 2, 1, 1), ("c", 3, 1, 1)], "term string, doc_id int, length int, tf long")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "a")], "query_id int, term string")
    scored = text.bm25(posted, "doc_id", asked, 3, 4 / 3)
    plan_text = scored._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+, doc_id", plan_text)
    kept = text.relative_cutoff(scored, 0.9)
    assert "Window" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["query_id"], r["doc_id"]) for r in kept.collect()} == {(1, 1), (2, 3), (None, 2)}


def test_relations_of_items_with_several_shapes(spark):
    """Two shapes under one path and number are both judged; an item is disjoint unless all its shapes meet the ring."""
    square = lambda x, y, h: [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]
    corner = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 1.0)]  # its bounds meet a square at its empty corner
    rows = [("two", "c", "$.a", 0, ("Polygon", square(1.4, 2.8, 0.1))), ("two", "c", "$.a", 0, ("Polygon", square(2.5, 1.5, 0.2))), ("in", "c", "$.a", 0, ("Polygon", square(2.5, 1.5, 0.2))), ("in", "c", "$.a", 1, ("Polygon", square(2.6, 1.4, 0.2))), ("far", None, "$.a", 0, ("Polygon", square(50.0, 1.5, 0.2)))]
    loc = spark.createDataFrame(rows, "item_id string, catalog_id string, path string, seq short, geometry struct<kind:string,ring:array<struct<x:double,y:double>>>")
    asked = spark.createDataFrame([(1, corner)], "intent_id int, ring array<struct<x:double,y:double>>")
    found = spatial.related_by(loc, asked, ["s_intersects", "s_disjoint"])
    got = sorted((r["relation"], r["item_id"]) for r in found.collect())
    assert got == [("s_disjoint", "far"), ("s_disjoint", "two"), ("s_intersects", "in"), ("s_intersects", "two")]


def test_nearest_vectors_of_many_copies(spark):
    """Blocks of vectors meet blocks of queries; copies tie by id, rows of another label or without a length take no part."""
    import random

    from quaywise.operators import vectors

    r = random.Random(1)
    base = [[r.gauss(0, 1) for _ in range(7)] for _ in range(40)]
    rows = [(n, base[n % 40], n % 3 if n % 50 else None) for n in range(600)] + [(900, [0.0] * 7, 1), (901, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>, label int")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), "label")
    plain = df.where("vec_id < 900").join(asked.where("query_id < 900"), "label").select("query_id", "vec_id", vectors.cosine_score(F.col("query"), F.col("vector"), vectors.norm(F.col("query")), vectors.norm(F.col("vector"))).alias("score")).where("score is not null")
    want = {}
    for q, v, s in plain.collect():
        want.setdefault(q, []).append((-s, v))
    found = vectors.knn(df, asked, 5, same="label", blocks=3)
    got = {}
    for x in sorted(found.collect(), key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((-x["score"], x["vec_id"]))
    assert got == {q: sorted(x)[:5] for q, x in want.items()}
    assert "CoGroups" in found._jdf.queryExecution().optimizedPlan().toString()


def test_payload_members_of_other_types(spark):
    """Members of another type spoil no other member; a catalogue's context is read where it stands, offers by their ids alone."""
    from quaywise.operators import payloads

    one = '{"catalogs":[{"@context":"u","resources":{"id":"r"},"offers":[{"id":"a"},5,{"id":7},null]},7,{"resources":[5,{"id":"r","n":1}],"offers":{"id":"z"}}]}'
    df = spark.createDataFrame([(1, one), (2, '{"catalogs":5}')], "n int, t string").select("n", F.parse_json("t").alias("p"))
    r = payloads.extract_resource(F.col("p"), F.lit("r"))
    got = df.select("n", F.try_variant_get(r, "$.n", "int").alias("m"), payloads.offer_ids(F.col("p")).alias("o"), payloads.context_url(r, F.col("p"), "$.catalogs[0]").alias("c"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, ["a", "7"], "u"), (2, None, [], None)]


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_publish_merge_meets_once(spark):
    """Stored and incoming rows meet in one join; repeated and null keys and missing offers come out as they went in."""
    kind = "catalog_id string, id string, version int, offer_ids array<string>"
    old = spark.createDataFrame([("c", "1", 0, ["b", "a"]), ("c", "1", 0, ["d", None]), ("c", "2", 0, None), (None, "3", 0, ["x"]), ("c", "4", 0, ["y"]), ("c", "4", 0, ["y"])], kind)
    new = spark.createDataFrame([("c", "1", 1, ["e", "a"]), ("c", "2", 1, []), (None, "3", 1, ["z"]), ("c", "5", 1, None)], kind)
    restated = spark.createDataFrame([("c", "b"), ("c", "b"), ("c", "q"), ("o", "d")], "catalog_id string, offer_id string")
    got = [tuple(r) for r in publish.publish_merge(old, new, restated).collect()]
    want = [("c", "1", 1, ["e", "a", "d", None]), ("c", "2", 1, []), (None, "3", 0, ["x"]), (None, "3", 1, ["z"]), ("c", "4", 0, ["y"]), ("c", "4", 0, ["y"]), ("c", "5", 1, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert _optimized(publish.publish_merge(old, new, restated.limit(0))).count("Join ") == 1


def test_offers_of_matches_build_payloads_where_asked(spark, data):
    """No payload is put together ahead of the choice between matches and offers."""
    from quaywise.plans.catalogue_queries import QUERIES

    assert " AS payload#" not in _optimized(QUERIES["offers_of_matches"](spark, data))


def test_denormalise_in_one_step(spark):
    """A payload becomes a variant in one step, from a catalogue or its members."""
    v = F.parse_json(F.lit('{"id":"c","resources":[{"id":"x"}],"offers":[],"isActive":true}'))
    rows = spark.range(1).select(v.alias("catalog"), F.parse_json(F.lit('{"id":"r"}')).alias("resource"), F.array(F.parse_json(F.lit('{"id":"o"}'))).alias("offers"))
    by_map = rows.withColumn("catalog", F.col("catalog").cast("map<string,variant>"))
    plain, mapped = (payloads.denormalise(r).select(F.to_json("payload").alias("p")) for r in (rows, by_map))
    assert plain.first() == mapped.first() and plain.first()["p"] == '{"catalogs":[{"id":"c","isActive":true,"offers":[{"id":"o"}],"resources":[{"id":"r"}]}]}'
    stored = spark.createDataFrame([("{}",)], "t string").select(F.parse_json("t").alias("catalog"), F.parse_json("t").alias("resource"), F.array(F.parse_json("t")).alias("offers"))
    assert payloads.denormalise(stored)._jdf.queryExecution().analyzed().toString().count("to_variant_object(") == 3
