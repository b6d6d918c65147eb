"""Streams on file sources: each must agree with the batch form of the same work."""

import datetime
import json
import pathlib
import shutil

import pytest
from pyspark.sql import functions as F

from quaywise.operators import publish
from quaywise.streaming import jobs, publishing, stateful

T0 = datetime.datetime(2024, 1, 1)


def message(*catalogs, mode=None, visible=None):
    directives = [{"catalogId": c["id"], "updateMode": mode or "MERGE"} | ({"visibleTo": visible} if visible else {}) for c in catalogs if c.get("id")]
    return json.dumps({"message": {"catalogs": list(catalogs), "publishDirectives": directives}})


def publish_all(spark, tmp_path, values, state="state", **options):
    """Each value is a file and a batch of its own."""
    source, out = str(tmp_path / f"{state}-in"), str(tmp_path / state)
    for n, value in enumerate(values):
        rows = [("k", v, T0 + datetime.timedelta(minutes=n), 10 * n + k) for k, v in enumerate(value if isinstance(value, list) else [value])]
        spark.createDataFrame(rows, jobs.MESSAGE).coalesce(1).write.mode("append").parquet(source)
        publishing.publish_stream(jobs.read_messages(spark, source), out, str(tmp_path / f"{state}-ck"), buckets=8, **options).start().awaitTermination()
    return out


def items_of(spark, state, batch=None):
    rows = publishing.current(spark, state, "items", batch, buckets=8).collect()
    return {(r["catalog_id"], r["id"]): r for r in rows}


def test_publish_stream_merges(spark, tmp_path):
    first = message({"id": "c1", "resources": [{"id": "r1", "descriptor": {"name": "A"}}, {"id": "r2", "descriptor": {"name": "B"}}], "offers": [{"id": "o1", "resourceIds": ["r1", "r2"], "n": None}]})
    second = message({"id": "c1", "resources": [{"id": "r1", "descriptor": {"name": "A2"}}]})
    state = publish_all(spark, tmp_path, [first, second, "junk"])
    items = items_of(spark, state)
    assert {k[1]: (json.loads(r["resource"])["descriptor"]["name"], r["offer_ids"]) for k, r in items.items()} == {"r1": ("A2", ["o1"]), "r2": ("B", ["o1"])}
    assert {json.loads(o["offer"])["id"] for r in items.values() for o in r["offers"]} == {"o1"} and all("\"n\"" not in o["offer"] for r in items.values() for o in r["offers"])
    assert {k[1]: (r["created_at"], r["updated_at"]) for k, r in items.items()} == {"r1": (T0, T0 + datetime.timedelta(minutes=1)), "r2": (T0, T0)}
    assert spark.read.text(f"{state}/rejects/batch=2").count() == 1
    assert [r["status"] for r in spark.read.parquet(f"{state}/results/batch=0").collect()] == ["ACCEPTED"]


def test_publish_stream_fills_every_table(spark, tmp_path):
    """Validation, offers across catalogues, provider offers, locations, index and results; a full update clears a
    catalogue everywhere, and a manifest that is gone raises."""
    at = lambda lon: {"geo": {"type": "Point", "coordinates": [lon, 2.0]}}
    shop = {"id": "c1", "provider": {"id": "p1"}, "resources": [{"id": "r1", "descriptor": {"name": "Lamp"}, "availableAt": [at(1.0), at(3.0)], "resourceAttributes": {"colour": "red", "@type": "T"}}], "offers": [{"id": "whole", "note": None}]}
    other = {"id": "c2", "resources": [{"id": "r9", "descriptor": {"name": "Desk"}, "availableAt": [at(5.0)]}], "offers": [{"id": "far", "resourceIds": ["r1", "nowhere"]}]}
    broken = {"id": "c3", "resources": "none"}
    state = publish_all(spark, tmp_path, [message(shop, broken), message(other), message({"id": "c1", "resources": [{"id": "r2", "descriptor": {"name": "Shelf"}}]}, mode="FULL")])
    read = lambda name, n: publishing.current(spark, state, name, n, buckets=8).collect()
    assert {k: r["offer_ids"] for k, r in items_of(spark, state, 1).items()} == {("c1", "r1"): ["far"], ("c2", "r9"): []}
    path = "$.catalogs[*].resources[*].availableAt[*].geo"
    assert sorted((r["item_id"], r["path"], r["seq"], r["geometry"]["ring"][0]["x"]) for r in read("locations", 1)) == [("r1", path, 0, 1.0), ("r1", path, 1, 3.0), ("r9", path, 0, 5.0)]
    assert [(r["offer_id"], r["provider_id"], json.loads(r["payload"])) for r in read("provider_offers", 1)] == [("whole", "p1", {"id": "whole"})]
    assert {r["doc_key"]: (r["text"], r["index_key"]) for r in read("documents", 1)} == {"c1:r1": ("Lamp red far r1 nowhere", "catalog-t"), "c2:r9": ("Desk", None)}
    results = lambda n: spark.read.parquet(f"{state}/results/batch={n}").collect()
    assert {r["catalog_id"]: r["status"] for r in results(0)} == {"c1": "ACCEPTED", "c3": "REJECTED"}
    assert all(json.loads(r["value"])["context"]["action"] == "on_publish" for r in results(0))
    assert set(items_of(spark, state, 2)) == {("c1", "r2"), ("c2", "r9")} == {tuple(r["doc_key"].split(":")) for r in read("documents", 2)}
    assert {(r["catalog_id"], r["id"]) for r in read("places", 2)} == {("c1", "r2"), ("c2", "r9")}
    assert [r["item_id"] for r in read("locations", 2)] == ["r9"] and not read("provider_offers", 2)
    shutil.move(f"{state}/_tables/batch=2", str(tmp_path / "gone"))
    with pytest.raises(Exception, match="batch=2"):
        publishing.apply_publish(spark.createDataFrame([("k", message(shop), T0, 9)], jobs.MESSAGE), 3, state, 8)


def test_linked_items_metadata_and_networks(spark, tmp_path):
    """An offer restated without its items reaches those that hold it, member by member; a catalogue that describes itself
    restamps items it does not list, a bare reference does not; networks come from the directive."""
    lamp, desk = ({"id": i, "descriptor": {"name": n}} for i, n in (("r1", "Lamp"), ("r2", "Desk")))
    first = message({"id": "c1", "descriptor": {"name": "Old"}, "networkId": "own", "resources": [lamp, desk], "offers": [{"id": "o", "resourceIds": ["r1", "r2"], "price": {"value": 5, "unit": "x"}, "tag": "t"}]}, visible=["N1", "N2"])
    second = message({"id": "c1", "descriptor": {"name": "New"}, "resources": [lamp], "offers": [{"id": "o", "resourceIds": ["r1"], "price": {"value": 6}, "tag": None}]})
    third = message({"id": "c1", "offers": [{"id": "o", "price": {"unit": "y"}}]})
    state = publish_all(spark, tmp_path, [first, second, third])
    offer = lambda r: json.loads(r["offers"][0]["offer"])
    name = lambda r: json.loads(r["meta"])["descriptor"]["name"]
    one, two, three = (items_of(spark, state, n) for n in range(3))
    assert {k[1]: r["network_id"] for k, r in one.items()} == {"r1": ["N1", "N2"], "r2": ["N1", "N2"]} and {name(r) for r in one.values()} == {"Old"}
    assert {name(r) for r in two.values()} == {"New"} and two["c1", "r2"]["network_id"] == ["N1", "N2"] and two["c1", "r1"]["network_id"] == []
    assert offer(two["c1", "r1"])["price"] == {"value": 6} and "tag" not in offer(two["c1", "r1"])  # replaced whole
    assert offer(two["c1", "r2"])["price"] == {"value": 6, "unit": "x"} and "tag" not in offer(two["c1", "r2"])  # merged
    assert {name(r) for r in three.values()} == {"New"} and [offer(three["c1", r])["price"]["unit"] for r in ("r1", "r2")] == ["y", "y"]
    assert {r["doc_key"]: r["catalog_name"] for r in publishing.current(spark, state, "documents", 1, buckets=8).collect()} == {"c1:r1": "New", "c1:r2": "New"}


def test_batches_write_only_what_they_touch(spark, tmp_path):
    """Bytes grow with the touched buckets; a batch that comes again changes nothing; the order of batches or one batch of
    all messages leave the same state; old versions can go."""
    size = lambda folder: sum(p.stat().st_size for p in pathlib.Path(folder).rglob("*.parquet"))
    shop = lambda n: {"id": f"c{n}", "resources": [{"id": f"r{n}-{k}", "descriptor": {"name": f"Lamp {k}"}} for k in range(30)], "offers": [{"id": f"o{n}", "resourceIds": [f"r{n}-1"]}]}
    values = [message(*map(shop, range(40))), message({"id": "c7", "resources": [{"id": "r7-0", "descriptor": {"name": "Desk"}}]}), message({"id": "c3", "resources": []}, mode="FULL")]
    state = publish_all(spark, tmp_path, values)
    assert len(list(pathlib.Path(f"{state}/items/version=0").glob("bucket=*"))) == 8 and len(list(pathlib.Path(f"{state}/items/version=1").glob("bucket=*"))) == 1
    assert size(f"{state}/items/version=1") < size(f"{state}/items/version=0") / 3
    names = list(publishing.SCHEMAS)
    mark = lambda folder, n=None: {name: sorted(map(repr, publishing.current(spark, folder, name, n, buckets=8).drop("batch", "created_at", "updated_at").collect())) for name in names}
    before = mark(state)
    publishing.apply_publish(spark.createDataFrame([("k", values[2], T0, 20)], jobs.MESSAGE), 2, state, 8)
    assert mark(state) == before and not any(k[0] == "c3" for k in items_of(spark, state))
    assert mark(publish_all(spark, tmp_path, [values], state="once")) == before
    with pytest.raises(Exception, match="buckets"):
        publishing.current(spark, state, "items", buckets=4)
    old = mark(state, 1)
    assert publishing.vacuum(spark, [publishing.state_table(state, n, 8) for n in names if n != "documents"], publishing.TABLES, keep=2) == 0 or mark(state, 1) == old
    publishing.vacuum(spark, [publishing.state_table(state, n, 8) for n in names if n != "documents"], publishing.TABLES, keep=1)
    assert mark(state)["items"] == before["items"] and not pathlib.Path(f"{state}/_tables/batch=1").exists()


def test_dedupe_counts_from_what_was_let_through(spark, tmp_path):
    """One id every 50 seconds: 0, 100 and 200 pass, in one batch, in the batch form and over several batches."""
    source, schema = str(tmp_path / "in"), "message_id string, ts timestamp, event_id long"
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = [("a", at(50 * n), n) for n in range(6)] + [("b", at(7), 10), ("b", at(7), 11), ("b", at(67), 12), ("b", at(68), 13)]
    want = [0, 2, 4, 10, 13]
    whole = spark.createDataFrame(rows, schema)
    assert sorted(r["event_id"] for r in jobs.dedupe_batch(whole).collect()) == want
    out = []
    for part in (rows[:3] + rows[6:8], rows[3:6], rows[8:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.dedupe_stream(spark.readStream.schema(schema).parquet(source), late="10 minutes")
        stream.writeStream.foreachBatch(lambda df, _: out.extend(r["event_id"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == want


def run_batches(spark, tmp_path, parts, schema, stream, pause=0.0):
    """What a stream hands out when each part comes as a file and a run of its own, from one checkpoint."""
    import time

    stateful.state_store(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a run goes on as long as timers may come
    source, out = str(tmp_path / "in"), []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        rows = stream(spark.readStream.schema(schema).parquet(source))
        query = rows.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        time.sleep(pause)
    return out


def test_retry_queue_across_restarts(spark, tmp_path):
    """Failures count across restarts; the fifth is final; a success or the time to live ends the count."""
    fail, good = lambda k, n=0: (k, "c", f"p{n}", "timeout", True), lambda k: (k, "c", None, None, False)
    parts = [[fail("d1", 1), fail("d2")], [fail("d1", 2), fail("d1", 3), good("d2")], [fail("d1", 4), fail("d2")], [fail("d1", 5), fail("d3")], [fail("d1", 6)]]
    out = run_batches(spark, tmp_path, parts, stateful.OUTCOME, lambda s: stateful.retry_queue(s, most=5, first_ms=1, longest_ms=2))
    dead = [r for r in out if r[5] == "DEAD"]
    assert dead == [("d1", "c", "p5", "timeout", 5, "DEAD")]
    again = {(r[0], r[4]) for r in out if r[5] == "RETRY"}
    assert {("d1", 3), ("d1", 4)} <= again and not any(n > 4 for _, n in again), out  # due timers come after a batch's rows
    assert ("d2", 2) not in again  # its success ended the first count


def test_retry_queue_forgets(spark, tmp_path):
    fail = lambda k: (k, "c", "p", "timeout", True)
    out = run_batches(spark, tmp_path, [[fail("d1")], [fail("d1"), fail("d2")], [fail("d3")]], stateful.OUTCOME, lambda s: stateful.retry_queue(s, most=2, first_ms=1, ttl_ms=1), pause=0.5)
    assert not [r for r in out if r[5] == "DEAD"]


def test_messages_in_key_order(spark, tmp_path):
    """A shuffled input is handed out in order; a gap that stays open is given up, and what fills it then is late."""
    parts = [[("a", "m3", 3), ("a", "m1", 1), ("b", "x1", 1)], [("a", "m2", 2), ("a", "m5", 5), ("b", "x2", 2)], [("c", "y1", 1), ("a", "m2", 2)], [("a", "m4", 4), ("b", "x3", 3)]]
    schema = "key string, value string, place long"
    out = run_batches(spark, tmp_path, parts, schema, lambda s: stateful.in_key_order(s, gap_ms=600_000))
    turns = lambda k: [(r[1], r[4]) for r in sorted(out, key=lambda r: r[3]) if r[0] == k]
    assert turns("a") == [("m1", "in turn"), ("m2", "in turn"), ("m3", "in turn"), ("m2", "late"), ("m4", "in turn"), ("m5", "in turn")]
    assert turns("b") == [("x1", "in turn"), ("x2", "in turn"), ("x3", "in turn")]
    last = spark.createDataFrame([r for r in out if r[4] == "in turn"], stateful.ORDERED)
    assert {r["key"]: r["value"] for r in publish.latest_version(last, ["key"], "turn").collect()} == {"a": "m5", "b": "x3", "c": "y1"}


def test_gap_in_key_order_times_out(spark, tmp_path):
    parts = [[("a", "m1", 1), ("a", "m3", 3)], [("b", "x1", 1)], [("a", "m2", 2), ("a", "m4", 4)]]
    out = run_batches(spark, tmp_path, parts, "key string, value string, place long", lambda s: stateful.in_key_order(s, gap_ms=1), pause=0.5)
    assert [(r[1], r[4]) for r in sorted(out, key=lambda r: r[3]) if r[0] == "a"] == [("m1", "in turn"), ("m3", "in turn"), ("m2", "late"), ("m4", "in turn")]


def test_registry_is_read_again(spark, tmp_path):
    """Batches within the time meet the version that was loaded, later ones the new one."""
    source, out, now = str(tmp_path / "in"), str(tmp_path / "out"), [0.0]
    versions = [("s1", "r", "https://old.example")], [("s1", "r", "https://new.example")]
    at = [0]
    load = lambda: spark.createDataFrame(versions[at[0]], "subscriber_id string, record_id string, base_url string")
    registry = stateful.Reread(load, seconds=60, clock=lambda: now[0])
    schema = "subscriber_id string, record_id string, action string"
    for n, when in enumerate((0.0, 30.0, 61.0)):
        now[0], at[0] = when, min(n, 1)
        spark.createDataFrame([("s1", "r", "on_discover")], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.dispatch_stream(spark.readStream.schema(schema).parquet(source), registry, out, str(tmp_path / "ck")).start().awaitTermination()
    sent = {r["batch"]: r["callback_url"] for r in spark.read.parquet(f"{out}/tasks").collect()}
    assert sent == {0: "https://old.example/on_discover", 1: "https://old.example/on_discover", 2: "https://new.example/on_discover"} and registry.loads == 2


def test_responses(spark):
    values = [json.dumps({"meta": {"subscriberId": "s", "recordId": "r"}, "payload": {"context": {"action": "on_discover", "messageId": "m", "transactionId": "t"}}}), "{", json.dumps({"context": {"action": "x"}}), json.dumps({"meta": {"subscriberId": "s", "recordId": "r"}, "payload": {}}), None]
    rows = jobs.read_responses(spark.createDataFrame([("k", v, T0, n) for n, v in enumerate(values)], jobs.MESSAGE)).orderBy("seq").collect()
    assert [r["dead_reason"] for r in rows] == [None, "not JSON", "no subscriber or record id", "no context", "not JSON"]
    r = rows[0]
    assert (r["subscriber_id"], r["record_id"], r["action"], r["message_id"], r["transaction_id"]) == ("s", "r", "on_discover", "m", "t")
    assert json.loads(r["body"])["context"]["action"] == "on_discover" and rows[2]["action"] == "x"


def test_dispatch_and_windows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("s1", "r", "on_discover"), ("s9", "r", "on_discover")], "subscriber_id string, record_id string, action string").write.parquet(source)
    registry = lambda: spark.createDataFrame([("s1", "r", "https://h.example")], "subscriber_id string, record_id string, base_url string")
    stream = spark.readStream.schema("subscriber_id string, record_id string, action string").parquet(source)
    jobs.dispatch_stream(stream, registry, out, str(tmp_path / "ck")).start().awaitTermination()
    assert spark.read.parquet(f"{out}/tasks").first()["callback_url"] == "https://h.example/on_discover" and spark.read.parquet(f"{out}/dead").first()["dead_reason"] == "unknown subscriber"
    timed = spark.createDataFrame([(T0 + datetime.timedelta(seconds=s), float(s)) for s in range(60)], "ts timestamp, lag_ms double")
    windows = jobs.lag_windows(timed)
    assert windows.count() == 4 and {r["n"] for r in windows.collect()} == {15}
    assert jobs.burst_recovery(windows.withColumn("p99", 59 - F.col("p99")), T0, 20).first()["recovery_s"] == 30


def test_envelopes(spark):
    rows = spark.createDataFrame([("k", json.dumps({"meta": {"subscriberId": "s", "recordId": "r", "active": False}, "payload": {"context": {"messageId": "m", "transactionId": "t"}}}), T0, 1)], jobs.MESSAGE)
    r = jobs.read_envelopes(rows).first()
    assert (r["subscriber_id"], r["active"], r["valid"], r["message_id"], r["transaction_id"]) == ("s", False, None, "m", "t")
    assert publish.latest_version(rows.unionByName(rows.withColumn("seq", F.lit(9).cast("long"))), ["key"]).first()["seq"] == 9
