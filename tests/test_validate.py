import ipaddress
import json
import random

from pyspark.sql import functions as F

from watchtrail.functions.network import is_ip_address
from watchtrail.operators import validate as V

EVENT = {"event_id": "e1", "timestamp": "2026-08-10T03:15:00Z", "principal_id": "dev", "account": {"id": 1}}


def errors(spark, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    return [r.error for r in V.parse_envelopes(df).orderBy("i").collect()]


def body(event=EVENT, features=None, **more):
    return json.dumps({"event": event, "features": {"a": 1} if features is None else features, **more})


def test_each_kind_of_rejection(spark):
    got = errors(
        spark,
        [
            None, "{not json", "[1, 2, 3]", '{"unknown_feature": 10}', body(features={}),
            json.dumps({"event": EVENT}), json.dumps({"features": {"a": 1}}), body(featurez=1),
            body(event={**EVENT, "source_ip": "not-an-ip"}),
            body(event={"event_id": "x", "timestamp": "2026-08-10T03:15:00Z"}),
            body(event={**EVENT, "event_id": ""}), body(event={**EVENT, "timestamp": 5}),
            body() + " tail", body(schema_version=2), '{"event":{"a":1,"a":2},"features":{"a":1}}',
        ],
    )
    assert got[:2] == [V.NOT_JSON] * 2 and got[2] == V.NOT_OBJECT and got[3] == V.NOT_ENVELOPE
    assert all(e.startswith(V.INVALID) for e in got[4:12])
    assert "valid IP address" in got[8] and "at least one of" in got[9]
    assert got[12] == V.NOT_JSON and "schema_version" in got[13] and "repeated" in got[14]


def test_only_one_whole_json_value_is_a_message(spark):
    good = body()
    repeated = [good.replace('{"', '{"features": {}, "', 1), good.replace('"features": {', '"features": {"a": 0, ')]
    bad = [good + tail for tail in ("]", "] junk", "}", "} junk", ",", "," + good, " junk", " // x", " /* x */")]
    bad += [good.replace('"', "'"), good.replace("{", "{{", 1), '{"a": 01}', "[" + good, "NaN junk", "", " ", "null null"]
    got = errors(spark, [good, f" {good}\n", *repeated, *bad, "null", '"text"', "3"])
    assert got[:2] == [None, None] and all("repeated" in e for e in got[2:4])
    assert got[4:-3] == [V.NOT_JSON] * len(bad) and got[-3:] == [V.NOT_OBJECT] * 3


def test_feature_values(spark):
    bad = {"a": "text", "b": None, "c": [1], "d": {"x": 1}, "e": True, "f": "NaN", "g": "inf", "h": "5d", "ok": "0.5"}
    assert errors(spark, [body(features=bad)]) == [
        V.INVALID + "features must be finite numbers: a, b, c, d, e, f, g, h"
    ]


def test_accepted_message_keeps_extras_and_numbers(spark):
    df = spark.createDataFrame([(body(features={"a": "0.5", "b": 1e3, "c": 2}),)], "body string")
    row = V.parse_envelopes(df).first()
    assert row.error is None and row.schema_version == "1.0"
    assert row.features == {"a": 0.5, "b": 1000.0, "c": 2.0}
    assert row.event_context == {"account": '{"id":1}'} and row.source_ip is None


def test_ip_pattern_agrees_with_the_standard_parser(spark):
    rng = random.Random(5)
    alphabet = ["0", "1", "db8", "ffff", "fffff", "g", ":", ":", "::", ".", "1.2.3.4", "256", "%eth0", "01"]
    texts = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 10))) for _ in range(4000)}
    for _ in range(2000):
        groups = [rng.choice(["0", "1f", "abcd"]) for _ in range(rng.randrange(1, 9))]
        groups[rng.randrange(len(groups))] = rng.choice(["", "1.2.3.4", "9"])
        texts.add(":".join(groups))
        texts.add("::" + ":".join(groups))
    texts |= {"::", "1::", "::1", "1.2.3.4", "01.2.3.4", "1.2.3", "1:2:3:4:5:6:7:8", "1.2.3.4\n", "fe80::1%eth0"}

    def parses(text):
        try:
            ipaddress.ip_address(text)
            return True
        except ValueError:
            return False

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_ip_address(F.col("t")).alias("ok"))
    wrong = [(r.t, r.ok) for r in rows.collect() if r.ok != parses(r.t)]
    assert wrong == []


def test_security_events_are_closed(spark):
    good = {
        "event_id": "evt-1", "timestamp": "2026-08-07T03:15:00Z", "account_id": "123456789012",
        "principal_id": "p", "event_name": "E", "service": "iam", "region": "us-gov-east-1",
        "source_ip": "2001:db8::1", "user_agent": "cli", "success": True, "sensitive_operation": False,
    }
    rows = [good, {**good, "account_id": "123"}, {**good, "surprise": 1}, {**good, "label": "odd"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, body string")
    got = [r.violations for r in V.parse_security_events(df).orderBy("i").collect()]
    assert got == [
        [], ["account_id must be 12 digits"], ["unexpected field: surprise"], ["label must be normal or suspicious"],
    ]


def test_required_features_keep_their_order(spark):
    df = spark.createDataFrame([({"b": 1.0, "a": float("inf")},)], "features map<string,double>")
    assert V.require_features(df, ["c", "a", "b"]).first().missing_features == ["c", "a"]
