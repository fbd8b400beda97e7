import json
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.fixtures import HIGH, NORMAL
from watchtrail.functions import constants as K
from watchtrail.operators import incidents as I
from watchtrail.operators import related as R

SCHEMA = (
    "incident_id string, timestamp timestamp, risk_level string, final_risk_score double, anomaly_score double, "
    "principal_id string, source_ip string, event_name string, service string, region string, attack_type string, "
    "original_payload string, reasons array<string>"
)
NOON = datetime(2026, 8, 10, 3, 15)


def seed(spark):
    rows = [
        ("inc-high-001", NOON, "HIGH", 0.88, 0.93, "developer-04", "203.0.113.77", "CreateAccessKey", "iam", "eu-west-1", "credential-compromise", json.dumps(HIGH), None),
        ("inc-high-002", NOON, "HIGH", 0.91, 0.95, "Developer-04", "203.0.113.77", "StopLogging", "cloudtrail.amazonaws.com", "eu-west-1", "defense-evasion", json.dumps(HIGH), None),
        ("inc-low-001", NOON, "LOW", 0.12, 0.15, "developer-99", "10.0.0.5", "GetMetricData", "cloudwatch", "us-east-1", None, json.dumps(NORMAL), None),
        ("inc-scorer-shape", NOON, "HIGH", 0.87, 0.91, None, None, None, None, None, None, json.dumps(HIGH), None),
        ("inc-odd", NOON, None, 9.99, None, "", "", "", "", "", None, "{broken", ["stored reason"]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_correlation_of_the_seed_rows(spark):
    table = seed(spark)
    found = R.find_related(table, "inc-high-001").collect()
    assert [(r.candidate_id, r.correlation_score) for r in found] == [("inc-high-002", 11)]
    assert found[0].match_reasons == [
        "Same principal id: developer-04", "Same source ip: 203.0.113.77", "Same region: eu-west-1",
    ]
    assert R.find_related(table, "inc-scorer-shape").count() == 0


def test_keyed_read_reaches_the_scan(spark, tmp_path, capsys):
    seed(spark).write.parquet(f"{tmp_path}/store")
    table = spark.read.parquet(f"{tmp_path}/store")
    I.normalize_incidents(I.get_incident(table, "inc-high-001")).explain()
    assert "EqualTo(incident_id,inc-high-001)" in capsys.readouterr().out
    found = R.find_related(table, "inc-high-001").first()
    assert (found.event_name, found.risk_level, found.final_risk_score) == ("StopLogging", "HIGH", 0.91)
    renamed = table.withColumnRenamed("incident_id", "incidentId")
    assert R.find_related(renamed, "inc-high-001").first().candidate_id == "inc-high-002"


def test_numbers_that_are_not_finite(spark):
    odd = json.dumps({"failed_calls_last_5m": "NaN", "hour_of_day": "NaN"})
    nan, inf = float("nan"), float("inf")
    rows = [
        ("a", NOON, "LOW", nan, nan, "p", "10.0.0.1", "GetMetricData", "cloudwatch", "us-east-1", None, odd, None),
        ("b", NOON, "LOW", inf, inf, "q", "10.0.0.2", "GetMetricData", "cloudwatch", "us-east-1", None, odd.replace("NaN", "Infinity"), None),
        ("c", NOON, "LOW", 0.1, 0.1, "r", "10.0.0.3", "GetMetricData", "cloudwatch", "us-east-1", None, '{"failed_calls_last_5m":9}]', None),
    ]
    reports = {r.incident_id: r for r in R.investigate_all(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert reports["a"].suspicious_reasons == [K.MODEL_REASON] and K.ESCALATION not in reports["a"].recommended_actions
    assert reports["b"].suspicious_reasons[0] == "High anomaly score (inf)" and K.ESCALATION in reports["b"].recommended_actions
    assert "Multiple recent failed calls" in reports["b"].suspicious_reasons
    assert not any("failed" in r for r in reports["c"].suspicious_reasons)


def test_explanations(spark):
    rows = {r.incident_id: r.explanation for r in I.explain(I.normalize_incidents(seed(spark))).collect()}
    assert rows["inc-high-001"] == [
        "High anomaly score (0.93)", "Sensitive IAM operation (CreateAccessKey)",
        "External source IP (203.0.113.77)", "Unusual execution hour (03:00 UTC)",
        "Activity outside the normal AWS Region (eu-west-1)",
        "Multiple recent failed calls (5 in the last 5 minutes)",
    ]
    assert rows["inc-low-001"] == [K.MODEL_REASON]
    assert rows["inc-odd"] == ["Unusual execution hour (03:00 UTC)"]


def test_recorded_rules_and_stored_reasons(spark):
    df = spark.createDataFrame(
        [
            ("a", {"rules_triggered": '["Region_Risk", "error_rate_risk"]'}, ["kept"]),
            ("b", {"rules": "anomaly"}, None), ("c", None, [" ", "kept"]),
        ],
        "incident_id string, score_metadata map<string,string>, reasons array<string>",
    )
    rows = {r.incident_id: r.explanation for r in I.explain(I.normalize_incidents(df)).collect()}
    assert rows["a"] == ["Activity outside the normal AWS Region", "Multiple recent failed calls"]
    assert rows["b"] == ["High anomaly score (0.00)"]
    assert rows["c"] == ["kept"]


def test_reports(spark):
    table = seed(spark)
    rows = {r.incident_id: r for r in R.investigate_all(table).collect()}
    high, low, odd = rows["inc-high-001"], rows["inc-low-001"], rows["inc-odd"]
    assert high.recommended_actions == [*K.PLAYBOOKS["credential-compromise"], K.ESCALATION]
    assert K.ESCALATION not in low.recommended_actions
    assert (odd.severity, odd.risk_score) == ("UNKNOWN", 1.0)
    assert high.summary.startswith("This incident was classified as HIGH with a final risk score of 0.88. The main")
    assert [r.incident_id for r in high.related_incidents] == ["inc-high-002"]
    one = R.investigate(table, "inc-high-001").first()
    assert (one.summary, one.related_incidents) == (high.summary, high.related_incidents)
    with pytest.raises(ValueError, match="not found"):
        R.investigate(table, "missing")
    with pytest.raises(ValueError, match="non-empty"):
        I.get_incident(table, "  ")


def test_trio_correlation(spark):
    rows = [
        ("evt-A", "alice", "203.0.113.10", "CreateAccessKey", "iam"),
        ("evt-B", "alice", "203.0.113.50", "AttachUserPolicy", "iam"),
        ("evt-C", "bob", "198.51.100.20", "ListBuckets", "s3"),
    ]
    df = spark.createDataFrame(rows, "incident_id string, principal_id string, source_ip string, event_name string, service string")
    got = R.find_related_all(df.withColumn("region", F.lit("us-east-1"))).collect()
    assert sorted((r.incident_id, r.related_id, r.correlation_score) for r in got) == [
        ("evt-A", "evt-B", 7), ("evt-B", "evt-A", 7),
    ]
    loose = R.find_related_all(df.withColumn("region", F.lit("us-east-1")), min_score=1)
    assert loose.filter("incident_id = 'evt-C'").count() == 2


@pytest.mark.parametrize(("min_score", "limit", "spread"), [(2, 25, 2), (1, 3, 3), (6, 2, 2)])
def test_all_pairs_against_brute_force(spark, min_score, limit, spread):
    rng = random.Random(min_score * 100 + limit)

    def pick(prefix, n):
        return None if rng.random() < 0.15 else rng.choice([f"{prefix}{rng.randrange(n)}", f"{prefix.upper()}{rng.randrange(n)}"])

    rows = []
    for i in range(150):
        hot = rng.random() < 0.4
        when = None if rng.random() < 0.05 else NOON + timedelta(minutes=rng.randrange(30))
        rows.append((f"i{i:03d}", when, "hot" if hot else pick("p", spread * 2), pick("ip", spread * 3), pick("c", spread), pick("n", spread), pick("s", spread), pick("r", spread)))
    df = spark.createDataFrame(
        rows, "incident_id string, timestamp timestamp, principal_id string, source_ip string, attack_category string, event_name string, service string, region string"
    )
    got = sorted((r.incident_id, r.rank, r.related_id, r.correlation_score) for r in R.find_related_all(df, min_score, limit).collect())
    weights = dict(zip(range(2, 8), (5, 5, 3, 2, 1, 1), strict=True))
    want = []
    for a in rows:
        matched = []
        for b in rows:
            total = sum(w for i, w in weights.items() if a[i] and b[i] and a[i].lower() == b[i].lower())
            if a[0] != b[0] and total >= min_score:
                matched.append((-total, b[1] is None, -(b[1] - NOON).total_seconds() if b[1] else 0, b[0]))
        want += [(a[0], n, m[3], -m[0]) for n, m in enumerate(sorted(matched)[:limit], start=1)]
    assert got == sorted(want)


def test_classification_rules(spark):
    rows = [
        ("DATA_Exfiltration", None, None, "data-exfiltration"), ("nonsense", "AssumeRole", None, "credential-compromise"),
        (None, "ListSecrets", "s3", "reconnaissance"), (None, "Query", "dynamodb", "data-exfiltration"),
        (None, "Foo", "CloudTrail ", "defense-evasion"), (None, "Foo", "lambda", None), (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, attack_category string, event_name string, service string, want string")
    assert df.withColumn("got", I.classify()).filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_candidates_are_compared_once(spark):
    lists = R.related_lists(I.normalize_incidents(seed(spark)))
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"profile#\d+\[0\] = values#\d+\[0\]", plan)) == 1


def crowd(n=120):
    """Incidents of few principals, some without one, at few addresses; values in two spellings."""
    rng = random.Random(n)
    pick = lambda prefix, k: None if rng.random() < 0.15 else rng.choice([f"{prefix}{rng.randrange(k)}", f"{prefix.upper()}{rng.randrange(k)}"])
    columns = ("principal_id", "source_ip", "attack_category", "event_name", "service", "region")
    found = []
    for i in range(n):
        values = ["busy" if rng.random() < 0.2 else pick("p", 12), pick("ip", 5), pick("c", 2), pick("n", 3), pick("s", 3), pick("r", 2)]
        found.append({"incident_id": f"i{i:03d}", "timestamp": NOON + timedelta(minutes=rng.randrange(40)), **dict(zip(columns, values, strict=True))})
    return found


CROWD = "incident_id string, timestamp timestamp, principal_id string, source_ip string, attack_category string, event_name string, service string, region string"


def related_by_hand(rows, row, limit=25):
    def score(other):
        return sum(w for n, w in K.CORRELATION_WEIGHTS.items() if row[n] and other[n] and row[n].lower() == other[n].lower())

    found = [(-score(o), -(o["timestamp"] - NOON).total_seconds(), o["incident_id"]) for o in rows if o["incident_id"] != row["incident_id"]]
    return [(name, -points) for points, _, name in sorted(found) if points <= -2][:limit]


@pytest.mark.parametrize(("own_rows", "group_rows", "in_memory"), [(256, 1024, True), (12, 20, True), (12, 20, False), (1, 1, False)])
def test_every_way_of_ranking_agrees_with_brute_force(spark, monkeypatch, own_rows, group_rows, in_memory):
    monkeypatch.setattr(R, "OWN_ROWS", own_rows)
    monkeypatch.setattr(R, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(R, "BROADCAST_BYTES", 256 << 20 if in_memory else 0)
    rows = crowd()
    reports = R.investigate_all(spark.createDataFrame([tuple(r.values()) for r in rows], CROWD)).collect()
    got = {r.incident_id: r.related_incidents for r in reports}
    stored = {r["incident_id"]: r for r in rows}
    for row in rows:
        related = got[row["incident_id"]]
        assert [(r.incident_id, r.correlation_score) for r in related] == related_by_hand(rows, row)
        for r in related:
            assert {n: r[n] for n in ("timestamp", *K.CORRELATION_WEIGHTS)} == {n: stored[r.incident_id][n] for n in ("timestamp", *K.CORRELATION_WEIGHTS)}


def test_reports_of_repeated_ids_hold_every_stored_row(spark):
    rows = [
        ("a", "p", "one"), ("b", "p", "two"), ("b", "P", "three"), ("c", "q", "four"), ("d", "q", "five"),
    ]
    df = spark.createDataFrame([(i, NOON, p, n) for i, p, n in rows], "incident_id string, timestamp timestamp, principal_id string, event_name string")
    reports = R.investigate_all(df).collect()
    got = sorted((r.incident_id, sorted((x.incident_id, x.event_name) for x in r.related_incidents)) for r in reports)
    # "a" is listed twice with either row of "b"; both reports of "b" list "a" once each.
    both = sorted([("b", "two"), ("b", "three")] * 2)
    assert got == [("a", both), ("b", [("a", "one")] * 2), ("b", [("a", "one")] * 2), ("c", [("d", "five")]), ("d", [("c", "four")])]


def test_lists_are_not_sent_to_each_incident(spark):
    df = spark.createDataFrame([tuple(r.values()) for r in crowd()], CROWD)
    explained = lambda x: x._jdf.queryExecution().explainString(x._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    for run in (R.find_related_all, R.investigate_all):
        plan = explained(run(df))
        # The incidents are dealt out by principal, once.
        assert plan.count("Exchange hashpartitioning") == 1


def test_reports_join_no_row_per_match(spark):
    df = spark.createDataFrame([tuple(r.values()) for r in crowd()], CROWD)
    plan = R.investigate_all(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "LeftOuter" in plan
