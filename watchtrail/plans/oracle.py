"""The same results in ANSI SQL, written on their own for an independent check."""

from __future__ import annotations

from watchtrail.functions import constants as K
from watchtrail.plans.activity import API_RISK, THRESHOLD

T = THRESHOLD


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


ACTIVITY = """activity AS (
  SELECT 'evt-' || event_id AS event_id, event_id AS seq, ts AS "timestamp",
    'user-' || user_id AS principal_id, event_type, k, value,
    CASE event_type WHEN 'signup' THEN 'CreateAccessKey' WHEN 'purchase' THEN 'AttachUserPolicy'
      WHEN 'click' THEN 'GetObject' WHEN 'error' THEN 'DescribeInstances'
      ELSE CASE WHEN k % 7 = 0 THEN 'GetMetricData' ELSE 'ListBuckets' END END AS event_name,
    CASE event_type WHEN 'signup' THEN 'iam' WHEN 'purchase' THEN 'iam' WHEN 'click' THEN 's3'
      WHEN 'error' THEN 'ec2' ELSE CASE WHEN k % 7 = 0 THEN 'cloudwatch' ELSE 's3' END END AS service,
    CASE k % 10 WHEN 0 THEN 'eu-west-1' WHEN 1 THEN 'us-west-2' ELSE 'us-east-1' END AS region,
    CASE WHEN k % 4 = 0 THEN '203.0.113.' || (user_id % 254 + 1)
      ELSE '10.0.' || (user_id % 4) || '.' || (k + 1) END AS source_ip,
    event_type <> 'error' AS success,
    event_type IN ('signup', 'purchase') AS sensitive,
    CAST(k % 4 = 0 AND event_type IN ('signup', 'purchase')
      AND (hour(ts) < 6 OR hour(ts) > 19) AS INT) AS label_binary,
    0.25 - value / 400 AS decision_value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""

RISK = f"risk AS (SELECT * FROM (VALUES {_values(API_RISK)}) t(event_name, r))"


def _last(measure: str, span: str) -> str:
    return (
        f"{measure} OVER (PARTITION BY principal_id ORDER BY \"timestamp\" "
        f"RANGE BETWEEN INTERVAL {span} PRECEDING AND CURRENT ROW)"
    )


CALLS = "count(*)"
FAILED = "sum(CASE WHEN success THEN 0 ELSE 1 END)"
SERVICES = "count(DISTINCT service)"
IAM = "sum(CASE WHEN service = 'iam' THEN 1 ELSE 0 END)"

FEATURED = f"""featured AS (
  SELECT a.*, CAST(hour("timestamp") AS INT) AS hour_of_day,
    CAST(isodow("timestamp") >= 6 AS INT) AS is_weekend,
    CAST(NOT success AS INT) AS failed_call, CAST(sensitive AS INT) AS sensitive_operation,
    CAST(hour("timestamp") NOT BETWEEN 6 AND 19 AS INT) AS unusual_hour,
    CAST(source_ip NOT LIKE '10.%' AS INT) AS external_ip,
    CAST(region <> 'us-east-1' AS INT) AS outside_home_region,
    {_last(CALLS, "5 MINUTE")} AS calls_last_5m,
    CAST({_last(FAILED, "5 MINUTE")} AS BIGINT) AS failed_calls_last_5m,
    {_last(SERVICES, "1 HOUR")} AS unique_services_last_1h,
    CAST({_last(IAM, "1 HOUR")} AS BIGINT) AS iam_calls_last_1h,
    CAST(coalesce(risk.r, 0.5) AS DOUBLE) AS api_risk_score
  FROM activity a LEFT JOIN risk ON a.event_name = risk.event_name)"""


def _rule_terms() -> str:
    return " + ".join(f"CASE WHEN {n} >= 1 THEN {w} ELSE 0 END" for n, w, _ in K.RULES)


def _rule_texts() -> str:
    parts = [f"CASE WHEN {n} >= 1 THEN {_quoted(t)} END" for n, _, t in K.RULES]
    parts.append(f"CASE WHEN api_risk_score >= 0.70 THEN {_quoted(K.API_RISK_REASON)} END")
    return ", ".join(parts)


RAW = f"""raw AS (
  SELECT *, 1 / (1 + exp(greatest(-60.0, least(60.0, 6 * (decision_value + {T}))))) AS a,
    least(1.0, CAST({_rule_terms()} AS DOUBLE) + 0.25 * greatest(0.0, least(1.0, api_risk_score))) AS r,
    -decision_value >= {T} AS flagged,
    concat_ws(' | ', {_rule_texts()}) AS rule_texts
  FROM featured)"""

BLEND = "least(1.0, 0.70 * a + 0.30 * r)"
SCORED = f"""scored AS (
  SELECT *, CASE WHEN flagged THEN 'suspicious' ELSE 'normal' END AS model_prediction,
    flagged AS model_flagged_anomaly, round(decision_value, 6) AS model_decision_value,
    round(a, 4) AS anomaly_score, round(r, 4) AS rule_score, round({BLEND}, 4) AS final_risk_score,
    CASE WHEN {BLEND} >= 0.70 THEN 'HIGH' WHEN {BLEND} >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN flagged AND rule_texts <> '' THEN {_quoted(K.MODEL_REASON)} || ' | ' || rule_texts
      WHEN flagged THEN {_quoted(K.MODEL_REASON)} WHEN rule_texts <> '' THEN rule_texts
      ELSE {_quoted(K.NO_FINDING_REASON)} END AS reasons
  FROM raw)"""

CATEGORY_ROWS = [(call, cat) for cat, calls in K.ATTACK_CATEGORIES.items() for call in calls]
CATEGORIES = f"categories AS (SELECT * FROM (VALUES {_values(CATEGORY_ROWS)}) t(call, category))"
INCIDENTS = """incidents AS (
  SELECT s.*, s.event_id AS incident_id, c.category AS attack_category
  FROM scored s LEFT JOIN categories c ON lower(s.event_name) = c.call)"""

WITH_A = f"WITH {ACTIVITY} "
WITH_F = f"WITH {ACTIVITY}, {RISK}, {FEATURED} "
WITH_R = f"WITH {ACTIVITY}, {RISK}, {FEATURED}, {RAW} "
WITH_S = f"WITH {ACTIVITY}, {RISK}, {FEATURED}, {RAW}, {SCORED} "
WITH_I = f"WITH {ACTIVITY}, {RISK}, {FEATURED}, {RAW}, {SCORED}, {CATEGORIES}, {INCIDENTS} "
US = 'epoch_us("timestamp")'

ORACLE: dict[str, str] = {}

# --- features ----------------------------------------------------------------------
ORACLE["calendar_features"] = WITH_A + """SELECT event_id, CAST(hour("timestamp") AS INT) AS hour_of_day,
  CAST(dayofweek("timestamp") IN (0, 6) AS INT) AS is_weekend,
  CAST(hour("timestamp") < 6 OR hour("timestamp") > 19 AS INT) AS unusual_hour FROM activity"""
ORACLE["event_flags"] = WITH_A + """SELECT event_id, CAST(event_type = 'error' AS INT) AS failed_call,
  CAST(sensitive AS INT) AS sensitive_operation, CAST(region <> 'us-east-1' AS INT) AS outside_home_region
  FROM activity"""
ORACLE["external_ip"] = WITH_A + "SELECT event_id, CAST(k % 4 = 0 AS INT) AS external_ip FROM activity"
ORACLE["external_ip_ranges"] = WITH_A + """SELECT event_id, address AS source_ip, CAST(NOT internal AS INT) AS external_ip FROM (
  SELECT event_id, CASE seq % 6 WHEN 0 THEN source_ip WHEN 1 THEN '172.' || (seq % 40) || '.' || (seq % 256) || '.1'
    WHEN 2 THEN 'fd' || lpad(lower(hex(seq % 256)), 2, '0') || '::' || lower(hex(seq % 65536))
    WHEN 3 THEN '2001:db8::' || lower(hex(seq % 65536)) WHEN 4 THEN 'fe80::' || lower(hex(seq % 65536)) || '%eth0'
    ELSE '::ffff:192.168.' || (seq % 256) || '.' || (seq % 200) END AS address,
  CASE seq % 6 WHEN 0 THEN coalesce(source_ip LIKE '10.%' AND k + 1 BETWEEN 0 AND 255, false)
    WHEN 1 THEN seq % 40 BETWEEN 16 AND 31 WHEN 2 THEN true WHEN 4 THEN true ELSE false END AS internal
  FROM activity)"""
for _name, _measure, _spans in (
    ("calls_last", CALLS, {"n_5m": "5 MINUTE", "n_6h": "6 HOUR", "n_24h": "24 HOUR"}),
    ("failed_calls_last", FAILED, {"n_5m": "5 MINUTE", "n_6h": "6 HOUR", "n_24h": "24 HOUR"}),
    ("unique_services_last", SERVICES, {"n_1h": "1 HOUR", "n_6h": "6 HOUR", "n_24h": "24 HOUR"}),
    ("iam_calls_last", IAM, {"n_1h": "1 HOUR", "n_6h": "6 HOUR", "n_24h": "24 HOUR"}),
):
    _columns = ", ".join(f"CAST({_last(_measure, s)} AS BIGINT) AS {n}" for n, s in _spans.items())
    ORACLE[_name] = WITH_A + f"SELECT event_id, {_columns} FROM activity"
ORACLE["api_risk"] = f"WITH {ACTIVITY}, {RISK} " + """SELECT event_id, a.event_name,
  CAST(CASE WHEN a.event_name = 'GetObject' THEN 0.5 ELSE r END AS DOUBLE) AS api_risk_score
  FROM activity a LEFT JOIN risk ON a.event_name = risk.event_name"""
_present = ("hour_of_day", "is_weekend", "failed_call", "sensitive_operation", "unusual_hour", "outside_home_region")
ORACLE["select_features"] = WITH_F + "SELECT event_id, " + ", ".join(
    n if n in _present else f"0 AS {n}" for n in K.FEATURES
) + " FROM featured"
ORACLE["numeric_matrix"] = WITH_A + """SELECT event_id,
  CASE WHEN seq % 13 = 0 OR seq % 11 = 0 THEN 0.0 ELSE value END AS amount,
  CAST(CASE WHEN seq % 7 = 0 THEN 0 ELSE seq % 100 END AS DOUBLE) AS code FROM activity"""
ORACLE["time_split"] = WITH_A + """SELECT event_id,
  CASE WHEN epoch_us("timestamp") <= (SELECT quantile_cont(epoch_us("timestamp")::DOUBLE, 0.8) FROM activity)
    THEN 'train' ELSE 'test' END AS part FROM activity"""
ORACLE["feature_vector"] = WITH_F + "SELECT event_id, " + ", ".join(
    f"CAST({n} AS DOUBLE) AS {n}" for n in K.FEATURES
) + " FROM featured"
ORACLE["read_feature_table"] = WITH_F + "SELECT event_id, " + ", ".join(
    f"CAST({n} AS DOUBLE) AS {n}" for n in K.FEATURES
) + ", label_binary FROM featured"

# --- scoring -----------------------------------------------------------------------
ORACLE["anomaly_score"] = WITH_R + "SELECT event_id, round(a, 6) AS anomaly_score FROM raw"
ORACLE["is_anomalous"] = WITH_A + f"SELECT event_id, -decision_value >= {T} AS is_anomalous FROM activity"
ORACLE["rule_score"] = WITH_R + "SELECT event_id, round(r, 6) AS rule_score FROM raw"
ORACLE["rule_reasons"] = WITH_R + "SELECT event_id, rule_texts AS rule_reasons FROM raw"
ORACLE["final_risk"] = WITH_R + f"SELECT event_id, round({BLEND}, 6) AS final_risk FROM raw"
ORACLE["risk_level"] = WITH_A + """SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN 'HIGH'
  WHEN value / 100 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM activity"""
ORACLE["all_reasons"] = WITH_S + "SELECT event_id, reasons FROM scored"
ORACLE["score"] = WITH_S + """SELECT event_id, model_prediction, model_flagged_anomaly, model_decision_value,
  anomaly_score, rule_score, final_risk_score, risk_level, reasons FROM scored"""


def _path(n: int) -> float:
    """Mean search depth among n rows, for the leaf sizes of the fixed trees."""
    from math import log

    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


FOREST = f"""forest AS (SELECT *, 0.5 - power(2, -(
    (CASE WHEN sensitive_operation > 0.5 THEN 1 + {_path(3)} WHEN external_ip <= 0.5 THEN 2 + {_path(4)}
      ELSE 2 + {_path(1)} END
    + CASE WHEN hour_of_day <= 10.5 THEN 1 + {_path(2)} ELSE 1 + {_path(6)} END
    + CASE WHEN failed_call <= 0.5 THEN 1 + {_path(7)} ELSE 1 + {_path(1)} END) / 3.0) / {_path(8)}) AS d
  FROM featured)"""
ORACLE["forest_decision"] = f"WITH {ACTIVITY}, {RISK}, {FEATURED}, {FOREST} SELECT event_id, round(d, 6) AS decision FROM forest"
FOREST_SCORED = f"""forest_scored AS (
  SELECT *, 1 / (1 + exp(6 * (d + 0.05))) AS fa, -d >= 0.05 AS fflag,
    least(1.0, CAST({_rule_terms()} AS DOUBLE) + 0.25 * api_risk_score) AS fr,
    concat_ws(' | ', {_rule_texts()}) AS texts FROM forest),
forest_final AS (
  SELECT *, 0.70 * fa + 0.30 * fr AS ff, CASE WHEN fflag AND texts <> '' THEN {_quoted(K.MODEL_REASON)} || ' | ' || texts
    WHEN fflag THEN {_quoted(K.MODEL_REASON)} WHEN texts <> '' THEN texts ELSE {_quoted(K.NO_FINDING_REASON)} END AS why
  FROM forest_scored)"""
LEVEL_FF = "CASE WHEN ff >= 0.7 THEN 'HIGH' WHEN ff >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
WITH_FOREST = f"WITH {ACTIVITY}, {RISK}, {FEATURED}, {FOREST}, {FOREST_SCORED} "
ORACLE["score_raw_events"] = WITH_FOREST + f"""SELECT event_id, round(fa, 4) AS anomaly_score,
  round(ff, 4) AS risk_score, {LEVEL_FF} AS risk_level, why AS reasons, 'fixed' AS model_version FROM forest_final"""

# The model sees a missing input as 0; a missing API risk scores as the highest.
ODD_FEATURED = f"WITH {ACTIVITY}, {RISK}, {FEATURED.replace('featured AS', 'whole AS', 1)}" + """, featured AS (SELECT * REPLACE (
    CASE WHEN seq % 7 = 0 THEN 0 ELSE sensitive_operation END AS sensitive_operation,
    CASE WHEN seq % 11 = 0 THEN 0 ELSE failed_call END AS failed_call,
    CASE WHEN seq % 3 = 0 THEN 0 ELSE hour_of_day END AS hour_of_day,
    CASE WHEN seq % 13 = 0 THEN 1.0 ELSE api_risk_score END AS api_risk_score) FROM whole)""" + f", {FOREST}, {FOREST_SCORED} "
ORACLE["score_dataset"] = ODD_FEATURED + f"""SELECT event_id, CASE WHEN fflag THEN 'suspicious' ELSE 'normal' END AS model_prediction,
  fflag AS model_flagged_anomaly, round(d, 6) AS model_decision_value, round(fa, 4) AS anomaly_score,
  round(fr, 4) AS rule_score, round(ff, 4) AS final_risk_score, {LEVEL_FF} AS risk_level, why AS reasons FROM forest_final"""
ORACLE["train_and_score"] = "SELECT count(DISTINCT event_id) AS events, 0::BIGINT AS bad FROM events"
FACTS = """true AS sums_match, true AS is_binary, true AS within_depth, true AS is_whole, true AS is_stable"""
ORACLE["fit_forest"] = WITH_A + f"""SELECT t::INT AS tree_id,
  (SELECT least(256, count(*)) FROM activity WHERE label_binary = 0)::INT AS root_rows, {FACTS} FROM range(300) r(t)"""
ORACLE["fit_forest_wide"] = f"""SELECT t::INT AS tree_id,
  (SELECT least(256, count(*)) FROM embeddings WHERE label = 0)::INT AS root_rows, {FACTS} FROM range(50) r(t)"""
ORACLE["model_round_trip"] = f"""WITH {ACTIVITY}, {RISK}, {FEATURED}, {FOREST}
  SELECT event_id, round(d, 6) AS decision, 0.05::DOUBLE AS threshold FROM forest"""
ORACLE["write_predictions"] = WITH_S + """SELECT 'predictions' AS output, count(*) AS "rows", count(DISTINCT event_id) AS events FROM scored
  UNION ALL SELECT 'high', count(*), count(DISTINCT event_id) FROM scored WHERE risk_level = 'HIGH'
  UNION ALL SELECT 'incidents', count(*), count(DISTINCT event_id) FROM scored WHERE risk_level <> 'LOW'"""
ORACLE["scan_incidents"] = WITH_I + "SELECT incident_id, risk_level, 'OPEN' AS status FROM incidents"

NOT_JSON = "Message body is not valid JSON"
NOT_ENVELOPE = "Message is not a scoring message: send identity under ''event''"
ERROR = f"""CASE WHEN seq % 17 = 0 THEN '{NOT_JSON}' WHEN seq % 19 = 0 THEN '{NOT_ENVELOPE}'
  WHEN seq % 23 = 0 THEN 'Invalid scoring message: unexpected field: featurez'
  WHEN seq % 29 = 0 THEN 'Invalid scoring message: source_ip must be a valid IP address'
  WHEN seq % 31 = 0 OR seq % 37 = 0 OR seq % 41 = 0 OR seq % 43 = 0 OR seq % 47 = 0 OR seq % 53 = 0
    OR seq % 59 = 0 OR seq % 61 = 0 THEN '{NOT_JSON}'
  WHEN seq % 67 = 0 OR seq % 71 = 0 THEN 'Invalid scoring message: repeated field' END"""
GOOD = "(" + " AND ".join(
    f"seq % {n} <> 0" for n in (17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71)
) + ")"
ORACLE["score_envelopes"] = WITH_FOREST + f"""SELECT 'msg-' || seq AS message_id,
  CASE WHEN {GOOD} THEN round(fa, 4) END AS anomaly_score, CASE WHEN {GOOD} THEN round(fr, 4) END AS rule_score,
  CASE WHEN {GOOD} THEN round(ff, 4) END AS final_risk_score, CASE WHEN {GOOD} THEN {LEVEL_FF} END AS risk_level,
  {ERROR} AS error FROM forest_final"""

# --- validation --------------------------------------------------------------------
ORACLE["parse_envelopes"] = WITH_F + f"""SELECT 'msg-' || seq AS message_id, {ERROR} AS error,
  CASE WHEN {GOOD} THEN event_id END AS event_id, CASE WHEN {GOOD} THEN {US} END AS at_us,
  CASE WHEN {GOOD} THEN source_ip END AS source_ip, CASE WHEN {GOOD} THEN api_risk_score END AS api_risk_score,
  CASE WHEN {GOOD} THEN 12 END AS n_features FROM featured"""
ORACLE["quarantine"] = WITH_A + f"SELECT 'msg-' || seq AS message_id, {ERROR} AS error FROM activity WHERE NOT {GOOD}"
ORACLE["validate_context"] = WITH_A + """SELECT seq, concat_ws(' | ',
  CASE WHEN seq % 37 = 0 THEN 'event_id must have 1 to 128 characters' END,
  CASE WHEN seq % 41 = 0 THEN 'timestamp must be an ISO date-time' END,
  CASE WHEN seq % 31 <> 0 AND seq % 59 = 0 THEN 'service must have at most 128 characters' END,
  CASE WHEN seq % 31 <> 0 AND (seq % 43 = 0 OR (seq % 47 <> 0 AND seq % 53 = 0))
    THEN 'source_ip must be a valid IP address' END,
  CASE WHEN seq % 31 = 0 THEN 'event must carry at least one of principal_id, source_ip, event_name, service, region' END
  ) AS context_errors FROM activity"""
ORACLE["validate_features"] = WITH_A + """SELECT event_id,
  CASE WHEN seq % 11 = 0 THEN 'features must not be empty'
    WHEN seq % 5 = 0 AND seq % 7 IN (0, 1, 3) THEN 'features must be finite numbers: a, b'
    WHEN seq % 5 = 0 THEN 'features must be finite numbers: a'
    WHEN seq % 7 IN (0, 1, 3) THEN 'features must be finite numbers: b' ELSE '' END AS feature_errors,
  CAST(CASE WHEN seq % 11 = 0 OR seq % 5 = 0 OR seq % 7 IN (0, 1, 3) THEN NULL
    WHEN seq % 7 = 2 THEN -999 ELSE 1.5 END AS DOUBLE) AS total FROM activity"""
_RAW_ERRORS = """concat_ws(' | ', CASE WHEN seq % 17 = 0 THEN 'user_agent must have 1 to 512 characters' END,
  CASE WHEN seq % 13 = 0 THEN 'account_id must be 12 digits' END,
  CASE WHEN seq % 19 = 0 THEN 'region must be a region name' END,
  CASE WHEN seq % 37 = 0 THEN 'source_ip must be a valid IP address' END,
  CASE WHEN seq % 31 = 0 THEN 'success must be true or false' END,
  CASE WHEN seq % 23 = 0 THEN 'label must be normal or suspicious' END,
  CASE WHEN seq % 29 = 0 THEN 'attack_type must have at most 128 characters' END) AS violations"""
ORACLE["validate_security_events"] = WITH_A + f"SELECT seq, {_RAW_ERRORS} FROM activity"
ORACLE["read_event_lines"] = WITH_A + f"SELECT event_id, {US} AS at_us, {_RAW_ERRORS} FROM activity"
ORACLE["require_features"] = WITH_A + """SELECT event_id, concat_ws(' | ',
  CASE WHEN seq % 3 = 0 THEN 'hour_of_day' END, CASE WHEN seq % 5 = 0 THEN 'is_weekend' END,
  'api_risk_score') AS missing_features FROM activity"""
ORACLE["check_predictions"] = WITH_S + """SELECT event_id FROM scored
  WHERE seq % 15 = 0 OR (seq % 10 = 0 AND final_risk_score > 0)"""
ORACLE["correlation_dimensions"] = WITH_A + """SELECT event_id, concat_ws(';', 'event_name=' || event_name,
  'principal_id=' || principal_id, CASE WHEN seq % 4 <> 0 THEN 'region=' || region END,
  CASE WHEN seq % 3 <> 0 THEN 'service=' || service END, 'source_ip=' || source_ip) AS dimensions FROM activity"""
ORACLE["envelope_round_trip"] = WITH_F + f"SELECT event_id, {US} AS at_us, " + ", ".join(K.IDENTITY) + (
    ", CAST(NULL AS VARCHAR) AS error, "
) + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in K.FEATURES) + " FROM featured"
ORACLE["filter_risk"] = WITH_S + "SELECT event_id, final_risk_score FROM scored WHERE risk_level = 'HIGH'"
ORACLE["incidents_only"] = WITH_S + "SELECT event_id, risk_level FROM scored WHERE risk_level <> 'LOW'"
ORACLE["recent_rows"] = WITH_S + f"""SELECT {US} AS at_us, event_name, principal_id, service, risk_level, final_risk_score
  FROM scored WHERE risk_level = 'MEDIUM' ORDER BY "timestamp", event_id LIMIT 100"""
ORACLE["incident_detail"] = WITH_S + f"""SELECT event_id, {US} AS at_us, event_name, service, principal_id,
  'N/A' AS attack_type, final_risk_score, risk_level, reasons FROM scored WHERE event_id = 'evt-5'"""

# --- model evaluation --------------------------------------------------------------
ORACLE["stratified_split"] = WITH_A + """SELECT label_binary, part,
  CAST(CASE part WHEN 'held' THEN floor(n * 0.2 + 0.5) ELSE n - floor(n * 0.2 + 0.5) END AS BIGINT) AS "rows"
  FROM (SELECT label_binary, count(*) AS n FROM activity GROUP BY 1), (VALUES ('fit'), ('held')) p(part)"""
SUSPICION = f"WITH {ACTIVITY}, s AS (SELECT -decision_value AS score, label_binary AS y FROM activity)"
LINES = """WITH s AS (SELECT l_quantity + floor(l_discount * 100) / 10 AS score,
  CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)"""
CURVE = """, c AS (SELECT score, count(*) AS n, sum(y) AS p FROM s GROUP BY score),
  w AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS rn, sum(p) OVER (ORDER BY score DESC) AS rp,
    sum(n) OVER () AS total, sum(p) OVER () AS pos FROM c)"""
_CALIBRATE = """, f AS (SELECT score, 2.0 * (rp / rn) * (rp / pos) / greatest(rp / rn + rp / pos, 1e-12) AS f1
    FROM (SELECT score, rp::DOUBLE AS rp, rn::DOUBLE AS rn, pos::DOUBLE AS pos FROM w))
  SELECT round(score, 6) AS threshold, round(f1, 6) AS f1_score FROM f ORDER BY f1 DESC, score LIMIT 1"""
_ROC = """ SELECT round(sum((n - p) * (rp - p + p / 2.0))::DOUBLE / (max(pos) * (max(total) - max(pos)))::DOUBLE, 6) AS roc_auc FROM w"""
_AP = """ SELECT round(sum((p::DOUBLE / pos) * (rp::DOUBLE / rn)), 6) AS pr_auc FROM w"""
for _suffix, _base in (("", SUSPICION), ("_lineitem", LINES)):
    ORACLE["calibrate_threshold" + _suffix] = _base + CURVE + _CALIBRATE
    ORACLE["roc_auc" + _suffix] = _base + CURVE + _ROC
    ORACLE["average_precision" + _suffix] = _base + CURVE + _AP


def _metrics(cutoff) -> str:
    return f"""m AS (SELECT count(*) AS testing_rows, count(*) FILTER (score >= {cutoff}) AS flagged_rows,
    count(*) FILTER (score < {cutoff} AND y = 0) AS true_negatives,
    count(*) FILTER (score >= {cutoff} AND y = 0) AS false_positives,
    count(*) FILTER (score < {cutoff} AND y = 1) AS false_negatives,
    count(*) FILTER (score >= {cutoff} AND y = 1) AS true_positives FROM s),
  rates AS (SELECT *, coalesce(true_positives / nullif(true_positives + false_positives, 0), 0.0) AS "precision",
    coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0.0) AS recall,
    coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0.0) AS f1_score FROM m)"""


_COUNTS = "testing_rows, flagged_rows, true_negatives, false_positives, false_negatives, true_positives"
_RATES = 'round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1_score, 6) AS f1_score'
ORACLE["classification_metrics"] = SUSPICION + f", {_metrics(T)} SELECT {_COUNTS}, {_RATES} FROM rates"
ORACLE["classification_metrics_labels"] = (
    "WITH s AS (SELECT toxic AS score, quality AS y FROM labels), " + _metrics(1) + f" SELECT {_COUNTS}, {_RATES} FROM rates"
)
ORACLE["contamination_baseline"] = (
    f"WITH {ACTIVITY}, s AS (SELECT CAST(decision_value < 0 AS INT) AS score, label_binary AS y FROM activity), "
    + _metrics(1) + f" SELECT {_COUNTS}, {_RATES} FROM rates"
)
ORACLE["evaluate_model"] = SUSPICION + CURVE + f""", {_metrics(T)} SELECT {_COUNTS}, round({T}::DOUBLE, 6) AS anomaly_threshold, {_RATES},
  (SELECT roc_auc FROM ({_ROC})) AS roc_auc, (SELECT pr_auc FROM ({_AP})) AS pr_auc FROM rates"""
ORACLE["evaluation_report"] = SUSPICION + CURVE + f""", {_metrics(T)} SELECT round("precision", 6) AS "precision",
  round(recall, 6) AS recall, round(f1_score, 6) AS f1, (SELECT roc_auc FROM ({_ROC})) AS roc_auc,
  (SELECT pr_auc FROM ({_AP})) AS pr_auc, round(f1_score, 6) AS flat_f1 FROM rates"""
ORACLE["risk_level_metrics"] = f"WITH {ACTIVITY}, {RISK}, {FEATURED}, {RAW}, {SCORED}, " + """
  s AS (SELECT CAST(risk_level <> 'LOW' AS INT) AS score, label_binary AS y FROM scored WHERE seq % 5 <> 0), """ + _metrics(1) + """
  SELECT round("precision", 4) AS "precision", round(recall, 4) AS recall, round(f1_score, 4) AS f1_score,
  true_negatives, false_positives, false_negatives, true_positives FROM rates"""
ORACLE["evaluate_gates"] = LINES + f""", {_metrics(5.0)},
  g AS (SELECT 1 AS position, 'recall' AS metric, recall AS v, 0.70::DOUBLE AS required FROM rates
    UNION ALL SELECT 2, 'precision', "precision", 0.70 FROM rates UNION ALL SELECT 3, 'pr_auc', 0.0, 0.65 FROM rates)
  SELECT position, metric, round(v, 6) AS "value", required, v >= required AS passed,
    format('{{:<10}} {{:.4f}} (required >= {{:.2f}}) {{}}', metric, v, required, CASE WHEN v >= required THEN 'PASS' ELSE 'FAIL' END) AS line,
    (SELECT bool_and(v >= required) FROM g) AS all_passed FROM g"""

# --- reports -----------------------------------------------------------------------
ORACLE["batch_summary"] = WITH_S + """SELECT count(*) AS total_events,
  count(*) FILTER (risk_level = 'LOW') AS low_risk_events, count(*) FILTER (risk_level = 'MEDIUM') AS medium_risk_events,
  count(*) FILTER (risk_level = 'HIGH') AS high_risk_events, count(*) FILTER (flagged) AS ml_flagged_anomalies,
  round(avg(anomaly_score), 4) AS average_anomaly_score, round(avg(final_risk_score), 4) AS average_final_risk_score FROM scored"""
ORACLE["kpis"] = WITH_S + """SELECT count(*) AS total_events, count(*) FILTER (flagged) AS suspicious_predictions,
  count(*) FILTER (risk_level = 'HIGH') AS high_risk_incidents,
  round(100 * count(*) FILTER (flagged AND label_binary = 1) / sum(label_binary), 1) AS recall_percent FROM scored"""
ORACLE["risk_distribution"] = WITH_S + "SELECT risk_level, count(*) AS events FROM scored GROUP BY 1"
ORACLE["hourly_risk_counts"] = WITH_S + """SELECT epoch_us(date_trunc('hour', "timestamp")) AS hour_us, risk_level,
  count(*) AS events FROM scored GROUP BY 1, 2"""
ORACLE["attack_type_counts"] = f"WITH {ACTIVITY}, {CATEGORIES} " + """SELECT category AS attack_type, count(*) AS events
  FROM activity JOIN categories ON lower(event_name) = call WHERE label_binary = 1 GROUP BY 1"""
ORACLE["service_counts"] = WITH_A + """SELECT service, count(*) AS events,
  round(count(*) / (SELECT count(*) FROM activity), 6) AS share FROM activity GROUP BY 1"""
ORACLE["score_histogram"] = WITH_S + """SELECT CAST(least(floor(anomaly_score * 40), 39) AS INT) AS bin, risk_level,
  count(*) AS events FROM scored GROUP BY 1, 2"""
ORACLE["score_scatter"] = WITH_S + """SELECT event_id, anomaly_score, rule_score, risk_level, event_name, principal_id
  FROM scored"""
ORACLE["score_grid"] = WITH_S + """SELECT CAST(least(floor(anomaly_score * 10), 9) AS INT) AS anomaly_bin,
  CAST(least(floor(rule_score * 10), 9) AS INT) AS rule_bin, risk_level, count(*) AS events FROM scored GROUP BY 1, 2, 3"""
METRICS = f"""metrics AS (SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, "timestamp")) AS period_us,
  count(*) FILTER (seq % 17 <> 0) AS events_processed,
  count(*) FILTER (seq % 17 <> 0 AND risk_level = 'HIGH') AS high_risk_incidents,
  count(*) FILTER (seq % 17 <> 0 AND risk_level = 'MEDIUM') AS medium_risk_incidents,
  count(*) FILTER (seq % 17 <> 0 AND risk_level = 'LOW') AS low_risk_events,
  count(*) FILTER (seq % 17 = 0) AS processing_failures,
  CAST(max(seq % 401) AS DOUBLE) AS oldest_age_seconds FROM scored GROUP BY 1)"""
ORACLE["scoring_metrics"] = f"WITH {ACTIVITY}, {RISK}, {FEATURED}, {RAW}, {SCORED}, {METRICS} SELECT * FROM metrics"
ORACLE["alarms"] = f"WITH {ACTIVITY}, {RISK}, {FEATURED}, {RAW}, {SCORED}, {METRICS} " + """
  SELECT period_us, 'scoring-errors' AS alarm, processing_failures::DOUBLE AS reading, processing_failures >= 1 AS breached FROM metrics
  UNION ALL SELECT period_us, 'quarantined-messages', processing_failures::DOUBLE, processing_failures >= 1 FROM metrics
  UNION ALL SELECT period_us, 'queue-age', oldest_age_seconds, oldest_age_seconds >= 300 FROM metrics"""
ORACLE["latency_stats"] = WITH_A + """SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, "timestamp", TIMESTAMP '1970-01-01')) AS period_us,
  count(value) AS samples, round(avg(value), 6) AS average, round(quantile_cont(value, 0.99), 6) AS p99 FROM activity GROUP BY 1"""
ORACLE["latency_rollup"] = WITH_A + """SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, "timestamp", TIMESTAMP '1970-01-01')) AS period_us,
  count(value) AS samples, round(avg(value), 6) AS average, TRUE AS within_bound FROM activity GROUP BY 1"""

# --- incidents ---------------------------------------------------------------------
ORACLE["build_incidents"] = WITH_I + f"""SELECT incident_id, {US} AS at_us, risk_level, final_risk_score, anomaly_score, rule_score,
  model_flagged_anomaly, 'unknown' AS model_version, 'OPEN' AS status, principal_id, source_ip, event_name, service, region,
  reasons, CAST(calls_last_5m AS DOUBLE) AS calls_last_5m, api_risk_score FROM incidents"""
ORACLE["normalize_incidents"] = WITH_I + """SELECT incident_id,
  CASE WHEN seq % 4 <> 3 THEN principal_id END AS principal_id, source_ip, event_name, service, region,
  attack_category, risk_level, final_risk_score,
  CASE WHEN seq % 4 <> 3 THEN round(api_risk_score, 6) END AS api_risk_score FROM incidents"""
ORACLE["as_number"] = WITH_A + """, t AS (SELECT event_id, seq % 5 AS m, value FROM activity)
  SELECT event_id, CASE WHEN m IN (0, 1) THEN 0.0 WHEN m = 2 THEN 9.99::DOUBLE WHEN m = 3 THEN -0.25 ELSE value END AS number,
  CASE WHEN m IN (0, 1, 3) THEN 0.0 WHEN m = 2 THEN 1.0 ELSE greatest(0.0, least(1.0, value)) END AS clamped,
  m NOT IN (0, 1) AS usable FROM t"""
ORACLE["attack_category"] = f"WITH {ACTIVITY}, {CATEGORIES} " + """SELECT event_id, category AS attack_category
  FROM activity LEFT JOIN categories ON lower(event_name) = call"""
ODD = """odd AS (SELECT incident_id, risk_level,
  CASE seq % 13 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE
    ELSE final_risk_score END AS final_risk_score,
  CASE seq % 5 WHEN 0 THEN ' Defense_Evasion ' WHEN 1 THEN 'unheard-of' WHEN 2 THEN attack_category END AS stored,
  CASE seq % 7 WHEN 0 THEN 'DescribeThings' WHEN 1 THEN 'FooBar' WHEN 2 THEN 'Query' ELSE event_name END AS name,
  CASE WHEN seq % 3 = 0 THEN 'CloudTrail' ELSE service END AS svc FROM incidents),
classified AS (SELECT odd.*, CASE
    WHEN replace(replace(lower(trim(stored)), '_', '-'), ' ', '-') IN (SELECT category FROM categories)
      THEN replace(replace(lower(trim(stored)), '_', '-'), ' ', '-')
    WHEN c.category IS NOT NULL THEN c.category
    WHEN lower(name) LIKE 'list%' OR lower(name) LIKE 'describe%' THEN 'reconnaissance'
    WHEN lower(svc) IN ('iam', 'sts', 'signin') THEN 'credential-compromise'
    WHEN lower(svc) IN ('s3', 'dynamodb', 'rds') THEN 'data-exfiltration'
    WHEN lower(svc) = 'cloudtrail' THEN 'defense-evasion' END AS category
  FROM odd LEFT JOIN categories c ON lower(name) = c.call)"""
WITH_ODD = f"WITH {ACTIVITY}, {RISK}, {FEATURED}, {RAW}, {SCORED}, {CATEGORIES}, {INCIDENTS}, {ODD} "
ORACLE["classify"] = WITH_ODD + "SELECT incident_id, category FROM classified"
PLAYBOOKS = "playbooks AS (SELECT * FROM (VALUES " + _values(
    [(cat, " | ".join(actions)) for cat, actions in K.PLAYBOOKS.items()]
) + ") t(category, actions))"
ESCALATE = f"CASE WHEN risk_level = 'HIGH' OR (final_risk_score >= 0.70 AND NOT isnan(final_risk_score::DOUBLE)) THEN ' | ' || {_quoted(K.ESCALATION)} ELSE '' END"
ORACLE["recommend_actions"] = WITH_ODD.rstrip() + f""", {PLAYBOOKS} SELECT incident_id,
  coalesce(actions, {_quoted(' | '.join(K.DEFAULT_ACTIONS))}) || {ESCALATE} AS recommended_actions
  FROM classified LEFT JOIN playbooks USING (category)"""
DIMENSION_TEXT = {n: n.replace("_", " ") for n in K.CORRELATION_WEIGHTS}


def _weight(left: str, right: str) -> str:
    return " + ".join(
        f"CASE WHEN lower({left}.{n}) = lower({right}.{n}) THEN {w} ELSE 0 END" for n, w in K.CORRELATION_WEIGHTS.items()
    )


def _why(left: str, right: str) -> str:
    parts = ", ".join(
        f"CASE WHEN lower({left}.{n}) = lower({right}.{n}) THEN 'Same {DIMENSION_TEXT[n]}: ' || {left}.{n} END"
        for n in K.CORRELATION_WEIGHTS
    )
    return f"concat_ws(' | ', {parts})"


ORACLE["correlate"] = WITH_I + f"""SELECT l.seq, CAST({_weight('l', 'r')} AS INT) AS correlation_score, {_why('l', 'r')} AS match_reasons
  FROM incidents l JOIN incidents r ON r.seq = l.seq + 1"""
ORACLE["get_incident"] = WITH_I + """SELECT incident_id, risk_level, 'OPEN' AS status, principal_id FROM incidents
  WHERE incident_id = 'evt-5'"""
RELATED = f"""related AS (SELECT r.incident_id AS candidate_id, epoch_us(r."timestamp") AS at_us,
    CAST({_weight('l', 'r')} AS INT) AS correlation_score, {_why('l', 'r')} AS match_reasons
  FROM incidents l, incidents r WHERE l.incident_id = 'evt-5' AND r.incident_id <> 'evt-5'
    AND {_weight('l', 'r')} >= 2 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 25)"""
ORACLE["find_related"] = WITH_I.rstrip() + f""", {RELATED} SELECT related.*, principal_id, source_ip, event_name, risk_level,
  round(final_risk_score, 6) AS final_risk_score FROM related JOIN incidents ON incident_id = candidate_id"""
# Every pair is compared, on the distinct combinations of values; ranking is per incident.
_SAME = {n: f"l.{n} = r.{n}" for n in K.CORRELATION_WEIGHTS}
ALL_RELATED = f"""folded AS MATERIALIZED (SELECT incident_id, "timestamp" AS moment, {", ".join(f"lower({n}) AS {n}" for n in K.CORRELATION_WEIGHTS)}
  FROM incidents),
profiles AS MATERIALIZED (SELECT row_number() OVER () AS p, * FROM (SELECT DISTINCT {", ".join(K.CORRELATION_WEIGHTS)} FROM folded)),
placed AS MATERIALIZED (SELECT f.incident_id, f.moment, p.p FROM folded f JOIN profiles p ON
  {" AND ".join(f"f.{n} IS NOT DISTINCT FROM p.{n}" for n in K.CORRELATION_WEIGHTS)}),
newest AS MATERIALIZED (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY p ORDER BY moment DESC NULLS LAST, incident_id) <= 26),
pairs AS (SELECT l.p AS p, r.p AS q, {" + ".join(f"CASE WHEN {_SAME[n]} THEN {w} ELSE 0 END" for n, w in K.CORRELATION_WEIGHTS.items())} AS score
  FROM profiles l, profiles r WHERE score >= 2),
best AS MATERIALIZED (SELECT pairs.p, n.incident_id AS related_id, n.moment, score FROM pairs JOIN newest n ON n.p = pairs.q
  QUALIFY row_number() OVER (PARTITION BY pairs.p ORDER BY score DESC, n.moment DESC NULLS LAST, n.incident_id) <= 26),
all_related AS (SELECT a.incident_id, b.related_id, b.score,
    row_number() OVER (PARTITION BY a.incident_id ORDER BY b.score DESC, b.moment DESC NULLS LAST, b.related_id) AS place
  FROM placed a JOIN best b ON a.p = b.p WHERE a.incident_id <> b.related_id QUALIFY place <= 25)"""
ORACLE["find_related_all"] = WITH_I.rstrip() + f""", {ALL_RELATED} SELECT x.incident_id, CAST(place AS INT) AS "rank", related_id,
  CAST(score AS INT) AS correlation_score, {_why('l', 'r')} AS match_reasons
  FROM all_related x JOIN incidents l ON l.incident_id = x.incident_id JOIN incidents r ON r.incident_id = x.related_id"""
EXPLAINED = f"""explained AS (SELECT *, concat_ws(' | ',
    CASE WHEN anomaly_score >= 0.70 THEN format('High anomaly score ({{:.2f}})', anomaly_score) END,
    CASE WHEN sensitive THEN 'Sensitive IAM operation (' || event_name || ')' END,
    CASE WHEN k % 4 = 0 THEN 'External source IP (' || source_ip || ')' END,
    CASE WHEN hour_of_day NOT BETWEEN 8 AND 19 THEN format('Unusual execution hour ({{:02d}}:00 UTC)', hour_of_day) END,
    CASE WHEN region <> 'us-east-1' THEN 'Activity outside the normal AWS Region (' || region || ')' END,
    CASE WHEN failed_calls_last_5m >= 2 THEN format('Multiple recent failed calls ({{}} in the last 5 minutes)', failed_calls_last_5m) END
  ) AS found FROM incidents),
explained2 AS (SELECT *, CASE WHEN found = '' THEN reasons ELSE found END AS explanation FROM explained)"""
ORACLE["explain"] = WITH_I.rstrip() + f", {EXPLAINED} SELECT incident_id, explanation FROM explained2"
# NaN is never at least anything and shows no detail; an unusable hour is no hour.
ODD_EXPLAINED = f"""explained AS (SELECT *, concat_ws(' | ',
    CASE WHEN seq % 11 = 5 THEN 'High anomaly score (inf)'
      WHEN seq % 11 = 4 THEN CASE WHEN seq % 22 = 4 THEN 'High anomaly score (nan)' END
      WHEN anomaly_score >= 0.70 THEN format('High anomaly score ({{:.2f}})', anomaly_score) END,
    CASE WHEN sensitive THEN 'Sensitive IAM operation (' || event_name || ')' END,
    CASE WHEN k % 4 = 0 THEN 'External source IP (' || source_ip || ')' END,
    CASE WHEN seq % 11 IN (2, 3) THEN CASE WHEN unusual_hour = 1 THEN 'Unusual execution hour' END
      WHEN hour_of_day NOT BETWEEN 8 AND 19 THEN format('Unusual execution hour ({{:02d}}:00 UTC)', hour_of_day) END,
    CASE WHEN region <> 'us-east-1' THEN 'Activity outside the normal AWS Region (' || region || ')' END,
    CASE WHEN seq % 11 = 1 THEN 'Multiple recent failed calls'
      WHEN seq % 11 = 0 THEN CASE WHEN seq % 22 = 11 THEN 'Multiple recent failed calls' END
      WHEN failed_calls_last_5m >= 2 THEN format('Multiple recent failed calls ({{}} in the last 5 minutes)', failed_calls_last_5m) END
  ) AS found FROM incidents),
explained2 AS (SELECT *, CASE WHEN found = '' THEN reasons ELSE found END AS explanation FROM explained)"""
ORACLE["explain_odd_numbers"] = WITH_I.rstrip() + f", {ODD_EXPLAINED} SELECT incident_id, explanation FROM explained2"
REPORTS = f"""reports AS (SELECT e.incident_id, risk_level AS severity, final_risk_score AS risk_score,
    'This incident was classified as ' || risk_level || format(' with a final risk score of {{:.2f}}. ', final_risk_score)
      || 'The main detection reasons were: ' || replace(explanation, ' | ', ', ') || '.' AS summary,
    explanation AS suspicious_reasons,
    coalesce(actions, {_quoted(' | '.join(K.DEFAULT_ACTIONS))}) || {ESCALATE} AS recommended_actions
  FROM (SELECT *, coalesce(attack_category, CASE WHEN event_name LIKE 'List%' OR event_name LIKE 'Describe%'
    THEN 'reconnaissance' WHEN service = 's3' THEN 'data-exfiltration' END) AS category FROM explained2) e
  LEFT JOIN playbooks USING (category))"""
WITH_REPORTS = WITH_I.rstrip() + f", {EXPLAINED}, {PLAYBOOKS}, {REPORTS} "
ORACLE["incident_reports"] = WITH_REPORTS + "SELECT * FROM reports"
ORACLE["investigate"] = WITH_REPORTS.rstrip() + f""", {RELATED} SELECT *,
  (SELECT string_agg(candidate_id, ',' ORDER BY correlation_score DESC, at_us DESC, candidate_id) FROM related) AS related_ids
  FROM reports WHERE incident_id = 'evt-5'"""
ORACLE["investigate_all"] = WITH_REPORTS.rstrip() + f""", {ALL_RELATED} SELECT reports.*,
  coalesce((SELECT string_agg(related_id, ',' ORDER BY place) FROM all_related x WHERE x.incident_id = reports.incident_id), '') AS related_ids
  FROM reports"""
ORACLE["alert_payload"] = WITH_I + """SELECT incident_id, 'HIGH AWS threat detected: ' || incident_id AS subject,
  risk_level, model_prediction, principal_id, source_ip, event_name, service,
  CASE WHEN service = 'iam' THEN 'unknown' ELSE region END AS region,
  strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') AS event_time, final_risk_score FROM incidents WHERE risk_level = 'HIGH'"""
ORACLE["insert_incidents"] = WITH_A + f"SELECT event_id AS incident_id, {US} AS at_us FROM activity WHERE seq % 4 <> 0"
ORACLE["alert_on_repeat"] = WITH_I + """SELECT incident_id, 'HIGH AWS threat detected: ' || incident_id AS subject
  FROM incidents WHERE risk_level = 'HIGH' AND seq % 4 <> 0"""
ORACLE["latest_approved_model"] = """SELECT event_type AS model_group, event_id AS "version", 'Approved' AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
    FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) % 3 = 0) WHERE rn = 1"""
