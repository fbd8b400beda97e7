"""Incident records: building, reading, normalising, explaining and advising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtrail.functions import constants as K
from watchtrail.functions.network import is_internal_ip
from watchtrail.functions.values import (
    any_of,
    as_number,
    at_least,
    compact_texts,
    fires,
    fixed_text,
    is_finite,
    is_single_json,
    once,
    text_array,
    text_or_null,
    unit_score,
)
from watchtrail.operators.ranking import first_per_key

SCORE_TYPE = "decimal(5,4)"


# --- building and storing ----------------------------------------------------------


def build_incidents(
    scored: DataFrame,
    features: tuple[str, ...] | None = K.FEATURES,
    scored_at: Column | None = None,
    model_version: str = "unknown",
) -> DataFrame:
    """Turn scored events into incident rows; an unpopulated field is NULL.

    ``features`` names the columns that become the stored map; None keeps an existing
    ``features`` map.
    """
    present = set(scored.columns)
    if features is None:
        vector = F.col("features")
    else:
        vector = F.create_map(
            *[part for n in features for part in (F.lit(n), F.col(n).cast("double"))]
        )
    extra = F.col("event_context") if "event_context" in present else F.lit(None).cast("map<string,string>")
    version = F.col("model_version") if "model_version" in present else F.lit(model_version)
    schema = F.col("schema_version") if "schema_version" in present else F.lit(K.SCHEMA_VERSION)
    return scored.select(
        F.col("event_id").alias("incident_id"),
        "event_id",
        schema.alias("schema_version"),
        (F.current_timestamp() if scored_at is None else scored_at).alias("timestamp"),
        F.col("timestamp").alias("event_time"),
        "risk_level",
        *[F.col(n).cast(SCORE_TYPE).alias(n) for n in ("final_risk_score", "anomaly_score", "rule_score")],
        "model_prediction",
        "model_flagged_anomaly",
        version.alias("model_version"),
        "reasons",
        F.lit("OPEN").alias("status"),
        *[text_or_null(F.col(n)).alias(n) for n in K.IDENTITY],
        F.when(F.size(vector) > 0, vector).alias("features"),
        F.when(F.size(extra) > 0, extra).alias("event_context"),
    )


def first_deliveries(df: DataFrame, key: str = "incident_id", order: str = "timestamp") -> DataFrame:
    """Keep the first delivery of each id; equal times are settled by row content."""
    comparable = [n for n, t in df.dtypes if not t.startswith(("map", "variant"))]
    return first_per_key(df, [key], [F.col(order).asc_nulls_last(), F.xxhash64(*comparable)])


def new_incidents(incoming: DataFrame, store: DataFrame, order: str = "timestamp") -> DataFrame:
    """Insert-if-absent: first delivery of each id that the store does not hold yet."""
    return first_deliveries(incoming, order=order).join(
        store.select("incident_id"), "incident_id", "left_anti"
    )


def get_incident(incidents: DataFrame, incident_id: str) -> DataFrame:
    if not incident_id or not str(incident_id).strip():
        raise ValueError("give a non-empty incident_id")
    return incidents.filter(F.col("incident_id") == str(incident_id))


def scan_incidents(incidents: DataFrame, max_items: int | None = None) -> DataFrame:
    return incidents if max_items is None else incidents.limit(max_items)


# --- normalising -------------------------------------------------------------------

# --- fixed values: names under which a field may be stored ---
ALIASES = {
    "incident_id": ("incident_id", "incidentId", "id"),
    "timestamp": ("timestamp", "eventTime", "event_time"),
    "principal_id": ("principal_id", "principalId", "user_name", "userName"),
    "source_ip": ("source_ip", "sourceIPAddress", "sourceIp"),
    "event_name": ("event_name", "eventName"),
    "service": ("service", "eventSource", "event_source"),
    "region": ("region", "awsRegion", "aws_region"),
    "attack_category": ("attack_category", "attack_type", "attackType"),
    "risk_level": ("risk_level", "riskLevel"),
    "anomaly_score": ("anomaly_score", "anomalyScore"),
    "rule_score": ("rule_score", "ruleScore"),
    "final_risk_score": ("final_risk_score", "finalRiskScore"),
}
IDENTITY_FALLBACKS = ("principalId", "userName", "arn")
VIEW_COLUMNS = (*ALIASES, "reasons", "score_metadata", "features")


def attack_category(event_name: Column) -> Column:
    """Category of an API call, case-insensitive; NULL for an unknown call."""
    name = F.lower(event_name)
    result = F.lit(None).cast("string")
    for category, calls in K.ATTACK_CATEGORIES.items():
        result = F.when(name.isin(*calls), category).otherwise(result)
    return result


def normalize_incidents(df: DataFrame) -> DataFrame:
    """The canonical view of incidents stored in any of the known shapes.

    A field is looked up in the row under each of its names, then in the stored payload.
    The payload is the first populated one of ``features``, ``original_payload`` and
    ``payload``, given as a map or as JSON text; unreadable JSON counts as empty.
    """
    types = dict(df.dtypes)
    open_payload = any(n in types for n in ("original_payload", "payload")) or not _is_numeric_map(
        types.get("features", "map<string,double>")
    )
    staged = once(df, {"_payload": _payload_map(types)}) if open_payload else df
    staged = staged.withColumn("_numbers", _numeric_map(types, open_payload))

    def candidates(names, kind="string"):
        stored = [F.col(n) for n in names if n in types]
        packed = [F.col("_payload")[n] for n in names] if open_payload else []
        if kind == "timestamp":
            return [c.cast("string").try_cast("timestamp") for c in stored + packed]
        return [text_or_null(c) for c in stored + packed]

    def field(names, kind="string"):
        found = candidates(names, kind)
        return F.coalesce(*found) if found else F.lit(None).cast(kind)

    def number(names):
        return as_number(field(names))

    user = _identity_map(types, open_payload)
    service = F.regexp_replace(field(ALIASES["service"]), r"\.amazonaws\.com\z", "")
    event_name = field(ALIASES["event_name"])
    principal = [field(ALIASES["principal_id"])] + (
        [text_or_null(user[n]) for n in IDENTITY_FALLBACKS] if user is not None else []
    )
    return staged.select(
        field(ALIASES["incident_id"]).alias("incident_id"),
        field(ALIASES["timestamp"], "timestamp").alias("timestamp"),
        F.coalesce(*principal).alias("principal_id"),
        field(ALIASES["source_ip"]).alias("source_ip"),
        event_name.alias("event_name"),
        service.alias("service"),
        field(ALIASES["region"]).alias("region"),
        F.coalesce(field(ALIASES["attack_category"]), attack_category(event_name)).alias(
            "attack_category"
        ),
        field(ALIASES["risk_level"]).alias("risk_level"),
        number(ALIASES["anomaly_score"]).alias("anomaly_score"),
        number(ALIASES["rule_score"]).alias("rule_score"),
        number(ALIASES["final_risk_score"]).alias("final_risk_score"),
        _reasons(types, open_payload).alias("reasons"),
        _metadata(types, open_payload).alias("score_metadata"),
        F.col("_numbers").alias("features"),
    )


def _is_numeric_map(kind: str) -> bool:
    return kind.startswith("map<string,") and not kind.startswith("map<string,string")


def _payload_map(types: dict[str, str]) -> Column:
    """Payload as text by name; numeric feature maps are read by ``_numeric_map`` instead."""
    found = []
    for name in ("features", "original_payload", "payload"):
        kind = types.get(name)
        if kind is None:
            continue
        if kind == "string":
            blank = F.trim(F.col(name)) == ""
            parsed = F.when(is_single_json(F.col(name)), F.from_json(name, "map<string,string>"))
            opened = F.coalesce(parsed, F.create_map().cast("map<string,string>"))
            found.append(F.when(F.col(name).isNotNull() & ~blank, opened))
        else:
            found.append(F.when(F.size(name) > 0, F.col(name).cast("map<string,string>")))
    found.append(F.create_map().cast("map<string,string>"))
    return F.coalesce(*found)


def _numeric_map(types: dict[str, str], open_payload: bool) -> Column:
    """The payload's numbers; a value that is not one is NULL."""
    found = []
    if _is_numeric_map(types.get("features", "")):
        stored = F.col("features").cast("map<string,double>")
        found.append(F.when(F.size(stored) > 0, stored))
    if open_payload:
        found.append(
            F.transform_values(
                "_payload",
                lambda _, v: F.when(v == "true", 1.0).otherwise(v.try_cast("double")),
            )
        )
    return F.coalesce(*found, F.create_map().cast("map<string,double>"))


def _identity_map(types: dict[str, str], open_payload: bool) -> Column | None:
    found = []
    kind = types.get("userIdentity")
    if kind == "string":
        found.append(F.from_json("userIdentity", "map<string,string>"))
    elif kind is not None and kind.startswith("map"):
        found.append(F.col("userIdentity").cast("map<string,string>"))
    elif kind is not None:
        found.append(F.from_json(F.to_json("userIdentity"), "map<string,string>"))
    if open_payload:
        found.append(F.from_json(F.col("_payload")["userIdentity"], "map<string,string>"))
    return F.coalesce(*found) if found else None


def _reasons(types: dict[str, str], open_payload: bool) -> Column:
    found = []
    if "reasons" in types:
        stored = F.from_json("reasons", "array<string>") if types["reasons"] == "string" else F.col("reasons")
        found.append(F.when(F.size(stored) > 0, stored))
    if open_payload:
        found.append(F.from_json(F.col("_payload")["reasons"], "array<string>"))
    found.append(F.array().cast("array<string>"))
    return F.coalesce(*found)


def _metadata(types: dict[str, str], open_payload: bool) -> Column:
    found = []
    kind = types.get("score_metadata")
    if kind == "string":
        found.append(F.from_json("score_metadata", "map<string,string>"))
    elif kind is not None:
        found.append(F.from_json(F.to_json("score_metadata"), "map<string,string>"))
    if open_payload:
        found.append(F.from_json(F.col("_payload")["score_metadata"], "map<string,string>"))
    found.append(F.create_map().cast("map<string,string>"))
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in found[:-1]], found[-1])


# --- classifying -------------------------------------------------------------------


def classify() -> Column:
    """Attack category of a normalised incident; NULL when nothing suggests one."""
    stored = F.translate(F.lower(F.trim("attack_category")), "_ ", "--")
    name = F.lower(F.trim("event_name"))
    service = F.lower(F.trim("service"))
    discovery = any_of([name.startswith(p) for p in K.ENUMERATION_PREFIXES])
    by_service = F.lit(None).cast("string")
    for category, services in K.SERVICE_CATEGORIES.items():
        by_service = F.when(service.isin(*services), category).otherwise(by_service)
    return F.coalesce(
        F.when(stored.isin(*K.PLAYBOOKS), stored),
        attack_category(name),
        F.when(discovery & ~name.isin(*K.DATA_READ_CALLS), "reconnaissance"),
        by_service,
    )


# --- explaining --------------------------------------------------------------------


def _recorded_rules() -> Column:
    def listed(name: str) -> Column:
        raw = text_or_null(F.col("score_metadata")[name])
        many = F.from_json(raw, "array<string>")
        is_list = F.ltrim(raw).startswith("[")
        return F.when(is_list & (F.size(many) > 0), many).when(~is_list, F.array(raw))

    rules = F.coalesce(listed("rules_triggered"), listed("rules"), F.array().cast("array<string>"))
    return F.transform(rules, lambda r: F.lower(F.trim(r)))


def _hour() -> Column:
    features = F.col("features")
    return F.when(
        F.map_contains_key(features, "hour_of_day"),
        F.when(is_finite(features["hour_of_day"]), features["hour_of_day"]).otherwise(-1.0),
    ).otherwise(F.hour("timestamp").cast("double"))


def _explanation(home_region: str) -> tuple[Column, Column]:
    """(reasons to show, reasons found) for a normalised incident, in reporting order."""
    features, rules = F.col("features"), F.col("_rules")

    def flag(name: str) -> Column:
        return fires(features[name])

    def recorded(*names: str) -> Column:
        return F.arrays_overlap(rules, text_array(names))

    def reason(applies: Column, text: str, detail: Column) -> Column:
        return F.when(F.coalesce(applies, F.lit(False)), F.concat(F.lit(text), F.coalesce(detail, F.lit(""))))

    def bracketed(value: Column) -> Column:
        return F.concat(F.lit(" ("), value, F.lit(")"))

    name, service = F.lower("event_name"), F.lower("service")
    hour, region = F.col("_hour"), F.col("region")
    known_hour = F.coalesce(hour >= 0, F.lit(False))
    first, last = K.WORKING_HOURS
    off_hours = known_hour & ~F.floor(hour).between(first, last)
    failures = as_number(features["failed_calls_last_5m"])
    false = F.lit(False)

    found = compact_texts(
        reason(
            at_least(F.col("anomaly_score"), K.HIGH_ANOMALY) | recorded("anomaly"),
            "High anomaly score",
            bracketed(fixed_text(F.col("anomaly_score"), 2)),
        ),
        reason(
            flag("sensitive_operation")
            | recorded("sensitive_action", "is_sensitive_action", "sensitive_operation")
            | F.coalesce(name.isin(*K.SENSITIVE_CALLS), false)
            | F.coalesce(service.isin(*K.SENSITIVE_SERVICES), false),
            "Sensitive IAM operation",
            bracketed(F.col("event_name")),
        ),
        reason(
            flag("external_ip")
            | recorded("is_external_ip", "external_ip", "external_source_ip")
            | F.coalesce(~is_internal_ip(F.col("source_ip")), false),
            "External source IP",
            bracketed(F.col("source_ip")),
        ),
        reason(
            flag("unusual_hour") | recorded("hour_risk", "time_risk") | off_hours,
            "Unusual execution hour",
            F.when(known_hour, F.format_string(" (%02d:00 UTC)", F.floor(hour))),
        ),
        reason(
            flag("outside_home_region")
            | recorded("region_risk")
            | F.coalesce(F.lower(region) != home_region.lower(), false),
            "Activity outside the normal AWS Region",
            bracketed(region),
        ),
        reason(
            at_least(failures, K.REPEATED_FAILURES) | recorded("error_rate_risk"),
            "Multiple recent failed calls",
            F.when(
                (failures != 0) & is_finite(failures),
                F.format_string(" (%d in the last 5 minutes)", failures.try_cast("long")),
            ),
        ),
    )
    stored = F.filter("reasons", lambda r: F.trim(r) != "")
    shown = (
        F.when(F.size("_found") > 0, F.col("_found"))
        .when(F.size(stored) > 0, stored)
        .otherwise(F.array(F.lit(K.MODEL_REASON)))
    )
    return shown, found


def explain(view: DataFrame, home_region: str = K.HOME_REGION) -> DataFrame:
    """Add ``explanation`` to normalised incidents."""
    chosen, found = _explanation(home_region)
    return (
        view.withColumns({"_rules": _recorded_rules(), "_hour": _hour()})
        .withColumn("_found", found)
        .withColumn("explanation", chosen)
        .drop("_rules", "_hour", "_found")
    )


# --- advising ----------------------------------------------------------------------


def recommend_actions(view: DataFrame) -> DataFrame:
    """Add ``recommended_actions``: the category's playbook, plus escalation when high."""
    advice = text_array(K.DEFAULT_ACTIONS)
    for category, actions in K.PLAYBOOKS.items():
        advice = F.when(F.col("_category") == category, text_array(actions)).otherwise(advice)
    high = (F.upper(F.coalesce("risk_level", F.lit(""))) == "HIGH") | at_least(
        F.col("final_risk_score"), K.HIGH_ANOMALY
    )
    escalated = F.when(high, F.concat(advice, F.array(F.lit(K.ESCALATION)))).otherwise(advice)
    return (
        view.withColumn("_category", classify())
        .withColumn("recommended_actions", escalated)
        .drop("_category")
    )


def report_summary(severity: Column, score: Column, reasons: Column) -> Column:
    because = F.when(
        F.size(reasons) > 0,
        F.concat(F.lit("The main detection reasons were: "), F.array_join(reasons, ", "), F.lit(".")),
    ).otherwise("No specific detection rule was recorded for this incident.")
    return F.concat(
        F.lit("This incident was classified as "),
        severity,
        F.lit(" with a final risk score of "),
        fixed_text(score, 2),
        F.lit(". "),
        because,
    )


def report_columns(view: DataFrame, home_region: str = K.HOME_REGION) -> DataFrame:
    """Severity, score, summary, reasons and actions of normalised incidents."""
    advised = recommend_actions(explain(view, home_region))
    severity = F.coalesce(text_or_null(F.col("risk_level")), F.lit("UNKNOWN"))
    score = unit_score(F.col("final_risk_score"))
    return advised.withColumns(
        {
            "severity": severity,
            "risk_score": score,
            "summary": report_summary(severity, score, F.col("explanation")),
            "suspicious_reasons": F.col("explanation"),
        }
    ).drop("explanation")


# --- alerting ----------------------------------------------------------------------


def alert_payload(incidents: DataFrame) -> DataFrame:
    """One alert per HIGH incident: a subject of at most 100 characters and a JSON message."""

    def known(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit("unknown"))

    time = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    message = F.struct(
        F.coalesce("incident_id", F.lit("unknown-event")).alias("incident_id"),
        "risk_level",
        "final_risk_score",
        "model_prediction",
        *[known(F.col(n)).alias(n) for n in K.IDENTITY],
        known(time).alias("event_time"),
        "reasons",
    )
    subject = F.concat(F.lit("HIGH AWS threat detected: "), F.coalesce("incident_id", F.lit("unknown-event")))
    return incidents.filter(F.col("risk_level") == "HIGH").select(
        "incident_id",
        F.substring(subject, 1, 100).alias("subject"),
        F.to_json(message).alias("message"),
    )


def alert_on_new(incoming: DataFrame, store: DataFrame, order: str = "timestamp") -> DataFrame:
    """Alerts for incidents that the store did not hold, so a redelivery alerts once."""
    return alert_payload(new_incidents(incoming, store, order))
