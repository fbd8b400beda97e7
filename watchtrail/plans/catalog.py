"""One named query per operator, over the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtrail.functions import constants as K
from watchtrail.functions import scoring as S
from watchtrail.functions.values import as_number as lenient_number
from watchtrail.functions.values import is_finite, unit_score
from watchtrail.operators import evaluate as E
from watchtrail.operators import features as X
from watchtrail.operators import incidents as I
from watchtrail.operators import related as R
from watchtrail.operators import report as P
from watchtrail.operators import score as C
from watchtrail.operators import validate as V
from watchtrail.operators.forest import ForestModel, read_threshold, validate_model
from watchtrail.plans.activity import (
    THRESHOLD,
    activity,
    featured,
    incidents,
    messages,
    risk_table,
    scored,
    spread,
    stored,
)
from watchtrail.session import as_table, checkpoint_dir, prepare
from watchtrail.sources.models import evaluation_document, latest_model, load_model, save_model
from watchtrail.sources.sinks import write_predictions as write_prediction_files
from watchtrail.sources.tables import read_events, read_features

INCIDENT = "evt-5"
CATALOG = {}


def query(run):
    """Register a query under its own name."""

    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(prepare(spark), sf_dir)

    CATALOG[run.__name__] = prepared
    return run


def _micros(name: str, out: str):
    return F.unix_micros(name).alias(out)


def _joined(name: str):
    return F.array_join(name, " | ").alias(name)


def _map_text(column):
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";"
    )


def _suspicious(spark, sf_dir):
    return activity(spark, sf_dir).withColumn("suspicion", -F.col("decision_value"))


# --- features ----------------------------------------------------------------------


@query
def calendar_features(spark, sf_dir):
    df = X.calendar_features(activity(spark, sf_dir))
    return df.select("event_id", "hour_of_day", "is_weekend", "unusual_hour")


@query
def event_flags(spark, sf_dir):
    df = X.event_flags(activity(spark, sf_dir))
    return df.select("event_id", "failed_call", "sensitive_operation", "outside_home_region")


@query
def external_ip(spark, sf_dir):
    return X.external_ip(activity(spark, sf_dir)).select("event_id", "external_ip")


#: Private, loopback and link-local blocks of both families.
INTERNAL_BLOCKS = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "fc00::/7", "::1/128", "fe80::/10",
)


@query
def external_ip_ranges(spark, sf_dir):
    """Addresses of six forms made from each event (its own, 172.x edges, IPv6 unique-local,
    documentation, zoned link-local and v4-mapped), judged against CIDR blocks."""
    seq = F.col("seq")
    group = F.lower(F.hex(seq % 65536))
    address = (
        F.when(seq % 6 == 0, F.col("source_ip"))
        .when(seq % 6 == 1, F.concat(F.lit("172."), seq % 40, F.lit("."), seq % 256, F.lit(".1")))
        .when(seq % 6 == 2, F.concat(F.lit("fd"), F.lpad(F.lower(F.hex(seq % 256)), 2, "0"), F.lit("::"), group))
        .when(seq % 6 == 3, F.concat(F.lit("2001:db8::"), group))
        .when(seq % 6 == 4, F.concat(F.lit("fe80::"), group, F.lit("%eth0")))
        .otherwise(F.concat(F.lit("::ffff:192.168."), seq % 256, F.lit("."), seq % 200))
    )
    events = activity(spark, sf_dir).withColumn("source_ip", address)
    return X.external_ip(events, cidrs=INTERNAL_BLOCKS).select("event_id", "source_ip", "external_ip")


def _windows(spark, sf_dir, make, spans):
    counters = [make(seconds, name) for name, seconds in spans.items()]
    df = X.rolling_counters(activity(spark, sf_dir), counters)
    return df.select("event_id", *[F.col(name) for name in spans])


@query
def calls_last(spark, sf_dir):
    return _windows(spark, sf_dir, X.calls_last, {"n_5m": 300, "n_6h": 21600, "n_24h": 86400})


@query
def failed_calls_last(spark, sf_dir):
    return _windows(spark, sf_dir, X.failed_calls_last, {"n_5m": 300, "n_6h": 21600, "n_24h": 86400})


@query
def unique_services_last(spark, sf_dir):
    return _windows(spark, sf_dir, X.unique_services_last, {"n_1h": 3600, "n_6h": 21600, "n_24h": 86400})


@query
def iam_calls_last(spark, sf_dir):
    return _windows(spark, sf_dir, X.iam_calls_last, {"n_1h": 3600, "n_6h": 21600, "n_24h": 86400})


@query
def api_risk(spark, sf_dir):
    known = risk_table(spark).filter(F.col("event_name") != "GetObject")
    return X.api_risk(activity(spark, sf_dir), known).select("event_id", "event_name", "api_risk_score")


@query
def select_features(spark, sf_dir):
    partial = X.event_flags(X.calendar_features(activity(spark, sf_dir)))
    return X.select_features(partial, K.FEATURES, keep=["event_id"])


@query
def numeric_matrix(spark, sf_dir):
    holed = activity(spark, sf_dir).select(
        "event_id",
        F.when(F.col("seq") % 13 == 0, None)
        .when(F.col("seq") % 11 == 0, float("nan"))
        .otherwise(F.col("value"))
        .alias("amount"),
        F.when(F.col("seq") % 7 != 0, F.col("seq") % 100).cast("string").alias("code"),
    )
    return X.numeric_matrix(holed, ["amount", "code"])


@query
def time_split(spark, sf_dir):
    train, test = X.time_split(activity(spark, sf_dir))
    return train.select("event_id", F.lit("train").alias("part")).unionByName(
        test.select("event_id", F.lit("test").alias("part"))
    )


@query
def feature_vector(spark, sf_dir):
    df = X.numeric_matrix(featured(spark, sf_dir))
    return df.select("event_id", *K.FEATURES)


# --- scoring -----------------------------------------------------------------------


@query
def anomaly_score(spark, sf_dir):
    value = F.round(S.anomaly_score(F.col("decision_value"), THRESHOLD), 6)
    return activity(spark, sf_dir).select("event_id", value.alias("anomaly_score"))


@query
def is_anomalous(spark, sf_dir):
    flag = S.is_anomalous(F.col("decision_value"), THRESHOLD)
    return activity(spark, sf_dir).select("event_id", flag.alias("is_anomalous"))


@query
def rule_score(spark, sf_dir):
    return featured(spark, sf_dir).select("event_id", F.round(S.rule_score(), 6).alias("rule_score"))


@query
def rule_reasons(spark, sf_dir):
    reasons = F.array_join(S.rule_reasons(), " | ").alias("rule_reasons")
    return featured(spark, sf_dir).select("event_id", reasons)


@query
def final_risk(spark, sf_dir):
    blend = S.final_risk(S.anomaly_score(F.col("decision_value"), THRESHOLD), S.rule_score())
    return featured(spark, sf_dir).select("event_id", F.round(blend, 6).alias("final_risk"))


@query
def risk_level(spark, sf_dir):
    return activity(spark, sf_dir).select(
        "event_id", S.risk_level(F.col("value") / 100).alias("risk_level")
    )


@query
def all_reasons(spark, sf_dir):
    flag = S.is_anomalous(F.col("decision_value"), THRESHOLD)
    reasons = F.array_join(S.all_reasons(flag, S.rule_reasons()), " | ").alias("reasons")
    return featured(spark, sf_dir).select("event_id", reasons)


@query
def score(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "event_id", *[n for n in C.SCORE_COLUMNS if n != "reasons"], _joined("reasons")
    )


def fixed_forest() -> ForestModel:
    """Three small trees over four inputs, known to both engines."""
    nodes = pd.DataFrame(
        [
            (0, 0, 0, 0.5, 1, 2, 8), (0, 1, 3, 0.5, 3, 4, 5), (0, 2, -1, None, -1, -1, 3),
            (0, 3, -1, None, -1, -1, 4), (0, 4, -1, None, -1, -1, 1),
            (1, 0, 1, 10.5, 1, 2, 8), (1, 1, -1, None, -1, -1, 2), (1, 2, -1, None, -1, -1, 6),
            (2, 0, 2, 0.5, 1, 2, 8), (2, 1, -1, None, -1, -1, 7), (2, 2, -1, None, -1, -1, 1),
        ],
        columns=["tree_id", "node_id", "feature", "threshold", "left", "right", "n_samples"],
    )
    manifest = {
        "model_name": "fixed", "model_version": "1", "algorithm": "IsolationForest",
        "feature_columns": ["sensitive_operation", "hour_of_day", "failed_call", "external_ip"],
        "sample_size": 8, "offset": 0.5, "anomaly_threshold": 0.05,
    }
    return ForestModel(nodes, manifest)


def _flagged(spark, sf_dir):
    return X.external_ip(X.event_flags(X.calendar_features(activity(spark, sf_dir))))


@query
def forest_decision(spark, sf_dir):
    value = F.round(fixed_forest().decision(spark), 6).alias("decision")
    return _flagged(spark, sf_dir).select("event_id", value)


@query
def score_dataset(spark, sf_dir):
    """A feature table with absent and NaN inputs under the fixed forest."""
    seq = F.col("seq")
    table = featured(spark, sf_dir).withColumns(
        {
            "sensitive_operation": F.when(seq % 7 != 0, F.col("sensitive_operation")),
            "failed_call": F.when(seq % 11 == 0, float("nan")).otherwise(F.col("failed_call")),
            "hour_of_day": F.when(seq % 3 != 0, F.col("hour_of_day")),
            "api_risk_score": F.when(seq % 13 != 0, F.col("api_risk_score")),
        }
    )
    df = C.score_dataset(table, fixed_forest())
    return df.select("event_id", *[c for c in C.SCORE_COLUMNS if c != "reasons"], _joined("reasons"))


@query
def train_and_score(spark, sf_dir):
    """A trained model over its own table: every event scored once, within bounds, levels in line."""
    table = stored(spread(featured(spark, sf_dir)))
    # Read three times below, scored once.
    df = stored(C.score_dataset(table, E.train(table)))
    level = S.risk_level(F.col("final_risk_score"))
    near = F.least(*[F.abs(F.col("final_risk_score") - cut) for cut in (K.MEDIUM_RISK, K.HIGH_RISK)]) < 1e-4
    bad = V.check_predictions(df).select("event_id").unionByName(
        df.filter((level != F.col("risk_level")) & ~near).select("event_id")
    )
    return df.agg(F.countDistinct("event_id").alias("events")).withColumn("bad", bad.agg(F.count("*")).scalar())


def _tree_facts(nodes, sample_size: int):
    """Per tree: rows at the root, and whether counts, shape and depth are those of a grown tree."""
    limit = (sample_size - 1).bit_length()
    facts = []
    for tree, own in nodes.groupby("tree_id"):
        rows = own.set_index("node_id")
        inner = rows[rows["feature"] >= 0]
        left, right = rows.loc[inner["left"]], rows.loc[inner["right"]]
        depth, level = {0: 0}, [0]
        while level:
            level = [c for n in level if rows.at[n, "feature"] >= 0 for c in (rows.at[n, "left"], rows.at[n, "right"]) if not depth.update({c: depth[n] + 1})]
        sums = (left["n_samples"].to_numpy() + right["n_samples"].to_numpy() == inner["n_samples"].to_numpy()).all()
        facts.append(
            (int(tree), int(rows.at[0, "n_samples"]), bool(sums), len(rows) == 2 * len(inner) + 1, max(depth.values()) <= limit, len(depth) == len(rows))
        )
    return facts


def _forest_facts(spark, table, **options):
    """Facts of every tree of a forest, and whether other partitions of the table give the same tree."""
    from watchtrail.operators.forest import fit_forest as fit

    model, other = fit(table, **options), fit(table.repartition(5), **options)
    order = ["tree_id", "node_id"]
    one, two = (m.nodes.sort_values(order).reset_index(drop=True) for m in (model, other))
    same = one.equals(two)
    facts = [(*f, same) for f in _tree_facts(model.nodes, model.manifest["sample_size"])]
    names = "tree_id int, root_rows int, sums_match boolean, is_binary boolean, within_depth boolean, is_whole boolean, is_stable boolean"
    return spark.createDataFrame(facts, names)


@query
def fit_forest(spark, sf_dir):
    table = stored(featured(spark, sf_dir).select("event_id", K.TARGET, *K.FEATURES))
    return _forest_facts(spark, table)


@query
def fit_forest_wide(spark, sf_dir):
    """A second width: 64 inputs, the rows of one label as normal."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = [f"e{i}" for i in range(64)]
    wide = vectors.select(
        F.col("vec_id").alias("event_id"),
        (F.col("label") != 0).cast("int").alias(K.TARGET),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )
    return _forest_facts(spark, wide, features=names, n_estimators=50)


@query
def model_round_trip(spark, sf_dir):
    """Decisions of a model that was saved, loaded and validated, with its threshold."""
    path = _folder(spark, "model")
    save_model(spark, fixed_forest(), path)
    model = load_model(spark, path)
    validate_model(model)
    value = F.round(model.decision(spark), 6).alias("decision")
    return _flagged(spark, sf_dir).select("event_id", value, F.lit(read_threshold(model.manifest)).alias("threshold"))


@query
def write_predictions(spark, sf_dir):
    """Rows per output, read back from the files."""
    path = _folder(spark, "predictions")
    write_prediction_files(scored(spark, sf_dir), path)
    parts = [
        spark.read.csv(f"{path}/predictions", header=True, escape='"').select(F.lit("predictions").alias("output"), "event_id"),
        spark.read.csv(f"{path}/high_risk_incidents", header=True, escape='"').select(F.lit("high"), "event_id"),
        spark.read.json(f"{path}/incidents").select(F.lit("incidents"), "event_id"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("output").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("events"))


@query
def scan_incidents(spark, sf_dir):
    return I.scan_incidents(incidents(spark, sf_dir)).select("incident_id", "risk_level", "status")


@query
def score_raw_events(spark, sf_dir):
    model = fixed_forest().with_manifest(model_version="fixed")
    df = C.score_raw_events(activity(spark, sf_dir), model, risk_table(spark))
    return df.select(
        "event_id", "anomaly_score", "risk_score", "risk_level", _joined("reasons"), "model_version"
    )


@query
def score_envelopes(spark, sf_dir):
    good, bad = C.score_envelopes(messages(spark, sf_dir), fixed_forest())
    columns = ["message_id", "anomaly_score", "rule_score", "final_risk_score", "risk_level"]
    empty = [F.lit(None).cast(t).alias(n) for n, t in zip(
        columns[1:], ["double", "double", "double", "string"], strict=True)]
    return good.select(*columns, F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("message_id", *empty, "error")
    )


# --- validation --------------------------------------------------------------------


@query
def parse_envelopes(spark, sf_dir):
    df = V.parse_envelopes(messages(spark, sf_dir))
    valid = F.col("error").isNull()
    return df.select(
        "message_id",
        "error",
        F.when(valid, F.col("event_id")).alias("event_id"),
        F.when(valid, F.unix_micros("timestamp")).alias("at_us"),
        F.when(valid, F.col("source_ip")).alias("source_ip"),
        F.when(valid, F.col("features")["api_risk_score"]).alias("api_risk_score"),
        F.when(valid, F.size("features")).alias("n_features"),
    )


@query
def validate_context(spark, sf_dir):
    seq = F.col("seq")
    blank = seq % 31 == 0
    spoiled = activity(spark, sf_dir).select(
        F.when(seq % 37 == 0, "").otherwise(F.col("event_id")).alias("event_id"),
        "seq",
        F.when(seq % 41 == 0, "yesterday").otherwise(F.col("timestamp").cast("string")).alias("timestamp"),
        F.when(blank, "").otherwise(F.col("principal_id")).alias("principal_id"),
        F.when(blank, None)
        .when(seq % 43 == 0, "10.0.0.256")
        .when(seq % 47 == 0, "2001:db8::8a2e:370:7334")
        .when(seq % 53 == 0, "2001:db8:::1")
        .otherwise(F.col("source_ip"))
        .alias("source_ip"),
        F.when(blank, None).otherwise(F.col("event_name")).alias("event_name"),
        F.when(blank, "").when(seq % 59 == 0, F.repeat(F.lit("s"), 129)).otherwise(F.col("service")).alias("service"),
        F.when(~blank, F.col("region")).alias("region"),
    )
    return V.validate_context(spoiled).select("seq", _joined("context_errors"))


@query
def validate_features(spark, sf_dir):
    seq = F.col("seq")
    b = (
        F.when(seq % 7 == 0, "NaN").when(seq % 7 == 1, "text").when(seq % 7 == 2, "-1e3")
        .when(seq % 7 == 3, None).otherwise(" 0.5 ")
    )
    texts = F.create_map(F.lit("b"), b, F.lit("a"), F.when(seq % 5 == 0, "inf").otherwise("1"))
    df = activity(spark, sf_dir).select(
        "event_id",
        F.when(seq % 11 == 0, F.create_map().cast("map<string,string>")).otherwise(texts).alias("features"),
    )
    checked = V.validate_features(df)
    good = F.size("feature_errors") == 0
    return checked.select(
        "event_id",
        _joined("feature_errors"),
        F.when(good, F.col("features")["a"] + F.col("features")["b"]).alias("total"),
    )


@query
def validate_security_events(spark, sf_dir):
    return V.validate_security_events(_raw_events(spark, sf_dir)).select("seq", _joined("violations"))


def _raw_events(spark, sf_dir):
    seq = F.col("seq")
    return activity(spark, sf_dir).withColumns(
        {
            "account_id": F.when(seq % 13 == 0, "123").otherwise(F.lpad(seq.cast("string"), 12, "0")),
            "user_agent": F.when(seq % 17 == 0, "").otherwise("cli/2"),
            "region": F.when(seq % 19 == 0, "Mars").otherwise(F.col("region")),
            "label": F.when(seq % 23 == 0, "odd").when(seq % 2 == 0, "normal"),
            "attack_type": F.when(seq % 29 == 0, F.repeat(F.lit("a"), 129)),
            "success": F.when(seq % 31 != 0, F.col("success")),
            "source_ip": F.when(seq % 37 == 0, "1.2.3").otherwise(F.col("source_ip")),
        }
    )


@query
def require_features(spark, sf_dir):
    seq = F.col("seq")
    vector = F.create_map(
        F.lit("hour_of_day"), F.when(seq % 3 == 0, float("nan")).otherwise(1.0),
        F.lit("is_weekend"), F.when(seq % 5 != 0, 0.0),
        F.lit("failed_call"), F.lit(1.0),
    )
    df = activity(spark, sf_dir).select("event_id", vector.alias("features"))
    needed = ["hour_of_day", "is_weekend", "failed_call", "api_risk_score"]
    return V.require_features(df, needed).select("event_id", _joined("missing_features"))


@query
def check_predictions(spark, sf_dir):
    """Scores pushed out of range on purpose; only those come back."""
    df = scored(spark, sf_dir).withColumns(
        {
            "final_risk_score": F.col("final_risk_score") + F.when(F.col("seq") % 10 == 0, 1).otherwise(0),
            "risk_level": F.when(F.col("seq") % 15 == 0, "SEVERE").otherwise(F.col("risk_level")),
        }
    )
    return V.check_predictions(df).select("event_id")


@query
def correlation_dimensions(spark, sf_dir):
    seq = F.col("seq")
    df = activity(spark, sf_dir).withColumns(
        {
            "service": F.when(seq % 3 == 0, "").otherwise(F.col("service")),
            "region": F.when(seq % 4 != 0, F.col("region")),
        }
    )
    return df.select("event_id", _map_text(V.correlation_dimensions()).alias("dimensions"))


@query
def envelope_round_trip(spark, sf_dir):
    built = V.build_envelopes(X.numeric_matrix(featured(spark, sf_dir))).select("body")
    opened = V.parse_envelopes(built)
    return opened.select(
        "event_id", _micros("timestamp", "at_us"), *K.IDENTITY, "error",
        *[F.col("features")[n].alias(n) for n in K.FEATURES],
    )


@query
def quarantine(spark, sf_dir):
    _, rejected = V.split_errors(V.parse_envelopes(messages(spark, sf_dir)))
    return rejected.select("message_id", "error")


@query
def filter_risk(spark, sf_dir):
    return P.filter_risk(scored(spark, sf_dir), "HIGH").select("event_id", "final_risk_score")


@query
def incidents_only(spark, sf_dir):
    return P.incidents_only(scored(spark, sf_dir)).select("event_id", "risk_level")


@query
def recent_rows(spark, sf_dir):
    df = P.recent_rows(scored(spark, sf_dir), level="MEDIUM")
    return df.select(_micros("timestamp", "at_us"), *P.RECENT_COLUMNS[1:])


@query
def incident_detail(spark, sf_dir):
    df = P.incident_detail(scored(spark, sf_dir), INCIDENT)
    return df.select(
        "event_id", _micros("timestamp", "at_us"), "event_name", "service", "principal_id",
        "attack_type", "final_risk_score", "risk_level", _joined("reasons"),
    )


# --- model evaluation --------------------------------------------------------------


@query
def stratified_split(spark, sf_dir):
    fitting, held = E.stratified_split(activity(spark, sf_dir))
    parts = fitting.select(K.TARGET, F.lit("fit").alias("part")).unionByName(
        held.select(K.TARGET, F.lit("held").alias("part"))
    )
    return parts.groupBy(K.TARGET, "part").agg(F.count("*").alias("rows"))


def _rounded(df, **digits):
    return df.select(*[
        F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def _line_scores(spark, sf_dir):
    """A larger labelled score table, with many ties."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        (F.col("l_quantity") + F.floor(F.col("l_discount") * 100) / 10).alias("suspicion"),
        (F.col("l_returnflag") == "R").cast("int").alias(K.TARGET),
    )


@query
def calibrate_threshold(spark, sf_dir):
    return _rounded(E.calibrate_threshold(_suspicious(spark, sf_dir)))


@query
def calibrate_threshold_lineitem(spark, sf_dir):
    return _rounded(E.calibrate_threshold(_line_scores(spark, sf_dir)))


@query
def classification_metrics(spark, sf_dir):
    return _rounded(E.classification_metrics(_suspicious(spark, sf_dir), "suspicion", THRESHOLD))


@query
def classification_metrics_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _rounded(E.classification_metrics(labels, "toxic", 1, "quality"))


@query
def roc_auc(spark, sf_dir):
    return _rounded(E.roc_auc(_suspicious(spark, sf_dir), "suspicion"))


@query
def roc_auc_lineitem(spark, sf_dir):
    return _rounded(E.roc_auc(_line_scores(spark, sf_dir), "suspicion"))


@query
def average_precision(spark, sf_dir):
    return _rounded(E.average_precision(_suspicious(spark, sf_dir), "suspicion"))


@query
def average_precision_lineitem(spark, sf_dir):
    return _rounded(E.average_precision(_line_scores(spark, sf_dir), "suspicion"))


@query
def evaluate_model(spark, sf_dir):
    return _rounded(E.evaluate_model(_suspicious(spark, sf_dir), "suspicion", THRESHOLD))


@query
def evaluation_report(spark, sf_dir):
    report = evaluation_document(E.evaluate_model(_suspicious(spark, sf_dir), "suspicion", THRESHOLD))
    return report.select(
        *[
            F.round(F.get_json_object("value", f"$.metrics.{n}.value").cast("double"), 6).alias(n)
            for n in ("precision", "recall", "f1", "roc_auc", "pr_auc")
        ],
        F.round(F.get_json_object("value", "$.classification_metrics.f1").cast("double"), 6).alias("flat_f1"),
    )


@query
def risk_level_metrics(spark, sf_dir):
    part = scored(spark, sf_dir).withColumn(
        K.TARGET, F.when(F.col("seq") % 5 != 0, F.col(K.TARGET))
    )
    return E.risk_level_metrics(part)


@query
def evaluate_gates(spark, sf_dir):
    metrics = E.classification_metrics(_line_scores(spark, sf_dir), "suspicion", 5.0)
    return _rounded(E.evaluate_gates(metrics))


@query
def contamination_baseline(spark, sf_dir):
    return _rounded(E.contamination_baseline(activity(spark, sf_dir), "decision_value"))


# --- reports -----------------------------------------------------------------------


@query
def batch_summary(spark, sf_dir):
    return P.batch_summary(scored(spark, sf_dir))


@query
def kpis(spark, sf_dir):
    metrics = E.classification_metrics(_suspicious(spark, sf_dir), "suspicion", THRESHOLD)
    return P.kpis(scored(spark, sf_dir), metrics)


@query
def risk_distribution(spark, sf_dir):
    return P.risk_distribution(scored(spark, sf_dir))


@query
def hourly_risk_counts(spark, sf_dir):
    df = P.hourly_risk_counts(scored(spark, sf_dir))
    return df.select(_micros("hour", "hour_us"), "risk_level", "events")


@query
def attack_type_counts(spark, sf_dir):
    attack = F.when(F.col(K.TARGET) == 1, I.attack_category(F.col("event_name")))
    return P.attack_type_counts(activity(spark, sf_dir).withColumn("attack_type", attack))


@query
def service_counts(spark, sf_dir):
    return _rounded(P.service_counts(activity(spark, sf_dir)))


@query
def score_histogram(spark, sf_dir):
    return P.score_histogram(scored(spark, sf_dir))


@query
def score_scatter(spark, sf_dir):
    return P.score_scatter(scored(spark, sf_dir))


@query
def score_grid(spark, sf_dir):
    return P.score_grid(scored(spark, sf_dir), bins=10)


def _processed(spark, sf_dir):
    """Scored activity with failures and processing times read off the row number."""
    delay = F.expr("make_interval(0, 0, 0, 0, 0, 0, (seq % 401) * 1.0)")
    return scored(spark, sf_dir).withColumns(
        {
            "error": F.when(F.col("seq") % 17 == 0, "failed"),
            "processed_at": F.col("timestamp") + delay,
        }
    )


@query
def scoring_metrics(spark, sf_dir):
    df = P.scoring_metrics(_processed(spark, sf_dir), processed="processed_at")
    return df.select(_micros("period_start", "period_us"), *[c for c in df.columns if c != "period_start"])


@query
def alarms(spark, sf_dir):
    processed = _processed(spark, sf_dir)
    metrics = P.scoring_metrics(processed, processed="processed_at")
    rejected = P.quarantine_metrics(processed.filter("error IS NOT NULL"), time="timestamp")
    joined = metrics.join(rejected, "period_start", "left")
    df = P.alarms(joined.withColumn("quarantined", F.coalesce("quarantined", F.lit(0))))
    return df.select(_micros("period_start", "period_us"), "alarm", "reading", "breached")


@query
def latency_stats(spark, sf_dir):
    df = P.latency_stats(activity(spark, sf_dir), "value", "6 hours")
    return _rounded(df.select(_micros("period_start", "period_us"), "samples", "average", "p99"))


@query
def latency_rollup(spark, sf_dir):
    """Five-minute sketches merged into six hours, checked against the exact events."""
    events = activity(spark, sf_dir)
    merged = P.merged_latency(P.latency_sketches(events, "value", "5 minutes"), "6 hours")
    checked = merged.join(P.rank_within_bound(events, merged, "value", "6 hours"), "period_start")
    return _rounded(checked.select(_micros("period_start", "period_us"), "samples", "average", "within_bound"))


# --- incidents ---------------------------------------------------------------------


@query
def build_incidents(spark, sf_dir):
    df = incidents(spark, sf_dir)
    return df.select(
        "incident_id", _micros("event_time", "at_us"), "risk_level",
        *[F.col(n).cast("double").alias(n) for n in ("final_risk_score", "anomaly_score", "rule_score")],
        "model_flagged_anomaly", "model_version", "status", *K.IDENTITY, _joined("reasons"),
        F.col("features")["calls_last_5m"].alias("calls_last_5m"),
        F.col("features")["api_risk_score"].alias("api_risk_score"),
    )


@query
def normalize_incidents(spark, sf_dir):
    """The same incidents stored in four shapes, all read through one view."""
    seq = F.substring(F.col("incident_id"), 5, 20).cast("long")
    base = incidents(spark, sf_dir).withColumn("shape", seq % 4)
    plain, packed, foreign = F.col("shape") == 0, F.col("shape") == 1, F.col("shape") >= 2
    payload = F.to_json(
        F.struct(
            F.when(packed, F.col("principal_id")).alias("principal_id"),
            F.when(packed, F.col("source_ip")).alias("source_ip"),
            F.when(packed, F.col("event_name")).alias("event_name"),
            F.when(foreign, F.struct(F.col("principal_id").alias("userName"))).alias("userIdentity"),
            F.col("features")["api_risk_score"].alias("api_risk_score"),
        )
    )
    shaped = base.select(
        F.when(~foreign, F.col("incident_id")).alias("incident_id"),
        F.when(foreign, F.col("incident_id")).alias("incidentId"),
        "timestamp",
        F.when(plain, F.col("principal_id")).alias("principal_id"),
        F.when(plain, F.col("source_ip")).alias("source_ip"),
        F.when(foreign, F.col("source_ip")).alias("sourceIPAddress"),
        F.when(plain, F.col("event_name")).alias("event_name"),
        F.when(foreign, F.col("event_name")).alias("eventName"),
        F.when(~foreign, F.col("service")).alias("service"),
        F.when(foreign, F.concat("service", F.lit(".amazonaws.com"))).alias("eventSource"),
        F.when(~foreign, F.col("region")).otherwise("").alias("region"),
        F.when(foreign, F.col("region")).alias("awsRegion"),
        "risk_level",
        "final_risk_score",
        F.when(plain, F.col("features")).alias("features"),
        F.when(F.col("shape") == 3, F.concat(payload, F.lit("}}")))
        .when(~plain, payload)
        .alias("original_payload"),
    )
    view = I.normalize_incidents(shaped)
    return view.select(
        "incident_id", "principal_id", "source_ip", "event_name", "service", "region",
        "attack_category", "risk_level", F.round("final_risk_score", 4).alias("final_risk_score"),
        F.round(F.col("features")["api_risk_score"], 6).alias("api_risk_score"),
    )


@query
def as_number(spark, sf_dir):
    seq = F.col("seq")
    text = (
        F.when(seq % 5 == 0, "n/a").when(seq % 5 == 1, None).when(seq % 5 == 2, "9.99")
        .when(seq % 5 == 3, "-0.25").otherwise(F.col("value").cast("string"))
    )
    df = activity(spark, sf_dir).withColumn("text", text)
    return df.select(
        "event_id",
        lenient_number(F.col("text")).alias("number"),
        unit_score(F.col("text")).alias("clamped"),
        F.coalesce(is_finite(F.col("text").try_cast("double")), F.lit(False)).alias("usable"),
    )


@query
def attack_category(spark, sf_dir):
    df = activity(spark, sf_dir)
    return df.select("event_id", I.attack_category(F.col("event_name")).alias("attack_category"))


def _odd_incidents(spark, sf_dir):
    """Incidents whose stored category, call or service is rewritten to reach every rule."""
    seq = F.substring(F.col("incident_id"), 5, 20).cast("long")
    return I.normalize_incidents(incidents(spark, sf_dir)).withColumns(
        {
            "attack_category": F.when(seq % 5 == 0, " Defense_Evasion ")
            .when(seq % 5 == 1, "unheard-of")
            .when(seq % 5 == 2, F.col("attack_category")),
            "event_name": F.when(seq % 7 == 0, "DescribeThings")
            .when(seq % 7 == 1, "FooBar")
            .when(seq % 7 == 2, "Query")
            .otherwise(F.col("event_name")),
            "service": F.when(seq % 3 == 0, "CloudTrail").otherwise(F.col("service")),
            "final_risk_score": F.when(seq % 13 == 0, float("nan"))
            .when(seq % 13 == 1, float("inf"))
            .when(seq % 13 == 2, float("-inf"))
            .otherwise(F.col("final_risk_score")),
        }
    )


def _odd_numbers(view):
    """Normalised incidents with stored numbers that are not finite, some with their rule recorded."""
    seq = F.substring(F.col("incident_id"), 5, 20).cast("long")
    odd = F.map_from_arrays(
        F.array(F.lit("failed_calls_last_5m"), F.lit("hour_of_day")),
        F.array(
            F.when(seq % 11 == 0, float("nan")).when(seq % 11 == 1, float("inf")).otherwise(F.col("features")["failed_calls_last_5m"]),
            F.when(seq % 11 == 2, float("nan")).when(seq % 11 == 3, float("-inf")).otherwise(F.col("features")["hour_of_day"]),
        ),
    )
    rest = F.map_filter("features", lambda k, _: ~k.isin("failed_calls_last_5m", "hour_of_day"))
    return view.withColumns(
        {
            "features": F.map_concat(rest, odd),
            "anomaly_score": F.when(seq % 11 == 4, float("nan")).when(seq % 11 == 5, float("inf")).otherwise(F.col("anomaly_score")),
            "score_metadata": F.when(
                seq % 22 == 4, F.create_map(F.lit("rules"), F.lit('["anomaly"]'))
            ).when(seq % 22 == 11, F.create_map(F.lit("rules"), F.lit('["error_rate_risk"]'))).otherwise(F.col("score_metadata")),
        }
    )


@query
def explain_odd_numbers(spark, sf_dir):
    view = I.explain(_odd_numbers(I.normalize_incidents(incidents(spark, sf_dir))))
    return view.select("incident_id", _joined("explanation"))


@query
def classify(spark, sf_dir):
    return _odd_incidents(spark, sf_dir).select("incident_id", I.classify().alias("category"))


@query
def correlate(spark, sf_dir):
    """Each incident beside the next one in sequence."""
    view = I.normalize_incidents(stored(incidents(spark, sf_dir))).withColumn(
        "seq", F.substring(F.col("incident_id"), 5, 20).cast("long")
    )
    names = [F.col(n) for n in R.DIMENSIONS]
    left = view.select("seq", *[c.alias(f"left_{n}") for n, c in zip(R.DIMENSIONS, names, strict=True)])
    right = view.select(
        (F.col("seq") - 1).alias("seq"),
        *[c.alias(f"right_{n}") for n, c in zip(R.DIMENSIONS, names, strict=True)],
    )
    return R.correlate(left.join(right, "seq")).select("seq", "correlation_score", _joined("match_reasons"))


@query
def get_incident(spark, sf_dir):
    df = I.get_incident(incidents(spark, sf_dir), INCIDENT)
    return df.select("incident_id", "risk_level", "status", "principal_id")


@query
def find_related(spark, sf_dir):
    df = R.find_related(incidents(spark, sf_dir), INCIDENT)
    return df.select(
        "candidate_id", _micros("candidate_time", "at_us"), "correlation_score", _joined("match_reasons"),
        "principal_id", "source_ip", "event_name", "risk_level", F.round("final_risk_score", 6).alias("final_risk_score"),
    )


@query
def find_related_all(spark, sf_dir):
    df = R.find_related_all(as_table(incidents(spark, sf_dir)))
    return df.withColumn("match_reasons", F.array_join("match_reasons", " | "))


@query
def explain(spark, sf_dir):
    view = I.explain(I.normalize_incidents(incidents(spark, sf_dir)))
    return view.select("incident_id", _joined("explanation"))


@query
def recommend_actions(spark, sf_dir):
    return I.recommend_actions(_odd_incidents(spark, sf_dir)).select(
        "incident_id", _joined("recommended_actions")
    )


@query
def investigate(spark, sf_dir):
    df = R.investigate(stored(incidents(spark, sf_dir)), INCIDENT)
    return _flat_report(df)


def _flat_report(df):
    ids = F.transform("related_incidents", lambda r: r["incident_id"])
    return df.select(
        "incident_id", "severity", F.round("risk_score", 4).alias("risk_score"), "summary",
        _joined("suspicious_reasons"), _joined("recommended_actions"),
        F.array_join(ids, ",").alias("related_ids"),
    )


@query
def investigate_all(spark, sf_dir):
    return _flat_report(R.investigate_all(as_table(incidents(spark, sf_dir))))


@query
def incident_reports(spark, sf_dir):
    """The report of every incident without its relations."""
    df = I.report_columns(I.normalize_incidents(incidents(spark, sf_dir)))
    return df.select(
        "incident_id", "severity", F.round("risk_score", 4).alias("risk_score"), "summary",
        _joined("suspicious_reasons"), _joined("recommended_actions"),
    )


@query
def alert_payload(spark, sf_dir):
    df = incidents(spark, sf_dir).withColumn(
        "region", F.when(F.col("service") != "iam", F.col("region"))
    )
    field = lambda n: F.get_json_object("message", f"$.{n}").alias(n)
    return I.alert_payload(df).select(
        "incident_id", "subject", *[field(n) for n in ("risk_level", "model_prediction", *K.IDENTITY, "event_time")],
        F.get_json_object("message", "$.final_risk_score").cast("double").alias("final_risk_score"),
    )


def _deliveries(spark, sf_dir):
    """All incidents, with every tenth delivered again later."""
    table = stored(incidents(spark, sf_dir))
    seq = F.substring(F.col("incident_id"), 5, 20).cast("long")
    again = table.filter(seq % 10 == 0).withColumn(
        "timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR")
    )
    known = table.filter(seq % 4 == 0)
    return table.unionByName(again), known


@query
def insert_incidents(spark, sf_dir):
    incoming, known = _deliveries(spark, sf_dir)
    return I.new_incidents(incoming, known).select("incident_id", _micros("timestamp", "at_us"))


@query
def alert_on_repeat(spark, sf_dir):
    incoming, known = _deliveries(spark, sf_dir)
    return I.alert_on_new(incoming, known).select("incident_id", "subject")


# --- sources -----------------------------------------------------------------------


@query
def latest_approved_model(spark, sf_dir):
    """Newest approved entry per group of a registry read off the events."""
    k = F.get_json_object("props", "$.k").cast("int")
    registry = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("model_group"),
        F.col("event_id").alias("version"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(k % 3 == 0, "Approved").otherwise("Pending").alias("status"),
    )
    return latest_model(registry, status="Approved").select("model_group", "version", "status")


def _folder(spark, name):
    import uuid

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def read_feature_table(spark, sf_dir):
    """The feature table written as CSV and read back under its declared schema."""
    path = _folder(spark, "features")
    featured(spark, sf_dir).select("event_id", *K.FEATURES, K.TARGET).write.csv(path, header=True)
    return read_features(spark, path)


@query
def read_event_lines(spark, sf_dir):
    """Raw events written as JSON lines and read back, violations included."""
    path = _folder(spark, "events")
    names = [n for n in V.SECURITY_EVENT_KEYS]
    raw = _raw_events(spark, sf_dir).select(*names)
    raw.write.json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    read = V.validate_security_events(read_events(spark, path))
    return read.select("event_id", _micros("timestamp", "at_us"), _joined("violations"))
