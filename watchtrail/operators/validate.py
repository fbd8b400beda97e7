"""Contract checks. A failing row keeps its reason and never stops the rest of a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtrail.functions import constants as K
from watchtrail.functions.network import is_ip_address
from watchtrail.functions.values import (
    all_of,
    compact_texts,
    is_finite,
    is_single_json,
    json_fields,
    once,
    text_array,
    text_or_null,
    text_to_number,
)

# --- fixed values: texts and names of the message contract ---
NOT_JSON = "Message body is not valid JSON"
NOT_OBJECT = "Message body must be a JSON object"
NOT_ENVELOPE = "Message is not a scoring message: send identity under 'event'"
INVALID = "Invalid scoring message: "
ENVELOPE_KEYS = ("schema_version", "event", "features")
EVENT_KEYS = ("event_id", "timestamp", *K.IDENTITY)
SECURITY_EVENT_KEYS = (
    "event_id", "timestamp", "account_id", "principal_id", "event_name", "service", "region",
    "source_ip", "user_agent", "success", "sensitive_operation", "label", "attack_type",
)
# ISO text only; a bare number is not a time.
TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}"


def _violation(broken: Column, text: Column | str) -> Column:
    return F.when(broken, text if isinstance(text, Column) else F.lit(text))


def _time(value: Column) -> Column:
    return F.when(value.rlike(TIME_PATTERN), value.try_cast("timestamp"))


def _kind(value: Column) -> Column:
    """Type name of a JSON value; NULL when the key is absent."""
    return F.schema_of_variant(value)


def _listed(names: Column) -> Column:
    return F.array_join(F.array_sort(names), ", ")


# --- event context -----------------------------------------------------------------


def context_errors(read=F.col) -> Column:
    """Violations of the identity half of a message, in field order.

    ``read`` returns the text of a field; ``timestamp`` may be text or a timestamp.
    """
    checks = []
    for name, longest in K.EVENT_LENGTHS.items():
        value = read(name)
        if name == "event_id":
            checks.append(
                _violation(
                    value.isNull() | ~F.length(value).between(1, longest),
                    f"event_id must have 1 to {longest} characters",
                )
            )
            checks.append(
                _violation(
                    read("timestamp").cast("string").try_cast("timestamp").isNull(),
                    "timestamp must be an ISO date-time",
                )
            )
        else:
            checks.append(
                _violation(F.length(value) > longest, f"{name} must have at most {longest} characters")
            )
    address = read("source_ip")
    checks.append(_violation(~is_ip_address(address), "source_ip must be a valid IP address"))
    populated = F.coalesce(*[text_or_null(read(name)) for name in K.IDENTITY])
    checks.append(
        _violation(populated.isNull(), "event must carry at least one of " + ", ".join(K.IDENTITY))
    )
    return compact_texts(*checks)


def validate_context(df: DataFrame) -> DataFrame:
    """Add ``context_errors``; empty when the identity columns are acceptable."""
    return df.withColumn("context_errors", context_errors())


def correlation_dimensions(read=F.col) -> Column:
    """Map of the populated identity fields only."""
    pairs = [part for name in K.IDENTITY for part in (F.lit(name), read(name))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))


# --- feature map -------------------------------------------------------------------


def numeric_features(texts: Column) -> Column:
    """Map of text to map of double; unusable values become NULL."""
    return F.transform_values(texts, lambda _, v: text_to_number(v))


def feature_errors(numbers: Column) -> Column:
    """Violations of a numeric feature map whose unusable values are NULL."""
    offending = F.map_keys(F.map_filter(numbers, lambda _, v: ~is_finite(v)))
    names = F.map_keys(numbers)
    return compact_texts(
        _violation(numbers.isNull() | (F.size(numbers) == 0), "features must not be empty"),
        _violation(F.size(F.array_distinct(names)) < F.size(names), "features has a repeated name"),
        _violation(
            F.size(offending) > 0,
            F.concat(F.lit("features must be finite numbers: "), _listed(offending)),
        ),
    )


def validate_features(df: DataFrame, features: str = "features") -> DataFrame:
    """Turn a text map into numbers and add ``feature_errors``."""
    numbers = numeric_features(F.col(features))
    return once(df, {features: numbers}).withColumn(
        "feature_errors", feature_errors(F.col(features))
    )


def require_features(
    df: DataFrame, names: Sequence[str] = K.FEATURES, features: str = "features"
) -> DataFrame:
    """Add ``missing_features``: trained inputs that are absent or not finite, in order."""
    usable = F.map_keys(F.map_filter(F.col(features), lambda _, v: is_finite(v)))
    return df.withColumn("missing_features", F.array_except(text_array(names), usable))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail when a wide table lacks a needed column."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"The dataset is missing required columns: {missing}")
    return df


# --- whole messages ----------------------------------------------------------------


def parse_envelopes(df: DataFrame, body: str = "body") -> DataFrame:
    """Open scoring messages into columns; ``error`` is the first thing wrong, else NULL.

    A message that repeats a name is refused, whichever of its objects repeats it.
    """
    text = F.col(body)
    strict = once(df, {"_strict": is_single_json(text)})
    opened = once(
        once(strict, {"_top": json_fields(text, F.col("_strict"))}),
        {
            "_event": F.try_variant_get(F.col("_top")["event"], "$", "map<string,variant>"),
            "_features": F.try_variant_get(F.col("_top")["features"], "$", "map<string,variant>"),
        },
    )

    def event_text(name: str) -> Column:
        return F.try_variant_get(F.col("_event")[name], "$", "string")

    plain = ("BIGINT", "DOUBLE", "FLOAT", "STRING")
    readable = lambda v: _kind(v).isin(*plain) | _kind(v).startswith("DECIMAL")
    as_text = F.transform_values(
        "_features", lambda _, v: F.when(readable(v), F.try_variant_get(v, "$", "string"))
    )
    extras = F.map_filter("_event", lambda k, _: ~k.isin(*EVENT_KEYS))
    parsed = once(
        opened,
        {
            "schema_version": F.coalesce(
                F.try_variant_get(F.col("_top")["schema_version"], "$", "string"),
                F.lit(K.SCHEMA_VERSION),
            ),
            **{name: event_text(name) for name in ("event_id", *K.IDENTITY)},
            "timestamp": _time(event_text("timestamp")),
            "features": numeric_features(as_text),
            "event_context": F.transform_values(
                extras,
                lambda _, v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(
                    F.to_json(v)
                ),
            ),
        },
    )
    unexpected = F.array_except(F.map_keys("_top"), text_array(ENVELOPE_KEYS))
    wrong_text = F.filter(
        text_array(EVENT_KEYS),
        lambda name: ~F.coalesce(_kind(F.element_at(F.col("_event"), name)), F.lit("VOID")).isin("STRING", "VOID"),
    )
    version = _kind(F.col("_top")["schema_version"])
    problems = F.concat(
        compact_texts(
            _violation(
                F.size(unexpected) > 0, F.concat(F.lit("unexpected field: "), _listed(unexpected))
            ),
            _violation(version != "STRING", "schema_version must be text"),
            _violation(F.col("_event").isNull(), "event must be an object"),
            _violation(F.col("_features").isNull(), "features must be an object"),
            _violation(
                F.size(wrong_text) > 0, F.concat(F.lit("must be text: "), _listed(wrong_text))
            ),
        ),
        F.when(F.col("_event").isNull(), F.array().cast("array<string>")).otherwise(context_errors()),
        F.when(F.col("_features").isNull(), F.array().cast("array<string>")).otherwise(
            feature_errors(F.col("features"))
        ),
    )
    bare = ~F.array_contains(F.map_keys("_top"), "event") & ~F.array_contains(
        F.map_keys("_top"), "features"
    )
    error = (
        F.when(text.isNull() | ~F.col("_strict"), NOT_JSON)
        .when(F.col("_top").isNull() & text.rlike(r"^\s*\{"), INVALID + "repeated field")
        .when(F.col("_top").isNull(), NOT_OBJECT)
        .when(bare, NOT_ENVELOPE)
        .when(F.size("_problems") > 0, F.concat(F.lit(INVALID), F.array_join("_problems", "; ")))
    )
    judged = once(once(parsed, {"_problems": problems}), {"error": error})
    return judged.drop("_strict", "_top", "_event", "_features", "_problems")


def build_envelopes(df: DataFrame, features: Sequence[str] = K.FEATURES) -> DataFrame:
    """Add ``body``: a scoring message for each row of events with features."""
    values = [
        part for name in features for part in (F.lit(name), F.col(name).cast("double"))
    ]
    message = F.struct(
        F.lit(K.SCHEMA_VERSION).alias("schema_version"),
        F.struct(*[F.col(name) for name in EVENT_KEYS]).alias("event"),
        F.create_map(*values).alias("features"),
    )
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return df.withColumn("body", F.to_json(message, options))


# --- raw events --------------------------------------------------------------------


def security_event_errors() -> Column:
    checks = []
    for name, longest in K.RAW_LENGTHS.items():
        value = F.col(name)
        checks.append(
            _violation(
                value.isNull() | ~F.length(value).between(1, longest),
                f"{name} must have 1 to {longest} characters",
            )
        )
    checks += [
        _violation(F.col("timestamp").isNull(), "timestamp must be an ISO date-time"),
        _violation(
            ~F.coalesce(F.col("account_id").rlike(K.ACCOUNT_PATTERN), F.lit(False)),
            "account_id must be 12 digits",
        ),
        _violation(
            ~F.coalesce(F.col("region").rlike(K.REGION_PATTERN), F.lit(False)),
            "region must be a region name",
        ),
        _violation(
            ~F.coalesce(is_ip_address(F.col("source_ip")), F.lit(False)),
            "source_ip must be a valid IP address",
        ),
        _violation(F.col("success").isNull(), "success must be true or false"),
        _violation(
            F.col("sensitive_operation").isNull(), "sensitive_operation must be true or false"
        ),
        _violation(~F.col("label").isin("normal", "suspicious"), "label must be normal or suspicious"),
        _violation(
            F.length("attack_type") > 128, "attack_type must have at most 128 characters"
        ),
    ]
    return compact_texts(*checks)


def validate_security_events(df: DataFrame) -> DataFrame:
    """Add ``violations``; empty when a raw event is acceptable."""
    missing = [name for name in SECURITY_EVENT_KEYS if name not in df.columns]
    filled = df.withColumns({name: F.lit(None).cast("string") for name in missing})
    return filled.withColumn("violations", security_event_errors())


def parse_security_events(df: DataFrame, body: str = "body") -> DataFrame:
    """Open raw event JSON under the closed schema; unknown keys are violations."""
    top = F.col("_top")
    opened = once(df, {"_top": json_fields(F.col(body))})

    def read(name: str) -> Column:
        return F.try_variant_get(top[name], "$", "string")

    columns = {name: read(name) for name in SECURITY_EVENT_KEYS}
    columns["timestamp"] = _time(read("timestamp"))
    for flag in ("success", "sensitive_operation"):
        columns[flag] = F.try_variant_get(top[flag], "$", "boolean")
    unknown = F.array_except(F.map_keys(top), text_array(SECURITY_EVENT_KEYS))
    shape = compact_texts(
        _violation(top.isNull(), NOT_OBJECT),
        _violation(F.size(unknown) > 0, F.concat(F.lit("unexpected field: "), _listed(unknown))),
    )
    read_once = once(opened, columns)
    return once(read_once, {"violations": F.concat(shape, security_event_errors())}).drop("_top")


# --- predictions -------------------------------------------------------------------


def check_predictions(df: DataFrame) -> DataFrame:
    """Rows whose scores leave [0, 1] or whose level is unknown."""
    scores = ("anomaly_score", "rule_score", "final_risk_score")
    sound = all_of(
        [F.col(name).between(0.0, 1.0) for name in scores]
        + [F.col("risk_level").isin("LOW", "MEDIUM", "HIGH")]
    )
    return df.filter(~F.coalesce(sound, F.lit(False)))


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows by whether a reason was recorded."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())
