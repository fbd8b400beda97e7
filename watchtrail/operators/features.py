"""Model inputs derived from raw audit events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtrail.functions import constants as K
from watchtrail.functions.network import address_number, cidr_ranges, in_ranges, is_internal_ip
from watchtrail.operators.ranking import percentile_by_group

MICROS = 1_000_000
BUCKET_SECONDS = 60


def calendar_features(df: DataFrame) -> DataFrame:
    hour = F.hour("timestamp")
    return df.withColumns(
        {
            "hour_of_day": hour,
            "is_weekend": (F.weekday("timestamp") >= 5).cast("int"),
            "unusual_hour": ((hour < 6) | (hour > 19)).cast("int"),
        }
    )


def event_flags(df: DataFrame, home_region: str = K.HOME_REGION) -> DataFrame:
    return df.withColumns(
        {
            "failed_call": (~F.col("success")).cast("int"),
            "sensitive_operation": F.col("sensitive_operation").cast("int"),
            "outside_home_region": (~F.col("region").eqNullSafe(F.lit(home_region))).cast("int"),
        }
    )


def external_ip(df: DataFrame, prefixes: tuple[str, ...] = K.INTERNAL_PREFIXES, cidrs: Sequence[str] | None = None) -> DataFrame:
    """1 unless the source address is internal. With ``cidrs`` (IPv4 and IPv6 blocks), internal
    means inside one of them, and text that is no address counts as external; otherwise the
    fixed prefixes decide."""
    if cidrs is not None:
        name = "_address"
        while name in df.columns:
            name += "_"
        placed = df.withColumn(name, address_number(F.col("source_ip")))
        inside = in_ranges(F.col(name), cidr_ranges(cidrs))
        return placed.withColumn("external_ip", F.when(inside, 0).otherwise(1)).drop(name)
    return df.withColumn("external_ip", (~is_internal_ip(F.col("source_ip"), prefixes)).cast("int"))


@dataclass(frozen=True)
class RollingCounter:
    """One per-principal counter over the last ``seconds``, current event included.

    ``adds`` is a number each event contributes; ``distinct`` counts different values of
    a column instead. Give exactly one of them.
    """

    name: str
    seconds: int
    adds: Column | None = None
    distinct: str | None = None


def calls_last(seconds: int = 300, name: str = "calls_last_5m") -> RollingCounter:
    return RollingCounter(name, seconds, adds=F.lit(1))


def failed_calls_last(seconds: int = 300, name: str = "failed_calls_last_5m") -> RollingCounter:
    return RollingCounter(name, seconds, adds=F.when(F.col("success"), 0).otherwise(1))


def unique_services_last(
    seconds: int = 3600, name: str = "unique_services_last_1h"
) -> RollingCounter:
    return RollingCounter(name, seconds, distinct="service")


def iam_calls_last(seconds: int = 3600, name: str = "iam_calls_last_1h") -> RollingCounter:
    return RollingCounter(name, seconds, adds=F.when(F.col("service") == "iam", 1).otherwise(0))


def default_counters() -> list[RollingCounter]:
    return [calls_last(), failed_calls_last(), unique_services_last(), iam_calls_last()]


def rolling_counters(
    df: DataFrame,
    counters: Sequence[RollingCounter] | None = None,
    key: str = "principal_id",
    time: str = "timestamp",
) -> DataFrame:
    """Add rolling counters; frames are closed at both ends and include tied events.

    A sliding frame re-reads its window for every row, which is quadratic for a busy
    principal. Instead every event adds to a balance when it happens and takes the same
    amount off once it has left the frame; the counter is the running balance. Events are
    first summed per key and instant, and balances run over (key, minute) buckets, so a
    key that holds a third of the data is still spread over the cluster. Events without a
    key are counted together, as one principal.

    The events are read once for all counters. Balances are dealt out by key and minute
    once; the minutes' totals and the balances within a minute read the same shuffle.
    """
    counters = list(counters or default_counters())
    names = [c.name for c in counters]
    changes = _changes(df, counters, key, time)
    minute = F.coalesce(F.floor(F.col("_at") / (BUCKET_SECONDS * MICROS)), F.lit(0))
    dealt = changes.withColumn("_minute", minute).repartition("_key", "_keyless", "_minute")

    place = ["_key", "_keyless", "_minute"]
    totals = dealt.groupBy(*place).agg(
        *[F.sum(n).alias(f"total_{n}") for n in names],
        # Both also keep the columns of the shared shuffle the same on either side.
        F.max("_is_event").alias("_has_event"),
        F.max("_at").alias("_until"),
    )
    # One row per key and minute, however many events.
    before = Window.partitionBy("_key", "_keyless").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(
        *place, "_has_event", "_until", *[F.coalesce(F.sum(f"total_{n}").over(before), F.lit(0)).alias(f"opening_{n}") for n in names]
    ).filter("_has_event")
    inside = Window.partitionBy(*place).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = dealt.withColumns({n: F.sum(n).over(inside) for n in names})
    balances = (
        running.filter("_is_event")
        .join(opening, place)
        .filter(F.col("_at") <= F.col("_until"))
        .select("_key", "_keyless", "_at", *[(F.col(n) + F.col(f"opening_{n}")).alias(n) for n in names])
    )
    own = {"_own_key": _text_key(key), "_own_keyless": F.col(key).isNull(), "_own_at": F.unix_micros(time)}
    same = [F.col(f"_own{n}") == F.col(n) for n in ("_key", "_keyless", "_at")]
    return df.withColumns(own).join(balances, same, "left").drop(*own, "_key", "_keyless", "_at")


def _text_key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def _changes(df: DataFrame, counters: list[RollingCounter], key: str, time: str) -> DataFrame:
    """(_key, _keyless, _at, _is_event, one amount per counter): what each balance gains or loses, and when.

    A summed counter gains at the instant of its events and loses as much once they have
    left the frame. A counter of distinct values gains 1 when a value enters the frame and
    loses 1 once its last event has left it; buckets no wider than the frame cannot contain
    a gap, so only the first and last instant of each (key, value, bucket) matter.
    """
    summed = [c for c in counters if c.distinct is None]
    columns = sorted({c.distinct for c in counters if c.distinct is not None})
    at = F.unix_micros(time)

    def row(place: int, value: Column, slot: Column) -> Column:
        amounts = [(c.adds if place == 0 else F.lit(0)).cast("long").alias(f"_a_{c.name}") for c in summed]
        return F.struct(F.lit(place).alias("_place"), value.cast("string").alias("_value"), slot.cast("long").alias("_slot"), *amounts)

    rows = [row(0, F.lit(None), at)]
    for place, column in enumerate(columns, 1):
        width = min(BUCKET_SECONDS, *[c.seconds for c in counters if c.distinct == column]) * MICROS
        rows.append(row(place, F.col(column), F.floor(at / width)))
    # An event without a time has no frame and takes no part in anyone else's.
    narrow = df.filter(F.col(time).isNotNull()).select(
        _text_key(key).alias("_key"), F.col(key).isNull().alias("_keyless"), at.alias("_at"), F.inline(F.array(*rows))
    )
    groups = narrow.filter("_place = 0 OR _value IS NOT NULL").groupBy("_key", "_keyless", "_place", "_value", "_slot")
    edges = groups.agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), *[F.sum(f"_a_{c.name}").alias(f"_a_{c.name}") for c in summed]
    )
    # Instants stand alone; the buckets of one value follow each other, one row per bucket.
    alone = F.when(F.col("_place") == 0, F.col("_slot"))
    along = Window.partitionBy("_key", "_keyless", "_place", "_value", alone).orderBy("_slot")
    edges = edges.withColumns({"_before": F.lag("_last").over(along), "_after": F.lead("_first").over(along)})

    def change(when: Column, is_event: bool, amount) -> Column:
        amounts = [amount(c).cast("long").alias(c.name) for c in counters]
        return F.struct(when.alias("_at"), F.lit(is_event).alias("_is_event"), *amounts)

    def step(by: int, gap: Column, chosen: RollingCounter):
        apart = ~F.coalesce(gap <= chosen.seconds * MICROS, F.lit(False))
        return lambda c: F.when(apart, by).otherwise(0) if c is chosen else F.lit(0)

    found = F.array(change(F.col("_first"), True, lambda c: F.col(f"_a_{c.name}") if c in summed else F.lit(0)))
    leaving = []
    for seconds in sorted({c.seconds for c in summed}):
        gone = F.col("_first") + F.lit(seconds * MICROS + 1)
        leaving.append(
            change(gone, False, lambda c, s=seconds: -F.col(f"_a_{c.name}") if c in summed and c.seconds == s else F.lit(0))
        )
    found = F.concat(found, F.array(*leaving)) if leaving else found
    for place, column in enumerate(columns, 1):
        own = []
        for c in counters:
            if c.distinct == column:
                own.append(change(F.col("_first"), False, step(1, F.col("_first") - F.col("_before"), c)))
                gone = F.col("_last") + F.lit(c.seconds * MICROS + 1)
                own.append(change(gone, False, step(-1, F.col("_after") - F.col("_last"), c)))
        found = F.when(F.col("_place") == place, F.array(*own)).otherwise(found)
    opened = edges.select("_key", "_keyless", F.inline(found))
    nothing = " AND ".join(f"{c.name} = 0" for c in counters)
    return opened.filter(f"_is_event OR NOT ({nothing})")


def api_risk(df: DataFrame, risk_table: DataFrame, default: float = K.DEFAULT_API_RISK) -> DataFrame:
    """Look up the risk of each API action; ``risk_table`` is (event_name, api_risk_score).

    The optimizer broadcasts the table by its size in bytes, or else shuffles both sides.
    """
    table = risk_table.select("event_name", "api_risk_score")
    return df.join(table, "event_name", "left").withColumn(
        "api_risk_score", F.coalesce("api_risk_score", F.lit(default))
    )


def select_features(
    df: DataFrame, names: Sequence[str] = K.FEATURES, keep: Sequence[str] = ()
) -> DataFrame:
    """The named columns in trained order; an absent column is 0."""
    present = set(df.columns)
    return df.select(
        *keep, *[F.col(n) if n in present else F.lit(0).alias(n) for n in names]
    )


def numeric_matrix(df: DataFrame, names: Sequence[str] = K.FEATURES) -> DataFrame:
    """Cast the named columns to double with missing values as 0; bad text is an error."""
    return df.withColumns(
        {
            n: F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0))
            for n in names
        }
    )


def time_split(
    df: DataFrame, share: float = 0.8, time: str = "timestamp"
) -> tuple[DataFrame, DataFrame]:
    """Earlier rows train, later rows test; tied times stay together."""
    cutoff = time_cutoff(df, share, time).first()["cutoff_us"]
    at = F.unix_micros(time)
    return df.filter(at <= F.lit(cutoff)), df.filter(at > F.lit(cutoff))


def time_cutoff(df: DataFrame, share: float = 0.8, time: str = "timestamp") -> DataFrame:
    """One row: the exact percentile of event time, in microseconds."""
    micros = df.select(F.unix_micros(time).alias("_us"))
    return percentile_by_group(micros, "_us", share, out="cutoff_us")


def build_features(
    df: DataFrame,
    risk_table: DataFrame,
    home_region: str = K.HOME_REGION,
    counters: Sequence[RollingCounter] | None = None,
) -> DataFrame:
    """All twelve model inputs beside the event's own columns."""
    counted = rolling_counters(df, counters)
    flagged = external_ip(event_flags(calendar_features(counted), home_region))
    return api_risk(flagged, risk_table)
