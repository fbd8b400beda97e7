"""Correlating incidents, one against all or all against all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtrail.functions import constants as K
from watchtrail.functions.values import compact_texts, once, text_or_null
from watchtrail.operators.incidents import VIEW_COLUMNS, get_incident, normalize_incidents, report_columns
from watchtrail.operators.ranking import top_per_key
from watchtrail.session import as_table

DIMENSIONS = tuple(K.CORRELATION_WEIGHTS)
#: Places of the dimensions with many values, and of the others.
STRONG = [DIMENSIONS.index(n) for n in ("principal_id", "source_ip")]
WEAK = [i for i in range(len(DIMENSIONS)) if i not in STRONG]
#: Incidents of a principal that are compared side by side, and members of a group ranked in one row.
OWN_ROWS, GROUP_ROWS = 256, 1024
#: Lists of up to so many bytes in memory go to every executor; about what an entry takes there.
BROADCAST_BYTES, ENTRY_BYTES, CARRIED_BYTES = 192 << 20, 120, 1000
#: What a related incident carries besides its id and time.
STORED = tuple(n for n in VIEW_COLUMNS if n not in ("incident_id", "timestamp"))


def _score(matched: dict[str, Column]) -> Column:
    total = F.lit(0)
    for name, weight in K.CORRELATION_WEIGHTS.items():
        total = total + F.when(matched[name], weight).otherwise(0)
    return total


def _reason(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"Same {name.replace('_', ' ')}: "), value)


def _newest_first(id_column: str = "candidate_id", time: str = "candidate_time") -> list[Column]:
    return [F.col(time).desc_nulls_last(), F.col(id_column).asc()]


def _sort_fields() -> list[Column]:
    """Leading struct fields that make a plain array sort put the best match first."""
    return [
        (-F.col("correlation_score")).alias("order_score"),
        F.col("candidate_time").isNull().alias("order_no_time"),
        (-F.unix_micros("candidate_time")).alias("order_time"),
    ]


# --- one against all ---------------------------------------------------------------


def correlate(pairs: DataFrame, left: str = "left_", right: str = "right_") -> DataFrame:
    """Score prefixed pairs of incidents and say why, in the left one's spelling."""
    matched = {
        name: F.coalesce(
            F.lower(text_or_null(F.col(f"{left}{name}")))
            == F.lower(text_or_null(F.col(f"{right}{name}"))),
            F.lit(False),
        )
        for name in DIMENSIONS
    }
    reasons = [F.when(matched[n], _reason(n, F.col(f"{left}{n}"))) for n in DIMENSIONS]
    return pairs.withColumns(
        {"correlation_score": _score(matched), "match_reasons": compact_texts(*reasons)}
    )


def find_related(
    incidents: DataFrame,
    incident_id: str,
    min_score: int = K.MIN_CORRELATION,
    limit: int = K.RELATED_LIMIT,
) -> DataFrame:
    """The incidents most strongly tied to one, newest first among equals.

    The one incident is read by its key, which reaches the scan; its values become
    literals, so the table is read once with nothing joined or shuffled but the top rows.
    Results carry the normalised incident beside its score and reasons.
    """
    view = normalize_incidents(incidents)
    source = None
    if "incident_id" in incidents.columns:
        source = normalize_incidents(get_incident(incidents, incident_id)).select(*DIMENSIONS).first()
    # An id stored under another name, or in the payload, is found in the view only.
    source = source or view.filter(F.col("incident_id") == incident_id).select(*DIMENSIONS).first()
    values = {name: source[name] for name in DIMENSIONS} if source else {}
    named = view.select(
        F.col("incident_id").alias("candidate_id"),
        F.col("timestamp").alias("candidate_time"),
        *[F.lit(values.get(name)).cast("string").alias(f"left_{name}") for name in DIMENSIONS],
        *[F.col(name).alias(f"right_{name}") for name in DIMENSIONS],
        *[F.col(name) for name in STORED],
    )
    if not any(values.values()):
        named = named.filter(F.lit(False))
    scored = correlate(named.filter(F.col("candidate_id") != incident_id))
    return (
        scored.filter(F.col("correlation_score") >= min_score)
        .orderBy(F.col("correlation_score").desc(), *_newest_first())
        .limit(limit)
        .select("candidate_id", "candidate_time", "correlation_score", "match_reasons", *STORED)
    )


# --- all against all ---------------------------------------------------------------


def _sets(places: list[int]) -> list[tuple[int, int]]:
    """(bit mask, weight) of every subset of the given dimensions, the empty one first."""
    weights = list(K.CORRELATION_WEIGHTS.values())
    found = [(0, 0)]
    for place in places:
        found += [(mask | 1 << place, weight + weights[place]) for mask, weight in found]
    return found


def related_lists(
    view: DataFrame, min_score: int = K.MIN_CORRELATION, limit: int = K.RELATED_LIMIT
) -> DataFrame:
    """For each distinct combination of values, its ``limit + 1`` best related incidents.

    Dimensions are split in strong ones (who and from where, with many values) and weak
    ones. Two incidents agree on one of four sets of strong dimensions; for each set,
    incidents with equal strong values form a group (all incidents, for the empty set), and
    incidents of a group with equal weak values rank their group alike. So a list per group
    and weak values is enough: its ``limit + 1`` best by weak agreement, then newest. Any
    further member is outranked by ``limit`` others that agree on at least as much.

    A group of at most ``limit + 1`` is its own list. Only in larger groups is the list put
    together from shorter ones, the newest for each set of weak values. Incidents with equal
    values share one profile, and a profile consults at most four lists. No pair of
    incidents is formed inside a group, and the result is exact.
    """
    if min_score < 1:
        raise ValueError("min_score must be at least 1: unrelated incidents never match.")
    keep = limit + 1
    rows = view.select(
        F.col("incident_id").alias("candidate_id"),
        F.col("timestamp").alias("candidate_time"),
        profile().alias("profile"),
    ).withColumn("profile_key", profile_key())
    members = top_per_key(rows, ["profile_key"], _newest_first(), keep)
    profiles = rows.groupBy("profile_key").agg(
        F.any_value("profile").alias("profile"), F.count("*").alias("size")
    )
    owners = _grouped_profiles(profiles, keep)
    # At most ``keep`` members per profile, and four groups.
    placed = members.drop("profile").join(owners, "profile_key").withColumnRenamed("profile", "values")
    placed = placed.select("group", "weak", "large", "strong", "candidate_id", "candidate_time", "values")
    small = placed.filter("NOT large").select("group", "candidate_id", "candidate_time", "values")
    merged = _merged_lists(placed.filter("large"), min_score, keep).drop("strong")
    owner = ["profile_key", "profile", "strong", "group"]
    candidate = ["candidate_id", "candidate_time", "values"]
    consulted = (
        owners.filter("NOT large").select(*owner).join(small, "group").select(*owner, *candidate)
    ).unionByName(
        owners.filter("large").select(*owner, "weak").join(merged, ["group", "weak"]).select(*owner, *candidate)
    )
    # Six comparisons of texts per candidate, not copied into each of the filters and scores below.
    agreed = once(consulted, {"mask": _agreement(range(len(DIMENSIONS)))}).drop("profile", "values")
    strong_bits = sum(1 << place for place in STRONG)
    score = sum(
        (F.when(F.col("mask").bitwiseAND(F.lit(1 << place)) > 0, w).otherwise(0) for place, w in enumerate(K.CORRELATION_WEIGHTS.values())),
        F.lit(0),
    )
    # A candidate is taken from the group of exactly the strong values it shares, so never twice.
    exact = agreed.filter(F.col("mask").bitwiseAND(F.lit(strong_bits)) == F.col("strong"))
    exact = exact.withColumn("correlation_score", score).filter(F.col("correlation_score") >= min_score)
    best = top_per_key(
        exact, ["profile_key"], [F.col("correlation_score").desc(), *_newest_first()], keep
    )
    # At most limit + 1 entries are collected per profile.
    entry = F.struct(
        *_sort_fields(), "candidate_id", "candidate_time", "mask", "correlation_score"
    )
    return best.groupBy("profile_key").agg(F.collect_list(entry).alias("related"))


def _grouped_profiles(profiles: DataFrame, keep: int) -> DataFrame:
    """A row per profile and set of strong dimensions it has: its group, and whether that is large."""
    choices = ", ".join(f"struct({mask} AS strong)" for mask, _ in _sets(STRONG))
    opened = profiles.withColumn("_present", _bits(lambda i: F.col("profile")[i].isNotNull())).select(
        "*", F.expr(f"inline(array({choices}))")
    )
    usable = F.col("strong").bitwiseAND(F.col("_present")) == F.col("strong")
    group = F.concat(F.col("strong"), F.lit("|"), profile_key(lambda i: f"strong & {1 << i} > 0"))
    weak = profile_key(lambda i: "false" if i in STRONG else "true")
    grouped = opened.filter(usable).drop("_present").withColumns({"group": group, "weak": weak})
    sized = grouped.filter("strong <> 0").groupBy("group").agg(F.sum("size").alias("group_size"))
    # A group of one holds nobody else; everybody is in the group that shares no strong value.
    named = grouped.filter("strong <> 0").join(sized.filter("group_size > 1"), "group")
    named = named.withColumn("large", F.col("group_size") > keep).drop("group_size", "size")
    whole = grouped.filter("strong = 0").withColumn("large", F.lit(True)).drop("size")
    return named.unionByName(whole)


def _merged_lists(placed: DataFrame, min_score: int, keep: int) -> DataFrame:
    """(group, weak, candidate, ...): the best of each large group for each of its weak values."""
    weights = list(K.CORRELATION_WEIGHTS.values())
    strong_weight = sum((F.when(F.col("strong").bitwiseAND(F.lit(1 << p)) > 0, weights[p]).otherwise(0) for p in STRONG), F.lit(0))
    choices = ", ".join(f"struct({mask} AS mask, {weight} AS weight)" for mask, weight in _sets(WEAK))

    def keyed(df: DataFrame, values: str) -> DataFrame:
        present = _bits(lambda i: F.col(values)[i].isNotNull())
        opened = df.withColumn("_present", present).select("*", F.expr(f"inline(array({choices}))"))
        usable = F.col("mask").bitwiseAND(F.col("_present")) == F.col("mask")
        reached = strong_weight + F.col("weight") >= min_score
        chosen = profile_key(lambda i: f"mask & {1 << i} > 0", values)
        key = F.concat(F.col("group"), F.lit("|"), F.col("mask"), F.lit("|"), chosen)
        return opened.filter(usable & reached).drop("_present").withColumn("key", key)

    newest = top_per_key(placed, ["group", "weak"], _newest_first(), keep)
    lists = top_per_key(keyed(newest, "values").select("key", "candidate_id", "candidate_time", "values"), ["key"], _newest_first(), keep)
    asking = placed.groupBy("group", "weak", "strong").agg(F.any_value("values").alias("profile"))
    candidates = keyed(asking, "profile").join(lists, "key").filter(F.col("mask") == _agreement(WEAK))
    ranked = top_per_key(candidates, ["group", "weak"], [F.col("weight").desc(), *_newest_first()], keep)
    return ranked.select("group", "weak", "candidate_id", "candidate_time", "values", "strong", "mask", "weight")


def _agreement(places) -> Column:
    """Bit mask of the given dimensions on which ``profile`` and ``values`` agree."""
    return sum(
        (
            F.when(F.coalesce(F.col("profile")[i] == F.col("values")[i], F.lit(False)), 1 << i).otherwise(0)
            for i in places
        ),
        F.lit(0),
    )


def profile() -> Column:
    """The six compared values of a normalised incident, case-folded, blanks as NULL."""
    return F.array(*[F.lower(text_or_null(F.col(name))) for name in DIMENSIONS])


def profile_key(chosen=lambda place: "true", values: str = "profile") -> Column:
    """The chosen values of a profile as one text. Lengths keep different values apart."""
    parts = [
        f"IF({chosen(i)}, coalesce(length({values}[{i}]) || ':' || {values}[{i}], '-'), '-')"
        for i in range(len(DIMENSIONS))
    ]
    return F.expr(f"concat({', '.join(parts)})")


def _bits(condition) -> Column:
    """Bit mask of the dimensions (by position) for which ``condition`` holds."""
    total = F.lit(0)
    for place in range(len(DIMENSIONS)):
        total = total + F.when(condition(place), 1 << place).otherwise(0)
    return total


def _packed(agrees, places) -> Column:
    """Score and bit mask of the agreeing dimensions in one number: ``score * 64 + mask``."""
    weights = list(K.CORRELATION_WEIGHTS.values())
    return sum((F.when(agrees(i), weights[i] * 64 + (1 << i)).otherwise(0) for i in places), F.lit(0))


#: Leading fields of an entry, by which a plain array sort puts the best first.
ORDER = ("order_score", "order_no_time", "order_time", "candidate_id")


def _entry(packed: Column, member: Column, *more: Column) -> Column:
    return F.struct(
        (-F.shiftright(packed, 6)).alias("order_score"),
        member["order_no_time"].alias("order_no_time"),
        member["order_time"].alias("order_time"),
        member["candidate_id"].alias("candidate_id"),
        packed.bitwiseAND(F.lit(63)).alias("mask"),
        *more,
    )


def _member(id_column: str, time: str, *more: Column) -> Column:
    return F.struct(
        F.col(time).isNull().alias("order_no_time"),
        (-F.unix_micros(time)).alias("order_time"),
        F.col(id_column).alias("candidate_id"),
        *more,
    )


def _ranked_groups(placed: DataFrame, min_score: int, keep: int) -> DataFrame:
    """(group, weak, list): for each group and its weak values, the best of the group by agreement.

    A group of at most ``GROUP_ROWS`` is ranked in one row. Larger ones are merged from lists.
    """
    sizes = placed.groupBy("group").agg((F.count("*") > GROUP_ROWS).alias("large"))
    sized = placed.join(sizes, "group")
    member = _member("candidate_id", "candidate_time", F.col("values"))
    rows = sized.filter("NOT large").groupBy("group", "strong").agg(F.collect_list(member).alias("members"))
    none = F.lit(None).cast("string")
    asked = F.transform("members", lambda m: F.array(*[m["values"][i] if i in WEAK else none for i in range(len(DIMENSIONS))]))
    opened = rows.select("group", "strong", "members", F.explode(F.array_distinct(asked)).alias("asked"))
    shared = _packed(lambda i: F.col("strong").bitwiseAND(F.lit(1 << i)) > 0, STRONG)

    def ranked(m: Column) -> Column:
        packed = shared + _packed(lambda i: F.col("asked")[i] == m["values"][i], WEAK)
        return F.struct(packed.alias("packed"), m.alias("member"))

    def listed(r: Column) -> Column:
        return _entry(r["packed"], r["member"], *[r["member"]["values"][i].alias(DIMENSIONS[i]) for i in STRONG])

    reached = F.filter(F.transform("members", ranked), lambda r: r["packed"] >= 64 * min_score)
    weak = profile_key(lambda i: "true" if i in WEAK else "false", "asked")
    small = opened.select("group", weak.alias("weak"), F.slice(F.sort_array(F.transform(reached, listed)), 1, keep).alias("list"))
    merged = _merged_lists(sized.filter("large"), min_score, keep)
    found = F.struct("packed", member.alias("member"))
    packed = F.col("weight") * 64 + F.col("mask") + shared
    large = merged.withColumn("packed", packed).groupBy("group", "weak").agg(F.collect_list(found).alias("found"))
    return small.unionByName(large.select("group", "weak", F.sort_array(F.transform("found", listed)).alias("list")))


def shared_lists(rows: DataFrame, min_score: int, keep: int) -> DataFrame:
    """(address, weak values) as ``place``: the best incidents for it, whoever the principal is.

    Of those at the same address and of all others by weak values alone, the best ``keep``
    are enough: a further one is outranked by ``keep`` others for every principal that it
    does not share, and those it does share are compared with it directly.
    """
    narrow = rows.select(
        F.col("incident_id").alias("candidate_id"), F.col("timestamp").alias("candidate_time"), F.col("profile").alias("values")
    ).withColumns({"place": _place_key("values"), "weak": profile_key(lambda i: "true" if i in WEAK else "false", "values")})
    # In a group, and among all, only the newest of equal values can be listed.
    cells = as_table(top_per_key(narrow, ["place"], _newest_first(), keep))
    address = F.col("values")[STRONG[1]]
    at_address = cells.filter(address.isNotNull()).withColumns(
        {"group": F.concat(F.lit(f"{1 << STRONG[1]}|"), address), "strong": F.lit(1 << STRONG[1])}
    )
    anywhere = top_per_key(cells, ["weak"], _newest_first(), keep).withColumns({"group": F.lit("0|"), "strong": F.lit(0)})
    lists = as_table(_ranked_groups(at_address.unionByName(anywhere).drop("place"), min_score, keep))
    places = cells.groupBy("place").agg(F.any_value("weak").alias("weak"), F.any_value(address).alias("_address"))
    places = places.withColumn("group", F.concat(F.lit(f"{1 << STRONG[1]}|"), F.col("_address")))
    near = lists.select("group", "weak", F.col("list").alias("_near"))
    far = lists.filter("group = '0|'").select("weak", F.col("list").alias("_far"))
    joined = places.join(near, ["group", "weak"], "left").join(far, "weak", "left")
    none = F.array().cast(lists.schema["list"].dataType)
    elsewhere = F.filter(
        F.coalesce("_far", none), lambda e: ~F.coalesce(e[DIMENSIONS[STRONG[1]]] == F.col("_address"), F.lit(False))
    )
    best = F.slice(F.sort_array(F.concat(F.coalesce("_near", none), elsewhere)), 1, keep)
    return joined.select("place", F.transform(best, lambda e: e.dropFields(DIMENSIONS[STRONG[1]])).alias("list"))


def _place_key(values: str) -> Column:
    return profile_key(lambda i: "false" if i == STRONG[0] else "true", values)


def _with_columns(lists: DataFrame, key: str, view: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Lists whose entries carry the named columns of their incident as ``stored``, read once per id."""
    opened = lists.select(key, F.posexplode("list").alias("_place", "_entry"))
    wanted = opened.select(F.col("_entry.candidate_id").alias("_id")).distinct()
    stored = view.select(F.col("incident_id").alias("_id"), F.struct(*names).alias("_stored")).join(wanted, "_id", "left_semi")
    # Reports of incidents with a repeated id are put together by ``_with_stored``.
    one = stored.groupBy("_id").agg(F.first("_stored").alias("_stored"))
    full = opened.join(one, F.col("_entry.candidate_id") == F.col("_id"), "left")
    entry = F.struct("_place", F.col("_entry").withField("stored", F.col("_stored")).alias("_entry"))
    by_place = lambda x, y: x["_place"] - y["_place"]
    found = full.groupBy(key).agg(F.array_sort(F.collect_list(entry), by_place).alias("_list"))
    return found.select(key, F.transform("_list", lambda r: r["_entry"]).alias("list"))


def attach_related(
    view: DataFrame, min_score: int = K.MIN_CORRELATION, limit: int = K.RELATED_LIMIT, carried: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``related``: each incident's best matches, strongest then newest first.

    Incidents of one principal are compared side by side, where they are, and the others come
    from the short lists of an address and weak values, so no list is sent to each incident.
    Principals of more than ``OWN_ROWS`` incidents are ranked from ``related_lists`` instead.
    ``carried`` names columns of the view that each match brings along.
    """
    if min_score < 1:
        raise ValueError("min_score must be at least 1: unrelated incidents never match.")
    keep, who = limit + 1, STRONG[0]
    rows = view.withColumn("profile", profile()).withColumns({"_who": F.col("profile")[who], "place": _place_key("profile")})
    lists = as_table(shared_lists(rows, min_score, keep))
    counted = rows.filter("_who IS NOT NULL").groupBy("_who").agg(F.count("*").alias("_rows"))
    busy = as_table(counted.filter(F.col("_rows") > OWN_ROWS).select("_who"))
    some_busy = not busy.isEmpty()

    def reasons(mask: Column) -> Column:
        return compact_texts(
            *[
                F.when(mask.bitwiseAND(F.lit(1 << place)) > 0, _reason(name, F.col(name)))
                for place, name in enumerate(DIMENSIONS)
            ]
        )

    def attached(df: DataFrame, best: Column, brought) -> DataFrame:
        # Others come before the incident itself is dropped, so the list stays in order.
        others = F.filter(best, lambda r: r["candidate_id"] != F.col("incident_id"))
        shaped = F.transform(
            F.slice(others, 1, limit),
            lambda r: F.struct(
                r["candidate_id"].alias("incident_id"),
                F.timestamp_micros(-r["order_time"]).alias("timestamp"),
                (-r["order_score"]).alias("correlation_score"),
                reasons(r["mask"]).alias("match_reasons"),
                *[brought(r, n).alias(n) for n in carried],
            ),
        )
        # A later explode would otherwise rank twice: once to see whether the list is empty.
        return once(df, {"related": shaped}).select(*view.columns, "related")

    elsewhere = lambda e: ~F.coalesce(e[DIMENSIONS[who]] == F.col("_who"), F.lit(False))
    others = [i for i in range(len(DIMENSIONS)) if i != who]
    more = [F.struct(*carried).alias("stored")] if carried else []
    mate = _member("incident_id", "timestamp", *[F.col("profile")[i].alias(f"value_{i}") for i in others], *more)
    # Incidents of no principal have no mates and are dealt out by their id.
    alone = F.when(F.col("_who").isNull(), F.xxhash64("incident_id"))
    own = rows.join(busy, "_who", "left_anti") if some_busy else rows
    own = own.withColumn("_mates", F.collect_list(mate).over(Window.partitionBy("_who", alone)))
    own = once(own, {f"_value_{i}": F.col("profile")[i] for i in others})
    same = F.when(F.col("_who").isNotNull(), _packed(lambda i: F.lit(True), [who])).otherwise(0)
    weighed = F.transform("_mates", lambda m: _packed(lambda i: F.col(f"_value_{i}") == m[f"value_{i}"], others))
    own = once(own, {"_weighed": weighed, "_same": same})
    ranked = F.transform(
        "_mates", lambda m, i: _entry(F.get(F.col("_weighed"), i) + F.col("_same"), m, i.alias("place"))
    )
    near = F.filter(ranked, lambda r: (r["mask"].bitwiseAND(F.lit(1 << who)) > 0) & (-r["order_score"] >= min_score))
    far = F.array_compact(F.transform("list", lambda e, i: F.when(elsewhere(e), _key(e, (-i - 1).alias("place")))))
    best = F.slice(F.sort_array(F.concat(near, F.coalesce(far, F.array().cast(KEYS)))), 1, keep)

    def brought(r: Column, name: str) -> Column:
        mate = F.get(F.col("_mates"), r["place"])["stored"][name]
        return F.when(r["place"] >= 0, mate).otherwise(F.get(F.col("list"), -r["place"] - 1)["stored"][name])

    full = as_table(_with_columns(lists, "place", view, carried)) if carried else lists
    result = attached(own.join(_spread_if_short(full, bool(carried)), "place", "left"), best, brought)
    if not some_busy:
        return result
    # The best among the incidents of busy principals hold the best of one's own principal.
    many = rows.join(busy, "_who", "left_semi").withColumn("profile_key", profile_key())
    found = related_lists(many, min_score, limit)
    profiles = many.groupBy("profile_key").agg(F.any_value("place").alias("place"), F.any_value("_who").alias("_who"))
    joined = profiles.join(found, "profile_key", "left").join(_spread_if_short(lists, False), "place", "left")
    none = F.array().cast(ENTRIES)
    mine = F.filter("related", lambda e: e["mask"].bitwiseAND(F.lit(1 << who)) > 0)
    near, far = [F.transform(part, lambda e: _key(e)) for part in (mine, F.filter("list", elsewhere))]
    merged = F.slice(F.sort_array(F.concat(F.coalesce(near, none), F.coalesce(far, none))), 1, keep)
    merged = joined.select("profile_key", merged.alias("list"))
    merged = _with_columns(merged, "profile_key", view, carried) if carried else merged
    return result.unionByName(
        attached(many.join(merged, "profile_key", "left"), _or_none("list", merged), lambda r, name: r["stored"][name])
    )


def _or_none(name: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType))


def _spread_if_short(lists: DataFrame, carried: bool) -> DataFrame:
    """Lists that fit in memory go to every executor, so the incidents need not be sent to them."""
    entries = lists.agg(F.sum(F.size("list")).alias("entries")).first()["entries"] or 0
    return F.broadcast(lists) if entries * (CARRIED_BYTES if carried else ENTRY_BYTES) <= BROADCAST_BYTES else lists


#: What entries are ranked by: their order, agreement, and place in one of two lists.
ENTRIES = "array<struct<order_score:int,order_no_time:boolean,order_time:bigint,candidate_id:string,mask:int>>"
KEYS = ENTRIES.replace("mask:int", "mask:int,place:int")


def _key(entry: Column, *more: Column) -> Column:
    return F.struct(*[entry[n].alias(n) for n in (*ORDER, "mask")], *more)


def _with_stored(attached: DataFrame, view: DataFrame) -> DataFrame:
    """The related incidents with their stored columns; at most ``limit`` per incident are joined."""
    entries = attached.select(F.col("incident_id").alias("_of"), F.posexplode("related").alias("_place", "_entry"))
    stored = view.select(F.col("incident_id").alias("_id"), *STORED)
    full = entries.join(stored, F.col("_entry.incident_id") == F.col("_id"))
    entry = F.struct("_place", "_entry.*", *STORED)
    by_place = lambda x, y: x["_place"] - y["_place"]
    lists = full.groupBy("_of").agg(F.array_sort(F.collect_list(entry), by_place).alias("_full"))
    shaped = F.transform("_full", lambda r: r.dropFields("_place"))
    lists = lists.select("_of", shaped.alias("_full"))
    none = F.array().cast(lists.schema["_full"].dataType)
    joined = attached.drop("related").join(lists, F.col("incident_id") == F.col("_of"), "left")
    return joined.withColumn("related", F.coalesce("_full", none)).drop("_of", "_full")


def find_related_all(
    incidents: DataFrame, min_score: int = K.MIN_CORRELATION, limit: int = K.RELATED_LIMIT
) -> DataFrame:
    """One row per incident and related incident, ranked from 1."""
    attached = attach_related(normalize_incidents(incidents), min_score, limit)
    return attached.select("incident_id", F.posexplode("related").alias("place", "r")).select(
        "incident_id",
        (F.col("place") + 1).alias("rank"),
        F.col("r.incident_id").alias("related_id"),
        F.col("r.correlation_score").alias("correlation_score"),
        F.col("r.match_reasons").alias("match_reasons"),
    )


# --- reports -----------------------------------------------------------------------

REPORT_COLUMNS = (
    "incident_id", "severity", "risk_score", "summary", "suspicious_reasons",
    "related_incidents", "recommended_actions",
)


def investigate(incidents: DataFrame, incident_id: str, home_region: str = K.HOME_REGION) -> DataFrame:
    """The report of one incident; an unknown id is an error."""
    found = get_incident(incidents, incident_id)
    if found.isEmpty():
        raise ValueError(f"Incident not found: {incident_id}")
    related = find_related(incidents, incident_id)
    entry = F.struct(
        F.struct(*_sort_fields(), "candidate_id").alias("order"),
        F.col("candidate_id").alias("incident_id"),
        F.col("candidate_time").alias("timestamp"),
        "correlation_score",
        "match_reasons",
        *STORED,
    )
    # At most ``limit`` entries. Maps have no order, so the entries are compared by their first field.
    best_first = lambda x, y: F.when(x["order"] < y["order"], -1).when(x["order"] > y["order"], 1).otherwise(0)
    listed = related.agg(F.array_sort(F.collect_list(entry), best_first).alias("related")).scalar()
    report = report_columns(normalize_incidents(found), home_region)
    shaped = F.transform(
        "_related",
        lambda r: F.struct(
            r["incident_id"].alias("incident_id"),
            r["timestamp"].alias("timestamp"),
            r["correlation_score"].alias("correlation_score"),
            r["match_reasons"].alias("match_reasons"),
            *[r[n].alias(n) for n in STORED],
        ),
    )
    return (
        report.withColumn("_related", listed)
        .withColumn("related_incidents", shaped)
        .select(*REPORT_COLUMNS)
    )


def investigate_all(incidents: DataFrame, home_region: str = K.HOME_REGION) -> DataFrame:
    """The report of every incident; ids are unique, as in a store of incidents.

    Matches bring their stored columns along, so none is looked up by its id. Only where an id
    is repeated, the stored rows of that id are joined to the reports concerned.
    """
    view = normalize_incidents(incidents)
    counted = view.filter("incident_id IS NOT NULL").groupBy("incident_id").agg(F.count("*").alias("_rows"))
    repeated = as_table(counted.filter("_rows > 1").select("incident_id", F.lit(True).alias("_again")))
    if repeated.isEmpty():
        attached = attach_related(view, carried=STORED)
    else:
        marked = attach_related(view.join(repeated, "incident_id", "left"), carried=(*STORED, "_again"))
        concerned = F.coalesce("_again", F.lit(False)) | F.exists("related", lambda r: F.coalesce(r["_again"], F.lit(False)))
        plain = F.transform("related", lambda r: r.dropFields("_again"))
        short = F.transform("related", lambda r: r.dropFields("_again", *STORED))
        marked = marked.withColumn("_concerned", concerned)
        others = marked.filter("NOT _concerned").withColumn("related", plain)
        again = marked.filter("_concerned").withColumn("related", short).drop("_again", "_concerned")
        attached = others.drop("_again", "_concerned").unionByName(_with_stored(again, view))
    return (
        report_columns(attached, home_region)
        .withColumnRenamed("related", "related_incidents")
        .select(*REPORT_COLUMNS)
    )
