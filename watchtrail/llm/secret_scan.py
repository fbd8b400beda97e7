"""Secret scan: named patterns plus Shannon entropy over a sliding window of candidate strings.

Native columns only. A pattern's matches are placed by the lengths of the pieces between
them. Added spans come from runs of one character class (hexadecimal, upper case and
digits, base64): a window slides over the run, the counts of its characters change by one
in and one out per step, and with them the sum of c * log2(c), which gives the entropy of
every window. The windows at or above the class's threshold make the span. A run that lies
in a pattern's span, lacks the class's mix of characters, or is on the allow-list is left.

``scan(..., whole=True)`` judges windows rather than runs (``WHOLE_CLASSES``): lower case with
digits is a class, one character of a kind is enough, mixed case without a digit needs more
bits, and only the allow-listed part of a run (``PUBLIC``) is left out, so what stands beside
it is measured. The default keeps the rules that the SQL of ``op9_secret_scan`` states.

A null text is empty; an empty text has no spans. Rows are independent: repeated ids and
rows, ties and further columns do not matter. Positions are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A run shorter than the limit cannot hold a longer match, so the limit may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: class: characters, characters every candidate must hold, bits from which a window counts.
CLASSES = {
    "hexadecimal": ("0123456789abcdefABCDEF", (r"[0-9]", r"[a-fA-F]"), 3.0),
    "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", (r"[0-9].*[0-9]", r"[A-Z].*[A-Z]"), 3.4),
    "base64": (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        (r"[0-9].*[0-9]", r"[A-Z].*[A-Z]", r"[a-z].*[a-z]"),
        3.8,
    ),
}
#: Candidates that look random or ordered but are public by design.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|0123456789|abcdefghij",
    r"^(sha1|sha256|sha384|sha512|md5)[-=]",
)

_LETTER = CLASSES["base64"][0]
#: As above, by the windows' entropy. Text of long words stays below the bits of runs without a digit.
WHOLE_CLASSES = {
    "hexadecimal": CLASSES["hexadecimal"],
    "upper": (CLASSES["upper"][0], (r"[0-9]", r"[A-Z]"), 3.4),
    "lower": ("abcdefghijklmnopqrstuvwxyz0123456789", (r"[0-9]", r"[a-z]"), 3.5),
    "base64": (_LETTER, (r"[0-9]", r"[A-Z]", r"[a-z]"), 3.8),
    "letters": (_LETTER, (r"[A-Z]", r"[a-z]"), 4.0),
}
_ASIDE = r"A-Za-z0-9+/_=\-"
#: The allow-listed parts: whole identifiers, digests with their lengths, marked words.
PUBLIC = (
    rf"(?<![{_ASIDE}])[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}(?![{_ASIDE}])"
    rf"|(?<![{_ASIDE}])(?:md5[-=][A-Za-z0-9+/]{{1,32}}|sha1[-=][A-Za-z0-9+/]{{1,40}}|sha256[-=][A-Za-z0-9+/]{{1,64}}"
    r"|sha384[-=][A-Za-z0-9+/]{1,96}|sha512[-=][A-Za-z0-9+/]{1,128})={0,2}"
    r"|(?i:example|placeholder|changeme|0123456789|abcdefghij)"
)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, each: Column) -> Column:
        start = acc["at"] + each["gap"]
        end = start + F.length(each["value"])
        span = F.struct(start.alias("start"), end.alias("end"), each["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")
    )


def hot_range(value: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """struct<first, last> of the windows whose entropy is at least ``bits``; nulls if none is.

    Every position takes one character in, and from ``window`` on one out.
    """
    log_sum = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def code(i: Column) -> Column:
        return F.instr(F.lit(alphabet), F.substring(value, i, F.lit(1)))

    size = F.length(value)
    moves = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.array(
                F.struct(F.when(i > window, code(i - window)).otherwise(0).alias("code"), F.lit(-1).alias("by"), i.alias("i")),
                F.struct(code(i).alias("code"), F.lit(1).alias("by"), i.alias("i")),
            ),
        )
    )

    def step(acc: Column, move: Column) -> Column:
        held = F.when(move["code"] > 0, F.element_at(acc["counts"], F.greatest(move["code"], F.lit(1)))).otherwise(0)
        then = F.when(move["code"] > 0, held + move["by"]).otherwise(0)
        total = acc["sum"] + F.element_at(log_sum, then + 1) - F.element_at(log_sum, held + 1)
        hot = (move["by"] > 0) & (move["i"] >= window) & (math.log2(window) - total / window >= bits)
        return F.struct(
            F.transform(acc["counts"], lambda c, k: F.when(k + 1 == move["code"], then).otherwise(c)).alias("counts"),
            total.alias("sum"),
            F.when(hot, F.coalesce(acc["first"], move["i"] - window)).otherwise(acc["first"]).alias("first"),
            F.when(hot, move["i"]).otherwise(acc["last"]).alias("last"),
        )

    zero = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    return F.aggregate(moves, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def blanked(text: Column, pattern: str) -> Column:
    """``text`` with every match of ``pattern`` replaced by as many spaces."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spaces = F.concat(F.transform(found, lambda v: F.repeat(F.lit(" "), F.length(v))), F.array(F.lit("")))
    pieces = F.zip_with(F.split(text, pattern, -1), spaces, lambda piece, gap: F.concat(piece, gap))
    return F.when(F.rlike(text, F.lit(pattern)), F.array_join(pieces, "")).otherwise(text)


def _entropy_spans(text: Column, base: Column, kind: tuple[str, tuple[str, ...], float], allowed: tuple[str, ...]) -> Column:
    alphabet, must, bits = kind
    letters = alphabet.replace("-", r"\-")
    found = matches(text, f"[{letters}]{{{WINDOW},}}")

    def wanted(m: Column) -> Column:
        keep = ~F.exists(base, lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"]))
        for pattern in must:
            keep &= F.rlike(m["value"], F.lit(pattern))
        for pattern in allowed:
            keep &= ~F.rlike(m["value"], F.lit(pattern))
        return keep

    measured = F.transform(
        F.filter(found, wanted), lambda m: F.struct(m["start"].alias("at"), hot_range(m["value"], alphabet, bits).alias("hot"))
    )
    hot = F.filter(measured, lambda m: m["hot"]["first"].isNotNull())
    return F.transform(hot, lambda m: _span("entropy", m["at"] + m["hot"]["first"], m["at"] + m["hot"]["last"]))


def scan(docs: DataFrame, *, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED, whole: bool = False) -> DataFrame:
    """``docs`` with ``base_spans`` and ``secret_spans``: array<struct<start, rank, end, kind>>, in order.

    Both columns replace columns of these names. An added span that lies in a pattern's
    span, or in another added one, is left out.
    """
    text = F.col("secret_text")
    valued = F.filter(
        matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= LEAST_VALUE
    )

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda m: _span(kind, m["start"], m["end"]))

    patterns = (named("assign", valued), named("access", matches(text, ACCESS)), named("hex", matches(text, HEX)))
    base = F.col("base_spans")
    opened = docs.withColumn("secret_text", F.coalesce(F.col(text_col), F.lit("")))
    opened = opened.withColumn("base_spans", F.array_sort(F.concat(*patterns)))
    if whole:
        opened = opened.withColumn("open_text", blanked(text, PUBLIC))
        each = [_entropy_spans(F.col("open_text"), base, kind, ()) for kind in WHOLE_CLASSES.values()]
    else:
        each = [_entropy_spans(text, base, kind, allowed) for kind in CLASSES.values()]
    opened = opened.withColumn("added_spans", F.array_distinct(F.concat(*each)))

    def alone(s: Column) -> Column:
        return ~F.exists(
            F.col("added_spans"),
            lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"]),
        )

    every = F.array_sort(F.concat(base, F.filter(F.col("added_spans"), alone)))
    return opened.withColumn("secret_spans", every).drop("secret_text", "open_text", "added_spans")


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """Scanned ``docs`` with every span of the text replaced by ``mark``; overlapping spans make one."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        F.col("secret_spans"),
        zero,
        step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return docs.withColumn(text_col, F.when(F.size("secret_spans") > 0, clean).otherwise(F.col(text_col)))
