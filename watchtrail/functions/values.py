"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decimal text only: Spark's own cast would also take Java suffixes such as "5d".
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def text_or_null(value: Column) -> Column:
    """Empty text counts as absent."""
    return F.nullif(value.cast("string"), F.lit(""))


def text_to_number(value: Column) -> Column:
    """Numeric text to double, anything else to NULL."""
    return F.when(value.rlike(NUMBER_PATTERN), F.trim(value).try_cast("double"))


def as_number(value: Column, default: float = 0.0) -> Column:
    """Lenient numeric read: unusable values become ``default``."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def is_finite(value: Column) -> Column:
    """True for a number that is neither NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def unit_score(value: Column) -> Column:
    """Clamp to [0, 1]; absent, non-numeric and non-finite values become 0."""
    number = value.try_cast("double")
    return F.when(is_finite(number), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))).otherwise(0.0)


def fires(value: Column) -> Column:
    """True when a 0/1 flag is set. Spark ranks NaN above every number, so it is zeroed first."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)) >= 1


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def text_array(values) -> Column:
    return F.array(*[F.lit(value) for value in values])


def compact_texts(*values: Column) -> Column:
    """The non-null texts, in the order given."""
    return F.array_compact(F.array(*values))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer copies an ordinary column's expression into every later filter on it.
    A one-row generator keeps a costly one, such as opened JSON, from being repeated.
    """
    added = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [name for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(added)))


STRICT_JSON = {"allowSingleQuotes": "false"}


def is_single_json(text: Column) -> Column:
    """Strict check: the whole text is one JSON value, with nothing after it.

    A parser stops at a closing mark, so the text is read inside brackets and inside
    braces: what would end the one early is an error in the other. Repeated names pass here.
    """
    in_brackets = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    in_braces = F.from_json(_as_field(text), "x string", STRICT_JSON)["x"].isNotNull()
    return F.coalesce(in_brackets & (in_braces | text.rlike(r"^\s*null\s*$")), F.lit(False))


def json_fields(text: Column, strict: Column | None = None) -> Column:
    """The fields of a JSON object as map<string,variant>; NULL for anything else.

    A name that is repeated in any object of the text makes it NULL. ``strict`` is the
    text's ``is_single_json`` where that is known already.
    """
    value = F.from_json(_as_field(text), "x variant", STRICT_JSON)["x"]
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    return F.when(is_single_json(text) if strict is None else strict, fields)


def _as_field(text: Column) -> Column:
    return F.concat(F.lit('{"x":'), text, F.lit("}"))


def at_least(value: Column, limit: float) -> Column:
    """``value >= limit``, where NULL and NaN are never at least anything."""
    return F.coalesce(~F.isnan(value) & (value >= limit), F.lit(False))


def fixed_text(value: Column, digits: int) -> Column:
    """Fixed-point text, rounding the stored binary value with ties to even.

    ``format_string`` rounds the shortest decimal form instead, so it shows 0.73 for a
    0.725 that is stored just below. The fraction is scaled by 2^60, which is exact, and
    multiplied in two halves that cannot overflow. The whole part is carried beside it, so
    one rule holds for all numbers; those beyond 2^62 have no fraction left to round.
    """
    half, scale = 1 << 30, 10**digits
    size = F.abs(value)
    integer = F.floor(size)
    whole = ((size - F.floor(size)) * float(1 << 60)).cast("long")
    low = whole.bitwiseAND(F.lit(half - 1)) * scale
    high = F.shiftright(whole, 30) * scale + F.shiftright(low, 30)
    rest = F.shiftleft(high.bitwiseAND(F.lit(half - 1)), 30) + low.bitwiseAND(F.lit(half - 1))
    quotient = F.shiftright(high, 30)
    odd = quotient % 2 == 1
    up = (rest > (1 << 59)) | ((rest == (1 << 59)) & odd)
    rounded = quotient + F.when(up, 1).otherwise(0)
    carried = integer + F.when(rounded >= scale, 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("")
    exact = F.format_string(f"%s%d.%0{digits}d", sign, carried.cast("long"), rounded % scale)
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(size < float(1 << 62), exact)
        .otherwise(F.format_string(f"%.{digits}f", value))
    )
