"""Numbers as printed, units, and tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factspan.functions.core import let, lookup

#: How far a computed value may be from a claimed one.
TOLERANCE = 0.05
#: The relative move that still counts as stable.
STABLE_SHARE = 0.025

#: Decimal scales and currencies by word.
SCALES = {
    "ribu": 1e3, "thousand": 1e3, "juta": 1e6, "million": 1e6, "miliar": 1e9, "milyar": 1e9, "billion": 1e9, "triliun": 1e12, "trillion": 1e12,
}
CURRENCIES = {"rp": "rp", "rupiah": "rp", "idr": "rp", "usd": "usd", "dolar": "usd", "dollar": "usd"}
#: Claim unit and table unit, and the factor between them.
UNIT_FACTORS = {
    "triliun rp|miliar rp": 1000.0, "miliar rp|miliar rp": 1.0, "triliun rp|triliun rp": 1.0, "miliar rp|triliun rp": 0.001,
    "miliar usd|juta usd": 1000.0, "miliar dolar as|juta usd": 1000.0, "miliar dolar|juta usd": 1000.0, "billion usd|juta usd": 1000.0,
    "juta usd|juta usd": 1.0, "miliar usd|miliar usd": 1.0, "miliar dolar as|miliar dolar as": 1.0,
    "juta usd|miliar usd": 0.001, "juta usd|miliar dolar as": 0.001,
}


def parse_number(raw: Column) -> Column:
    """A number with ``.`` for thousands and ``,`` for decimals, or null.

    Parentheses around the number make it negative unless a percent sign is
    inside them; a currency before it, a scale or percent word after it, stars
    and interior blanks are dropped.
    """

    def unwrap(state: Column) -> Column:
        s, negative = state["s"], state["negative"]
        wrapped = (F.length(s) > 2) & s.startswith("(") & s.endswith(")")
        inner = F.trim(F.substring(s, F.lit(2), F.length(s) - 2))
        signed = let(inner, lambda i: F.struct(F.trim(F.when(i.startswith("-"), F.substring(i, F.lit(2), F.length(i))).otherwise(i)).alias("s"), (negative | ~F.contains(i, F.lit("%")) | i.startswith("-")).alias("negative")))
        return F.when(wrapped, signed).otherwise(state)

    def sign(state: Column) -> Column:
        s = state["s"]
        return F.when(s.startswith("-"), F.struct(F.trim(F.substring(s, F.lit(2), F.length(s))).alias("s"), F.lit(True).alias("negative"))).otherwise(state)

    def strip(state: Column) -> Column:
        s = F.regexp_replace(state["s"], r"(?i)^Rp\s*", "")
        s = F.trim(F.regexp_replace(s, r"(?i)\s*(triliun|miliar|persen|%)[^\d]*$", ""))
        return F.struct(F.trim(F.regexp_replace(s, r"\*+$", "")).alias("s"), state["negative"].alias("negative"))

    def value(state: Column) -> Column:
        s = F.regexp_replace(state["s"], r"\s+", "")

        def read(t: Column) -> Column:
            whole = F.replace(F.regexp_replace(t, ",[^,]*$", ""), F.lit("."), F.lit(""))
            text = F.when(F.contains(t, F.lit(",")), F.concat(whole, F.lit("."), F.regexp_extract(t, ",([^,]*)$", 1))).otherwise(whole)
            fine = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
            return F.when(fine, text.try_cast("double"))

        return let(s, read) * F.when(state["negative"], -1.0).otherwise(1.0)

    start = F.struct(F.trim(raw).alias("s"), F.lit(False).alias("negative"))
    return let(let(let(let(let(start, unwrap), sign), strip), unwrap), value)


def parse_unit(unit: Column) -> Column:
    """``struct(scale, currency)`` of a level unit; null for percentages and units without scale and currency."""
    words = F.regexp_extract_all(F.lower(unit), F.lit("([a-z]+)"), F.lit(1))

    def read(w: Column) -> Column:
        scales = F.filter(F.transform(w, lambda x: lookup(SCALES, x)), lambda x: x.isNotNull())
        currency = F.get(F.filter(F.transform(w, lambda x: lookup(CURRENCIES, x)), lambda x: x.isNotNull()), F.lit(0))
        scale = F.aggregate(scales, F.lit(1.0), lambda a, x: a * x)
        level = ~F.contains(unit, F.lit("%")) & ~F.array_contains(w, "persen") & ((F.size(scales) > 0) | currency.isNotNull())
        return F.when(level, F.struct(scale.alias("scale"), currency.alias("currency")))

    return let(words, read)


def unit_factor(claim: Column, table: Column) -> Column:
    """What a value in the claim's unit is multiplied by to be in the table's, or null."""
    a, b = F.trim(F.lower(claim)), F.trim(F.lower(table))
    pair = let(F.struct(parse_unit(a).alias("x"), parse_unit(b).alias("y")), lambda p: F.when(p["x"]["currency"] == p["y"]["currency"], p["x"]["scale"] / p["y"]["scale"]))
    known = F.coalesce(lookup(UNIT_FACTORS, F.concat(a, F.lit("|"), b)), F.when(a == b, 1.0), pair)
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), known)


def units_comparable(a: Column, b: Column) -> Column:
    """Whether two declared units describe the same kind of quantity; a blank only with a blank."""
    x, y = F.trim(F.lower(F.coalesce(a, F.lit("")))), F.trim(F.lower(F.coalesce(b, F.lit(""))))
    return (x == y) | ((x != "") & (y != "") & unit_factor(x, y).isNotNull())


def column_unit(label: Column) -> Column:
    """The unit in a column name's trailing parentheses, or null."""
    return F.nullif(F.trim(F.regexp_extract(label, r"\(([^)]+)\)\s*$", 1)), F.lit(""))


def is_growth_unit(unit: Column) -> Column:
    return F.coalesce(unit.rlike(r"(?i)\byoy\b"), F.lit(False))


def delta(claimed: Column, computed: Column) -> Column:
    return F.round(F.abs(claimed - computed), 4)


def verdict(claimed: Column, computed: Column) -> Column:
    return F.when(delta(claimed, computed) <= TOLERANCE, "Entailed").otherwise("Refuted")


def stable_band(a: Column, b: Column) -> Column:
    """The largest move between two values that still counts as stable."""
    return F.greatest(F.lit(TOLERANCE), F.lit(STABLE_SHARE) * (F.abs(a) + F.abs(b)) / 2)
