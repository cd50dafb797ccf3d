"""Scaling, buckets and display numbers."""

from pyspark.sql import Column, functions as F

from .text import as_col, let


def clamp(c, low: float = 0.0, high: float = 1.0) -> Column:
    """Into [low, high]; a missing value counts as 0."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(as_col(c), F.lit(0.0))))


def log_scale(c, scale: float) -> Column:
    """log(1 + c) against log(1 + scale), at most 1; a missing value counts as 0."""
    c = F.coalesce(as_col(c), F.lit(0.0))
    return F.when(c <= 0, 0.0).otherwise(F.least(F.log1p(c) / F.log1p(F.lit(scale)), F.lit(1.0)))


def min_max(c, low, high) -> Column:
    c, low, high = as_col(c), as_col(low), as_col(high)
    return F.when(high == low, 1.0).otherwise((c - low) / (high - low))


def novelty_bucket(c) -> Column:
    c = as_col(c)
    return F.when(c >= 0.9, 0.0).when(c >= 0.7, 0.25).when(c >= 0.4, 0.5).otherwise(1.0)


def horizon_bucket(days) -> Column:
    days = as_col(days)
    return (
        F.when(days.isNull() | (days < 0), 0.0)
        .when(days <= 2, 0.2)
        .when(days <= 30, 1.0)
        .when(days <= 180, 0.9)
        .when(days <= 365, 0.6)
        .otherwise(0.3)
    )


def clarity(flags) -> Column:
    return clamp(1.0 - 0.2 * F.size(as_col(flags)))


def score_band(c) -> Column:
    c = as_col(c)
    return F.when(c >= 0.75, "high").when(c >= 0.55, "good").when(c >= 0.40, "fair").otherwise("low")


def days_bucket(days) -> Column:
    days = as_col(days)
    return (
        F.when(days.isNull(), "")
        .when(days < 0, "Expired")
        .when(days == 0, "Today")
        .otherwise(F.concat(days.cast("string"), F.lit("d left")))
    )


def days_level(days) -> Column:
    """How near a deadline is: urgent up to a week and once it has passed, soon up to 30 days, else ok; empty without one."""
    days = as_col(days)
    return F.when(days.isNull(), "").when(days <= 7, "urgent").when(days <= 30, "soon").otherwise("ok")


def score_text(c) -> Column:
    """0-100 whole number, half to even; null shows as a dash."""
    c = as_col(c)
    return F.when(c.isNull(), "-").otherwise(F.rint(c * 100).cast("int").cast("string"))


def percent_text(c) -> Column:
    c = as_col(c)
    return F.when(c.isNull(), "-").otherwise(F.concat(F.rint(c * 100).cast("int").cast("string"), F.lit("%")))


def summary_text(m, decimals: bool = True) -> Column:
    """`key=value` pairs of a map, empty values left out, joined by ` | `."""
    kept = F.filter(F.map_entries(as_col(m)), lambda e: e["value"].isNotNull() & ~e["value"].isin("", "[]", "{}"))

    def show(e):
        v = e["value"]
        if decimals:
            v = F.when(v.rlike(r"^-?\d+\.\d+$"), F.format_string("%.2f", v.try_cast("double"))).otherwise(v)
        return F.concat(e["key"], F.lit("="), v)

    text = F.array_join(F.transform(kept, show), " | ")
    return F.when(text == "", F.lit("no additional details" if decimals else "")).otherwise(text)


def fixed_text(c, digits: int = 2) -> Column:
    """A number with 1 to 3 decimals, rounded half to even on its exact binary value.

    The fraction is scaled by a power of two, which is exact, and rounded in whole numbers; `round`
    and `format_string` go by the shortest decimal form and differ on values such as 0.415.
    """
    scale, bits = 10**digits, {1: 58, 2: 56, 3: 53}[digits]
    half = 1 << (bits - 1)

    def show(x):
        size = F.abs(x)
        scaled = (size - F.floor(size)) * F.lit(float(1 << bits))
        tail = (scaled - F.floor(scaled)) * F.lit(float(scale))  # small values have bits below the scale
        n = F.floor(scaled) * F.lit(scale) + F.floor(tail)
        cut = tail != F.floor(tail)
        q, rest = F.shiftright(n, bits), n.bitwiseAND(F.lit((1 << bits) - 1))
        up = (rest > half) | ((rest == half) & (cut | (F.pmod(q, F.lit(2)) == 1)))
        total = F.floor(size) * scale + q + F.when(up, 1).otherwise(0)
        body = F.format_string(f"%d.%0{digits}d", F.floor(total / scale).cast("bigint"), F.pmod(total, F.lit(scale)))
        return F.concat(F.when(x < 0, "-").otherwise(""), body)

    return let(as_col(c).cast("double"), show)
