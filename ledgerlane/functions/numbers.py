"""Number columns: parsing, money, ratios and growth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import SPACE


def to_float(c: Column) -> Column:
    """Text to double: commas dropped, one ``%``, then 亿, 万 or 元.  Bad text gives NULL."""
    t = F.replace(
        F.regexp_replace(c.cast("string"), f"^{SPACE}+|{SPACE}+$", ""), F.lit(","), F.lit("")
    )
    t = F.regexp_replace(t, "%$", "")
    scale = F.when(t.endswith("亿"), 1e8).when(t.endswith("万"), 1e4).otherwise(1.0)
    digits = F.regexp_replace(t, "[亿万元]$", "")
    plain = digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(plain, digits.try_cast("double") * scale)


def plain_number(token: Column) -> Column:
    """``to_float`` for tokens made of digits, commas, sign and percent only."""
    digits = F.translate(token, ",%", "")
    return F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), digits.try_cast("double"))


def money_to_10k(c: Column) -> Column:
    return F.when(F.abs(c) <= fv.MAX_RAW_AMOUNT, c / 10000.0)


def format_money(c: Column) -> Column:
    return (
        F.when(c.isNull(), F.lit(fv.UNKNOWN_TEXT))
        .when(F.abs(c) >= 10000, F.concat(F.format_string("%.2f", c / 10000), F.lit("亿元")))
        .otherwise(F.concat(F.format_number(c, 2), F.lit("万元")))
    )


def format_metric(c: Column, is_eps: Column) -> Column:
    return (
        F.when(c.isNull(), F.lit(fv.UNKNOWN_TEXT))
        .when(is_eps, F.format_string("%.4f", c))
        .otherwise(format_money(c))
    )


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", c)


def abs_ratio(a: Column, b: Column) -> Column:
    """Larger over smaller absolute value; 1 when both are zero or missing, NULL when one is."""
    x, y = F.coalesce(F.abs(a), F.lit(0.0)), F.coalesce(F.abs(b), F.lit(0.0))
    return F.when((x == 0) & (y == 0), F.lit(1.0)).otherwise(
        F.when((x != 0) & (y != 0), F.greatest(x, y) / F.least(x, y))
    )


def scale_gap(a: Column, b: Column, factor) -> Column:
    return F.coalesce(abs_ratio(a, b) >= factor, F.lit(False))


def change_multiple(current: Column, previous: Column) -> Column:
    return F.when(previous != 0, F.abs(current) / F.abs(previous))


def growth(current: Column, previous: Column) -> Column:
    """Percent growth; NULL when a side is missing, the base is zero or the signs differ."""
    return F.when(
        (previous != 0) & (current * previous >= 0),
        (current - previous) / F.abs(previous) * 100.0,
    )


def display_growth(stored: Column, current: Column, previous: Column, period: Column,
                   cap: float = fv.MAX_DISPLAY_GROWTH) -> tuple[Column, Column]:
    """Growth shown next to a value and its status: stored, computed, unknown or not_applicable."""
    computed = growth(current, previous)
    use_stored = F.coalesce(F.abs(stored) <= cap, F.lit(False))
    annual = period.endswith("FY")
    has_both = current.isNotNull() & previous.isNotNull()
    value = F.when(use_stored, stored).when(annual & (F.abs(computed) <= cap), computed)
    status = (
        F.when(use_stored, F.lit("stored"))
        .when(~annual | ~has_both, F.lit("unknown"))
        .when(computed.isNull(), F.lit("not_applicable"))
        .when(F.abs(computed) <= cap, F.lit("computed"))
        .otherwise(F.lit("unknown"))
    )
    return value, status


def annual_growth(current: Column, previous: Column, printed: Column,
                  cap: float = fv.MAX_DISPLAY_GROWTH) -> Column:
    """Printed growth when it agrees with the row, else the growth the row implies."""
    computed = (current - previous) / F.abs(previous) * 100.0
    near = (F.abs(printed) <= cap) & (F.abs(printed - computed) <= F.greatest(F.lit(1.0), F.abs(computed) * 0.25))
    in_cap = F.when(F.abs(computed) <= cap, computed)
    return (
        F.when(current.isNull() | previous.isNull(), F.when(F.abs(printed) <= cap, printed))
        .when(previous == 0, F.lit(None).cast("double"))
        .when(current * previous > 0, F.when(near, printed).otherwise(in_cap))
        .when(current == 0, in_cap)
    )


def field_class(field: Column) -> Column:
    """percent, eps or amount, from the field name."""
    return (
        F.when(field.isin(*fv.RATIO_COLUMNS) | field.endswith("_growth") | field.endswith("_ratio"), "percent")
        .when(field.isin(*fv.EPS_COLUMNS), "eps")
        .otherwise("amount")
    )


def sanitize_field(field: Column, value: Column) -> Column:
    """NULL for values outside the limits of their field."""
    limits = F.create_map(*[F.lit(x) for kv in fv.AMOUNT_LIMITS.items() for x in kv])
    kind = field_class(field)
    bad_percent = (
        ((field == "asset_liability_ratio") & ~value.between(0.0, 100.0))
        | (field.isin("roe", "roe_weighted_excl_non_recurring") & (F.abs(value) > fv.MAX_ABS_ROE))
        | (F.abs(value) > fv.MAX_ABS_RATIO)
    )
    bad_amount = F.coalesce(F.abs(value) > F.try_element_at(limits, field), F.lit(False)) | (
        field.isin(*fv.NON_NEGATIVE_COLUMNS) & (value < 0)
    )
    bad = (
        F.when(kind == "percent", bad_percent)
        .when(kind == "eps", F.abs(value) > fv.MAX_ABS_EPS)
        .otherwise(bad_amount)
    )
    return F.when(~bad, value)


def values_conflict(a: Column, b: Column) -> Column:
    gap = F.greatest(F.lit(1.0), F.abs(a) * 0.05, F.abs(b) * 0.05)
    return F.coalesce(F.abs(a - b) > gap, F.lit(False))


def is_suspicious(value: Column, is_amount: Column) -> Column:
    return value.isNull() | (is_amount & (F.abs(value) < 1))
