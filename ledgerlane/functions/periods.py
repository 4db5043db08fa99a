"""Report periods: ``20YY`` plus FY, HY or Q1-Q4."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import compact_text, contains_any

CODE = "(20[0-9]{2})(FY|HY|Q1|Q2|Q3|Q4)"


def normalize_period(c: Column) -> Column:
    """The code in a period text; most are codes already and are not searched again."""
    raw = F.upper(compact_text(c))
    worded = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), fv.PERIOD_WORDS, raw)
    code = F.regexp_extract(worded, CODE, 0)
    return F.when(c.cast("string").rlike(f"^{CODE}\\z"), c.cast("string")).when(code != "", code).otherwise(raw)


def is_valid_period(c: Column) -> Column:
    return normalize_period(c).rlike("^20[0-9]{2}(FY|Q1|Q2|Q3|HY)$")


def period_suffix(c: Column) -> Column:
    return F.regexp_extract(normalize_period(c), f"^{CODE}$", 2)


def previous_period(code: Column) -> Column:
    """Same period one year earlier, for an already normalised code; NULL otherwise."""
    year = F.regexp_extract(code, f"^{CODE}$", 1)
    return F.when(year != "", F.concat((year.try_cast("int") - 1).cast("string"), F.substring(code, 5, 2)))


def period_year(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, "(20[0-9]{2})", 1).try_cast("int"), F.lit(0))


def period_rank(c: Column) -> Column:
    ranked = reduce(
        lambda acc, kv: acc.when(c.contains(kv[0]), kv[1]),
        fv.PERIOD_RANK[1:],
        F.when(c.contains(fv.PERIOD_RANK[0][0]), fv.PERIOD_RANK[0][1]),
    )
    return F.coalesce(ranked, F.lit(0))


def period_key(c: Column) -> Column:
    """Calendar sort key: (year, order inside the year)."""
    return F.struct(period_year(c).alias("year"), period_rank(c).alias("ord"))


def question_period(question: Column, context_year=None, context_period=None) -> Column:
    """Period asked for, as struct(year, report_period, label); NULL when no year is known.

    ``context_year`` and ``context_period`` (same struct) stand in when the text has no year.
    """
    t = compact_text(question)
    found = F.regexp_extract(t, "(20[0-9]{2})年", 1)
    year = F.when(found != "", found)
    if context_year is not None:
        year = F.coalesce(year, context_year)
    code, label = F.lit("FY"), F.lit("年度")
    for c, word, flags in reversed(fv.QUESTION_PERIODS):
        hit = contains_any(t, flags)
        code, label = F.when(hit, c).otherwise(code), F.when(hit, word).otherwise(label)
    asked = F.struct(
        year.alias("year"),
        F.concat(year, code).alias("report_period"),
        F.concat(year, F.lit("年"), label).alias("label"),
    )
    out = F.when(year.isNotNull(), asked)
    return F.coalesce(out, context_period) if context_period is not None else out


def title_period(title: Column, text: Column) -> Column:
    """Period of a report from its title and the start of its text; '' when none is named."""
    head = compact_text(F.substring(text, 1, 800))
    probe = F.concat(compact_text(title), F.substring(head, 1, 200))
    year = F.regexp_extract(probe, "(20[0-9]{2})年", 1)
    code = F.lit("")
    for c, words in reversed(fv.TITLE_PERIODS):
        code = F.when(contains_any(probe, words), c).otherwise(code)
    return F.when((year != "") & (code != ""), F.concat(year, code)).otherwise("")


def allowed_periods(code: Column) -> Column:
    """Periods a report may fill: its own, and the interim ones of the year for an annual report."""
    year = F.substring(code, 1, 4)
    interim = F.transform(F.array(F.lit("Q1"), F.lit("HY"), F.lit("Q3")), lambda s: F.concat(year, s))
    return F.when(code.rlike("^[0-9]{4}.*FY$"), F.concat(F.array(code), interim)).otherwise(F.array(code))
