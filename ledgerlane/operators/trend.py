"""Trends of one metric per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.periods import period_key
from ..functions.text import compact_text
from ..scale import top_per
from .lookups import is_amount, metric_value


def clean_series(sheet: DataFrame, column: str) -> DataFrame:
    """stock_code, report_period, value: numeric values only, and no near-zero money."""
    out = sheet.select("stock_code", "report_period", metric_value(column, sheet.columns).alias("value"))
    out = out.filter(F.col("value").isNotNull())
    return out.filter(F.abs("value") >= 1) if is_amount(column) else out


def window_rule(question: Column, n_all: Column, n_annual: Column) -> Column:
    """struct(annual, keep) for the wording of a question: which periods and how many."""
    t = compact_text(question)
    recent = t.contains("近几年")
    use_all = (recent | t.contains("截至三季报") | t.contains("季度")) & (n_all >= 4)
    annual = ~use_all & (n_annual >= 3)
    three = t.contains("近三年") & (n_annual >= 3)
    keep = F.when(three, 3).when(use_all, 12).when(recent, 8).otherwise(6)
    return F.struct((three | annual).alias("annual"), keep.alias("keep"))


def trend_window(series: DataFrame, questions: DataFrame | None = None, question: str = "") -> DataFrame:
    """The periods a trend answer shows, newest last.

    ``questions`` (stock_code, question_id, question) asks per company; otherwise one wording
    applies to all.  Period counts come from a partially aggregated group-by; the window keeps
    at most 12 rows per key and is limited before its shuffle.
    """
    counts = series.groupBy("stock_code").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("report_period").endswith("FY")).alias("n_annual")
    )
    if questions is None:
        asked, keys = counts.withColumn("question", F.lit(question)), ["stock_code"]
    else:
        asked, keys = questions.join(counts, "stock_code"), ["stock_code", "question_id"]
    rule = asked.select(*keys, window_rule(F.col("question"), F.col("n_all"), F.col("n_annual")).alias("rule"))
    rows = series.join(rule, "stock_code").filter(~F.col("rule.annual") | F.col("report_period").endswith("FY"))
    newest = [period_key(F.col("report_period")).desc(), F.col("report_period").desc(), F.col("value").desc()]
    ranked = top_per(rows, keys, newest, 12, rank="back")
    return ranked.filter(F.col("back") <= F.col("rule.keep")).drop("rule")


def trend_shape(window: DataFrame, keys=("stock_code",)) -> DataFrame:
    """Pattern, low and high point, and recovery of a trend window (at most 12 rows per key)."""
    item = F.struct((-F.col("back")).alias("pos"), "report_period", "value")
    s = window.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("s"))
    s = s.select(
        *keys,
        F.transform("s", lambda x: x["report_period"]).alias("labels"),
        F.transform("s", lambda x: x["value"]).alias("v"),
    )
    n = F.size("v")
    low, high = F.array_position("v", F.array_min("v")).cast("int"), F.array_position("v", F.array_max("v")).cast("int")

    def steps(start, stop, test):
        """Whether every neighbouring pair from position start to stop passes."""
        pairs = F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>"))
        return F.forall(pairs, lambda i: test(F.element_at("v", i), F.element_at("v", i + 1)))

    up, down = (lambda a, b: a <= b), (lambda a, b: a >= b)
    first, last = F.element_at("v", 1), F.element_at("v", -1)
    one = F.lit(1)
    inner_low, inner_high = ~low.isin(1) & (low != n), ~high.isin(1) & (high != n)
    pattern = (
        F.when(n == 1, "single")
        .when((n >= 3) & inner_low & (first > F.array_min("v")) & (F.array_min("v") < last), "v_shape")
        .when((n >= 3) & inner_high & (first < F.array_max("v")) & (F.array_max("v") > last), "inverted_v")
        .when(steps(one, n, up), "rising")
        .when(steps(one, n, down), "falling")
        .otherwise("mixed")
    )
    mixed_periods = F.exists("labels", lambda p: ~p.endswith("FY"))
    told = mixed_periods & (low > 1)
    recovery = F.when(told & (low < n), F.when(steps(low, n, up), "steady").otherwise("uneven"))
    decline = F.when(told, F.when(steps(one, low, down), "steady").otherwise("uneven"))
    recent = F.slice("labels", F.greatest(n - 2, one), 3)
    one_year = F.size(F.array_distinct(F.transform(recent, lambda p: F.substring(p, 1, 4)))) == 1
    recent_move = F.when(
        (n >= 3) & one_year,
        F.when(steps(n - 2, n, up), "improving").when(steps(n - 2, n, down), "falling_back"),
    )
    start, end, newest = F.substring(F.element_at("labels", 1), 1, 4), F.substring(F.element_at("labels", -1), 1, 4), F.element_at("labels", -1)
    span = F.concat(start, F.lit("-"), end, F.lit("年"), F.when(newest.endswith("FY"), "").otherwise(F.concat(F.lit("（截至"), newest, F.lit("）"))))
    return s.select(
        *keys,
        n.alias("n_periods"),
        span.alias("span"),
        F.element_at("labels", 1).alias("first_period"),
        newest.alias("last_period"),
        F.element_at(recent, 1).alias("recent_start"),
        pattern.alias("pattern"),
        F.element_at("labels", low).alias("low_period"),
        F.array_min("v").alias("low_value"),
        F.element_at("labels", high).alias("high_period"),
        F.array_max("v").alias("high_value"),
        decline.alias("decline"),
        recovery.alias("recovery"),
        recent_move.alias("recent_move"),
    )


def trend_text(company: Column, label: Column, shown) -> Column:
    """Wording of a row of ``trend_shape`` about a metric called ``label``; ``shown`` turns a value into text."""
    c = F.col
    say = F.format_string

    def told(column, forms, *args):
        out = F.lit(None).cast("string")
        for code, form in forms:
            out = F.when(c(column) == code, say(form, *args)).otherwise(out)
        return out

    patterns = F.create_map(*[F.lit(x) for pair in fv.TREND_PATTERNS for x in pair])
    falls = c("decline").isNotNull()
    parts = F.concat_ws(
        "，",
        say(fv.TREND_HEAD, company, c("span"), label, F.try_element_at(patterns, c("pattern"))),
        F.when(~falls, say(fv.TREND_LOW_VALUE, c("low_period"), shown(c("low_value"))))
        .when(c("decline") == "steady", say(fv.TREND_DECLINE, c("first_period"), c("low_period"), c("low_period")))
        .otherwise(say(fv.TREND_LOW, c("low_period"))),
        F.when(~falls, say(fv.TREND_HIGH_VALUE, c("high_period"), shown(c("high_value"))))
        .otherwise(told("recovery", fv.TREND_RECOVERY, c("last_period"))),
        told("recent_move", fv.TREND_RECENT, c("recent_start"), c("last_period")),
    )
    single = say(fv.TREND_SINGLE, company, label, c("low_period"), shown(c("low_value")))
    return F.when(c("n_periods") == 1, single).otherwise(F.concat(parts, F.lit("。")))


def in_period_order(rows: DataFrame, periods) -> DataFrame:
    """Rows of the listed periods, in the listed order."""
    wanted = F.array(*[F.lit(p) for p in periods])
    place = F.array_position(wanted, F.col("report_period"))
    return rows.withColumn("period_position", place).filter(place > 0)
