"""Rankings, with growth against the year before and the best grower."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import numbers as N
from ..functions.periods import previous_period
from .lookups import in_company_set, is_amount, metric_value


def _largest():
    return [F.col("metric_value").desc_nulls_last(), F.col("stock_code").asc()]


def _at(sheet: DataFrame, period: str, column: str) -> DataFrame:
    return sheet.filter(F.col("report_period") == period).select(
        "stock_code", "stock_abbr", "report_period", metric_value(column, sheet.columns).alias("metric_value")
    )


def _position(top: DataFrame) -> DataFrame:
    # ``top`` is already limited to k rows, so one task numbers k rows
    return top.withColumn("position", F.row_number().over(Window.orderBy(*_largest())))


def top_k(sheet: DataFrame, column: str, period: str, k: int) -> DataFrame:
    """Largest k; doubtful values are dropped after the limit, so fewer may remain."""
    top = _at(sheet, period, column).orderBy(*_largest()).limit(k)
    return _position(top.filter(~N.is_suspicious(F.col("metric_value"), F.lit(is_amount(column)))))


def with_growth(rows: DataFrame, sheet: DataFrame, column: str, name: str = "yoy", stored=None,
                cap: float = fv.MAX_DISPLAY_GROWTH) -> DataFrame:
    """Add ``name`` and ``name_status`` from the same company's row one year earlier."""
    before = (
        sheet.groupBy("stock_code", "report_period")
        .agg(F.max(metric_value(column, sheet.columns)).alias("_before"))
        .withColumnRenamed("report_period", "_previous")
    )
    out = rows.withColumn("_previous", previous_period(F.col("report_period"))).join(
        before, ["stock_code", "_previous"], "left"
    )
    now = F.col("_now") if "_now" in rows.columns else F.col("metric_value")
    kept = stored if stored is not None else F.lit(None).cast("double")
    value, status = N.display_growth(kept, now, F.col("_before"), F.col("report_period"), cap)
    return out.withColumn(name, value).withColumn(f"{name}_status", status).drop("_previous", "_before")


def _two_years(sheet: DataFrame, period: str, values: dict) -> DataFrame:
    """One row per company with each value now and a year before, from one pass over the table.

    (stock_code, report_period) is the key of a statement table, so the two periods can be
    folded with a conditional aggregate instead of a self join.
    """
    previous = f"{int(period[:4]) - 1}{period[4:]}"
    at = lambda p, c: F.max(F.when(F.col("report_period") == p, c))
    return (
        sheet.filter(F.col("report_period").isin(period, previous))
        .groupBy("stock_code")
        .agg(
            at(period, F.col("stock_abbr")).alias("stock_abbr"),
            *[at(period, c).alias(n) for n, c in values.items()],
            *[at(previous, c).alias(f"{n}_before") for n, c in values.items()],
        )
        .withColumn("report_period", F.lit(period))
    )


def _flag_best(top: DataFrame, growth: str) -> DataFrame:
    """Mark the best grower among at most k rows."""
    w = Window.orderBy(F.col(growth).desc_nulls_last(), *_largest())
    return top.withColumn("best_grower", (F.row_number().over(w) == 1) & F.col(growth).isNotNull())


def top_k_growth(sheet: DataFrame, column: str, period: str, k: int) -> DataFrame:
    """Largest k with growth for each and a flag on the best grower."""
    both = _two_years(sheet, period, {"metric_value": metric_value(column, sheet.columns)})
    top = both.orderBy(*_largest()).limit(k).filter(F.col("metric_value").isNotNull())
    value, status = N.display_growth(
        F.lit(None).cast("double"), F.col("metric_value"), F.col("metric_value_before"), F.col("report_period")
    )
    out = top.select(
        "stock_code", "stock_abbr", "report_period", "metric_value", value.alias("yoy"), status.alias("yoy_status")
    )
    return _position(_flag_best(out, "yoy"))


def profit_metric(income: DataFrame, period: str) -> DataFrame:
    """total_profit when at least two rows of the period carry a real value, else net_profit."""
    rows = income.filter(F.col("report_period") == period)
    real = F.count_if(F.abs("total_profit") >= 1) if "total_profit" in income.columns else F.lit(0)
    return rows.agg(F.when(real >= 2, "total_profit").otherwise("net_profit").alias("metric_key"))


def profit_top_k(income: DataFrame, year: str, k: int) -> DataFrame:
    """Profit ranking with profit growth and revenue growth; printed growth is used first."""
    period = f"{year}FY"
    have = income.columns
    col = lambda c: (F.col(c) if c in have else F.lit(None)).cast("double")
    both = _two_years(income, period, {
        "total": col("total_profit"),
        "net": col("net_profit"),
        "sales": metric_value("main_business_revenue", have),
        "total_yoy": F.coalesce(col("total_profit_yoy_growth"), col("net_profit_yoy_growth")),
        "net_yoy": col("net_profit_yoy_growth"),
        "sales_yoy": F.coalesce(col("main_business_revenue_yoy_growth"), col("operating_revenue_yoy_growth")),
    })
    # profit_metric is one row by construction
    chosen = both.crossJoin(F.broadcast(profit_metric(income, period)))
    pick = lambda a, b: F.when(F.col("metric_key") == "total_profit", F.col(a)).otherwise(F.col(b))
    top = (
        chosen.withColumn("metric_value", pick("total", "net"))
        .orderBy(*_largest())
        .limit(k)
        .filter(F.abs("metric_value") >= 1)
    )
    p, ps = N.display_growth(pick("total_yoy", "net_yoy"), F.col("metric_value"), pick("total_before", "net_before"), F.col("report_period"))
    s, ss = N.display_growth(F.col("sales_yoy"), F.col("sales"), F.col("sales_before"), F.col("report_period"))
    out = top.select(
        "stock_code", "stock_abbr", "report_period", "metric_key", "metric_value",
        p.alias("profit_yoy"), ps.alias("profit_yoy_status"), s.alias("sales_yoy"), ss.alias("sales_yoy_status"),
    )
    return _position(_flag_best(out, "profit_yoy"))


def set_extreme(sheet: DataFrame, column: str, period: str, members: DataFrame, kind: str = "max",
                by_growth: bool = False) -> DataFrame:
    """The member of a company set with the largest or smallest value, or growth."""
    rows = in_company_set(_at(sheet, period, column), members)
    if by_growth:
        rows = with_growth(rows, sheet, column)
    by = F.col("yoy" if by_growth else "metric_value")
    order = by.desc_nulls_last() if kind == "max" else by.asc_nulls_last()
    return rows.filter(by.isNotNull()).orderBy(order, "stock_code").limit(1)


def newest_reports(reports: DataFrame, per_company: int = 5, code: str = "stockCode") -> DataFrame:
    """Latest research reports per company (or overall when ``code`` is None)."""
    from ..functions.codes import publish_date
    from ..scale import top_per

    order = [F.col("publishDate").desc_nulls_last(), F.col("title").asc()]
    dated = lambda df: df.withColumn("publish_day", publish_date(F.col("publishDate")))
    if code is None:
        return dated(reports.orderBy(*order).limit(per_company))
    return dated(top_per(reports, [code], order, per_company, rank="position"))
