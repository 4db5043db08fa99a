"""Point lookups, threshold filters and other selections over statement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import numbers as N
from ..functions.periods import period_key
from ..functions.text import compact_text, contains_any
from ..scale import top_per
from .rank_directory import RankDirectory

FALLBACKS = {
    "main_business_revenue": "total_operating_revenue",
    "main_business_revenue_yoy_growth": "operating_revenue_yoy_growth",
}


def metric_value(column: str, have) -> Column:
    """The metric, with the revenue fallback; NULL when the table lacks it."""
    parts = [c for c in (column, FALLBACKS.get(column)) if c and c in have]
    return F.coalesce(*[F.col(c) for c in parts]).cast("double") if parts else F.lit(None).cast("double")


def is_amount(column: str) -> bool:
    """Money metrics: neither per-share nor percent."""
    return not (column in fv.EPS_COLUMNS or column in fv.RATIO_COLUMNS or column.endswith(("_growth", "_ratio")))


def is_percentage(label: Column, column: Column) -> Column:
    return contains_any(label, fv.PERCENT_LABEL_WORDS) | column.endswith("_ratio") | column.endswith("_growth")


def scalar_batch(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Value for each (stock_code, report_period, metric_key) asked for; NULL when absent."""
    values = facts.groupBy("stock_code", "report_period", "metric_key").agg(
        F.max("metric_value").alias("metric_value")
    )
    out = requests.join(values, ["stock_code", "report_period", "metric_key"], "left")
    doubtful = F.col("metric_value").isNull() | (
        ~F.col("metric_key").isin(*fv.EPS_COLUMNS, *fv.RATIO_COLUMNS) & (F.abs("metric_value") < 1)
    )
    return out.withColumn("suspicious", doubtful)


def latest_value(sheet: DataFrame, column: str, order: str = "text") -> DataFrame:
    """Latest period and its value per company.

    ``text`` sorts periods as strings (Q3 after HY after FY); ``calendar`` by year end.
    """
    value = metric_value(column, sheet.columns)
    by = F.col("report_period") if order == "text" else period_key(F.col("report_period"))
    best = F.max_by(F.struct("report_period", value.alias("metric_value")), by)
    return sheet.groupBy("stock_code").agg(best.alias("b")).select("stock_code", "b.report_period", "b.metric_value")


def company_attributes(requests: DataFrame, companies: DataFrame, fields=None) -> DataFrame:
    """Attribute named by ``field_name`` for each requested company."""
    fields = fields or [c for c in dict.fromkeys(f[1] for f in fv.COMPANY_FIELDS) if c in companies.columns]
    pairs = F.create_map(*[x for c in fields for x in (F.lit(c), F.col(c).cast("string"))])
    dim = companies.select("stock_code", pairs.alias("_attributes"))
    return requests.join(dim, "stock_code", "left").select(
        *requests.columns, F.try_element_at("_attributes", F.col("field_name")).alias("field_value")
    )


def compare(value: Column, operator: Column, bound: Column) -> Column:
    return (
        F.when(operator == ">=", value >= bound)
        .when(operator == "<=", value <= bound)
        .when(operator == ">", value > bound)
        .when(operator == "<", value < bound)
    )


def threshold(question: Column, column: Column, label: Column, forms=fv.THRESHOLD_FORMS,
              negative="负数", positive="正数") -> Column:
    """struct(operator, bound) asked for in the text; NULL when none is.

    Negated wording is read before the plain one it contains.  A unit converts money to 10k.
    """
    t = F.regexp_replace(compact_text(question), "％", "%")
    out = F.lit(None).cast("struct<operator:string,bound:double>")
    for op, words in reversed(forms):
        pattern = rf"(?:{words})([-+]?[0-9]+(?:\.[0-9]+)?)(亿|万|%|元)?"
        number, unit = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
        raw = N.to_float(F.concat(number, unit))
        scaled = (unit != "") & ~is_percentage(label, column) & ~column.isin(*fv.EPS_COLUMNS)
        bound = F.when(scaled, raw / 10000.0).otherwise(raw)
        hit = F.struct(F.lit(op).alias("operator"), bound.alias("bound"))
        out = F.when(number != "", hit).otherwise(out)
    zero = lambda op: F.struct(F.lit(op).alias("operator"), F.lit(0.0).alias("bound"))
    return F.when(t.contains(negative), zero("<")).when(t.contains(positive), zero(">")).otherwise(out)


def threshold_filter(sheet: DataFrame, column: str, period: str, operator: str, bound: float, limit: int | None = None) -> DataFrame:
    """Companies meeting a bound at a period, largest first; all of them, or the first ``limit``."""
    value = metric_value(column, sheet.columns)
    out = (
        sheet.filter(F.col("report_period") == period)
        .select("stock_code", "stock_abbr", "report_period", value.alias("metric_value"))
        .filter(compare(F.col("metric_value"), F.lit(operator), F.lit(float(bound))))
        .orderBy(F.col("metric_value").desc_nulls_last(), "stock_code")
    )
    return out.limit(limit) if limit is not None else out


def threshold_requests(requests: DataFrame, facts: DataFrame, limit: int | None = None) -> DataFrame:
    """The same for a table of requests (request_id, metric_key, report_period, operator, bound), read off a rank directory."""
    return RankDirectory(requests, facts).listed(limit)


def in_company_set(sheet: DataFrame, members: DataFrame) -> DataFrame:
    return sheet.join(members.select("stock_code").distinct(), "stock_code", "left_semi")


def period_matches(period: Column, asked: Column, year: Column) -> Column:
    """Same period, or any period of the same year."""
    return (period == asked) | period.startswith(year)


def latest_fy(sheet: DataFrame, default: str = "2024FY") -> DataFrame:
    """Latest annual period of the table, as a one-row frame."""
    newest = F.max(F.when(F.col("report_period").endswith("FY"), F.col("report_period")))
    return sheet.agg(F.coalesce(newest, F.lit(default)).alias("report_period"))


def available_periods(sheet: DataFrame) -> DataFrame:
    """Distinct periods per company, and how many."""
    return (
        sheet.filter(F.col("report_period") != "").select("stock_code", "report_period").distinct()
        .groupBy("stock_code")
        .agg(F.array_sort(F.collect_list("report_period")).alias("periods"), F.count(F.lit(1)).alias("n_periods"))
    )


def product_list(products: DataFrame, year: str | None = None, categories=fv.HERBAL_WORDS) -> DataFrame:
    """Distinct product names of a year (default: the latest) in the given categories."""
    if year is None:
        newest = products.filter(F.col("year") != "").agg(F.max("year").alias("year"))
        chosen = products.join(F.broadcast(newest), "year")
    else:
        chosen = products.filter(F.col("year") == year)
    name = F.trim("product_name")
    return (
        chosen.filter((name != "") & contains_any(F.col("drug_category"), categories))
        .groupBy("year", name.alias("product_name"))
        .agg(F.min("source_path").alias("source_path"))
        .orderBy("year", "product_name")
    )


def metric_status(sheets: dict[str, DataFrame], metrics=fv.METRICS) -> DataFrame:
    """For each catalog metric: available, column_missing or table_empty."""
    spark = next(iter(sheets.values())).sparkSession
    rows = [(t, c, label, t in sheets and c in sheets[t].columns) for t, c, label, _, _ in metrics]
    catalog = spark.createDataFrame(rows, "table_name string, metric_key string, metric_label string, has_column boolean")
    filled = None
    for t, df in sheets.items():
        one = df.select(F.lit(t).alias("table_name")).limit(1)
        filled = one if filled is None else filled.unionByName(one)
    return catalog.join(filled.withColumn("filled", F.lit(True)), "table_name", "left").select(
        "table_name", "metric_key", "metric_label",
        F.when(~F.col("has_column"), "column_missing")
        .when(F.col("filled").isNull(), "table_empty")
        .otherwise("available")
        .alias("status"),
    )
