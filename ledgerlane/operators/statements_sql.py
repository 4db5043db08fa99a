"""The statement behind an answer as text: a template per route, filled with the values a step is bound to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATES = {
    "scalar": "SELECT {metric} FROM {table} WHERE stock_code = {company} AND report_period = {asked}",
    "latest": "SELECT report_period, {metric} FROM {table} WHERE stock_code = {company} ORDER BY report_period DESC LIMIT 1",
    "trend": "SELECT report_period, {metric} FROM {table} WHERE stock_code = {company} ORDER BY report_period",
    "ranking": "SELECT stock_code, stock_abbr, report_period, {metric} AS metric_value FROM {table} WHERE report_period = {at} ORDER BY metric_value DESC LIMIT {k}",
    "ranking_growth": "SELECT stock_code, stock_abbr, {metric} AS metric_value FROM {table} WHERE report_period = {at} ORDER BY metric_value DESC LIMIT {k}",
    "threshold": "SELECT stock_code, stock_abbr, report_period, {metric} AS metric_value FROM {table} WHERE report_period = {at} AND {metric} {operator} {bound} ORDER BY metric_value DESC",
    "set_extreme": "SELECT stock_code, stock_abbr, {metric} AS metric_value FROM {table} WHERE report_period = {at} AND stock_code IN ({codes})",
    "company_profile": "SELECT {field} FROM company_info WHERE stock_code = {company}",
}


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.coalesce(value, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))


def statement_text(steps: DataFrame) -> Column:
    """Text of the statement of each step's route; empty where a route has none."""
    c, have = F.col, steps.columns
    codes = F.array_join(F.transform(c("_codes"), quoted), ", ") if "_codes" in have else F.lit("")
    values = {
        "{metric}": c("metric_key"), "{table}": c("metric.table_name"), "{company}": quoted(c("company")), "{asked}": quoted(c("asked_period")),
        "{at}": quoted(c("at")), "{k}": c("top_k").cast("string"), "{operator}": c("limit_asked.operator"), "{bound}": c("limit_asked.bound").cast("string"),
        "{field}": c("company_field.field_name"), "{codes}": codes,
    }

    def filled(template: str) -> Column:
        text = F.lit(template)
        for name, value in values.items():
            if name in template:
                text = F.replace(text, F.lit(name), F.coalesce(value, F.lit("")))
        return text

    out = F.lit("")
    for route, template in TEMPLATES.items():
        out = F.when(c("route") == route, filled(template)).otherwise(out)
    return out
