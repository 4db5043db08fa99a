"""Long metric facts out of the wide statement tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv

FACT_KEY = ("stock_code", "stock_abbr", "report_period", "report_date", "source_file", "source_excerpt")


def table_facts(sheet: DataFrame, table: str, metrics=fv.METRICS) -> DataFrame:
    """Metric rows of one statement table; growth is paired from its own column.

    Columns the table lacks are skipped.  One scan: the metrics are inlined map-side.
    """
    have = set(sheet.columns)
    cells = [
        F.struct(
            F.lit(column).alias("metric_key"),
            F.lit(label).alias("metric_label"),
            F.col(column).cast("double").alias("metric_value"),
            (F.col(growth) if growth in have else F.lit(None)).cast("double").alias("yoy_value"),
        )
        for t, column, label, growth, _ in metrics
        if t == table and column in have
    ]
    key = [(F.col(c) if c in have else F.lit("")).alias(c) for c in FACT_KEY]
    return (
        sheet.select(*key, F.inline(F.array(*cells)))
        .filter(F.col("metric_value").isNotNull())
        .withColumn("table_name", F.lit(table))
    )


def metric_facts(sheets: dict[str, DataFrame], lineage: DataFrame | None = None, metrics=fv.METRICS) -> DataFrame:
    """Facts over all tables; the source is the field's own where lineage knows it."""
    known = {m[0] for m in metrics}
    parts = [table_facts(df, t, metrics) for t, df in sheets.items() if t in known]
    facts = reduce(DataFrame.unionByName, parts).withColumn("source_type", F.lit("structured"))
    if lineage is None:
        return facts
    chosen = lineage.filter(F.col("decision") == "chosen").select(
        "table_name", "stock_code", "report_period", F.col("field_name").alias("metric_key"),
        F.col("source_file").alias("_file"), F.col("source_excerpt").alias("_excerpt"),
    )
    own = lambda mine, row: F.coalesce(F.nullif(F.col(mine), F.lit("")), F.col(row)).alias(row)
    joined = facts.join(chosen, ["table_name", "stock_code", "report_period", "metric_key"], "left")
    rest = [c for c in facts.columns if c not in ("source_file", "source_excerpt")]
    return joined.select(*rest, own("_file", "source_file"), own("_excerpt", "source_excerpt"))
