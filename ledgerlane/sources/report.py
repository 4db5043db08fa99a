"""The validation report: one table per section and a one-row summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import quality as Q
from ..operators.companies import missing_in_master
from ..operators.facts import metric_facts


def _over(sheets, make) -> DataFrame:
    parts = [make(df, t).withColumn("table_name", F.lit(t)) for t, df in sheets.items()]
    return reduce(DataFrame.unionByName, parts)


def validation_report(sheets: dict[str, DataFrame], master: DataFrame, aliases: DataFrame | None = None,
                      lineage: DataFrame | None = None) -> dict[str, DataFrame]:
    """Sections by name; every section is a DataFrame."""
    judged = Q.judge_all(sheets)
    issues = Q.cell_issues(judged)
    clean = Q.sanitize(judged)
    named = _over(sheets, lambda df, t: df.select("stock_code", "stock_abbr"))
    facts = metric_facts(clean, lineage)
    sections = {
        "duplicate_keys": _over(sheets, lambda df, t: Q.duplicate_keys(df)),
        "invalid_periods": _over(sheets, lambda df, t: Q.invalid_periods(df)),
        "key_fields": _over(sheets, lambda df, t: Q.missing_keys(df)),
        "critical_field_missing": _over(clean, lambda df, t: Q.critical_missing(df, t, fv.CRITICAL_FIELDS.get(t, ()))),
        "suspicious_values": issues,
        "encoding_issues": Q.damaged_labels(facts),
        "coverage_by_table": _over(clean, lambda df, t: Q.coverage(df, t, fv.CRITICAL_FIELDS.get(t, ()))),
        "stock_code_alignment": missing_in_master(named, master, aliases),
        "suspicious_values_by_column": Q.issues_by_column(issues),
        "sanitized_rows_by_table": Q.sanitized_rows(issues),
        "top_risky_companies": Q.risky_companies(issues),
    }
    if lineage is not None:
        found = Q.lineage_conflicts(lineage)
        sections["lineage_conflicts"] = found
        sections["conflicted_fields_by_table"] = Q.conflicts_by_field(found)
    return sections


def summary(sections: dict[str, DataFrame]) -> DataFrame:
    """Row count per section."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("section"), "n") for k, df in sections.items()]
    return reduce(DataFrame.unionByName, counts)


def write_report(sections: dict[str, DataFrame], folder: str) -> None:
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
    summary(sections).write.mode("overwrite").json(f"{folder.rstrip('/')}/summary")
