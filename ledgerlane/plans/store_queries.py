"""Queries on tables that are written, replaced in part and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import resolution as RES
from ..session import shared_folder
from ..sources import stores as ST
from ..sources import tables as TB
from .driver_tables import supplier_statements
from .registry import query
from .statement_queries import EVENTS, HELD, LAST, _candidates, sup

LOADED = "2024-05-01T00:00:00"


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


@query("stored_statements", sup("""
kept AS (SELECT stock_code, report_period, substr(report_period, 1, 4) AS year, net_profit FROM stmt),
now AS (SELECT stock_code, report_period, year, net_profit FROM kept WHERE year NOT IN ('2020', '2021') UNION ALL
  SELECT stock_code, report_period, year, net_profit * 2 FROM kept WHERE year = '2020' AND stock_code NOT LIKE '%7')""") + """
SELECT row_number() OVER (ORDER BY stock_code, year, CASE substr(report_period, 5) WHEN 'Q1' THEN 1 WHEN 'HY' THEN 2 WHEN 'Q3' THEN 3 ELSE 5 END) AS serial_number,
  stock_code, report_period, net_profit, CAST(NULL AS DOUBLE) AS total_profit FROM now""")
def stored_statements(spark, d):
    """A whole load, then a load of 2020 with other values and fewer rows, then one of 2021 with none."""
    at, schema = _folder(spark), TB.statement_schema("income_sheet", [("net_profit", "decimal(18,2)")])
    rows = supplier_statements(spark, d, metrics=("net_profit",))
    ST.write_statements(rows, schema, at, "income_sheet")
    again = rows.filter(~F.col("stock_code").endswith("7")).withColumn("net_profit", F.col("net_profit") * 2)
    ST.write_statements(again, schema, at, "income_sheet", years=[2020])
    ST.write_statements(rows.limit(0), schema, at, "income_sheet", years=[2021])
    return ST.read_statements(spark, at, schema, "income_sheet").select("serial_number", "stock_code", "report_period", "net_profit", "total_profit")


@query("stored_lineage", "WITH " + EVENTS + f""",
won AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY stock_code, field_name {LAST}) = 1),
""" + HELD.replace("q AS (SELECT *,", "q AS (SELECT *, source_file AS file,") + f""",
l AS (SELECT *, last_value(CASE WHEN taken THEN file END IGNORE NULLS) OVER (PARTITION BY stock_code, field_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_file FROM h),
rows AS (
SELECT stock_code, field_name, 'chosen' AS decision, v AS field_value, source_file, priority AS source_priority,
  CAST(NULL AS DOUBLE) AS candidate_value, '' AS candidate_source_file, '' AS candidate_source_excerpt, CAST(NULL AS INTEGER) AS candidate_priority FROM won WHERE v IS NOT NULL
UNION ALL
SELECT stock_code, field_name, CASE WHEN taken THEN 'replace_existing' ELSE 'keep_existing' END, CASE WHEN taken THEN v ELSE held END,
  CASE WHEN taken THEN file ELSE held_file END, CASE WHEN taken THEN priority ELSE best END, CASE WHEN taken THEN held ELSE v END,
  CASE WHEN taken THEN held_file ELSE file END, 'e', CASE WHEN taken THEN best ELSE priority END
FROM l WHERE abs(held - v) > greatest(1.0, abs(held) * 0.05, abs(v) * 0.05))
SELECT t.table_name, stock_code, '2024FY' AS report_period, field_name, field_value, source_file, 'e' AS source_excerpt, source_priority, 'e' AS extractor_stage,
  '{LOADED}' AS updated_at, decision, candidate_value, candidate_source_file, candidate_source_excerpt, candidate_priority, candidate_source_excerpt AS candidate_extractor_stage
FROM rows CROSS JOIN (VALUES ('events'), ('archive')) t(table_name) WHERE t.table_name = 'events' OR field_name IN ('error', 'click')""")
def stored_lineage(spark, d):
    """Lineage of two tables, of which the second is then replaced by that of fewer fields."""
    at, cand = _folder(spark), _candidates(spark, d, lambda k: F.lit("last"))
    fields = ("signup", "purchase", "error", "view", "click")
    rows = RES.lineage(RES.resolve_fields(cand, mixed=False), RES.conflicts(cand, mixed=False), fields, F.lit(LOADED))
    archive = rows.withColumn("table_name", F.lit("archive"))
    ST.write_lineage(rows.unionByName(archive), at, ["events", "archive"])
    kept = ST.read_parts(spark, at, rows.schema, ["archive"]).filter(F.col("field_name").isin("error", "click"))
    ST.write_lineage(kept, at, ["archive"])  # a load may read what it replaces
    return ST.read_parts(spark, at, rows.schema, ["events", "archive"])
