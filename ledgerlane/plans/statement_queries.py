"""Queries on statement tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import companies as C
from ..operators import facts as FA
from ..operators import lookups as L
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import resolution as RES
from ..operators import trend as TR
from ..sources import report as REP
from ..sources import tables as TB
from . import sql as S
from .driver_tables import customer_sheets, money, read, supplier_statements
from .registry import query

REVENUE = "total_operating_revenue"


def sup(*ctes: str) -> str:
    return "WITH " + ",".join([S.SUPPLIER, *ctes])


def cus(*ctes: str) -> str:
    return "WITH " + ",".join([S.CUSTOMER, *ctes])


@query("topk_growth", sup(f"""
b AS (SELECT a.stock_code, a.stock_abbr, a.report_period, a.{REVENUE} AS metric_value, z.{REVENUE} AS was
      FROM stmt a LEFT JOIN stmt z ON z.stock_code = a.stock_code AND z.report_period = '2019FY'
      WHERE a.report_period = '2020FY' ORDER BY 4 DESC NULLS LAST, 1 LIMIT 5),
g AS (SELECT *, {S.growth('metric_value', 'was')} AS yoy FROM b)""") + """
SELECT CAST(row_number() OVER (ORDER BY metric_value DESC, stock_code) AS INTEGER) AS position, stock_code, stock_abbr, report_period,
       metric_value, yoy, row_number() OVER (ORDER BY yoy DESC NULLS LAST, metric_value DESC) = 1 AS best_grower FROM g""")
def topk_growth(spark, d):
    stmt = supplier_statements(spark, d, (2019, 2020), (REVENUE,))
    return R.top_k_growth(stmt, REVENUE, "2020FY", 5).drop("yoy_status")


@query("topk_metric", sup() + """
SELECT CAST(row_number() OVER (ORDER BY net_profit DESC, stock_code) AS INTEGER) AS position, stock_code, stock_abbr, report_period, net_profit AS metric_value
FROM (SELECT * FROM stmt WHERE report_period = '2020Q3' ORDER BY net_profit DESC, stock_code LIMIT 20) WHERE abs(net_profit) >= 1""")
def topk_metric(spark, d):
    return R.top_k(supplier_statements(spark, d, (2020,), ("net_profit",)), "net_profit", "2020Q3", 20)


@query("profit_topk", cus(f"""
t AS (SELECT a.stock_code, a.stock_abbr, a.report_period, a.total_profit AS metric_value, z.total_profit AS was
      FROM cust a LEFT JOIN cust z ON z.stock_code = a.stock_code AND z.report_period = '2019FY'
      WHERE a.report_period = '2020FY' ORDER BY 4 DESC NULLS LAST, 1 LIMIT 10),
g AS (SELECT *, {S.growth('metric_value', 'was')} AS y FROM t),
h AS (SELECT *, CASE WHEN abs(y) <= 500 THEN y END AS profit_yoy FROM g)""") + """
SELECT CAST(row_number() OVER (ORDER BY metric_value DESC, stock_code) AS INTEGER) AS position, stock_code, stock_abbr, report_period,
  'total_profit' AS metric_key, metric_value, profit_yoy, CAST(35.0 AS DOUBLE) AS sales_yoy,
  CASE WHEN was IS NULL THEN 'unknown' WHEN y IS NULL THEN 'not_applicable' WHEN profit_yoy IS NULL THEN 'unknown' ELSE 'computed' END AS profit_yoy_status,
  profit_yoy IS NOT NULL AND row_number() OVER (ORDER BY profit_yoy DESC NULLS LAST, metric_value DESC) = 1 AS best_grower FROM h""")
def profit_topk(spark, d):
    return R.profit_top_k(customer_sheets(spark, d, (2019, 2020))["income_sheet"], "2020", 10).drop("sales_yoy_status")


@query("metric_facts", cus() + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, stock_code, report_period, '{m}' AS metric_key, '{label}' AS metric_label, {m} AS metric_value, "
    f"{g if g in S.SHEET_COLUMNS[t] else 'CAST(NULL AS DOUBLE)'} AS yoy_value FROM cust WHERE {m} IS NOT NULL"
    for t, m, label, g, _ in fv.METRICS if m in S.SHEET_COLUMNS[t]
))
def metric_facts(spark, d):
    return FA.metric_facts(customer_sheets(spark, d)).select(
        "table_name", "stock_code", "report_period", "metric_key", "metric_label", "metric_value", "yoy_value"
    )


@query("quarter_cumulative", """
WITH w AS (SELECT l_suppkey AS company, year(l_shipdate) AS year, quarter(l_shipdate) AS quarter, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS v
           FROM lineitem GROUP BY 1, 2, 3)
SELECT company, CAST(year AS INTEGER) AS year, CAST(quarter AS INTEGER) AS quarter, CAST(v AS DOUBLE) AS value,
  CAST(SUM(v) OVER (PARTITION BY company, year ORDER BY quarter ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS to_date FROM w""")
def quarter_cumulative(spark, d):
    q = read(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter")
    ).agg(F.sum(money("l_extendedprice")).alias("v"))
    out = RES.cumulative_quarters(q, ["company", "year"], "quarter", "v", "to_date")
    return out.select("company", "year", "quarter", F.col("v").cast("double").alias("value"), F.col("to_date").cast("double").alias("to_date"))


def _series_and_claims(spark, d):
    """Net profit by quarter as a series of document 2, and annual claims before and after it by supplier: a fourth of them each contradicted before,
    contradicted after, contradicted by a claim of lower rank, and without claim."""
    stmt = supplier_statements(spark, d, metrics=("net_profit",)).filter("net_profit is not null")
    base = stmt.select(F.lit("income_sheet").alias("table_name"), "stock_code", "report_period", F.lit("net_profit").alias("field_name"),
                       F.substring("report_period", 1, 4).alias("year"), F.col("net_profit").alias("value"))
    series = base.select("*", F.lit(2).alias("doc"), F.lit(21).alias("seq"), F.lit(0).alias("priority"), F.lit("quarters").alias("source_file"), F.lit("table").alias("source_excerpt"))
    claim = lambda seq, priority, times, name: F.struct(
        F.lit(seq).alias("seq"), F.lit(priority).alias("priority"), F.lit(float(times)).alias("times"), F.lit(name).alias("source_file"))
    kind = F.col("stock_code").cast("int") % 4
    claims = F.when(kind == 0, F.array(claim(10, 5, 3, "annual"))).when(kind == 1, F.array(claim(30, 9, 3, "revised"))) \
        .when(kind == 2, F.array(claim(10, 5, 1, "annual"), claim(12, 1, 3, "summary"))).otherwise(F.array().cast("array<struct<seq:int,priority:int,times:double,source_file:string>>"))
    candidates = base.filter(F.col("report_period").endswith("FY")).select("*", F.explode(claims).alias("c")).select(
        "table_name", "stock_code", "report_period", "field_name", (F.col("value") * F.col("c.times")).alias("value"), "c.seq", "c.priority", "c.source_file",
        F.lit("line").alias("source_excerpt"))
    return series, candidates


CONTRADICTED = "CAST(stock_code AS INTEGER) % 4 = 0 AND net_profit <> 0"


@query("series_veto", sup() + f"""
SELECT stock_code, report_period, net_profit AS value FROM stmt t WHERE net_profit IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM stmt z WHERE z.stock_code = t.stock_code AND left(z.report_period, 4) = left(t.report_period, 4) AND z.report_period LIKE '%FY' AND {CONTRADICTED})""")
def series_veto(spark, d):
    return RES.veto_series(*_series_and_claims(spark, d)).select("stock_code", "report_period", "value")


@query("series_conflicts", sup() + f"""
SELECT stock_code, report_period, CAST(21 AS INTEGER) AS seq, 'keep_existing' AS decision, net_profit * 3 AS existing_value, net_profit AS candidate_value,
  CAST(5 AS INTEGER) AS existing_priority, CAST(0 AS INTEGER) AS candidate_priority, 'annual' AS existing_source_file, 'quarters' AS candidate_source_file
FROM stmt WHERE report_period LIKE '%FY' AND {CONTRADICTED}""")
def series_conflicts(spark, d):
    return RES.series_conflicts(*_series_and_claims(spark, d)).drop("table_name", "field_name", "existing_source_excerpt", "candidate_source_excerpt")


@query("scalar_batch", sup() + """
SELECT s.stock_code, s.report_period, 'net_profit' AS metric_key, t.net_profit AS metric_value,
       t.net_profit IS NULL OR abs(t.net_profit) < 1 AS suspicious
FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, p AS report_period
      FROM supplier, (VALUES ('2020FY'), ('2018HY'), ('2035FY')) x(p)) s
LEFT JOIN stmt t ON t.stock_code = s.stock_code AND t.report_period = s.report_period""")
def scalar_batch(spark, d):
    asked = F.explode(F.array(*[F.lit(p) for p in ("2020FY", "2018HY", "2035FY")]))
    requests = read(spark, d, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock_code"), asked.alias("report_period"),
        F.lit("net_profit").alias("metric_key"),
    )
    stmt = supplier_statements(spark, d, metrics=("net_profit",))
    return L.scalar_batch(requests, FA.table_facts(stmt, "income_sheet")).select(
        "stock_code", "report_period", "metric_key", "metric_value", "suspicious"
    )


@query("latest_value", sup() + """
SELECT stock_code, max(report_period) AS report_period, max_by(net_profit, report_period) AS metric_value FROM stmt GROUP BY stock_code""")
def latest_value(spark, d):
    return L.latest_value(supplier_statements(spark, d, metrics=("net_profit",)), "net_profit")


@query("latest_value_calendar", sup() + """
SELECT stock_code, max_by(report_period, y * 10 + CASE p WHEN 'Q1' THEN 1 WHEN 'HY' THEN 2 WHEN 'Q3' THEN 3 ELSE 5 END) AS report_period,
  max_by(net_profit, y * 10 + CASE p WHEN 'Q1' THEN 1 WHEN 'HY' THEN 2 WHEN 'Q3' THEN 3 ELSE 5 END) AS metric_value FROM stmt GROUP BY stock_code""")
def latest_value_calendar(spark, d):
    return L.latest_value(supplier_statements(spark, d, metrics=("net_profit",)), "net_profit", order="calendar")


def company_master(spark, d):
    """Supplier master: nation as industry, region as registered region."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock_code"), F.col("s_name").alias("stock_abbr"),
        F.concat(F.lit("Company "), F.substring("s_name", 10, 9)).alias("company_name"), F.col("n_name").alias("industry"),
        F.col("r_name").alias("registered_region"), F.col("s_acctbal").cast("decimal(18,2)").cast("string").alias("registered_capital"),
    )


@query("company_profile", """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, f AS field_name,
  CASE f WHEN 'industry' THEN n_name WHEN 'registered_capital' THEN CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS field_value
FROM supplier JOIN nation ON s_nationkey = n_nationkey, (VALUES ('industry'), ('registered_capital'), ('employee_count')) v(f)""")
def company_profile(spark, d):
    fields = F.explode(F.array(*[F.lit(f) for f in ("industry", "registered_capital", "employee_count")]))
    master = company_master(spark, d)
    return L.company_attributes(master.select("stock_code", fields.alias("field_name")), master)


@query("threshold_filter", sup() + """
SELECT stock_code, stock_abbr, report_period, net_profit AS metric_value FROM stmt
WHERE report_period = '2020FY' AND net_profit > 300 ORDER BY net_profit DESC, stock_code LIMIT 50""")
def threshold_filter(spark, d):
    return L.threshold_filter(supplier_statements(spark, d, (2020,), ("net_profit",)), "net_profit", "2020FY", ">", 300, limit=50)


@query("sign_filter", cus() + """
SELECT report_period AS request_id, stock_code, operating_cf_net_amount AS metric_value, CAST(n AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY report_period ORDER BY operating_cf_net_amount DESC, stock_code) AS n
  FROM cust WHERE operating_cf_net_amount < 0) WHERE n <= 50""")
def sign_filter(spark, d):
    sheet = customer_sheets(spark, d, written=False)["cash_flow_sheet"]
    asked = L.threshold(F.lit("经营活动现金流量净额为负数的公司"), F.lit("operating_cf_net_amount"), F.lit("经营活动现金流量净额"))
    requests = sheet.select("report_period").distinct().select(
        F.col("report_period").alias("request_id"), "report_period", F.lit("operating_cf_net_amount").alias("metric_key"),
        asked["operator"].alias("operator"), asked["bound"].alias("bound"),
    )
    facts = FA.table_facts(sheet, "cash_flow_sheet")
    return L.threshold_requests(requests, facts, limit=50).select("request_id", "stock_code", "metric_value", "position")


THRESHOLD_TEXTS = (("不低于", ">=", ""), ("不超过", "<=", ""), ("超过", ">", "万"), ("低于", "<", "亿"), ("大于", ">", "元"), ("没有条件", None, ""))


@query("threshold_conditions", "SELECT p_partkey, CASE p_partkey % 6 " + " ".join(
    f"WHEN {i} THEN {repr(op) if op else 'NULL'}" for i, (_, op, _) in enumerate(THRESHOLD_TEXTS)
) + " END AS operator, CASE p_partkey % 6 WHEN 5 THEN NULL WHEN 2 THEN CAST(p_size AS DOUBLE) * 10000 / 10000 WHEN 3 THEN CAST(p_size AS DOUBLE) * 100000000 / 10000 "
  "WHEN 4 THEN CAST(p_size AS DOUBLE) / 10000 ELSE CAST(p_size AS DOUBLE) END AS bound FROM part")
def threshold_conditions(spark, d):
    k = F.col("p_partkey") % 6
    pick = lambda j: F.get(F.array(*[F.lit(t[j] or "") for t in THRESHOLD_TEXTS]), k.cast("int"))
    text = F.concat(F.lit("净利润"), pick(0), F.col("p_size").cast("string"), pick(2), F.lit("的公司"))
    x = L.threshold(text, F.lit("net_profit"), F.lit("净利润"))
    return read(spark, d, "part").select("p_partkey", x["operator"].alias("operator"), x["bound"].alias("bound"))


@query("set_extreme", sup(f"""
m AS (SELECT a.*, {S.growth('a.' + REVENUE, 'z.' + REVENUE)} AS yoy
      FROM stmt a LEFT JOIN stmt z ON z.stock_code = a.stock_code AND z.report_period = '2019FY'
      WHERE a.report_period = '2020FY' AND a.stock_code IN (
        SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') FROM supplier WHERE s_nationkey IN (1, 2, 3)))""") + f"""
(SELECT 'largest' AS kind, stock_code, {REVENUE} AS value FROM m ORDER BY value DESC, stock_code LIMIT 1) UNION ALL
(SELECT 'smallest' AS kind, stock_code, {REVENUE} AS value FROM m ORDER BY value, stock_code LIMIT 1) UNION ALL
(SELECT 'fastest' AS kind, stock_code, yoy AS value FROM m WHERE abs(yoy) <= 500 ORDER BY value DESC, stock_code LIMIT 1)""")
def set_extreme(spark, d):
    stmt = supplier_statements(spark, d, (2019, 2020), (REVENUE,))
    members = read(spark, d, "supplier").filter(F.col("s_nationkey").isin(1, 2, 3)).select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock_code")
    )
    one = lambda name, value, **how: R.set_extreme(stmt, REVENUE, "2020FY", members, **how).select(
        F.lit(name).alias("kind"), "stock_code", F.col(value).alias("value")
    )
    return one("largest", "metric_value").unionByName(one("smallest", "metric_value", kind="min")).unionByName(
        one("fastest", "yoy", by_growth=True)
    )


@query("latest_fy", sup() + "SELECT max(report_period) AS report_period FROM stmt WHERE p = 'FY'")
def latest_fy(spark, d):
    return L.latest_fy(supplier_statements(spark, d, metrics=(REVENUE,)))


@query("available_periods", cus() + """
SELECT stock_code, string_agg(report_period, ',' ORDER BY report_period) AS periods, count(*) AS n_periods FROM cust GROUP BY stock_code""")
def available_periods(spark, d):
    out = L.available_periods(customer_sheets(spark, d, written=False)["income_sheet"])
    return out.select("stock_code", F.array_join("periods", ",").alias("periods"), "n_periods")


CLEAN = """
s AS (SELECT stock_code, report_period, net_profit AS value, p, y * 10 + CASE p WHEN 'Q1' THEN 1 WHEN 'HY' THEN 2 WHEN 'Q3' THEN 3 ELSE 5 END AS k
      FROM {0} WHERE abs(net_profit) >= 1),
n AS (SELECT stock_code, count(*) AS n_all, count(*) FILTER (p = 'FY') AS n_fy FROM s GROUP BY stock_code),
r AS (SELECT s.*, n_all >= 4 AS every, {1} AS keep FROM s JOIN n USING (stock_code) WHERE {2}),
w AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY k DESC) AS back FROM r)
"""


@query("trend_window", cus(CLEAN.format("cust", "CASE WHEN n_fy >= 3 THEN 3 ELSE 6 END", "n_fy < 3 OR p = 'FY'")) + """
SELECT stock_code, report_period, value, CAST(back AS INTEGER) AS back FROM w WHERE back <= keep""")
def trend_window(spark, d):
    series = TR.clean_series(customer_sheets(spark, d)["income_sheet"], "net_profit")
    return TR.trend_window(series, question="近三年的净利润变化").select("stock_code", "report_period", "value", "back")


# the shape of the windows that CLEAN makes
SHAPE = """,
a AS (SELECT stock_code, list(value ORDER BY k) AS v, list(report_period ORDER BY k) AS p FROM w WHERE back <= keep GROUP BY stock_code),
b AS (SELECT *, len(v) AS n, list_position(v, list_min(v)) AS lo, list_position(v, list_max(v)) AS hi FROM a),
e AS (SELECT *, len(list_filter(range(1, n), lambda i: v[i] > v[i + 1])) = 0 AS up, len(list_filter(range(1, n), lambda i: v[i] < v[i + 1])) = 0 AS down,
  len(list_filter(range(1, lo), lambda i: v[i] < v[i + 1])) = 0 AS fell, len(list_filter(range(lo, n), lambda i: v[i] > v[i + 1])) = 0 AS rose,
  len(list_filter(p, lambda x: x NOT LIKE '%FY')) > 0 AS mixed FROM b),
shape AS (SELECT stock_code, CAST(n AS INTEGER) AS n_periods,
  p[1][1:4] || '-' || p[n][1:4] || '年' || CASE WHEN p[n] LIKE '%FY' THEN '' ELSE '（截至' || p[n] || '）' END AS span,
  p[1] AS first_period, p[n] AS last_period, p[greatest(n - 2, 1)] AS recent_start,
  CASE WHEN n = 1 THEN 'single' WHEN n >= 3 AND lo NOT IN (1, n) AND v[1] > v[lo] AND v[lo] < v[n] THEN 'v_shape'
       WHEN n >= 3 AND hi NOT IN (1, n) AND v[1] < v[hi] AND v[hi] > v[n] THEN 'inverted_v' WHEN up THEN 'rising' WHEN down THEN 'falling' ELSE 'mixed' END AS pattern,
  p[lo] AS low_period, v[lo] AS low_value, p[hi] AS high_period, v[hi] AS high_value,
  CASE WHEN mixed AND lo > 1 THEN CASE WHEN fell THEN 'steady' ELSE 'uneven' END END AS decline,
  CASE WHEN mixed AND lo > 1 AND lo < n THEN CASE WHEN rose THEN 'steady' ELSE 'uneven' END END AS recovery,
  CASE WHEN n >= 3 AND p[n][1:4] = p[n - 2][1:4] AND p[n][1:4] = p[n - 1][1:4] THEN
    CASE WHEN v[n - 2] <= v[n - 1] AND v[n - 1] <= v[n] THEN 'improving' WHEN v[n - 2] >= v[n - 1] AND v[n - 1] >= v[n] THEN 'falling_back' END END AS recent_move
  FROM e)
"""


@query("trend_shape", sup(CLEAN.format("stmt", "CASE WHEN n_all >= 4 THEN 12 ELSE 8 END", "n_all >= 4 OR n_fy < 3 OR p = 'FY'")) + SHAPE + "SELECT * FROM shape")
def trend_shape(spark, d):
    series = TR.clean_series(supplier_statements(spark, d, metrics=("net_profit",)), "net_profit")
    return TR.trend_shape(TR.trend_window(series, question="近几年的净利润趋势"))


@query("growth_recompute", cus() + f"""
SELECT a.stock_code, a.report_period, a.{REVENUE} AS revenue,
  CASE WHEN z.stock_code IS NULL THEN a.operating_revenue_yoy_growth ELSE {S.growth('a.' + REVENUE, 'z.' + REVENUE)} END AS revenue_growth,
  CASE WHEN z.stock_code IS NOT NULL THEN {S.growth('a.net_profit', 'z.net_profit')} END AS profit_growth
FROM cust a LEFT JOIN cust z ON z.stock_code = a.stock_code AND z.p = a.p AND z.y = a.y - 1""")
def growth_recompute(spark, d):
    out = RES.recompute_income_growth(customer_sheets(spark, d)["income_sheet"])
    return out.select(
        "stock_code", "report_period", F.col(REVENUE).alias("revenue"),
        F.col("operating_revenue_yoy_growth").alias("revenue_growth"), F.col("net_profit_yoy_growth").alias("profit_growth"),
    )


@query("duplicate_keys", """
SELECT o_custkey, o_orderpriority, count(*) AS duplicate_count FROM orders GROUP BY 1, 2 HAVING count(*) > 1
ORDER BY 3 DESC, 1, 2 LIMIT 100""")
def duplicate_keys(spark, d):
    return Q.duplicate_keys(read(spark, d, "orders"), ("o_custkey", "o_orderpriority"), limit=100)


def cells_sql(columns=None) -> str:
    return "cells AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, report_period, {c} AS value FROM cust WHERE {c} IS NOT NULL"
        for t, cs in S.SHEET_COLUMNS.items() for c in cs if columns is None or c in columns
    ) + ")"


PEERS = """
peers AS (SELECT table_name, column_name, report_period, count(*) AS peer_count, list_sort(list(value)) AS vs FROM cells GROUP BY 1, 2, 3),
profile AS (SELECT table_name, column_name, report_period, peer_count,
  (vs[(peer_count + 1) // 2] + vs[peer_count // 2 + 1]) / 2.0 AS median, vs[CAST(round_even((peer_count - 1) * 0.9, 0) AS INTEGER) + 1] AS p90 FROM peers)
"""


@query("peer_profile", cus(cells_sql(), PEERS) + "SELECT * FROM profile")
def peer_profile(spark, d):
    return Q.peer_profile(customer_sheets(spark, d))


def _issue_sql() -> str:
    """Every rule spelled out per column, first hit wins."""
    def case(rules):
        return "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in rules) + " END"

    def gap(c, factor):
        return f"b.{c} IS NOT NULL AND coalesce(({S.safe_ratio('a.' + c, 'b.' + c)}) >= {factor}, false)"

    parts, whys = [], {}
    for t, cs in S.SHEET_COLUMNS.items():
        for c in cs:
            v, size, rules = f"a.{c}", f"abs(a.{c})", []
            if c in fv.AMOUNT_LIMITS:
                rules.append(("amount_exceeds_absolute_limit", f"{size} > {fv.AMOUNT_LIMITS[c]}"))
                if c in fv.NON_NEGATIVE_COLUMNS:
                    rules.append(("negative_amount_not_allowed", f"{v} < 0"))
                if c in ("net_profit", "total_profit"):
                    rules.append(("profit_exceeds_revenue", f"{size} > greatest(abs(a.main_business_revenue) * 1.05, 10)"))
                if c == "main_business_revenue":
                    rules.append(("main_business_exceeds_total_revenue", f"{size} > greatest(abs(a.{REVENUE}) * 1.05, 10)"))
                if c in fv.COMPONENT_TOTALS:
                    rules.append(("component_exceeds_total", f"{size} > greatest(abs(a.{fv.COMPONENT_TOTALS[c]}) * 1.05, 10)"))
                if c == "liability_total_liabilities":
                    rules.append(("liability_exceeds_assets", f"{size} > greatest(abs(a.asset_total_assets) * 1.5, 10)"))
                if c == "equity_parent_net_assets":
                    rules.append(("equity_exceeds_assets", f"{size} > greatest(abs(a.asset_total_assets) * 1.2, 10)"))
                if c in fv.CASH_FLOW_COLUMNS:
                    rules.append(("cashflow_scale_mismatch", f"{size} > 3.5 * greatest(abs(a.main_business_revenue), abs(a.asset_total_assets), abs(a.liability_total_liabilities), 1.0)"))
                factor = fv.AMOUNT_HISTORY_FACTORS.get(c, fv.AMOUNT_HISTORY_DEFAULT)
                rules.append(("history_scale_jump", f"{size} >= 50 AND {gap(c, factor)}"))
                floor = fv.PEER_FLOORS.get(c, fv.PEER_FLOOR_DEFAULT)
                rules.append(("peer_outlier", f"pr_{c}.peer_count >= 4 AND {size} > greatest(abs(pr_{c}.p90) * 8, abs(pr_{c}.median) * 12, {floor})"))
            elif c in fv.EPS_COLUMNS:
                factor = fv.RATIO_HISTORY_FACTORS.get(c, fv.RATIO_HISTORY_DEFAULT)
                rules = [("abnormal_eps", f"{size} > 20"), ("eps_scale_jump", f"{size} > 0.5 AND {gap(c, factor)}")]
            elif c in fv.RATIO_COLUMNS:
                if c == "asset_liability_ratio":
                    rules.append(("asset_liability_ratio_out_of_range", f"NOT ({v} BETWEEN 0 AND 100)"))
                if c == "roe":
                    rules.append(("abnormal_roe", f"{size} > 80"))
                rules.append(("abnormal_growth_or_ratio", f"{size} > 300"))
                factor = fv.RATIO_HISTORY_FACTORS.get(c, fv.RATIO_HISTORY_DEFAULT)
                rules.append(("ratio_scale_jump", f"{size} > 10 AND {gap(c, factor)}"))
                base = fv.GROWTH_BASES.get(c)
                if base:
                    g = S.growth(f"a.{base}", f"b.{base}")
                    jump = fv.AMOUNT_HISTORY_FACTORS.get(base, fv.AMOUNT_HISTORY_DEFAULT)
                    rules += [
                        ("growth_scale_mismatch", gap(base, jump)),
                        ("recomputed_growth_out_of_range", f"abs({g}) > 300"),
                        ("growth_recompute_mismatch", f"abs({v} - ({g})) > greatest(20, abs({g}) * 0.6)"),
                        ("growth_scale_mismatch", f"b.{base} <> 0 AND abs(a.{base}) / abs(b.{base}) >= {jump} AND {size} < 80"),
                    ]
            if rules:
                whys[(t, c)] = f"CASE WHEN {v} IS NOT NULL THEN {case(rules)} END"
    joins = " ".join(
        f"LEFT JOIN profile pr_{c} ON pr_{c}.column_name = '{c}' AND pr_{c}.report_period = a.report_period"
        for c in fv.AMOUNT_LIMITS if any(c == x for _, x in whys)
    )
    judged = "judged AS (SELECT a.*, " + ", ".join(f"{e} AS why_{c}" for (_, c), e in whys.items()) + (
        f" FROM cust a LEFT JOIN cust b ON b.stock_code = a.stock_code AND b.p = a.p AND b.y = a.y - 1 {joins})"
    )
    for t, c in whys:
        why = f"why_{c}"
        base = fv.GROWTH_BASES.get(c)
        if base and (t, base) in whys:
            why = f"coalesce(why_{c}, CASE WHEN why_{base} IS NOT NULL AND {c} IS NOT NULL THEN 'base_metric_sanitized' END)"
        parts.append(f"SELECT '{t}' AS table_name, stock_code, report_period, '{c}' AS column_name, {c} AS value, {why} AS reason FROM judged")
    return cus(cells_sql(tuple(fv.AMOUNT_LIMITS)), PEERS, judged, "every AS (" + " UNION ALL ".join(parts) + ")",
               "issues AS (SELECT * FROM every WHERE reason IS NOT NULL)")


ISSUES = _issue_sql()


def _issues(spark, d):
    return Q.cell_issues(Q.judge_all(customer_sheets(spark, d), written=False))


@query("cell_issues", ISSUES + " SELECT * FROM issues")
def cell_issues(spark, d):
    return _issues(spark, d).select("table_name", "stock_code", "report_period", "column_name", "value", "reason")


@query("sanitized_facts", ISSUES + " SELECT table_name, column_name AS metric_key, count(value) AS facts, CAST(SUM(CAST(value AS DECIMAL(30,8))) AS DOUBLE) AS total FROM every "
       "WHERE reason IS NULL AND value IS NOT NULL AND column_name <> 'operating_revenue_yoy_growth' GROUP BY 1, 2 "
       "UNION ALL SELECT 'cash_flow_sheet', 'net_cash_flow', count(*), CAST(SUM(CAST(net_cash_flow AS DECIMAL(30,8))) AS DOUBLE) FROM cust WHERE net_cash_flow IS NOT NULL "
       "UNION ALL SELECT 'core_performance_indicators_sheet', 'gross_profit_margin_dummy', 0, 0 FROM cust WHERE false")
def sanitized_facts(spark, d):
    clean = Q.sanitize(Q.judge_all(customer_sheets(spark, d), written=False))
    facts = FA.metric_facts(clean)
    return facts.groupBy("table_name", "metric_key").agg(
        F.count("metric_value").alias("facts"), F.sum(F.col("metric_value").cast("decimal(30,8)")).cast("double").alias("total")
    )


@query("issue_rollups", ISSUES + " SELECT table_name, column_name, reason, count(*) AS n FROM issues GROUP BY 1, 2, 3")
def issue_rollups(spark, d):
    return _issues(spark, d).groupBy("table_name", "column_name", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("issues_by_column", ISSUES + " SELECT column_name, count(*) AS issue_count FROM issues GROUP BY 1")
def issues_by_column(spark, d):
    return Q.issues_by_column(_issues(spark, d))


@query("sanitized_rows", ISSUES + " SELECT table_name, count(DISTINCT stock_code || report_period) AS sanitized_rows FROM issues GROUP BY 1")
def sanitized_rows(spark, d):
    return Q.sanitized_rows(_issues(spark, d))


@query("risky_companies", ISSUES + " SELECT stock_code, count(*) AS issue_count FROM issues GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def risky_companies(spark, d):
    return Q.risky_companies(_issues(spark, d))


@query("coverage", """
SELECT 'documents' AS table_name, count(*) AS row_count, f AS field_name,
  count(CASE f WHEN 'quality' THEN quality WHEN 'toxic' THEN toxic END) AS non_null,
  round(count(CASE f WHEN 'quality' THEN quality WHEN 'toxic' THEN toxic END) / count(*), 4) AS coverage_ratio
FROM documents LEFT JOIN labels USING (doc_id), (VALUES ('quality'), ('toxic'), ('absent')) v(f) GROUP BY f""")
def coverage(spark, d):
    docs = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return Q.coverage(docs, "documents", ("quality", "toxic", "absent")).drop("present")


@query("critical_missing", """
SELECT 'documents' AS table_name, f AS column_name, CASE WHEN f = 'absent' THEN NULL ELSE count(*) - count(quality) END AS missing_rows,
  CASE WHEN f = 'absent' THEN 'column_missing' ELSE 'null_value' END AS reason
FROM documents LEFT JOIN labels USING (doc_id), (VALUES ('quality'), ('absent')) v(f) GROUP BY f""")
def critical_missing(spark, d):
    docs = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return Q.critical_missing(docs, "documents", ("quality", "absent"))


def _companies_seen(spark, d):
    """Customers and suppliers that appear in the fact tables, under one code space."""
    a = read(spark, d, "orders").select(
        F.lit("income_sheet").alias("table_name"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("stock_code"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("stock_abbr"))
    b = read(spark, d, "lineitem").select(
        F.lit("balance_sheet").alias("table_name"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("stock_code"),
        F.lit("").alias("stock_abbr"))
    return a.unionByName(b)


SEEN = """
seen AS (SELECT DISTINCT 'income_sheet' AS table_name, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS stock_code, 'C' || CAST(o_custkey AS VARCHAR) AS stock_abbr FROM orders
  UNION SELECT DISTINCT 'balance_sheet', lpad(CAST(l_suppkey AS VARCHAR), 6, '0'), '' FROM lineitem),
master AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code FROM supplier WHERE s_nationkey < 20),
named AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS stock_code, c_name AS name FROM customer WHERE c_nationkey < 10)
"""


def _known_master(spark, d):
    return read(spark, d, "supplier").filter(F.col("s_nationkey") < 20).select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock_code"))


def _named_chunks(spark, d):
    return read(spark, d, "customer").filter(F.col("c_nationkey") < 10).select(
        F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("stock_code"), F.col("c_name").alias("stock_name"))


@query("alias_rebuild", "WITH " + SEEN + """
SELECT s.stock_code, coalesce(nullif(s.stock_abbr, ''), n.name, '') AS stock_abbr,
  coalesce(n.name, nullif(s.stock_abbr, ''), s.stock_code) AS company_name, s.table_name AS source_table
FROM seen s LEFT JOIN named n USING (stock_code) WHERE s.stock_code NOT IN (SELECT stock_code FROM master)""")
def alias_rebuild(spark, d):
    return C.rebuild_aliases(_companies_seen(spark, d), _known_master(spark, d), _named_chunks(spark, d)).drop("source")


@query("alias_statistics", "WITH " + SEEN + """
SELECT count(*) AS alias_count, count(DISTINCT stock_code) AS missing_company_info_count FROM seen WHERE stock_code NOT IN (SELECT stock_code FROM master)""")
def alias_statistics(spark, d):
    return C.alias_statistics(C.rebuild_aliases(_companies_seen(spark, d), _known_master(spark, d)))


@query("alignment_anti", "WITH " + SEEN + """
SELECT table_name, stock_code, stock_abbr, CASE WHEN stock_code IN (SELECT stock_code FROM named) THEN 'covered_by_alias_table' ELSE 'missing_master_data' END AS status
FROM seen WHERE stock_code NOT IN (SELECT stock_code FROM master)""")
def alignment_anti(spark, d):
    aliases = _named_chunks(spark, d).select("stock_code", F.lit("customer").alias("source_table"), F.lit("given").alias("source"))
    return C.missing_in_master(_companies_seen(spark, d), _known_master(spark, d), aliases).select(
        "table_name", "stock_code", "stock_abbr", "status")


@query("company_merge", "WITH " + SEEN + """,
u AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, 0 AS r, s_name AS abbr, CAST(NULL AS VARCHAR) AS name FROM supplier
  UNION ALL SELECT stock_code, 1, NULL, name FROM named
  UNION ALL SELECT stock_code, 2, nullif(stock_abbr, ''), NULL FROM seen)
SELECT code AS stock_code, CAST(min(r) AS INTEGER) AS source_rank, arg_min(abbr, r) FILTER (abbr IS NOT NULL) AS stock_abbr,
  coalesce(arg_min(name, r) FILTER (name IS NOT NULL), arg_min(abbr, r) FILTER (abbr IS NOT NULL)) AS company_name FROM u GROUP BY code""")
def company_merge(spark, d):
    master = read(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock_code"), F.col("s_name").alias("stock_abbr"))
    named = _named_chunks(spark, d).withColumnRenamed("stock_name", "company_name")
    return C.merge_companies([master, named, _companies_seen(spark, d)]).drop("company_key")


@query("company_label", cus() + """
SELECT c.stock_code, c.report_period, coalesce(s_name, c.stock_abbr) AS label FROM cust c
LEFT JOIN supplier ON lpad(CAST(s_suppkey AS VARCHAR), 6, '0') = c.stock_code""")
def company_label(spark, d):
    rows = customer_sheets(spark, d, written=False)["income_sheet"].select("stock_code", "stock_abbr", "report_period")
    return C.company_label(rows, company_master(spark, d)).select("stock_code", "report_period", "label")


@query("statement_table", sup() + """
SELECT row_number() OVER (ORDER BY stock_code, y, CASE p WHEN 'Q1' THEN 1 WHEN 'HY' THEN 2 WHEN 'Q3' THEN 3 ELSE 5 END) AS serial_number,
  stock_code, report_period, net_profit, CAST(NULL AS DOUBLE) AS total_profit FROM stmt""")
def statement_table(spark, d):
    dictionary = [("net_profit", "decimal(18,2)"), ("", "int")]
    schema = TB.statement_schema("income_sheet", dictionary)
    out = TB.statement_table(supplier_statements(spark, d, metrics=("net_profit",)), schema)
    return out.select("serial_number", "stock_code", "report_period", "net_profit", "total_profit")


# events as competing candidates for the fields of a user
def _candidates(spark, d, mode):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").select(
        F.lit("events").alias("table_name"), F.col("user_id").cast("string").alias("stock_code"), F.lit("2024FY").alias("report_period"),
        F.col("event_type").alias("field_name"), (F.col("value") / 40).alias("value"), (k % 3).alias("priority"), F.col("event_id").alias("seq"),
        mode(k).alias("mode"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("source_file"), F.lit("e").alias("source_excerpt"),
        F.date_format("ts", "yyyy-MM-dd").alias("report_date"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("u"), k.cast("string"))).alias("stock_abbr"),
    )


EVENTS = """
ev AS (SELECT user_id, event_type, event_id, value / 40 AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  strftime(ts, '%Y-%m-%d') AS d FROM events),
cand AS (SELECT CAST(user_id AS VARCHAR) AS stock_code, event_type AS field_name, event_id AS seq, v, k % 3 AS priority, d, k,
  'f' || CAST(k % 7 AS VARCHAR) AS source_file, k % 2 = 0 AS is_last FROM ev)
"""
LAST = "order by priority desc, seq desc"


@query("field_resolution", "WITH " + EVENTS + f"""
SELECT stock_code, field_name, v AS value, CAST(priority AS INTEGER) AS priority, source_file FROM cand
QUALIFY row_number() OVER (PARTITION BY stock_code, field_name {LAST}) = 1""")
def field_resolution(spark, d):
    won = RES.resolve_fields(_candidates(spark, d, lambda k: F.lit("last")), mixed=False)
    return won.select("stock_code", "field_name", "value", "priority", "source_file")


HELD = """
p AS (SELECT *, max(priority) OVER (PARTITION BY stock_code, field_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM cand),
q AS (SELECT *, priority >= coalesce(best, -1) AS taken FROM p),
h AS (SELECT *, last_value(CASE WHEN taken THEN v END IGNORE NULLS) OVER (PARTITION BY stock_code, field_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM q)
"""


@query("field_conflicts", "WITH " + EVENTS + "," + HELD + """
SELECT stock_code, field_name, seq, CASE WHEN taken THEN 'replace_existing' ELSE 'keep_existing' END AS decision, held AS existing_value, v AS candidate_value
FROM h WHERE abs(held - v) > greatest(1.0, abs(held) * 0.05, abs(v) * 0.05)""")
def field_conflicts(spark, d):
    found = RES.conflicts(_candidates(spark, d, lambda k: F.lit("last")), bucket_rows=2000, mixed=False)
    return found.select("stock_code", "field_name", "seq", "decision", "existing_value", "candidate_value")


@query("conflicts_by_field", "WITH " + EVENTS + "," + HELD + """
SELECT 'events' AS table_name, field_name, count(*) AS conflict_count FROM h WHERE abs(held - v) > greatest(1.0, abs(held) * 0.05, abs(v) * 0.05) GROUP BY 2""")
def conflicts_by_field(spark, d):
    return Q.conflicts_by_field(RES.conflicts(_candidates(spark, d, lambda k: F.lit("last")), mixed=False))


@query("field_resolution_reasonable", "WITH RECURSIVE " + EVENTS + """,
n AS (SELECT *, row_number() OVER (PARTITION BY stock_code, field_name ORDER BY seq) AS i FROM cand),
f AS (SELECT stock_code, field_name, i, v AS cur, priority AS pr FROM n WHERE i = 1
  UNION ALL
  SELECT n.stock_code, n.field_name, n.i,
    CASE WHEN n.priority > f.pr OR (n.priority = f.pr AND (n.is_last OR (abs(f.cur) < 1 AND abs(n.v) >= 1))) THEN n.v ELSE f.cur END,
    greatest(n.priority, f.pr)
  FROM f JOIN n ON n.stock_code = f.stock_code AND n.field_name = f.field_name AND n.i = f.i + 1)
SELECT stock_code, field_name, cur AS value, CAST(pr AS INTEGER) AS priority FROM f QUALIFY row_number() OVER (PARTITION BY stock_code, field_name ORDER BY i DESC) = 1""")
def field_resolution_reasonable(spark, d):
    mode = lambda k: F.when(k % 2 == 0, "last").otherwise("reasonable")
    return RES.resolve_fields(_candidates(spark, d, mode), bucket_rows=2000).select("stock_code", "field_name", "value", "priority")


@query("row_source", "WITH " + EVENTS + """
SELECT stock_code, max(priority) AS row_priority, arg_max(d, priority * 1000000000 + seq) AS report_date,
  arg_max(source_file, priority * 1000000000 + seq) AS source_file, 'u' || CAST(arg_min(k, seq) FILTER (k % 5 <> 0) AS VARCHAR) AS stock_abbr FROM cand GROUP BY 1""")
def row_source(spark, d):
    out = RES.row_sources(_candidates(spark, d, lambda k: F.lit("last")))
    return out.select("stock_code", "row_priority", "report_date", "source_file", "stock_abbr")


@query("field_lineage", "WITH " + EVENTS + "," + HELD + f""",
won AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY stock_code, field_name {LAST}) = 1)
SELECT field_name, 'chosen' AS decision, count(*) AS n, CAST(SUM(CAST(v * 40 AS DECIMAL(18,2))) AS DOUBLE) AS total FROM won GROUP BY 1 UNION ALL
SELECT field_name, CASE WHEN taken THEN 'replace_existing' ELSE 'keep_existing' END, count(*),
  CAST(SUM(CAST(CASE WHEN taken THEN v ELSE held END * 40 AS DECIMAL(18,2))) AS DOUBLE) FROM h
WHERE abs(held - v) > greatest(1.0, abs(held) * 0.05, abs(v) * 0.05) GROUP BY 1, 2""")
def field_lineage(spark, d):
    cand = _candidates(spark, d, lambda k: F.lit("last"))
    fields = ("signup", "purchase", "error", "view", "click")
    rows = RES.lineage(RES.resolve_fields(cand, mixed=False), RES.conflicts(cand, mixed=False), fields)
    return rows.groupBy("field_name", "decision").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("field_value") * 40).cast("decimal(18,2)")).cast("double").alias("total"))


@query("lineage_facts", cus() + """
SELECT stock_code, report_period, CASE WHEN key % 2 = 0 THEN 'lineage/' || CAST(key AS VARCHAR) ELSE 'orders/' || CAST(key AS VARCHAR) END AS source_file, net_profit AS metric_value FROM cust""")
def lineage_facts(spark, d):
    sheet = customer_sheets(spark, d)["income_sheet"].select("stock_code", "stock_abbr", "report_period", "report_date", "source_file", "source_excerpt", "net_profit")
    key = F.substring("stock_abbr", 2, 20)
    known = sheet.filter(key.cast("long") % 2 == 0).select(
        F.lit("income_sheet").alias("table_name"), "stock_code", "report_period", F.lit("net_profit").alias("field_name"),
        F.concat(F.lit("lineage/"), key).alias("source_file"), F.lit("x").alias("source_excerpt"), F.lit("chosen").alias("decision"))
    facts = FA.metric_facts({"income_sheet": sheet}, known)
    return facts.select("stock_code", "report_period", "source_file", "metric_value")


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("orders", "lineitem", "documents", "pages", "events")))
def row_counts(spark, d):
    return TB.row_counts({t: read(spark, d, t) for t in ("orders", "lineitem", "documents", "pages", "events")})


@query("table_listing", "SELECT 'customer' AS table_name, count(*) AS row_count, 5 AS column_count FROM customer UNION ALL SELECT 'orders', count(*), 6 FROM orders")
def table_listing(spark, d):
    return TB.table_listing({t: read(spark, d, t) for t in ("customer", "orders")})


@query("table_preview", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(c_name, '') AS c_name FROM customer ORDER BY customer.c_custkey LIMIT 20 OFFSET 40")
def table_preview(spark, d):
    return TB.preview(read(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], page=3, page_size=20)


@query("product_list", """
WITH p AS (SELECT CAST(2020 + p_size % 4 AS VARCHAR) AS year, p_name, p_type FROM part)
SELECT year, trim(p_name) AS product_name FROM p WHERE year = (SELECT max(year) FROM p) AND (p_type LIKE '%ECONOMY%' OR p_type LIKE '%PROMO%') GROUP BY 1, 2""")
def product_list(spark, d):
    products = read(spark, d, "part").select(
        (2020 + F.col("p_size") % 4).cast("string").alias("year"), F.col("p_name").alias("product_name"),
        F.col("p_type").alias("drug_category"), F.col("p_brand").alias("source_path"))
    return L.product_list(products, categories=("ECONOMY", "PROMO")).select("year", "product_name")


@query("metric_status", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{m}' AS metric_key, CASE WHEN count(*) > 0 THEN '{'available' if m in S.SHEET_COLUMNS[t] else 'column_missing'}' ELSE 'x' END AS status FROM orders"
    for t, m, _, _, _ in fv.METRICS) + ")")
def metric_status(spark, d):
    return L.metric_status(customer_sheets(spark, d)).select("table_name", "metric_key", "status")


@query("period_issues", cus() + """
SELECT stock_code || '|' || bad AS row_id, stock_code, bad AS report_period, CASE WHEN n = 1 THEN CAST(y AS VARCHAR) || 'Q4' ELSE 'YEAR' || CAST(y AS VARCHAR) END AS normalized_period
FROM (SELECT stock_code, y, key % 3 AS n, CASE key % 3 WHEN 1 THEN CAST(y AS VARCHAR) || '年第四季度' ELSE 'year ' || CAST(y AS VARCHAR) END AS bad FROM cust WHERE p = 'FY' AND key % 3 > 0)""")
def period_issues(spark, d):
    year, n = F.col("report_year"), F.substring("stock_abbr", 2, 20).cast("long") % 3
    sheet = customer_sheets(spark, d, written=False)["income_sheet"].filter(F.col("report_period").endswith("FY"))
    text = F.when(n == 0, F.concat(year, F.lit("年年度"))).when(n == 1, F.concat(year, F.lit("年第四季度"))).otherwise(F.concat(F.lit("year "), year))
    return Q.invalid_periods(sheet.select("stock_code", text.alias("report_period")))


@query("missing_keys", """
SELECT CAST(o_orderkey AS VARCHAR) AS row_id, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS stock_code, '2024FY' AS report_period FROM orders WHERE o_orderstatus = 'P'""")
def missing_keys(spark, d):
    rows = read(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("row_id"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_custkey").cast("string")).alias("stock_code"), F.lit("2024FY").alias("report_period"))
    return Q.missing_keys(rows)


@query("validation_summary", ISSUES + """
SELECT 'suspicious_values' AS section, count(*) AS n FROM issues UNION ALL
SELECT 'sanitized_rows_by_table', count(DISTINCT table_name) FROM issues UNION ALL
SELECT 'invalid_periods', 0 UNION ALL SELECT 'key_fields', 0 UNION ALL SELECT 'duplicate_keys', 0 UNION ALL
SELECT 'stock_code_alignment', 4 * count(DISTINCT stock_code) FROM cust WHERE stock_code NOT IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') FROM supplier)""")
def validation_summary(spark, d):
    sections = REP.validation_report(customer_sheets(spark, d), company_master(spark, d))
    keep = ("suspicious_values", "sanitized_rows_by_table", "invalid_periods", "key_fields", "duplicate_keys", "stock_code_alignment")
    return REP.summary({k: sections[k] for k in keep})


@query("extraction_coverage", cus() + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM cust" for t in S.SHEET_COLUMNS))
def extraction_coverage(spark, d):
    return TB.row_counts(customer_sheets(spark, d))


@query("newest_reports", """
SELECT source AS "stockCode", CAST(doc_id AS VARCHAR) AS title, CAST(n AS INTEGER) AS position, strftime(DATE '1899-12-30' + CAST(45000 + doc_id % 1000 AS INTEGER), '%Y-%m-%d') AS publish_day
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY 45000 + doc_id % 1000 DESC, CAST(doc_id AS VARCHAR)) AS n FROM documents) WHERE n <= 5""")
def newest_reports(spark, d):
    reports = read(spark, d, "documents").select(
        F.col("source").alias("stockCode"), F.col("doc_id").cast("string").alias("title"),
        (45000 + F.col("doc_id") % 1000).cast("string").alias("publishDate"))
    return R.newest_reports(reports).drop("publishDate")


