"""SQL fragments shared by the reference answers of the registered queries."""

PERIODS = "(VALUES ('Q1', 1), ('HY', 2), ('Q3', 3), ('FY', 4)) v(p, k)"

# supplier statements
SUPPLIER = f"""
li AS (
  SELECT l_suppkey AS key, year(l_shipdate) + 20 AS y, quarter(l_shipdate) AS q,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)) AS keep,
         CAST(l_tax AS DECIMAL(4,2)) AS tax, l_returnflag AS flag
  FROM lineitem),
byq AS (
  SELECT key, y, q, SUM(price) AS gross, SUM(price * keep) AS main, SUM(price * keep * tax) AS tax,
         SUM(CASE WHEN flag = 'R' THEN -price ELSE price END) AS cash
  FROM li GROUP BY key, y, q),
cum AS (
  SELECT key, y, p, CAST(SUM(gross) AS DOUBLE) AS gross, CAST(SUM(main) AS DOUBLE) AS main,
         CAST(SUM(tax) AS DOUBLE) AS tax, CAST(SUM(cash) AS DOUBLE) AS cash
  FROM byq, {PERIODS} WHERE q <= k GROUP BY key, y, p),
stmt AS (
  SELECT lpad(CAST(key AS VARCHAR), 6, '0') AS stock_code, s_name AS stock_abbr,
         CAST(y AS VARCHAR) || p AS report_period, y, p,
         gross / 10000 AS total_operating_revenue, main / 10000 AS main_business_revenue,
         (main - tax) / 10000 AS net_profit, cash / 10000 AS net_cash_flow
  FROM cum JOIN supplier ON s_suppkey = key)
"""

# customer statements: one wide view over the four tables
CUSTOMER = f"""
o AS (
  SELECT o_custkey AS key, year(o_orderdate) + 20 AS y, quarter(o_orderdate) AS q,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderstatus AS st, o_orderpriority AS pr
  FROM orders),
cq AS (
  SELECT key, y, q, SUM(total) AS total,
         SUM(CASE WHEN st = 'F' THEN total ELSE 0 END) AS done, SUM(CASE WHEN st = 'O' THEN total ELSE 0 END) AS open,
         SUM(CASE WHEN st = 'P' THEN total ELSE 0 END) AS pending,
         SUM(CASE WHEN pr IN ('1-URGENT', '2-HIGH') THEN total ELSE 0 END) AS high,
         SUM(CASE WHEN pr = '3-MEDIUM' THEN total ELSE 0 END) AS medium,
         SUM(CASE WHEN pr = '5-LOW' THEN total ELSE 0 END) AS low
  FROM o GROUP BY key, y, q),
c AS (
  SELECT key, y, p, CAST(SUM(total) AS DOUBLE) AS total, CAST(SUM(done) AS DOUBLE) AS done, CAST(SUM(open) AS DOUBLE) AS open,
         CAST(SUM(pending) AS DOUBLE) AS pending, CAST(SUM(high) AS DOUBLE) AS high, CAST(SUM(medium) AS DOUBLE) AS medium,
         CAST(SUM(low) AS DOUBLE) AS low
  FROM cq, {PERIODS} WHERE q <= k GROUP BY key, y, p),
cust AS (
  SELECT lpad(CAST(key AS VARCHAR), 6, '0') AS stock_code, 'C' || CAST(key AS VARCHAR) AS stock_abbr,
    CAST(y AS VARCHAR) || p AS report_period, y, p, key,
    total AS total_operating_revenue, CAST(35.0 AS DOUBLE) AS operating_revenue_yoy_growth, total - pending AS main_business_revenue,
    high - low AS net_profit, medium * 2 AS total_profit,
    total / 20000 AS eps, open / 25000 AS diluted_eps,
    CASE WHEN total <> 0 THEN (high - low) * 100 / total END AS roe,
    CASE WHEN open <> 0 THEN done * 100 / open END AS gross_profit_margin,
    done + open AS asset_total_assets, open AS asset_cash_and_cash_equivalents, done - low AS asset_accounts_receivable,
    pending AS asset_inventory, done * 2 AS liability_total_liabilities,
    CASE WHEN done + open <> 0 THEN done * 2 * 100 / (done + open) END AS asset_liability_ratio,
    (done + open) - done * 2 AS equity_parent_net_assets,
    done - open AS operating_cf_net_amount, 0.0 - pending * 5 AS investing_cf_net_amount, low * 3 AS financing_cf_net_amount,
    done - low AS net_cash_flow
  FROM c)
"""

SHEET_COLUMNS = {
    "income_sheet": ("total_operating_revenue", "operating_revenue_yoy_growth", "main_business_revenue", "net_profit", "total_profit"),
    "core_performance_indicators_sheet": ("eps", "diluted_eps", "roe", "gross_profit_margin"),
    "balance_sheet": (
        "asset_total_assets", "asset_cash_and_cash_equivalents", "asset_accounts_receivable", "asset_inventory",
        "liability_total_liabilities", "asset_liability_ratio", "equity_parent_net_assets",
    ),
    "cash_flow_sheet": ("operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount", "net_cash_flow"),
}

# text helpers
SQUEEZE = r"trim(regexp_replace({0}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def squeeze(column: str) -> str:
    return SQUEEZE.format(column)


CHUNKS = f"""
clean AS (SELECT doc_id, source, lang, {squeeze('text')} AS t FROM documents),
chunks AS (
  SELECT doc_id, source, lang, CAST(i AS INTEGER) AS chunk_index, substring(t, CAST(i AS INTEGER) * 420 + 1, 500) AS text
  FROM clean, LATERAL (SELECT unnest(generate_series(0, CAST(greatest(ceil((length(t) - 500) / 420.0), 0) AS INTEGER))) AS i)
  WHERE length(t) > 0)
"""


def growth(now: str, before: str) -> str:
    return f"CASE WHEN {before} <> 0 AND {now} * {before} >= 0 THEN ({now} - {before}) / abs({before}) * 100.0 END"


def safe_ratio(a: str, b: str) -> str:
    x, y = f"coalesce(abs({a}), 0)", f"coalesce(abs({b}), 0)"
    return f"CASE WHEN {x} = 0 AND {y} = 0 THEN 1.0 WHEN {x} <> 0 AND {y} <> 0 THEN greatest({x}, {y}) / least({x}, {y}) END"
