"""Statement tables derived from the driver tables.

Two companies' worlds are built from order data so that every operator runs on whole
tables: suppliers (steady figures) and customers (sparse, volatile figures).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolution import cumulative
from ..session import written as stored

PERIODS = ("Q1", "HY", "Q3", "FY")
YEAR_SHIFT = 20  # the tables cover 1995-2001, report periods are written 20YY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def cents(name: str) -> Column:
    return (money(name) * 100).cast("bigint")


def in_units(c: Column) -> Column:
    """The double nearest to a whole number of cents."""
    return F.when(F.abs(c) < 1 << 53, c / 100.0).otherwise((c.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("double"))


def _period_rows(facts: DataFrame, key: str, day: str, measures: dict[str, Column], figure=lambda c: c.cast("double")) -> DataFrame:
    """One row per key and period with year-to-date sums, each turned into a double by ``figure``.

    Quarters are summed as conditional aggregates, so the fact table is shuffled once, after
    partial aggregation, and the four period rows come out of a map-side explode.
    """
    year, quarter = F.year(day) + YEAR_SHIFT, F.quarter(day)
    sums = [
        F.sum(F.when(quarter == q, c)).alias(f"{m}_{q}") for m, c in measures.items() for q in (1, 2, 3, 4)
    ]
    wide = facts.groupBy(F.col(key).alias("key"), year.alias("y")).agg(*sums)
    # added up exactly, then turned into doubles; each sum once, before the rows are made of them
    to_date = {m: cumulative([F.col(f"{m}_{q}") for q in (1, 2, 3, 4)]) for m in measures}
    summed = wide.select("key", "y", *[c.alias(f"{m}_{i}") for m, sums in to_date.items() for i, c in enumerate(sums)])
    rows = F.array(*[
        F.struct(
            F.concat(F.col("y").cast("string"), F.lit(p)).alias("report_period"),
            *[figure(F.col(f"{m}_{i}")).alias(m) for m in measures],
        )
        for i, p in enumerate(PERIODS)
    ])
    return summed.select("key", "y", F.inline(rows))


def within_years(facts: DataFrame, day: str, years) -> DataFrame:
    """Keep whole years, as a range on the date itself so that it reaches the Parquet scan."""
    if years is None:
        return facts
    start, stop = (
        F.lit(f"{y - YEAR_SHIFT}-01-01").cast("timestamp_ntz") for y in (min(years), max(years) + 1)
    )
    return facts.filter((F.col(day) >= start) & (F.col(day) < stop))


SUPPLIER_METRICS = ("total_operating_revenue", "main_business_revenue", "net_profit", "net_cash_flow")


def supplier_statements(spark: SparkSession, sf_dir: str, years=None, metrics=SUPPLIER_METRICS) -> DataFrame:
    """Income and cash-flow figures per supplier and period, in 10k units.

    ``years`` and ``metrics`` prune the scan and the sums when a job needs only some.
    """
    price, off, tax = money("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    net = price * (F.lit(1).cast("decimal(4,2)") - off)
    sums = {
        "gross": price,
        "main": net,
        "tax": net * tax,
        "cash": F.when(F.col("l_returnflag") == "R", -price).otherwise(price),
    }
    needs = {"total_operating_revenue": ("gross",), "main_business_revenue": ("main",), "net_profit": ("main", "tax"), "net_cash_flow": ("cash",)}
    used = dict.fromkeys(m for metric in metrics for m in needs[metric])
    rows = _period_rows(
        within_years(read(spark, sf_dir, "lineitem"), "l_shipdate", years), "l_suppkey", "l_shipdate",
        {m: sums[m] for m in used},
    )
    figures = {
        "total_operating_revenue": lambda: F.col("gross") / 10000,
        "main_business_revenue": lambda: F.col("main") / 10000,
        "net_profit": lambda: (F.col("main") - F.col("tax")) / 10000,
        "net_cash_flow": lambda: F.col("cash") / 10000,
    }
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_name")
    return rows.join(names, "key").filter(F.col(next(iter(used))).isNotNull()).select(
        F.lpad(F.col("key").cast("string"), 6, "0").alias("stock_code"),
        F.col("s_name").alias("stock_abbr"),
        "report_period",
        *[figures[m]().alias(m) for m in metrics],
    )


def customer_sheets(spark: SparkSession, sf_dir: str, years=None, written: bool = True) -> dict[str, DataFrame]:
    """Four statement tables per customer and period, with sparse and implausible cells.

    ``years`` prunes the scan.  A job that reads one table once sets ``written`` to False: the sums it does not use are
    then not made.
    """
    total = cents("o_totalprice")  # whole numbers add up as exactly as decimals, in a third of the room
    status, level = F.col("o_orderstatus"), F.col("o_orderpriority")

    def part(cond):
        return F.when(cond, total).otherwise(F.lit(0).cast("bigint"))

    rows = _period_rows(
        within_years(read(spark, sf_dir, "orders"), "o_orderdate", years), "o_custkey", "o_orderdate",
        {
            "total": total,
            "done": part(status == "F"),
            "open": part(status == "O"),
            "pending": part(status == "P"),
            "high": part(level.isin("1-URGENT", "2-HIGH")),
            "medium": part(level == "3-MEDIUM"),
            "low": part(level == "5-LOW"),
        },
        in_units,
    ).filter(F.col("total").isNotNull())
    if written:
        rows = stored(rows)  # the four tables are read many times; they are written once
    key = [
        F.lpad(F.col("key").cast("string"), 6, "0").alias("stock_code"),
        F.concat(F.lit("C"), F.col("key").cast("string")).alias("stock_abbr"),
        "report_period",
        F.col("y").cast("string").alias("report_year"),
        F.concat(F.col("y").cast("string"), F.lit("-12-31")).alias("report_date"),
        F.concat(F.lit("orders/"), F.col("key").cast("string")).alias("source_file"),
        F.lit("orders").alias("source_excerpt"),
    ]
    c = F.col
    assets = c("done") + c("open")
    return {
        "income_sheet": rows.select(
            *key,
            c("total").alias("total_operating_revenue"),
            F.lit(35.0).alias("operating_revenue_yoy_growth"),
            (c("total") - c("pending")).alias("main_business_revenue"),
            (c("high") - c("low")).alias("net_profit"),
            (c("medium") * 2).alias("total_profit"),
        ),
        "core_performance_indicators_sheet": rows.select(
            *key,
            (c("total") / 20000).alias("eps"),
            (c("open") / 25000).alias("diluted_eps"),
            F.try_divide((c("high") - c("low")) * 100, c("total")).alias("roe"),
            F.try_divide(c("done") * 100, c("open")).alias("gross_profit_margin"),
        ),
        "balance_sheet": rows.select(
            *key,
            assets.alias("asset_total_assets"),
            c("open").alias("asset_cash_and_cash_equivalents"),
            (c("done") - c("low")).alias("asset_accounts_receivable"),
            c("pending").alias("asset_inventory"),
            (c("done") * 2).alias("liability_total_liabilities"),
            F.try_divide(c("done") * 2 * 100, assets).alias("asset_liability_ratio"),
            (assets - c("done") * 2).alias("equity_parent_net_assets"),
        ),
        "cash_flow_sheet": rows.select(
            *key,
            (c("done") - c("open")).alias("operating_cf_net_amount"),
            (F.lit(0.0) - c("pending") * 5).alias("investing_cf_net_amount"),
            (c("low") * 3).alias("financing_cf_net_amount"),
            (c("done") - c("low")).alias("net_cash_flow"),
        ),
    }
