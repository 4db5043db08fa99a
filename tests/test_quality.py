from ledgerlane.operators import quality

INCOME = ("serial_number long, stock_code string, stock_abbr string, report_period string, total_operating_revenue double, "
          "operating_revenue_yoy_growth double, main_business_revenue double, net_profit double, total_profit double")


def reasons(sheets):
    return {(r.column_name, r.report_period): r.reason for r in quality.cell_issues(quality.judge_all(sheets)).collect()}


def test_profit_above_revenue_is_cleared(spark):
    df = spark.createDataFrame([(1, "000001", "甲", "2024FY", 500.0, None, 480.0, 900.0, 950.0)], INCOME)
    judged = quality.judge_all({"income_sheet": df})
    clean = quality.sanitize(judged)["income_sheet"].collect()[0]
    assert clean.net_profit is None and clean.total_profit is None and clean.total_operating_revenue == 500.0
    assert quality.sanitized_rows(quality.cell_issues(judged)).collect()[0].sanitized_rows == 1


def test_scale_jump_marks_growth(spark):
    df = spark.createDataFrame([
        (1, "000001", "甲", "2023FY", 1000.0, None, 900.0, 10.0, 12.0),
        (2, "000001", "甲", "2024FY", 40000.0, 35.0, 900.0, 10.0, 12.0)], INCOME)
    balance = spark.createDataFrame([(1, "000001", "甲", "2024FY", 999999999.0, 180.0)],
                                    "serial_number long, stock_code string, stock_abbr string, report_period string, asset_total_assets double, asset_liability_ratio double")
    got = reasons({"income_sheet": df, "balance_sheet": balance})
    assert got["operating_revenue_yoy_growth", "2024FY"] == "growth_scale_mismatch"
    assert got["total_operating_revenue", "2024FY"] == "history_scale_jump"
    assert got["asset_liability_ratio", "2024FY"] == "asset_liability_ratio_out_of_range"
    assert got["asset_total_assets", "2024FY"] == "amount_exceeds_absolute_limit"


def test_peer_percentile_is_nearest_rank(spark):
    for n in (1, 2, 4, 6, 11, 16):
        df = spark.createDataFrame([(f"{i:06d}", "x", "2024FY", float(i)) for i in range(n)],
                                   "stock_code string, stock_abbr string, report_period string, net_profit double")
        r = quality.peer_profile({"income_sheet": df}).collect()[0]
        assert (r.peer_count, r.p90, r["median"]) == (n, float(round((n - 1) * 0.9)), (n - 1) / 2)


def test_cash_flow_anchor_comes_from_the_other_tables(spark):
    cash = spark.createDataFrame([("000001", "甲", "2024FY", 300.0)], "stock_code string, stock_abbr string, report_period string, operating_cf_net_amount double")
    income = spark.createDataFrame([("000001", "甲", "2024FY", 500.0)], "stock_code string, stock_abbr string, report_period string, total_operating_revenue double")
    sheets = {"cash_flow_sheet": cash, "income_sheet": income}
    assert quality.cell_issues(quality.judge_all(sheets)).count() == 0
    assert quality.cell_issues(quality.judge_all(sheets, parity=True)).collect()[0].reason == "cashflow_scale_mismatch"


def test_peers_are_ranked_exactly_with_equal_close_and_odd_values(spark):
    schema = "stock_code string, stock_abbr string, report_period string, net_profit double"
    values = {
        "2024FY": [0.0] * 40 + [float(i % 7) - 3 for i in range(60)],
        "2023FY": [1000 + i / 1000 for i in range(50)],  # all in one bin
        "2022HY": [-1e300, 1e300, float("inf"), 5.0, float("-inf")],
        "abc": [1.0, 2.0, 3.0, 40.0],  # a period that is no code
    }
    rows = [(f"{i:06d}", "x", p, v) for p, vs in values.items() for i, v in enumerate(vs)]
    got = {r.report_period: r for r in quality.peer_profile({"income_sheet": spark.createDataFrame(rows, schema)}).collect()}
    assert sorted(got) == sorted(p.upper() for p in values)
    for p, vs in values.items():
        vs, n, r = sorted(vs), len(vs), got[p.upper()]
        assert (r.peer_count, r["median"], r.p90) == (n, (vs[(n - 1) // 2] + vs[n // 2]) / 2, vs[round((n - 1) * 0.9)])


def test_few_peer_cells_are_sorted(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    ranks = quality.group_ranks
    monkeypatch.setattr(quality, "group_ranks", lambda df, *rest: seen.append(df.count()) or ranks(df, *rest))
    df = spark.range(20000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("stock_code"), F.lit("2024FY").alias("report_period"), (F.col("id") + 1.0).alias("net_profit"))
    r = quality.peer_profile({"income_sheet": df}).collect()[0]
    assert (r["median"], r.p90) == (10000.5, 18000.0) and seen[0] < 200


def test_rules_run_in_methods_that_the_jvm_compiles(spark):
    from ledgerlane.session import tune

    assert tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
