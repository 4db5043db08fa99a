import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import extraction as X


def annual(spark, tokens):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    return X.read_annual(df, "t").collect()[0].row


def periodic(spark, tokens):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    return X.read_periodic(df, "t").collect()[0].row


def test_annual_row(spark):
    r = annual(spark, ["412,300,155.60", "398,770,021.45", "3.39", "371,902,880.05"])
    assert (r.current, r.previous, r.yoy, r.previous2) == (412300155.60, 398770021.45, 3.39, 371902880.05)
    r = annual(spark, ["18,204,771.30", "-9,115,240.75", "不适用", "27,660,318.90"])
    assert r.current == 18204771.30 and r.yoy is None and r.previous2 == 27660318.90


def test_annual_short_rows(spark):
    assert annual(spark, ["120", "100"]).yoy is None
    assert annual(spark, ["120", "100", "20%"]).yoy == 20.0
    assert annual(spark, []).current is None


def test_periodic_layouts(spark):
    r = periodic(spark, ["100", "90", "95", "5.2%", "300", "280", "285", "5.3%"])
    assert (r.current, r.current_yoy, r.ytd, r.ytd_yoy) == (100, 5.2, 300, 5.3)
    r = periodic(spark, ["100", "5.0%", "300", "6.0%"])
    assert (r.current, r.current_yoy, r.ytd, r.ytd_yoy) == (100, 5.0, 300, 6.0)
    r = periodic(spark, ["1000", "900", "11.1%"])
    assert (r.current, r.current_yoy, r.ytd) == (1000, 11.1, 1000)


def test_broken_tokens_join(spark):
    df = spark.createDataFrame([(["1,2", "34.56", "7", "8.1%"],)], "t array<string>")
    assert df.select(X.merge_broken(F.col("t"))).collect()[0][0] == ["1,234.56", "7", "8.1%"]


TEXT = """证券代码：000999 证券简称：甲公司 2024年年度报告
主要会计数据和财务指标 单位：元
营业收入 5,000,000.00 4,000,000.00 25.00% 3,000,000.00
归属于上市公司股东的净利润 800,000.00 600,000.00 33.33% 500,000.00
总资产 9,000,000.00 8,000,000.00 12.50% 7,000,000.00
分季度主要财务指标
营业收入 1,000,000.00 1,000,000.00 1,500,000.00 1,500,000.00
合并利润表 四、利润总额 900,000.00 700,000.00
"""


@pytest.fixture(scope="module")
def fields(spark):
    docs = spark.createDataFrame(
        [("r/1.pdf", "甲公司2024年年度报告", TEXT, "000999", "甲公司", "2024FY", "2025-03-31", 1, True)],
        "file_path string, title string, text string, stock_code string, stock_abbr string, report_period string, report_date string, doc_seq long, readable boolean")
    from ledgerlane.operators.resolution import resolve_fields
    return {(r.field_name, r.report_period): r for r in resolve_fields(X.extract(docs)).collect()}


def test_annual_report_fields(fields):
    assert fields["total_operating_revenue", "2024FY"].value == 500.0
    assert fields["net_profit", "2024FY"].value == 80.0
    assert fields["asset_total_assets", "2024FY"].value == 900.0
    assert fields["operating_revenue_yoy_growth", "2024FY"].value == 25.0


def test_statement_body_outranks_key_data_and_quarters_fill_interim_rows(fields):
    assert fields["total_profit", "2024FY"].value == 90.0 and fields["total_profit", "2024FY"].priority == 50
    assert [fields["total_operating_revenue", p].value for p in ("2024Q1", "2024HY", "2024Q3")] == [100.0, 200.0, 350.0]


def test_numbers_of_a_snippet_are_read_once(spark):
    docs = spark.createDataFrame(
        [], "file_path string, title string, text string, stock_code string, stock_abbr string, report_period string, report_date string, doc_seq long, doc_priority int, readable boolean")
    docs = spark.createDataFrame(docs.rdd, docs.schema)  # rows that the optimizer cannot see to be none
    for make in (X.quarter_series, X.profit_candidates):
        plan = make(docs)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1


def test_broken_tokens_join_by_pairs(spark):
    rows = [
        (["1,2", "34.56", "34.56"], ["1,234.56", "34.56"]), (["12", ",345.60"], ["12,345.60"]), (["12", "-,345.60"], ["12-,345.60"]),
        (["1,2", "34.56%"], ["1,2", "34.56%"]), (["1,234", "56.7"], ["1,234", "56.7"]), (["1,2", "1,3", "4.5"], ["1,2", "1,34.5"]),
        (["不适用", "4.5"], ["不适用", "4.5"]), ([], []),
    ]
    df = spark.createDataFrame(rows, "t array<string>, want array<string>")
    for r in df.select(X.merge_broken(F.col("t")).alias("got"), "want").collect():
        assert r.got == r.want


def test_reports_need_the_two_years_before_and_lines_are_read_once(spark, tmp_path):
    from ledgerlane.plans.text_queries import report_files

    lines = [(1, y, 10.0) for y in (1995, 1996, 1997, 1999)] + [(2, 1995, 1.0), (2, 1996, None), (2, 1997, 3.0), (None, 1997, 4.0)]
    df = spark.createDataFrame(lines, "l_suppkey long, y int, l_extendedprice double").selectExpr(
        "l_suppkey", "l_extendedprice", "make_timestamp(y, 5, 1, 0, 0, 0) AS l_shipdate")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    files = report_files(spark, str(tmp_path))
    assert files._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {r.path: r.text for r in files.collect()}
    assert set(got) == {"reports/000001_20180331.pdf", "reports/000002_20180331.pdf"}
    assert "营 业收入 10.00 10.00 0.00% 10.00" in got["reports/000001_20180331.pdf"] and got["reports/000002_20180331.pdf"] is None
