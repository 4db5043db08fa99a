import os

from pyspark.sql import functions as F

from ledgerlane.operators import resolution
from ledgerlane.sources import stores, tables

ROWS = "stock_code string, report_period string, net_profit double, report_year string"


def load(spark, path, rows, years=None):
    schema = tables.statement_schema("income_sheet", [("net_profit", "decimal(18,2)")])
    stores.write_statements(spark.createDataFrame(rows, ROWS), schema, path, "income_sheet", years)
    return schema


def held(spark, path, schema, **which):
    return sorted((r.serial_number, r.stock_code, r.report_period, r.net_profit) for r in stores.read_statements(spark, path, schema, "income_sheet", **which).collect())


def test_a_partial_load_replaces_its_years_and_moves_the_numbers(spark, tmp_path):
    at = str(tmp_path / "store")
    schema = load(spark, at, [("1", "2023FY", 1.0, "2023"), ("1", "2024Q1", 2.0, "2024"), ("2", "2023HY", 3.0, "2023"), ("2", "odd", None, None)])
    assert [r[0] for r in held(spark, at, schema)] == [1, 2, 3, 4]
    untouched = {f: os.path.getmtime(f) for f in files(at, "2024")}
    load(spark, at, [("1", "2023Q1", 5.0, "2023"), ("1", "2022FY", 9.0, "2022")], years=["2023"])
    now = held(spark, at, schema)
    assert {r[1:] for r in now} == {("1", "2023Q1", 5.0), ("1", "2024Q1", 2.0), ("2", "odd", None)}  # 2022 is not part of the load
    assert [r[0] for r in now] == [1, 2, 3]
    assert {f: os.path.getmtime(f) for f in files(at, "2024")} == untouched
    assert held(spark, at, schema, years=[2024]) == [(2, "1", "2024Q1", 2.0)]


def files(at, year):
    top = f"{at}/part_table=income_sheet/part_year={year}"
    return [f"{top}/{f}" for f in os.listdir(top)] if os.path.isdir(top) else []


def test_a_load_without_rows_empties_its_part_only(spark, tmp_path):
    at = str(tmp_path / "store")
    schema = load(spark, at, [("1", "2023FY", 1.0, "2023"), ("1", "2024FY", 2.0, "2024")])
    load(spark, at, [], years=[2024])
    assert [r[2] for r in held(spark, at, schema)] == ["2023FY"] and not files(at, "2024")
    load(spark, at, [])
    assert held(spark, at, schema) == []


def test_a_store_that_is_not_there_is_empty(spark, tmp_path):
    schema = tables.statement_schema("income_sheet", [("net_profit", "double")])
    assert held(spark, str(tmp_path / "none"), schema) == []


def test_own_numbers_stay_and_repeated_rows_are_kept(spark, tmp_path):
    at = str(tmp_path / "store")
    schema = tables.statement_schema("income_sheet", [("net_profit", "double")])
    rows = spark.createDataFrame([(70, "1", "2023FY", 1.0), (None, "1", "2023FY", 1.0), (None, "1", "2023FY", 1.0)],
                                 "serial_number long, stock_code string, report_period string, net_profit double")
    stores.write_statements(rows, schema, at, "income_sheet")
    got = [r[0] for r in held(spark, at, schema)]
    assert len(got) == 3 and 70 in got


def test_reading_a_year_opens_its_folder_only(spark, tmp_path, capsys):
    at = str(tmp_path / "store")
    schema = load(spark, at, [("1", f"{y}FY", 1.0, str(y)) for y in range(2015, 2025)])
    df = stores.read_parts(spark, at, schema, ["income_sheet"], years=[2020])
    assert df.count() == 1
    df.explain("formatted")
    pruned = [line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters")]
    assert len(pruned) == 1 and "2020" in pruned[0] and "income_sheet" in pruned[0]


def test_lineage_has_stage_and_time_and_is_replaced_by_table(spark, tmp_path):
    at = str(tmp_path / "lineage")
    cand = spark.createDataFrame(
        [(t, "1", "2024FY", "net_profit", v, p, s, "last", f"f{s}", e) for t, v, p, s, e in
         [("income_sheet", 10.0, 1, 1, "summary"), ("income_sheet", 30.0, 2, 2, "full"), ("balance_sheet", 5.0, 1, 3, None)]],
        "table_name string, stock_code string, report_period string, field_name string, value double, priority int, seq long, mode string, source_file string, source_excerpt string")
    rows = resolution.lineage(resolution.resolve_fields(cand), resolution.conflicts(cand), ("net_profit",), F.lit("t0"))
    got = {(r.table_name, r.decision): r for r in rows.collect()}
    chosen, lost = got["income_sheet", "chosen"], got["income_sheet", "replace_existing"]
    assert (chosen.extractor_stage, chosen.updated_at, chosen.candidate_extractor_stage) == ("full", "t0", "")
    assert (lost.extractor_stage, lost.candidate_extractor_stage, lost.field_value, lost.candidate_value) == ("full", "summary", 30.0, 10.0)
    assert got["balance_sheet", "chosen"].extractor_stage == ""
    stores.write_lineage(rows, at, ["income_sheet", "balance_sheet"])
    stores.write_lineage(rows.limit(0), at, ["income_sheet"])
    left = stores.read_parts(spark, at, rows.schema, ["income_sheet", "balance_sheet"]).collect()
    assert [(r.table_name, r.decision) for r in left] == [("balance_sheet", "chosen")]
