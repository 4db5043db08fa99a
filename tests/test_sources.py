from ledgerlane.operators import companies
from ledgerlane.sources import tables


def test_schema_from_a_dictionary():
    schema = tables.statement_schema("income_sheet", [("net_profit", "decimal(18,2)"), ("", "int"), ("note", "varchar(9)"), ("n", "bigint"), ("d", "datetime")])
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    assert list(kinds)[:4] == ["serial_number", "stock_code", "stock_abbr", "report_period"]
    assert kinds["net_profit"] == "double" and kinds["note"] == "string" and kinds["n"] == "bigint" and kinds["d"] == "string"
    assert kinds["total_profit"] == "double"


def test_csv_layers_replace_by_name(spark, tmp_path):
    seed, manual = tmp_path / "seed", tmp_path / "manual"
    seed.mkdir(), manual.mkdir()
    schema = tables.T.StructType.fromDDL("year string, amount double")
    (seed / "facts.csv").write_text("﻿year,amount\n2024,\n2023,1.5\n", encoding="utf-8")
    (seed / "other.csv").write_text("a\n1\n", encoding="utf-8")
    (manual / "facts.csv").write_text("year,amount\n", encoding="utf-8")
    out = tables.layered_csv(spark, [str(seed), str(manual), str(tmp_path / "absent")], {"facts": schema}, {})
    assert sorted((r.year, r.amount) for r in out["facts"].collect()) == [("2023", 1.5), ("2024", None)]
    assert "other" not in out


def test_company_headers(spark):
    raw = spark.createDataFrame([("1", "999", "甲", "甲公司")], "`序号` string, `股票代码` string, `A股简称` string, `公司名称` string")
    r = tables.load_companies(raw).collect()[0]
    assert (r.serial_number, r.stock_code, r.stock_abbr, r.industry) == (1, "000999", "甲", "")


def test_unknown_company_is_covered_by_the_alias_table(spark):
    seen = spark.createDataFrame([("income_sheet", "301888", "新股")], "table_name string, stock_code string, stock_abbr string")
    master = spark.createDataFrame([("000001",)], "stock_code string")
    aliases = companies.rebuild_aliases(seen, master)
    r = companies.missing_in_master(seen, master, aliases).collect()[0]
    assert r.status == "covered_by_alias_table" and r.alias_source_table == "income_sheet"


def test_preview_pages(spark):
    df = spark.range(30)
    assert [r.id for r in tables.preview(df, ["id"], page=2, page_size=1).collect()] == ["5", "6", "7", "8", "9"]
