import pytest
from pyspark.sql import functions as F

from ledgerlane.functions import codes, numbers, periods, questions, text


def values(spark, rows, make, schema="t string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(make(F.col("t"))).collect()]


def test_stock_codes(spark):
    got = values(spark, ["1", "SZ000999 ", "1234567", "abc", None], codes.normalize_code)
    assert got == ["000001", "000999", "1234567", "abc", ""]


def test_period_wording(spark):
    rows = ["2024年年度", "2024年半年度", "2024年第三季度", "2024 年年报", "abc", None]
    assert values(spark, rows, periods.normalize_period) == ["2024FY", "2024HY", "2024Q3", "2024FY", "ABC", ""]
    assert values(spark, ["2024FY", "2024Q4", "x"], periods.is_valid_period) == [True, False, False]
    assert values(spark, ["2024FY", "x"], periods.previous_period) == ["2023FY", None]


def test_period_order(spark):
    rows = ["2024FY", "2024Q1", "2023FY", "2024HY", "2024Q3"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").orderBy(periods.period_key(F.col("t")))
    assert [r[0] for r in df.collect()] == ["2023FY", "2024Q1", "2024HY", "2024Q3", "2024FY"]


def test_numbers(spark):
    rows = ["1,234.5", "8.12%", "3亿", "-2万", "5元", "1d", "nan", "", None, "1e3"]
    assert values(spark, rows, numbers.to_float) == [1234.5, 8.12, 3e8, -2e4, 5.0, None, None, None, None, 1000.0]


def test_publish_dates(spark):
    rows = ["46022", "20240102", "2024-01-02 10:00", "20240102.0", "soon"]
    assert values(spark, rows, codes.publish_date) == ["2025-12-31", "2024-01-02", "2024-01-02", "20240102.0", "soon"]


def test_glued_numbers(spark):
    got = values(spark, ["营业收入585,461,786.232024年"], text.clean_extracted)
    assert got == ["营业收入585,461,786.23 2024年"]
    again = values(spark, got, text.clean_extracted)
    assert again == got
    assert values(spark, ["净 利 润 1 2 , 3 4 5 . 6 7 元"], text.collapse_spaced) == ["净利润 12,345.67元"]  # 润 is no unit


def test_text_helpers(spark):
    assert values(spark, ["a b 　c "], text.normalize_text) == ["a b c"]
    assert values(spark, ["净利润 Top5"], text.tokens) == [["净利润", "净利", "利润", "top5"]]
    assert values(spark, ["一。二！ three; \n"], text.split_sentences) == [["一。", "二！", "three;"]]
    assert values(spark, ["鍑€鍒╂鼎", "净利润", ""], text.has_encoding_issue) == [True, False, False]


@pytest.mark.parametrize("n", [1, 500, 501, 920, 921, 1000, 1340, 1341])
def test_chunks_cover_the_text(spark, n):
    body = "".join(chr(97 + i % 26) for i in range(n))
    got = values(spark, [body], lambda c: text.chunks(c))[0]
    want, start = [], 0
    while True:
        want.append(body[start:start + 500])
        if start + 500 >= n:
            break
        start += 420
    assert got == want


def test_payloads(spark):
    rows = ['[{"Q": " a "}, "b", 5, {"X": 1}]', "[bad", " plain ", ""]
    assert values(spark, rows, questions.payload_questions) == [["a", "b"], ["[bad"], ["plain"], []]


def test_metric_detection_prefers_the_longest_alias(spark):
    got = values(spark, ["净利润同比增长率是多少", "利润", "无"], lambda c: questions.detect_metric(c)["metric_key"])
    assert got == ["net_profit_yoy_growth", "net_profit", None]


def test_level_overlap_equals_plain_count(spark):
    df = spark.createDataFrame([("a b a c a b", "a b x"), ("", "a"), ("z z", "z")], "q string, t string")
    q, t = text.tokens(F.col("q")), F.array_distinct(text.tokens(F.col("t")))
    rows = df.select(text.token_overlap(q, t), text.level_overlap(text.token_levels(q), t)).collect()
    assert [(r[0], r[1]) for r in rows] == [(5, 5), (0, 0), (2, 2)]
