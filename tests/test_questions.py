from pyspark.sql import functions as F

from ledgerlane.functions import questions
from ledgerlane.operators import answers, conversation, facts, lookups, matching, ranking, tagging


def tags(spark, *asked):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, question string")
    return tagging.tag_questions(df).orderBy("i").collect()


def test_pipelines(spark):
    a, b, c, d = tags(spark, "2024年利润top5企业，其中同比增幅最大的是哪家？", "甲公司近三年的主营业务收入变化趋势并分析原因",
                      "哪些公司资产负债率超过60%且最高", "甲公司2024年净利润是多少")
    assert a.intents == ["ranking", "yoy", "maxmin"] and a.pipeline == "ranking_yoy_max_pipeline" and a.top_k == 5
    assert b.pipeline == "trend_then_attribution" and b.intents == ["trend", "attribution"]
    assert c.pipeline == "fragment_split" or c.pipeline == "threshold_then_extreme"
    assert d.intents == ["single_value"] and d.metric.metric_key == "net_profit" and d.period.report_period == "2024FY"


def test_threshold_reads_negated_words_first(spark):
    df = spark.createDataFrame([("资产负债率不超过60%",), ("净利润超过2亿",), ("净利润为负数",), ("净利润",)], "q string")
    got = [r[0] for r in df.select(lookups.threshold(F.col("q"), F.lit("net_profit"), F.lit("净利润"))).collect()]
    assert (got[0].operator, got[0].bound) == ("<=", 0.006)
    assert (got[1].operator, got[1].bound) == (">", 20000.0)
    assert (got[2].operator, got[2].bound) == ("<", 0.0) and got[3] is None


def test_names_beat_fragments_and_codes_stand_alone(spark):
    companies = spark.createDataFrame([("000001", "甲乙制造", "甲乙制造股份有限公司"), ("000002", "丙丁贸易", "丙丁贸易有限公司")],
                                      "stock_code string, stock_abbr string, company_name string")
    asked = spark.createDataFrame([(1, "甲乙的利润"), (2, "2021年000002的利润"), (3, "1000002元"), (4, "丙丁贸易和甲乙")], "i int, question string")
    got = matching.best_company(asked, ["i"], "question", matching.alias_table(companies))
    assert {r.i: r.stock_code for r in got.collect()} == {1: "000001", 2: "000002", 4: "000002"}


def test_scan_and_gram_join_find_the_same(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["甲公司利润增长", "abcabcabd", "xyz", "公司", "ab"])], "i int, t string")
    names = spark.createDataFrame([(n,) for n in ["公司", "利润增长", "abca", "ab", "cabd", "zz", "abcabcabd"]], "n string")
    pairs = lambda df: sorted((r.i, r.n) for r in df.collect())
    a = pairs(matching.contains_match(texts, ["i"], "t", names, "n"))
    b = pairs(matching.gram_match(texts, ["i"], "t", names, "n"))
    assert a == b == sorted((i, n) for i, t in enumerate(["甲公司利润增长", "abcabcabd", "xyz", "公司", "ab"])
                            for n in ["公司", "利润增长", "abca", "ab", "cabd", "zz", "abcabcabd"] if n in t)


def test_slots_carry_over_and_segments_do_not_matter(spark):
    asked = ["甲公司2024年净利润是多少", "2023年呢", "那主营业务收入呢", "国家医保目录新增产品有哪些", "它的净利润呢", "2024年净利润top5企业是哪些", "其中最高的是谁"]
    rows = [(1, i, q, "000001" if "甲公司" in q else None) for i, q in enumerate(asked)]
    df = spark.createDataFrame(rows, "conv_id int, turn long, question string, stock_code string")
    signals = conversation.turn_signals(df)
    whole = [tuple(r) for r in conversation.carry_slots(signals).orderBy("turn").collect()]
    split = [tuple(r) for r in conversation.carry_slots(signals, fan=2).orderBy("turn").collect()]
    assert whole == split
    by = conversation.carry_slots(signals).orderBy("turn").collect()
    assert (by[1].follow_up, by[1].stock_code, by[1].metric_key, by[1].report_period) == (True, "000001", "net_profit", "2023FY")
    assert by[2].metric_key == "main_business_revenue" and by[2].report_period == "2023FY"
    assert by[3].follow_up is False and by[3].stock_code is None
    assert by[4].stock_code == "000001" and by[4].set_kind == 1


def statements(spark):
    rows = [("000001", "甲", "2023FY", 503.0, 64.0), ("000001", "甲", "2024FY", 611.0, 88.0), ("000002", "乙", "2023FY", 472.0, 60.0),
            ("000002", "乙", "2024FY", 655.0, 97.0), ("000003", "丙", "2024FY", 701.0, 131.0)]
    return spark.createDataFrame(rows, "stock_code string, stock_abbr string, report_period string, total_operating_revenue double, net_profit double")


def test_ranking_with_growth(spark):
    rows = ranking.top_k_growth(statements(spark), "net_profit", "2024FY", 3).orderBy("position").collect()
    assert [r.stock_code for r in rows] == ["000003", "000002", "000001"]
    assert rows[0].yoy is None and rows[0].yoy_status == "unknown"
    assert round(rows[1].yoy, 2) == 61.67 and rows[1].best_grower and not rows[2].best_grower


def test_answers_and_export(spark):
    sheet = statements(spark)
    f = facts.table_facts(sheet, "income_sheet")
    companies = spark.createDataFrame([(c, n, n + "公司") for c, n in (("000001", "甲厂"), ("000002", "乙厂"), ("000003", "丙厂"))],
                                      "stock_code string, stock_abbr string, company_name string")
    q = spark.createDataFrame([("B1001", '[{"Q": "甲厂2024年净利润是多少"}, {"Q": "那2023年呢"}]'), ("B1002", "2024年净利润top2企业")], "question_id string, payload string")
    planned = answers.plan_answers(answers.explode_payloads(q), matching.company_names(companies), f)
    out = answers.answer_all(planned, f, companies, lookups.latest_fy(sheet))
    rows = {(r.question_id, r.seq): r for r in out.collect()}
    assert rows["B1001", 0].content == "甲厂2024FY的净利润为：88.00万元"
    assert rows["B1001", 1].content == "甲厂2023FY的净利润为：64.00万元"
    assert rows["B1002", 0].content.startswith("2024FY的净利润排名结果如下：1. 丙（000003）: 131.00万元")
    export = answers.export_rows(answers.assemble(out), q)
    assert export.columns == ["编号", "问题", "SQL查询语句", "图形格式", "回答"]
    cells = {r["编号"]: r for r in export.collect()}
    assert cells["B1002"]["图形格式"] == "柱状图" and cells["B1001"]["图形格式"] == "无"
    assert '"Q":"那2023年呢"' in cells["B1001"]["回答"]
    assert answers.export_rows(answers.assemble(out), q, "task3").columns == ["编号", "问题", "SQL查询语句", "回答"]
    assert answers.export_variant(q) == "task2"


def test_trend_wording(spark):
    from ledgerlane.operators import trend

    series = {
        "a": [("2022FY", 9.0), ("2023FY", 4.0), ("2024FY", 6.0)], "b": [("2024FY", 5.0)],
        "c": [("2023FY", 9.0), ("2024Q1", 7.0), ("2024HY", 3.0), ("2024Q3", 8.0)],
        "d": [("2023HY", 8.0), ("2023Q3", 6.0), ("2023FY", 7.0), ("2024Q1", 5.0), ("2024HY", 4.0), ("2024Q3", 3.0)],
    }
    rows = [(k, p, v, len(s) - i) for k, s in series.items() for i, (p, v) in enumerate(s)]
    shapes = trend.trend_shape(spark.createDataFrame(rows, "stock_code string, report_period string, value double, back int"))
    said = trend.trend_text(F.col("stock_code"), F.lit("利润"), lambda x: x.cast("string"))
    got = {r.stock_code: r.said for r in shapes.select("stock_code", said.alias("said")).collect()}
    assert got == {
        "a": "a2022-2024年的利润呈“V型反转强波动走势”，2023FY为阶段低点（4.0），2022FY为阶段高点（9.0）。",
        "b": "b利润目前仅有2024FY一期数据（5.0）",
        "c": "c2023-2024年（截至2024Q3）的利润呈“V型反转强波动走势”，2023FY至2024HY持续回落并在2024HY触底，此后持续修复至2024Q3。",
        "d": "d2023-2024年（截至2024Q3）的利润呈“波动走势”，2024Q3为阶段低点，2024Q1至2024Q3季度主要表现为回落。",
    }


def test_repeated_question_ids_keep_their_own_answers(spark):
    from ledgerlane.operators import answers

    rows = [("B1", '[{"Q": "甲"}, {"Q": "乙"}]'), ("B1", '[{"Q": "丙"}]'), ("B1", '[{"Q": "丙"}]'), (None, '[{"Q": "丁"}]')]
    asked = answers.explode_payloads(spark.createDataFrame(rows, "question_id string, payload string"))
    got = asked.groupBy("row_key", "question_id").agg(F.array_sort(F.collect_list("question")).alias("q")).collect()
    assert sorted((r.question_id or "", r.q) for r in got) == [("", ["丁"]), ("B1", ["丙"]), ("B1", ["丙"]), ("B1", ["乙", "甲"])]


def answered(spark, rows, **options):
    sheet = statements(spark)
    f = facts.table_facts(sheet, "income_sheet")
    companies = spark.createDataFrame([("000001", "甲厂", "甲厂公司"), ("000002", "乙厂", "乙厂公司"), ("000003", "丙厂", "丙厂公司")],
                                      "stock_code string, stock_abbr string, company_name string")
    steps = answers.explode_steps(spark.createDataFrame(rows, "question_id string, payload string"))
    planned = answers.plan_answers(steps, matching.company_names(companies), f)
    return answers.answer_all(planned, f, companies, lookups.latest_fy(sheet), **options)


def test_steps_read_the_company_set_of_the_ranking_before(spark):
    rows = [
        ("s", '["2024年净利润top2企业", "这些公司里2024年净利润最低的是哪家", "这些公司里2024年净利润同比增幅最大的是哪家", "这些公司里2023年净利润最高的是哪家"]'),
        ("alone", '["2024年净利润top1企业", "这些公司里2024年净利润最低的是哪家"]'),
        ("none", '["2019年净利润top3企业", "2024年净利润最低的是哪家"]'),
        ("other", '["这些公司里2024年净利润最低的是哪家"]'),
    ]
    got = {(r.question_id, r.seq): (r.route, r.content) for r in answered(spark, rows).collect()}
    assert got["s", 1] == ("set_extreme", "在上一轮命中的 2 家公司里，2024FY净利润最低的是乙，为 97.00万元。")
    assert got["s", 2] == ("set_extreme", "在上一轮命中的 2 家公司里，2024FY净利润同比增幅最高的是乙，为 61.67%。")
    assert got["s", 3] == ("set_extreme", "在上一轮命中的 2 家公司里，2023FY净利润最高的是乙，为 60.00万元。")
    assert all(got[k, 1][0] != "set_extreme" for k in ("alone", "none")) and got["other", 0][0] != "set_extreme"


def test_ranking_with_growth_and_compound_questions(spark):
    rows = [("g", "2024年净利润top3企业中同比增幅最大的是哪家"), ("c", "甲厂2024年的净利润是多少，2023年的净利润是多少"), ("c", "甲厂2024年的净利润是多少，2023年的净利润是多少")]
    got = answered(spark, rows).orderBy("question_id", "seq").collect()
    assert [r.question_id for r in got] == ["c", "c", "g"]
    assert got[0].content == "1. 甲厂2024FY的净利润为：88.00万元\n2. 甲厂2023FY的净利润为：64.00万元" and got[0].content == got[1].content
    assert got[0].sql.split("\n\n")[1] == "SELECT net_profit FROM income_sheet WHERE stock_code = '000001' AND report_period = '2023FY'"
    assert got[2].content == ("2024FY Top3 企业中，净利润同比增幅最高的是乙，为 61.67%。\n1. 丙：131.00万元，同比未知\n"
                              "2. 乙：97.00万元，同比61.67%\n3. 甲：88.00万元，同比37.50%")
    assert got[2].chart == "柱状图" and got[2].sql.endswith("LIMIT 3")


def test_threshold_answers_list_all_unless_cut(spark):
    rows = [("t", "2024年净利润超过1的公司有哪些")]
    assert answered(spark, rows).first().content.count("；") == 2
    assert answered(spark, rows, listed=1).first().content.count("；") == 0


def test_statement_text_quotes_values(spark):
    from ledgerlane.operators.statements_sql import quoted

    assert spark.range(1).select(quoted(F.lit("o'x"))).first()[0] == "'o''x'"


def test_long_questions_are_cut_in_one_pass(spark):
    """A question of 40,000 characters that names no drawing: minutes, when the pattern starts anew at every character."""
    import time

    long = "abc de " * 5700
    df = spark.createDataFrame([(0, "先绘图再解释"), (1, "甲\n乙绘图然后丙"), (2, "绘图再乙"), (3, long)], "i int, q string")
    start = time.monotonic()
    got = {r.i: r.f for r in df.select("i", questions.fragments(F.col("q")).alias("f")).collect()}
    assert time.monotonic() - start < 15
    assert got == {0: ["先绘图", "解释"], 1: ["甲 乙绘图", "丙"], 2: ["绘图再乙"], 3: [long.strip()]}


def test_names_meet_texts_alike_for_few_and_many(spark, monkeypatch):
    """Read off by a pattern, sent to the texts, or met by salted n-grams: the same pairs; texts are never broadcast."""
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["甲公司利润增长", "abcabcabd", "a.b(c", "公司", "ab", "la lacio lab", "x000002", "7000002", "é lac\nlab", "lacilab", ""])], "i int, t string")
    names = spark.createDataFrame([(n,) for n in [
        "公司", "利润增长", "abca", "ab", "cabd", "zz", "abcabcabd", "la", "lac", "lab", "lacio", "a.b(", "000002", "é lac\nla"]], "n string")
    want = sorted((r.i, r.n) for r in texts.crossJoin(names).filter(F.contains("t", "n")).collect())
    company = names.select(F.col("n").alias("alias"), F.col("n").alias("stock_code"), F.lit(1).alias("tier"))
    plans, best = [], []
    for read, few in ((2000, 50_000), (0, 50_000), (0, 0)):
        monkeypatch.setattr(matching, "READ_NAMES", read)
        monkeypatch.setattr(matching, "FEW_NAMES", few)
        df = matching.contains_match(texts, ["i"], "t", names, "n")
        assert sorted((r.i, r.n) for r in df.collect()) == want
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        best.append({r.i: r.alias for r in matching.best_company(texts, ["i"], "t", company).collect()})
    assert best[0] == best[1] == best[2] and best[0][6] == "000002" and 7 not in best[0] and best[0][9] == "lac"
    assert "SortMergeJoin [i" in plans[2] and all("BroadcastHashJoin [i" not in p for p in plans)


def test_answer_joins_do_not_trust_guessed_sizes(spark):
    """Companies and questions in small files: no join on them may be planned as a broadcast."""
    companies = spark.createDataFrame([("000001", "甲公司", "甲公司股份", "制造")], "stock_code string, stock_abbr string, company_name string, industry string")
    values = spark.createDataFrame([("000001", "甲公司", "2020FY", "net_profit", 5.0)],
                                   "stock_code string, stock_abbr string, report_period string, metric_key string, metric_value double")
    asked = spark.createDataFrame([("q1", "甲公司2020年的净利润是多少"), ("q2", "甲公司净利润最新是多少"), ("q3", "甲公司近三年的净利润变化趋势")], "question_id string, payload string")
    planned = answers.plan_answers(answers.explode_steps(asked), matching.company_names(companies), values)
    out = answers.answer_all(planned, values, companies, lookups.latest_fy(values))
    plan = answers.export_rows(answers.assemble(out), asked)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not [j for j in joins if "BroadcastHashJoin [company" in j or "BroadcastHashJoin [row_key" in j]


def test_threshold_answers_of_the_queries_list_every_company(spark, monkeypatch):
    """99 of the 100 suppliers of sf0.01 meet the bound: the answers and their SQL list them all, not the first 50."""
    import duckdb

    from ledgerlane.plans import question_queries as Q

    asked = {}
    monkeypatch.setattr(answers, "explode_steps", lambda *a, **k: None)
    monkeypatch.setattr(answers, "plan_answers", lambda *a, **k: None)
    monkeypatch.setattr(answers, "answer_all", lambda *a, **k: asked.update(k))
    Q._answers(spark, "/root/testdata/sf0.001")
    assert asked.get("listed") is None
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    told = con.execute(f"SELECT content FROM ({Q.ANSWERS} SELECT * FROM ans) WHERE question_id = 'c1'").fetchone()[0]
    assert "共99家" in told and told.count("；") == 98 and "；99. " in told
