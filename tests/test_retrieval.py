from ledgerlane.operators import chunking, retrieval


def test_evidence_for_a_cause_question(spark):
    chunks = spark.createDataFrame([
        (1, "stock_research_pdf", "甲公司深度报告", "000001", "甲公司", "2024FY", "r/1.pdf", 0, "甲公司主营业务收入增长的原因是新品放量和渠道改善。其余内容与此无关。"),
        (2, "stock_research_pdf", "乙公司点评", "000002", "乙公司", "2024FY", "r/2.pdf", 0, "乙公司主营业务收入下滑的原因是需求不足。"),
        (3, "industry_research_pdf", "行业报告", "", "", "", "r/3.pdf", 0, "甲公司所在行业主营业务收入增长的原因说明。"),
    ], "chunk_id long, source_type string, title string, stock_code string, stock_name string, report_period string, file_path string, chunk_index int, text string")
    requests = spark.createDataFrame([(1, "甲公司主营业务收入上升原因", True, "000001", "甲公司", "甲公司股份"), (2, "zzz", False, None, None, None)],
                                     "request_id long, question string, prefer_causes boolean, stock_code string, stock_abbr string, company_name string")
    got = {r.request_id: r for r in retrieval.retrieve(requests, chunks).collect()}
    assert got[1].status == "answered" and got[1].references[0].paper_path == "r/1.pdf"
    assert got[1].summary == "甲公司主营业务收入增长的原因是新品放量和渠道改善。"
    assert got[2].status == "no_match" and got[2].references is None


def test_themes_take_the_first_clean_sentence(spark):
    chunks = spark.createDataFrame([
        ("000001", "stock_research_pdf", "t", "r/2.pdf", 0, "渠道库存恢复正常水平。"), ("000001", "stock_research_pdf", "t", "r/1.pdf", 1, "新品带来明显的增量收入。"),
    ], "stock_code string, source_type string, title string, file_path string, chunk_index int, text string")
    rows = retrieval.theme_sentences(chunks).collect()
    assert {r.theme: r.sentence for r in rows} == {"处方药业务逐步恢复": "渠道库存恢复正常水平。", "新品放量和渠道改善": "新品带来明显的增量收入。"}


def test_report_scan_keeps_only_the_stem_of_oversized_files(spark):
    files = spark.createDataFrame([("d/000001_20250331.pdf", 10, "2024年年度报告"), ("d/甲：2023年半年度报告.pdf", 30_000_000, "x")], "path string, length long, text string")
    a, b = chunking.scan_reports(files).orderBy("file_path").collect()
    assert (a.stock_code, a.report_period, a.report_date, a.readable) == ("000001", "2024FY", "2025-03-31", True)
    assert (b.stock_name, b.title, b.report_period, b.readable, b.text) == ("甲", "2023年半年度报告", "2023HY", False, "甲：2023年半年度报告")


def test_scored_text_is_cut_once(spark):
    """A question and a text of 6,000 words: the text is not cut into tokens again for each word of the question."""
    import time

    from pyspark.sql import functions as F

    from ledgerlane.functions.text import score_text

    words = " ".join(f"w{i}" for i in range(6000))
    df = spark.createDataFrame([(words + " other", words)], "q string, t string")
    start = time.monotonic()
    assert df.select(score_text(F.col("q"), F.col("t")).alias("s")).first().s == 6000.0
    assert time.monotonic() - start < 8


def test_pairs_are_narrow_and_any_number_of_lists_gives_the_same(spark, monkeypatch):
    schema = "chunk_id long, source_type string, title string, stock_code string, stock_name string, report_period string, file_path string, chunk_index int, text string"
    chunks = spark.createDataFrame([(i, "stock_research_pdf", "甲公司报告", f"00000{i % 3}", "甲乙丙"[i % 3] + "公司", "2024FY", f"r/{i}.pdf", i, "主营业务收入增长的原因是新品放量。") for i in range(12)], schema)
    requests = spark.createDataFrame([(1, "甲公司主营业务收入上升原因", True, "000000", "甲公司", "甲公司"), (2, "主营业务收入增长", False, None, None, None)],
                                     "request_id long, question string, prefer_causes boolean, stock_code string, stock_abbr string, company_name string")
    got = []
    for few in (retrieval.FEW_LISTS, 0):
        monkeypatch.setattr(retrieval, "FEW_LISTS", few)
        prepared = retrieval.prepare_requests(requests)
        rows = retrieval.scored(prepared, chunks, retrieval.candidates(prepared, chunks))
        assert not {"text", "question", "query_tokens", "title"} & set(rows.columns)
        got.append(sorted(map(tuple, rows.collect())))
    assert got[0] == got[1] and len({r[:2] for r in got[0]}) == len(got[0]) > 12


def _case(spark):
    schema = "chunk_id long, source_type string, title string, stock_code string, stock_name string, report_period string, file_path string, chunk_index int, text string"
    kinds = ("stock_research_pdf", "industry_research_pdf", "financial_report_pdf", "company_profile")
    words = ("利润", "收入", "增长", "新品", "渠道")
    chunks = spark.createDataFrame([
        (i * 7 % 101, kinds[i % 4], f"报告{i % 3}", f"00000{i % 5}" if i % 11 else None, f"公司{i % 6}", f"{2020 + i % 3}FY" if i % 13 else None, f"r/{i}.pdf", i % 9,
         "。".join(w * (1 + i % 2) for j, w in enumerate(words) if (i >> j) % 2 or i % 7 == j)) for i in range(101)], schema)
    requests = spark.createDataFrame([
        (1, "利润增长的原因", True, "000001", "公司1", "公司2"), (2, "收入", False, None, None, None), (3, "2021年渠道和新品 渠道 渠道 渠道 渠道 渠道", False, None, None, None),
        (4, "利润", False, "000003", "公司4", "公司4"), (5, "zzz", False, None, None, None)],
        "request_id long, question string, prefer_causes boolean, stock_code string, stock_abbr string, company_name string")
    return chunks, requests


def test_limited_candidates_are_the_first_of_all(spark, monkeypatch):
    """Read in blocks that grow and cut where a list has its number: the first of what no limit finds, in the candidate order."""
    from pyspark.sql import functions as F

    chunks, requests = _case(spark)
    every = retrieval.candidates(retrieval.prepare_requests(requests), chunks).collect()
    limits = (7, 5, 6)
    number = {1: 7, 2: 6, 3: 6, 4: 7, 5: 6}
    want = sorted((r.request_id, r.chunk_id, r.candidate_rank) for r in every if r.candidate_rank <= number[r.request_id])
    monkeypatch.setattr(retrieval, "GROWTH", 2)
    for first, few in ((3, retrieval.BLOCK_LISTS), (4096, 20)):
        monkeypatch.setattr(retrieval, "FIRST_BLOCK", first)
        monkeypatch.setattr(retrieval, "BLOCK_LISTS", few)
        prepared, placed = retrieval.prepare_requests(requests, limits=limits), retrieval.in_order(chunks)
        got = retrieval.candidates(prepared, placed, limits).join(placed.select("pos", "chunk_id"), "pos")
        assert sorted((r.request_id, r.chunk_id, r.candidate_rank) for r in got.collect()) == want
    assert len(every) > len(want) > 20 and placed.agg(F.max("pos")).first()[0] == 101


def test_scores_are_those_of_the_texts(spark, monkeypatch):
    """Shared tokens by hashes in levels, requests sent in parts: the same as counting the question's tokens one by one; no question is shuffled."""
    from pyspark.sql import functions as F

    from ledgerlane.functions import text as T

    chunks, requests = _case(spark)
    prepared = retrieval.prepare_requests(requests, limits=(50, 50, 50))
    placed = retrieval.in_order(chunks)
    picked = retrieval.candidates(prepared, placed, (50, 50, 50))
    got = []
    for many in (50_000, 2):
        monkeypatch.setattr(retrieval, "MANY_REQUESTS", many)
        rows = retrieval.scored(prepared, placed, picked)
        got.append(sorted(map(tuple, rows.collect())))
    assert got[0] == got[1] and {r[0] for r in got[0]} == {1, 2, 3, 4}
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert "asked" not in "".join(x for x in plan.splitlines() if "SortMergeJoin" in x) and "BroadcastHashJoin [request_id" in plan
    whole = T.normalize_text(F.concat_ws(" ", "title", "text"))
    plain = prepared.filter("request_id = 3").select("query_tokens", "asked", "terms").crossJoin(placed.select("chunk_id", whole.alias("t")))
    plain = {r.chunk_id: r for r in plain.select("chunk_id", T.score_text(F.col("asked"), F.col("t"), F.col("query_tokens")).alias("s"),
                                                 F.size(F.filter("terms", lambda w: F.contains("t", w))).alias("h")).collect()}
    third = [r for r in got[0] if r[0] == 3]
    assert third and all(round(r[2] - plain[r[1]].s - min(plain[r[1]].h, 4) * 1.2, 9) == 0 for r in third)


def test_themes_are_judged_before_companies_are_met(spark):
    """Companies that share a chunk: its sentences are cut once, below the join with the companies; each gets its own first sentence."""
    from ledgerlane.operators import attribution

    chunks = spark.createDataFrame([
        (1, "stock_research_pdf", "t", "000001", "甲", "2024FY", "r/2.pdf", 0, "渠道库存恢复正常水平。"), (2, "stock_research_pdf", "t", "000002", "乙", "2024FY", "r/1.pdf", 0, "渠道库存恢复相当缓慢。"),
    ], "chunk_id long, source_type string, title string, stock_code string, stock_name string, report_period string, file_path string, chunk_index int, text string")
    requests = spark.createDataFrame([("000001", "乙", "甲公司"), ("000003", "甲", None), ("000004", "丙", "丙公司")], "stock_code string, stock_abbr string, company_name string")
    told = attribution.company_themes(requests, chunks)
    assert {r.stock_code: r.theme_references[0].paper_path for r in told.collect()} == {"000001": "r/1.pdf", "000003": "r/2.pdf"}
    plan = told._jdf.queryExecution().sparkPlan().toString().splitlines()
    join = next(i for i, x in enumerate(plan) if "Join [_scope" in x)
    assert next(i for i, x in enumerate(plan) if "posexplode" in x) > join
