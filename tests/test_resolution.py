import random

from pyspark.sql import functions as F

from ledgerlane.operators import facts, resolution

SCHEMA = ("table_name string, stock_code string, report_period string, field_name string, value double, priority int, "
          "seq long, mode string, source_file string, source_excerpt string")


def fold(rows):
    """One candidate after the other, as a person would do it."""
    current, log = None, []
    for value, priority, seq, mode, source in rows:
        if current is not None:
            held, level, _ = current
            wins = priority > level or (priority == level and (mode == "last" or (abs(held) < 1 <= abs(value))))
            if abs(held - value) > max(1.0, abs(held) * 0.05, abs(value) * 0.05):
                log.append((seq, "replace_existing" if wins else "keep_existing", held, value))
        else:
            wins = True
        if wins:
            current = (value, priority, source)
    return current, log


def test_resolution_and_conflicts_match_a_fold(spark):
    rng = random.Random(11)
    groups = {}
    for seq in range(400):
        key = "hot" if seq % 3 else f"c{seq % 4}"
        value = round(rng.choice([0.3, 0.7, -0.5, 2.0, 5.0, 9.0, 40.0]) * rng.choice([1, 1.01]), 4)
        groups.setdefault(key, []).append((value, rng.randrange(3), seq, rng.choice(["last", "reasonable"]), f"f{seq}"))
    rows = [("t", k, "2024FY", "diluted", v, p, s, m, f, "e") for k, items in groups.items() for v, p, s, m, f in items]
    df = spark.createDataFrame(rows, SCHEMA)
    won = {r.stock_code: (r.value, r.priority, r.source_file) for r in resolution.resolve_fields(df, bucket_rows=29).collect()}
    log = {}
    for r in resolution.conflicts(df, bucket_rows=29).collect():
        log.setdefault(r.stock_code, []).append((r.seq, r.decision, r.existing_value, r.candidate_value))
    for key, items in groups.items():
        current, expected = fold(items)
        assert won[key] == current
        assert sorted(log.get(key, [])) == expected


def test_last_value_of_equal_rank_wins_and_facts_carry_its_source(spark):
    rows = [("income_sheet", "000999", "2024FY", "net_profit", 100.0, 10, 1, "last", "a.pdf", "x"),
            ("income_sheet", "000999", "2024FY", "net_profit", 120.0, 30, 2, "last", "b.pdf", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    won, found = resolution.resolve_fields(df, mixed=False), resolution.conflicts(df, mixed=False)
    lineage = resolution.lineage(won, found)
    got = {r.decision: r for r in lineage.collect()}
    assert got["chosen"].field_value == 120.0 and got["chosen"].source_file == "b.pdf"
    assert got["replace_existing"].candidate_value == 100.0 and got["replace_existing"].candidate_source_file == "a.pdf"
    sheet = spark.createDataFrame([("000999", "甲", "2024FY", "", "row.pdf", "z", 120.0)],
                                  "stock_code string, stock_abbr string, report_period string, report_date string, source_file string, source_excerpt string, net_profit double")
    fact = facts.metric_facts({"income_sheet": sheet}, lineage).collect()[0]
    assert (fact.metric_label, fact.metric_value, fact.source_file) == ("净利润", 120.0, "b.pdf")


def test_quarters_add_up_past_gaps(spark):
    df = spark.createDataFrame([(None, 2.0, None, 3.0)], "a double, b double, c double, d double")
    got = df.select(*resolution.cumulative([F.col(c) for c in "abcd"])).collect()[0]
    assert tuple(got) == (None, 2.0, 2.0, 5.0)


def test_a_series_is_judged_by_what_came_before_it(spark):
    key = ("income_sheet", "000001", "2024FY", "net_profit")
    series = spark.createDataFrame(
        [(*key[:2], p, "net_profit", "2024", doc, seq, v, 0, "q", "") for doc, seq in ((2, 21), (5, 51)) for p, v in (("2024Q1", 10.0), ("2024FY", 100.0))],
        "table_name string, stock_code string, report_period string, field_name string, year string, doc int, seq int, value double, priority int, source_file string, source_excerpt string")
    claims = spark.createDataFrame([(*key, 300.0, 40, 5, "revised", "x")],
                                   "table_name string, stock_code string, report_period string, field_name string, value double, seq int, priority int, source_file string, source_excerpt string")
    for bucket in (1, 7, 1000):
        kept = resolution.veto_series(series, claims, bucket)
        assert sorted((r.doc, r.report_period) for r in kept.collect()) == [(2, "2024FY"), (2, "2024Q1")]
        row = resolution.series_conflicts(series, claims, bucket).collect()
        assert [(r.seq, r.decision, r.existing_value, r.candidate_value, r.existing_source_file) for r in row] == [(51, "keep_existing", 300.0, 100.0, "revised")]
    assert resolution.veto_series(series, claims.limit(0)).count() == 4
