import random

from pyspark.sql import functions as F

from ledgerlane import scale


def test_running_maximum_splits_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = scale.running(df, ["k"], ["seq"], F.floor(F.col("seq") / 37), {"m": ("max", F.col("v")), "s": ("sum", F.col("v"))})
    seen = {(r.k, r.seq): (r.m, r.s) for r in got.collect()}
    before = {}
    for k, seq, v in rows:
        past = before.setdefault(k, [])
        assert seen[k, seq] == ((max(past), sum(past)) if past else (None, None))
        past.append(v)


def test_global_numbers(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = sorted((r.n, r.a, r.b) for r in scale.global_row_number(df, ["a", "b"], "n").collect())
    assert got == [(i + 1, a, b) for i, (a, b) in enumerate(sorted(rows))]


def test_group_ranks_with_repeated_values(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else "cold", float(rng.randrange(20))) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in scale.group_ranks(df, ["g"], "v").collect():
        values = sorted(v for g, v in rows if g == r.g)
        assert values.index(r.v) + 1 == r.first_rank
        assert len(values) - values[::-1].index(r.v) == r.last_rank
        assert len(values) == r.group_rows


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    from ledgerlane import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_rank_directory_equals_a_join(spark):
    import random

    from ledgerlane.operators.lookups import compare, threshold_requests
    from ledgerlane.operators.rank_directory import RankDirectory

    rng = random.Random(4)
    facts = [(m, p, f"{i:06d}", rng.choice([None, -2.0, -1.0, 0.0, 0.0, 1.5, 3.0])) for m in "ab" for p in ("2020FY", "2021FY") for i in range(40)]
    asked = [(i, rng.choice("abc"), rng.choice(["2020FY", "2021FY", None]), rng.choice([">", ">=", "<", "<="]), rng.choice([None, -5.0, -1.0, 0.0, 1.5, 9.0])) for i in range(120)]
    f = spark.createDataFrame(facts, "metric_key string, report_period string, stock_code string, metric_value double")
    r = spark.createDataFrame(asked, "request_id int, metric_key string, report_period string, operator string, bound double")
    met = r.join(f, ["metric_key", "report_period"]).filter(compare(F.col("metric_value"), F.col("operator"), F.col("bound"))).collect()
    want = {}
    for row in met:
        want.setdefault(row.request_id, []).append((-row.metric_value, row.stock_code))
    want = {k: [code for _, code in sorted(v)] for k, v in want.items()}
    for limit in (None, 1, 7):
        got = {}
        for row in threshold_requests(r, f, limit).collect():
            got.setdefault(row.request_id, {})[row.position] = row.stock_code
        assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: v[:limit] for k, v in want.items()}
        assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())
    counts = {row.request_id: row.n_met for row in RankDirectory(r, f).counts().collect()}
    assert counts == {i: len(want.get(i, [])) for i in range(120)}
    assert threshold_requests(r, f.limit(0)).count() == 0 and threshold_requests(r.limit(0), f).count() == 0
