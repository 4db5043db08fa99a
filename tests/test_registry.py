import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, table

SF = "/root/testdata/sf0.001"
QUICK = ("topk_growth", "quarter_cumulative", "sign_filter", "alias_rebuild", "document_chunks", "field_conflicts", "longest_alias_match",
         "reference_lookup", "slot_carry_forward_segmented", "question_id_match", "peer_profile")


def test_every_reference_answer_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([c[0] for c in cur.description], cur.fetchall())
