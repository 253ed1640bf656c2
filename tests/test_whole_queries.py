"""Registered queries over whole tables against their SQL, on a table where an id or depth bound would lose rows."""

import os
from collections import Counter

import duckdb
import pytest

from loomgraph import workload

SF = "/root/testdata/sf0.01"
WHOLE = ["expand_into", "relationship_uniqueness", "var_length", "named_path", "common_suppliers", "distinct_aggregates", "regex_whole_match", "unwind_null", "shortest_path_by_property", "parallel_edges", "merge_relationships", "eigenvector"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables_agree_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.execute(workload.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert Counter(tuple(r[n] for n in names) for r in workload.queries()[name](spark, SF).collect()) == Counter(want.fetchall())


def test_no_query_keeps_to_an_id_range():
    for name, sql in workload.oracle_sql().items():
        assert "key < 5" not in sql or name == "create_and_match"


def test_bfs_levels_go_to_the_end(spark, tmp_path):
    chain = [(k, f"2020-01-01 00:{k:02}:00", k, "a") for k in range(8)]
    spark.createDataFrame(chain, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "to_timestamp_ntz(ts) ts", "user_id", "event_type").write.parquet(str(tmp_path / "events.parquet"))
    got = workload.queries()["bfs_levels"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(k, 1) for k in range(8)]
