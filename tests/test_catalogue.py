"""Every registered query that has SQL against that SQL in DuckDB, on the smallest tables."""

import os
from collections import Counter

import pytest

from argosieve.plans import catalogue


@pytest.fixture(scope="module")
def duck(tiny):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(tiny):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tiny}/{name}')")
    return con


def _bag(rows):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, tiny, duck, name):
    query, sql = catalogue.QUERIES[name]
    df = query(spark, tiny)
    names = sorted(df.columns)
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert _bag(tuple(r) for r in df.select(*names).collect()) == _bag(tuple(r[i] for i in order) for r in want.fetchall())


def test_ipv6_of_large_keys_equals_sql(spark, tmp_path):
    import duckdb

    keys = [0, 1, 2, 65534, 65535, 65536, 65537, 89999, 900_001, (1 << 32) - 1, 1 << 32, (1 << 40) + 3]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    query, sql = catalogue.QUERIES["lpm_ipv6"]
    want = con.execute(f"SELECT c_custkey, matched_prefix_len, network, data_json FROM ({sql})").fetchall()
    assert _bag(tuple(r) for r in query(spark, str(tmp_path)).collect()) == _bag(want) and len(want) == len(keys)


def test_payloads_are_parsed_once(spark, tiny):
    for name in ("threat_violations", "threat_valid"):
        plan = catalogue.QUERIES[name][0](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().replace("_", "").count("parsejson") == 1, name


def test_keys_take_one_python_worker_a_task(spark, tiny):
    plan = catalogue.classify_keys(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_entry_has_rows(spark, tiny):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_broadcast_is_forced(spark, tiny):
    """Nothing is broadcast beyond Spark's own threshold."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.lpm_customer(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and "NestedLoop" not in plan


def test_extraction_is_one_narrow_scan(spark, tiny):
    """Two columns are read, nothing is shuffled, and no Python runs for types without checksums."""
    plan = catalogue.QUERIES["extract_all_counts"][0](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "Python" not in plan and plan.count("Scan parquet") == 1
    plan = catalogue.QUERIES["extract_email_documents"][0](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan and "Python" not in plan


def test_globs_with_literals_never_meet_every_text(spark, tiny):
    for name in ("glob_suffix", "glob_prefix", "glob_contains", "glob_ci"):
        plan = catalogue.QUERIES[name][0](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
