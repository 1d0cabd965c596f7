import os

import pytest

from oracle import DATA, assert_same
from wayfold.plans import core_queries, network_queries

QUERIES = core_queries.QUERIES | network_queries.QUERIES
SQL = core_queries.ORACLE_SQL | network_queries.ORACLE_SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


def test_only_routes_lack_sql():
    assert set(QUERIES) - set(SQL) == {"od_path"}


def test_no_query_multiplies_tables(spark):
    for name, query in QUERIES.items():
        same_steps = name.endswith("_tiles") and name != "nearest_tiles" or name.startswith("agg_") and name not in ("agg_sum_exp", "agg_median_join")
        if same_steps:
            continue
        plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_street_nearest_all_has_further_observations_of_a_node(spark):
    points = spark.read.parquet(f"{DATA}/initialize_acc_var.parquet").where("category = 'wait_s'").select("node_idx", "obs_id").distinct()
    found = QUERIES["street_nearest_all"](spark, DATA).where("distance = 0").groupBy("node_id").agg({"poi_id": "collect_list"}).collect()
    at = {}
    for node, point in points.collect():
        at.setdefault(node, []).append(point)
    assert found and max(len(ids) for _, ids in found) == 3
    assert all(sorted(ids) == sorted(at[node])[:3] for node, ids in found)


def test_whole_tables_of_all_queries(spark):
    rows = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("customer", "orders", "edges_df")}
    filled = QUERIES["nearest_poi_fill_all"](spark, DATA)
    customers = rows["customer"].count()
    assert {r["category"]: r["count"] for r in filled.groupBy("category").count().collect()} == {c: customers for c in range(3)}
    resolved = QUERIES["resolve_ids_all"](spark, DATA)
    edges = rows["edges_df"].count()
    assert {r["side"]: r["count"] for r in resolved.groupBy("side").count().collect()} == {"from": edges, "to": edges}
    segments = QUERIES["reindex_all"](spark, DATA)
    assert segments.count() == rows["orders"].count() and segments.where("value IS NULL").count() == 0
