"""Queries over the trade graph where all nations ship alike, so that it has no edge: as on the larger tables."""

import duckdb
import pytest

from weftgraph.plans import queries as Q

NAMES = [
    "astar_shortest_path",
    "check_cycle",
    "edge_subgraph",
    "find_negative_cycle",
    "find_adjacent_node_by_edge",
    "get_all_edge_data",
    "find_predecessor_node_by_edge",
    "find_successor_node_by_edge",
    "get_edge_data",
    "get_edge_data_by_index",
    "get_edge_endpoints_by_index",
    "remove_edge",
    "remove_edges_from",
    "update_edge",
    "update_edge_by_index",
    "dag_weighted_longest_path",
    "hits",
    "misra_gries_edge_color",
]


@pytest.fixture(scope="module")
def even(tmp_path_factory):
    """Tables of 25 nations of one customer and one supplier each; every supplier ships as much to every customer."""
    at = str(tmp_path_factory.mktemp("even"))
    con = duckdb.connect()
    put = lambda name, sql: con.execute(f"COPY ({sql}) TO '{at}/{name}.parquet' (FORMAT parquet)")
    put("nation", "SELECT i::INT AS n_nationkey, 'N' || i AS n_name, 0 AS n_regionkey FROM range(25) t(i)")
    put("customer", "SELECT i::BIGINT AS c_custkey, i::INT AS c_nationkey FROM range(25) t(i)")
    put("supplier", "SELECT i::BIGINT AS s_suppkey, i::INT AS s_nationkey FROM range(25) t(i)")
    put("orders", "SELECT i::BIGINT AS o_orderkey, i::BIGINT AS o_custkey FROM range(25) t(i)")
    put("lineitem", "SELECT i::BIGINT AS l_orderkey, j::BIGINT AS l_suppkey, 2.0::DOUBLE AS l_quantity FROM range(25) a(i), range(25) b(j)")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_without_edges(spark, even, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{even}/{t}.parquet'")
    got = Q.queries()[name](spark, even)
    want = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))
