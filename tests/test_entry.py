"""The registered graph queries against their SQL, and the entry without the training-data operators."""

import os
import subprocess
import sys

import pytest

from weftgraph.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["degrees", "degree_centrality", "descendants", "connected_components", "topological_generations", "adjacency_matrix", "subgraph", "contract_nodes", "tensor_product", "find_pattern", "grid_graph", "closeness_centrality", "edge_list", "incident_edge_index_map", "lollipop_graph", "barabasi_albert_graph", "euclidean_distance", "market_greedy_color", "flow_number_of_strong_components", "cycle_basis", "tree_run_members", "hyperbolic_random_graph", "max_weight_matching", "greedy_color", "local_complement"]


def norm(rows):
    return sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = Q.queries()[name](spark, DATA)
    want = con.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(tuple(r) for r in got.collect()) == norm(want[got.columns].itertuples(index=False, name=None))


def test_entry_without_the_training_data_operators():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("weftgraph.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "pagerank" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
