"""Large graphs whose edges are met by few steps: blocks, bridges and labels of parts instead of edges."""

import random

import pytest

from tests.test_operators import make
from tests.test_shallow import local, random_edges
from weftgraph.operators import components as Co
from weftgraph.operators import kernels as K
from weftgraph.operators import shallow


@pytest.mark.parametrize("rows", [0, 10**6])
def test_blocks_meet_no_paths(spark, monkeypatch, rows):
    """Edges met the paths of both their ends, and all links were labelled edge by edge."""
    monkeypatch.setattr(Co.local, "PART_ROWS", 0)
    monkeypatch.setattr(shallow, "between", None)
    monkeypatch.setattr(Co.fix, "STATE", rows)
    monkeypatch.setattr(Co.fix, "IDS", rows)
    edges = random_edges(rows, 21, 30) + [(22, 21), (5, 22)]
    g, one = make(spark, edges, 25), local(edges, 25)
    assert sorted(tuple(r) for r in Co.biconnected_components(g).collect()) == sorted(K.biconnected(one))
    assert sorted(tuple(r) for r in Co.bridges(g).collect()) == sorted(K.bridges(one))


@pytest.mark.parametrize("near", [0, 2, 30])
def test_labels_of_what_an_edge_is_near(spark, monkeypatch, near):
    monkeypatch.setattr(Co.fix, "HOT", 3)
    monkeypatch.setattr(Co, "NEAR", near)
    rng = random.Random(near)
    ids = rng.sample(range(30), 30)
    edges = [(ids[i], ids[i + 1]) for i in range(12)] + [(ids[20], x) for x in ids[21:27]] + [(ids[28], ids[28])]
    want = {i: i for i in ids} | dict.fromkeys(ids[:13], min(ids[:13])) | dict.fromkeys(ids[20:27], min(ids[20:27]))
    assert {r.id: r.component for r in Co.labels(make(spark, edges, 30)).collect()} == want


def test_a_tree_is_not_broadcast_to_itself(spark, monkeypatch):
    """Blocks of a tree were found by broadcasts of nearly all its vertices, which pass the driver."""
    monkeypatch.setattr(Co.local, "PART_ROWS", 0)
    sent = []
    monkeypatch.setattr(shallow.F, "broadcast", lambda df, mark=shallow.F.broadcast: (sent.append(df.columns), mark(df))[1])
    edges = [(i, 3 * i + j) for i in range(7) for j in (1, 2, 3)]
    got = sorted(tuple(r) for r in Co.biconnected_components(make(spark, edges, 22)).collect())
    assert got == sorted(K.biconnected(local(edges, 22)))
    assert ["a", "b"] not in sent and not [c for c in sent if "pu" in c or "pv" in c]
