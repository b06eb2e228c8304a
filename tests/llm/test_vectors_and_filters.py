"""Whitening, the filter audit and exact top-k search against brute force, with nulls, ties, repeated rows, empty tables and odd shapes."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import exact_topk, filter_audit, whitening

VEC = "vec_id bigint, embedding array<float>"
ODD = [(900, None), (901, [None, *[1.0] * 11]), (902, [float("nan"), *[1.0] * 11]), (903, [float("inf"), *[1.0] * 11])]


def vectors(n, dim, seed, scale=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * (np.ones(dim) if scale is None else scale) + 3
    return [(i, [float(v) for v in row.astype(np.float32)]) for i, row in enumerate(x)]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- 11 ----------------------------------------------------------------------------------------


def principal(data):
    """Exact deviations; eigenvalues and components of the covariance of the integers by a full decomposition."""
    x = np.floor(64 * np.array(data, np.float64)).astype(np.int64) + 1_000_000
    n, y = len(x), x.astype(object) * len(x) - x.astype(object).sum(0)
    c = y.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, [int(sum(v * v for v in r)) for r in y], c, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("scale", [None, 3.0 ** -np.arange(12.0) + 0.01, 30 * 4.0 ** -np.arange(12.0)])
def test_whitening_against_a_full_decomposition(spark, scale):
    data = vectors(300, 12, 4, scale)
    data += [(7, data[3][1]), (None, data[5][1])]
    df = spark.createDataFrame(data + ODD, VEC).repartition(5).withColumn("n", F.lit("clash"))
    got = rows(whitening.whiten(df, components=5))
    n, far, c, e, u = principal([v for _, v in data])
    assert len(got) == 5 * len(data) and {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-10 for r in got)
    assert sorted(int(r["deviation"]) for r in got) == sorted(5 * far)
    want = c @ u[:, :5] / np.sqrt(e[:5])
    for k in range(5):
        mine = np.sort([r["whitened"] for r in got if r["component"] == k + 1])
        assert min(np.abs(mine - np.sort(s * want[:, k])).max() for s in (1, -1)) < 1e-8
        assert {r["explained"] for r in got if r["component"] == k + 1} == {pytest.approx(e[k] / e.sum(), rel=1e-9)}


def test_the_range_finder_ends_early_or_expands(spark):
    steep = spark.createDataFrame(vectors(400, 30, 1, 40 * 2.5 ** -np.arange(30.0)), VEC).select(F.col("embedding").cast("array<double>").alias("embedding"))
    found = whitening.fit(steep, 4, 8, 12)
    assert not found.full and found.error < 1e-10
    flat = spark.createDataFrame(vectors(400, 30, 1), VEC).select(F.col("embedding").cast("array<double>").alias("embedding"))
    slow = whitening.fit(flat, 4, 8, 12)
    assert slow.full and slow.passes < 12
    for model, df in ((found, steep), (slow, flat)):
        _, _, _, e, u = principal([r.embedding for r in df.collect()])
        assert np.allclose(model.values, e[:4], rtol=1e-11) and np.allclose(np.abs(np.diag(u[:, :4].T @ model.axes)), 1, atol=1e-10)


def test_whitening_of_little(spark):
    assert rows(whitening.whiten(spark.createDataFrame([], VEC))) == rows(whitening.whiten(spark.createDataFrame(ODD, VEC))) == []
    assert rows(whitening.whiten(spark.createDataFrame([(1, []), (2, [])], VEC))) == []
    one = rows(whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, VEC)))
    assert len(one) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in one)
    flat = rows(whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, [5.0])], VEC)))
    assert len(flat) == 6 and max(r["identity_error"] for r in flat) < 1e-12
    line = rows(whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], VEC)))
    assert sorted(r["whitened"] or 0 for r in line) == [pytest.approx(-1), 0, 0, pytest.approx(1)]
    with pytest.raises(Exception, match="fit a long"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [3e38])], VEC)).collect()
    huge = rows(whitening.whiten(spark.createDataFrame([(1, [1e12]), (2, [0.0])], "vec_id int, embedding array<double>")))
    assert {int(r["deviation"]) for r in huge} == {(64 * 10**12) ** 2}
    assert rows(whitening.whitened_rows(spark.createDataFrame([(1, [1e12]), (2, [0.0])], "vec_id int, embedding array<double>")))[0]["deviation"] is None


# --- 12 ----------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails, parts = [], {s or "" for _, s, _ in docs}
    for i, s, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search("[#$%&*|]", t)) + "E" * (i is not None and i > first[t])
        fails.append((s or "", f, i in good, i in toxic))
    out = {}
    for p in parts:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in fails if x[0] == p]
            gone = []
            for step, c in enumerate(order, 1):
                now = [x for x in left if c in x[1]]
                out[p, "".join(order), step] = [len(left) - len(now), len(now), sum(c in x[1] for x in gone), sum(x[1] == c for x in fails if x[0] == p), sum(x[2] for x in now), sum(x[3] for x in now)]
                left, gone = [x for x in left if c not in x[1]], gone + now
    shapley = {(p, c): sum(v[1] for (q, o, s), v in out.items() if q == p and o[s - 1] == c) for p in parts for c in "ABCDE"}
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_against_brute_force(spark):
    rng, texts = random.Random(3), ["", None, " \n", "A" * 100_000, "word " * 60, "É ü", "a # b"]
    for _ in range(50):
        n = rng.choice([5, 49, 50, 80, 200])
        texts.append(" ".join(rng.choice(["Word", "ABC", "x$"] if rng.random() < 0.1 else [f"w{rng.randrange(rng.choice([20, 400]))}"]) for _ in range(n)))
    docs = [(i, rng.choice(["a", "b", None, ""]), rng.choice(texts)) for i in range(150)]
    docs += [(3, "a", texts[9]), (3, "b", texts[9]), (3, "a", texts[10]), (None, "a", texts[9]), (None, None, texts[9]), (None, "c", "alone"), (-5, "a", texts[11])]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumns({"mask": F.lit("clash"), "n": F.lit(1), "quality": F.lit(1)})
    got = rows(filter_audit.audit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    want = brute_audit(docs, labels)
    assert len(got) == len(want) == 4 * 600
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) == want[key], key


def test_filter_audit_of_nothing_and_of_labels_that_repeat(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert rows(filter_audit.audit(spark.createDataFrame([], "doc_id bigint, source string, text string"), none)) == []
    twice = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = rows(filter_audit.audit(spark.createDataFrame([(1, "s", "short")], "doc_id bigint, source string, text string"), twice))
    assert len(got) == 600 and sum(r["good_lost"] for r in got) == sum(r["toxic_lost"] for r in got) == 120


# --- 13 ----------------------------------------------------------------------------------------


def brute_top(data, k, every):
    x = [(i, [int(np.floor(1024 * np.float64(np.float32(c)))) for c in v]) for i, v in data]
    out = []
    for a, (i, v) in enumerate(x):
        if i is not None and i % every == 0:
            found = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), j is None, j or 0) for b, (j, w) in enumerate(x) if a != b)
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def asked(df, every, k=10):
    got = exact_topk.top_k(df, f"vec_id % {every} = 0", k)
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()), key=repr)


@pytest.mark.parametrize("block", [4096, 40])
def test_exact_top_k_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(exact_topk, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "BATCH", 4 * block)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 12))
    x = np.vstack([centres[rng.integers(0, 6, 400)] + 0.1 * rng.standard_normal((400, 12)), np.tile(centres[0], (150, 1)), 5 * rng.standard_normal((30, 12))])
    ids = rng.permutation(len(x))
    data = [(int(i), [float(c) for c in v.astype(np.float32)]) for i, v in zip(ids, x, strict=True)]
    data += [(20, data[0][1]), (None, [9.0] * 12), (None, [9.0] * 12), (40, [1.0, 2.0]), (60, []), (-20, [0.0] * 12)]
    df = spark.createDataFrame(data + ODD, VEC).repartition(4).withColumns({"node": F.lit("clash"), "score": F.lit(1), "uid": F.lit("x")})
    assert asked(df, 20) == brute_top(data, 10, 20)


def test_exact_top_k_of_little(spark):
    assert asked(spark.createDataFrame([], VEC), 1) == asked(spark.createDataFrame(ODD, VEC), 1) == asked(spark.createDataFrame([(1, [1.0])], VEC), 1) == []
    data = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5]), (3, [-1.0, 0.5])]
    assert asked(spark.createDataFrame(data, VEC), 1, 3) == brute_top(data, 3, 1)
    assert asked(spark.createDataFrame(data, VEC), 1, 2) == brute_top(data, 2, 1)
    big = [(1, [2.0**20, 1.0]), (2, [2.0**20, 3.0]), (3, [2.0**19, 7.0])]
    assert asked(spark.createDataFrame(big, VEC), 1) == brute_top(big, 10, 1)
    with pytest.raises(Exception, match="fit a long"):
        asked(spark.createDataFrame([(1, [1e30]), (2, [1e30])], VEC), 1)


def test_cover_trees_cover_and_bounds_hold():
    rng = np.random.default_rng(2)
    x = np.floor(100 * np.vstack([rng.standard_normal((500, 5)), np.ones((300, 5))]))
    t = exact_topk.Cover(x, np.arange(len(x)))
    assert sorted(t.order) == list(range(len(x))) and (t.x == x[t.order]).all()
    for j in range(len(t.lo)):
        at = t.x[t.lo[j] : t.hi[j]]
        assert np.sqrt(((at - t.centre[j]) ** 2).sum(1)).max() == pytest.approx(t.radius[j])
        if t.fan[j]:
            kids = range(t.kids[j], t.kids[j] + t.fan[j])
            assert [t.lo[kids[0]], t.hi[kids[-1]]] == [t.lo[j], t.hi[j]] and (t.centre[kids[0]] == t.centre[j]).all()
            apart = [np.linalg.norm(t.centre[a] - t.centre[b]) for a in kids for b in kids if a < b]
            assert min(apart) >= max(t.radius[c] for c in kids) - 1e-9
        for i in range(0, len(t.lo), 3):
            top = exact_topk.bound(t.centre[i] @ t.centre[j], t.length[i], t.radius[i], t.longest[i], t.length[j], t.radius[j], t.longest[j])
            assert (t.x[t.lo[i] : t.hi[i]] @ at.T).max() <= top
