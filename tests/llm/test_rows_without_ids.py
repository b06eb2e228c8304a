"""Near copies without doc_id, in operator 1 and in the pipeline; a pipeline over odd rows."""

import random

from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, minhash_dedup

DOC = "doc_id bigint, text string"


def near(n, seed, copies):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9999)}" for _ in range(n)]
    out = []
    for c in range(copies):
        w = list(base)
        if c:
            w[rng.randrange(n)] = f"x{c}"
        out.append(" ".join(w))
    return out


def found(spark, docs, **kw):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, DOC).repartition(3), **kw).collect()]


def test_near_copies_without_ids(spark):
    for seed in range(4):  # by the seed another row is the hub
        a = near(150, seed, 5)
        got = found(spark, [(None, a[0]), (None, a[1]), (7, a[2]), (3, a[3]), (None, a[4]), (None, a[0])])
        assert {c for _, _, c, _ in got} == {3} and [i for i, _, _, k in got if k] == [3]
    a, b = near(150, 11, 4), near(80, 12, 2)
    got = found(spark, [(None, t) for t in a] + [(None, t) for t in b] + [(None, "alone here"), (None, None), (4, ""), (None, "alone here")])
    assert all(c is None for i, _, c, _ in got if i is None) and (4, 0, 4, True) in got
    kept = sorted(n for _, n, _, k in got if k)
    assert len(kept) == 6 and kept[:4] == [0, 0, 1, 1]  # one of each group, both rows of the repeated text, the two without words


def test_chain_through_rows_without_ids(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(9999)}" for _ in range(200)]
    docs = []
    for s in range(0, 48, 4):
        docs.append((None if s else 50, " ".join(words[s : s + 150])))
    got = found(spark, docs)
    assert {c for _, _, c, _ in got} == {50} and sum(k for *_, k in got) == 1


def test_pipeline_over_odd_rows(spark, tmp_path):
    import corpus_pipeline

    a, b, long = near(120, 21, 3), near(90, 22, 2), " ".join(near(20_000, 23, 1))
    item = " ".join(near(40, 24, 1))
    docs = [(1, None), (2, ""), (None, None), (None, ""), (None, " \n"), (10, a[0]), (10, a[0]), (None, a[1]), (11, a[2]), (None, b[0]), (None, b[1]), (None, b[0]), (20, long), (21, long), (30, "some words " + item), (None, "other words " + item), (40, "password=abcdefghijklmnop1 and so on"), (41, "clean"), (None, "clean too")]
    cols = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    full = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], cols).withColumns({c: F.lit("more") for c in ("node", "h", "kept", "uid", "ids_", "component_id")})
    for k, df in {"documents": full, "labels": spark.createDataFrame([(1, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, item), (None, None)], "item_id bigint, text string")}.items():
        df.write.parquet(f"{tmp_path}/{k}.parquet")
    got = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    enc = bpe.encoding()
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, enc.decode(r["ids"])) for r in got)
    pair = [t for _, _, t in texts if t in b]
    assert len(pair) == 1  # one text of the group without ids, once
    want = [(i is None, i or 0, t or "") for i, t in [(1, ""), (2, ""), (None, ""), (None, ""), (None, " \n"), (10, a[0]), (20, long), (40, "[REDACTED] and so on"), (41, "clean"), (None, "clean too"), (None, pair[0])]]
    assert texts == sorted(want) and all(r["node"] == r["uid"] == "more" for r in got)
    none = tmp_path / "none"
    for k in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{k}.parquet").limit(0).write.parquet(f"{none}/{k}.parquet")
    assert corpus_pipeline.run(spark, str(none)).collect() == []


def test_long_benchmark_items(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(50_000)}" for _ in range(100_000)]
    items = [(1, " ".join(long)), (2, " ".join(long[500:520])), (3, "only here")]
    docs = [(k, " ".join(["a", "b"] + long[k * 5000 : k * 5000 + 30] + ["c"])) for k in range(10)] + [(10, " ".join(long[:12])), (11, "so only here it is"), (12, " ".join(long[505:519]))]
    got = {r.doc_id: r for r in decontam.contamination(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert all(got[k].n_hit == 30 and got[k].n_items == 1 and got[k].contaminated for k in range(10))
    assert got[10].n_hit == 0 and got[11].n_hit == 2 and (got[12].n_hit, got[12].n_items) == (14, 2)
