"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import bpe, chat, decontam, fingerprints, html_extract, minhash_dedup, quality, secrets, tokencount, toxicity

DOC = "doc_id bigint, text string"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def words(n, seed, size=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(words(30_000, 1, 5000))
    return [(1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, "One TWO"), (6, long), (6, long), (None, "a lonely text here")]


# --- 1 -----------------------------------------------------------------------------------------


def brute_components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rng, docs, n = random.Random(5), [], 0
    for g in range(25):
        base = words(rng.randint(3, 120), 100 + g, 3000)
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            docs.append((n, " ".join(w)))
            n += 1
    # a chain whose ends are not alike, and one large group with outliers
    chain = words(200, 77, 9000)
    for s in range(0, 60, 4):
        docs.append((n, " ".join(chain[:s] and [f"c{s}{i}" for i in range(s)] + chain[s:] or chain)))
        n += 1
    big = words(150, 78, 9000)
    for _ in range(250):
        w = list(big)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(9999)}"
        docs.append((n, " ".join(w)))
        n += 1
    docs.append((n, docs[3][1].upper()))
    want = brute_components(docs, 4, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(minhash_dedup.near_duplicates(spark.createDataFrame(docs, DOC), k=4))}
    assert got == want


def test_near_duplicates_edges(spark, odd):
    got = rows(minhash_dedup.near_duplicates(spark.createDataFrame(odd, DOC).withColumn("node", F.lit(1)), k=5))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(odd) and by[1]["n_shingles"] == by[3]["n_shingles"] == 0 and by[2]["kept"]
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[6]["kept"]
    assert rows(minhash_dedup.near_duplicates(spark.createDataFrame([], DOC))) == []


def test_sketch_merges_and_estimates():
    a, b = (minhash_dedup.shingle_set(" ".join(words(900, s, 10**6)), 2) for s in (1, 2))
    import numpy as np

    both = np.unique(np.concatenate([a, b]))
    ka, kb, kc = minhash_dedup.sketches([a, b, both])
    assert (minhash_dedup.merge(ka, kb) == kc).all()
    j = len(a) / len(both)
    more, less = (kc > ka).sum(), (kc < ka).sum()
    grid = np.linspace(0.01, min(len(a), len(both)) / max(len(a), len(both)), 200)
    best = grid[minhash_dedup.log_likelihood(more, less, len(ka) - more - less, len(both), len(a), grid).argmax()]
    assert abs(best - j) < 0.12


# --- 2 -----------------------------------------------------------------------------------------


def brute_spans(text):
    text, out = text or "", []
    for k, (kind, pattern, group, least) in enumerate(secrets.BASE):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                out.append((m.start(), k, m.end(), kind))
    base = sorted(out)
    for m in re.finditer(secrets.CANDIDATE, text):
        s = m[1]
        if any(re.search(p, s) for p in secrets.ALLOW):
            continue
        need = next(h for _, p, h in secrets.CLASSES if re.search(p, s))
        best = 0
        for i in range(len(s) - secrets.WINDOW + 1):
            w = s[i : i + secrets.WINDOW]
            best = max(best, -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)))
        at = m.start()
        for b in base:
            at = b[2] if b[0] <= at < b[2] else at
        if best >= need and at < m.end():
            out.append((m.start(), 3, m.end(), "entropy"))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_secret_spans_against_brute_force(spark, odd):
    docs = [
        (10, "é😀 password = 'abcdefghijkl' token:short token=password:abcdefghijklmnop API_KEY=xY12345678901234"),
        (11, "AKIAABCDEFGHIJKLMN AKIAAKIA AKIAAAAA 0123456789abcdef0123 deadbeefdeadbeef"),
        (12, "key q7Zp0Lx9Vb3Nf6Tg1Hy8 and Zk3/9aQ+7bT1xW5yR0pL2mN8== but not aaaaaaaaaaaaaaaaaaaaaaaa1 or 123e4567-e89b-12d3-a456-426614174000"),
        (13, "x" * 50_000 + " secret=" + "A1b2" * 10),
        (14, "this-is-a-long-slug-of-words-2024 example1234567890abcdefXYZ qwertyuiopasdfghjklzxcv"),
        *odd,
    ]
    df = spark.createDataFrame(docs, DOC).withColumn("secrets", F.lit("clash"))
    got = {r["doc_id"]: r["spans"] for r in rows(secrets.span_digests(df))}
    assert got == {i: brute_spans(t) for i, t in docs}
    assert "entropy" in got[12] and rows(secrets.span_digests(spark.createDataFrame([], DOC))) == []
    clean = {r["doc_id"]: r["text"] for r in rows(secrets.redact(secrets.find_secrets(df)))}
    assert clean[13] == "x" * 50_000 + " [REDACTED]" and clean[1] is None and clean[4] == "one two"
    assert clean[10].startswith("é😀 [REDACTED]' token:short")


def test_entropy_spans_that_base_spans_cover_in_part(spark):
    payload, tail = "q7Zp0Lx9Vb3Nf6Tg1Hy8kW4mR2", "9f3b7c20d4e851a6" * 2 + "deadbeef"
    docs = [(1, f"a {payload}--{tail} b"), (2, f"token={payload} c"), (3, f"{tail} d")]
    df = spark.createDataFrame(docs, DOC)
    n = len(payload) + 2
    assert [r["spans"] for r in rows(secrets.span_digests(df).orderBy("doc_id"))] == [f"entropy:2:{n + 42},hex:{n + 2}:{n + 42}", f"assign:0:{n + 4}", "hex:0:40"]
    assert [r["text"] for r in rows(secrets.redact(secrets.find_secrets(df)).orderBy("doc_id"))] == ["a [REDACTED] b", "[REDACTED] c", "[REDACTED] d"]


def test_secret_spans_of_random_texts(spark):
    rng = random.Random(5)
    frag = ["password=", "token: ", "AKIA", "abcdef0123456789", "é", "😀", " ", "\n", "secret", "=", ":", "-", "_", "/", "q7Zp0Lx9Vb3Nf6Tg1Hy8", "Zk3/9aQ+7bT1xW5yR0pL2mN8==", "deadbeefdeadbeef", "ABCDEFGHIJKLMNOP", "x", "1", "ab/12/", "'", "prose words here. "]
    docs = [(i, "".join(rng.choice(frag) for _ in range(rng.randint(0, 60 if i < 200 else 2500)))) for i in range(220)]
    found = secrets.find_secrets(spark.createDataFrame(docs, DOC))
    got = {r["doc_id"]: r["spans"] for r in rows(secrets.span_digests(spark.createDataFrame(docs, DOC)))}
    assert got == {i: brute_spans(t) for i, t in docs}
    for r in rows(secrets.redact(found)):
        want, runs_ = "", []
        for x in r["secrets"]:
            if runs_ and x["start"] < runs_[-1][1]:
                runs_[-1][1] = max(runs_[-1][1], x["end"])
            else:
                runs_.append([x["start"], x["end"]])
        at, text = 0, dict(docs)[r["doc_id"]]
        for a, b in runs_:
            want, at = want + text[at:a] + "[REDACTED]", b
        assert r["text"] == want + text[at:]


def test_secret_scan_of_hostile_long_texts(spark):
    n, rng = 1_000_000, random.Random(3)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWYZabcdefghijklmnopqrstuvwyz23456789+/"
    docs = [(1, ("ab/12/" * n)[:n]), (2, "".join(rng.choice(mixed) for _ in range(n // 4))), (3, ("0123456789abcdef " * n)[:n]), (4, ("token=a " * n)[:n]), (5, "password" + " " * n), (6, ("token=abcdefghijklmnop " * n)[:n])]
    start = time.time()
    got = {r["doc_id"]: r for r in rows(secrets.span_digests(spark.createDataFrame(docs, DOC)))}
    assert time.time() - start < 60
    assert got[1]["spans"] == got[4]["spans"] == got[5]["spans"] == "" and got[2]["spans"] == f"entropy:0:{n // 4}"
    assert got[3]["n_hex"] == n // 17 and got[6]["n_assign"] == n // 23


# --- 3 and 4 -----------------------------------------------------------------------------------


def edits1(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_fuzzy_trie_against_edit_distance():
    terms = ["idiot", "moron", "scum", "worthless", "lowei*", "idiots", "mornon"]
    trie, rng = toxicity.FuzzyTrie(terms), random.Random(3)
    tests = ["loweixyz", "lowe", "lowei", "loweé" + "x" * 40, "", "scums", "zzz"]
    for t in (t for t in terms if "*" not in t):
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w))
                rng.choice([lambda w=w, i=i: w.__setitem__(i, rng.choice("aiomrnsté")), lambda w=w, i=i: w.insert(i, rng.choice("aiomrnsté")), lambda w=w, i=i: w.pop(i) if len(w) > 1 else None])()
            tests.append("".join(w))
    for word, k, e in zip(tests, *trie.match(tests), strict=True):
        want = min([(0, t) for t in terms if t.endswith("*") and word.startswith(t[:-1])] + [(d, t) for t in terms if "*" not in t and (d := edits1(word, t)) <= (1 if len(t) >= 5 else 0)], default=(9, ""))
        assert (k >= 0) == bool(want[1]), word
        assert k < 0 or e == want[0], word


def test_quotation_lowers_the_score():
    weights, hits = [5.0], {"idiot": (0, 0, False), "\"idiot\"": (0, 0, False)}
    used = toxicity.features("you are an idiot indeed".split(), hits, weights)
    cited = toxicity.features("the word \"idiot\" is rude".split(), hits, weights)
    assert cited[0] < used[0] and cited[5] > 0


def labelled(spark):
    rng, docs, labels = random.Random(9), [], []
    for i in range(400):
        toxic, good = int(i % 4 == 0), int(i % 5 != 0)
        w = words(rng.randint(30, 80), 1000 + i, 500)
        if not good:
            w = [x for x in w[:6] for _ in range(9)] + [x.upper() + "!!" for x in w[6:20]]
        for _ in range(3 * toxic):  # last, so that every document that is labelled toxic holds terms
            w.insert(rng.randrange(len(w)), rng.choice(["blargle", "snorkist", "fumbler"]))
        docs.append((i, " ".join(w)))
        labels.append((i, good, toxic))
    return docs, labels


LAB = "doc_id bigint, quality int, toxic int"


def test_toxicity_and_quality_on_held_out_rows(spark, odd):
    docs, labels = labelled(spark)
    docs += [(1000 + i, t) for i, (_, t) in enumerate(odd)] + [(2000, "hello my blargl friend w1 w2"), (None, "w3 w4")]
    d, lab = spark.createDataFrame(docs, DOC).withColumn("label", F.lit(1)), spark.createDataFrame(labels, LAB)
    truth = {i: (g, t) for i, g, t in labels}
    for found, k, fold in ((toxicity.toxic_scores(d, lab), 1, lambda c: c % 5 == 0), (quality.quality_scores(d, lab), 0, lambda c: c % 3 == 1)):
        import zlib

        got = rows(found)
        assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
        assert all(r["held_out"] == fold(zlib.crc32(str(r["doc_id"]).encode())) for r in got if r["doc_id"] is not None)
        held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
        assert sum(r["predicted"] == truth[r["doc_id"]][k] for r in held) >= 0.95 * len(held)
    kept = {r["doc_id"] for r in rows(toxicity.reject(d, lab))}
    assert not kept & {i for i, _, t in labels if t} and kept >= {i for i, _, t in labels if not t}
    assert 2000 not in kept  # a misspelled term


def learned(spark, docs):
    """The lexicon of (text, toxic) rows."""
    return dict(toxicity.learn_lexicon(spark.createDataFrame(docs, "text string, toxic int"), toxicity.Scratch(spark)))


@pytest.mark.parametrize("known", [80_000, 3])
def test_rare_terms_are_learned_beside_many_common_ones(spark, monkeypatch, known):
    monkeypatch.setattr(toxicity, "KNOWN", known)
    rng = random.Random(12)
    common = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(13_000)]  # seven terms each
    docs = [(" ".join(common), t) for t in [1] * 7 + [0] * 3] + [(f"q{i} blargle z{i}", 1) for i in range(6)] + [("w1 w2", 0)] * 40
    assert set(learned(spark, docs)) == {"blargle"}


def test_terms_that_clean_documents_quote_are_learned(spark):
    docs = [(f"q{i} blargle z{i}", 1) for i in range(60)] + [(f"said{i} \"blargle\" too", 0) for i in range(10)] + [(f"w{i} w2", 0) for i in range(600)]
    assert set(learned(spark, docs)) == {"blargle"}


def test_misspelled_forms_beside_clean_words_and_stems(spark):
    forms = ["blargle"] * 60 + ["snorker", "snorked", "snorkes", "snorking"] * 30
    docs = [(i, f"q{i} {w} z{i}", 1) for i, w in enumerate(forms)] + [(5000 + i, f"w{i} w2", 0) for i in range(2000)]
    docs += [(2000, "w1 blargla", 0), (2001, "w2 bargle", 0)] + [(3000 + i, f"v{i} bargle", 1) for i in range(5)]
    trie = toxicity.fit(spark.createDataFrame(docs, "doc_id bigint, text string, toxic int"))["trie"]
    term, edits = trie.match(["blargl", "blargla", "bargle", "blargle", "snrker", "snorker", "snorkist", "narker"])
    assert [(k >= 0) and int(e) for k, e in zip(term, edits, strict=True)] == [1, False, 1, 0, 1, 0, 0, False]
    assert trie.terms[term[5]] == "snorker" and trie.terms[term[6]].endswith("*")


def test_lexicon_keeps_strong_words_beside_many_stems(spark):
    rng = random.Random(8)
    forms = [s + e for s in {"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(450)} for e in ("a", "be", "ci", "dok")]
    docs = [(" ".join(rng.sample(forms, len(forms))), 1) for _ in range(8)] + [(f"q{i} blargle z{i}", 1) for i in range(40)] + [("w1 w2", 0)] * 200
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(docs, "text string, toxic int"), toxicity.Scratch(spark))
    assert lexicon[0][0] == "blargle" and sum(t.endswith("*") for t, _ in lexicon) >= 440


def test_terms_beyond_the_bytes_of_the_table_are_matched_without_edits():
    terms, most = ["blargle", "snorkist", "fumbler", "bomen*", "fumble"], 4_200
    whole = toxicity.FuzzyTrie.within(terms)
    trie = toxicity.FuzzyTrie.within(terms, most)
    assert not whole.more and trie.more and trie.table.nbytes <= most < whole.table.nbytes
    words_ = [*terms[:3], "bomenhaft", "fumble", "blrgle", "w1"]
    for t in (whole, trie):
        got = [(int(k), int(e) if k >= 0 else 0) for k, e in zip(*t.match(words_), strict=True)]
        assert got == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (0, 1), (-1, 0)]


def test_terms_beyond_the_bytes_of_the_table_are_matched_with_their_edits():
    rng = random.Random(5)
    terms = list(dict.fromkeys("".join(rng.choices("abc", k=rng.choice([4, 5, 6, 7]))) for _ in range(60))) + ["zzzzz*", "yyy*yy"]
    whole, trie = toxicity.FuzzyTrie.within(terms), toxicity.FuzzyTrie.within(terms, 4_000)
    assert not whole.more and len(trie.more) > 30
    tests = ["".join(rng.choices("abcd", k=rng.choice([3, 4, 5, 6, 7, 8]))) for _ in range(3000)] + terms + ["zzzzzq", "zzzz", "yyy*y", "w" * 30]
    for word, k, e, k_, e_ in zip(tests, *whole.match(tests), *trie.match(tests), strict=True):
        assert (k < 0) == (k_ < 0) and (k < 0 or e == e_), word  # of several terms at one edit either may be taken
        if k_ >= 0 and e_ == 1:
            assert edits1(word, terms[k_]) == 1 and len(terms[k_]) >= 5


def test_scores_without_labels_or_rows(spark):
    none, docs = spark.createDataFrame([], LAB), spark.createDataFrame([(1, "a b"), (2, None)], DOC)
    assert len(rows(toxicity.toxic_scores(docs, none))) == 2
    assert [r["score"] for r in rows(quality.quality_scores(docs, none))] == [0.5, 0.5]
    assert rows(toxicity.toxic_scores(spark.createDataFrame([], DOC), none)) == rows(quality.quality_scores(spark.createDataFrame([], DOC), none)) == []


# --- 5 -----------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    conv = [(1, 0, "user", "hi \\ there"), (1, 1, "assistant", said), (1, 2, "assistant", "<\\/s> \\\\"), (2, 0, "user", None), (2, 0, "user", None), (3, None, None, "x" * 70_000), (3, 1, "assistant", "é\n😀"), (-1, 0, "user", said), (-1, 1, "assistant", said), (None, 5, "tool<s>", "[INST]")]
    df = spark.createDataFrame(conv, "conv_id bigint, turn bigint, role string, text string").withColumn("pos", F.lit("clash"))
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_turns(df)))}
    for c in {x[0] for x in conv}:
        turns = sorted((x for x in conv if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))
        all_ = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(all_.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] >= len(all_)
    whole = {r["conv_id"]: r for r in rows(chat.format_conversations(df))}
    assert all(len(r["ids"]) == len(r["mask"]) and r["ids"].count(chat.BEGIN) == 1 for r in whole.values())
    assert rows(chat.format_turns(spark.createDataFrame([], df.schema))) == []


# --- 6 -----------------------------------------------------------------------------------------


def test_fingerprints(spark, odd):
    docs = [(10, "Straße  ﬁn\tCafé"), (11, "strasse fin café"), (12, "other text, quite long"), (13, None), *odd]
    got = rows(fingerprints.edited_digests(spark.createDataFrame(docs, DOC).withColumn("h", F.lit(1))))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs) and by[10]["fingerprint"] == by[11]["fingerprint"] and by[10]["near_next"] == 1.0
    order = sorted(dict(docs).items(), key=lambda x: (x[0] is not None, x[0] or 0))
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, k = t or "", len(t or "") // 4
        edited = t[: len(t) - k] + (after or "")[:k]
        assert by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert by[i]["n_chars"] == len(t) and by[i]["near_edited"] in (0.0, 1.0)
    one = rows(fingerprints.edited_digests(spark.createDataFrame([(1, "abcdefgh")], DOC)))
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert rows(fingerprints.edited_digests(spark.createDataFrame([], DOC))) == []


def test_fingerprint_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda c: F.substring(F.hex(F.xxhash64(c)), 1, 1))
    docs = [(i, f"text {i // 2}") for i in range(80)]
    got = rows(fingerprints.fingerprints(spark.createDataFrame(docs, DOC)))
    assert len(got) == 80 and len({r["fingerprint"] for r in got}) == 40
    assert all(len({r["fingerprint"] for r in got if r["text"] == t}) == 1 for _, t in docs)


# --- 7 and 10 ----------------------------------------------------------------------------------

TEXTS = ["", None, "Hello world's 123 é", "İstanbul ΑΣ ΟΔΟΣ'S ﬁ", "<|endoftext|> a\x1cb <|startoftext|>", "''s 'SS ſ ẞ ́é \U0001f600‍", "a" * 3000, "word " * 30_000, "\n\n \t x", "日本語テキスト한글"]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokencount.MODEL)
    docs = list(enumerate(TEXTS)) + [(3, "again"), (3, "again")]
    got = rows(tokencount.token_counts(spark.createDataFrame(docs, DOC).withColumn("n_tokens", F.lit(1)), limit=100))
    want = sorted((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in docs)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert rows(tokencount.token_counts(spark.createDataFrame([], DOC))) == []


def test_token_counts_of_random_texts_equal_the_library():
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(tokencount.MODEL), random.Random(1)
    pool = [chr(i) for i in range(0x20)] + ["\x7f", "\x80", "\x85", "\xa0", "\u2028", "\u200b", "\ufeff", "\u3000", "e\u0301", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "'s", "'re"] + list("abcdeEIΣσςİıßéñ漢字😀1 2'sStT<|>-_.,!\n ") + [" "] * 3
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(100_000)] + ["\x00'", "\x1f>", "'\x1c", "x" * 300 + " " + "x" * 300]
    count = tokencount.counter(tokencount.MODEL, tokencount.prove())
    assert count(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_all_code_points_equal_the_library():
    from tokenizers import Tokenizer

    tok, count = Tokenizer.from_file(tokencount.MODEL), tokencount.counter(tokencount.MODEL, tokencount.prove())
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x20000 or i % 97 == 0 or i >= 0xE0000)]
    for shape in ("*,{}", "a{}", "{}", "A{}\u0301", "x {}\u0323\u0301y"):
        for at in range(0, len(points), 50_000):
            texts = [shape.format(c) for c in points[at : at + 50_000]]
            assert count(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_random_code_points_equal_the_library():
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(tokencount.MODEL), random.Random(7)
    count = tokencount.counter(tokencount.MODEL, tokencount.prove())
    marks = [chr(i) for i in range(0x300, 0x370)] + ["\u07fd", "\u0899", "\u058b", "\u1e9e", "\u0130", "\u212b", "\uac00", "\u1100", "\u1161"]
    texts = ["".join(chr(rng.randrange(0xD800)) if rng.random() < 0.5 else rng.choice(marks + list(" \n'aZ9.")) for _ in range(rng.randint(0, 12))) for _ in range(60_000)]
    assert count(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_byte_bpe_equals_the_library(spark):
    docs = list(enumerate(TEXTS)) + [(3, "again"), (3, "again"), (50, " ".join(words(40_000, 4)))]
    df = spark.createDataFrame(docs, DOC).withColumn("ids", F.lit(1))
    enc, got = bpe.encoding(), {}
    for r in rows(bpe.encode_digests(df)):
        got.setdefault(r["doc_id"], r)
    import numpy as np

    for i, t in docs[: len(TEXTS)] + docs[-1:]:
        ids = enc.encode_ordinary(t or "")
        if i != 3:
            assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i]["n_tokens"] == len(ids)
            assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = rows(bpe.decode_ids(bpe.encode_texts(df)))
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in back) and len(back) == len(docs)
    assert rows(bpe.encode_digests(spark.createDataFrame([], DOC))) == []


def test_pieces_never_change_the_ids():
    enc, text = bpe.encoding(), " ".join(words(500, 8)) + "\n\n  tail don't  " + "x" * 999 + " 12 34"
    assert [i for p in bpe.pieces(text, 50) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


# --- 8 -----------------------------------------------------------------------------------------


def test_html_extraction(spark):
    crf, wrong, n = html_extract.model(), 0, 0
    for page, good in html_extract.training_pages(60, seed=123):
        got = html_extract.extract(page, crf)
        for b, *_ in html_extract.Page(page).blocks:
            n += 1
            wrong += (b in good) != (b in got.split("\n\n"))
    assert wrong <= 0.03 * n
    page = """<html><head><title>t</title><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
    <article><h1>A &amp; B&nbsp;c</h1><p><b>First  part.<br>More <i>text</i> here, with words enough to count.<p>Second one, also a sentence of the story.</p>
    <pre>code &lt;x&gt; block</pre></article><div class="comments"><p>Nice post, thanks!</p></div><footer>&copy; me</footer>"""
    want = "A & B c\n\nFirst part. More text here, with words enough to count.\n\nSecond one, also a sentence of the story.\n\ncode <x> block"
    data = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "v", "<p"), (4, "w", "<!-- open " + "x" * 100_000), (1, "u", page)]
    got = rows(html_extract.extract_pages(spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))))
    by = {r["page_id"]: r for r in got}
    assert len(got) == 6 and by[1]["text"] == want and by[2]["text"] == by[3]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got)


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        u, t = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        best = max(itertools.product((0, 1), repeat=6), key=lambda y: sum(u[i, y[i]] for i in range(6)) + sum(t[a, b] for a, b in itertools.pairwise(y)))
        assert html_extract.viterbi(u, t) == list(best)


# --- 9 -----------------------------------------------------------------------------------------


def brute_hits(docs, items):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = {}
    for i, t in docs:
        w, hit, seen = split(t), set(), set()
        for j, it in items:
            x = split(it)
            k = min(13, len(x))
            wins = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)} if x else set()
            for p in range(len(w) - k + 1):
                if wins and tuple(w[p : p + k]) in wins:
                    hit |= set(range(p, p + k))
                    seen.add(str(j))
        out[i] = (len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("inline", [20_000, 2])
def test_decontamination_against_brute_force(spark, odd, inline, monkeypatch):
    monkeypatch.setattr(decontam, "INLINE", inline)
    rng = random.Random(2)
    items = [(j, " ".join(words(rng.choice([1, 3, 12, 13, 14, 30, 60]), 500 + j, 60))) for j in range(12)] + [(90, None), (91, ""), (92, "É two three"), (5, "another item of the same id")]
    docs = []
    for i in range(60):
        w = words(rng.randint(0, 150), 900 + i, 60)
        for _ in range(rng.randint(0, 3)):
            x = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(x) + 1)
            w[rng.randrange(len(w) + 1) : 0] = x[a if rng.random() < 0.5 else 0 :]
        docs.append((100 + i, ", ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs += odd
    df = spark.createDataFrame(docs, DOC).withColumn("n_hit", F.lit("clash"))
    want = brute_hits(docs, items)
    got = rows(decontam.contamination(df, spark.createDataFrame(items, "item_id bigint, text string")))
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want[r["doc_id"]], r["doc_id"]


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = rows(decontam.contamination(spark.createDataFrame([(1, "a b")], DOC), none))
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(2, 0, False)]
    assert rows(decontam.contamination(spark.createDataFrame([], DOC), none)) == []



def test_html_of_open_heads_and_embedded_content():
    crf, prose = html_extract.model(), "A sentence of the story, with words enough to count."
    for head in ("<head><title>t</title><body>", "<head><meta charset=utf-8><style>p {}</style>", "<title>t</title>", "<head><title>t</title></head><body>"):
        assert html_extract.extract(f"<!DOCTYPE html><html>{head}<article><h1>A title</h1><p>{prose}</p></article>", crf) == f"A title\n\n{prose}"
    inner = f"<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is meant. {prose}</p><noscript><p>{prose} One.</p></noscript><object><p>{prose} Two.</p></object><video><p>{prose} Three.</p></video>"
    want = [f"Here x=2 is meant. {prose}", f"{prose} One.", f"{prose} Two.", f"{prose} Three."]
    assert html_extract.extract(f"<html><head></head><body><article>{inner}<script>no()</script><select><option>no</select></article>", crf).split("\n\n") == want


#: Pages written by hand after common layouts, and the blocks of their main text.
BY_HAND = [
    ("""<!doctype html><html><head><title>Bread</title></head><body class="single-post"><div id="page"><header id="masthead" class="site-header"><h2 class="site-title"><a href="/">Baking notes</a></h2></header>
     <nav class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav>
     <main id="main"><article class="post hentry"><h1 class="entry-title">Baking bread in a cold kitchen</h1><div class="entry-content"><p>The dough wants warmth, but a cold room only makes it slower. Give it a night.</p>
     <h2>What you need</h2><ul><li>Five hundred grams of flour and some patience.</li><li>Water, salt and a little yeast from the shop.</li></ul><blockquote><p>Slow dough is good dough, my teacher used to say.</p></blockquote></div></article>
     <div id="comments" class="comments-area"><h3>Two thoughts</h3><ol class="comment-list"><li class="comment"><p>Worked well for me, thank you for this!</p></li></ol></div></main>
     <aside class="widget-area sidebar"><h3>Recent posts</h3><ul><li><a href="/a">Rye</a></li></ul></aside><footer class="site-footer"><p>&copy; 2020 Baking notes. All rights reserved.</p></footer></div></body></html>""",
     ["Baking bread in a cold kitchen", "The dough wants warmth, but a cold room only makes it slower. Give it a night.", "What you need", "Five hundred grams of flour and some patience.", "Water, salt and a little yeast from the shop.", "Slow dough is good dough, my teacher used to say."]),
    ("""<html><body><div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><div class="menu"><a href=/w>World</a> <a href=/s>Sport</a></div>
     <div class="article-body"><h1>Harbour opens after the storm</h1><p>The harbour opened again on Monday, three days after the storm had passed over the coast.</p><div class="ad">Buy two shoes for the price of one today.</div>
     <p>Boats left at dawn, and the first fish was sold before noon, the port said.</p></div><div class="related-posts"><h3>Read more</h3><p><a href=/x>Storm warning for the north</a></p></div><div id=footer>&copy; The Paper</div></body></html>""",
     ["Harbour opens after the storm", "The harbour opened again on Monday, three days after the storm had passed over the coast.", "Boats left at dawn, and the first fish was sold before noon, the port said."]),
]


def test_html_pages_written_by_hand():
    crf = html_extract.model()
    for page, want in BY_HAND:
        assert html_extract.extract(page, crf).split("\n\n") == want


def test_html_of_hostile_long_pages():
    crf, n, head = html_extract.model(), 1_000_000, "<article><p>A sentence of the story, with words enough to count.</p>"
    hostile = ["<a" * (n // 2), '<a "' * (n // 4), '<a "' * (n // 4 + 1) + ">", '<a ">"' * (n // 6), "<a '\">\"" * (n // 7), "<div>x" * (n // 6), "<" * n, "<!--" * (n // 4), "<![CDATA[" * (n // 9) + ">", "&#" + "9" * n, "&#" + "0" * n + "65;", "</div>" * (n // 6), "<script>" * (n // 8)]
    hostile.append("".join(f"<div class={''.join(chr(97 + int(c)) for c in str(i))}>x" for i in range(n // 18)))
    start = time.time()
    for page in hostile:
        assert html_extract.extract(head + page, crf).startswith("A sentence of the story, with words enough to count.")
    assert time.time() - start < 60


def test_html_tags():
    found = [(t, n, c) for t, n, c, _ in html_extract.scan("a<b x='>'>c</b ><!-- <i> -->d< e <p q=\"u>f</p><xmp><b></xmp>")]
    assert found == [("a", "b", False), ("c", "b", True), ("", "", False), ("d< e ", "p", False), ("f", "p", True), ("", "xmp", False), ("<b>", "xmp", True), ("", "", False)]
    assert [b[:2] for b in html_extract.Page("<p>&#x41;&#65;&#99999999999;&amp;lt;<p>two <b>w</b>").blocks] == [("AA\ufffd&lt;", "p"), ("two w", "p")]


# --- the pipeline ------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    item = " ".join(words(40, 4242, 10**6))
    docs = [(i, t) for i, t in docs if i % 5] + [(900, docs[1][1]), (901, docs[1][1] + " extra"), (902, " ".join(words(100, 31)) + " " + item), (903, " ".join(words(90, 32)) + " password=abcdefghijklmnop1")]
    full = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    full.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LAB).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in rows(corpus_pipeline.run(spark, str(tmp_path)))}
    toxic = {i for i, _, t in labels if t}
    left = [(i, t) for i, t in docs if i not in toxic]
    comp = brute_components(left, 5, 80)
    left = [(i, t) for i, t in left if comp[i][1] == i and i != 902]
    assert set(got) == {i for i, _ in left} and 903 in got and 900 not in got
    enc = bpe.encoding()
    for i, t in left:
        t = t.replace("password=abcdefghijklmnop1", "[REDACTED]")
        assert got[i]["ids"] == enc.encode_ordinary(t) and got[i]["n_chars"] == len(t)


def test_votes_are_those_of_all_cosines(spark):
    import numpy as np

    texts = [f"word{i % 7} said {i} times, and more of it {'!' * (i % 5)}" for i in range(60)] + ["", "Z" * 5000, "語" * 3000]
    lab = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts[:40])], "text string, quality int")
    model = quality.fit(lab.selectExpr("monotonically_increasing_id() AS doc_id", "text", "quality"))
    got = quality.vote(model, texts)
    for t, s in zip(texts, got, strict=True):
        x = quality.vector(t)
        if not x.any():
            assert s == pytest.approx(model["y"].mean())
            continue
        x = x @ model["map"] - model["mean"]
        cos = [float(x @ v / max(np.linalg.norm(x), 1e-9)) for v in model["near"]]
        near = sorted(range(len(cos)), key=lambda i: -cos[i])
        w = [max(cos[i], 1e-3) ** 8 for i in near]
        edge = cos[near[quality.NEIGHBOURS - 1]] - cos[near[quality.NEIGHBOURS]]
        if edge > 1e-5:  # no tie at the border of the neighbourhood
            k = quality.NEIGHBOURS
            assert s == pytest.approx(sum(a * model["y"][i] for a, i in zip(w[:k], near[:k], strict=True)) / sum(w[:k]), abs=1e-3)


def test_quality_reads_long_runs_to_their_end():
    assert quality.shape("a" * 50 + "9") == "x9" and "".join(quality.pieces("ab " + "c" * 100)) == "ab" + "c" * 100
    a, b = (quality.vector("語" * 4000 + x * 4000) for x in ("ア", "9"))
    assert abs(a - b).max() > 0.05
