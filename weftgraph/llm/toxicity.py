"""Toxicity by a learned lexicon, fuzzy matching and context windows.

The lexicon is learned from labelled documents: words, and beginnings of words, that stand in many
different contexts of toxic documents, at odds far above those of others. Its trie, intersected with the
Levenshtein automaton of distance 1, is made deterministic once; documents run through that table,
so misspelled terms are found in one pass over their distinct words. A window around each hit says
whether the term is quoted or used. A logistic model over the sums gives the score.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._util import Scratch, map_batches

#: Least contexts of a term, least length.
CONTEXTS, LEAST = 6, 3
#: Bytes of the trie's table, at most; terms of less weight that it has no room for are matched beside it, by their forms less a character.
BYTES = 64 << 20
#: Labelled training rows that the logistic model is fitted on, at most: those of the least hash of their id.
SAMPLE = 20_000
#: Words on each side that decide between quotation and abuse; weight of a quoted hit.
NEAR, QUOTED = 5, 0.35
#: Share of a term's weight that a misspelled form of it has.
MISSPELLED = 0.8
#: Labels up to this number (12 bytes each) are broadcast; beyond it they are joined by shuffle, once.
BROADCAST = 2_000_000
#: Terms up to this number are broadcast to be counted; beyond it all terms are counted and joined by shuffle.
KNOWN = 400_000
#: Lengths of word beginnings that may become terms, marked by a star.
STEMS = (4, 5, 6, 7, 8, 9)

_edge = " \t\n\r.,!?;:\"'#$%&@^+=()[]{}<>«»“”„‘’|*_~`-–—…¡¿/\\"
_open, _close = "\"“«„‘'", "\"”»“’'"
#: Words that announce a quotation, in the languages of the corpus.
SAYS = frozenset("said says say called calls term word words quote quoted quotes wrote writes means meaning slur dit dites mot terme appelé sagt sagte wort begriff nannte dijo dice palabra término llamó".split())


def tokens(text: str | None) -> list[str]:
    """Lower-cased pieces between white space, with their punctuation."""
    return (text or "").lower().split()


def bare(token: str) -> str:
    return token.strip(_edge)


def _less_one(word: str) -> list[tuple[int, str]]:
    return [(i, word[:i] + word[i + 1 :]) for i in range(len(word))]


class FuzzyTrie:
    """The product of the lexicon's trie and the Levenshtein automaton of distance 1, as a table.

    States are sets of (trie node, edits). Symbol 0 ends a word and changes nothing; characters
    outside the lexicon share symbol 1. Terms that end in a star accept every continuation, and
    are matched without edits; so are terms of fewer than 5 characters. A whole word that is a term
    counts as itself, and not as the continuation of a beginning.
    """

    #: Words that are no misspelled forms although they lie that near to a term.
    barred: frozenset[str] = frozenset()

    #: Terms outside the trie, and which of them take edits: by each form less one character, with the place it had.
    more: dict[str, int] = {}
    shorter: dict[str, list[tuple[int, int]]] = {}

    @classmethod
    def within(cls, terms: list[str], most: int = BYTES) -> FuzzyTrie:
        """All ``terms``: as many of the first as a table of ``most`` bytes holds in the trie, the rest beside it, with their edits."""
        n = len(terms)
        while True:
            try:
                trie = cls(terms[:n], most=most)
                break
            except OverflowError:
                n = n * 3 // 4
        trie.terms, trie.more = terms, {t: k for k, t in enumerate(terms) if k >= n}
        trie.whole = {t: k for k, t in enumerate(terms) if not t.endswith("*")}
        trie.shorter = {}
        for t, k in trie.more.items():
            if len(t) >= 5 and not t.endswith("*"):
                for i, form in _less_one(t):
                    trie.shorter.setdefault(form, []).append((k, i))
        return trie

    def near(self, word: str) -> int:
        """The first term outside the trie at one edit from ``word`` (-1: none): one of them less a character is the other, or both less the character at one place are equal."""
        got = [self.more[form] for _, form in _less_one(word) if len(form) >= 5 and not form.endswith("*") and form in self.more]
        got += [k for k, _ in self.shorter.get(word, ())]
        got += [k for i, form in _less_one(word) for k, j in self.shorter.get(form, ()) if i == j]
        return min(got, default=-1)

    def __init__(self, terms: list[str], width: int = 24, most: int | None = None):
        import numpy as np

        self.terms, self.width = terms, width
        self.whole = {t: k for k, t in enumerate(terms) if not t.endswith("*")}
        kids: list[dict] = [{}]
        ends: list[int] = [-1]
        stars: list[int] = [-1]
        fuzzy_below: list[bool] = [False]  # a fuzzy term lies at or below the node
        for k, term in enumerate(terms):
            node, word = 0, term.rstrip("*")
            path = [0]
            for c in word:
                if c not in kids[node]:
                    kids[node][c] = len(kids)
                    kids.append({})
                    ends.append(-1)
                    stars.append(-1)
                    fuzzy_below.append(False)
                node = kids[node][c]
                path.append(node)
            if term.endswith("*"):
                stars[node] = k
            else:
                ends[node] = k
                if len(word) >= 5:
                    for p in path:
                        fuzzy_below[p] = True
        letters = sorted({c for d in kids for c in d})
        self.symbol = {c: i + 2 for i, c in enumerate(letters)}
        n_sym = len(letters) + 2
        start = frozenset({(0, 0)})
        index, todo, rows, accepts = {start: 0}, [start], [], []
        dead = frozenset()
        star_state: dict[int, int] = {}

        def closed(states):
            # keep the fewest edits for each node
            best: dict[int, int] = {}
            for node, e in states:
                best[node] = min(e, best.get(node, 9))
            return frozenset(best.items())

        def step(states, c):
            out = set()
            for node, e in states:
                if c in kids[node]:
                    out.add((kids[node][c], e))
                if e == 0 and fuzzy_below[node]:
                    out.add((node, 1))
                    for child in kids[node].values():
                        if fuzzy_below[child]:
                            out.add((child, 1))
                            if c in kids[child] and fuzzy_below[kids[child][c]]:
                                out.add((kids[child][c], 1))
            return closed(out)

        def number(states):
            if states not in index:
                index[states] = len(index)
                todo.append(states)
            return index[states]

        at = 0
        while at < len(todo):
            if most is not None and terms and 4 * n_sym * (len(todo) + len(terms)) > most:  # a row of a starred term is added at most for each
                raise OverflowError
            states = todo[at]
            at += 1
            # (term, edits) at the end of the word
            hit = (-1, 9)
            for node, e in states:
                if node >= 0 and ends[node] >= 0 and (e == 0 or len(terms[ends[node]]) >= 5):
                    hit = min(hit, (ends[node], e), key=lambda x: x[1])
                for child in kids[node].values() if e == 0 else ():
                    if ends[child] >= 0 and len(terms[ends[child]]) >= 5 and hit[1] > 1:
                        hit = (ends[child], 1)
            starred = next((stars[node] for node, e in states if e == 0 and stars[node] >= 0), -1)
            accepts.append((hit, starred))
            row = [number(step(states, "\0"))] * n_sym
            row[0] = index[states]
            for c in {c for node, e in states for c in kids[node]} | {c for node, e in states if e == 0 for ch in kids[node].values() for c in kids[ch]}:
                row[self.symbol[c]] = number(step(states, c))
            rows.append(row)
        # starred states swallow what follows
        extra = len(rows)
        for i, (hit, starred) in enumerate(accepts):
            if starred >= 0 and starred not in star_state:
                star_state[starred] = extra + len(star_state)
        rows += [[s] * n_sym for s in star_state.values()]
        accepts += [((k, 0), k) for k in star_state]
        table = np.array(rows, dtype=np.int32)
        to_star = np.arange(len(rows), dtype=np.int32)
        for i, (_, starred) in enumerate(accepts[:extra]):
            if starred >= 0:
                to_star[i] = star_state[starred]
        self.table = to_star[table]
        self.table[:, 0] = np.arange(len(rows))
        self.start = int(to_star[0])
        self.term = np.array([k if k >= 0 else -1 for (k, _), _ in accepts], dtype=np.int32)
        self.edits = np.array([e for (_, e), _ in accepts], dtype=np.int8)
        self.starred = np.array([t.endswith("*") for t in terms] + [False])  # the last for no term
        self.codes = np.ones(0x11000, dtype=np.int32)
        self.codes[0] = 0
        for c, i in self.symbol.items():
            if ord(c) < len(self.codes):
                self.codes[ord(c)] = i
        del dead

    def match(self, words: list[str]):
        """For each word the index of its term (-1: none) and the edits. ``width`` exceeds every term by more than the distance."""
        import numpy as np

        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int8)
        raw = np.array(words, dtype=f"<U{self.width}").view(np.uint32).reshape(len(words), self.width)
        sym = self.codes[np.minimum(raw, len(self.codes) - 1)]
        state = np.full(len(words), self.start, np.int32)
        for i in range(self.width):
            state = self.table[state, sym[:, i]]
        term, edits = self.term[state], self.edits[state]
        if self.more:
            for i in np.flatnonzero((term < 0) | (edits > 0)):
                w = words[i]
                k = next((k for t in (w, *(w[:n] + "*" for n in STEMS if len(w) >= n)) if (k := self.more.get(t)) is not None), None)
                if k is not None:
                    term[i], edits[i] = k, 0
                elif term[i] < 0 and (k := self.near(w)) >= 0:
                    term[i], edits[i] = k, 1
        for i in np.flatnonzero((term >= 0) & ((edits > 0) | self.starred[np.minimum(term, len(self.starred) - 1)])):
            if edits[i] == 0:
                term[i] = self.whole.get(words[i], term[i])
            elif words[i] in self.barred:
                term[i] = -1
        return term, edits


def quoted(words: list[str], i: int) -> bool:
    """Is the token in quotation marks within the window, or announced by a word of saying?"""
    w = words[i]
    lo = max(0, i - NEAR)
    opened = any(x[0] in _open and (x[-1] not in _close or len(x) == 1) for x in words[lo:i] if x) or w[0] in _open
    closed = any(x[-1] in _close for x in words[i : i + NEAR + 1] if x) or (len(w) > 1 and w.rstrip(".,!?;:")[-1:] in _close)
    said = any(bare(x) in SAYS for x in words[max(0, i - 3) : i])
    return (opened and closed) or (said and w[0] in _open)


def features(words: list[str], hits: dict, weights: list[float]) -> list[float]:
    """Sums over the hits of one document; ``hits`` maps tokens to (term, edits)."""
    exact = fuzzy = stem = cited = 0.0
    for i, w in enumerate(words):
        got = hits.get(w)
        if got is None:
            continue
        k, e, starred = got
        v = weights[k]
        if quoted(words, i):
            cited += v
            v *= QUOTED
        if starred:
            stem += v
        elif e:
            fuzzy += v
            exact += MISSPELLED * v
        else:
            exact += v
    return [math.log1p(exact), math.log1p(stem), float(exact > 0), float(fuzzy > 0), float(stem > 0), math.log1p(cited), math.log1p(exact + stem) / math.log(math.e + len(words))]


def _unmarked(texts):
    return [tokens(t) for t in texts]


def _terms(word: str):
    """A word and its starred beginnings."""
    if LEAST <= len(word) <= 20 and not word.isdigit():
        yield word
        for n in STEMS:
            if len(word) > n:
                yield word[:n] + "*"


def _counts(rows: DataFrame, known=None) -> DataFrame:
    """term, n: documents of ``rows`` (text) that hold a term (of those in the broadcast ``known``, if given). Batches are summed up before the shuffle."""

    def make():
        only = None if known is None else known.value

        def fn(cols):
            out: dict[str, int] = {}
            for text in cols["text"]:
                got = {t for w in set(map(bare, set(tokens(text)))) for t in _terms(w)}
                for t in got if only is None else got & only:
                    out[t] = out.get(t, 0) + 1
            return {"term": list(out), "n": list(out.values())}

        return fn

    return map_batches(rows, make, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _known(terms: DataFrame):
    """The column ``term`` as a broadcast set, or None if it is longer than KNOWN."""
    if terms.limit(KNOWN + 1).count() > KNOWN:
        return None
    return terms.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in terms.select("term").collect()))


def _contexts(rows: DataFrame, known=None) -> DataFrame:
    """term, word, ctx of the terms (in the broadcast ``known``, if given): the full word and the word before it."""

    def make():
        only = None if known is None else known.value

        def fn(cols):
            seen = set()
            for text in cols["text"]:
                before = ""
                for w in map(bare, tokens(text)):
                    seen.update((t, w, before) for t in _terms(w) if only is None or t in only)
                    before = w
            rows = list(seen)
            return {"term": [r[0] for r in rows], "word": [r[1] for r in rows], "ctx": [r[2] for r in rows]}

        return fn

    return map_batches(rows, make, "term string, word string, ctx string").distinct()


def _ratio(labelled: DataFrame) -> float:
    """Clean rows per toxic one."""
    total = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    return (total.get(0, 0) + 1) / (total.get(1, 0) + 1)


def _odds(n: str, ratio: float):
    """Log odds of toxic uses against the documents in the column ``clean``."""
    return F.log((F.col(n) + 0.1) * F.lit(ratio) / (F.col("clean") + 0.5))


def learn_lexicon(labelled: DataFrame, scratch: Scratch) -> list[tuple[str, float]]:
    """Terms and weights from ``labelled`` (text, toxic), from counts over all rows: those of most odds in most contexts first.

    First the documents of each class are counted per term, for all terms that CONTEXTS toxic documents
    hold; only for terms that stand out are contexts looked at. A context is the pair of a
    word and the word before it, so copies of a document count once.
    """
    toxic, fine = labelled.where("toxic = 1").select("text"), labelled.where("toxic = 0").select("text")
    cand = scratch.save(_counts(toxic).where(f"n >= {CONTEXTS}"))
    clean = _counts(fine, _known(cand)).select("term", F.col("n").alias("clean"))
    ratio = _ratio(labelled)
    apart = cand.join(clean, "term", "left").select("term", "n", F.coalesce("clean", F.lit(0)).alias("clean"))
    apart = scratch.save(apart.where(_odds("n", ratio) >= 3))
    seen = _contexts(toxic, _known(apart)).join(apart.select("term"), "term", "left_semi")
    seen = seen.groupBy("term").agg(F.count("*").alias("ctx"), F.countDistinct("word").alias("words"), F.countDistinct("ctx").alias("befores"))
    seen = seen.where(f"ctx >= {CONTEXTS} AND befores >= {CONTEXTS} AND (term NOT LIKE '%*' OR words >= 4)")
    best = apart.join(seen, "term").withColumn("odds", _odds("ctx", ratio)).where("odds >= 3")
    got = best.orderBy(F.desc(F.col("odds") * F.sqrt("ctx")), "term").select("term", "odds", "ctx").collect()  # what stands out, whole
    # shorter beginnings first, made longer while that loses few contexts; beginnings that a kept one covers are left out,
    # whole words stay for their misspelled forms
    starred: dict[str, list] = {}
    for r in sorted((r for r in got if r.term.endswith("*")), key=lambda r: (len(r.term), r.term)):
        starred.setdefault(r.term[: STEMS[0]], []).append(r)
    stems: set[str] = set()
    for group in starred.values():
        kept: list[str] = []
        for r in group:
            if not any(r.term.startswith(s) or s.startswith(r.term[:-1]) for s in kept):
                for longer in group:
                    if longer.term.startswith(r.term[:-1]) and longer.ctx >= 0.9 * r.ctx and len(longer.term) > len(r.term):
                        r = longer
                kept.append(r.term[:-1])
        stems.update(kept)
    return [(r.term, r.odds) for r in got if not r.term.endswith("*") or r.term[:-1] in stems]


def _scan(trie: FuzzyTrie, texts):
    """Tokens of each text, and the hits of all."""
    docs = _unmarked(texts)
    distinct = list(set().union(*docs)) if docs else []
    plain = [bare(w) for w in distinct]
    term, edits = trie.match(plain)
    hits = {distinct[i]: (int(term[i]), int(edits[i]), trie.terms[term[i]].endswith("*")) for i in (term >= 0).nonzero()[0] if plain[i]}
    return docs, hits


def _fit(x, y, rounds: int = 60, ridge: float = 0.05):
    """Logistic regression by Newton's method."""
    import numpy as np

    x = np.hstack([np.asarray(x, float).reshape(len(y), -1), np.ones((len(y), 1))])
    y, w = np.asarray(y, float), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * w
        pull[-1] *= 0.01
        grad = x.T @ (p - y) + pull
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move
        if abs(move).max() < 1e-7:
            break
    return w


def _own_words(labelled: DataFrame, trie: FuzzyTrie) -> frozenset[str]:
    """Words of clean documents that are no misspelled forms: in all of ``labelled``, toxic documents do not hold them at the odds of a term."""
    shared = labelled.sparkSession.sparkContext.broadcast(trie)

    def make():
        trie = shared.value

        def fn(cols):
            found: dict[tuple[str, int], int] = {}
            for k in range(0, len(cols["text"]), 400):
                docs, hits = _scan(trie, cols["text"][k : k + 400])
                for d, toxic in zip(docs, cols["toxic"][k : k + 400], strict=True):
                    for w in {bare(w) for w in set(d) & hits.keys() if hits[w][1] > 0}:
                        found[w, toxic] = found.get((w, toxic), 0) + 1
            return {"word": [w for w, _ in found], "toxic": [t for _, t in found], "n": list(found.values())}

        return fn

    forms = map_batches(labelled.select("text", "toxic"), make, "word string, toxic int, n bigint").groupBy("word")
    forms = forms.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"))
    own = forms.where("clean > 0").where(_odds("n", _ratio(labelled)) < 3)
    return frozenset(r.word for r in own.select("word").collect())  # within one edit of a term


def fit(labelled: DataFrame) -> dict:
    """The model from ``labelled`` (doc_id, text, toxic): lexicon from all rows, logistic weights from a bounded sample."""
    scratch = Scratch(labelled.sparkSession)
    labelled = labelled.where("toxic IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    lexicon = learn_lexicon(labelled, scratch)
    trie = FuzzyTrie.within([t for t, _ in lexicon])
    weights = [w for _, w in lexicon]
    least = labelled.select("doc_id", "toxic").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("_id")).distinct()
    sample = labelled.join(F.broadcast(least), F.col("doc_id") == F.col("_id"), "left_semi")
    trie.barred = _own_words(labelled, trie)
    shared = labelled.sparkSession.sparkContext.broadcast((trie, weights))

    def make():
        trie, weights = shared.value

        def fn(cols):
            out = []
            for k in range(0, len(cols["text"]), 400):
                docs, hits = _scan(trie, cols["text"][k : k + 400])
                out += [features(d, hits, weights) for d in docs]
            return {"toxic": cols["toxic"], "x": out}

        return fn

    rows = map_batches(sample.select("text", "toxic"), make, "toxic int, x array<double>").limit(SAMPLE).collect()
    w = _fit([r.x for r in rows], [r.toxic for r in rows]) if rows else [0.0] * 8
    return {"trie": trie, "weights": weights, "w": [float(v) for v in w], "lexicon": lexicon}


def score(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """key, score, n_hits. The text alone decides; null and empty texts get the model's base rate."""
    shared = docs.sparkSession.sparkContext.broadcast((model["trie"], model["weights"], model["w"]))
    kind = docs.schema[key].dataType.simpleString()

    def make():
        trie, weights, w = shared.value

        def fn(cols):
            out, n = [], []
            for k in range(0, len(cols["text"]), 400):
                docs, hits = _scan(trie, cols["text"][k : k + 400])
                for d in docs:
                    x = features(d, hits, weights)
                    z = sum(a * b for a, b in zip(x, w, strict=False)) + w[-1]
                    out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                    n.append(sum(1 for t in d if t in hits))
            return {"key": cols["key"], "score": out, "n_hits": n}

        return fn

    return map_batches(docs.select(F.col(key).alias("key"), "text"), make, f"key {kind}, score double, n_hits bigint").withColumnRenamed("key", key)


def training_rows(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """Labelled rows outside the held-out fold; a document's labels if they repeat: the greatest."""
    lab = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text")
    if lab.limit(BROADCAST + 1).count() <= BROADCAST:
        return rows.join(F.broadcast(lab), "doc_id")
    return Scratch(docs.sparkSession).save(rows.join(lab, "doc_id"))  # several passes follow


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits for every document."""
    model = fit(training_rows(docs, labels))
    out = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns."""
    model = fit(training_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast((model["trie"], model["weights"], model["w"]))
    keep = docs.columns

    def make():
        import numpy as np

        trie, weights, w = shared.value

        def fn(cols):
            good = []
            for k in range(0, len(cols["text"]), 400):
                found, hits = _scan(trie, cols["text"][k : k + 400])
                x = np.array([features(d, hits, weights) for d in found])
                z = x @ np.array(w[:-1]) + w[-1]
                good += list(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold)
            return {c: [v for v, g in zip(cols[c], good, strict=True) if g] for c in keep}

        return fn

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, make, fields)
