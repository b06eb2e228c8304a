"""Quality by nearest-neighbour voting over latent-semantic vectors.

Documents become weighted counts of hashed words and word shapes; a truncated SVD of a labelled
sample gives the latent space. The sample's vectors are broadcast (their number is a parameter) and
every document's exact cosines to all of them are computed in blocks; the nearest labels vote by
similarity.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._util import map_batches

#: Labelled rows in the model, at most (those of the least hash of their id); dimensions; neighbours; documents of a block.
SAMPLE, DIMS, NEIGHBOURS, BLOCK = 3000, 48, 15, 256
#: Hash slots of words, of word shapes and of pairs of shapes; more slots for repetition.
WORDS, SHAPES, PAIRS, MORE = 1024, 256, 512, 4
WIDTH = WORDS + SHAPES + PAIRS + MORE
#: Weight of the words' block against the shapes' block of a vector.
WORD_SHARE = 0.35
#: A run without blanks counts as consecutive pieces of so many characters; pieces in a worker's memory.
PIECE, CACHE = 40, 300_000

_known: dict = {}


def shape(word: str) -> str:
    """Runs of letters, digits and signs, with the case of letters, each written once."""
    out, last = [], ""
    for c in word:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if k != last:
            out.append(k)
            last = k
    return "".join(out)


def _slots(word: str):
    import xxhash

    got = _known.get(word)
    if got is None:
        if len(_known) >= CACHE:
            _known.clear()
        got = _known[word] = (xxhash.xxh3_64_intdigest(word.lower()) % WORDS, xxhash.xxh3_64_intdigest(shape(word), seed=1) % SHAPES)
    return got


def pieces(text: str) -> list[str]:
    """The words of a text; longer runs without blanks are cut, so that all of them counts."""
    return [w[k : k + PIECE] for w in text.split() for k in range(0, len(w), PIECE)]


def vector(text: str | None):
    """Log counts: words, shapes, pairs of neighbouring shapes, repeated words and lines."""
    import numpy as np

    text = text or ""
    words = pieces(text)
    out = np.zeros(WIDTH, np.float32)
    if not words:
        return out
    slots = np.array([_slots(w) for w in words])
    out[:WORDS] = np.bincount(slots[:, 0], minlength=WORDS)
    s = slots[:, 1]
    out[WORDS : WORDS + SHAPES] = np.bincount(s, minlength=SHAPES)
    if len(s) > 1:
        out[WORDS + SHAPES : WORDS + SHAPES + PAIRS] = np.bincount((s[:-1] * 31 + s[1:] * 7) % PAIRS, minlength=PAIRS)
    lines = text.split("\n")
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out[-MORE:] = [8 * again, 8 * (len(lines) - len(set(lines))), len(words) - len(set(words)), 8 * sum(w.isupper() and len(w) > 1 for w in words)]
    out = np.log1p(out)
    a, b = np.linalg.norm(out[:WORDS]), np.linalg.norm(out[WORDS:])
    if a:
        out[:WORDS] *= WORD_SHARE / a
    if b:
        out[WORDS:] *= math.sqrt(1 - WORD_SHARE**2) / b
    return out


def fit(labelled: DataFrame) -> dict:
    """The model from ``labelled`` (doc_id, text, quality), of which at most SAMPLE rows are used."""
    import numpy as np

    labelled = labelled.where("quality IS NOT NULL")
    least = labelled.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(SAMPLE)
    sample = labelled.join(F.broadcast(least), "doc_id", "left_semi").select("text", F.col("quality").cast("int").alias("quality"))

    def make():
        def fn(cols):
            return {"v": [vector(t).astype(np.float16).tobytes() for t in cols["text"]], "quality": cols["quality"]}

        return fn

    rows = map_batches(sample, make, "v binary, quality int").limit(SAMPLE).collect()
    if not rows:
        return {"map": np.zeros((WIDTH, 1), np.float32), "mean": np.zeros(WIDTH, np.float32), "near": np.zeros((0, 1), np.float32), "y": np.zeros(0)}
    x = np.stack([np.frombuffer(r.v, np.float16) for r in rows]).astype(np.float32)
    y = np.array([r.quality for r in rows], float)
    # inverse document frequencies of the sample, then the leading right singular vectors
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.2
    values, vectors = np.linalg.eigh((x * idf).T @ (x * idf))
    k = min(DIMS, len(x), WIDTH)
    to = (idf[:, None] * vectors[:, ::-1][:, :k]).astype(np.float32)
    mean = (x @ to).mean(0)
    near = x @ to - mean
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    return {"map": to, "mean": mean, "near": near, "y": y}


def vote(model: dict, texts) -> list[float]:
    """Scores of texts: exact cosines of a block to all labelled vectors, then a vote weighted by similarity."""
    import numpy as np

    near, y = model["near"], model["y"]
    if not len(y):
        return [0.5] * len(texts)
    base, out = float(y.mean()), []
    for k in range(0, len(texts), BLOCK):
        x = np.stack([vector(t) for t in texts[k : k + BLOCK]])
        empty = ~x.any(1)
        x = x @ model["map"] - model["mean"]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        cos = x @ near.T
        m = min(NEIGHBOURS, cos.shape[1])
        top = np.argpartition(-cos, m - 1, axis=1)[:, :m]
        w = np.maximum(np.take_along_axis(cos, top, 1), 1e-3) ** 8
        s = np.clip((w * y[top]).sum(1) / w.sum(1), 0.0, 1.0)
        out += [float(v) for v in np.where(empty, base, s)]
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Texts without words get the share of good rows in the sample; without labels all get 0.5.
    Repeated labels of a document: the greatest counts. One pass over the texts, no shuffle of them
    but of the labelled rows.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))
    lab = labels.where(fold != held).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    least = lab.where("quality IS NOT NULL").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(SAMPLE)
    model = fit(docs.select("doc_id", "text").join(F.broadcast(least), "doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def fn(cols):
            s = vote(shared.value, cols["text"])
            return {"doc_id": cols["doc_id"], "score": s}

        return fn

    out = map_batches(docs.select("doc_id", "text"), make, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
