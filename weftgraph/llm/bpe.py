"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._util import map_batches, vocabulary

RANKS = vocabulary("byte_bpe_50k.tiktoken")
#: Fixed value: the pre-token pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this many characters are encoded in pieces.
PIECE = 65_536

_encodings: dict = {}


def encoding(path: str = RANKS):
    """The tiktoken encoding of a local rank file; one per Python worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def pieces(text: str, size: int = PIECE):
    """Cut a long text where no pre-token can cross: an ASCII letter or digit, then a blank or line feed.

    Every alternative of the pattern holds white space only at its start (or nothing but white
    space), so none has a non-space followed by a space, and the look-ahead of the white-space
    alternative only sees what follows white space. Where no such place exists the piece goes on.
    """
    start, n = 0, len(text)
    while n - start > size:
        cut = start + size
        while cut < n and not (text[cut] in " \n" and text[cut - 1].isascii() and text[cut - 1].isalnum()):
            cut += 1
        if cut >= n:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode(text: str, enc) -> list[int]:
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in pieces(text):
        out += enc.encode_ordinary(piece)
    return out


def _digests(path):
    import numpy as np

    enc = encoding(path)

    def fn(cols):
        n, ids_sha, dec_sha = [], [], []
        for text in cols["text"]:
            ids = encode(text or "", enc)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
            dec_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": dec_sha}

    return fn


def encode_texts(docs: DataFrame, path: str = RANKS, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``ids array<int>``. A null or empty text gives an empty array.

    A column of ``docs`` that is called ``ids`` is replaced.
    """
    docs = docs.drop("ids")
    keep = docs.columns

    def make():
        enc = encoding(path)

        def fn(cols):
            return {c: cols[c] for c in keep} | {"ids": [encode(t or "", enc) for t in cols[text]]}

        return fn

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, make, f"{fields}, `ids` array<int>")


def decode_ids(df: DataFrame, path: str = RANKS, ids: str = "ids") -> DataFrame:
    """All columns plus ``bytes binary``, the raw bytes of the ids (null ids: empty)."""
    df = df.drop("bytes")
    keep = df.columns

    def make():
        enc = encoding(path)

        def fn(cols):
            return {c: cols[c] for c in keep} | {"bytes": [enc.decode_bytes(x or []) for x in cols[ids]]}

        return fn

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(df, make, f"{fields}, `bytes` binary")


def encode_digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per document; one pass, no shuffle.

    Null and empty texts have no tokens and the digests of nothing; repeated rows give repeated
    results; other columns are not read.
    """
    return map_batches(docs.select("doc_id", F.col("text")), lambda: _digests(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
