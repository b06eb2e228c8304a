"""Token counts by the whole-token shortcut for a word-end BPE (tokenizers JSON file).

The vocabulary is proved once on the driver: a pre-token whose merges end in one symbol counts 1
without merging. Only the other pre-tokens are merged (by the library, once per distinct one and
worker).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from weftgraph.llm._util import map_batches, vocabulary

MODEL = vocabulary("word_bpe_49k.json")
#: Fixed value: the pre-token pattern of the model file, with \s spelled out.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Distinct pieces that a worker keeps, and characters of the longest that it keeps (some 100 MB at most).
CACHE, LONGEST = 400_000, 64

_state: dict = {}
_separators = re.compile(r"[\x1c-\x1f]")
#: What lies between ASCII white space. Neither normalising nor splitting reaches across it.
_piece = re.compile(r"[^\t-\r ]+")
#: Letters of byte-level vocabularies that stand for themselves; every other byte has another letter.
_plain = re.compile(r"[\x21-\x7e]*")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merges of lowest rank until none is left."""
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: ranks.get((symbols[i], symbols[i + 1]), 1 << 60))
        pair = (symbols[best], symbols[best + 1])
        if pair not in ranks:
            break
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                out.append(pair[0] + pair[1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def prove(path: str = MODEL) -> frozenset[str]:
    """The pre-tokens (plain text) that the model encodes as one token; bounded by the vocabulary."""
    import regex

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    ranks = {p: i for i, p in enumerate(pairs)}
    end, back = model["end_of_word_suffix"] or "", {c: b for b, c in byte_letters().items()}
    whole, one = regex.compile(PRETOKEN), set()
    for entry in model["vocab"]:
        if not entry.endswith(end) or len(entry) == len(end):
            continue
        letters = entry[: len(entry) - len(end)]
        try:
            word = bytes(back[c] for c in letters).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if whole.fullmatch(word) and merged([*letters[:-1], letters[-1] + end], ranks) == [entry]:
            one.add(word)
    return frozenset(one)


def _library(path):
    if path not in _state:
        import regex
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        with open(path, encoding="utf-8") as f:
            special = sorted((t["content"] for t in json.load(f)["added_tokens"]), key=len, reverse=True)
        _state[path] = (tok, regex.compile(PRETOKEN), re.compile("|".join(map(re.escape, special)) or r"(?!)"), {})
    return _state[path]


def counter(path: str, whole: frozenset[str]):
    """A function from a list of texts to their numbers of tokens.

    No pre-token crosses ASCII white space, so texts are cut there and each distinct piece is counted once per
    worker: its pre-tokens that are whole tokens count 1, the others are merged. Pieces of ASCII are lower-cased
    and split here; all others go through the library's own normaliser and pre-tokeniser, since Python's
    Unicode tables are of another version.
    """
    tok, pre, special, cache = _library(path)
    model, letters = tok.model, str.maketrans(byte_letters())
    spelled = lambda word: word if _plain.fullmatch(word) else word.encode().decode("latin-1").translate(letters)
    whole_spelled = frozenset(map(spelled, whole))

    def ascii_piece(words):
        return sum(1 if w in whole else len(model.tokenize(spelled(w))) for w in pre.findall(words))

    def other_piece(words):
        found = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(words))
        return sum(1 if w in whole_spelled else len(model.tokenize(w)) for w, _ in found)

    def cut(text):
        if text.isascii():
            text = text.lower()
            # U+001C to U+001F part words in Python, not in the model
            return pre.findall(text) if _separators.search(text) else text.split()
        return [w.lower() if w.isascii() else w for w in _piece.findall(text)]

    def count(texts):
        found = []
        for text in texts:
            words, n = [], 0
            if text:
                parts = special.split(text)
                n = len(parts) - 1
                for part in parts:
                    words += cut(part)
            for w in words:
                if (k := cache.get(w)) is None:
                    k = ascii_piece(w) if w.isascii() else other_piece(w)
                    if len(w) <= LONGEST:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[w] = k
                n += k
            found.append(n)
        return found

    return count


def token_counts(docs: DataFrame, path: str = MODEL, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document; one pass, no shuffle.

    Special strings inside a text count 1 each, as the library takes them by default. Null and
    empty texts have no bytes and no tokens; repeated rows give repeated results; other columns
    are not read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove(path))

    def make():
        count = counter(path, whole.value)

        def fn(cols):
            texts = cols["text"]
            n = [c for k in range(0, len(texts), 500) for c in count(texts[k : k + 500])]
            return {"doc_id": cols["doc_id"], "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [c > limit for c in n]}

        return fn

    return map_batches(docs.select("doc_id", "text"), make, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
