"""Chat formatting by token-level assembly.

Each segment (role, text) is encoded by itself; reserved ids above the vocabulary are spliced in
between, so no text can produce them. Loss masks come from prefix sums of the segment lengths.
Control strings that occur in a text are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from weftgraph.llm._util import map_batches, shipped, slices
from weftgraph.llm.bpe import RANKS, encode, encoding

#: Reserved ids and how the template writes them; the ids lie above the 50,256 ranks and the free id 50256.
BEGIN, TURN, SEP, END = 50257, 50258, 50259, 50260
WRITTEN = {BEGIN: "<s>", TURN: "[INST]", SEP: "[/INST]", END: "</s>"}
#: Strings that must not appear unescaped inside a text: the template's own and those of other common templates.
CONTROL = [*WRITTEN.values(), "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>"]
_control = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    """Double backslashes, then put one after the first character of each control string."""
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undo :func:`escape`: two backslashes are one, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


def assemble(role: str, text: str, first: bool, enc, learn=("assistant",)):
    """The ids of one turn and its loss mask."""
    parts = [([BEGIN] if first else []) + [TURN], encode(escape(role), enc), [SEP], encode(escape(text), enc), [END]]
    ends = [0]
    for p in parts:
        ends.append(ends[-1] + len(p))
    step = [0] * (ends[-1] + 1)
    if role in learn:
        step[ends[3]] += 1
        step[ends[4]] -= 1
    mask, on = [], 0
    for s in step[:-1]:
        on += s
        mask.append(on)
    return [i for p in parts for i in p], mask


def format_turns(conversations: DataFrame, path: str = RANKS, learn=("assistant",)) -> DataFrame:
    """One row per turn: conv_id, pos, ids array<int>, mask array<int>, in the order of the conversation.

    The ids of a conversation are those of its turns one after the other. Turns are ordered by
    turn (null first), then role and text, so ties and repeated rows keep a defined place; null
    roles and texts are empty; rows of a null conv_id form one conversation. A conversation of any
    length streams through its task; nothing holds it whole.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def make():
        enc, at = encoding(path), [object(), 0]

        def fn(cols):
            pos, ids, masks = [], [], []
            for conv, role, text in zip(cols["conv_id"], cols["role"], cols["text"], strict=True):
                at[:] = [conv, at[1] + 1] if conv == at[0] else [conv, 0]
                a, b = assemble(role, text, at[1] == 0, enc, learn)
                pos.append(at[1])
                ids.append(a)
                masks.append(b)
            return {"conv_id": cols["conv_id"], "pos": pos, "ids": ids, "mask": masks}

        return fn

    return map_batches(rows, make, "conv_id bigint, pos bigint, ids array<int>, mask array<int>")


def read_back(turns: DataFrame, path: str = RANKS) -> DataFrame:
    """Per conversation, from the ids and masks of :func:`format_turns` alone:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Relies on the order that format_turns leaves in each partition.
    """

    def run(batches):
        import pyarrow as pa

        enc, conv, state = encoding(path), None, None

        def row():
            n, all_, chars, loss, size = state
            return {"conv_id": conv, "n_turns": n, "turns_sha256": all_.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        for batch in slices(batches):
            done = []
            for c, pos, ids, mask in zip(*(batch[k].to_pylist() for k in ("conv_id", "pos", "ids", "mask")), strict=True):
                if state is None or c != conv or pos == 0:
                    if state:
                        done.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                sep, begin = ids.index(SEP), ids.index(TURN) + 1
                role, text = (enc.decode_bytes(x).decode() for x in (ids[begin:sep], ids[sep + 1 : -1]))
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                under = unescape(enc.decode_bytes([i for i, m in zip(ids, mask, strict=True) if m]).decode())
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += len(role) + len(text) + sum(len(WRITTEN[i]) for i in ids if i in WRITTEN)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
        if state:
            yield pa.RecordBatch.from_pylist([row()], schema=out)

    import pyarrow as pa

    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return shipped(turns).mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def format_conversations(conversations: DataFrame, path: str = RANKS) -> DataFrame:
    """One row per conversation with its whole ids and mask (for conversations that fit in a row)."""
    turns = format_turns(conversations, path)
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ids", "mask"))).alias("t"))
    return turns.select("conv_id", F.flatten("t.ids").alias("ids"), F.flatten("t.mask").alias("mask"))
