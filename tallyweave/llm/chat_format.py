r"""Chat formatting by token-level assembly.

Each text is encoded by itself and reserved ids, which no text can yield, are spliced around it, so a turn can't
be forged by what a text says. The template's written form is

    ### User: text</turn>\n

and control strings inside a text are escaped by backslashes: \ to \\, ### to \#\#\#, </turn> to \</turn>. Taking
away each backslash and keeping the character after it gives the text back. The loss mask is the difference of two
prefix sums over the reserved ids (assistant headers begun, turns ended).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import bounded_batches

#: Reserved ids above the vocabulary of 50,257: headers of the known roles, of any other role (whose name follows
#: as tokens up to ROLE_END), and the end of a turn.
HEADERS = {"system": 50257, "user": 50258, "assistant": 50259}
OTHER, ROLE_END, TURN_END = 50260, 50261, 50262
TITLES = {"system": "System", "user": "User", "assistant": "Assistant"}

TURN = "conv_id {conv}, turn {turn}, role string, formatted string, token_ids array<int>, loss_mask array<tinyint>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\#\\#\\#").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def loss_mask(ids: np.ndarray) -> np.ndarray:
    """1 for the tokens between an assistant header and its turn's end."""
    begun = np.cumsum(ids == HEADERS["assistant"])
    ends = ids == TURN_END
    began_in_turn = begun - np.concatenate([[0], np.maximum.accumulate(np.where(ends, begun, 0))])[:-1] if len(ids) else begun
    return ((began_in_turn > 0) & (ids < HEADERS["system"])).astype("i1")


def format_turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """One row per turn, in order inside each partition: conv_id, turn, role, formatted, token_ids, loss_mask, seq
    (0, 1, ... in the conversation), token_start and char_start (prefix sums over the conversation).

    A null text is empty; a null role is written as an unnamed one. Rows go by turn (null first), ties by role, then
    text; extra columns are left out. Conversations with a null id form one of their own. No conversation is gathered in memory: turns are
    encoded where they lie and stay rows, so a conversation may be as long as it likes.
    """

    def step(batches):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True  # their strings in a text are ordinary text
        if tok.get_vocab_size() > HEADERS["system"]:
            raise ValueError("the vocabulary reaches into the reserved ids")
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                rows = part.select(["role", "text"]).to_pylist()
                safe = [escape(r["text"] or "") for r in rows]
                ids = [e.ids for e in tok.encode_batch(safe, add_special_tokens=False)]
                shown, tokens, masks = [], [], []
                for r, text, body in zip(rows, safe, ids):
                    role = r["role"] or ""
                    if role in HEADERS:
                        head, title = [HEADERS[role]], TITLES[role]
                    else:
                        title = escape(role)
                        head = [OTHER, *tok.encode(title, add_special_tokens=False).ids, ROLE_END]
                    shown.append(f"### {title}: {text}</turn>\n")
                    one = np.asarray([*head, *body, TURN_END], "i4")
                    tokens.append(one)
                    masks.append(loss_mask(one))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([r["role"] for r in rows], pa.string()), pa.array(shown), pa.array(tokens, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))],
                    ["conv_id", "turn", "role", "formatted", "token_ids", "loss_mask"],
                )

    kinds = dict(conversations.dtypes)
    cols = bounded_batches(conversations).select("conv_id", "turn", "role", "text")
    turns = cols.mapInArrow(step, TURN.format(conv=kinds["conv_id"], turn=kinds["turn"]))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "formatted")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        turns.withColumn("seq", F.row_number().over(order) - 1)
        .withColumn("token_start", F.coalesce(F.sum(F.size("token_ids")).over(before), F.lit(0)))
        .withColumn("char_start", F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)))
    )


def read_turn(ids: list[int], mask: list[int], tok) -> tuple[str, str, str]:
    """(role, text, text under the loss mask), all read back from the tokens."""
    if ids[0] == OTHER:
        at = ids.index(ROLE_END)
        role, body = unescape(tok.decode(ids[1:at], skip_special_tokens=False)), ids[at + 1 : -1]
    else:
        role, body = {v: k for k, v in HEADERS.items()}[ids[0]], ids[1:-1]
    under = [i for i, m in zip(ids, mask) if m]
    return role, unescape(tok.decode(body, skip_special_tokens=False)), unescape(tok.decode(under, skip_special_tokens=False))


DIGEST = "conv_id {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(turns: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation, read back from format_turns' own rows, which come in order: a running hash."""

    def step(batches):
        import hashlib

        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        at, state, out, tokens = None, None, [], 0

        def close():
            n, turns_h, chars, loss_h, shown = state
            out.append((at, n, turns_h.hexdigest(), chars, loss_h.hexdigest(), shown))

        def batch():
            c = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c[0], kind), pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3], pa.int64()), pa.array(c[4]), pa.array(c[5], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for conv, ids, mask, shown, seq, start in zip(*(b.column(k).to_pylist() for k in range(6))):
                if seq == 0:
                    if state:
                        close()
                    at, state, tokens = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], 0
                if (conv, seq, start) != (at, state[0], tokens):
                    raise ValueError(f"turn {seq} of conversation {conv} is out of place")
                tokens += len(ids)
                role, text, loss = read_turn(ids, mask, tok)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += shown
            if len(out) >= 2000:
                yield batch()
                out = []
        if state:
            close()
        if out:
            yield batch()

    return turns.select("conv_id", "token_ids", "loss_mask", F.length("formatted").cast("long").alias("shown"), "seq", "token_start").mapInArrow(step, DIGEST.format(conv=dict(turns.dtypes)["conv_id"]))
