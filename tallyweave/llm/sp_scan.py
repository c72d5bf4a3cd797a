"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text is the best path over its pieces' scores (Viterbi). A giant text is cut into chunks.
A state at a chunk's border is how far the piece that crosses it reaches beyond (0 to the longest piece less one);
each chunk yields the matrix of best scores from entry state to exit state. Matrices multiply associatively in
max-plus: chunks into groups, groups along the text, which fixes the states at all borders; then each chunk is
traced back by itself. A text of one chunk enters and leaves at state 0, so it needs no scan.

Scores are those in the model's file, unknown characters scoring UNKNOWN_PENALTY less than the worst piece and
falling back to bytes. They are whole numbers in the public vocabulary, so sums are exact. Of equal scores the path
with the longer last piece is taken inside a chunk, and the smaller state at a border.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SHORT, bounded_batches, per_process, saved, shuffle_partitions

CHUNK_CHARS = 32_768
GROUP = 256  # chunks whose matrices one task multiplies
UNKNOWN_PENALTY = 10.0
MEMO_WORDS = 400_000
SPACE = "▁"
NONE = -np.inf
_LETTERS = re.compile(r"[^\W\d_]+")


class _Plain(dict):
    """Ids of what stands between two sure borders."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, text: str) -> bytes:
        ids = self.model.search(text)
        if len(text) <= SHORT:
            self[text] = ids
        return ids


class _AfterSpace(dict):
    """Ids of what follows a single space, with the space; newlines, letters and signs apart where the pieces allow."""

    def __init__(self, model: PieceModel, plain: _Plain):
        self.model, self.plain = model, plain

    def __missing__(self, text: str) -> bytes:
        if self.model.alone and "\n" in text:  # hardly ever met again
            first, *rest = text.split("\n")
            return self[first] + b"".join([self.plain["\n"] + (self.plain[r] if r else b"") for r in rest])
        m = _LETTERS.match(text)
        if m and m.end() < len(text) and text[m.end() - 1 : m.end() + 1] not in self.model.joins:
            ids = self[m[0]] + self.plain[text[m.end() :]]
        else:
            ids = self.model.search(SPACE + text)
        if len(text) <= SHORT:
            self[text] = ids
        return ids


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in usable}
        self.score = {self.pieces[i]: float(sp.get_score(i)) for i in usable}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        # scores of pieces and, as no score at all, of what only begins one
        self.starts = {p[:n]: NONE for p in self.ids for n in range(1, len(p))} | self.score
        self.starts |= {c: self.unknown for c, s in self.starts.items() if len(c) == 1 and s == NONE}
        # no piece holds a space after another character, so each word's start is a border of every path;
        # characters of no piece longer than themselves stand alone
        assert not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.alone = not any("\n" in p for p in self.ids)
        self.words = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if self.alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        # pairs of neighbours that some piece holds; between others every path has a border
        self.joins = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.plain = _Plain(self)
        self.after_space = _AfterSpace(self, self.plain)
        low = [chr(self.bytes[i]) if i in self.bytes and self.bytes[i] < 128 else p for i, p in enumerate(self.pieces)]
        self.shown = [p.replace(SPACE, " ") for p in low]
        self.high = np.asarray([self.bytes.get(i, 0) >= 128 for i in range(n)])

    def arcs_to(self, text: str, end: int, least: int = 0):
        """(start, score) of the pieces that end at end, longest first; a single character is always one."""
        score = self.score
        for n in range(min(self.longest, end - least), 0, -1):
            s = score.get(text[end - n : end])
            if s is not None:
                yield end - n, s
            elif n == 1:
                yield end - 1, self.unknown

    def best(self, text: str) -> tuple[float, list[int]]:
        """Score and piece ends of the best path through a whole text."""
        n = len(text)
        total, back = [0.0] + [NONE] * n, [0] * (n + 1)
        known, unknown = self.starts.get, self.unknown
        for start in range(n):
            here = total[start]
            s = known(text[start])
            if s is None:  # no piece begins so, the character itself included
                s = unknown
            end = start + 1
            if s + here > total[end]:
                total[end], back[end] = s + here, start
            while end < n:
                end += 1
                s = known(text[start:end])
                if s is None:
                    break
                s += here
                if s > total[end]:
                    total[end], back[end] = s, start
        ends, at = [], n
        while at:
            ends.append(at)
            at = back[at]
        return total[n], ends[::-1]

    def ids_of(self, text: str, ends: list[int]) -> list[int]:
        out, at = [], 0
        for end in ends:
            i = self.ids.get(text[at:end])
            out += [i] if i is not None else [self.byte_ids[b] for b in text[at:end].encode("utf-8", "surrogatepass")]
            at = end
        return out

    def search(self, text: str) -> bytes:
        ids = self.ids_of(text, self.best(text)[1])
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text between two borders of states 0, spaces written as SPACE."""
        if len(self.after_space) > MEMO_WORDS:
            self.after_space.clear()
        if len(self.plain) > MEMO_WORDS:
            self.plain.clear()
        if text[:1] == SPACE and SPACE * 2 not in text:
            return b"".join(map(self.after_space.__getitem__, text[1:].split(SPACE)))
        out = []
        for w in self.words.findall(text):
            single = w[0] == SPACE and w[1:2] != SPACE
            out.append(self.after_space[w[1:]] if single else self.plain[w])
        return b"".join(out)

    def states_through(self, text: str, size: int, entries: int, exits: int) -> np.ndarray:
        """entries x exits matrix of best scores from position i to position size + j; pieces may reach beyond size by
        the text's own lookahead, but each starts before size unless the path has no way to go."""
        at = np.full((len(text) + 1, entries), NONE)
        for i in range(min(entries, len(text) + 1)):
            at[i, i] = 0.0
        for end in range(1, len(text) + 1):
            for start, s in self.arcs_to(text, end):
                if start < size:
                    np.maximum(at[end], at[start] + s, out=at[end])
        out = np.full((entries, exits), NONE)
        for j in range(min(exits, len(text) - size + 1)):
            out[:, j] = at[size + j]
        return out

    def matrix(self, text: str, size: int, first: bool, last: bool) -> np.ndarray:
        """Transfer matrix of a chunk, up to a constant: text is the chunk and its lookahead, size its own length."""
        k = self.longest
        entries, exits = 1 if first else k, 1 if last else k
        cuts = [m.start() for m in self.words.finditer(text) if k <= m.start() <= size - k]
        if len(cuts) < 2:
            m = self.states_through(text, size, entries, exits)
        else:  # every path passes the first and the last cut
            a, z = cuts[0], cuts[-1]
            into = self.states_through(text[:a], a, entries, 1)
            out = self.states_through(text[z:], size - z, 1, exits)
            m = into + out  # what all paths share between the two would be added to every entry alike
        full = np.full((k, k), NONE)
        full[:entries, :exits] = m
        return full

    def trace(self, text: str, size: int, entry: int, leave: int) -> bytes:
        """Ids from position entry to position size + leave; the last piece starts before size."""
        end = size + leave
        if not leave:
            return self.encode(text[entry:end])
        cuts = [m.start() for m in self.words.finditer(text[:size]) if m.start() >= entry]
        z = max((c for c in cuts if c <= size - self.longest), default=entry)
        body, tail, own = text[entry:z], text[z:end], size - z
        n = len(tail)
        total, back = [0.0] + [NONE] * n, [0] * (n + 1)
        for stop in range(1, n + 1):
            for start, s in self.arcs_to(tail, stop):
                if start < own and total[start] + s > total[stop]:
                    total[stop], back[stop] = total[start] + s, start
        ends, at = [], n
        while at:
            ends.append(at)
            at = back[at]
        return self.encode(body) + np.asarray(self.ids_of(tail, ends[::-1]), "<i4").tobytes()

    def decode(self, ids: bytes, first: bool = True) -> str:
        """The text of ids; of a text's first chunk, without the space put before it."""
        at = np.frombuffer(ids, "<i4")
        if not len(at):
            return ""
        if self.high[at].any():  # bytes of longer characters, to be put together first
            out, raw = [], bytearray()
            for i in at.tolist():
                b = self.bytes.get(i)
                if b is not None:
                    raw.append(b)
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "surrogatepass"))
                    raw.clear()
                out.append(self.shown[i])
            out.append(raw.decode("utf-8", "surrogatepass"))
            text = "".join(out)
        else:
            text = "".join(map(self.shown.__getitem__, at.tolist()))
        return text[1:] if first and text[:1] == " " else text


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(1)


def _load(raws) -> list[np.ndarray]:
    return [np.frombuffer(r, "f8").reshape(-1, round((len(r) / 8) ** 0.5)) for r in raws]


def walk(mats: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States at the borders of a row of chunks, on a best path from entry to leave."""
    forward = [np.where(np.arange(len(mats[0])) == entry, 0.0, NONE)]
    for m in mats:
        forward.append((forward[-1][:, None] + m).max(0))
    states = [leave]
    for f, m in zip(forward[-2::-1], mats[::-1]):
        states.append(int((f + m[:, states[-1]]).argmax()))
    return states[::-1]


def _multiply(pdf: pd.DataFrame) -> pd.DataFrame:
    mats = _load(pdf.sort_values("chunk")["m"])
    total = mats[0]
    for m in mats[1:]:
        total = times(total, m)
    return pd.DataFrame({"row": [pdf["row"].iat[0]], "grp": [pdf["grp"].iat[0]], "m": [total.tobytes()]})


def _along(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("grp")
    states = walk(_load(pdf["m"]), 0, 0)
    return pd.DataFrame({"row": pdf["row"], "grp": pdf["grp"], "entry": states[:-1], "leave": states[1:]})


def _inside(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    states = walk(_load(pdf["m"]), int(pdf["entry"].iat[0]), int(pdf["leave"].iat[0]))
    return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "enter": states[:-1], "leave_at": states[1:]})


ENCODED = "id {kind}, chunk int, n_chunks int, ids array<int>, ids_crc32 bigint, round_trip boolean"


def encode(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per chunk (one per document but for giant ones): id_col, chunk, n_chunks, ids, ids_crc32, round_trip
    (whether the ids decode to the chunk's text). A document's ids are its chunks' in order.

    Spaces become the vocabulary's space sign, one is put before the text, nothing else is normalised. A null or
    empty text gives one row without ids. Ids of documents may be null or repeat.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = bounded_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    shown_size = F.coalesce(F.length("t"), F.lit(0)) + 1
    look = per_process("pieces", model_path, lambda: PieceModel(model_path)).longest

    def shown(t: str | None) -> str:
        return SPACE + t.replace(" ", SPACE) if t else ""

    def emit(cols: list, out: list[tuple[bytes, bool]]):
        ids = [x for x, _ in out]
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("i4")
        return pa.RecordBatch.from_arrays(
            [*cols, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"))), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([ok for _, ok in out])],
            ["id", "chunk", "n_chunks", "ids", "ids_crc32", "round_trip"],
        )

    def whole(batches):
        m = per_process("pieces", model_path, lambda: PieceModel(model_path))
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                texts = part.column(1).to_pylist()
                out = [(x := m.encode(shown(t)), m.decode(x) == (t or "").replace(SPACE, " ")) for t in texts]
                yield emit([part.column(0), pa.array(np.zeros(len(texts)), pa.int32()), pa.array(np.ones(len(texts)), pa.int32())], out)

    schema = ENCODED.format(kind=kind)
    small = rows.where(shown_size <= chunk_chars).select("id", "t").mapInArrow(whole, schema)

    def cut(batches):
        for b in batches:
            for row, i, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                text = shown(t)
                n = max(1, len(text) // chunk_chars)  # the last takes the rest, so none is shorter than a piece
                at = [k * chunk_chars for k in range(n)] + [len(text)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n), pa.array([i] * n, b.schema.field(1).type), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([z - a for a, z in zip(at, at[1:])], pa.int32()), pa.array([text[a : z + look - 1] for a, z in zip(at, at[1:])])],
                    ["row", "id", "chunk", "n_chunks", "size", "t"],
                )

    giant = saved(rows.where(shown_size > chunk_chars).mapInArrow(cut, f"row bigint, id {kind}, chunk int, n_chunks int, size int, t string"), "giant-chunks")

    def matrices(batches):
        m = per_process("pieces", model_path, lambda: PieceModel(model_path))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m.matrix(x["t"], x["size"], x["chunk"] == 0, x["chunk"] == x["n_chunks"] - 1).tobytes() for x in b.to_pylist()], pa.binary())], ["row", "chunk", "m"])

    mats = giant.select("row", "chunk", "n_chunks", "size", "t").mapInArrow(matrices, "row bigint, chunk int, m binary")
    mats = saved(mats.withColumn("grp", F.expr(f"chunk div {GROUP}").cast("int")), "giant-matrices")
    # matrices are small on the wire and dear to multiply: a number of partitions keeps them from being put together
    parts = shuffle_partitions(docs.sparkSession)
    dealt = mats.repartition(parts, "row", "grp")
    groups = dealt.groupBy("row", "grp").applyInPandas(_multiply, "row bigint, grp int, m binary")
    ends = groups.groupBy("row").applyInPandas(_along, "row bigint, grp int, entry int, leave int")
    states = dealt.join(ends.hint("merge"), ["row", "grp"]).groupBy("row", "grp").applyInPandas(_inside, "row bigint, chunk int, enter int, leave_at int")

    def traced(batches):
        m = per_process("pieces", model_path, lambda: PieceModel(model_path))
        for b in batches:
            if b.num_rows:
                out = []
                for x in b.to_pylist():
                    ids = m.trace(x["t"], x["size"], x["enter"], x["leave_at"])
                    own = x["t"][x["enter"] : x["size"] + x["leave_at"]].replace(SPACE, " ")
                    out.append((ids, m.decode(ids, x["chunk"] == 0) == (own[1:] if x["chunk"] == 0 else own)))
                yield emit([b.column(0), b.column(1), b.column(2)], out)

    ready = giant.join(states.hint("merge"), ["row", "chunk"]).select("id", "chunk", "n_chunks", "size", "t", "enter", "leave_at")
    return small.union(ready.mapInArrow(traced, schema)).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", chunk_col: str = "chunk", text_col: str = "text") -> DataFrame:
    """encoded with a column text_col, in place of one of that name: the text of each row's ids, null ids giving an empty
    one. A document's text is its chunks' in order."""
    schema = F.struct(*(F.col(f"`{c}`") for c in encoded.columns)).alias("r")

    def step(batches):
        m = per_process("pieces", model_path, lambda: PieceModel(model_path))
        for b in batches:
            texts = [m.decode(np.asarray(i or [], "<i4").tobytes(), c in (0, None)) for i, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["r", "t"])

    from pyspark.sql import types as T

    out = T.StructType([T.StructField("r", encoded.schema), T.StructField("t", T.StringType())])
    done = encoded.select(schema, F.col(ids_col).alias("i"), F.col(chunk_col).alias("c")).mapInArrow(step, out)
    return done.select(*(F.col(f"r.`{c}`") for c in encoded.columns if c.lower() != text_col.lower()), F.col("t").alias(text_col))
