"""Best-fit packing of documents into training sequences.

A document is cut only where it is longer than a sequence. Full pieces are sequences of their own. The others are
placed by bounded-space online best-fit: a fixed number of open bins in a bitset keyed by free space; an item goes
to the open bin with the least sufficient space, and when one bin too many is open the fullest closes first.
Partitions pack by themselves; the bins still open at their end (at most OPEN_BINS each) are items of a further
round over FAN_IN times fewer partitions, until one is left.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SHORT, bounded_batches, per_process, saved

CAPACITY = 4096
OPEN_BINS = 256
ITEMS_PER_PARTITION = 20_000
FAN_IN = 64
MEMO_WORDS = 400_000

PIECES = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"


_BREAKS = re.compile("[\t\n\r]")
#: Letters, then signs: two words to the tokenizer, whose ids don't depend on each other.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_signs() -> dict[int, str]:
    """How byte-level vocabularies write the letters beyond ASCII, by code point: printable bytes stand for themselves,
    the others for the characters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    sign = {b: chr(b if b in printable else next(others)) for b in range(256)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(128, 256)}


class _Letters(dict):
    """Ids of a word of lower-case letters, by the tokenizer's merges alone."""

    def __init__(self, tok):
        self.merge, self.signs = tok.model.tokenize, _byte_signs()

    def __missing__(self, word: str) -> bytes:
        shown = word if word.isascii() else word.translate(self.signs)
        ids = np.asarray([t.id for t in self.merge(shown)], "<u4").tobytes()
        if len(word) <= SHORT:
            self[word] = ids
        return ids


class _Runs(dict):
    """Ids of a run without white space."""

    def __init__(self, tok):
        self.tok, self.letters = tok, _Letters(tok)
        self[""] = b""

    def __missing__(self, run: str) -> bytes:
        m = _PLAIN.fullmatch(run)
        if m is None:
            ids = np.asarray(self.tok.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            ids = self.letters[m[1].lower()]
            if m[2]:
                ids += self[m[2]]
        if len(run) <= SHORT:
            self[run] = ids
        return ids


class WordEncoder:
    """Little-endian uint32 ids of whole texts, by a tokenizer whose words never cross plain white space.

    Each run between space, tab, newline and carriage return is encoded once and remembered (short ones, MEMO_WORDS at most);
    of runs of letters with signs after them, letters (lower-case, as the tokenizer makes them) and signs apart.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.runs = _Runs(Tokenizer.from_file(path))

    def encode(self, text: str) -> bytes:
        runs = self.runs
        if len(runs) > MEMO_WORDS:
            letters = runs.letters
            runs.clear()
            runs[""] = b""
            if len(letters) > MEMO_WORDS:
                letters.clear()
        return b"".join(map(runs.__getitem__, _BREAKS.sub(" ", text).split(" ")))


def pieces_of(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32. A null text is empty: one end id."""

    def step(batches):
        enc = per_process("packing", tokenizer, lambda: WordEncoder(tokenizer))
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                rows: list[tuple] = []
                for row, t in enumerate(part.column(1).to_pylist()):
                    data = enc.encode(t or "") + end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[at : at + 4 * capacity]
                        rows.append((row, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(c[0])), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(step, PIECES.format(kind=dict(docs.dtypes)[id_col]))


def best_fit(lengths, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
    """(bin, offset) of each length in turn, the fill of every bin, and the bins still open at the end."""
    free_of: dict[int, list[int]] = {}
    bits, n_open = 0, 0
    fill: list[int] = []
    placed = []
    for size in lengths:
        fits = bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = free_of[free].pop()
            if not free_of[free]:
                bits &= ~(1 << free)
        else:
            if n_open == open_bins:  # the fullest closes
                low = (bits & -bits).bit_length() - 1
                free_of[low].pop()
                if not free_of[low]:
                    bits &= ~(1 << low)
                n_open -= 1
            b, free = len(fill), capacity
            fill.append(0)
            n_open += 1
        placed.append((b, fill[b]))
        fill[b] += size
        left = free - size
        if left:
            free_of.setdefault(left, []).append(b)
            bits |= 1 << left
        else:
            n_open -= 1
    return placed, fill, {b for bs in free_of.values() for b in bs}


def _pack_partition(round_no: int, capacity: int, open_bins: int, base: int) -> Callable:
    def step(batches):
        ids, lens = [], []
        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            lens.append(b.column(1).to_numpy(zero_copy_only=False))
        if not ids:
            return
        item, size = np.concatenate(ids), np.concatenate(lens)
        placed, fill, still = best_fit(size.tolist(), capacity, open_bins)
        bins = np.asarray([b for b, _ in placed], "i8")
        first = (base + TaskContext.get().partitionId()) << 32
        openness = np.isin(bins, np.fromiter(still, "i8", len(still)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(bins + first), pa.array(np.asarray([o for _, o in placed], "i8")), pa.array(size), pa.array(np.asarray(fill, "i8")[bins]), pa.array(openness)],
            ["item", "bin", "offset", "size", "fill", "open"],
        )

    return step


PACKED = "item bigint, bin bigint, offset bigint, size bigint, fill bigint, open boolean"


def _round(items: DataFrame, partitions: int, round_no: int, base: int, capacity: int, open_bins: int) -> DataFrame:
    dealt = items.repartition(partitions, F.xxhash64("item", F.lit(round_no))).sortWithinPartitions(F.xxhash64("item"), "item")
    return saved(dealt.mapInArrow(_pack_partition(round_no, capacity, open_bins, base), PACKED), f"packed-{round_no}")


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, items_per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """pieces with sequence_id and offset (gapless from 0 in each sequence), in place of columns of these names. pieces must
    have a column length.

    Works on any other columns; rows that are repeated are packed as often as they occur. Lengths are 1 to capacity.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")))
    numbered = saved(pieces.select(row.alias("row"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("number")), "pieces")
    part = numbered.where(F.col("length") < capacity)
    n = part.count()
    parts = max(1, -(-n // items_per_partition))
    base, round_no = 1, 0
    packed = _round(part.select(F.col("number").alias("item"), "length"), parts, 0, base, capacity, open_bins)
    place = packed.select("item", "bin", "offset")
    while parts > 1:
        base, round_no, parts = base + parts, round_no + 1, -(-parts // FAN_IN)
        opened = packed.where("open").groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("length"))
        packed = _round(opened, parts, round_no, base, capacity, open_bins)
        moved = packed.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        place = place.join(moved, "bin", "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    whole = numbered.where(F.col("length") == capacity).select("row.*", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = part.join(place, F.col("number") == F.col("item")).select("row.*", F.col("bin").alias("sequence_id"), "offset")
    return whole.union(rest)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id. Null and repeated ids are kept as they are. An empty table gives no rows.
    """
    return pack(pieces_of(docs, tokenizer, id_col, text_col, end_id, capacity), capacity)
