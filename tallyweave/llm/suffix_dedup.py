"""Removal of passages that an earlier document already has, exact to the byte, by a difference cover of bounded depth.

Only the first LENGTH bytes of suffixes have to be ordered here, so one level of names is enough:

1. Sample the positions whose residue modulo PERIOD is in COVER, a difference cover: of any two positions, both have a
   sampled one at the same distance, PERIOD - 1 at most. The sampled strings of TUPLE = LENGTH - PERIOD + 1 bytes are
   sorted, batch by batch and then range by range of names, and told whether another document has them. Two equal windows
   of LENGTH bytes have a sampled string in common at one offset, so windows without a shared one drop out. Names are
   hashes of 40 bits here, which may only keep too much.
2. Merge the rest: the windows of what is left (candidate regions). Everything that the windows around a local mark span
   has one name of 128 bits; the same name in an earlier document settles all these windows at once, and a mark with one
   surrounding only needs no further look.
3. Windows still open are ordered by their own 128-bit names and compared with their neighbours.

Documents are dealt into batches by ranges of the id, so "in an earlier document" is "in a batch of a lower number,
or in this one under a smaller id". Batches send sorted distinct names to the task of each range of names and get
back one bit each: no name's occurrences are ever gathered, however common the passage. Ranges are as many as batches;
where text is plenty, the size of batches and their number, and so the splitters on the driver, grow with its root.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngram_join import _mix
from .shared import bounded_batches, saved, shuffle_partitions

LENGTH = 50
PERIOD, COVER = 13, (0, 1, 3, 9)  # every residue is the difference of two of these
TUPLE = LENGTH - PERIOD + 1
K = 24  # bytes whose least hash marks a place in candidate regions
BATCH_BYTES = 6_000_000  # of a batch, up to ROOT_FROM bytes of text
ROOT_FROM = 7e11  # beyond, batches grow with the root of the text (72 MB at 100 TB)
CHUNK_BYTES = 1_000_000
BATCH_TASKS = 20_000  # at most; beyond, a task has several batches, one after another

_ONE = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_SIGNS = _mix(np.arange(1, 257, dtype="u8") * _ONE)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def rolling(signs: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the strings of each of the sizes that begin at each position (fewer by size - 1), by doubling."""
    out: list = [None] * len(sizes)
    at = [0] * len(sizes)
    power, size = signs, 1
    while True:
        for k, want in enumerate(sizes):
            if want & size:
                if out[k] is None:
                    out[k] = power
                else:
                    m = len(power) - at[k]
                    out[k] = out[k][:m] * _power(size) + power[at[k] :][: len(out[k])]
                at[k] += size
        size *= 2
        if size > max(sizes):
            return [_mix(x) for x in out]
        half = size // 2
        power = power[:-half] * _power(half) + power[half:]


def least_in_window(key: np.ndarray, w: int) -> np.ndarray:
    """Position of the least key among the w from each position on, the leftmost of equals."""

    def merge(a, b):
        take = b[0] < a[0]
        return np.where(take, b[0], a[0]), np.where(take, b[1], a[1])

    now = (key, np.arange(len(key), dtype="i4"))
    size = 1
    while size * 2 <= w:
        now = merge(tuple(x[:-size] for x in now), tuple(x[size:] for x in now))
        size *= 2
    if size < w:
        now = merge(tuple(x[: len(x) - (w - size)] for x in now), tuple(x[w - size :] for x in now))
    return now[1]


def chunks(texts: list[bytes]):
    """(first, last, joined bytes, starts) of runs of texts, about CHUNK_BYTES each."""
    k = 0
    while k < len(texts):
        size, z = 0, k
        while z < len(texts) and (z == k or size + len(texts[z]) <= CHUNK_BYTES):
            size += len(texts[z])
            z += 1
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts[k:z]])])
        yield k, z, np.frombuffer(b"".join(texts[k:z]), "u1"), starts
        k = z


def covered(buf: np.ndarray, starts: np.ndarray):
    """Of each sampled position whose TUPLE bytes lie in one text: number of the text, position in buf, hash."""
    none = np.zeros(0, "i8")
    if len(buf) < TUPLE:
        return none, none, none.view("u8")
    (h,) = rolling(_SIGNS[buf], (TUPLE,))
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(h)]
    at = np.arange(len(h)) - starts[text]
    chosen = np.zeros(PERIOD, bool)
    chosen[list(COVER)] = True
    # the string, and the window that it is in, must end in the text
    p = np.flatnonzero(chosen[at % PERIOD] & (np.arange(len(h)) + TUPLE <= starts[text + 1]) & (np.diff(starts)[text] >= LENGTH))
    return text[p], p, h[p]


def sampled(buf: np.ndarray, starts: np.ndarray):
    """Marks: number of the text, first and last window start (in buf), name, name of the surroundings, and all windows'
    hashes."""
    none = np.zeros(0, "i8")
    if len(buf) < LENGTH:
        return none, none, none, none.view("u8"), none.view("u8"), none.view("u8")
    signs = _SIGNS[buf]
    h, w = rolling(signs, (K, LENGTH))
    at = least_in_window((h >> np.uint64(32)).astype("u4"), LENGTH - K + 1)
    valid = np.ones(len(at), bool)
    for end in starts[1:]:  # windows that run over a text's end
        valid[max(0, end - LENGTH + 1) : end] = False
    s = np.flatnonzero(valid)
    if not len(s):
        return none, none, none, none.view("u8"), none.view("u8"), w
    p = at[s]
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
    s0, s1, p = s[first], s[np.concatenate([first[1:] - 1, [len(s) - 1]])], p[first]
    text = np.searchsorted(starts, s0, "right") - 1
    c = _mix(w[s0] * _ONE + _mix(w[s1] + np.uint64(3)) + _mix(((p - s0) * 64 + (s1 - s0)).astype("u8")))
    return text, s0, s1, h[p], c, w


def _bucket(name: np.ndarray, n: int) -> np.ndarray:
    """Range of names, in order; n is below 2 ** 32."""
    return (((name >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype("i8")


def _rows(cuts: np.ndarray, columns: list[np.ndarray], batch: int, write=np.ndarray.tobytes):
    """A row (bucket, batch, blobs) for each range that has names."""
    n = len(cuts) - 1
    at = [k for k in range(n) if cuts[k] < cuts[k + 1]]
    return pa.table({"bucket": pa.array(at, pa.int32()), "batch": pa.array([batch] * len(at), pa.int32()), **{f"x{j}": pa.array([write(x[cuts[k] : cuts[k + 1]]) for k in at], pa.binary()) for j, x in enumerate(columns)}})


def _cuts(names: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(_bucket(names, n), np.arange(n + 1))


def _decode_ids(table: pa.Table):
    return table.column("id").to_pylist(), table.column("th").to_pylist()


_LOW = np.uint64((1 << 24) - 1)
_STEP = 1 << 24


def _bytes(x: np.ndarray, n: int) -> bytes:
    """The low n bytes of each number, the highest first."""
    return np.ascontiguousarray(x.astype(">u8").view("u1").reshape(-1, 8)[:, 8 - n :]).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    x = np.zeros((len(raw) // n, 8), "u1")
    x[:, 8 - n :] = np.frombuffer(raw, "u1").reshape(-1, n)
    return x.view(">u8").ravel().astype("u8")


def _pack(names: np.ndarray) -> bytes:
    """Sorted distinct names of 40 bits: the first in full, then steps of three bytes, if all are that small."""
    x = names >> np.uint64(24)
    step = np.diff(x)
    if len(step) and step.max() >= _STEP:
        return b"\x01" + _bytes(x, 5)
    return b"\x00" + _bytes(x[:1], 5) + _bytes(step, 3)


def _unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\x01":
        x = _numbers(raw[1:], 5)
    else:
        x = np.cumsum(np.concatenate([_numbers(raw[1:6], 5), _numbers(raw[6:], 3)]), dtype="u8")
    return x << np.uint64(24)


def _names(samples: list[tuple], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct sampled names (40 bits, the low 24 zero) of a batch, and whether two ids of it have each.
    samples: what covered gives for each chunk, after the chunk's first text."""
    keys = [(h & ~_LOW) | rank[k + text].astype("u8") for k, (text, _, h) in samples]  # a batch has fewer texts than 2 ** 24
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, "u8")
    h, owner = keys & ~_LOW, keys & _LOW
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, "i8")
    last = np.concatenate([first[1:] - 1, [len(h) - 1]]) if len(first) else first
    return h[first], owner[first] != owner[last]


def _ranked(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """The batch in order of id, its texts, and the rank of each id (equal for equal ids)."""
    table = table.sort_by([("id", "ascending"), ("th", "ascending")])
    ids = table.column("id").to_numpy()
    rank = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, "i8")
    return table, table.column("t").to_pylist(), rank


def _bits(table: pa.Table, column: str) -> np.ndarray:
    """The bits sent back for a batch's names, in order of the ranges."""
    table = table.sort_by("bucket")
    out = [np.unpackbits(np.frombuffer(b, "u1"), count=n) for b, n in zip(table.column(column).to_pylist(), table.column("n").to_pylist())]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def _answers(sizes: list[int], batches: list[int], flags: dict[str, np.ndarray], bucket: int) -> pa.Table:
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return pa.table(
        {"bucket": pa.array([bucket] * len(sizes), pa.int32()), "batch": pa.array(batches, pa.int32()), "n": pa.array(sizes, pa.int32())}
        | {k: pa.array([np.packbits(v[a:z]).tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary()) for k, v in flags.items()}
    )


def _shared_names(table: pa.Table) -> pa.Table:
    """Of each batch's names in a range: whether another batch has it."""
    parts = [_unpack(b) for b in table.column("x0").to_pylist()]
    every = np.sort(np.concatenate(parts))
    shared = every[1:][every[1:] == every[:-1]]
    hit = [_among(shared, p) for p in parts]
    return _answers([len(p) for p in parts], table.column("batch").to_pylist(), {"b0": np.concatenate(hit)}, table.column("bucket")[0].as_py())


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in known, which is sorted."""
    if not len(known) or not len(x):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _earlier(table: pa.Table, several: bool) -> pa.Table:
    """Of each batch's pairs of names in a range: b0, whether a batch of a lower number has the pair; with several, b1,
    whether the first name occurs with several second ones."""
    batches = table.column("batch").to_pylist()
    a, b = ([np.frombuffer(x, "u8") for x in table.column(c).to_pylist()] for c in ("x0", "x1"))
    sizes = [len(x) for x in a]
    a, b, n = np.concatenate(a), np.concatenate(b), np.repeat(np.asarray(batches), sizes)
    by = np.lexsort((n, b, a))
    sa, sb = a[by], b[by]
    repeat = np.concatenate([[False], (sa[1:] == sa[:-1]) & (sb[1:] == sb[:-1])])
    flags = {"b0": np.zeros(len(a), bool)}
    flags["b0"][by] = repeat
    if several:
        new = np.concatenate([[True], sa[1:] != sa[:-1]])
        group = np.cumsum(new) - 1
        many = np.bincount(group, ~repeat) > 1
        flags["b1"] = np.zeros(len(a), bool)
        flags["b1"][by] = many[group]
    return _answers(sizes, batches, flags, table.column("bucket")[0].as_py())


def _regions(table: pa.Table, answers: pa.Table, n: int) -> pa.Table:
    """Bytes of the batch that may be repeated: batch, id, th, start, t."""
    table, texts, rank = _ranked(table)
    parts = list(chunks(texts))
    samples = [(k, covered(buf, starts)) for k, _, buf, starts in parts]
    names, local = _names(samples, rank)
    shared = names[_bits(answers, "b0") | local] if len(names) else names
    ids, ths = _decode_ids(table)
    out: list[tuple] = []
    for (_, _, buf, starts), (k, (text, p, h)) in zip(parts, samples):
        hit = _among(shared, h & ~_LOW)
        text, p = text[hit], p[hit]
        if not len(text):
            continue
        # the windows that have the shared string within PERIOD bytes of their start
        s0 = np.maximum(starts[text], p - PERIOD + 1)
        e = np.minimum(p + LENGTH, starts[text + 1])
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (s0[1:] > e[:-1])]))
        ends = e[np.concatenate([new[1:] - 1, [len(e) - 1]])]
        raw = buf.tobytes()
        for x, a, z in zip(text[new].tolist(), s0[new].tolist(), ends.tolist()):
            out.append((ids[k + x], ths[k + x], a - int(starts[x]), raw[a:z]))
    batch = table.column("batch")[0].as_py()
    c = list(zip(*out)) or [()] * 4
    return pa.table({"batch": pa.array([batch] * len(out), pa.int32()), "id": pa.array(c[0], pa.int64()), "th": pa.array(c[1], pa.int64()), "start": pa.array(c[2], pa.int64()), "t": pa.array(c[3], pa.binary())})


class _Region:
    """Sampled positions of a batch's regions, with the surroundings' names."""

    def __init__(self, table: pa.Table):
        self.table, self.texts, self.rank = _ranked(table)
        parts = []
        for k, _, buf, starts in chunks(self.texts):
            text, s0, s1, h, c, w = sampled(buf, starts)
            size = s1 - s0 + 1
            at = np.repeat(s0 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            parts.append((k + text, s0 - starts[text], size, h, c, w[at]))
        self.text, self.s0, self.size, self.h, self.c, self.w = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((self.rank[self.text], self.c, self.h))
        h, c, r = self.h[order], self.c[order], self.rank[self.text][order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.names, self.surroundings = h[first], c[first]  # distinct pairs, sorted
        self.pair = np.empty(len(h), "i8")
        self.pair[order] = group
        self.later = np.zeros(len(h), bool)  # a smaller id of this batch has the pair
        self.later[order] = r > r[first][group] if len(h) else False
        self.lead = np.zeros(len(h), bool)  # first of its pair here
        self.lead[order] = new

    def open_windows(self, answers: pa.Table):
        """Settled positions; and of the windows still open: their place, name of the sample, hash."""
        earlier, several = _bits(answers, "b0"), _bits(answers, "b1")
        settled = self.later | earlier[self.pair] if len(self.pair) else self.later
        self.settled = settled
        # one place for each pair stands for its other ones under the same id
        self.open = ~settled & several[self.pair] if len(self.pair) else self.lead
        where = np.repeat(np.flatnonzero(self.open), self.size[self.open])
        begin = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype("i8")
        size = self.size[self.open]
        offset = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]).astype("i8"), size)
        return where, offset, self.h[where], self.w[begin[where] + offset]


def _distinct_windows(h: np.ndarray, w: np.ndarray, rank: np.ndarray):
    """Sorted distinct (h, w), the number of each window's pair, and whether a smaller rank has it."""
    order = np.lexsort((rank, w, h))
    a, b, r = h[order], w[order], rank[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    pair, later = np.empty(len(a), "i8"), np.zeros(len(a), bool)
    pair[order] = group
    if len(a):
        later[order] = r > r[first][group]
    return a[first], b[first], pair, later


def _spans(region: _Region, answers: pa.Table, windows: pa.Table) -> pa.Table:
    """Removed bytes: id, th, start, end (may overlap)."""
    where, offset, h, w = region.open_windows(answers)
    _, _, pair, later = _distinct_windows(h, w, region.rank[region.text[where]])
    earlier = _bits(windows, "b0")
    gone = later | earlier[pair] if len(pair) else later
    s, x = region.settled, region.text
    text = np.concatenate([x[s], x[where[gone]]])
    begin = np.concatenate([region.s0[s], region.s0[where[gone]] + offset[gone]])
    end = np.concatenate([region.s0[s] + region.size[s] - 1 + LENGTH, region.s0[where[gone]] + offset[gone] + LENGTH])
    order = np.lexsort((begin, text))
    text, begin, end = text[order], begin[order], end[order]
    if len(text):
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (begin[1:] > np.maximum.accumulate(end + text * (1 << 40))[:-1] - text[1:] * (1 << 40))]))
        end = np.maximum.reduceat(end, new)
        text, begin = text[new], begin[new]
    take = region.table.take(pa.array(text, pa.int64()))
    start = take.column("start").to_numpy()
    return pa.table({"id": take.column("id"), "th": take.column("th"), "start": pa.array(begin + start, pa.int64()), "end": pa.array(end + start, pa.int64())})


def batches_for(total: int) -> int:
    """Number of batches for so many bytes of text."""
    return max(1, math.ceil(total / (BATCH_BYTES * max(1.0, math.sqrt(total / ROOT_FROM)))))


def removed_spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col's value as id, th (64-bit hash of the text) and array spans (start, end, in bytes; disjoint, in order) of what goes."""
    docs = bounded_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(F.col(text_col)).alias("th")).where("id is not null and octet_length(t) >= %d" % LENGTH)
    numbers = None
    if dict(docs.dtypes)["id"] not in ("tinyint", "smallint", "int", "bigint"):  # numbered in the order of the ids
        ids = docs.select("id").distinct().repartitionByRange(shuffle_partitions(df.sparkSession), "id").sortWithinPartitions("id")
        numbers = saved(ids.select("id", F.monotonically_increasing_id().alias("number")), "suffix-ids")
        docs = docs.join(numbers, "id").withColumn("id", F.col("number")).drop("number")
    docs = docs.withColumn("id", F.col("id").cast("long"))
    total = docs.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = batches_for(total)
    splitters = docs.approxQuantile("id", [k / n for k in range(1, n)], max(0.1 / n, 1e-6)) if n > 1 else []  # a sketch of bounded size
    bounds = np.asarray(sorted({int(s) for s in splitters}), "i8")

    @F.pandas_udf(T.IntegerType())
    def batch_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype("i4"))

    docs = docs.withColumn("batch", batch_of("id") if len(bounds) else F.lit(0))
    dealt = docs.repartition(min(n, BATCH_TASKS), "batch")

    def send_names(table: pa.Table) -> pa.Table:
        table_, texts, rank = _ranked(table)
        names, _ = _names([(k, covered(buf, starts)) for k, _, buf, starts in chunks(texts)], rank)
        return _rows(_cuts(names, n), [names], table_.column("batch")[0].as_py(), _pack)

    sent = dealt.groupBy("batch").applyInArrow(send_names, "bucket int, batch int, x0 binary")
    answers = sent.groupBy("bucket").applyInArrow(_shared_names, "bucket int, batch int, n int, b0 binary")
    regions = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda t, a: _regions(t, a, n) if t.num_rows else _no_regions(), "batch int, id bigint, th bigint, start bigint, t binary")
    regions = saved(regions, "suffix-regions")

    def send_pairs(table: pa.Table) -> pa.Table:
        r = _Region(table)
        return _rows(_cuts(r.names, n), [r.names, r.surroundings], table.column("batch")[0].as_py())

    by_batch = regions.repartition(min(n, BATCH_TASKS), "batch")
    pairs = by_batch.groupBy("batch").applyInArrow(send_pairs, "bucket int, batch int, x0 binary, x1 binary")
    told = saved(pairs.groupBy("bucket").applyInArrow(lambda t: _earlier(t, True), "bucket int, batch int, n int, b0 binary, b1 binary"), "suffix-pairs")

    def send_windows(table: pa.Table, told_: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(np.zeros(1, "i8"), [np.zeros(0, "u8")] * 2, 0)
        r = _Region(table)
        where, _, h, w = r.open_windows(told_)
        a, b, _, _ = _distinct_windows(h, w, r.rank[r.text[where]])
        return _rows(_cuts(a, n), [a, b], table.column("batch")[0].as_py())

    windows = by_batch.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(send_windows, "bucket int, batch int, x0 binary, x1 binary")
    seen = windows.groupBy("bucket").applyInArrow(lambda t: _earlier(t, False), "bucket int, batch int, n int, b0 binary")
    both = saved(told.select("batch", "bucket", "n", "b0", "b1", F.lit(0).alias("kind")).unionByName(seen.withColumns({"b1": F.lit(None).cast("binary"), "kind": F.lit(1)})), "suffix-answers")

    def finish(table: pa.Table, told_: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _no_spans()
        kind = told_.column("kind").to_numpy()
        return _spans(_Region(table), told_.filter(pa.array(kind == 0)), told_.filter(pa.array(kind == 1)))

    spans = by_batch.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(finish, "id bigint, th bigint, start bigint, end bigint")
    spans = spans.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return spans if numbers is None else spans.join(numbers.withColumnRenamed("id", "own"), F.col("id") == F.col("number")).select(F.col("own").alias("id"), "th", "spans")


def _no_regions() -> pa.Table:
    return pa.table({"batch": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "th": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "t": pa.array([], pa.binary())})


def _no_spans() -> pa.Table:
    return pa.table({k: pa.array([], pa.int64()) for k in ("id", "th", "start", "end")})


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept (binary: what is left).

    A null text is empty. A null id is neither earlier nor later than another: nothing goes there, and nothing goes
    elsewhere because of it. Rows that repeat an id don't take from each other. Texts under LENGTH bytes stay whole; texts
    may be of any length, ids of any type that has an order. Extra columns are left out.
    """
    spans = removed_spans(df, text_col, id_col)
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t"), F.xxhash64(F.col(text_col)).alias("k"))
    joined = docs.join(spans, (F.col("d") == F.col("id")) & (F.col("k") == F.col("th")), "left").select("d", "t", "spans")

    def step(batches):
        for b in batches:
            n, gone, count, kept = [], [], [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                cut = merge_spans([(x["start"], x["end"]) for x in s or []])
                n.append(len(t))
                gone.append(sum(z - a for a, z in cut))
                count.append(len(cut))
                ends = [0, *(z for _, z in cut)]
                kept.append(b"".join(t[a:z] for a, z in zip(ends, [*(a for a, _ in cut), len(t)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["d", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(step, f"d {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("d", id_col)
