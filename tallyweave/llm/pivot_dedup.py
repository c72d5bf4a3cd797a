"""Embedding near-deduplication by a pivot-permutation index.

A bounded sample of vectors serves as reference points. Every vector is described by its permutation: the numbers of
its NEAREST closest reference points, nearest first. Each reference point has an inverted list of the vectors that it
is near to. Two vectors are candidates if they share SHARED or more of these points and their permutations are at most
FAR apart (Spearman's footrule, absent points counting as one place beyond the last). As SHARED points must be common,
a vector enters the lists of all of its points but the SHARED - 1 of the highest numbers.

Shared points are counted list by list, and a pair is taken up on the lowest point that both have. Candidates are
verified by cosine in double precision. Equal vectors are one node with a weight. Long lists are cut into blocks, and
pairs of blocks are dealt out to tasks; pairs themselves are never written, only counts and one link to each block's
local root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, components, saved, shuffle_partitions

MIN_PIVOTS = 64
PIVOT_BYTES = 32 << 20  # reference points: twice the root of the number of distinct vectors, and no more than this broadcast
SAMPLE = 4  # times as many vectors are drawn to choose them from
APART = 0.9  # no two of them are more alike
NEAREST = 5
SHARED = 2
FAR = 24
BLOCK = 1000


def _keyed(batches):
    """Digest and raw numbers (floats as floats, all else as doubles) of each usable vector; null for the others."""
    for b in batches:
        digests, raws = [], []
        column = b.column(b.num_columns - 1)
        size = "<f4" if column.type.value_type == pa.float32() else "<f8"
        for v in column.to_pylist():
            x = np.asarray(v, size) if v is not None and len(v) and None not in v else None
            if x is None or not np.isfinite(x).all() or not x.any():
                digests.append(None)
                raws.append(None)
                continue
            raws.append((x + 0.0).tobytes())  # no negative zeros
            digests.append(hashlib.blake2b(raws[-1], digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], [*b.schema.names[:-1], "digest", "raw"])


def unit(raws: list[bytes], number: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), number).reshape(len(raws), -1).astype("f8")
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x, in order, that are not close to one kept before; most at most. A crowd of near copies in the sample
    would else be described by its own members, whose order is chance."""
    kept, n = np.zeros((min(most, len(x)), x.shape[1])), 0
    for row in x:
        if n == most:
            break
        if not n or (kept[:n] @ row).max() < APART:
            kept[n] = row
            n += 1
    return kept[:n]


def permutations(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """Numbers of the m nearest reference points of each row, nearest first; ties by number."""
    out = []
    for k in range(0, len(x), 500):
        far = -(x[k : k + 500] @ pivots.T)
        if far.shape[1] > 4 * m:  # the m-th least by selection, then only what is as near as that is sorted
            bound = np.partition(far, m - 1, axis=1)[:, m - 1 : m]
            far = np.where(far <= bound, far, np.inf)
        out.append(np.argsort(far, axis=1, kind="stable")[:, :m])
    return np.concatenate(out) if out else np.zeros((0, m), int)


def lists_of(perm: np.ndarray) -> np.ndarray:
    """The points in whose lists each row goes: all but the SHARED - 1 of the highest numbers."""
    return np.sort(perm, axis=1)[:, : max(1, perm.shape[1] - SHARED + 1)]


def _lists(nodes: DataFrame, pivots: dict[int, np.ndarray], number: str) -> DataFrame:
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)  # PIVOT_BYTES for each dimension at most
    width = np.dtype(number).itemsize

    def step(batches):
        for b in batches:
            raws = b.column(3).to_pylist()
            for size in sorted({len(r) for r in raws}):
                at = np.flatnonzero([len(r) == size for r in raws])
                part = b.take(pa.array(at))
                own = shared.value.get(size // width)
                if own is None or len(own) < SHARED:  # no reference points of this dimension: one list
                    perm = np.zeros((len(at), 1), "i4")
                else:
                    perm = permutations(unit(part.column(3).to_pylist(), number), own, min(NEAREST, len(own)))
                keys = lists_of(perm)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(at), size // width), pa.int32()), pa.array(keys.tolist(), pa.list_(pa.int32())), pa.array([p.tobytes() for p in perm.astype("<i4")], pa.binary())],
                    ["node", "label", "weight", "raw", "dim", "keys", "perm"],
                )

    kind = dict(nodes.dtypes)["label"]
    return nodes.select("node", "label", "weight", "raw").mapInArrow(step, f"node bigint, label {kind}, weight bigint, raw binary, dim int, keys array<int>, perm binary")


def shared_points(pa_: np.ndarray, pb: np.ndarray, key: int) -> np.ndarray:
    """Whether each pair of permutations shares enough points, of which key is the lowest, near enough in their order."""
    m = pa_.shape[1]
    if m < SHARED:
        return np.ones((len(pa_), len(pb)), bool)
    count = np.zeros((len(pa_), len(pb)), "i1")
    foot = np.full((len(pa_), len(pb)), m * (m + 1), "i2")  # of nothing shared: each point is away from one place beyond
    lower = np.zeros((len(pa_), len(pb)), bool)
    for i in range(m):
        for j in range(m):
            same = pa_[:, i, None] == pb[None, :, j]
            count += same
            foot -= same * np.int16(2 * m - i - j - abs(i - j))
            lower |= same & (pa_[:, i, None] < key)
    return (count >= SHARED) & (foot <= FAR) & ~lower


def _meet(left: dict, right: dict, key: int, same: bool, least: float):
    """Weighted numbers of links taken up on this key, and (node, local root) of those links."""
    near = shared_points(left["perm"], right["perm"], key)
    if same:
        near &= np.triu(np.ones(near.shape, bool), 1)
    a, b = np.nonzero(near)
    if not len(a):
        return
    if 4 * len(a) > near.size:  # many candidates: all products at once
        good = (left["x"] @ right["x"].T)[a, b] >= least
    else:
        good = np.concatenate([np.einsum("ij,ij->i", left["x"][a[k : k + 20_000]], right["x"][b[k : k + 20_000]]) for k in range(0, len(a), 20_000)]) >= least
    a, b = a[good], b[good]
    if not len(a):
        return
    shift = 0 if same else len(left["node"])
    nodes = left["node"] if same else np.concatenate([left["node"], right["node"]])
    weight = left["weight"] if same else np.concatenate([left["weight"], right["weight"]])
    b = b + shift
    n = np.zeros(len(nodes))
    np.add.at(n, a, weight[b])
    np.add.at(n, b, weight[a])
    root = nodes.copy()
    while True:  # least label over links
        old = root.copy()
        np.minimum.at(root, a, old[b])
        np.minimum.at(root, b, old[a])
        if (old == root).all():
            break
    hit = np.flatnonzero(n > 0)
    yield nodes[hit], root[hit], n[hit].astype("i8")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", least: float = 0.98) -> DataFrame:
    """One row per input row: id_col, n_links, component_id (smallest id reachable by links, itself included), kept.

    Vectors are compared only where labels are equal (all with label_col None) and their dimensions too. A null
    label, id or vector, an empty or zero vector, and null or non-finite components link with nothing; component_id
    is then the row's own id. Equal vectors are linked with each other. An empty table gives no rows. No pair below
    least is linked; recall is measured against brute force in the tests. Ids may be of any type that has an order and may
    repeat (each row is a vector of its own); vectors may be of any length.
    """
    spark = bounded_batches(df).sparkSession
    label = F.col(label_col) if label_col else F.lit(0)
    rows = df.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("v"))
    kinds = dict(rows.dtypes)
    number = "<f4" if kinds["v"] == "array<float>" else "<f8"
    width = np.dtype(number).itemsize
    keyed = saved(rows.mapInArrow(_keyed, f"id {kinds['id']}, label {kinds['label']}, digest binary, raw binary"), "pivot-rows")
    usable = keyed.where("digest is not null and label is not null and id is not null")
    nodes = usable.groupBy("label", "digest").agg(F.count("*").alias("weight"), F.min("id").alias("low"), F.min("raw").alias("raw"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "pivot-nodes")
    size = nodes.agg(F.count("*").alias("n"), F.max(F.octet_length("raw")).alias("widest")).first()
    most = PIVOT_BYTES // (8 * max(1, (size["widest"] or width) // width))
    n_pivots = int(max(SHARED, min(most, max(MIN_PIVOTS, 2 * size["n"] ** 0.5))))
    # a share by a hash, then the least hashes: SAMPLE * n_pivots vectors, whatever the number of rows
    draw = F.pmod(F.xxhash64("digest", "label"), F.lit(1 << 40))
    share = int(min(1.0, 2 * SAMPLE * n_pivots / max(1, size["n"])) * (1 << 40))
    drawn = [bytes(r["raw"]) for r in nodes.where(draw <= share).orderBy(draw, "node").select("raw").limit(SAMPLE * n_pivots).collect()]
    pivots = {s // width: spread(unit([r for r in drawn if len(r) == s], number), n_pivots) for s in {len(r) for r in drawn}}

    lists = _lists(nodes, pivots, number).withColumn("key", F.explode("keys")).drop("keys")
    # lists with one vector end here; the number of the others' blocks follows their length
    sizes = lists.groupBy("label", "dim", "key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    dealt = lists.join(sizes, ["label", "dim", "key"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "weight", "raw", "perm")
    parts = shuffle_partitions(spark)
    by = ["label", "dim", "key", "lo", "hi"]
    dealt = dealt.repartition(parts, *by).sortWithinPartitions(*by)

    def step(batches):
        held, at = [], None

        def flush():
            t = pa.Table.from_batches(held)
            if t.num_rows < 2:
                return
            mine = t.column("mine").to_numpy()
            perm = np.frombuffer(b"".join(t.column("perm").to_pylist()), "<i4").reshape(t.num_rows, -1)
            full = {"node": t.column("node").to_numpy(), "weight": t.column("weight").to_numpy(), "x": unit(t.column("raw").to_pylist(), number), "perm": perm}
            _, _, key, lo, hi = at
            side = lambda k: {c: v[mine == k] for c, v in full.items()}
            left, right = (full, full) if lo == hi else (side(lo), side(hi))
            for nodes_, roots, counts in _meet(left, right, key, lo == hi, least):
                yield pa.RecordBatch.from_arrays([pa.array(nodes_), pa.array(roots), pa.array(counts)], ["a", "b", "n"])

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in by)))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if keys[s] != at and held:
                    yield from flush()
                    held = []
                at = keys[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from flush()

    found = saved(dealt.mapInArrow(step, "a bigint, b bigint, n bigint"), "pivot-links")
    comp = components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    own = nodes.select("label", "digest", "node", "weight", "low").join(comp, "node", "left").join(counts, F.col("node") == F.col("a"), "left")
    own = own.withColumn("c", F.coalesce("component", "node"))
    lowest = own.groupBy("c").agg(F.min("low").alias("component_id"))
    own = own.join(lowest, "c").select("label", "digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "component_id")
    usable_id = F.when(F.col("label").isNotNull() & F.col("id").isNotNull(), F.col("digest"))
    out = keyed.select("id", "label", usable_id.alias("digest")).join(own, ["label", "digest"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
