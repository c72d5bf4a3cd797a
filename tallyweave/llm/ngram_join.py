"""N-gram Jaccard join, size-aware, with heavy and light sets; linked documents come out as components.

A document is the set of its distinct word n-grams (64-bit hashes). Documents with one and the same set are one
class. Of the classes,

* light ones (few n-grams) enumerate their subsets of each size that a partner must share; two sets with a common
  k-subset share k elements, so the link is sure. Inside a key it is enough to tie each set to the smallest one:
  whatever can link there, links with that.
* heavy ones enter the inverted lists of their rarest elements (as many as a partner can't all miss). A heavy set
  meets every set on its lists, light or heavy. Each list is first scanned against one centre set, then, between
  sets that still lie in different components, blockwise against all others.

The boundary is where enumerating costs more than scanning, by the sizes and the list lengths measured on the input.
Elements common in the input come last in the order of rarity; these are found exactly where they are many in one
task. The order never changes the result. A pair goes to exact comparison of the full sets only if the histograms
of both sets' hashes (an upper bound of their overlap) allow the link. There is no cap on lists or candidates.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, components, free_name, per_process, saved, shuffle_partitions

LONG_WORD, BLOCK_BYTES = 4096, 1 << 18
HOT_ELEMENTS = 200_000  # the most common elements that are put last; the broadcast is bounded by this
HOT_IN_TASK = 6
LIGHT_MOST = 40  # sizes over this are never light
LIST_SAMPLE = 64  # list lengths are measured on one in so many elements
VERIFY_COST = 4.0  # of looking at one list entry, against writing one
STAR_ROUNDS = 2
BLOCK = 2000
SETS_BYTES = 4 << 20  # of sets in one batch
ROLES = 500  # or so, in one row
HEAD = 16  # a set's rarest elements that go with it into blocks
BINS = 256  # of a histogram of hashes, a byte each; FULL stands for FULL or more
FULL = 255


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.cumprod(out)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_BASE = 0xD6E8FEB86659FD93


class Shingler:
    """Sorted distinct 64-bit hashes of the n-grams of texts. Words are lower-cased in A-Z and end at ASCII white space.

    A word's hash is a polynomial of its bytes, taken for all words of a block at once from one running sum, and mixed;
    words over LONG_WORD bytes, which would need blocks of their own size, are hashed one by one.
    """

    def __init__(self, n: int):
        self.n = n
        self.mult = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3) + 2 * k) & 0xFFFFFFFFFFFFFFFF | 1) for k in range(n)]
        self.power = _powers(_BASE, BLOCK_BYTES + LONG_WORD)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), BLOCK_BYTES + LONG_WORD)
        self.signs = _mix(np.arange(1, 257, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))[_LOWER]

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hash) of each word."""
        import xxhash

        buf = np.frombuffer(raw, "u1")
        gap = np.concatenate([[True], _SPACE[buf], [True]])
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        out = np.empty(len(starts), "u8")
        k = 0
        while k < len(starts):
            if ends[k] - starts[k] > LONG_WORD:
                out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].lower())
                k += 1
                continue
            at = starts[k]
            z = max(k + 1, int(np.searchsorted(ends, at + BLOCK_BYTES, "right")))
            size = ends[k:z] - starts[k:z]
            if size.max() > LONG_WORD:
                z = k + int((size > LONG_WORD).argmax())
            here = self.signs[buf[at : ends[z - 1]]]
            run = np.concatenate([[np.uint64(0)], np.cumsum(here * self.power[: len(here)])])
            a, b = starts[k:z] - at, ends[k:z] - at
            out[k:z] = _mix((run[b] - run[a]) * self.inverse[a] + (b - a).astype("u8"))
            k = z
        return starts, out

    def grams(self, w: np.ndarray, n: int) -> np.ndarray:
        m = len(w) - n + 1
        x = np.full(m, n * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF, "u8")
        for k in range(n):
            x += w[k : k + m] * self.mult[k]
            x ^= x >> np.uint64(31)
        return _mix(x)

    def many(self, texts: list[str | None]):
        """The sets of texts in turn."""
        k = 0
        while k < len(texts):
            raws, size = [], 0
            while k < len(texts) and (not raws or size < BLOCK_BYTES):
                raws.append((texts[k] or "").encode("utf-8", "surrogatepass"))
                size += len(raws[-1]) + 1
                k += 1
            starts, w = self.words(b" ".join(raws))
            edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]))
            x = self.grams(w, self.n) if len(w) >= self.n else w[:0]
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if z - a >= self.n:
                    s = np.sort(x[a : z - self.n + 1])
                    yield s[np.concatenate([[True], s[1:] != s[:-1]])]
                else:
                    yield self.grams(w[a:z], z - a) if z > a else w[:0]

    def of(self, text: str | None) -> np.ndarray:
        return next(self.many([text]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_partner(size: int, num: int, den: int) -> int:
    """The smallest size that a set of this size can link with; also the least overlap with any partner."""
    return -(-num * size // den)


def subset_keys(x: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sizes) of the subsets that may be all that a partner shares: x with up to size - least_partner left out."""
    g = _mix(x + np.uint64(0x51ED270B))
    total, n = g.sum(dtype="u8"), len(x)
    keys, sizes = [], []
    for d in range(n - least_partner(n, num, den) + 1):
        at = np.fromiter(itertools.chain.from_iterable(itertools.combinations(range(n), d)), int, comb(n, d) * d).reshape(comb(n, d), d)
        keys.append(_mix(total - g[at].sum(1, dtype="u8") + np.uint64((n - d) * 0x632BE59B)))
        sizes.append(np.full(len(keys[-1]), n - d))
    return np.concatenate(keys), np.concatenate(sizes)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view("i8")


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: sizes and documents; 1: elements many in a task; 2: one in LIST_SAMPLE elements; with counts."""

    def step(batches):
        shingler = per_process("shingler", n, lambda: Shingler(n))
        sizes: dict[int, int] = {}
        sets = []
        seen = 0

        def counts():
            keys, c = np.unique(np.concatenate(sets), return_counts=True)
            many, drawn = c >= HOT_IN_TASK, keys % np.uint64(LIST_SAMPLE) == 0
            for kind, pick in ((1, many), (2, drawn)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(pick.sum(), kind), pa.int32()), pa.array(_signed(keys[pick])), pa.array(c[pick])], ["kind", "key", "n"])

        for b in batches:
            for x in shingler.many(b.column(0).to_pylist()):
                sizes[len(x)] = sizes.get(len(x), 0) + 1
                sets.append(x)
                seen += len(x)
                if seen > 4_000_000:
                    yield from counts()
                    sets, seen = [], 0
        if sets:
            yield from counts()
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes)), pa.int32()), pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], ["kind", "key", "n"])

    return docs.select("t").mapInArrow(step, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def boundary(sizes: dict[int, int], mean_list: float, num: int, den: int) -> int:
    """The largest light size at least total cost."""
    best, best_cost = 0, None
    light = lambda p: sum(comb(p, d) for d in range(p - least_partner(p, num, den) + 1))
    heavy = lambda p: (p - least_partner(p, num, den) + 1) * (1 + VERIFY_COST * max(0.0, mean_list - 1))
    for x in range(LIGHT_MOST + 1):
        near = least_partner(x + 1, num, den)
        cost = sum(c * ((light(p) + (heavy(p) if p >= near else 0)) if p <= x else heavy(p)) for p, c in sizes.items() if p)
        if best_cost is None or cost < best_cost:
            best, best_cost = x, cost
    return best


PROFILE = "id {kind}, n int, fp bigint, hist binary, prefix array<bigint>, keys array<bigint>, key_sizes array<int>"


def _profiles(docs: DataFrame, n: int, num: int, den: int, light: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # HOT_ELEMENTS at most
    near = least_partner(light + 1, num, den)

    def step(batches):
        import xxhash

        hot_keys, hot_counts = shared.value
        shingler = per_process("shingler", n, lambda: Shingler(n))
        none, none_sizes = np.zeros(0, "i8"), np.zeros(0, "i4")
        maybe_hot = np.zeros(1 << 22, bool)  # keeps most elements from the search among the hot ones
        maybe_hot[hot_keys & np.uint64((1 << 22) - 1)] = True
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                sizes, fps, hists, prefixes, keys, key_sizes = [], [], [], [], [], []
                for x in shingler.many(part.column(1).to_pylist()):
                    p = len(x)
                    sizes.append(p)
                    fps.append(xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63))
                    hists.append(np.minimum(np.bincount((x >> np.uint64(40)).astype("i8") & (BINS - 1), minlength=BINS), FULL).astype("u1").tobytes())
                    if p >= near and p:
                        common = maybe_hot[x & np.uint64((1 << 22) - 1)]
                        if common.any():
                            at = np.minimum(np.searchsorted(hot_keys, x[common]), len(hot_keys) - 1)
                            real = hot_keys[at] == x[common]
                            common[common] = real
                            at = at[real]
                        late = x[common][np.argsort(hot_counts[at], kind="stable")] if common.any() else x[:0]
                        prefixes.append(_signed(np.concatenate([x[~common], late])[: p - least_partner(p, num, den) + 1]))
                    else:
                        prefixes.append(none)
                    k, c = subset_keys(x, num, den) if 0 < p <= light else (none, none_sizes)
                    keys.append(k.view("i8"))
                    key_sizes.append(c)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(hists, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(key_sizes, pa.list_(pa.int32()))],
                    ["id", "n", "fp", "hist", "prefix", "keys", "key_sizes"],
                )

    return docs.select("id", "t").mapInArrow(step, PROFILE.format(kind=dict(docs.dtypes)["id"]))


def _may_link(ha: np.ndarray, hb: np.ndarray, na, nb, num: int, den: int) -> np.ndarray:
    """Whether the histograms allow the link; bins that are FULL in both count as unbounded."""
    over = np.minimum(ha, hb).sum(-1, dtype="i8") + np.where(((ha == FULL) & (hb == FULL)).any(-1), 1 << 40, 0)
    return over * (den + num) >= num * (na + nb)


def _star(lists: DataFrame, comp: DataFrame | None, round_no: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of each list's centre with its other members in other components."""
    here = lists
    if comp is not None:
        here = here.join(comp, F.col("fp") == F.col("node"), "left").withColumn("c", F.coalesce("component", "fp")).drop("node", "component")
    else:
        here = here.withColumn("c", F.col("fp"))
    r = F.xxhash64("fp", F.lit(round_no))
    # one small row for each list, combined before the shuffle, then joined back: a long list is no single group
    centre = here.groupBy("token").agg(*(F.min_by(c, r).alias(f"m_{c}") for c in ("fp", "n", "c", "heavy")), F.min("c").alias("low"), F.max("c").alias("high"))
    pairs = here.join(centre.where("low <> high").drop("low", "high"), "token").where("m_c <> c and (heavy or m_heavy)")
    pairs = pairs.where(F.least("n", "m_n") * den >= F.greatest("n", "m_n") * num)
    return pairs.select(F.col("m_fp").alias("a"), F.col("fp").alias("b")).distinct()


def _blocks(lists: DataFrame, comp: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) in one list, of different components, that the histograms allow. Long lists are cut into blocks,
    and pairs of blocks are dealt out to tasks.

    The list of the first element that two sets share decides on them: what both have from there on must be enough, and
    lists of later elements leave the pair out where their heads tell of an earlier one."""
    here = lists.join(comp, F.col("fp") == F.col("node"), "left").withColumn("c", F.coalesce("component", "fp")).drop("node", "component")
    mixed = here.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("len")).where("low <> high")
    here = here.join(mixed.select("token", "len"), "token")
    here = here.withColumn("blocks", F.ceil(F.col("len") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    here = here.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here = here.select("token", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "fp", "n", "c", "heavy", "pos")
    here = here.join(classes.select(F.col("fp").alias("f2"), F.col("n").alias("n2"), "hist", "head"), (F.col("fp") == F.col("f2")) & (F.col("n") == F.col("n2"))).drop("f2", "n2")
    parts = shuffle_partitions(lists.sparkSession)
    dealt = here.repartition(parts, "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")

    def pairs_of(rows: dict[str, np.ndarray], lo: int, hi: int) -> list[tuple[np.ndarray, np.ndarray]]:
        left = rows if lo == hi else {k: v[rows["mine"] == lo] for k, v in rows.items()}
        right = rows if lo == hi else {k: v[rows["mine"] == hi] for k, v in rows.items()}
        out = []
        for k in range(len(left["fp"])):
            p = left["n"][k]
            ok = (right["c"] != left["c"][k]) & (right["heavy"] | left["heavy"][k])
            ok &= np.minimum(right["n"], p) * den >= np.maximum(right["n"], p) * num
            if lo == hi:
                ok &= right["fp"] > left["fp"][k]
            ok &= np.minimum(right["n"] - right["pos"], p - left["pos"][k]) * (den + num) >= num * (right["n"] + p)
            at = np.flatnonzero(ok)
            if len(at):
                at = at[_may_link(right["hist"][at], left["hist"][k], right["n"][at], p, num, den)]
                shared = (right["head"][at][:, None, :] == left["head"][k][None, :, None]).any(2)
                at = at[~shared[:, : left["pos"][k]].any(1)]
                if len(at):
                    out.append((np.full(len(at), left["fp"][k]), right["fp"][at]))
        return out

    def step(batches):
        held, key = [], None

        def flush():
            table = pa.Table.from_batches(held)
            rows = {k: table.column(k).to_numpy() for k in ("mine", "fp", "n", "c", "heavy", "pos")}
            rows["hist"] = np.stack([np.frombuffer(h, "u1") for h in table.column("hist").to_pylist()])
            heads = table.column("head").combine_chunks()
            sizes = heads.value_lengths().to_numpy()
            # shorter ones end in repeats of their last element
            rows["head"] = heads.flatten().to_numpy()[(np.cumsum(sizes) - sizes)[:, None] + np.minimum(np.arange(HEAD), sizes[:, None] - 1)]
            found = pairs_of(rows, key[1], key[2])
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            keys = list(zip(*(b.column(c).to_numpy() for c in ("token", "lo", "hi"))))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if keys[s] != key and held:
                    yield from flush()
                    held = []
                key = keys[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from flush()

    return dealt.mapInArrow(step, "a bigint, b bigint").distinct()


def _allowed(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that the histograms of both sets allow."""
    side = lambda s: classes.select(F.col("fp").alias(s), F.col("n").alias(f"n_{s}"), F.col("hist").alias(f"h_{s}"))

    def step(batches):
        for batch in batches:
            if batch.num_rows:
                h = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(-1, BINS) for c in ("h_a", "h_b")]
                n = [batch.column(c).to_numpy().astype("i8") for c in ("n_a", "n_b")]
                yield batch.filter(pa.array(_may_link(h[0], h[1], n[0], n[1], num, den))).select(["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(step, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs whose full sets link. Each set travels once for each pair it is b of; a hot centre's pairs are dealt
    out over several tasks, its own set going to each."""
    spark = pairs.sparkSession
    salt = F.pmod(F.xxhash64("b"), F.col("salts"))
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).alias("salts"))
    salted = pairs.join(counts, "a").select("a", salt.alias("salt"), "b")
    roles = salted.select(F.col("b").alias("fp"), F.struct(F.col("a"), F.col("salt"), F.lit(True).alias("member")).alias("role")).union(
        counts.select(F.col("a").alias("fp"), F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: F.struct(F.col("a"), k.cast("bigint").alias("salt"), F.lit(False).alias("member")))).alias("role"))
    )
    # a class's set is made once for ROLES of its parts, so that no row grows with the number of its pairs
    many = roles.groupBy("fp").agg(F.ceil(F.count("*") / ROLES).alias("groups"))
    roles = roles.join(many, "fp").groupBy("fp", F.pmod(F.xxhash64("role"), F.col("groups"))).agg(F.collect_list("role").alias("roles"))
    texts = docs.join(roles.join(classes.select("fp", "id"), "fp"), "id")  # one row of the class stands for it

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], ["a", "salt", "member", "fp", "x"])

    def sets(batches):
        shingler = per_process("shingler", n, lambda: Shingler(n))
        for b in batches:
            rows, size = [], 0
            for fp, roles_, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingler.many(b.column(2).to_pylist())):
                x = x.tobytes()
                for r in roles_:
                    rows.append((r["a"], r["salt"], r["member"], fp, x))
                    size += len(x)
                    if size >= SETS_BYTES:
                        yield emit(rows)
                        rows, size = [], 0
            if rows:
                yield emit(rows)

    parts = shuffle_partitions(spark)
    sent = texts.select("fp", "roles", "t").mapInArrow(sets, "a bigint, salt bigint, member boolean, fp bigint, x binary")
    # a repeated id can bring texts of another class along: the class of what has come is told by its set below
    dealt = sent.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "member", "fp")

    def compare(batches):
        import xxhash

        centre, key = None, None
        for b in batches:
            out_a, out_b = [], []
            for k, (a, salt_no, member, fp) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
                x = b.column(4)[k].as_buffer()  # no copy
                if xxhash.xxh3_64_intdigest(x) - (1 << 63) != fp:
                    continue
                x = np.frombuffer(x, "u8")
                if not member:
                    centre, key = x.copy(), (a, salt_no)
                elif key == (a, salt_no):
                    both = len(np.intersect1d(centre, x, assume_unique=True))
                    if den * both >= num * (len(centre) + len(x) - both):
                        out_a.append(a)
                        out_b.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """comp after more links: these are drawn between components, and only those that they join get a new name."""
    if comp is None:
        return saved(components(links), "ngram-components")
    at = lambda c: F.coalesce(f"of_{c}", c)
    for c in ("a", "b"):
        links = links.join(comp.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    moved = components(links.select(at("a").alias("a"), at("b").alias("b"))).withColumnsRenamed({"node": "was", "component": "now"})
    moved = saved(moved, "ngram-moved")
    kept = comp.join(moved, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    new = moved.join(comp, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return saved(kept.union(new), "ngram-components")


def similar_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the smallest id reachable by links, itself included).

    Two documents link when their sets' Jaccard similarity is threshold (a fraction, num / den) or more. Fewer than n
    words make one n-gram of all; no words, an empty text or null make the empty set, which links with nothing. Rows
    with a null id take no part and have a null component; rows that repeat an id are documents that share it.
    """
    num, den = threshold
    every = bounded_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    docs = every.where("id is not null")
    survey = saved(_survey(docs, n), "ngram-survey")
    sizes = {r["key"]: r["n"] for r in survey.where(f"kind = 0 and key <= {2 * LIGHT_MOST}").collect()}
    # the lists that are scanned are those of rare elements, so the plain mean tells, not the one by entries
    lists_mean = survey.where("kind = 2").agg((F.sum("n") / F.count("*")).alias("m")).first()["m"] or 1.0
    light = boundary(sizes, float(lists_mean), num, den)
    hot = survey.where("kind = 1").orderBy(F.desc("n"), "key").limit(HOT_ELEMENTS).toPandas()
    keys = hot["key"].to_numpy(dtype="i8").view("u8")
    order = np.argsort(keys)
    profiles = saved(_profiles(every, n, num, den, light, (keys[order], hot["n"].to_numpy(dtype="i8")[order])), "ngram-profiles")

    reps = profiles.where("n > 0 and id is not null").groupBy("fp", "n").agg(F.min("id").alias("id"))
    classes = saved(profiles.join(reps, ["fp", "n", "id"]).dropDuplicates(["fp", "n"]), "ngram-classes")

    # light with light: a common subset is the link
    subsets = classes.where(F.size("keys") > 0).select("fp", "n", F.explode(F.arrays_zip("keys", "key_sizes")).alias("k"))
    subsets = subsets.select("fp", "n", F.col("k.keys").alias("key"), F.col("k.key_sizes").alias("size"))
    least = subsets.groupBy("key", "size").agg(F.min(F.struct("n", "fp")).alias("m"), F.count("*").alias("len")).where("len > 1").drop("len")
    edges = subsets.join(least, ["key", "size"]).where("m.fp <> fp").where(F.col("size") * (num + den) >= num * (F.col("n") + F.col("m.n")))
    edges = saved(edges.select(F.col("m.fp").alias("a"), F.col("fp").alias("b")).distinct(), "ngram-links")

    # heavy with all: inverted lists
    lists = classes.select(F.posexplode("prefix").alias("pos", "token"), "fp", "n", (F.col("n") > light).alias("heavy"))
    shared = lists.groupBy("token").agg(F.count("*").alias("len")).where("len > 1")
    lists = saved(lists.join(shared.select("token"), "token"), "ngram-lists")
    slim = classes.select("fp", "n", "hist", "id")
    comp = None if edges.isEmpty() else saved(components(edges), "ngram-components")
    for k in range(STAR_ROUNDS):
        pairs = saved(_allowed(_star(lists, comp, k, num, den), slim, num, den), "ngram-pairs")
        if pairs.isEmpty():
            break
        comp = _joined(comp, saved(_verified(pairs, docs, slim, n, num, den), "ngram-links"))
    comp = edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if comp is None else comp  # none at all
    heads = classes.select("fp", "n", "hist", F.slice("prefix", 1, HEAD).alias("head"))
    pairs = saved(_blocks(lists, comp, heads, num, den), "ngram-pairs")
    if not pairs.isEmpty():
        comp = _joined(comp, saved(_verified(pairs, docs, slim, n, num, den), "ngram-links"))

    labelled = classes.select("fp", "n", "id").join(comp, F.col("fp") == F.col("node"), "left").withColumn("c", F.coalesce("component", "fp"))
    lowest = labelled.groupBy("c").agg(F.min("id").alias("low"))
    of_class = labelled.join(lowest, "c").select("fp", "n", "low")
    out = profiles.select("id", "n", "fp").join(of_class, ["fp", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """docs without those that a smaller id of their component stands for; rows with a null id stay. Same columns."""
    found = similar_components(docs, text_col, id_col, n, threshold)
    name = free_name(docs, "gone")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
