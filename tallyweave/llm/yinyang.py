"""Centroid clustering with Yinyang bounds: exact k-means on whole numbers, with few distances worked out.

Centroids are put into groups once, at the start. Each vector keeps an upper bound of the distance to its own centroid and,
for each group, a lower bound of the distance to the group's other centroids. When centroids move, bounds are widened by how
far. A vector whose upper bound lies under all lower bounds keeps its centroid (global filter); else its own distance is worked
out, and only groups whose bound lies under it are scanned (group filter), every centroid of these exactly.

Bounds are doubles with a margin for rounding, and a group is left out only if it is farther for certain; distances that decide
are whole numbers, so ties go to the smaller number as in a plain scan. Vectors with their bounds are a table in the shared folder,
written anew each round; the one before is deleted. Sums are made in each task, then by cluster and component. Only
centroids, counts and inertia pass through the driver: k numbers for each component.

A vector that is null, has another number of components, or a null or non-finite one is left out; so is one with a component
of 2**27 or more (scaled), whose squared distances could leave 64 bits. Rows of one id are vectors of their own; null ids start
no cluster before others do. With fewer vectors than clusters each vector starts one; without any the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, saved

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, "1:"
LARGEST = 1 << 27
MARGIN = 1e-9  # relative, of all bounds; doubles err by 1e-15
STATE = "id {}, v array<int>, cluster int, distance bigint, upper double, lower array<double>, scanned int"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """id and v, the floored components times scale, of the vectors that count."""
    x = lambda c: c.cast("double") * float(scale)
    fine = F.forall(vector_col, lambda c: F.coalesce(F.abs(x(c)) < float(LARGEST), F.lit(False)))  # NaN is above all numbers
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col)).where((F.size(vector_col) == dimensions) & fine)
    return kept.select("id", F.transform(vector_col, lambda c: F.floor(x(c)).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids hash smallest, in order of the hash."""
    hashed = F.when(F.col("id").isNotNull(), F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256))
    rows = vectors.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], "i8")


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids."""
    middle = centroids[np.linspace(0, len(centroids) - 1, groups).astype(int)].astype("f8")
    for _ in range(rounds):
        away = np.stack([((centroids - m) ** 2).sum(1) for m in middle], 1)
        own = away.argmin(1)
        middle = np.stack([centroids[own == g].mean(0) if (own == g).any() else middle[g] for g in range(groups)])
    return own


class Assigner:
    """Vectors to their nearest centroids, given how far centroids moved since the bounds were made."""

    def __init__(self, centroids: np.ndarray, groups: np.ndarray, moved: np.ndarray | None):
        self.c, self.moved = centroids, moved
        self.members = [np.flatnonzero(groups == g) for g in range(int(groups.max()) + 1)]
        self.members = [m for m in self.members if len(m)]
        self.group_of = np.empty(len(centroids), "i8")
        for g, m in enumerate(self.members):
            self.group_of[m] = g

    def squared(self, v: np.ndarray, k) -> np.ndarray:
        d = v - self.c[k]
        return np.einsum("ij,ij->i", d, d)

    def fresh(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first round: everything is scanned."""
        n, scan = len(v), np.ones((len(v), len(self.members)), bool)
        none = np.full(n, -1)
        at, best, lower, scanned = self._scan(v, none, np.full(n, np.iinfo("i8").max), np.zeros((n, len(self.members))), scan)
        return at, best, np.sqrt(best.astype("f8")) * (1 + MARGIN), lower, scanned

    def again(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, last: bool):
        """Any later round. Distances are worked out where the global filter lets a vector through, and in the last round
        for all; elsewhere they are 0."""
        upper = (upper + self.moved[own]) * (1 + MARGIN)
        lower = (lower - np.array([self.moved[m].max() for m in self.members])) * np.where(lower > 0, 1 - MARGIN, 1.0)
        maybe = lower.min(1) <= upper
        known = np.flatnonzero(maybe | last)
        distance = np.zeros(len(v), "i8")
        distance[known] = self.squared(v[known], own[known])
        upper[known] = np.sqrt(distance[known].astype("f8")) * (1 + MARGIN)
        scan = maybe[:, None] & (lower <= upper[:, None])
        at, best, lower, scanned = self._scan(v, own, distance, lower, scan)
        upper[known] = np.sqrt(best[known].astype("f8")) * (1 + MARGIN)
        return at, best, upper, lower, scanned

    def _scan(self, v, own, distance, lower, scan):
        """Scans the groups of each vector that scan names. lower holds of the others."""
        best, at, lower, before = distance.copy(), own.copy(), lower.copy(), own
        seconds = {}
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(scan[:, g])
            if not len(rows):
                continue
            away = np.stack([self.squared(v[rows], k) for k in members], 1)
            seconds[g] = rows, away
            near = away.min(1)
            number = members[away.argmin(1)]  # members ascend: the smaller number of equals
            better = (near < best[rows]) | ((near == best[rows]) & (number < at[rows]))
            best[rows[better]], at[rows[better]] = near[better], number[better]
        for g, (rows, away) in seconds.items():
            away = np.where(self.members[g][None, :] == at[rows][:, None], np.iinfo("i8").max, away)  # the own centroid doesn't count
            lower[rows, g] = np.sqrt(away.min(1).astype("f8")) * (1 - MARGIN)
        left = np.flatnonzero((before != at) & (before >= 0))  # the one that was left now counts in its group
        g = self.group_of[before[left]]
        lower[left, g] = np.minimum(lower[left, g], np.sqrt(distance[left].astype("f8")) * (1 - MARGIN))
        scanned = sum(scan[:, g].astype("i4") * len(m) for g, m in enumerate(self.members))
        return at, best, lower, scanned


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype="i4") * rows.shape[1], pa.array(rows.ravel(), kind))


def _assigned(state: DataFrame, work: Assigner, first: bool, last: bool, id_type: str) -> DataFrame:
    def assign(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), "i8")
            if first:
                out = work.fresh(v)
            else:
                out = work.again(v, b.column("cluster").to_numpy(), b.column("upper").to_numpy(), _matrix(b.column("lower"), "f8"), last)
            own, distance, upper, lower, scanned = out
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), pa.array(own, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper), _lists(lower, pa.float64()), pa.array(scanned, pa.int32())],
                ["id", "v", "cluster", "distance", "upper", "lower", "scanned"],
            )

    return state.mapInArrow(assign, STATE.format(id_type))


def _sums(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of components and counts by cluster, exact: each task sends k rows, added as decimals."""

    def add(batches: Iterable[pa.RecordBatch]):
        total = np.zeros((k, dimensions + 1), "i8")
        for b in batches:
            own, v = b.column("cluster").to_numpy(), _matrix(b.column("v"), "i8") if b.num_rows else None
            for c in np.unique(own):
                rows = v[own == c]
                total[c, :-1] += rows.sum(0)
                total[c, -1] += len(rows)
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), _lists(total[used], pa.int64())], ["cluster", "sums"])

    parts = state.select("cluster", "v").mapInArrow(add, "cluster int, sums array<bigint>")
    each = parts.select("cluster", F.posexplode("sums").alias("at", "n")).groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(19,0)")).alias("n"))
    sums, counts = np.zeros((k, dimensions), object), np.zeros(k, object)
    for c, at, n in each.collect():
        if at == dimensions:
            counts[c] = int(n)
        else:
            sums[c, at] = int(n)
    return sums, counts


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, groups: int | None = None, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """id, v, cluster, distance (squared) and scanned (centroids compared in the last assignment) of each vector that
    counts, and the final centroids. groups: by default the root of k."""
    state = saved(whole_vectors(vectors, id_col, vector_col, dimensions, scale), "vectors")
    id_type = state.schema["id"].dataType.simpleString()
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        return state.select("id", "v", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("scanned", "int")))), centroids
    k = len(centroids)
    group = grouped(centroids, groups or max(1, round(k**0.5)))
    moved = None
    for at in range(rounds + 1):
        after = saved(_assigned(state, Assigner(centroids, group, moved), moved is None, at == rounds, id_type), "assigned")
        dropped(state)
        state = after
        if at < rounds:
            sums, counts = _sums(state, k, dimensions)
            new = np.array([[int(s) // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(k)], "i8")
            moved = np.sqrt(((new - centroids) ** 2).sum(1).astype("f8")) * (1 + MARGIN)
            centroids = new
    return state.select("id", "v", "cluster", "distance", "scanned"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with the distances summed over each cluster and over all, and the sha256 of each final centroid."""
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.n) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(c, n, sum(sums.values()), digest(centroids[c].tolist())) for c, n in sums.items() if c is not None]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")  # a row for each cluster
    return assigned.join(F.broadcast(table), "cluster")

