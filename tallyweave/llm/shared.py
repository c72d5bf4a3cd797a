"""Helpers that several operators share: tables in the shared folder, sizes, hash splits, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: list[str] = []  # this process's own folder, where Spark runs in one machine and none is named
_SAVED: list[str] = []
_STAGE: list[str] = []  # those that the last stage of a pipeline saved


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where none is named, a local one, if the master is local
    (tests); on a cluster, where each executor would write to its own disk, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tallyweave-"))
        named = _LOCAL[0]
    return named.rstrip("/")


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Executors delete a query's shuffle files as it ends, for queries run inside; else they stay until the driver's JVM happens
    to collect the plan. For writes only: a plan that is run once more would have to shuffle again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back, which cuts its lineage; its shuffle files go with the write.
    drop_saved deletes it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    _SAVED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the tables that df is read from, where saved wrote them, once nothing reads them any more."""
    _delete(df.sparkSession, _read_by(df))


def _read_by(df: DataFrame) -> list[str]:
    """The saved tables that df is read from."""
    plain = lambda path: path.split(":", 1)[-1].lstrip("/")
    folders = {plain(f.rsplit("/", 1)[0]) for f in df.inputFiles()}
    return [p for p in _SAVED if plain(p) in folders]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _SAVED.remove(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def stage_tables(docs: DataFrame):
    """For a stage that takes docs once the stage before it has been written: deletes the tables that one saved, but for those
    that docs is read from, and remembers those saved inside for the next stage. Other tables stay."""
    read = set(_read_by(docs))
    _delete(docs.sparkSession, [p for p in _STAGE if p in _SAVED and p not in read])
    before = len(_SAVED)
    try:
        yield
    finally:
        _STAGE[:] = [*read.intersection(_STAGE), *_SAVED[before:]]


def drop_saved(spark: SparkSession) -> int:
    """Deletes every table that this driver has saved, and says how many; for use once results are written."""
    n = 0
    while _SAVED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SAVED.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores after it, so that no column of df has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


BATCH_BYTES = 8 << 20
SHORT = 64  # characters of the longest key that memos keep; what is longer is worked out each time, so memos are bounded in bytes


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to BATCH_BYTES: whole texts fill memory on both sides of the pipe."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def gathered(batches, rows: int, size: int = BATCH_BYTES):
    """Record batches put together to at least rows rows or size bytes, but for the last."""
    held, n, held_bytes = [], 0, 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        held_bytes += b.nbytes
        if n >= rows or held_bytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, held_bytes = [], 0, 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_KEPT: list = [None, None]


def per_process(kind: str, key, make):
    """make(), kept by this Python worker for its next tasks. Only the last one asked for is kept: workers live on
    from stage to stage, and what earlier stages remembered would add up."""
    if _KEPT[0] != (kind, key):
        _KEPT[:] = [None, None]
        _KEPT[:] = [(kind, key), make()]
    return _KEPT[1]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(id_col: Column | str, n: int) -> Column:
    """crc32 of the id written as text, mod n; the fold that the labels' contracts name."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b), both long, not null.

    Alternating large-star and small-star steps, each a pre-aggregated group-by; the number of rounds grows with
    the logarithm of the longest path. Every round is written to the shared folder. Nodes without an edge to
    another node don't appear.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours move to the smallest of the neighbourhood
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        marks = [d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (now, after)]
        now = after
        if marks[0] == marks[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
