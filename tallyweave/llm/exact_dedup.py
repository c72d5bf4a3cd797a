"""Exact deduplication by a content sort.

Sampled splitters range-partition the texts, an external sort inside each partition places equal texts side by
side, neighbours are compared in full, and one row of each run of equal texts stays.

The sort key is (first bytes of the text, 64-bit hash of the text, text, id). Splitters are drawn over (first
bytes, hash, id) only, so the sample that Spark collects for them has a fixed size per partition however long the
texts are, and a text that a third of all rows share is split over many partitions by its ids. A run may then go
on in the next partition: runs at a partition's edges, two per partition but for hash collisions, are merged in a
second step, by their heads alone. So are the parts of runs that are too long to hold: a task never holds more than
RUN_ROWS rows or RUN_BYTES of them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import bounded_batches, saved, shuffle_partitions

PREFIX_BYTES = 24
RUN_ROWS, RUN_BYTES = 20_000, 16 << 20


def exact_dedup(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    keep: str = "min",
    normalize: Column | None = None,
    carry: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row per input row: column row (struct of the carried columns), keep_id, group_size, kept, text_sha256.

    keep: "min" or "max", the id that stays of equal texts. normalize: the text to compare, by default text_col
    itself. carry: columns for the struct row, all by default, so names never clash.

    A null text counts as empty, so null and empty texts are equal. A null id is larger than any for "min" and
    smaller than any for "max": it stays only where all ids of the texts are null (keep_id is then null). Rows with
    the same text and id: one of them is kept. Texts may be of any length. An empty table gives an empty result.
    """
    spark = bounded_batches(df).sparkSession
    n = partitions or shuffle_partitions(spark)
    id_field = df.schema[id_col]
    order = F.col("i").asc_nulls_last() if keep == "min" else F.col("i").desc_nulls_last()
    text = F.coalesce(normalize if normalize is not None else F.col(text_col), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in (carry or df.columns)))
    keyed = df.select(row.alias("row"), text.alias("t"), F.col(id_col).alias("i"))
    keyed = keyed.withColumn("p", F.substring(F.col("t").cast("binary"), 1, PREFIX_BYTES)).withColumn("h", F.xxhash64("t"))
    placed = keyed.repartitionByRange(n, "p", "h", order).sortWithinPartitions("p", "h", "t", order)
    out = T.StructType(
        [
            T.StructField("row", keyed.schema["row"].dataType),
            T.StructField("i", id_field.dataType),
            T.StructField("text_sha256", T.StringType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("n", T.LongType()),
            T.StructField("best", id_field.dataType),
            T.StructField("open", T.BooleanType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("run", T.IntegerType()),
        ]
    )
    runs = saved(placed.mapInArrow(_runs(to_arrow_schema(out)), out), "exact-runs")
    closed = runs.where("not open").select("row", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.col("first").alias("kept"), "text_sha256")
    # parts of runs: their heads, one of RUN_ROWS rows or two of a partition, tell each part about the whole run
    heads = runs.where("open and first")
    rank = F.struct(F.col("best").isNull().alias("none"), "best", "part", "run")
    rank = F.min(rank) if keep == "min" else F.max(F.struct(F.col("best").isNotNull().alias("some"), "best", "part", "run"))
    whole = heads.groupBy("text_sha256").agg(F.sum("n").alias("all_n"), rank.alias("top"))
    told = heads.select("text_sha256", "part", "run").join(whole, "text_sha256").drop("text_sha256")
    parts = runs.where("open").join(told, ["part", "run"])
    is_top = F.col("first") & (F.col("part") == F.col("top.part")) & (F.col("run") == F.col("top.run"))
    return closed.unionByName(parts.select("row", F.col("top.best").alias("keep_id"), F.col("all_n").alias("group_size"), is_top.alias("kept"), "text_sha256"))


def _runs(schema: pa.Schema):
    """Rows in order, with their run's size and best id. Runs of one (first bytes, hash) are held, RUN_ROWS rows or
    RUN_BYTES at most; what has to be let go before the run's end, and runs at a partition's edges, are open parts."""

    def step(batches):
        part = TaskContext.get().partitionId()
        held: list[list] = []  # runs of the current (p, h): rows, ids, sha, open
        held_rows = held_bytes = n_run = 0
        lead, prev, first_key = None, None, True
        out: list[pa.RecordBatch] = []
        size = 0

        def flush(edge: bool):
            nonlocal held, held_rows, held_bytes, n_run, size
            for rows, ids, sha, is_open in held:
                n = len(ids)
                out.append(
                    pa.RecordBatch.from_arrays(
                        [pa.concat_arrays(rows), pa.array(ids, schema.field("i").type), pa.array([sha] * n), pa.array([True] + [False] * (n - 1)), pa.array([n] * n, pa.int64()), pa.array([ids[0]] * n, schema.field("best").type), pa.array([edge or is_open] * n), pa.array([part] * n, pa.int32()), pa.array([n_run] * n, pa.int32())],
                        schema=schema,
                    )
                )
                n_run += 1
            size += held_rows
            held, held_rows, held_bytes = [], 0, 0

        for b in batches:
            row, t, ids, p, h = (b.column(b.schema.get_field_index(c)) for c in ("row", "t", "i", "p", "h"))
            row = row.cast(schema.field("row").type)
            n = b.num_rows
            if not n:
                continue
            mean = b.nbytes // n + 1
            same = pc.equal(t.slice(1), t.slice(0, n - 1)).to_pylist() if n > 1 else []
            starts = [0] + [k + 1 for k, s in enumerate(same) if not s] + [n]
            ids = ids.to_pylist()
            for a, z in zip(starts, starts[1:]):
                text = t[a].as_py()
                if a == 0 and prev is not None and text == prev:  # goes on from the batch before
                    if not held:
                        held.append([[], [], sha, True])
                    held[-1][0].append(row.slice(a, z - a))
                    held[-1][1].extend(ids[a:z])
                else:
                    key = (p[a].as_py(), h[a].as_py())
                    if key != lead:
                        if lead is not None:
                            flush(first_key)
                            first_key = False
                        lead = key
                    sha = hashlib.sha256(text.encode()).hexdigest()
                    held.append([[row.slice(a, z - a)], list(ids[a:z]), sha, False])
                held_rows += z - a
                held_bytes += mean * (z - a)
                if held_rows >= RUN_ROWS or held_bytes >= RUN_BYTES:
                    held[-1][3] = True
                    flush(first_key)
                if size >= 2000:
                    yield from _joined(out, schema)
                    out, size = [], 0
            prev = t[n - 1].as_py()
        flush(True)
        yield from _joined(out, schema)

    return step


def _joined(batches: list[pa.RecordBatch], schema: pa.Schema):
    if batches:
        yield from pa.Table.from_batches(batches, schema).combine_chunks().to_batches()


def deduplicate(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "min") -> DataFrame:
    """df without the rows that exact_dedup drops; same columns."""
    return exact_dedup(df, text_col, id_col, keep).where("kept").select("row.*")
