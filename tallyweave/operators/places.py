"""Places of rows in the order of their group, without a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import stored


def with_place(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place (from 1 on, long) in order among the rows of its keys; null keys are a group.

    Rows are dealt to sorted ranges of (keys, order), so a group may span any number of tasks. A row's place is its number
    in its range, plus what earlier ranges hold of its group: as many counts as there are groups and ranges. The order
    should be total, else equal rows get their places in any order. The sorted rows are written once, so that ranges and
    numbers stay as they were when a task runs again.
    """
    tags = {t: _free(df, t) for t in ("range", "line")}
    # nulls lie where orderBy puts them; both ways agree as the same expressions deal and sort
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = stored(dealt.withColumns({tags["range"]: F.spark_partition_id(), tags["line"]: F.monotonically_increasing_id()}), "places")
    counts = rows.groupBy(*keys, tags["range"]).agg(F.count("*").alias("n"), F.min(tags["line"]).alias("first"))
    # one row for each group and range: few, whatever the number of rows
    earlier = Window.partitionBy(*keys).orderBy(tags["range"]).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(tags["range"]).alias("at"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    on = [rows[tags["range"]] == shifts["at"], *(rows[k].eqNullSafe(shifts[f"k{i}"]) for i, k in enumerate(keys))]
    return rows.join(shifts, on).select(*(rows[c] for c in df.columns), (rows[tags["line"]] + shifts["shift"]).alias(name))


def _free(df: DataFrame, wanted: str) -> str:
    while wanted.lower() in {c.lower() for c in df.columns}:
        wanted += "_"
    return wanted
