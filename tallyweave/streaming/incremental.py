"""New runs as they come: an extension, not a part of the reconciliation proper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.reconcile import reconcile
from ..sources import tables as tables


def reconcile_stream(spark: SparkSession, items_path: str, out_path: str, checkpoint: str):
    """Takes the run files that items_path has gained since the last call and replaces these runs under out_path.

    A run's items must come together; a batch that is done again writes the same files. A batch's tables go when it is written.
    """
    stream = spark.readStream.schema(tables._schema(tables.ITEMS)).parquet(items_path)

    def batch(df: DataFrame, _: int) -> None:
        with tables.tables_until_done(df.sparkSession):
            items = tables.stored(df, "incoming")
            tables.replace_runs(reconcile(items).matches, out_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
