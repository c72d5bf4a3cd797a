"""Places over ranges equal a plain window's."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.operators.places import with_place


@pytest.mark.parametrize("n,hot", [(0, 0), (1, 0), (500, 400), (3000, 0)])
def test_places(spark, n, hot):
    r = random.Random(n)
    rows = [("hot" if k < hot else r.choice(["a", "b", None]), r.choice([None, 1.5, 2.5, 3.5]), k, "x") for k in range(n)]
    df = spark.createDataFrame(rows, "run string, score double, id bigint, range string").repartition(7)
    order = [F.desc("score"), F.col("id")]
    got = with_place(df, ["run"], order)
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(*order)).cast("bigint"))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_places_without_keys(spark):
    df = spark.range(1000).repartition(5).select("id", (F.col("id") % 10).alias("v"))
    got = {(x.id, x.place) for x in with_place(df, [], [F.desc("v"), F.col("id")], "place").collect()}
    want = {(i, k + 1) for k, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 10), i)))}
    assert got == want
