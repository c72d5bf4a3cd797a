"""A reviewer asked room by room, on the executors, with a failure of its own for each room."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

KEY = ["run_id", "room_a"]
FIELDS = ["room", "description", "amount", "quantity", "unit", "unit_price"]
ANSWERS = "run_id string, room_a string, a_id bigint, b_id bigint, scope_same boolean, confidence double, rationale string, critical_blue boolean, pos bigint, failed boolean, error string"

TYPES = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.split()[1]]) for f in ANSWERS.split(", ")])

#: What a reviewer is asked: run_id, room_a, items_a and items_b (dicts of id and FIELDS, by page and id), and first, what the first
#: pass said of each item of A. It answers with dicts of item_a_id, item_b_id, scope_same, confidence, rationale, critical_blue.
Reviewer = Callable[[dict], list[dict]]


def _parts(rows: DataFrame, size: int, name: str) -> DataFrame:
    """How many parts each room has: one, if it has at most size rows."""
    return rows.groupBy(*KEY).agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def by_room(reviewer: Reviewer, a: DataFrame, b: DataFrame, size: int = 500) -> Callable[[DataFrame], DataFrame]:
    """A second pass that asks reviewer about the unsure items of one room at a time (a, b: matching.sides).

    A room of more than size unsure items, or more than about size items of B, is asked about in parts, each part of A with each
    of B, so that no task holds more than two parts; the most confident answer counts. Where reviewer raises, the
    items of A of that call come back as failed, with the error, and other rooms keep their answers. Answers about items of A
    that weren't asked about are dropped; items of B are checked later (matching.known_only). Rooms without items of B
    aren't asked about.
    """

    def ask(unsure: DataFrame) -> DataFrame:
        first = unsure.select(*KEY, "a_id", F.col("b_id").alias("first_b"), F.col("scope_same").alias("first_scope"), F.col("confidence").alias("first_confidence"))
        own, other = a.join(first, [*KEY, "a_id"]), b
        parts = stored(_parts(own, size, "parts_a").join(_parts(other, size, "parts_b"), KEY), "review-parts")
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        call = [*KEY, "part_a", "part_b"]
        shown = lambda s: [F.col(f"{s}_{c}").alias(c) for c in ("page", "id", *FIELDS)]
        said = ["first_b", "first_scope", "first_confidence"]
        own = own.join(parts, KEY).withColumn("part_a", part("a_id", "parts_a")).withColumn("part_b", every("parts_b")).select(*call, F.lit(0).alias("side"), *shown("a"), *said)
        none = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in said]
        other = other.join(parts, KEY).withColumn("part_b", part("b_id", "parts_b")).withColumn("part_a", every("parts_a")).select(*call, F.lit(1).alias("side"), *shown("b"), *none)
        n = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), a.sparkSession.sparkContext.defaultParallelism)
        # a number of its own: calls are slow, and small sizes aren't put together
        dealt = own.unionByName(other).repartition(n, *call).sortWithinPartitions(*call, "side", "page", "id")
        return dealt.mapInArrow(walk, ANSWERS)

    def walk(batches):
        """Sorted items as they come, a call's together, its items of A first; only one call's items are held, and answers go out by batch."""
        at, held, ids, said = None, ([], []), set(), {}
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (*KEY, "part_a", "part_b", "side", "id", *FIELDS, "first_b", "first_scope", "first_confidence")]
            for run, room, i, j, side, id_, *more in zip(*columns):
                if (run, room, i, j) != at:
                    out += one(at, held, ids, said)
                    at, held, ids, said = (run, room, i, j), ([], []), set(), {}
                held[side].append({"id": id_, **dict(zip(FIELDS, more))})
                if side == 0:
                    ids.add(id_)
                    said[id_] = {"item_b_id": more[-3], "scope_same": bool(more[-2]), "confidence": more[-1]}
            yield from told(out)
        yield from told(one(at, held, ids, said))

    def one(at, held, ids, said) -> list[tuple]:
        if not ids:  # nobody to be asked about
            return []
        run, room = at[:2]
        try:
            answers = reviewer({"run_id": run, "room_a": room, "items_a": held[0], "items_b": held[1], "first": said})
            return [(run, room, x["item_a_id"], x.get("item_b_id"), bool(x.get("scope_same")), float(x.get("confidence") or 0.0), x.get("rationale") or "", bool(x.get("critical_blue")), k, False, None) for k, x in enumerate(answers) if x.get("item_a_id") in ids]
        except Exception as e:  # noqa: BLE001  the room falls back; a lost executor isn't an exception here
            return [(run, room, i, None, False, 0.0, "", False, 0, True, f"{type(e).__name__}: {e}") for i in sorted(ids)]

    def told(rows: list[tuple]):
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), TYPES)], schema=TYPES)

    return ask
