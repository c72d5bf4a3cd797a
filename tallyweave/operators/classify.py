"""Statuses of assigned items, items of B that nobody claimed, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as X
from .extract import first_of

FIELDS = ["description", "quantity", "unit", "unit_price", "amount", "page", "room"]


def with_sides(assigned: DataFrame, items: DataFrame) -> DataFrame:
    """assigned (run_id, a_id, b_id, ...) with both items' fields as a_ and b_ columns."""
    side = lambda s: items.select("run_id", F.col("id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in FIELDS))
    own = assigned.drop(*(f"{s}_{c}" for s in "ab" for c in FIELDS))
    return own.join(side("a"), ["run_id", "a_id"], "left").join(side("b"), ["run_id", "b_id"], "left")


def classify(pairs: DataFrame, tol: float = N.TOLERANCE) -> DataFrame:
    """status: blue without a partner; green if the scope is the same, the numbers agree, and neither units nor
    specifications differ; else orange. critical stays only on blue.

    mismatch names the numbers that differ; where these would leave the pair green, its units, else its specifications (both
    sides in order). The proposal's rationale goes on with these, or with the mark of a critical item, to 1500 characters.
    """
    ua, ub = X.unit("a_unit"), X.unit("b_unit")
    units = (ua != "") & (ub != "") & (ua != ub)
    sa, sb = X.spec_markers("a_description"), X.spec_markers("b_description")
    specs = (F.size(sa) > 0) & (F.size(sb) > 0) & (sa != sb)
    green = F.coalesce("scope_same", F.lit(False)) & N.within_tolerance("a_", "b_", tol)
    matched = F.col("b_id").isNotNull()
    said = lambda c: F.concat(F.lit("{'"), F.array_join(c, "', '"), F.lit("'}"))
    guard = F.when(matched & green & units, F.concat(F.lit("unit ("), "a_unit", F.lit(" vs "), "b_unit", F.lit(")"))).when(matched & green & specs, F.concat(F.lit("specs ("), said(sa), F.lit(" vs "), said(sb), F.lit(")")))
    status = F.when(~matched, "blue").when(green & ~units & ~specs, "green").otherwise("orange")
    mismatch = F.filter(F.concat(N.mismatches("a_", "b_", tol), F.array(guard)), lambda x: x.isNotNull())
    before = F.coalesce("rationale", F.lit("")) if "rationale" in pairs.columns else F.lit("")
    out = pairs.withColumn("rationale", before).withColumns({"mismatch": F.when(matched, mismatch).otherwise(F.array().cast("array<string>")), "status": status})
    critical = (F.col("status") == "blue") & F.coalesce("critical_blue", F.lit(False))
    differs = F.when(F.size("mismatch") > 0, F.concat(F.lit(" | metadata differs: "), F.array_join("mismatch", ", "))).otherwise("")
    why = F.concat("rationale", differs, F.when(critical, " | [CRITICAL_BLUE] high-priority JDR-only scope").otherwise(""))
    return out.withColumn("critical_blue", critical).withColumn("rationale", F.substring(why, 1, 1500))


def best_room(links: DataFrame) -> DataFrame:
    """The room of A linked best to each room of B."""
    w = Window.partitionBy("run_id", "room_b").orderBy(F.desc("confidence"), "room_a")
    return links.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("run_id", "room_b", "room_a", "confidence")


def nuggets(items: DataFrame, assigned: DataFrame, links: DataFrame, fields: bool = False) -> DataFrame:
    """Items of B that nobody claimed, once for each signature, with the room of A they would belong to; fields: with the items'
    own, as b_ columns."""
    claimed = assigned.where("b_id is not null").select("run_id", F.col("b_id").alias("id"))
    rest = items.where("doc = 'B'").join(claimed, ["run_id", "id"], "left_anti")
    signed = rest.select("*", *X.nugget_signature(F.col("room"), F.col("description"), F.col("amount")))
    once = first_of(signed, ["run_id", "sig_room", "sig_desc", "sig_amount"], [F.col("page"), F.col("id")]).withColumnRenamed("room", "room_b")
    out = once.join(best_room(links).drop("confidence"), ["run_id", "room_b"], "left")
    return out.select("run_id", F.coalesce("room_a", F.lit("(unmapped)")).alias("room_a"), "room_b", F.col("id").alias("b_id"), F.lit("nugget").alias("status"), *(F.col(c).alias(f"b_{c}") for c in FIELDS if fields and c != "room"))


def status_counts(matches: DataFrame) -> DataFrame:
    """All four statuses, zero included."""
    return matches.groupBy("run_id").agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("green", "orange", "blue", "nugget")))


def status_panel(matches: DataFrame) -> DataFrame:
    """status_counts, and how many rows are marked as critical."""
    critical = F.count(F.when(F.coalesce("rationale", F.lit("")).contains("[CRITICAL_BLUE]"), 1)).alias("critical")
    return matches.groupBy("run_id").agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("green", "orange", "blue", "nugget")), critical)


def totals(pairs: DataFrame) -> DataFrame:
    """Amounts of matched items on both sides, and the gap."""
    matched = F.col("status").isin("green", "orange")
    total = lambda s: F.sum(F.when(matched, F.coalesce(f"{s}_amount", F.lit(0.0))).otherwise(0.0))
    return pairs.groupBy("run_id").agg(total("a").alias("total_a"), total("b").alias("total_b")).withColumn("gap", F.abs(F.col("total_a") - F.col("total_b")))


def coverage_audit(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items of A, those with a row of any status, the missing ones, critical ones and the first eight of them."""
    every = items.where("doc = 'A'").groupBy("run_id").agg(F.count("*").alias("total_a_rows"))
    w = Window.partitionBy("run_id").orderBy("a_id")
    shown = pairs.where("critical_blue").withColumn("k", F.row_number().over(w)).where("k <= 8").groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("a_id")), ",").alias("critical_examples"))
    has = pairs.groupBy("run_id").agg(F.count("*").alias("matched_a_rows"), F.count(F.when(F.col("critical_blue"), 1)).alias("critical_blue"))
    out = every.join(has, "run_id", "left").join(shown, "run_id", "left").fillna({"matched_a_rows": 0, "critical_blue": 0, "critical_examples": ""})
    return out.withColumn("missing_a_rows", F.greatest(F.lit(0), F.col("total_a_rows") - F.col("matched_a_rows")))
