"""Pairing items inside candidate rooms: name hints, proposals, two passes, one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as X
from ..sources.tables import stored
from .rooms import sequence_ratio


def sides(items: DataFrame, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Items of A and of B with the room pair's key (run_id, room_a): B comes once for each room of A it may match.
    Without blocks, rooms of equal names."""
    named = items.withColumn("norm", X.normalized_description("description"))
    cols = ["id", "page", "room", "description", "norm", "quantity", "unit", "unit_price", "amount"]
    a = named.where("doc = 'A'").select("run_id", F.col("room").alias("room_a"), *(F.col(c).alias(f"a_{c}") for c in cols))
    b = named.where("doc = 'B'").select("run_id", *(F.col(c).alias(f"b_{c}") for c in cols))
    if blocks is None:
        return a, b.withColumn("room_a", F.col("b_room"))
    return a, b.join(blocks.select("run_id", "room_a", F.col("room_b").alias("b_room")), ["run_id", "b_room"])


def exact_hints(a: DataFrame, b: DataFrame, k: int = 8, fields: bool = False) -> DataFrame:
    """Items of B with the same normalised text, the first k by page and id; for items of A without any, those with
    the same set of two or more tokens. fields: with the numbers of both, for exact_edges.

    Equal texts have equal sets, so items meet once, by set; what follows stays where the join has put them.
    """
    key = ["run_id", "room_a"]
    bag = lambda c: F.array_join(F.array_sort(F.filter(F.array_distinct(F.split(c, " ")), lambda t: t != "")), " ")
    numbers = NUMBERS if fields else ("id",)
    side = lambda df, s: df.select(*key, f"{s}_norm", *(f"{s}_{c}" for c in dict.fromkeys(("id", *numbers, *(["page"] if s == "b" else [])))), bag(F.col(f"{s}_norm")).alias("bag"))
    met = side(a, "a").where("a_norm <> ''").join(side(b, "b"), [*key, "bag"]).withColumn("same", F.col("a_norm") == F.col("b_norm")).where("same or bag like '% %'")
    item = Window.partitionBy(*key, "bag", "a_id").orderBy("b_page", "b_id")  # one order for both: pairs are sorted once
    any_same = F.max("same").over(item.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    every = met.withColumn("any_same", any_same).where("same = any_same").withColumn("kind", F.when(F.col("same"), "text").otherwise("tokens"))
    kept = every.withColumn("rank", F.row_number().over(item)).where(F.col("rank") <= k)
    return kept.select(*key, "a_id", "b_id", "b_page", "kind", "rank", *(f"{s}_{c}" for s in "ab" for c in numbers if f"{s}_{c}" not in ("a_id", "b_id", "b_page")))


#: an item's fields in the score of a pair and the order of equal ones
NUMBERS = ("id", "page", "amount", "quantity", "unit_price", "unit")


#: the signs of a normalised description
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789' "


def signs(c: str) -> Column:
    """How often each of SIGNS occurs."""
    return F.array(*(F.length(c) - F.length(F.replace(F.col(c), F.lit(s), F.lit(""))) for s in SIGNS))


def near_hints(a: DataFrame, b: DataFrame, least: float = 0.64, k: int = 6) -> DataFrame:
    """The k most alike items of B for each item of A. Texts are compared once for each pair of different ones, whatever the number of
    rooms, and only if the signs they share, counted, or their tokens allow the score."""
    key = ["run_id", "room_a"]
    # read several times: texts are normalised once
    a, b = stored(a.select(*key, "a_norm", "a_id"), "near-a"), stored(b.select(*key, "b_norm", "b_id", "b_page"), "near-b")
    names = lambda df, s: df.where(f"{s}_norm <> ''").select(*key, f"{s}_norm").distinct()
    met = names(a, "a").join(names(b, "b"), key)
    # written out, or what follows would be worked out before pairs are made distinct; few scores are known to be few, and go to the pairs
    texts = stored(met.select("a_norm", "b_norm").distinct(), "near-texts")
    told = texts.withColumns({f"{s}_{c}": v for s in "ab" for c, v in (("set", F.array_distinct(F.split(f"{s}_norm", " "))), ("signs", signs(f"{s}_norm")))})
    told = told.withColumn("jaccard", N.jaccard(F.col("a_set"), F.col("b_set")))
    # matching blocks hold no sign more often than both texts do
    shared = F.aggregate(F.zip_with("a_signs", "b_signs", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    bound = shared * 2.0 / (F.length("a_norm") + F.length("b_norm"))
    may = told.where((bound >= least) | (F.col("jaccard") >= least)).select("a_norm", "b_norm", "jaccard")
    scored = may.withColumn("score", F.greatest(sequence_ratio("a_norm", "b_norm"), "jaccard")).where(F.col("score") >= least)
    good = met.join(stored(scored.select("a_norm", "b_norm", "score"), "near-scores"), ["a_norm", "b_norm"])
    # the k best of B hold for all items of A with one text
    w = Window.partitionBy(*key, "a_norm").orderBy(F.desc("score"), "b_page", "b_id")
    best = good.join(b.select(*key, "b_norm", "b_id", "b_page"), [*key, "b_norm"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return a.select(*key, "a_norm", "a_id").join(best, [*key, "a_norm"]).select(*key, "a_id", "b_id", F.round("score", 3).alias("similarity"), "rank")


def exact_edges(exact: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of exact names with what their numbers score, for greedy_matching; exact_hints that have the numbers keep these: items aren't
    looked up again."""
    key = ["run_id", "room_a"]
    numbers = lambda df, s: df.select(*key, *(f"{s}_{c}" for c in NUMBERS))
    pairs = exact if "a_amount" in exact.columns else exact.select(*key, "a_id", "b_id").join(numbers(a, "a"), [*key, "a_id"]).join(numbers(b, "b"), [*key, "b_id"])
    return pairs.select(*key, "a_id", "a_page", "b_id", "b_page", N.metadata_alignment("a_", "b_").alias("score"))


def offline_proposals(a: DataFrame, edges: DataFrame, near: DataFrame) -> DataFrame:
    """The default scorer in place of a model: an exact candidate (0.93; of several the closest numbers), else the most
    alike one, else none. One row for each item of A."""
    key = ["run_id", "room_a"]
    w = Window.partitionBy("run_id", "a_id")
    first = edges.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "b_page", "b_id"))).where("rank = 1").select("run_id", "a_id", F.col("b_id").alias("exact_id"))
    second = near.where("rank = 1").select("run_id", "a_id", F.col("b_id").alias("near_id"), "similarity")
    out = a.select(*key, "a_id", "a_page").join(first, ["run_id", "a_id"], "left").join(second, ["run_id", "a_id"], "left")
    chosen = F.coalesce("exact_id", "near_id")
    why = F.when(F.col("exact_id").isNotNull(), "same name").when(F.col("near_id").isNotNull(), "similar name").otherwise("no candidate")
    return out.select(
        *key, "a_id", "a_page", chosen.alias("b_id"), chosen.isNotNull().alias("scope_same"),
        F.when(F.col("exact_id").isNotNull(), 0.93).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("confidence"), why.alias("rationale"), F.lit(False).alias("critical_blue"),
    )


def with_reason(proposals: DataFrame) -> DataFrame:
    return proposals if "rationale" in proposals.columns else proposals.withColumn("rationale", F.lit(""))


def best_by_item(proposals: DataFrame) -> DataFrame:
    """One proposal for each item of A: the most confident, the first of equals; critical if any null one says so."""
    w = Window.partitionBy("run_id", "a_id")
    flag = F.max(F.col("b_id").isNull() & F.coalesce("critical_blue", F.lit(False))).over(w)
    return proposals.withColumn("critical", flag).withColumn("rank", F.row_number().over(w.orderBy(F.desc("confidence"), "pos"))).where("rank = 1").drop("rank", "critical_blue").withColumnRenamed("critical", "critical_blue")


def uncertain(first: DataFrame, review_null: bool = True, unsure: float = 0.50, unsure_null: float = 0.62, unsure_scope: float = 0.68) -> DataFrame:
    """First-pass rows that a second pass looks at again."""
    none = F.col("b_id").isNull()
    again = F.col("confidence").isNull() | (none & F.lit(review_null)) | (F.col("confidence") < unsure) | (none & (F.col("confidence") < unsure_null)) | (~F.coalesce("scope_same", F.lit(False)) & (F.col("confidence") < unsure_scope))
    return first.withColumn("uncertain", again)


def coalesce_passes(first: DataFrame, second: DataFrame, rescue: float = 0.55) -> DataFrame:
    """The second pass wins, except a null over a first match of at least rescue, which says so. An item of B that doesn't
    exist is no null: it wins here and falls to known_only."""
    cols = ["b_id", "scope_same", "confidence", "rationale"]
    s = with_reason(second).select("run_id", "a_id", F.lit(True).alias("seen"), *(F.col(c).alias(f"s_{c}") for c in cols), F.col("critical_blue").alias("s_critical"))
    both = with_reason(first).join(s, ["run_id", "a_id"], "left")
    rescued = F.col("seen") & F.col("s_b_id").isNull() & F.col("b_id").isNotNull() & (F.col("confidence") >= rescue)
    keep = F.col("seen").isNull() | rescued
    critical = F.coalesce("critical_blue", F.lit(False)) | F.coalesce("s_critical", F.lit(False))
    new = {c: F.when(keep, F.col(c)).otherwise(F.col(f"s_{c}")) for c in cols}
    new["rationale"] = F.when(rescued, F.concat(F.lit("[kept pass1 over pass2-null] "), "rationale")).otherwise(new["rationale"])
    return both.select(*(c for c in first.columns if c not in (*cols, "critical_blue")), *(x.alias(c) for c, x in new.items()), critical.alias("critical_blue"))


def known_only(proposals: DataFrame, b: DataFrame) -> DataFrame:
    """Proposals whose item of B isn't among the room's candidates (b: run_id, room_a, b_id) propose none."""
    there = b.select("run_id", "room_a", "b_id").distinct().withColumn("known", F.lit(True))
    out = proposals.join(there, ["run_id", "room_a", "b_id"], "left")
    new = {"b_id": F.when(F.col("known"), F.col("b_id")), "scope_same": F.coalesce("known", F.lit(False)) & F.col("scope_same")}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in proposals.columns))


def assign_one_to_one(proposals: DataFrame) -> DataFrame:
    """Each item of B goes to its first claim by room, confidence, page and id; losers become unmatched, say so, and are
    not tried again. Rooms rank by name."""
    # claims on nothing would make one large group: each is a group by itself, and proposals are worked out once
    nothing = F.when(F.col("b_id").isNull(), F.col("a_id"))
    w = Window.partitionBy("run_id", "b_id", nothing).orderBy("room_a", F.desc("confidence"), "a_page", "a_id")
    out = proposals.withColumn("won", F.col("b_id").isNotNull() & (F.row_number().over(w) == 1))
    if "rationale" in proposals.columns:
        lost = F.concat("rationale", F.lit(" | B="), F.col("b_id").cast("string"), F.lit(" already claimed by higher-confidence pair"))
        out = out.withColumn("rationale", F.when(~F.col("won") & F.col("b_id").isNotNull(), lost).otherwise(F.col("rationale")))
    return out.withColumn("b_id", F.when(F.col("won"), F.col("b_id")))


def _walk(frames):
    """Sorted edges as they come, a room's together; only the ids used in the room are held."""
    at, used_a, used_b = None, set(), set()
    for pdf in frames:
        keep = []
        for run, room, a, b in zip(pdf["run_id"], pdf["room_a"], pdf["a_id"], pdf["b_id"]):
            if (run, room) != at:
                at, used_a, used_b = (run, room), set(), set()
            ok = a not in used_a and b not in used_b
            keep.append(ok)
            if ok:
                used_a.add(a)
                used_b.add(b)
        yield pdf[keep]


def greedy_matching(edges: DataFrame, rounds: int = 24) -> DataFrame:
    """One-to-one pairs of a run's room, best score first, equal ones in the order of A's page and id, then B's (edges: run_id,
    room_a, a_id, a_page, b_id, b_page, score).

    An edge that is the best of both its ends would be taken by a walk over all sorted edges whatever comes before it. So each
    round takes all such edges and drops what they touch; keys are single items, whatever a room holds. Rounds are as many as
    the longest chain of edges that wait for each other; what is left after rounds (chains of hundreds of equal texts) is walked,
    sorted, by run and room.
    """
    cols = ["run_id", "room_a", "a_id", "a_page", "b_id", "b_page", "score"]
    best = [F.desc("score"), F.col("a_page"), F.col("a_id"), F.col("b_page"), F.col("b_id")]
    end = lambda s: Window.partitionBy("run_id", "room_a", f"{s}_id")
    left, done = edges.select(*cols), []
    for _ in range(rounds):
        first = left.withColumn("first_a", F.row_number().over(end("a").orderBy(*best)) == 1)
        first = first.withColumn("taken", F.col("first_a") & (F.row_number().over(end("b").orderBy(*best)) == 1))
        gone = F.max("taken").over(end("a")) | F.col("gone_b")
        after = first.withColumn("gone_b", F.max("taken").over(end("b"))).withColumn("gone", gone).where("taken or not gone").select(*cols, "taken")
        after = stored(after, "greedy")
        done.append(after.where("taken").select(*cols))
        left = after.where("not taken").select(*cols)
        if left.isEmpty():
            break
    else:
        dealt = left.repartition(F.col("run_id"), F.col("room_a")).sortWithinPartitions("run_id", "room_a", *best)
        done.append(dealt.mapInPandas(_walk, left.schema))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("run_id", "room_a", "a_id", "b_id", "score")


def enforce_exact(proposals: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposals with the greedy pairs of exact wording put in: same scope, 0.93 at least, never critical. Items of B
    that an exact proposal of the room holds already are not given away.

    Where proposals have a column said, rows without an answer count as answered with nothing if their room gets any such pair.
    """
    key = ["run_id", "room_a"]
    held = proposals.join(edges.select(*key, "a_id", "b_id"), [*key, "a_id", "b_id"]).select(*key, "b_id").distinct()
    forced = greedy_matching(edges.join(held, [*key, "b_id"], "left_anti")).select(*key, "a_id", F.col("b_id").alias("f_id"), F.col("score").alias("f_score"))
    out = with_reason(proposals).join(forced, [*key, "a_id"], "left")
    hit = F.col("f_id").isNotNull()
    why = F.concat(F.lit("exact-wording override: selected same-name candidate first; metadata_alignment="), F.format_string("%.2f", "f_score"), F.lit(" for downstream green/orange classification"))
    new = {
        "b_id": F.coalesce("f_id", "b_id"), "scope_same": hit | F.col("scope_same"), "confidence": F.when(hit, F.least(F.lit(1.0), F.greatest(F.lit(0.93), F.coalesce("confidence", F.lit(0.0))))).otherwise(F.col("confidence")),
        "rationale": F.when(hit, why).otherwise(F.col("rationale")), "critical_blue": ~hit & F.col("critical_blue"),
    }
    if "said" in proposals.columns:
        out = out.join(forced.select(*key).distinct().withColumn("any_forced", F.lit(True)), key, "left")
        mute = F.col("said").isNull() & F.coalesce("any_forced", F.lit(False)) & ~hit
        for c, v in (("scope_same", F.lit(False)), ("confidence", F.lit(0.0)), ("rationale", F.lit("no candidate selected")), ("critical_blue", F.lit(False))):
            new[c] = F.when(mute, v).otherwise(new[c])
        new["said"] = F.col("said") | mute | hit
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in proposals.columns))


def brief_items(items: DataFrame, length: int = 180) -> DataFrame:
    """What a model is shown of an item, as JSON: id, room, cut description and amount (null too), the rest if present."""
    rest = [F.col(c) for c in ("quantity", "unit", "unit_price")]
    head = [F.col("id"), F.col("room"), X.cut("description", length).alias("description")]
    with_amount = F.to_json(F.struct(*head, F.col("amount"), *rest))
    without = F.concat(F.regexp_replace(F.to_json(F.struct(*head, *rest)), r"\}$", ""), F.lit(',"amount":null}'))
    return items.select("run_id", "doc", "id", F.when(F.col("amount").isNull(), without).otherwise(with_amount).alias("brief"))
