"""The whole reconciliation: items of many runs to links, matches, counts and report rows."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import matching as M
from ..operators import report as R
from ..operators import rooms as rooms_
from ..sources.tables import kept, stored, tables_until_done


@dataclass
class Reconciled:
    items: DataFrame
    links: DataFrame
    components: DataFrame
    pairs: DataFrame
    matches: DataFrame
    counts: DataFrame
    audit: DataFrame

    @functools.cached_property
    def report(self) -> DataFrame:
        """Report rows in order, commented; its places are worked out, and stored, when it is first asked for."""
        return R.once_each(R.in_order(R.report_rows(self.matches, self.items))).withColumn("comment", R.comment())


def map_rooms(items: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Room links of every run. judge may turn ambiguous pairs into links (run_id, room_a, room_b, confidence,
    rationale); links to pairs that it was not asked about are left out. By default it finds none."""
    profiles = stored(rooms_.profiles(items), "room-profiles")
    ranked = stored(rooms_.ranked(rooms_.score_pairs(profiles)), "room-pairs")
    groups = [rooms_.exact_links(profiles), rooms_.deterministic_links(ranked)]
    if judge is not None:
        asked = rooms_.ambiguous_pairs(ranked)
        groups.append(judge(asked).join(asked.select("run_id", "room_a", "room_b"), ["run_id", "room_a", "room_b"], "left_semi"))
    return rooms_.cap_links(rooms_.merge_links(*groups))


def first_pass(items: DataFrame, blocks: DataFrame | None = None, near: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Offline proposals for every item of A, exact wording enforced; the scored pairs of exact names; and the proposals
    before that. near: whether names that are only alike are proposed too."""
    a, b = M.sides(items, blocks)
    edges = stored(M.exact_edges(M.exact_hints(a, b, fields=True), a, b), "exact-edges")
    with tables_until_done(items.sparkSession):
        alike = M.near_hints(a, b) if near else items.sparkSession.createDataFrame([], "run_id string, room_a string, a_id bigint, b_id bigint, similarity double, rank int")
        proposals = kept(M.offline_proposals(a, edges, alike), "offline")
    return M.enforce_exact(proposals, edges), edges, proposals


def second_pass(first: DataFrame, edges: DataFrame, proposals: DataFrame, second: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What second says of the uncertain rows (run_id, a_id, b_id, scope_same, confidence, critical_blue; rationale, pos and failed
    if it has them), the best answer for each, exact wording enforced among these, coalesced with the first pass.

    For rows that come back as failed the offline proposals stand in, and exact wording is enforced on them too; others keep their
    answers. An exception that second itself raises ends the job: operators/review.py turns those of a reviewer into rows.
    """
    cols = ["b_id", "scope_same", "confidence", "rationale", "critical_blue"]
    unsure = first.where("uncertain")
    asked = unsure.select("run_id", "room_a", "a_id")
    answers = M.with_reason(second(unsure))
    extra = {"pos": F.coalesce("b_id", F.lit(-1)), "failed": F.lit(False)}
    answers = stored(answers.withColumns({c: v for c, v in extra.items() if c not in answers.columns}).select("run_id", "a_id", *cols, "pos", "failed"), "second-pass")
    failed = answers.where("failed").select("run_id", "a_id").distinct()
    said = M.best_by_item(answers.where("not failed").join(failed, ["run_id", "a_id"], "left_anti")).select("run_id", "a_id", *cols)
    stand_in = M.with_reason(proposals).join(failed, ["run_id", "a_id"], "left_semi").select("run_id", "a_id", *cols)
    rows = asked.join(said.unionByName(stand_in).withColumn("said", F.lit(True)), ["run_id", "a_id"], "left")
    reviewed = M.enforce_exact(rows, edges.join(asked, ["run_id", "room_a", "a_id"], "left_semi")).where("said")
    return M.coalesce_passes(first, reviewed)


def reconcile(items: DataFrame, judge: Callable | None = None, second: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None, least: float = 0.6) -> Reconciled:
    """second may review the uncertain first-pass rows: it takes them, with both sides of their rooms for a reviewer by room, as
    in second=lambda unsure, a, b: by_room(reviewer, a, b)(unsure). Items of B that it makes up are dropped."""
    spark = items.sparkSession
    # what leads to a result is deleted as soon as that is written
    with tables_until_done(spark):
        links = kept(map_rooms(items, judge), "room-links")
    components = rooms_.components(items.select("run_id", "doc", "room").distinct(), links, max(0.40, least - 0.18))
    with tables_until_done(spark):
        with tables_until_done(spark):
            profiles = rooms_.profiles(items, rooms_.X.match_tokens)
            blocks = kept(rooms_.candidate_rooms(profiles, links, components, least), "room-blocks")
        proposals, edges, offline = first_pass(items, blocks)
        if second is not None:
            first = stored(M.uncertain(proposals), "first-pass")
            a, b = M.sides(items, blocks)
            proposals = M.known_only(second_pass(first, edges, offline, lambda unsure: second(unsure, a, b)).drop("uncertain"), b)
        assigned = kept(M.assign_one_to_one(proposals), "assigned")
    pairs = stored(C.classify(C.with_sides(assigned, items)), "pairs")
    nuggets = C.nuggets(items, assigned, links)
    matches = pairs.select("run_id", "room_a", F.col("b_room").alias("room_b"), "a_id", "b_id", "status", "rationale").unionByName(
        nuggets.select("run_id", "room_a", "room_b", F.lit(None).cast("bigint").alias("a_id"), "b_id", "status", F.lit("").alias("rationale"))
    )
    return Reconciled(items, links, components, pairs, matches, C.status_counts(matches), C.coverage_audit(items, pairs))
