"""Linking the rooms of two documents: profiles, scores, links, components, candidate rooms."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as X
from ..sources.tables import stored

# Words that make two rooms of one name different ones.
ROOM_TYPES = ["closet", "bathroom", "bath", "kitchen", "garage", "basement", "laundry", "pantry", "foyer", "entry", "porch", "deck", "attic", "office", "linen"]
MAX_LINKS = 5


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks (Ratcliff and Obershelp), in the order of the arguments. Null counts as empty."""
    seen: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a.fillna(""), b.fillna("")):
        if (x, y) not in seen:
            seen[x, y] = difflib.SequenceMatcher(None, x, y).ratio()
        out.append(seen[x, y])
    return pd.Series(out, dtype="float64")


def profiles(items: DataFrame, tokens: Callable = X.profile_tokens) -> DataFrame:
    """run_id, doc, room and the sorted set of its descriptions' tokens. A room's different descriptions, gathered in one shuffle, are read
    at once, parted by spaces, which are in no token."""
    rooms = items.groupBy("run_id", "doc", "room").agg(F.collect_set("description").alias("texts"))
    return rooms.select("run_id", "doc", "room", F.array_sort(tokens(F.array_join("texts", " "))).alias("profile"))


#: different words and texts, up to which a profile is told in bits; with more, as a set of words
PROFILE_WORDS, PROFILE_TEXTS = 1024, 100_000


def coded_profiles(items: DataFrame, tokens: Callable = X.profile_tokens) -> DataFrame:
    """profiles, stored, with the words as bits of numbers (bits_0 and on, 64 words each) instead of sets: a text's words are read once for
    all items, and a room's bits put together without gathering texts. With over PROFILE_WORDS words or PROFILE_TEXTS texts, profiles itself."""
    # dealt out by run, whatever a run's size: a room's items lie together, so that rooms are shuffled afterwards, not items
    told = stored(items.select("run_id", "doc", "room", "description").hint("rebalance", "run_id"), "room-texts")
    texts = stored(told.select("description").where("description is not null").distinct(), "room-texts")
    words = [] if (many := texts.count() > PROFILE_TEXTS) else texts.select(F.explode(tokens("description")).alias("word")).distinct().limit(PROFILE_WORDS + 1).collect()
    if many or len(words) > PROFILE_WORDS:
        return stored(profiles(told, tokens), "profiles")
    places = [(x["word"], k // 64, k % 64) for k, x in enumerate(sorted(words))] or [("", 0, 0)]
    number = items.sparkSession.createDataFrame(places, "word string, slot int, place int")
    slots = {f"bits_{k}": F.when(F.col("slot") == k, F.expr("shiftleft(1L, place)")) for k in range(places[-1][1] + 1)}
    said = texts.select("description", F.explode(tokens("description")).alias("word")).join(F.broadcast(number), "word")
    codes = stored(said.groupBy("description").agg(*(F.bit_or(v).alias(c) for c, v in slots.items())), "room-codes")
    rooms = told.join(F.broadcast(codes), "description", "left").groupBy("run_id", "doc", "room")
    return stored(rooms.agg(*(F.coalesce(F.bit_or(c), F.lit(0).cast("long")).alias(c) for c in slots)), "profiles")


def name_similarity(a: Column, b: Column, stopwords: bool = True, ratio: Column | None = None) -> Column:
    """0 without tokens or with different numbers on both sides; 0.25 if a kind of room is on one side only; else the
    largest of Jaccard, ratio (left out if None) and 0.92 for equal last tokens."""
    return _alike(X.room_tokens(a, stopwords), X.room_tokens(b, stopwords), F.array_sort(X.room_numbers(a)), F.array_sort(X.room_numbers(b)), ratio)


def _alike(ta: Column, tb: Column, na: Column, nb: Column, ratio: Column | None) -> Column:
    """name_similarity of two names' tokens and sorted numbers."""
    kinds = F.array_union(F.array_except(ta, tb), F.array_except(tb, ta))
    last = F.when(F.element_at(ta, -1) == F.element_at(tb, -1), 0.92).otherwise(0.0)
    terms = [N.jaccard(ta, tb), last] + ([ratio] if ratio is not None else [])
    return (
        F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0)
        .when((F.size(na) > 0) & (F.size(nb) > 0) & (na != nb), 0.0)
        .when(F.arrays_overlap(kinds, F.array(*map(F.lit, ROOM_TYPES))), 0.25)
        .otherwise(F.greatest(*terms))
    )


def _jaccard_of_sets(a: Column, b: Column) -> Column:
    """jaccard of arrays without repeats: their sizes give the union's. No branches: Spark works out once what stands twice only outside
    of them."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)), F.lit(0.0))


def _with_ratio(pairs: DataFrame, a: str, b: str, stopwords: bool) -> DataFrame:
    """pairs with the sequence ratio of two rooms' tokens, worked out once for each pair of names, whatever the number
    of runs, and only where it may raise the similarity."""
    plain = name_similarity(F.col(a), F.col(b), stopwords)
    # written out, or the similarity would be worked out before names are made distinct, once a pair of rooms
    names = stored(pairs.select(a, b).distinct(), "room-names").where(plain < 1.0)
    said = lambda c: F.array_join(X.room_tokens(c, stopwords), " ")
    # written out: few names are known to be few, and go to the pairs
    scored = stored(names.withColumn("ratio", sequence_ratio(said(a), said(b))), "room-ratios")
    return pairs.join(scored, [a, b], "left").fillna({"ratio": 0.0})


def _read_names(rooms: DataFrame, c: str, s: str, stopwords: bool) -> DataFrame:
    """rooms with the tokens (t_) and sorted numbers (n_) of the names in c: read once a room, not once a pair."""
    return rooms.withColumns({f"t_{s}": X.room_tokens(c, stopwords), f"n_{s}": F.array_sort(X.room_numbers(c))})


PAIRS_IN_TASK = 1_000_000


def _dealt(rooms: DataFrame, parts: int) -> DataFrame:
    return rooms.repartition(parts, "run_id")


def _parts(profiles_: DataFrame, a: Column, b: Column) -> int:
    """In how many parts runs are dealt, so that a part has PAIRS_IN_TASK pairs or so of rooms that are a with rooms that are b, whatever their
    number: a task's memory doesn't grow with the input."""
    n = profiles_.groupBy("run_id").agg((F.count_if(a) * F.count_if(b)).alias("n")).agg(F.sum("n")).first()[0]
    least = int(profiles_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(min(least, 2 * profiles_.sparkSession.sparkContext.defaultParallelism), -(-(n or 0) // PAIRS_IN_TASK))


#: different names of A times those of B, up to which each two are compared once, for all runs; with more, once each pair of rooms
NAME_PAIRS = 100_000


def _names_compared(profiles_: DataFrame, stopwords: bool, with_ratio: bool) -> tuple[DataFrame, DataFrame] | None:
    """The different names of A and B, numbered (doc, room, n), and every one of A with every one of B and their similarity (a, b: their
    numbers); None if these are over NAME_PAIRS."""
    names = stored(profiles_.where("doc in ('A', 'B')").select("doc", "room").distinct(), "room-names")
    count = {x["doc"]: x["count"] for x in names.groupBy("doc").count().collect()}
    if count.get("A", 0) * count.get("B", 0) > NAME_PAIRS:
        return None
    # few, by NAME_PAIRS, or on one side only
    names = stored(names.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("room")).cast("long")), "room-names")
    side = lambda d, s: _read_names(names.where(F.col("doc") == d).select(F.col("n").alias(s), F.col("room").alias(f"name_{s}")), f"name_{s}", s, stopwords)
    a, b = side("A", "a"), side("B", "b")
    pairs = a.crossJoin(F.broadcast(b)).repartition(profiles_.sparkSession.sparkContext.defaultParallelism)
    alike = lambda ratio: _alike(*map(F.col, ("t_a", "t_b", "n_a", "n_b")), ratio)
    if with_ratio:
        ratio = sequence_ratio(F.array_join("t_a", " "), F.array_join("t_b", " "))
        pairs = pairs.withColumn("plain", alike(None)).withColumn("ratio", F.when(F.col("plain") < 1.0, ratio).otherwise(0.0))
    return names, stored(pairs.select("a", "b", "name_a", "name_b", alike(F.col("ratio") if with_ratio else None).alias("name")), "room-names")


def _profiles_alike(held: list[str]) -> Column:
    """Jaccard of two rooms' profiles, whose columns held have _a and _b behind them: sets of words, or bits."""
    if held == ["profile"]:
        return _jaccard_of_sets(F.col("profile_a"), F.col("profile_b"))
    bits = lambda op: sum((F.bit_count(op(F.col(f"{c}_a"), F.col(f"{c}_b"))) for c in held[1:]), F.bit_count(op(F.col(f"{held[0]}_a"), F.col(f"{held[0]}_b"))))
    return bits(Column.bitwiseAND) / F.greatest(bits(Column.bitwiseOR), F.lit(1))


def score_pairs(profiles_: DataFrame, stopwords: bool = True, with_ratio: bool = True, only: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """Every room of A (only: of these, run_id and room_a) with every room of B in the same run, scored; least: those with a combined score of
    at least that, whose profiles alone are compared if their names leave it open. Rooms per run are few; runs are dealt by key, in parts by
    the number of pairs; what goes on by run and room stays there. profiles_ (of profiles, or of coded_profiles) is read four times: it had
    better be stored."""
    parts = _parts(profiles_, F.col("doc") == "A", F.col("doc") == "B")
    held = [c for c in profiles_.columns if c.startswith("bits_")] or ["profile"]
    side = lambda d, s: profiles_.where(F.col("doc") == d).select("run_id", F.col("room").alias(f"room_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in held))
    a = side("A", "a") if only is None else side("A", "a").join(only, ["run_id", "room_a"], "left_semi")
    b = side("B", "b")
    compared = _names_compared(profiles_, stopwords, with_ratio)
    if compared is not None:
        names, named = compared
        if least is not None:  # a profile adds 0.22 at most
            named = named.where(F.col("name") * 0.78 + 0.22 >= least - 1e-9)
        # rooms go by their names' numbers, and a pair of names is found by one number
        times = F.lit(1 << 32)
        named = named.select((F.col("a") * times + F.col("b")).alias("both"), F.col("name_a").alias("room_a"), F.col("name_b").alias("room_b"), "name")

        def numbered(rooms: DataFrame, d: str, s: str) -> DataFrame:
            known = names.where(F.col("doc") == d).select(F.col("room").alias("name"), F.col("n").alias(s))
            return _dealt(rooms.join(F.broadcast(known), F.col(f"room_{s}").eqNullSafe(F.col("name"))).drop("name", f"room_{s}"), parts)

        pairs = numbered(a, "A", "a").join(numbered(b, "B", "b"), "run_id").withColumn("both", F.col("a") * times + F.col("b")).drop("a", "b")
        pairs = pairs.join(F.broadcast(named), "both")
    else:
        pairs = _read_names(_dealt(a, parts), "room_a", "a", stopwords).join(_read_names(_dealt(b, parts), "room_b", "b", stopwords), "run_id")
        if with_ratio:
            pairs = _with_ratio(pairs, "room_a", "room_b", stopwords)
        pairs = pairs.withColumn("name", _alike(*map(F.col, ("t_a", "t_b", "n_a", "n_b")), F.col("ratio") if with_ratio else None))
    pairs = pairs.withColumn("profile", _profiles_alike(held))
    pairs = pairs.select("run_id", "room_a", "room_b", "name", "profile", (F.col("name") * 0.78 + F.col("profile") * 0.22).alias("combined"))
    return pairs if least is None else pairs.where(F.col("combined") >= least)


def exact_links(rooms: DataFrame) -> DataFrame:
    """Rooms of equal names but for case and spaces around."""
    side = lambda d, s: rooms.where(F.col("doc") == d).select("run_id", F.col("room").alias(f"room_{s}"), X.strip(F.lower("room")).alias("key")).distinct()
    return side("A", "a").join(side("B", "b"), ["run_id", "key"]).select("run_id", "room_a", "room_b", F.lit(0.99).alias("confidence"), F.lit("exact-name-match").alias("rationale"))


def _best_first() -> list[Column]:
    """Nine places: the last bits of a sum don't order equal scores."""
    return [F.desc(N.nine_places(F.col("combined"))), F.col("room_b")]


#: pairs scored below this are never accepted (names at 0.78, profiles at 0.15), nor before one that is
LEAST_FIT = 0.64


def ranked(pairs: DataFrame, k: int = 8) -> DataFrame:
    """The k best pairs of each room of A with their rank, and what becomes of them: accepted (3 at most), else
    ambiguous, else neither."""
    w = Window.partitionBy("run_id", "room_a").orderBy(*_best_first())
    top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    fit = (F.col("combined") >= 0.82) | ((F.col("name") >= 0.78) & (F.col("profile") >= 0.15))
    top = top.withColumn("fit", fit).withColumn("so_far", F.sum(F.col("fit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    accepted = F.col("fit") & (F.col("so_far") <= 3)
    ambiguous = ~accepted & ((F.col("combined") >= 0.58) | (F.col("name") >= 0.66) | (F.col("profile") >= 0.26))
    return top.withColumn("accepted", accepted).withColumn("ambiguous", ambiguous).drop("fit", "so_far")


def deterministic_links(ranked_: DataFrame) -> DataFrame:
    return ranked_.where("accepted").select("run_id", "room_a", "room_b", N.link_confidence(F.col("combined"), F.col("name")).alias("confidence"), F.lit("deterministic-room-link").alias("rationale"))


def ambiguous_pairs(ranked_: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("run_id", "room_a").orderBy(*_best_first())
    return ranked_.where("ambiguous").withColumn("choice", F.row_number().over(w)).where(F.col("choice") <= k)


def merge_links(*groups: DataFrame, least: float = 0.42) -> DataFrame:
    """One link for each pair of rooms, folded in order of the groups: the best confidence; of two reasons the more confident
    link's comes first, the earlier one's of equals, and one that the other contains is left out. Inside a group the
    more confident link comes first."""
    every = None
    for k, g in enumerate(groups):
        g = g.select("run_id", "room_a", "room_b", "confidence", F.coalesce("rationale", F.lit("")).alias("rationale"), F.lit(k).alias("place"))
        every = g if every is None else every.unionByName(g)
    # by a window: its sort takes rows as they are, where an aggregate would make and write out a list for each link before the shuffle
    w = Window.partitionBy("run_id", "room_a", "room_b").orderBy("place", -F.col("confidence"), "rationale")
    links = F.collect_list(F.struct("rationale", "confidence")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def fold(held, x):
        both = (held["rationale"] != "") & (x["rationale"] != "")
        better = x["confidence"] > held["confidence"]
        front, back = F.when(better, x["rationale"]).otherwise(held["rationale"]), F.when(better, held["rationale"]).otherwise(x["rationale"])
        reason = F.when(both & ~front.contains(back), F.concat_ws("; ", front, back)).when(better & (front == ""), back).otherwise(front)
        return F.struct(F.greatest(held["confidence"], x["confidence"]).alias("confidence"), reason.alias("rationale"))

    first = F.struct(F.element_at("links", 1)["confidence"].alias("confidence"), F.element_at("links", 1)["rationale"].alias("rationale"))
    merged = every.withColumns({"links": links, "n": F.row_number().over(w)}).where("n = 1")
    out = merged.select("run_id", "room_a", "room_b", F.aggregate(F.slice("links", 2, 1 << 30), first, fold).alias("m"))
    return out.select("run_id", "room_a", "room_b", "m.confidence", "m.rationale").where(F.col("confidence") >= least)


def _cap(batches):
    """Links as they come, a run's together and sorted; only the run's counts are held."""
    at, used_a, used_b = None, {}, {}

    def told(column) -> list:
        coded = column.dictionary_encode(null_encoding="encode")
        words = coded.dictionary.to_pylist()
        return [words[k] for k in coded.indices.to_pylist()]

    for batch in batches:
        keep = []
        for run, a, b in zip(*(told(batch.column(c)) for c in ("run_id", "room_a", "room_b"))):
            if run != at:
                at, used_a, used_b = run, {}, {}
            of_a, of_b = used_a.get(a, 0), used_b.get(b, 0)
            keep.append(of_a < MAX_LINKS or of_b < MAX_LINKS)
            if keep[-1]:
                used_a[a], used_b[b] = of_a + 1, of_b + 1
        yield batch.filter(pa.array(keep, pa.bool_()))


def cap_links(links: DataFrame, dealt: bool = False) -> DataFrame:
    """By confidence: a link goes if both its rooms have MAX_LINKS kept links already. The kept counts depend on each
    other, so runs are walked, as a sorted stream (dealt: a run's links are in one partition as they come, as those of score_pairs). Links
    are worked out once, and a task holds a part of the runs, sorted with spill."""
    links = links if dealt else links.repartition(F.col("run_id"))
    return links.sortWithinPartitions("run_id", F.desc("confidence"), "room_a", "room_b").mapInArrow(_cap, links.schema)


WALK = 100_000


def _spread(frames):
    """Edges (run_id, u, v), a run's together: each of its nodes with the smallest one it reaches. Only the run's nodes are held."""
    at, above = None, {}

    def top(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for pdf in frames:
        out = []
        for run, u, v in zip(pdf["run_id"], pdf["u"], pdf["v"]):
            if run != at:
                out += [(at, x, top(x)) for x in above]
                at, above = run, {}
            u, v = top(above.setdefault(u, u)), top(above.setdefault(v, v))
            above[max(u, v)] = min(u, v)
        yield pd.DataFrame(out, columns=["run_id", "node", "component"])
    yield pd.DataFrame([(at, x, top(x)) for x in above], columns=["run_id", "node", "component"])


def components(rooms: DataFrame, links: DataFrame, floor: float, max_rounds: int = 40, walk: int = WALK) -> DataFrame:
    """run_id, node (A::room or B::room) and component (its smallest node), by links of at least floor; rooms without
    a link are their own. Runs of up to walk edges are walked as a stream, run by run; in larger ones labels spread in rounds."""
    nodes = rooms.select("run_id", F.concat("doc", F.lit("::"), "room").alias("u")).distinct()
    edges = links.where(F.col("confidence") >= floor).select("run_id", F.concat(F.lit("A::"), "room_a").alias("u"), F.concat(F.lit("B::"), "room_b").alias("v"))
    every = stored(edges.unionByName(nodes.withColumn("v", F.col("u"))).where("run_id is not null and u is not null and v is not null"), "room-edges")
    large = stored(every.groupBy("run_id").count().where(F.col("count") > walk).select("run_id"), "room-large")
    none = large.isEmpty()
    small = every if none else every.join(large, "run_id", "left_anti")
    dealt = small.repartition(F.col("run_id")).sortWithinPartitions("run_id")
    walked = dealt.mapInPandas(_spread, nodes.select("run_id", F.col("u").alias("node"), F.col("u").alias("component")).schema)
    return walked if none else walked.unionByName(_in_rounds(every.join(large, "run_id", "left_semi"), max_rounds))


def _in_rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """components of edges (run_id, u, v), nodes by themselves among them. Labels spread along edges and to their labels' labels, so rounds
    are few."""
    both = stored(edges.union(edges.select("run_id", "v", "u")).distinct(), "room-edges")
    now = stored(both.select("run_id", F.col("u").alias("node")).distinct().withColumn("component", F.col("node")), "room-labels")
    for _ in range(max_rounds):
        near = both.join(now, (both.run_id == now.run_id) & (both.v == now.node)).groupBy(both.run_id, F.col("u").alias("node")).agg(F.min("component").alias("low"))
        after = now.join(near, ["run_id", "node"], "left").select("run_id", "node", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("component"))
        up = after.select("run_id", F.col("node").alias("component"), F.col("component").alias("top"))
        after = stored(after.join(up, ["run_id", "component"]).select("run_id", "node", F.col("top").alias("component"), (F.col("top") != F.col("old")).alias("moved")), "room-labels")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now
    raise RuntimeError("room components did not settle")


def group_stats(components_: DataFrame, links: DataFrame) -> DataFrame:
    """For each component: its rooms, and count, largest and mean confidence of all links inside, weak ones too."""
    sized = components_.groupBy("run_id", "component").agg(F.sum(F.col("node").startswith("A::").cast("int")).alias("rooms_a"), F.sum(F.col("node").startswith("B::").cast("int")).alias("rooms_b"))
    label = lambda s: components_.select("run_id", F.col("node").alias(f"n_{s}"), F.col("component").alias(f"c_{s}"))
    inside = links.withColumn("n_a", F.concat(F.lit("A::"), "room_a")).withColumn("n_b", F.concat(F.lit("B::"), "room_b"))
    inside = inside.join(label("a"), ["run_id", "n_a"]).join(label("b"), ["run_id", "n_b"]).where("c_a = c_b")
    stats = inside.groupBy("run_id", F.col("c_a").alias("component")).agg(F.count("*").alias("link_count"), F.max("confidence").alias("max_confidence"), F.avg("confidence").alias("avg_confidence"))
    return sized.join(stats, ["run_id", "component"], "left").fillna({"link_count": 0, "max_confidence": 0.0, "avg_confidence": 0.0})


def group_order(stats: DataFrame) -> DataFrame:
    """group_stats with their place in the run: most rooms first, then the best link, then the smallest component."""
    w = Window.partitionBy("run_id").orderBy(F.desc(F.col("rooms_a") + F.col("rooms_b")), F.desc("max_confidence"), "component")
    return stats.withColumn("place", F.row_number().over(w))


def component_candidates(components_: DataFrame) -> DataFrame:
    """Every room of A with every room of B of its component."""
    side = lambda d, s: components_.where(F.col("node").startswith(f"{d}::")).select("run_id", "component", F.expr("substring(node, 4)").alias(f"room_{s}"))
    return side("A", "a").join(side("B", "b"), ["run_id", "component"]).select("run_id", "room_a", "room_b")


def strong_links(links: DataFrame, least: float = 0.6) -> DataFrame:
    """Links of at least least; for rooms of A without one, up to three near their best if that is good enough."""
    # one order for both: the best link is the first one
    w = Window.partitionBy("run_id", "room_a").orderBy(F.desc("confidence"), "room_b")
    # weaker links are never near enough, and stand behind those that are: they stay out of the sort
    links = links.where(F.col("confidence") >= min(0.45, least))
    top = links.withColumns({"top": F.first("confidence").over(w), "rank": F.row_number().over(w)})
    weak = (F.col("top") < least) & (F.col("top") >= max(0.45, least - 0.20)) & (F.col("confidence") >= F.greatest(F.lit(0.45), F.col("top") - 0.12)) & (F.col("rank") <= 3)
    return top.where((F.col("confidence") >= least) | weak).drop("top", "rank")


def soft_candidates(profiles_: DataFrame, limit: int = 6, with_ratio: bool = True, only: DataFrame | None = None) -> DataFrame:
    """The best rooms of B for each room of A (only: of these) by names and profiles; the first ones by name where none qualify."""
    pairs = score_pairs(profiles_, stopwords=False, with_ratio=with_ratio, only=only).withColumn("score", F.col("name") * 0.72 + F.col("profile") * 0.28)
    poor = (F.col("score") < 0.20) & (F.col("name") < 0.34) & (F.col("profile") < 0.10)
    w = Window.partitionBy("run_id", "room_a")
    pairs = pairs.withColumn("good", ~poor).withColumn("any_good", F.max("good").over(w))
    order = w.orderBy(F.desc(F.when(F.col("any_good"), F.col("score")).otherwise(0.0)), "room_b")
    return pairs.where("good or not any_good").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("run_id", "room_a", "room_b", "score", "rank")


def expand(candidates: DataFrame, profiles_: DataFrame, with_ratio: bool = True) -> DataFrame:
    """candidates and the rooms of B that are much like one of them; one step, not a closure."""
    b = profiles_.where("doc = 'B'").select("run_id", "room", "profile")
    left, right = b.select("run_id", F.col("room").alias("room_b"), F.col("profile").alias("p1")), b.select("run_id", F.col("room").alias("near"), F.col("profile").alias("p2"))
    pairs = _read_names(left, "room_b", "b", False).join(_read_names(right, "near", "c", False), "run_id").where("room_b <> near")
    if with_ratio:
        pairs = _with_ratio(pairs, "room_b", "near", False)
    name = _alike(*map(F.col, ("t_b", "t_c", "n_b", "n_c")), F.col("ratio") if with_ratio else None)
    alike = pairs.withColumn("name", name).where("name >= 0.80").where((F.col("name") >= 0.90) | (_jaccard_of_sets(F.col("p1"), F.col("p2")) >= 0.06)).select("run_id", "room_b", "near")
    own = candidates.select("run_id", "room_a", "room_b").distinct()
    return own.union(own.join(alike, ["run_id", "room_b"]).select("run_id", "room_a", F.col("near"))).distinct()


def candidate_cascade(profiles_: DataFrame, links: DataFrame, components_: DataFrame, least: float = 0.6, with_ratio: bool = True) -> DataFrame:
    """The rooms of B that each room of A is compared with (run_id, room_a, room_b), and by which rule of the cascade (mode):

    strong or low-confidence-fallback links, with the other rooms of B in the component; room-group-fallback, of rooms that have the
    component only; name-profile-fallback, the six softest-scored rooms where there is neither; each with the rooms of B that are much
    like one of them (expanded: whether there are any). global-room-fallback: the ten best-scored rooms, where no item of B lies
    in any of these, as of links to rooms that are gone. profiles_ has the rooms with items.
    """
    key, pair = ["run_id", "room_a"], ["run_id", "room_a", "room_b"]
    profiles_ = stored(profiles_, "room-profiles")
    rooms = lambda d, s: profiles_.where(F.col("doc") == d).select("run_id", F.col("room").alias(f"room_{s}"))
    firm = strong_links(links, least).withColumn("mode", F.when(F.col("confidence") >= least, "strong").otherwise("low-confidence-fallback"))
    tagged = firm.select(*pair, "mode").unionByName(component_candidates(components_).withColumn("mode", F.lit("room-group-fallback")))
    # written out: read more than once, and joins don't take a union's parts for the parts of its inputs
    linked = stored(tagged.join(rooms("A", "a"), key, "left_semi"), "room-linked")
    rank = {"strong": 0, "low-confidence-fallback": 1, "room-group-fallback": 2}
    mode = lambda: F.min_by("mode", F.element_at(F.create_map(*(F.lit(x) for kv in rank.items() for x in kv)), F.col("mode")))
    modes = linked.groupBy(*key).agg(mode().alias("mode"))
    soft = lambda bare, k: soft_candidates(profiles_, k, with_ratio, bare).select(*pair)
    # rooms of A without a link, and only these, are scored softly
    bare = rooms("A", "a").join(modes, key, "left_anti")
    seeds = linked.select(*pair).distinct().join(modes, key).unionByName(soft(bare, 6).withColumn("mode", F.lit("name-profile-fallback")))
    seeds = stored(seeds, "room-seeds")
    wide = expand(seeds, profiles_, with_ratio).join(seeds.select(*key, "mode").distinct(), key)
    found = wide.join(rooms("B", "b"), ["run_id", "room_b"], "left_semi").select(*pair, "mode")
    found = stored(found.join(seeds.select(*pair).withColumn("seed", F.lit(True)), pair, "left").withColumn("added", F.col("seed").isNull()).drop("seed"), "room-blocks")
    more = found.groupBy(*key).agg(F.max("added").alias("expanded"))
    none = rooms("A", "a").join(more, key, "left_anti")
    last = soft(none, 10).select(*pair, F.lit("global-room-fallback").alias("mode"), F.lit(False).alias("expanded"))
    return found.drop("added").join(more, key).select(*pair, "mode", "expanded").unionByName(last)


def candidate_rooms(profiles_: DataFrame, links: DataFrame, components_: DataFrame, least: float = 0.6, with_ratio: bool = True) -> DataFrame:
    return candidate_cascade(profiles_, links, components_, least, with_ratio).select("run_id", "room_a", "room_b")


def component_counts(components_: DataFrame) -> DataFrame:
    """Number of components of each run, and of rooms of A with a room of B in theirs."""
    w = Window.partitionBy("run_id", "component")
    marked = components_.withColumn("b", F.max(F.col("node").startswith("B::")).over(w))
    return marked.groupBy("run_id").agg(F.countDistinct("component").alias("components"), F.count(F.when(F.col("b") & F.col("node").startswith("A::"), 1)).alias("rooms_a_covered"))
