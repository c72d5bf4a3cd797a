"""From text lines to line items: filling rooms down and up, parsing, merging two sources, coverage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as X
from ..sources.tables import stored

BY_DOC = ["run_id", "doc"]


def _lines_of(*by: str):
    return Window.partitionBy(*by).orderBy("page", "line_no")


def page_lines(pages: DataFrame) -> DataFrame:
    """Lines of page texts (run_id, doc, page, text), numbered from 1 on each page. A null text has none."""
    cut = pages.select(*BY_DOC, "page", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "text"))
    return cut.select(*BY_DOC, "page", (F.col("at") + 1).alias("line_no"), "text")


def _over_pages(lines: DataFrame, mark: str, down: bool) -> DataFrame:
    """lines with filled: the nearest mark that isn't null at or before each line (down), or at or after it, in the document.

    A segmented scan: marks are filled inside pages, each page is reduced to its last (first) mark, these are carried from page to
    page, and what reaches a page joins its lines. Documents are windows over their pages only. lines are read twice: stored
    ones are worked out once.
    """
    page = Window.partitionBy(*BY_DOC, "page").orderBy("line_no")
    pages = Window.partitionBy(*BY_DOC).orderBy("page")
    if down:
        inside = F.last(mark, ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, 0))
        ends, reached = F.max_by(mark, F.when(F.col(mark).isNotNull(), F.col("line_no"))), F.last("end__", ignorenulls=True).over(pages.rowsBetween(Window.unboundedPreceding, -1))
    else:
        inside = F.first(mark, ignorenulls=True).over(page.rowsBetween(0, Window.unboundedFollowing))
        ends, reached = F.min_by(mark, F.when(F.col(mark).isNotNull(), F.col("line_no"))), F.first("end__", ignorenulls=True).over(pages.rowsBetween(1, Window.unboundedFollowing))
    carried = lines.groupBy(*BY_DOC, "page").agg(ends.alias("end__")).select(*BY_DOC, "page", reached.alias("reached__")).where("reached__ is not null")
    filled = lines.withColumn("inside__", inside).join(carried, [*BY_DOC, "page"], "left")
    return filled.select(*lines.columns, F.coalesce("inside__", "reached__").alias("filled"))


def fill_rooms_down(lines: DataFrame, is_room: Column, per_page: bool = False, name: Column | None = None) -> DataFrame:
    """Each line with the last heading before it, across pages or on its page; headings are taken out. name: what a heading
    calls the room, by default its text."""
    name = X.collapse("text") if name is None else name
    marked = lines.withColumn("head", F.when(is_room, name))
    if per_page:
        w = _lines_of(*BY_DOC, "page").rowsBetween(Window.unboundedPreceding, 0)
        filled = marked.withColumn("room", F.last("head", ignorenulls=True).over(w))
    else:
        filled = _over_pages(marked, "head", down=True).withColumn("room", F.coalesce("filled", F.lit("(unknown)"))).drop("filled")
    return filled.where("head is null").drop("head")


def fill_rooms_up(lines: DataFrame) -> DataFrame:
    """Each numbered line with the section that the next totals line closes, across pages; null after the last one."""
    filled = _over_pages(lines.withColumn("closes", X.section_total("text")), "closes", down=False).withColumnRenamed("filled", "room")
    return filled.where(F.col("closes").isNull()).withColumn("number", X.item_number("text")).where("number is not null").drop("closes")


def parse_items(lines: DataFrame) -> DataFrame:
    """Rule-based items: lines with an amount or a number, in the room above them; noise is left out."""
    clean = stored(lines.withColumn("text", X.collapse("text")), "clean-lines").where(F.col("text") != "").where(~X.is_noise("text"))
    body = fill_rooms_down(clean, X.is_room_line("text"))
    out = body.withColumn("amount", X.strict_amount("text"))
    return out.where(F.col("amount").isNotNull() | F.col("text").rlike(r"^\d+\.\s+")).withColumnRenamed("text", "description")


def sanitize(extracted: DataFrame, least: float = 0.40) -> DataFrame:
    """Items with a meaningful description, cleaned, and enough confidence; an empty room becomes Unspecified."""
    room = X.collapse("room")
    kept = extracted.where(X.is_meaningful("description") & (F.col("confidence") >= least))
    return kept.withColumns({"description": X.clean_description("description"), "room": F.when(room == "", "Unspecified").otherwise(room)})


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; null keys are equal."""
    return df.withColumn("rank__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank__ = 1").drop("rank__")


def dedupe_items(items: DataFrame) -> DataFrame:
    keyed = items.withColumns({"k_room": X.strip(F.lower(F.coalesce("room", F.lit("")))), "k_desc": X.strip(F.lower(F.coalesce("description", F.lit("")))), "k_amount": F.round("amount", 2)})
    return first_of(keyed, ["run_id", "doc", "page", "k_room", "k_desc", "k_amount"], [F.col("id")]).drop("k_room", "k_desc", "k_amount")


SIGNATURE = ["sig_room", "sig_desc", "sig_amount"]
ITEM = ["room", "description", "quantity", "unit", "unit_price", "amount"]


def best_by_signature(items: DataFrame, *within: str) -> DataFrame:
    """The most confident item of each signature, the first of equals. within: further keys, as the chunk of a page."""
    signed = items.select("*", *X.item_signature(F.col("room"), F.col("description"), F.col("amount")))
    return first_of(signed, [*BY_DOC, "page", *within, *SIGNATURE], [F.desc("confidence"), F.col("pos")])


def merge_sources(primary: DataFrame, secondary: DataFrame, least_primary: float = 0.40, least_secondary: float = 0.60, least_both: float = 0.40, within: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join of two extractions on the signature. Of a signature that both have, the more confident side's item
    stays whole (the primary one of equals) and gains confidence, which must reach least_both; single ones need their own
    least. What stays is sanitized. pos and agreed sides' source come along."""
    keys = [*BY_DOC, "page", *within, *SIGNATURE]
    side = lambda df, c, name: best_by_signature(df, *within).select(*keys, F.col("confidence").alias(c), F.struct(*ITEM, "pos").alias(name))
    p, s = side(primary, "c1", "own"), side(secondary, "c2", "other")
    both = p.alias("p").join(s.alias("s"), [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "full_outer")
    agree = F.col("c1").isNotNull() & F.col("c2").isNotNull()
    agreed = N.dual_confidence(F.col("c1"), F.col("c2"))
    confidence = F.when(agree, F.when(agreed >= least_both, agreed)).when(F.col("c1") >= least_primary, F.col("c1")).when(F.col("c2") >= least_secondary, F.col("c2"))
    item = F.when(agree, F.when(F.col("c1") >= F.col("c2"), F.col("own")).otherwise(F.col("other"))).otherwise(F.coalesce("own", "other"))
    source = F.when(agree, "both").when(F.col("c1").isNotNull(), "primary").otherwise("secondary")
    kept = both.select(*(F.coalesce(f"p.{k}", f"s.{k}").alias(k) for k in keys), item.alias("item"), confidence.alias("confidence"), source.alias("source"))
    return sanitize(kept.where("confidence is not null").select(*keys, "item.*", "confidence", "source"), 0.0)


def join_by_occurrence(items: DataFrame, rooms: DataFrame) -> DataFrame:
    """Each item with the room of the same occurrence of its number on its page (rooms: run_id, doc, page, line_no,
    number, room). Items keep their own room where there is none. place is their order on the page by item number, 9999
    without one."""
    keys = ["run_id", "doc", "page", "number"]
    k = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    left = items.withColumn("number", X.item_number("description")).withColumn("occurrence", k(["id"]))
    right = rooms.where("number is not null and room is not null").withColumn("occurrence", k(["line_no"])).select(*keys, "occurrence", F.col("room").alias("doc_room"))
    place = F.row_number().over(Window.partitionBy("run_id", "doc", "page").orderBy(F.coalesce(F.nullif("number", F.lit(0)), F.lit(9999)), "id"))
    return left.withColumn("place", place).join(right, [*keys, "occurrence"], "left").withColumn("room", F.coalesce("doc_room", "room")).drop("doc_room", "occurrence")


def rooms_by_number(lines: DataFrame) -> DataFrame:
    """The room of each item number on a page, by the heading above; the last mention wins."""
    filled = fill_rooms_down(lines, X.is_room_heading("text"), per_page=True, name=X.room_heading("text")).withColumn("number", X.item_number("text")).where("number is not null and room is not null")
    return first_of(filled, [*BY_DOC, "page", "number"], [F.desc("line_no")]).select(*BY_DOC, "page", "number", "room")


def reassign_rooms(items: DataFrame, by_number: DataFrame) -> DataFrame:
    """items with the room that by_number (rooms_by_number) gives their number on their page, and whether that changed it."""
    keys = [*BY_DOC, "page", "number"]
    told = by_number.select(*keys, F.col("room").alias("told__"))
    joined = items.withColumn("number", X.item_number("description")).join(told, keys, "left")
    changed = F.col("told__").isNotNull() & ~F.col("told__").eqNullSafe(F.col("room"))
    return joined.withColumn("reassigned", changed).withColumn("room", F.coalesce("told__", "room")).select(*items.columns, "reassigned")


def page_coverage(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """For each page with expected numbers: how many there are and are covered, the missing and extra ones (40 and 20
    at most, as the report shows them), first, last and whether all are there. Both inputs: run_id, doc, page, number, pos.

    Numbers count once, in order of their first pos: first and last are the page's, not the smallest and largest; missing ones
    come in the page's order, extra ones in that of the extraction.
    """
    keys = [*BY_DOC, "page"]
    once = lambda df, c: df.where("number is not null").groupBy(*keys, "number").agg(F.min("pos").alias(c))
    both = once(expected, "e").join(once(extracted, "x"), [*keys, "number"], "full_outer")
    here, got = F.col("e").isNotNull(), F.col("x").isNotNull()
    numbers = lambda cond, at: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(at, "number")))), lambda r: r["number"])
    out = both.groupBy(*keys).agg(
        F.count("e").alias("expected"), F.count("x").alias("extracted"), F.count(F.when(here & got, 1)).alias("covered"),
        numbers(~got, "e").alias("missing"), numbers(~here, "x").alias("extra"), F.min_by("number", "e").alias("first"), F.max_by("number", "e").alias("last"),
    )
    return out.where("expected > 0").withColumns({"is_full": F.col("covered") == F.col("expected"), "percent": N.coverage_percent(F.col("covered"), F.col("expected")), "missing": F.slice("missing", 1, 40), "extra": F.slice("extra", 1, 20)})


def document_coverage(pages: DataFrame, shown: int = 25) -> DataFrame:
    """page_coverage summed up by document: pages with numbers, full and incomplete ones, totals, percent, and the first shown
    incomplete pages."""
    w = Window.partitionBy(*BY_DOC).orderBy("page")
    first = pages.where("not is_full").select(*BY_DOC, "page").withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown)
    first = first.groupBy(*BY_DOC).agg(F.array_sort(F.collect_list("page")).alias("problem_pages"))
    full = F.count(F.when(F.col("is_full"), 1))
    sums = pages.groupBy(*BY_DOC).agg(F.count("*").alias("pages_with_indices"), full.alias("pages_full"), (F.count("*") - full).alias("pages_incomplete"), F.sum("expected").alias("expected_total"), F.sum("covered").alias("covered_total"))
    out = sums.withColumns({"missing_total": F.col("expected_total") - F.col("covered_total"), "percent": N.coverage_percent(F.col("covered_total"), F.col("expected_total"))})
    return out.join(first, BY_DOC, "left").withColumn("problem_pages", F.coalesce("problem_pages", F.array().cast("array<int>")))


def page_cut(pages: DataFrame) -> DataFrame:
    """Pages before the first image page, up to and with the first summary page (pages: run_id, doc, page, text,
    image_share)."""
    words = F.size(F.filter(F.split(X.collapse("text"), " "), lambda w: w != ""))
    summary = F.lower(F.coalesce("text", F.lit(""))).contains("summary for dwelling")
    image = (words < 20) & (F.coalesce("image_share", F.lit(0.0)) > 0.30)
    flagged = pages.withColumn("last", F.when(summary & ~image, F.col("page")).when(image, F.col("page") - 1))
    cut = flagged.groupBy(*BY_DOC).agg(F.min("last").alias("cut"))
    return pages.join(cut, BY_DOC).where("cut is null or page <= cut").drop("cut")


Reader = Callable[[object], list[dict]]
_READ = "run_id string, doc string, page int, chunk int, side string, reader string, attempts int, tried int, error string, items array<struct<room: string, description: string, quantity: double, unit: string, unit_price: double, amount: double, confidence: double>>"


def _read(parts: DataFrame, readers: list[tuple[str, Reader]], side: str) -> DataFrame:
    """A row for each part (run_id, doc, page, chunk, content): what the first reader that didn't fail found.

    Readers are asked in order, on the executors. attempts counts those that were asked, if one answered, else it is 0; tried
    counts them in any case, and error is what the last failure said. Only the reader's own exceptions are caught: a lost
    executor or a full disk fails the task, which Spark runs again.
    """
    names = [f.split(":")[0] for f in _READ[_READ.index("struct<") + 7 :].rstrip(">").split(", ")]

    def work(frames):
        for pdf in frames:
            rows = []
            for run, doc, page, chunk, content in zip(*(pdf[c] for c in ("run_id", "doc", "page", "chunk", "content"))):
                found, who, tried, error = [], None, 0, None
                for name, read in readers:
                    tried += 1
                    try:
                        found, who = read(bytes(content) if side == "image" else content), name
                        break
                    except Exception as e:  # noqa: BLE001  the next reader is asked
                        error = f"{name}: {type(e).__name__}: {e}"
                items = [{n: x.get(n) for n in names} for x in found]
                rows.append((run, doc, page, chunk, side, who, tried if who else 0, tried, error, items))
            yield pd.DataFrame(rows, columns=["run_id", "doc", "page", "chunk", "side", "reader", "attempts", "tried", "error", "items"])

    return parts.select(*BY_DOC, "page", "chunk", "content").mapInPandas(work, _READ)


@dataclass
class PagesRead:
    """items (run_id, doc, page, chunk, pos, ..., confidence, source, reassigned) and pages (run_id, doc, page and the struct
    read: chunks, chunks_with_items, attempts, usage, image, reassigned, errors)."""

    items: DataFrame
    pages: DataFrame


def read_pages(pages: DataFrame, text_readers: list[tuple[str, Reader]], image_readers: list[tuple[str, Reader]] = (), second_readers: list[tuple[str, Reader]] = (), chunk_chars: int = 18_000, least: float = 0.40, least_second: float = 0.60) -> PagesRead:
    """Items of pages (run_id, doc, page, text, and image where there are image readers) by chains of injected readers, in
    place of models.

    The image comes first. Pages where it leaves no item of at least least go to the text readers, in chunks, and to the
    second readers if there are any; where both have items of a chunk, these are merged by signature (merge_sources), else one
    side's own least holds. A page's rooms then follow the headings above its numbers. An item is a dict of the columns room
    to confidence; what it lacks is null, and 0 for confidence.
    """
    flat = lambda read: sanitize(read.select(*BY_DOC, "page", "chunk", "side", F.posexplode("items").alias("pos", "x")).select(*BY_DOC, "page", "chunk", "side", "pos", "x.*").fillna({"confidence": 0.0}), 0.0)
    keys = [*BY_DOC, "page"]
    todo, seen, by_image = pages, None, None
    if image_readers:
        shown = pages.where("image is not null").select(*keys, F.lit(0).alias("chunk"), F.col("image").alias("content"))
        seen = stored(_read(shown, list(image_readers), "image"), "read-images")
        by_image = flat(seen).where(F.col("confidence") >= least).withColumn("source", F.lit("image"))
        todo = pages.join(by_image.select(*keys).distinct(), keys, "left_anti")
    chunked = todo.select(*keys, F.posexplode(X.chunks("text", max(6000, chunk_chars))).alias("chunk", "content"))
    read = _read(chunked, list(text_readers), "primary")
    if second_readers:
        read = read.unionByName(_read(chunked, list(second_readers), "secondary"))
    read = stored(read, "read-texts")
    found = stored(flat(read), "read-found")
    first, second = found.where("side = 'primary'"), found.where("side = 'secondary'")
    of = lambda df: df.select(*keys, "chunk").distinct()
    both = of(first).join(of(second), [*keys, "chunk"])
    merged = merge_sources(first.join(both, [*keys, "chunk"], "left_semi"), second.join(both, [*keys, "chunk"], "left_semi"), least, least_second, least, within=("chunk",))
    alone = found.join(both, [*keys, "chunk"], "left_anti").where(F.col("confidence") >= F.when(F.col("side") == "primary", least).otherwise(least_second)).withColumn("source", F.col("side"))
    cols = [*keys, "chunk", "pos", *ITEM, "confidence", "source"]
    items = merged.select(*cols).unionByName(alone.select(*cols))
    if by_image is not None:
        items = items.unionByName(by_image.select(*cols))
    items = stored(reassign_rooms(items, rooms_by_number(page_lines(pages))), "read-items")
    return PagesRead(items, _telemetry(pages, read if seen is None else read.unionByName(seen), items))


def _telemetry(pages: DataFrame, read: DataFrame, items: DataFrame) -> DataFrame:
    keys = [*BY_DOC, "page"]
    asked = read.groupBy(*keys).agg(F.countDistinct(F.when(F.col("side") != "image", F.col("chunk"))).alias("parts"), F.sum("attempts").alias("attempts"), F.max((F.col("side") == "image") & F.col("reader").isNotNull()).alias("image"), F.array_sort(F.collect_set("error")).alias("errors"))
    used = read.where("reader is not null").groupBy(*keys, "reader").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reader", "n")))).alias("usage"))
    gave = items.groupBy(*keys).agg(F.countDistinct("chunk").alias("with_items"), F.max(F.col("source") == "image").alias("by_image"), F.count(F.when(F.col("reassigned"), 1)).alias("reassigned"))
    out = pages.select(*keys).join(asked, keys, "left").join(used, keys, "left").join(gave, keys, "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    no = lambda c: F.coalesce(c, F.lit(False))
    return out.select(*keys, F.struct(
        F.when(no("by_image"), F.lit(1).cast("bigint")).otherwise(n("parts")).alias("chunks"), n("with_items").alias("chunks_with_items"), n("attempts").alias("attempts"),
        F.coalesce("usage", F.create_map().cast("map<string,bigint>")).alias("usage"), no("image").alias("image"), n("reassigned").alias("reassigned"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
    ).alias("read"))


def extraction_counters(pages: DataFrame) -> DataFrame:
    """Counters of each document from its pages (PagesRead.pages): pages, chunks, attempts, image pages, rooms changed, and how
    often each reader was used."""
    r = lambda f: F.col(f"read.{f}")
    sums = pages.groupBy(*BY_DOC).agg(
        F.count("*").alias("pages"), F.sum(r("chunks")).alias("chunks"), F.sum(r("chunks_with_items")).alias("chunks_with_items"), F.sum(r("attempts")).alias("attempts"),
        F.count(F.when(r("image"), 1)).alias("image_pages"), F.sum(r("reassigned")).alias("reassigned"),
    )
    used = pages.select(*BY_DOC, F.explode(r("usage")).alias("reader", "n")).groupBy(*BY_DOC, "reader").agg(F.sum("n").alias("n"))
    usage = used.groupBy(*BY_DOC).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reader", "n")))).alias("usage"))
    return sums.join(usage, BY_DOC, "left")
