"""Benchmark decontamination: windows of benchmark words, looked up in whole documents by a broadcast hash table.

Words are runs of letters, digits and signs beyond ASCII, A-Z in lower case. A window is n consecutive words of an item; an
item of fewer words, but not none, is one window. A word of a document inside any occurrence of a window is hit.

Everything is DataFrame functions. A window is filed under one of its word triples, the rarest in the benchmark, so that
common phrases don't gather windows. Documents' words are exploded inside one codegen stage (words, triple, look-up,
comparison of the whole window), and only hits and one row for each document leave it. Windows are distinct, and held in
blocks of at most BLOCK_BYTES: a benchmark beyond one block costs one scan of the documents for each.

A null text, an empty one and one without words have no words and no hits. Each row of documents is a document of its own,
whatever its id (null, repeated). Items of one id are one item; a null id counts as an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_name, saved

WINDOW = 10
#: Words of the key under which a window is filed; windows of fewer words use all theirs.
KEY_WORDS = 3
#: Windows' text and owners in one broadcast.
BLOCK_BYTES = 32 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else. lower() is the faster way where it can't touch another letter."""
    others = text.rlike(r"[\p{Lu}\p{Lt}\p{IsUppercase}&&[^A-Z]]")
    return F.when((F.octet_length(text) == F.length(text)) | ~others, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def split_words(text: Column) -> Column:
    """The words in order, with an empty string before the first and after the last where the text has other signs there."""
    return F.split(text, _APART)


def n_words(words: Column) -> Column:
    empty = lambda at: (F.element_at(words, at) == "").cast("int")
    n = F.size(words) - empty(1) - F.when(F.size(words) > 1, empty(-1)).otherwise(0)
    return F.when(words.isNull(), 0).otherwise(n).cast("bigint")


def _key(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def windows(benchmark: DataFrame, n: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: words, the sorted ids of their items as strings, and the key with its place in the window."""
    words = F.filter(split_words(lowered(F.col("t"))), lambda x: x != "")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("t"))
    items = items.select("item", words.alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
    cut = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), n).alias("win"))
    distinct = cut.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))
    k = F.least(F.size("win"), F.lit(KEY_WORDS))
    places = distinct.select("win", "items", k.alias("k"), F.explode(F.sequence(F.lit(0), F.size("win") - k)).alias("o"))
    at = lambda i: F.when(F.col("k") > i, F.get("win", F.col("o") + i))  # noqa: E731  null where the window is shorter: left out of the hash
    keyed = places.withColumn("key", _key([at(i) for i in range(KEY_WORDS)]))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    best = keyed.join(counts, "key").groupBy("win").agg(F.min(F.struct("n", "key", "o")).alias("b"), F.first("items").alias("items"), F.first("k").alias("k"))
    return best.select("win", "items", "k", F.size("win").alias("len"), F.col("b.key").alias("key"), F.col("b.o").alias("o"))


def _rows(docs: DataFrame, block: DataFrame, key_lengths: list[int]) -> DataFrame:
    """One row for each document (start null), and one for each occurrence of a window. docs: rid, carried, words, n_words.

    The path up to the filter is one codegen stage: words aren't copied for each of them.
    """
    x = docs.select("*", F.posexplode_outer("words").alias("p", "x"))
    near = lambda k: _key(["x", *(F.get("words", F.col("p") + i) for i in range(1, k))])
    if len(key_lengths) == 1:
        x = x.withColumn("key", near(key_lengths[0]))
    else:
        x = x.withColumn("key", F.explode(F.array(*map(near, key_lengths))))
    met = x.join(F.broadcast(block), "key", "left")
    same = F.when(F.col("p") >= F.col("o"), F.slice("words", F.greatest(F.col("p") - F.col("o"), F.lit(0)) + 1, F.col("len")) == F.col("win"))
    hit = F.coalesce(same, F.lit(False))
    kept = met.where(hit | F.col("p").isNull() | (F.col("p") == 0))
    first = (F.get("words", F.lit(0)) == "").cast("int")  # the empty string before the first word is none
    return kept.select("rid", "carried", "n_words", F.when(hit, F.col("p") - F.col("o") - first).alias("start"), F.when(hit, F.col("len")).alias("len"), F.when(hit, F.col("items")).alias("items"))


def _blocks(benchmark: DataFrame, n: int, item_col: str, text_col: str, block_bytes: int) -> tuple[list[DataFrame], list[int]]:
    """Windows in blocks of a checked size, and the lengths of their keys."""
    table = saved(windows(benchmark, n, item_col, text_col), "windows")
    held = F.sum(F.lit(64) + F.octet_length(F.array_join("win", " ")) + F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + 16 + F.octet_length(x)))
    size, lengths = table.agg(held, F.array_sort(F.collect_set("k"))).first()
    if not size:
        return [], []
    n_blocks = -(-size // block_bytes)
    if n_blocks == 1:
        return [table], list(lengths)
    return [table.where(F.pmod(F.xxhash64("win"), F.lit(n_blocks)) == k) for k in range(n_blocks)], list(lengths)


def _occurrences(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, carry: list[str], item_col: str, item_text_col: str, block_bytes: int, rid: str | None = None) -> DataFrame:
    """rid, carried, n_words, start, len, items and end: how far earlier windows of the document reach."""
    blocks, lengths = _blocks(benchmark, n, item_col, item_text_col, block_bytes)
    base = docs.select((F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), F.struct(*(F.col(c) for c in carry)).alias("carried"), F.col(text_col).alias("t"))
    if len(blocks) > 1 and rid is None:
        base = saved(base, "numbered")  # every scan has to see the same numbers
    split = base.select("rid", "carried", split_words(lowered(F.col("t"))).alias("words"))
    split = split.select("rid", "carried", n_words(F.col("words")).alias("n_words"), "words")
    none = split.select("rid", "carried", "n_words", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("items"))
    rows = None
    for block in blocks:
        part = _rows(split, block.drop("k"), lengths)
        rows = part if rows is None else rows.unionByName(part)
    w = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return (none if rows is None else rows).withColumn("end", F.max(F.col("start") + F.col("len")).over(w))


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", carry: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: row (a struct of the columns carry, by default doc_id), n_words, n_hit and the sorted ids of the
    items of which a window occurs."""
    rows = _occurrences(docs, benchmark, n, text_col, carry or ["doc_id"], item_col, item_text_col, block_bytes)
    new = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", F.coalesce("end", "start")))
    found = rows.groupBy("rid").agg(F.first("carried").alias("row"), F.max("n_words").alias("n_words"), F.coalesce(F.sum(new), F.lit(0)).cast("bigint").alias("n_hit"), F.collect_set("items").alias("lists"))
    return found.select("row", "n_words", "n_hit", F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"))


def remove(docs: DataFrame, benchmark: DataFrame, whole: bool = False, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without what occurs in the benchmark, with all their columns: whole documents go, or the hit words and what
    stands between them. Texts without a hit stay as they are, null too."""
    rid = free_name(docs, "rid")
    numbered = saved(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    rows = _occurrences(numbered, benchmark, n, text_col, [rid], item_col, item_text_col, block_bytes, rid).where("start is not null")
    if whole:
        return numbered.join(rows.select(F.col("rid").alias(rid)).distinct(), rid, "left_anti").drop(rid)
    w = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("run", F.sum((F.col("start") > F.coalesce("end", F.lit(-1))).cast("int")).over(w))
    runs = runs.groupBy("rid", "run").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("len")).alias("z"))
    spans_, text, cut = free_name(docs, "spans"), F.col(text_col), free_name(docs, "cut")
    spans = runs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias(spans_)).withColumnRenamed("rid", rid)
    # text = apart[0] word[0] apart[1] word[1] ... apart[k]
    apart, words = F.split(text, _WORD), F.filter(F.split(text, _APART), lambda x: x != "")
    tokens = F.zip_with(F.slice(apart, 1, F.size(words)), words, lambda s, x: F.concat(s, x))
    pieces = F.transform(spans_, lambda x, i: F.struct(F.when(i > 0, F.get(F.col(spans_), i - 1)["z"]).otherwise(0).alias("after"), x["a"].alias("a")))
    before = lambda c: F.array_join(F.transform(pieces, lambda x: F.concat(F.array_join(F.slice(c["tokens"], x["after"] + 1, x["a"] - x["after"]), ""), F.get(c["apart"], x["a"]))), "")
    last = F.element_at(F.col(spans_), -1)["z"]
    rest = lambda c: F.concat(F.array_join(F.slice(c["tokens"], last + 1, F.size(c["tokens"])), ""), F.element_at(c["apart"], -1))
    joined = numbered.join(spans, rid, "left").withColumn(cut, F.when(F.col(spans_).isNotNull(), F.struct(tokens.alias("tokens"), apart.alias("apart"))))
    new = F.when(F.col(spans_).isNull(), text).otherwise(F.concat(before(F.col(cut)), rest(F.col(cut))))
    return joined.withColumn(text_col, new).select(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    """n_items, items_sha256 and contaminated in place of items."""
    return found.select("row", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
