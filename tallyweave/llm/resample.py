"""Importance resampling towards a target: documents weighed by hashed n-grams, and an exact draw without replacement.

Features are all runs of 1 to n consecutive words, repeats counted; a feature's bucket is its crc32 modulo the number of
buckets. One pass over all documents and all target texts counts buckets (a sum for each task, then one for each bucket), a
second one looks every feature's gain up in an array. A document's score is its weight and a Gumbel draw from its id, so the k
highest scores are a sample without replacement.

The k-th key of (score, id) is found by radix selection: the counts of one digit's values, of the rows that agree in all
digits before, tell the next digit. What reaches the driver is at most 2**DIGIT_BITS counts a step. Only rows up to that
key are then sorted, by ranges, and numbered.

A null or empty text has no words and no features, and weight 0. A null id hashes as an empty one and sorts last. Rows of one
id and score are told apart by their number of features, then by their place in the scored table. Other columns of the documents
aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.places import with_place
from .shared import bounded_batches, saved

BUCKETS = 10_000
MAX_RUN = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = "7:"
SMOOTH = BUCKETS  # added to the totals, as 1 is to each bucket
DIGIT_BITS = 12
PIECE = 1 << 20  # bytes of a text whose words are held at a time

#: bytes of words as they are, A-Z in lower case, all else a space
_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_in_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, a piece of the text at a time."""
    text = raw.translate(_WORDS)
    at = 0
    while at < len(text):
        to = text.find(b" ", at + PIECE)
        to = len(text) if to < 0 else to
        words = text[at:to].split()
        if words:
            yield words
        at = to


def feature_hashes(raw: bytes, n: int = MAX_RUN) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text: the number of their words, and the crc32 of every run of up to n words that ends in them."""
    before: list[list[int]] = [[] for _ in range(n)]  # before[k]: the hash of the last run of k + 1 words, if any
    for words in words_in_pieces(raw):
        hashes = list(map(zlib.crc32, words))
        out = [hashes]
        spaced = [b" " + w for w in words]
        shorter = before[0] + hashes
        before[0] = hashes[-1:]
        for k in range(1, n):  # a run of k + 1 words goes on where the run before its last word ended
            ends = spaced[len(spaced) - len(shorter) + 1 :] if len(shorter) <= len(spaced) else spaced
            longer = list(map(zlib.crc32, ends, shorter))
            out.append(longer)
            shorter = before[k] + longer
            before[k] = longer[-1:] or before[k]
        yield len(words), np.array([h for runs in out for h in runs], "u4")


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, n: int = MAX_RUN) -> DataFrame:
    """bucket, n: occurrences over all texts. Each task sends a bucket once."""

    def count(batches):
        total = np.zeros(buckets, "i8")
        for batch in batches:
            for raw in _raw(batch.column(0)):
                for _, hashes in feature_hashes(raw or b"", n):
                    total += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(total[used])], ["bucket", "n"])

    parts = bounded_batches(docs.select(text_col)).mapInArrow(count, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass
class Gains:
    """What one occurrence of a bucket's feature speaks for the target, in thousandths."""

    values: np.ndarray
    n: int


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, n: int = MAX_RUN) -> Gains:
    """Both sides counted whole; one count for each bucket and side reaches the driver."""
    own, other = np.zeros(buckets, object), np.zeros(buckets, object)
    for side, df, c in ((own, docs, text_col), (other, target, target_text_col)):
        for bucket, count in bucket_counts(df, c, buckets, n).collect():
            side[bucket] = count
    s_all, t_all = float(own.sum() + buckets), float(other.sum() + buckets)
    return Gains(np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(own, other)], "i8"), n)


def weigh(docs: DataFrame, model: Gains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features and weight: the floored mean gain of all features."""

    def score(batches):
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for raw in _raw(batch.column(1)):
                words = features = total = 0
                for k, hashes in feature_hashes(raw or b"", model.n):
                    words, features = words + k, features + len(hashes)
                    total += int(model.values[hashes % np.uint32(len(model.values))].sum())
                n_words.append(words)
                n_features.append(features)
                weights.append(total // features if features else 0)
            numbers = [pa.array(x, pa.int64()) for x in (n_words, n_features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    return bounded_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(score, schema)


def gumbel(id_col: Column, seed: str = SEED) -> Column:
    """A draw from the id alone, in thousandths."""
    text = F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def up_to_kth(rows: DataFrame, keys: list[str], k: int) -> Column:
    """The condition that holds for the k smallest rows by keys (long, not null, together unique): radix selection.

    Digits come from the highest in which rows differ. The search ends where all rows with the digits found are needed.
    """
    if k <= 0:
        return F.lit(False)
    sign = F.lit(-(1 << 63)).cast("bigint")
    ends = rows.agg(F.count("*"), *(f(c) for c in keys for f in (F.min, F.max))).first()
    if k >= ends[0]:
        return F.lit(True)
    same, found, left = F.lit(True), [], k

    def smaller(values: list[int]) -> Column:
        """keys up to values, in order; the last one included."""
        out = F.col(keys[len(values) - 1]) <= values[-1]
        for c, v in reversed(list(zip(keys, values[:-1]))):
            out = (F.col(c) < v) | ((F.col(c) == v) & out)
        return out

    for i, c in enumerate(keys):
        low, high = (int(x) + (1 << 63) for x in ends[1 + 2 * i : 3 + 2 * i])
        bits = (low ^ high).bit_length()
        prefix = low >> bits
        while bits:
            step = min(DIGIT_BITS, bits)
            bits -= step
            digit = F.shiftrightunsigned(F.col(c).bitwiseXOR(sign), bits).bitwiseAND((1 << step) - 1)
            counts = sorted(tuple(r) for r in rows.where(same).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
            for value, n in counts:
                if left <= n:
                    break
                left -= n
            prefix = prefix << step | value
            first, last = (prefix << bits) - (1 << 63), ((prefix + 1) << bits) - 1 - (1 << 63)
            if left == n:  # all of them
                return smaller([*found, last])
            # what is pushed down to the scan: bounds of the column, and equal columns before
            here = F.col(c).between(first, last)
            for d, v in zip(keys, found):
                here = here & (F.col(d) == v)
            same = here
        found.append(int(prefix) - (1 << 63))
        same = F.lit(True)
        for d, v in zip(keys, found):
            same = same & (F.col(d) == v)
    return smaller(found)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, n: int = MAX_RUN) -> DataFrame:
    """Every document's id, n_features, weight, score and rank, all long: 1, 2, 3 ... of those that are drawn, else null.

    Of the documents with at least least_words words, percent of a hundred (rounded down) are drawn. Ids are whole numbers.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of whole numbers")
    model = gains(docs, target, text_col, target_text_col, buckets, n)
    scored = weigh(docs, model, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    order = {"backwards": -F.col("score"), "no_id": F.col("id").isNull().cast("bigint"), "id_key": F.coalesce(F.col("id").cast("bigint"), F.lit(0)), "row": F.monotonically_increasing_id()}
    scored = saved(scored.withColumns(order), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    keys = ["backwards", "no_id", "id_key", "n_features", "row"]
    drawn = up_to_kth(able, keys, percent * able.count() // 100)
    out = [F.col("id").cast("bigint").alias(id_col), "n_features", "weight", "score"]
    ranked = with_place(able.where(drawn), [], [F.col(c) for c in keys], "rank").select(*out, "rank")
    rest = scored.where((F.col("n_words") < least_words) | ~drawn).select(*out, F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(rest)
