"""Clustering, decontamination and resampling against plain versions, with the edges of their inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, resample, yinyang

# clustering ------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale=64, seed="1:"):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(scale * x) < 1 << 27 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for at in range(rounds + 1):
        found = [(i, v, *near(v)) for i, v in kept]
        for j in range(len(centres) if at < rounds else 0):
            own = [v for _, v, _, c in found if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i is None, i or 0), v, c, d) for i, v, d, c in found), centres


@pytest.mark.parametrize("kind", ["ties", "groups", "far"])
def test_clusters_equal_a_plain_scan(spark, kind):
    r = np.random.default_rng(5)
    if kind == "ties":  # few values: many equal distances
        data = r.integers(-1, 2, (300, 4)) / 64
    elif kind == "groups":
        data = np.concatenate([r.normal(m, 0.05, (120, 4)) for m in (-1, 0, 1)])
    else:
        data = r.normal(0, 10_000, (200, 4)) * r.choice([1, 100], (200, 1))
    rows = [(k % 250, [float(x) for x in v]) for k, v in enumerate(data)]
    rows += [(900, None), (901, [1.0, 2.0, 3.0]), (902, [1.0, None, 1.0, 1.0]), (903, [math.nan, 0.0, 0.0, 0.0]), (904, [math.inf, 0.0, 0.0, 0.0]), (905, [3e30, 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5]), (906, [])]
    df = spark.createDataFrame([(i, v, "x", 1.5, 7) for i, v in rows], "vec_id bigint, embedding array<double>, v string, distance double, cluster int").repartition(3)
    for k, rounds, groups in ((16, 3, None), (7, 5, 2), (5, 2, 1), (16, 0, 4)):
        got, centres = yinyang.cluster(df, k, rounds, groups, dimensions=4)
        want, plain = plain_clusters(rows, k, rounds, 4)
        assert centres.tolist() == plain
        assert sorted(((x.id is None, x.id or 0), x.v, x.cluster, x.distance) for x in got.collect()) == want


def test_bounds_spare_distances(spark):
    r = np.random.default_rng(1)
    middles = r.normal(0, 3, (16, 64))
    data = middles[r.integers(0, 16, 2000)] + r.normal(0, 0.1, (2000, 64))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(data)], "vec_id bigint, embedding array<float>")
    got, _ = yinyang.cluster(df, 16, 6)
    assert got.agg(F.avg("scanned")).first()[0] < 8  # of 16


def test_inertia_and_few_vectors(spark):
    rows = [(3, [1.0] * 64), (3, [1.0] * 64), (None, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in yinyang.with_inertia(*yinyang.cluster(df)).select("id", "distance", "cluster_inertia", "inertia").collect()]
    assert sorted(got, key=str) == sorted([(3, 0, 0, 0), (3, 0, 0, 0), (None, 0, 0, 0)], key=str)
    assert yinyang.with_inertia(*yinyang.cluster(df.limit(0))).count() == 0


# decontamination -------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOWN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_hits(texts, items, n=10):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(DOWN))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        found = [m for m in WORD.finditer(text or "")]
        w = [m.group().translate(DOWN) for m in found]
        hit, owners = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    owners |= own
                    hit[k : k + size] = [True] * size
        kept, after = "", 0
        for k, m in enumerate(found):  # what stands between two words of one occurrence run goes with them
            if hit[k]:
                kept += text[after : m.start()] if not (k and hit[k - 1]) else ""
                after = m.end()
        out.append((len(w), sum(hit), sorted(owners), kept + (text or "")[after:] if sum(hit) else text))
    return out


def made(seed):
    r = random.Random(seed)
    voc = ["the", "cat", "Été", "été", "sat", "7", "ON", "mat", "дом", "x9", "KELVIN", "ΣΑΣ"]
    text = lambda n: "".join(r.choice(voc) + r.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    items = [(k, text(r.choice([1, 2, 3, 8, 10, 11, 30]))) for k in range(12)] + [(3, text(12)), (None, text(11)), (77, None), (78, ""), (79, "?!")]
    texts = [text(r.choice([0, 1, 5, 40, 200])) for _ in range(40)]
    for _ in range(30):
        texts.append(text(r.randrange(4)) + "(" + r.choice(items[:14])[1] + ") " + text(r.randrange(30)))
    return texts + [None, "", "...", texts[-1], texts[-1], text(20_000) + items[6][1]], items


@pytest.mark.parametrize("seed,least,block", [(1, 0, 1 << 20), (2, 0, 300), (3, 10, 1 << 20), (4, 3, 500)])
def test_decontamination(spark, seed, least, block):
    texts, items = made(seed)
    items = [(i, t) for i, t in items if len(WORD.findall(t or "")) >= least]
    docs = spark.createDataFrame([(k % 60 or None, t, "a", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, words string, rid int").repartition(5)
    bench = spark.createDataFrame([(i, t, "b") for i, t in items], "item_id bigint, text string, win string")
    got = decontaminate.find(docs, bench, carry=["doc_id", "text"], block_bytes=block)
    want = plain_hits(texts, items)
    key = lambda rows: sorted(map(repr, rows))
    assert key((r.row.text, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == key((t, *x[:3]) for t, x in zip(texts, want))
    spans = decontaminate.remove(docs, bench, block_bytes=block)
    assert spans.columns == docs.columns and key(r.text for r in spans.collect()) == key(x[3] for x in want)
    assert key(r.text for r in decontaminate.remove(docs, bench, whole=True, block_bytes=block).collect()) == key(t for t, x in zip(texts, want) if not x[1])


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = sorted(tuple(r) for r in decontaminate.digests(decontaminate.find(docs, none)).select("row.doc_id", "n_words", "n_hit", "n_items", "contaminated").collect())
    assert got == [(1, 3, 0, 0, False), (2, 0, 0, 0, False)]
    assert decontaminate.find(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert sorted(map(repr, decontaminate.remove(docs, none).collect())) == sorted(map(repr, docs.collect()))


# resampling ------------------------------------------------------------------------------------------------------------


def plain_features(text, n):
    w = [x.encode() for x in WORD.findall((text or "").translate(DOWN))]
    return w, [b" ".join(w[k : k + m]) for m in range(1, n + 1) for k in range(len(w) - m + 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("piece", [1, 7, 40, 1 << 20])
def test_features_of_pieces(monkeypatch, n, piece):
    monkeypatch.setattr(resample, "PIECE", piece)
    r = random.Random(n)
    for _ in range(30):
        text = "".join(r.choice(["a", "Bé", "c7", " ", ". ", "дом", "\n"]) for _ in range(r.randrange(60)))
        got = list(resample.feature_hashes(text.encode(), n))
        w, f = plain_features(text, n)
        assert sum(k for k, _ in got) == len(w) and sorted(int(h) for _, x in got for h in x) == sorted(map(zlib.crc32, f))


@pytest.mark.parametrize("case", range(6))
def test_radix_selection(spark, case):
    r = random.Random(case)
    value = [lambda: r.randrange(-5, 5), lambda: r.choice([-(1 << 63), (1 << 63) - 1, 0, 1]), lambda: r.randrange(1 << 40), lambda: 3, lambda: r.choice([7] * 300 + [8, -9]), lambda: r.randrange(-(1 << 62), 1 << 62)][case]
    rows = [(value(), r.randrange(1000), k) for k in range(400)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    for k in (0, 1, 17, 399, 400, 500):
        got = sorted(tuple(x) for x in df.where(resample.up_to_kth(df, ["a", "b", "c"], k)).collect())
        assert got == sorted(rows)[:k]


def plain_resample(rows, target, percent, least, buckets):
    own, other = np.zeros(buckets), np.zeros(buckets)
    feats = [plain_features(t, 2) for _, t in rows]
    for _, f in feats:
        for x in f:
            own[zlib.crc32(x) % buckets] += 1
    for t in target:
        for x in plain_features(t, 2)[1]:
            other[zlib.crc32(x) % buckets] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (own.sum() + buckets) / ((s + 1) * (other.sum() + buckets)))) for s, t in zip(own, other)]
    out = []
    for (i, _), (w, f) in zip(rows, feats):
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted(repr(tuple(x[:5])) for x in out)


@pytest.mark.parametrize("percent,least", [(25, 20), (100, 0), (0, 0), (60, 5)])
def test_resample(spark, percent, least):
    texts, items = made(9)
    rows = [(None if k == 5 else k - 20 if k % 9 else k % 2, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, row int, score int").repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = resample.resample(docs, bench, percent, least, buckets=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    # rows that are alike but for their place may swap ranks
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_resample(rows, [t for _, t in items], percent, least, 50)


def test_resample_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert {(r.doc_id, r.n_features, r.weight, r["rank"]) for r in resample.resample(docs, docs).collect()} == {(1, 0, 0, None), (2, 0, 0, None)}
    assert resample.resample(docs.limit(0), docs).count() == 0
    with pytest.raises(TypeError):
        resample.resample(docs.select(F.col("doc_id").cast("string"), "text"), docs)
