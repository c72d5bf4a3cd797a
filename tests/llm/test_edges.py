"""Columns of clashing names, ids of other types, texts of any length, memory that doesn't grow, however rows are dealt."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import chat_format, exact_dedup, lang_id, ngram_join, packing, pivot_dedup, secret_scan, shared, sp_scan, suffix_dedup, toxicity
from test_operators import DOCS, plain_components, plain_removal, plain_sets, prose

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def glued(r: random.Random, n: int) -> str:
    """A text without white space, as of a script that writes none."""
    return "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))


@pytest.mark.parametrize("make", [lambda: ngram_join.Shingler(3).of, lambda: packing.WordEncoder(WORD_BPE).encode, lambda: sp_scan.PieceModel(PIECES).encode])
def test_memos_keep_no_long_words(make):
    work, r = make(), random.Random(1)
    work(glued(r, 50))
    tracemalloc.start()
    for _ in range(400):
        work(glued(r, 2000))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 1_500_000  # 400 texts of 6 kB each, and their ids, would be over 4 MB


def test_scorer_and_labeller_keep_no_long_words():
    r = random.Random(2)
    scorer = toxicity.Scorer(toxicity.ToxicityModel(np.ones((toxicity.ALPHABET,) * 3, "f4"), {}, 0.0))
    model = lang_id.LanguageModel(["x", "y"], np.zeros((lang_id.BUCKETS, 2), "f4"), np.ones((len(lang_id.SCRIPT_NAMES), 2), bool))
    lab = lang_id.Labeller(model, 1.0)
    for _ in range(60):
        text = glued(r, 100_000)
        scorer.score(text)
        lab.label([text, "short words"])
    assert sum(map(len, scorer.memo)) < 1000 and sum(map(len, lab.index)) <= lang_id.LONG_CHARS + 200_000


def test_more_than_127_languages_and_a_long_text():
    n = 300
    model = lang_id.LanguageModel([f"l{k:03d}" for k in range(n)], np.zeros((lang_id.BUCKETS, n), "f4"), np.ones((len(lang_id.SCRIPT_NAMES), n), bool))
    lab = lang_id.Labeller(model, 1.0)
    lab.learn({"w"})
    lab.scores[0, 250] = 5.0
    labels, letters = lab.label(["w " * 20_000, "w", ""])
    assert [len(x) for x in labels] == [20_000, 1, 0] and all((x == 250).all() for x in labels) and letters[0].sum() == 20_000


def test_gathered_is_bounded_by_bytes():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 10)], ["t"]) for _ in range(50)]
    assert max(b.num_rows for b in shared.gathered(iter(batches), 10**6, 20_000)) <= 30
    assert sum(b.num_rows for b in shared.gathered(iter(batches), 100)) == 500


def test_clashing_names(spark):
    r = random.Random(3)
    rows = [(k, prose(r, 20) + f" password={r.getrandbits(72):018x}", *["x"] * 8) for k in range(30)]
    names = "i__ string, h__ string, k__ string, s__ string, item__ string, toxic_score string, score string, r string"
    docs = spark.createDataFrame(rows, f"{DOCS}, {names}")
    model = secret_scan.fit(docs)
    out = secret_scan.redact(docs, model)
    assert out.columns == docs.columns and out.where(F.col("text").contains(secret_scan.MASK)).count() > 25
    flat = toxicity.ToxicityModel(np.ones((toxicity.ALPHABET,) * 3, "f4"), {}, 0.0)
    assert toxicity.score(docs, flat).where("score = 0.5").count() == 30
    assert exact_dedup.deduplicate(docs).columns == docs.columns
    pieces = docs.select(F.lit(7).cast("int").alias("length"), F.lit("o").alias("offset"), F.lit("b").alias("bin"), F.lit("i").alias("item"), F.lit("n").alias("number"), F.lit("r").alias("row"))
    packed = packing.pack(pieces, capacity=10)
    assert packed.columns == ["length", "bin", "item", "number", "row", "sequence_id", "offset"]
    assert packed.select("sequence_id").distinct().count() == 30 and packed.where("offset = 0").count() == 30
    enc = sp_scan.encode(docs.withColumn("chunk", F.lit("c")).withColumn("ids", F.lit("i")), PIECES)
    again = sp_scan.decode(enc.withColumn("text", F.lit("old")), PIECES)
    assert again.columns.count("text") == 1 and {x["text"] for x in again.collect()} == {x[1] for x in rows}
    model = lang_id.fit(docs.withColumn("lang", F.lit("en")))
    assert lang_id.identify(docs, model).count() == 30


def test_ids_of_other_types(spark):
    r = random.Random(4)
    rows = [(f"id{k:03d}", prose(r, 30)) for k in range(20)]
    rows += [("zz", rows[3][1]), (None, rows[3][1]), ("a-not-a-number", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {x["doc_id"] for x in packing.pack_documents(docs, WORD_BPE).collect()} == {i for i, _ in rows}
    found = {x["row"]["doc_id"]: x["keep_id"] for x in exact_dedup.exact_dedup(docs).collect()}
    assert found["zz"] == found["id003"] == found[None] == "id003"
    low = {x["doc_id"]: x["component_id"] for x in ngram_join.similar_components(docs).collect()}
    assert low["zz"] == "id003" and low["id004"] == "id004" and low[None] is None
    vecs = spark.createDataFrame([("b", [1.0, 2.0], "l"), ("a", [2.0, 4.0], "l"), ("c", [1.0, -2.0], "l")], "vec_id string, embedding array<float>, label string")
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in pivot_dedup.near_duplicates(vecs).collect()} == {"a": (1, "a"), "b": (1, "a"), "c": (0, "c")}
    turns = spark.createDataFrame([("x", 0, "user", "hi", 1), ("y", 0, "assistant", "ho", 2)], "conv_id string, turn int, role string, text string, seq int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert {x["conv_id"]: x["loss_chars"] for x in chat_format.digests(chat_format.format_turns(turns, path), path).collect()} == {"x": 0, "y": 2}


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_of_runs_too_long_to_hold(spark, monkeypatch, keep):
    """Runs cut into parts, over several partitions, with repeated and null ids."""
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 7)
    r = random.Random(5)
    rows = [(r.choice([*range(300), 17, 17, None]), r.choice(["hot", "hot", "warm", None, "", prose(r, 2)])) for _ in range(900)] + [(1000 + k % 2, "pair" * 9) for k in range(40)]
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    pick = min if keep == "min" else max
    for parts in (1, 9):
        got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), keep=keep, partitions=parts).collect()
        assert len(got) == len(rows)
        for t, ids in groups.items():
            mine = [g for g in got if (g["row"]["text"] or "") == t]
            best = pick((i for i in ids if i is not None), default=None)
            assert {(g["keep_id"], g["group_size"]) for g in mine} == {(best, len(ids))}
            assert [g["row"]["doc_id"] for g in mine if g["kept"]] == [best]


def test_light_sets_meet_on_subsets(spark):
    """Short texts: the boundary by cost is where subsets still say something, and these alone find the links."""
    r = random.Random(6)
    rows = []
    for k in range(400):
        words = prose(r, r.randint(9, 13)).split()
        rows.append((k, " ".join(words)))
        if k % 4 == 0:
            rows.append((1000 + k, " ".join(words[:-1])))
    sets = plain_sets(rows, 5)
    sizes: dict = {}
    for s in sets:
        sizes[len(s)] = sizes.get(len(s), 0) + 1
    light = ngram_join.boundary(sizes, 3.0, 4, 5)
    assert light >= max(sizes) and ngram_join.least_partner(light, 4, 5) < light
    links = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(links) >= 80
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == plain_components([i for i, _ in rows], links)
    # the subsets of two linked light sets have one in common; those of sets that don't link prove nothing false
    keys = [set(zip(*(x.tolist() for x in ngram_join.subset_keys(ngram_join.Shingler(5).of(t), 4, 5)))) for _, t in rows]
    index = {i: k for k, (i, _) in enumerate(rows)}
    assert all(keys[index[a]] & keys[index[b]] for a, b in links)


def test_rows_with_many_roles_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROLES", 3)
    monkeypatch.setattr(ngram_join, "SETS_BYTES", 2000)
    r = random.Random(7)
    base = prose(r, 80).split()
    rows = []
    for k in range(60):
        words = list(base)
        words[r.randrange(80)] = f"w{k}"
        rows.append((k, " ".join(words)))
    got = {x["component_id"] for x in ngram_join.similar_components(spark.createDataFrame(rows, DOCS)).collect()}
    sets = plain_sets(rows, 5)
    links = [(a, b) for a in range(60) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert got == set(plain_components(range(60), links).values())


def test_permutations_keep_order_and_counts():
    r = np.random.default_rng(8)
    x, pivots = r.normal(size=(40, 8)), r.normal(size=(30, 8))
    perm = pivot_dedup.permutations(x, pivots, 5)
    assert (perm == np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :5]).all()
    keys = pivot_dedup.lists_of(perm)
    for a in range(40):
        for b in range(40):
            both = sorted(set(perm[a]) & set(perm[b]))
            place = lambda p, q: list(q).index(p) if p in q else 5
            foot = sum(abs(place(p, perm[a]) - place(p, perm[b])) for p in set(perm[a]) | set(perm[b]))
            hits = [k for k in set(keys[a]) & set(keys[b]) if pivot_dedup.shared_points(perm[a : a + 1], perm[b : b + 1], k)[0, 0]]
            assert hits == ([both[0]] if len(both) >= 2 and foot <= pivot_dedup.FAR else [])


def test_recall_against_brute_force_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(x["vec_id"], x["label"], np.asarray(x["embedding"], "f8")) for x in table.collect() if x["label"] is not None and x["embedding"] is not None and None not in x["embedding"]]
    rows = [x for x in rows if np.isfinite(x[2]).all() and x[2].any()]
    v = np.stack([x[2] / np.linalg.norm(x[2]) for x in rows])
    same = np.asarray([x[1] for x in rows])
    want = ((v @ v.T >= 0.98) & (same[:, None] == same[None])).sum() - len(rows)
    got = pivot_dedup.near_duplicates(table).agg(F.sum("n_links")).first()[0]
    assert 0.99 * want <= got <= want


def test_cover_and_names():
    """Two equal windows at any residues have a sampled start in common; packed names come back."""
    n = suffix_dedup.PERIOD
    for a in range(n):
        for b in range(n):
            assert any((a + d) % n in suffix_dedup.COVER and (b + d) % n in suffix_dedup.COVER for d in range(n))
    r = np.random.default_rng(9)
    for size, top in ((0, 1), (1, 1 << 40), (5, 1 << 40), (100_000, 1 << 40), (3, 1 << 20)):
        x = np.unique(r.integers(0, top, size).astype("u8")) << np.uint64(24)
        assert (suffix_dedup._unpack(suffix_dedup._pack(x)) == x).all() or not len(x)


def test_batches_grow_with_the_root_of_the_text():
    size = suffix_dedup.BATCH_BYTES
    assert [suffix_dedup.batches_for(k) for k in (0, 1, size, size + 1, 10 * size)] == [1, 1, 1, 2, 10]
    for total in (10**12, 10**14, 10**16):  # neither batches nor rows between them run away
        n = suffix_dedup.batches_for(total)
        assert 0.99 < n / (suffix_dedup.batches_for(4 * total) / 2) < 1.01
        assert total * 4 / 13 / n**2 > 10  # names in a row


def test_repeats_by_ids_of_text(spark):
    r = random.Random(11)
    passage = prose(r, 20)
    rows = [(f"k{r.randrange(10**6):06d}", " ".join(r.choice([passage, prose(r, 5)]) for _ in range(r.randint(0, 4)))) for _ in range(60)] + [("", passage)]
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suffix_dedup.remove_repeats(spark.createDataFrame([(*x, 1) for x in rows], "doc_id string, text string, n_removed int")).collect()]
    assert sorted(got) == sorted(plain_removal(rows))


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = spark.conf, Context()

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            shared.scratch_dir(Session())
    table = shared.saved(spark.range(3), "three")
    assert table.count() == 3 and shared.drop_saved(spark) >= 1 and shared.drop_saved(spark) == 0


@pytest.mark.parametrize("before", ["", "path/", "a" * 70 + "/", "www.site.org/" + "key=" * 40])
def test_parts_of_a_token_are_joined_and_cut_whatever_its_length(before):
    """The tail of a token is read alike after any other parts."""
    said = toxicity.restored(before + "st--upid", toxicity.Decoder(np.zeros((toxicity.ALPHABET,) * 3, "f4")))
    assert {"stupid", "upid"} <= set(said)
