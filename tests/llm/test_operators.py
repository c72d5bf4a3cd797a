"""Each operator against plain versions, and nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import chat_format, exact_dedup, lang_id, ngram_join, packing, pivot_dedup, secret_scan, shared, sp_scan, suffix_dedup, toxicity

DOCS = "doc_id bigint, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing", "ed"]) for _ in range(n))


def plain_components(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


# shared ---------------------------------------------------------------------------------------------------------


def test_components_of_paths_and_rings(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(k, (k + 1) % 20) for k in range(20)] + [(200 + r.randrange(60), 200 + r.randrange(60)) for _ in range(40)]
    got = {x["node"]: x["component"] for x in shared.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = plain_components({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    assert shared.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# exact dedup ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, keep):
    long = "x" * 300_000
    rows = [(1, "a", 5), (2, "a", 6), (3, None, 7), (4, "", 8), (5, long, 9), (6, long, 9), (7, "a ", 1), (2, "a", 6), (None, "a", 3), (None, "only null ids", 4), (8, "A", None)]
    rows += [(k, "hot", k) for k in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept int").repartition(5)
    got = exact_dedup.exact_dedup(df, keep=keep).collect()
    assert len(got) == len(rows)
    groups: dict = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    pick = min if keep == "min" else max
    kept_of: dict = {}
    for g in got:
        t = g["row"]["text"] or ""
        ids = [i for i in groups[t] if i is not None]
        assert g["keep_id"] == (pick(ids) if ids else None)
        assert g["group_size"] == len(groups[t])
        assert g["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        kept_of.setdefault(t, []).append((g["kept"], g["row"]["doc_id"]))
    for t, found in kept_of.items():
        assert [i for k, i in found if k] == [next(g["keep_id"] for g in got if (g["row"]["text"] or "") == t)]
    left = exact_dedup.deduplicate(df, keep=keep)
    assert left.columns == df.columns and left.count() == len(groups)
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_exact_dedup_over_partition_borders(spark):
    r = random.Random(5)
    rows = [(k, r.choice(["same", "other", prose(r, 3)])) for k in range(500)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), partitions=37).collect()
    size = {}
    for _, t in rows:
        size[t] = size.get(t, 0) + 1
    assert all(x["group_size"] == size[x["row"]["text"]] for x in found)
    assert sum(x["kept"] for x in found) == len(size)


# packing --------------------------------------------------------------------------------------------------------


def test_word_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["", "  ", "It's DON'T stop-it!! über Straße, naïve", "a<|endoftext|>b <|startoftext|> c", "x y\x0bz \x1c q", "é İstanbul ΣΑΣ", "12,345.67 $$$ a.b.c", "日本 語\tтест\r\nok", "Ñandú***\n\n'tis", "q" * 5000]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    r = random.Random(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(k, prose(r, r.randint(0, 400))) for k in range(200)] + [(900, prose(r, 9000)), (901, None), (902, ""), (901, None), (None, "null id")]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), path).collect()
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, want)) == sorted(key((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"])) for x in got)
    by: dict = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(x["length"] for x in got)
    assert len(by) <= 1.05 * total / 4096 + 2
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).count() == 0


def test_rounds_of_packing_keep_every_piece(spark):
    r = random.Random(2)
    pieces = spark.createDataFrame([(k, r.randint(1, 100)) for k in range(3000)], "k int, length bigint")
    got = packing.pack(pieces, capacity=100, open_bins=4, items_per_partition=50).collect()
    assert sorted(x["k"] for x in got) == list(range(3000))
    by: dict = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 100


def test_best_fit_closes_the_fullest():
    placed, fill, still = packing.best_fit([60, 50, 70, 30], 100, 2)
    assert placed == [(0, 0), (1, 0), (2, 0), (2, 70)] and fill == [60, 50, 100] and still == {1}


# chat -----------------------------------------------------------------------------------------------------------

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_chat_round_trip(spark):
    hard = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, None, "#" * 7), (1, 3, "assistant", None), (2, 0, "tool: x</turn>", "é\\\n"), (None, 0, "assistant", "<|endoftext|>"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, "system", "c"), (4, 0, "user", "y" * 50_000)]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, seq int")
    turns = chat_format.format_turns(df, BYTE_BPE)
    got = {x["conv_id"]: x for x in chat_format.digests(turns, BYTE_BPE).collect()}
    none = (float("-inf"), "", "")
    convs: dict = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((none[0] if t is None else t, role or "", text or ""))
    for c, said in convs.items():
        said.sort()
        assert got[c]["n_turns"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
        loss = "".join(t for _, r, t in said if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(got) == set(convs)
    for x in turns.collect():
        ids = np.asarray(x["token_ids"])
        assert (ids >= chat_format.HEADERS["system"]).sum() == (3 if (x["role"] or "") not in chat_format.HEADERS else 2)
    assert chat_format.digests(chat_format.format_turns(df.limit(0), BYTE_BPE), BYTE_BPE).count() == 0


def test_escape_is_reversible():
    r = random.Random(4)
    for _ in range(500):
        t = "".join(r.choice(["\\", "#", "###", "</turn>", "<", "a", "\n", "### User: "]) for _ in range(r.randint(0, 12)))
        assert chat_format.unescape(chat_format.escape(t)) == t


# n-gram join ----------------------------------------------------------------------------------------------------


def plain_sets(rows, n):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    return out


@pytest.mark.parametrize(("n", "threshold"), [(3, (9, 10)), (5, (4, 5)), (1, (7, 10))])
def test_ngram_join(spark, n, threshold):
    r = random.Random(n)
    rows = []
    for k in range(140):
        if rows and r.random() < 0.6:
            words = (r.choice(rows)[1] or "").split()
            for _ in range(r.randint(0, 2)):
                if words:
                    words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((k, " ".join(words)))
        else:
            rows.append((k, prose(r, r.choice([0, 1, 2, 3, 8, 15, 30, 60, 150]))))
    rows += [(500, None), (501, ""), (502, "One  two\x0bthree"), (503, "one two three"), (504, "Ärger ärger"), (505, "ärger ärger")]
    num, den = threshold
    sets = plain_sets(rows, n)
    links = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = plain_components([i for i, _ in rows], links)
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id bigint, text string, component_id string, fp int")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.similar_components(df, n=n, threshold=threshold).collect()}
    assert got == {i: (len(s), want[i]) for (i, _), s in zip(rows, sets)}


def test_ngram_join_long_lists_in_blocks(spark, monkeypatch):
    """One common passage in all, families of near copies, lists longer than a block."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    r = random.Random(9)
    passage = prose(r, 40)
    rows = []
    for family in range(6):
        base = prose(r, 60).split()
        for k in range(12):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(WORDS) + str(r.randrange(99))
            rows.append((family * 100 + k, passage + " " + " ".join(words)))
    sets = plain_sets(rows, 3)
    links = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar_components(spark.createDataFrame(rows, DOCS), n=3, threshold=(4, 5)).collect()}
    assert got == plain_components([i for i, _ in rows], links)


def test_ngram_join_edges(spark):
    assert ngram_join.similar_components(spark.createDataFrame([], DOCS)).count() == 0
    got = ngram_join.similar_components(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "other words here now then too"), (1, "a b c d e f")], DOCS)).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0) for x in got) == [(0, 0), (1, 1), (1, 1), (1, 1)]
    kept = ngram_join.keep_one_of_each(spark.createDataFrame([(None, "a b c d e f", "x"), (2, "a b c d e f", "y"), (1, "a b c d e f", "z"), (3, None, "w")], DOCS + ", gone__x string"))
    assert sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 1, 3] and kept.columns == ["doc_id", "text", "gone__x"]


# embeddings -----------------------------------------------------------------------------------------------------


def test_pivot_near_duplicates(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 24))
    rows = []
    for k in range(400):
        v = base[r.integers(60)] + r.normal(size=24) * r.choice([0, 0.02, 0.05, 0.3])
        rows.append((k, [float(x) for x in v.astype("f4")], int(r.integers(3))))
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("nan")] * 24, 1), (503, [None] * 24, 1), (504, rows[0][1], None), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [], 1), (508, [1e300, 1e300], 2), (509, [1e-300, 1e-300], 2)]
    df = spark.createDataFrame([(*x, "n", 0) for x in rows], "vec_id bigint, embedding array<double>, label int, n_links string, node int")
    got = {x["vec_id"]: x for x in pivot_dedup.near_duplicates(df).collect()}
    usable = {i: np.asarray(v) for i, v, lab in rows if v and None not in v and lab is not None and np.isfinite(v).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in usable.items()}
    links = [(a, b) for a in usable for b in usable if b < a and label[a] == label[b] and len(usable[a]) == len(usable[b]) and unit[a] @ unit[b] >= 0.98]
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    found = sum(x["n_links"] for x in got.values())
    assert len(got) == len(rows) and all(got[i]["n_links"] <= count[i] for i in count)
    assert found >= 0.9 * sum(count.values()) > 0
    want = plain_components(list(count), links)
    assert sum(got[i]["component_id"] == want[i] for i in want) >= 0.95 * len(want)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got.values())
    assert pivot_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pivot_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(pivot_dedup, "BLOCK", 7)
    r = np.random.default_rng(2)
    centre = r.normal(size=16)
    rows = [(k, [float(x) for x in centre + r.normal(size=16) * 0.01], 0) for k in range(80)] + [(100 + k, [1.0] * 16, 0) for k in range(5)]
    got = {x["vec_id"]: x for x in pivot_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert all(got[k]["n_links"] == 79 and got[k]["component_id"] == 0 for k in range(80))
    assert all(got[100 + k]["n_links"] == 4 and got[100 + k]["component_id"] == 100 for k in range(5))


# repeated passages ----------------------------------------------------------------------------------------------


def plain_removal(rows, n=50):
    low: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            w = b[k : k + n]
            low[w] = min(low.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if low[b[k : k + n]] < i:
                gone[k : k + n] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("batch", [2_000, 10_000_000])
def test_repeated_passages(spark, monkeypatch, batch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1500)
    r = random.Random(7)
    passages = [prose(r, k) for k in (8, 9, 12, 30, 80)] + ["a" * 130, "ab" * 60, "é" * 40]
    rows = [(-3, passages[3])]
    for k in range(120):
        rows.append((k * 3 % 121, " ".join(r.choice(passages + [prose(r, r.randint(1, 12))] * 3) for _ in range(r.randint(0, 6)))))
    rows += [(300, None), (301, ""), (302, passages[4][:49]), (303, passages[4][:50]), (304, passages[4]), (304, passages[4]), (305, passages[4] * 3)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, spans int, th string")
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(got) == sorted(plain_removal(rows))


def test_repeated_passages_edges(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    t = prose(random.Random(1), 40)
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(None, t), (None, t), (5, t)], DOCS)).collect()
    assert all(x["n_removed"] == 0 for x in got) and len(got) == 3


# toxicity -------------------------------------------------------------------------------------------------------


def test_decoder_restores_disguised_words():
    text = " ".join(["idiot pathetic stupid the weather is fine and this idiot is stupid"] * 200)
    counts = np.zeros((toxicity.ALPHABET,) * 3)
    c = toxicity.classes()[np.frombuffer(f" {text} ".encode("utf-32-le"), "u4")].astype(int)
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    d = toxicity.Decoder(toxicity.language_model(counts))
    for said in ("1d1ot", "id10t", "i.d.i.o.t", "idiooooot", "stup!d", "$tupid", "p@thetic"):
        word = {"$": "stupid", "s": "stupid", "p": "pathetic"}.get(said[0], "idiot")
        assert word in toxicity.restored(said, d), said
    assert "idiot" in toxicity.joined("you i d i o t there", d)
    assert toxicity.restored("weather,", d) == ["weather"]


def test_decoder_takes_long_coded_edged_and_spaced_words():
    text = " ".join(["idiot trash rash clown ass sad the weather is fine and this idiot is trash and sad"] * 200)
    counts = np.zeros((toxicity.ALPHABET,) * 3)
    c = toxicity.classes()[np.frombuffer(f" {text} ".encode("utf-32-le"), "u4")].astype(int)
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    d = toxicity.Decoder(toxicity.language_model(counts))
    long = "https://site.example/" + "weather/" * 20 + "1d1ot/i.d.i.o.t/fine"
    for said, word in (("tr" + "a" * 70 + "sh", "trash"), ("1d107", "idiot"), ("!diot", "idiot"), ("!d!0+", "idiot"), ("+rash", "trash"), ("(lown", "clown"), ("(lown!", "clown"), ("a$$", "ass"), ("a$$!", "ass"), ("@$$", "ass"), (long, "idiot"), ("(weather!)", "weather")):
        assert word in toxicity.restored(said, d), said
    for said, word in (("so s a d today", "sad"), ("you i  d\ti\no t", "idiot")):
        assert word in toxicity.joined(said, d), said
    assert toxicity.restored("2023", d) == [] and toxicity.restored("weather.", d) == ["weather"]
    blob = "".join(random.Random(1).choice("abcdefgh0123456789") for _ in range(3000))
    assert toxicity.restored(blob, d)


def test_toxicity_model(spark):
    r = random.Random(8)
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        words = prose(r, 60).split()
        if toxic:
            words[r.randrange(60)] = r.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(900, None), (901, ""), (902, "you 1d1ot you"), (903, "z" * 200_000), (None, "an idiot")]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, lab, usable=F.col("doc_id") % 2 == 0)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    wrong = sum((got[k] >= 0.7) != bool(y) for k, y in labels if k % 2)
    assert wrong <= 6
    assert got[900] == got[901] < 0.5 and got[902] > 0.7 and got[None] > 0.7
    kept = toxicity.reject_toxic(docs, lab)
    assert kept.columns == ["doc_id", "text"] and 460 <= kept.count() <= 490
    none = toxicity.fit(docs, lab.limit(0))
    assert toxicity.score(docs, none).where("score > 0.01").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


# languages ------------------------------------------------------------------------------------------------------


def test_language_spans(spark):
    r = random.Random(10)
    made = {"aa": "the and of ing tion er th", "bb": "le la que ou eux eau ment", "cc": "дом кот лес мир год"}
    say = lambda lang, n: " ".join("".join(r.choice(made[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(k, say(lang, r.randint(5, 60)), lang) for k, lang in enumerate(r.choice(list(made)) for _ in range(300))]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 34 !!", "bb"), (903, say("aa", 30) + " " + say("bb", 20), None), (904, say("cc", 20), None), (905, "日本語", None), (None, say("bb", 9), "bb")]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = lang_id.fit(docs, usable=F.coalesce(F.col("i") % 3, F.lit(0)) != 0)
    found = lang_id.identify(docs, model)
    got = {x["doc_id"]: x for x in found.collect()}
    assert len(got) == len(rows) and found.columns == ["doc_id", "lang_pred", "score", "spans"]
    assert sum(got[i]["lang_pred"] != lang for i, _, lang in rows[:300]) <= 3
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3
    spans = [(s["start"], s["end"], s["lang"]) for s in got[903]["spans"]]
    assert [x[2] for x in spans] == ["aa", "bb"] and abs(spans[0][1] - 30) <= 2 and spans[-1][1] == 50
    assert got[904]["lang_pred"] == "cc" and got[905]["lang_pred"] in made
    empty = lang_id.fit(docs.limit(0))
    assert {x["lang_pred"] for x in lang_id.identify(docs, empty).collect()} == {"und"}


def test_viterbi_of_languages_is_the_best_labelling():
    r = np.random.default_rng(4)
    model = lang_id.LanguageModel(["x", "y", "z"], np.zeros((lang_id.BUCKETS, 3), "f4"), np.ones((len(lang_id.SCRIPT_NAMES), 3), bool))
    lab = lang_id.Labeller(model, 2.0)
    words = [f"w{chr(97 + k)}" for k in range(20)]
    lab.learn(set(words))
    lab.scores = r.normal(size=lab.scores.shape).astype("f4") * 2
    texts = [" ".join(r.choice(words, size=n)) for n in (7, 1, 0, 5)]
    got, _ = lab.label(texts)
    import itertools

    for t, path in zip(texts, got):
        s = [lab.scores[lab.index[w]] for w in t.split()]
        value = lambda p: sum(x[k] for x, k in zip(s, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max((value(p) for p in itertools.product(range(3), repeat=len(s))), default=0)
        assert abs(value(path.tolist()) - best) < 1e-4


# secrets --------------------------------------------------------------------------------------------------------


def test_secrets(spark):
    r = random.Random(12)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows, secrets = [], {}
    for k in range(120):
        s = key(40)
        kind = k % 4
        said = [f'token = "{s}"', f"commit {s}", f"https://site.example/files/{s[:20]}.png", f"password={s[:18]}"][kind]
        text = f"{prose(r, 12)} {said} {prose(r, 8)}"
        rows.append((k, text, len(text)))
        if kind in (0, 3):
            secrets[k] = s if kind == 0 else s[:18]
    rows += [(500, None, 0), (501, "", 0), (0, rows[0][1], 1), (None, rows[0][1], 2), (502, prose(r, 20_000), 3)]
    docs = spark.createDataFrame(rows, DOCS + ", n_chars bigint")
    model = secret_scan.fit(docs)
    found = secret_scan.scan(docs, model).where("is_secret").collect()
    texts = {i: t for i, t, _ in rows}
    hit = {(x["doc_id"], texts[x["doc_id"]][x["start"] : x["start"] + x["length"]]) for x in found}
    good = {(k, s) for k, s in secrets.items()}
    assert len(hit & good) >= 0.95 * len(good)
    assert len({k for k, _ in hit if k is not None and k not in secrets}) <= 3
    out = {(x["doc_id"], k): x for k, x in enumerate(secret_scan.redact(docs, model).collect())}
    assert len(out) == len(rows)
    for x in out.values():
        if x["doc_id"] in secrets and (x["doc_id"], secrets[x["doc_id"]]) in hit:
            assert secrets[x["doc_id"]] not in x["text"] and secret_scan.MASK in x["text"] and x["n_chars"] == len(x["text"])
    assert secret_scan.redact(docs.limit(0), model).count() == 0
    own = secret_scan.fit(docs, spark.createDataFrame(secret_scan.generated_findings(400, seed=3), "text string, start int, end int, is_secret int"))
    assert secret_scan.scan(docs, own).count() > 0


def test_secrets_of_each_form(spark):
    """Keys without a digit, short passwords, values with other signs and dotted tokens; look-alikes stay."""
    r = random.Random(15)
    draw = lambda signs, n: "".join(r.choice(signs) for _ in range(n))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    b64 = low + up + "0123456789_-"
    forms = {
        "issued": lambda: ("", "AKIA" + draw(up, 16), ""),
        "letters": lambda: ("token = '", draw(low + up, 32), "'"),
        "short": lambda: ('password = "', draw(low, 3) + "7" + draw(up, 3) + "4" + draw(low, 2), '"'),
        "signs": lambda: ('password = "', "S3" + draw(low, 2) + "!t#9" + draw(up, 2), '"'),
        "dotted": lambda: ("", f"eyJ{draw(b64, 20)}.{draw(b64, 5)}.{draw(b64, 30)}", ""),
    }
    plain = ["author: Peter", "key: value", "internationalization", "getElementsByTagName", "password: required", "www.weather-and-travel.co.uk", "one/two/three/four-five"]
    rows, planted, k = [], {}, 0
    for form, make in forms.items():
        for _ in range(20):
            a, s, z = make()
            rows.append((k, f"{prose(r, 12)} {a}{s}{z} {prose(r, 8)}"))
            planted[k], k = (form, s), k + 1
    rows += [(k + n, f"{prose(r, 12)} {p} {prose(r, 8)}") for n, p in enumerate(plain * 4)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {x["doc_id"]: x["text"] for x in secret_scan.redact(docs).collect()}
    for form in forms:
        left = [s for i, (f, s) in planted.items() if f == form and s in out[i]]
        assert len(left) <= 2, (form, left)
    assert sum(secret_scan.MASK in out[i] for i in out if i not in planted) <= 4


def test_candidates_are_apart_and_linear():
    text = "password=ghp_" + "a" * 40 + " x.y token: " + "b." * 50_000 + " " + "c-" * 100_000 + " key=" + "'" * 1000
    spans = secret_scan.candidates(text)
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert text[slice(*spans[0])] == "ghp_" + "a" * 40


def test_dictionary_counts_over_all_documents(spark, monkeypatch):
    """A word that few documents of any slice have, but enough of all; however the rows are dealt."""
    rows = [(k, " ".join(["common", *(["seldom"] if k % 200 == 0 else []), *(["never"] if k % 1500 == 0 else []), *(["cat"] if k % 2 else [])])) for k in range(6000)]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(secret_scan, "HELD_WORDS", 1)
    for parts in (1, 7, 400):
        assert secret_scan.dictionary(docs.repartition(parts)) == {"common", "seldom"}
    assert secret_scan.dictionary(docs.limit(0)) == frozenset()


# SentencePiece --------------------------------------------------------------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_scan_is_viterbi(spark):
    m = sp_scan.PieceModel(PIECES)
    r = random.Random(6)
    parts = ["the", "ing", " ", "  ", "\n", "é", "梦", "a", "1", "information", " of", "€", "er", "\U0001f600"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(1, 400)))) for k in range(60)]
    rows += [(k, t.replace(" ", "").replace("\n", "")) for k, t in rows[:20]]
    rows += [(900, None), (901, ""), (None, "x"), (902, " "), (903, "word " * 4000)]
    enc = sp_scan.encode(spark.createDataFrame(rows, DOCS), PIECES, chunk_chars=40)
    by: dict = {}
    for x in sp_scan.decode(enc, PIECES).collect():
        assert x["round_trip"] and x["ids_crc32"] == zlib.crc32(np.asarray(x["ids"], "<i4").tobytes())
        by.setdefault(x["doc_id"], []).append((x["chunk"], x["n_chunks"], x["ids"], x["text"]))
    want: dict = {}
    for i, t in rows:
        whole = m.ids_of(sp_scan.SPACE + t.replace(" ", sp_scan.SPACE), m.best(sp_scan.SPACE + t.replace(" ", sp_scan.SPACE))[1]) if t else []
        want.setdefault(i, []).append((whole, t or ""))
    assert set(by) == set(want)
    for i, chunks in by.items():
        if len(want[i]) == 1:
            chunks.sort(key=lambda c: c[0])
            assert [c[0] for c in chunks] == list(range(chunks[0][1]))
            assert sum((c[2] for c in chunks), []) == want[i][0][0], i
            assert "".join(c[3] for c in chunks) == want[i][0][1]
    assert sp_scan.encode(spark.createDataFrame([], DOCS), PIECES).count() == 0


def test_scan_agrees_with_the_library():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = pb.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the same scores, searched by Viterbi
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    m = sp_scan.PieceModel(PIECES)
    r = random.Random(2)
    texts = [prose(r, r.randint(1, 60)) for _ in range(200)]
    total = lambda ids: sum(m.score[m.pieces[i]] for i in ids)
    for t in texts:
        mine = np.frombuffer(m.encode(sp_scan.SPACE + t.replace(" ", sp_scan.SPACE)), "<i4").tolist()
        assert total(mine) >= total(lib.encode(t)) and lib.decode(mine) == t


def test_ngram_join_of_texts_beyond_the_histogram(spark):
    """Sets with full bins are compared in full."""
    words = [f"w{k}" for k in range(120_000)]
    near = [w if k % 20_000 else w + "x" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words)))]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar_components(spark.createDataFrame(rows, DOCS), n=3, threshold=(9, 10)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_ngram_join_meets_two_sets_once(spark, monkeypatch):
    """Texts that share hundreds of elements, not enough to link, aren't compared in the list of each of these."""
    kind, made = type(spark.range(1)), []
    keep = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *how, **more: (made.append((self.columns, keep(self, *how, **more))), made[-1][1])[1])
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(1000)]
    rows = [(k, " ".join([*base[:875], *(f"x{k}y{j}" for j in range(125))])) for k in range(12)]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar_components(spark.createDataFrame(rows, DOCS), n=3, threshold=(4, 5)).collect()}
    assert got == {k: k for k in range(12)}
    met = [out for columns, out in made if columns[:3] == ["token", "lo", "hi"]]
    assert met[0].distinct().count() == 12 * 11 // 2 <= met[0].count() <= 12 * 11
