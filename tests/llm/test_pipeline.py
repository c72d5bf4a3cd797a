"""Stages of the pipeline against plain versions, on planted documents."""

import random

import corpus_pipeline
import pytest

from tallyweave.llm import shared
from test_operators import plain_components, plain_sets, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(20)
    bad, rows, labels = ["idiot", "moron", "scum"], [], []
    for k in range(400):
        words = prose(r, r.randint(20, 120)).split()
        toxic = k % 6 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad)
        rows.append((k, " ".join(words), "en", f"s{k % 3}"))
        if k % 2 == 0:
            labels.append((k, 1, int(toxic)))
    for k in range(60):
        text = rows[r.choice([x for x in range(400) if x % 6])][1]
        if k % 2:
            words = text.split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        rows.append((1000 + k, text, None, None))
    rows += [(2000 + k, prose(r, 30) + f' password={r.getrandbits(72):018x} ' + prose(r, 5), "en", "s") for k in range(20)]
    rows += [(3000, None, None, None), (3001, "", "en", "s"), (None, "no id here at all", "en", "s")]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "secret_scan", "best_fit_packing"]
    before = {(x["doc_id"], x["text"]) for x in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "best_fit_packing":
            assert {x["doc_id"] for x in out.collect()} == {i for i, _ in before}
            break
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = {(x["doc_id"], x["text"]) for x in out.collect()}
        gone = before - after
        if name == "toxicity":
            toxic = {i for i, t in before if t and {"idiot", "moron", "scum"} & set(t.split())}
            assert len({i for i, _ in gone} ^ toxic) <= 3
        elif name == "exact_dedup":
            least: dict = {}
            for i, t in before:
                least.setdefault(t or "", []).append(i)
            want = {min((x for x in ids if x is not None), default=None) for ids in least.values()}
            assert {i for i, _ in after} == want
        elif name == "ngram_join":
            rows = [x for x in before if x[0] is not None]
            sets = plain_sets(rows, 5)
            links = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            low = plain_components([i for i, _ in rows], links)
            assert {i for i, _ in after} == {i for i, c in low.items() if i == c} | {None}
        else:
            assert {i for i, _ in after} == {i for i, _ in before}
            masked = {i for i, t in after if t and "[secret]" in t}
            assert len(masked & {2000 + k for k in range(20)}) >= 18 and len(masked) <= 22
        path = f"{folder}/after-{name}"
        out.write.parquet(path)
        docs, before = spark.read.parquet(path), after


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_and_very_long_texts(spark, tmp_path):
    """Columns named as what stages use inside stay as they are; texts of hundreds of thousands of words go through."""
    r = random.Random(8)
    names = ["gone", "gone__", "id", "n", "fp", "row", "keep_id", "kept", "toxic_score", "score", "s", "t", "component_id", "text_hash", "id__"]
    long = prose(r, 150_000)
    texts = [long, long, long + " one more", "x" * 300_000, *(prose(r, 40) for _ in range(30))]
    rows = [(k, t, "en", "s", len(t), *range(len(names))) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} int" for c in names))
    spark.createDataFrame([(k, 1, 0) for k in range(4, 20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        assert set(shared._STAGE) <= set(shared._SAVED), name  # those of the stage before are gone
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert all(tuple(x)[5:] == tuple(range(len(names))) for x in docs.collect()), name
    assert {x["doc_id"] for x in docs.select("doc_id").collect()} == {0, *range(3, len(texts))}  # the copy and the near copy go
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {x["doc_id"] for x in packed.select("doc_id").distinct().collect()} == {0, *range(3, len(texts))}
