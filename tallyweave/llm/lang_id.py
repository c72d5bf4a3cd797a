"""Language identification with spans of mixed-language text.

Every word gets a score per language from character n-grams, learned from a bounded sample of labelled documents.
The script of the word (a range of code points) narrows the languages that it may be in. Viterbi search with a
penalty for switching labels the words; runs of one label are spans. The label that holds most letters is the
document's language.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SHORT, bounded_batches, gathered

MAX_SAMPLE = 6000  # labelled documents that the n-gram tables are learned from
BUCKETS = 1 << 15
SWITCH_PENALTY = 8.0
MEMO_WORDS, LONG_CHARS = 200_000, 4 << 20  # beyond these, what is remembered is dropped before the next texts
OFF_SCRIPT = -60.0
STEP_ROWS = 1500  # documents whose words are labelled in step

# First code points of blocks, and the script from there on.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"),
    (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0x10000, "other"), (0x20000, "han"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_STARTS = [c for c, _ in SCRIPTS]


def script(ch: str) -> int:
    return SCRIPT_NAMES.index(SCRIPTS[bisect.bisect_right(_STARTS, ord(ch)) - 1][1])


def word_of(token: str) -> str:
    """The letters of a lower-case token."""
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams of 1 to 4 characters, and the number of the word of each."""
    shown = [f" {w} " for w in words]
    c = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), "u4").astype("u8")
    owner = np.repeat(np.arange(len(words)), [len(s) for s in shown])
    found, owners, h = [], [], np.zeros(len(c), "u8")
    for n in (1, 2, 3, 4):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(1)
        inside = owner[:m] == owner[n - 1 :]
        x = h ^ (h >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        found.append((x >> np.uint64(49)).astype("i4")[inside])
        owners.append(owner[:m][inside])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # buckets x languages, logarithms of likelihoods against their mean
    allowed: np.ndarray  # scripts x languages


def fit(docs: DataFrame, usable: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Learned from rows with a language that meet usable. Without any, there are no languages to tell."""
    known = bounded_batches(docs).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null and t is not null")
    if usable is not None:
        known = known.where(usable)
    sizes = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0), "f4"), np.zeros((len(SCRIPT_NAMES), 0), bool))
    langs = sorted(sizes)
    each = MAX_SAMPLE / len(langs)
    # a share of each language by a hash: bounded whatever the number of documents, and without a shuffle
    rate = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, each / n) * (1 << 40))))), F.col("l"))
    sample = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 40)) < rate).select("t", "l")
    number = {k: j for j, k in enumerate(langs)}

    def count(batches):
        grams = np.zeros((len(langs), BUCKETS), "i8")
        seen = np.zeros((len(langs), len(SCRIPT_NAMES)), "i8")
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = [w for w in map(word_of, t.lower().split()) if w]
                if words:
                    grams[number[lang]] += np.bincount(gram_buckets(words)[0], minlength=BUCKETS)
                    for w in words:
                        seen[number[lang], script(w[0])] += 1
        for kind, m in ((0, grams), (1, seen)):
            a, z = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(m[a, z])], ["kind", "l", "b", "n"])

    rows = sample.mapInArrow(count, "kind int, l int, b int, n bigint").groupBy("kind", "l", "b").agg(F.sum("n").alias("n")).toPandas()
    grams, seen = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    for kind, m in ((0, grams), (1, seen)):
        part = rows[rows["kind"] == kind]
        m[part["b"].to_numpy(), part["l"].to_numpy()] = part["n"].to_numpy()
    logs = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    allowed = seen > 0.01 * np.maximum(1, seen.sum(0))
    return LanguageModel(langs, (logs - logs.mean(1, keepdims=True)).astype("f4"), allowed)


class Labeller:
    def __init__(self, model: LanguageModel, penalty: float):
        self.m, self.penalty = model, penalty
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)), "f4")
        self.letters = np.zeros(0, "i4")
        self.long = 0  # characters of remembered tokens that are not short

    def learn(self, tokens: set[str]) -> None:
        if len(self.index) > MEMO_WORDS or self.long > LONG_CHARS:
            self.index.clear()
            self.scores, self.letters, self.long = self.scores[:0], self.letters[:0], 0
        new = [t for t in tokens if t not in self.index]
        if not new:
            return
        self.long += sum(len(t) for t in new if len(t) > SHORT)
        words = [word_of(t) for t in new]
        buckets, owner = gram_buckets(words)
        own = np.zeros((len(words), len(self.m.langs)), "f4")
        for j in range(own.shape[1]):
            own[:, j] = np.bincount(owner, self.m.table[buckets, j], len(words))
        for k, w in enumerate(words):
            if not w:
                own[k] = 0
            elif self.m.allowed.size:
                may = self.m.allowed[script(w[0])]
                if may.any():
                    own[k, ~may] = OFF_SCRIPT
        base = len(self.index)
        self.index.update((t, base + k) for k, t in enumerate(new))
        self.scores = np.concatenate([self.scores, own])
        self.letters = np.concatenate([self.letters, np.asarray([len(w) for w in words], "i4")])

    def label(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Labels of the words of each text, and their numbers of letters. All texts step together, longest first; what
        they came from is kept as two bytes a word and language."""
        tokens = [t.lower().split() for t in texts]
        self.learn({t for ts in tokens for t in ts})
        ids = [np.fromiter(map(self.index.__getitem__, ts), "i4", len(ts)) for ts in tokens]
        order = sorted(range(len(ids)), key=lambda k: -len(ids[k]))
        lengths = np.asarray([len(ids[k]) for k in order])
        n_lang = len(self.m.langs)
        longest = int(lengths[0]) if len(lengths) else 0
        labels = [np.zeros(n, "i2") for n in lengths]
        if longest and n_lang:
            active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts with more than t words
            flat = np.concatenate([ids[k] for k in order])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            best = np.zeros((len(order), n_lang), "f4")
            at_step = np.concatenate([[0], np.cumsum(active)])
            back = np.empty((len(flat), n_lang), "i2")
            own = np.arange(n_lang, dtype="i2")
            for t in range(longest):
                n = active[t]
                now = best[:n]
                top = now.argmax(1)
                jump = now[np.arange(n), top] - self.penalty
                stay = now >= jump[:, None]
                back[at_step[t] : at_step[t + 1]] = np.where(stay, own, top[:, None].astype("i2"))
                best[:n] = np.maximum(now, jump[:, None]) + self.scores[flat[starts[:n] + t]]
            at = best.argmax(1).astype("i2")
            out = np.zeros(len(flat), "i2")
            for t in range(longest - 1, -1, -1):
                n = active[t]
                out[starts[:n] + t] = at[:n]
                at[:n] = back[at_step[t] + np.arange(n), at[:n]]
            labels = [out[s : s + n] for s, n in zip(starts, lengths)]
        back_in_order: list = [None] * len(ids)
        for k, lab in zip(order, labels):
            back_in_order[k] = lab
        return back_in_order, [self.letters[x] for x in ids]


SPANS = "array<struct<start:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", id_col: str = "doc_id", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """One row per document: id_col, lang_pred, score (the share of letters in words so labelled), spans (start, end
    in white-space-separated words, end excluded, and lang).

    und, 0.0 and no spans where the text is null or has no letter, or the model knows no language. Ties go to the
    language first in order of its name. Repeated and null ids are kept as they are. Texts may be of any length: about
    BATCH_BYTES of them, or one text, are labelled at a time.
    """
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages

    def step(batches):
        m = shared.value
        labeller = Labeller(m, penalty)
        for part in gathered(batches, STEP_ROWS):
            labels, letters = labeller.label([t or "" for t in part.column(1).to_pylist()])
            preds, scores, spans = [], [], []
            for lab, n in zip(labels, letters):
                weight = np.bincount(lab, n, len(m.langs)) if len(lab) and m.langs else np.zeros(1)
                total = weight.sum()
                if not total:
                    preds.append("und")
                    scores.append(0.0)
                    spans.append([])
                    continue
                top = int(weight.argmax())
                preds.append(m.langs[top])
                scores.append(float(weight[top] / total))
                cuts = [0, *(np.flatnonzero(np.diff(lab)) + 1).tolist(), len(lab)]
                spans.append([{"start": a, "end": z, "lang": m.langs[lab[a]]} for a, z in zip(cuts, cuts[1:])])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["i", "lang_pred", "score", "spans"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(step, f"i {kind}, lang_pred string, score double, spans {SPANS}")
    return out.withColumnRenamed("i", id_col)
