"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Words that look disguised (digits, symbols or dots among
letters, long repetitions, letters set apart by spaces) become a lattice of the letters that each sign may stand
for; Viterbi search under the language model restores them. The restored words are scored by weights learned from
labels, on a bounded sample of labelled documents; everything else reads all rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SHORT, bounded_batches, free_name, saved

#: Bounds of the labelled sample that the weights are learned from, in documents.
MAX_TOXIC, MAX_CLEAN = 3000, 6000
MAX_WEIGHTS = 50_000
MIN_TOXIC_DOCS = 5  # that a feature must be in; two or four find no more of the held-out ones of a small sample
JOINED_PARTS = 2  # neighbouring parts of a token that are read as one word
MEMO_WORDS = 150_000
N_BEST = 3

# The letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = ".-_~'’·,/\\"
ALPHABET = 64  # classes of characters: 0 the word's edge, 1-26 a-z, the rest other letters by code point


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, "u1")
    for c in range(0x20000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch) - 96 if "a" <= ch <= "z" else 27 + c % (ALPHABET - 27)
    return table


_CLASS: np.ndarray | None = None


def classes() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        _CLASS = _classes()
    return _CLASS


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter trigrams, words' edges included, over every document's whole text."""

    def step(batches):
        table = classes()
        total = np.zeros(ALPHABET**3, "i8")
        for b in batches:
            for s in range(0, b.num_rows, 200):
                text = " ".join(t for t in b.column(0).slice(s, 200).to_pylist() if t)
                c = table[np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), "u4")].astype("i4")
                total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["gram", "n"])

    counted = bounded_batches(docs).select(text_col).mapInArrow(step, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()  # ALPHABET ** 3 rows at most
    out = np.zeros(ALPHABET**3)
    out[rows["gram"].to_numpy(dtype="i8")] = rows["n"].to_numpy()
    return out.reshape(ALPHABET, ALPHABET, ALPHABET)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative logarithms) of a character after two others, smoothed by the bigram."""
    pair = counts.sum(0)
    low = (pair + 0.5) / (pair.sum(1, keepdims=True) + 0.5 * ALPHABET)
    return -np.log((counts + 5 * low[None]) / (counts.sum(2, keepdims=True) + 5)).astype("f4")


class Decoder:
    """Restores disguised words: the cheapest paths through the lattice of letters under the language model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.classes = classes()

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        out = []
        first, last = len(token) - len(token.lstrip(_SIGNS)), len(token.rstrip(_SIGNS))
        at = 0
        for ch, run in itertools.groupby(token):
            n = len(list(run))
            at += n
            if ch.isalpha():
                out.append([(ch, 0.0)] if n == 1 else [(ch * 2, 0.0), (ch, 1.5)] if n == 2 else [(ch, 0.2), (ch * 2, 0.7)])
            elif ch in LEET:
                letters = LEET[ch]
                out.append([(x * k, 1.0 + 0.5 * (k > 1)) for x in letters for k in ((1,) if n == 1 else (1, 2))])
                if at <= first or at > last:  # signs at an edge may be no letters
                    out[-1].append(("", 1.0))
            elif ch == "*":
                out.append([(x, 3.0) for x in "abcdefghijklmnopqrstuvwxyz"] + [("", 1.0)])
            elif ch == " ":
                out.append([("", 0.5), (" ", 1.0)])
            else:
                out.append([("", 0.3 if ch in SEPARATORS else 2.0)])
        return out

    def decode(self, token: str, n_best: int = N_BEST) -> list[tuple[float, str]]:
        """(cost, restored) of the n_best cheapest at each last pair of letters, cheapest first."""
        cost, cls = self.costs, self.classes
        # paths are linked backwards: (cost, (path before, letters))
        states: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {(0, 0): [(0.0, None)]}
        for arcs in self.lattice(token):
            after: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {}
            for (a, b), paths in states.items():
                for letters, own in arcs:
                    x, y, more = a, b, own
                    for ch in letters:
                        z = int(cls[ord(ch)])
                        more += float(cost[x, y, z])
                        x, y = y, z
                    after.setdefault((x, y), []).extend((c + more, (s, letters)) for c, s in paths)
            states = {k: sorted(v, key=_cost)[:n_best] for k, v in after.items()}
        ends = sorted(((c + float(cost[a, b, 0]), s) for (a, b), paths in states.items() for c, s in paths), key=_cost)
        return sorted((c, _spelt(s)) for c, s in ends[: 2 * n_best])


_cost = itemgetter(0)


def _spelt(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


_SIGNS = "".join(c for c in LEET if not c.isdigit())
_EDGES = re.compile(r"^[^\w@$]+|[\W_]+$")
_TRIPLE = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1{3,}", re.S)
_OUTER = re.compile(rf"^[^\w{re.escape(_SIGNS)}]+|(?:(?![{re.escape(_SIGNS)}])[\W_])+$")
# signs between words of a long token: beside two word characters, so that letters set apart stay together
_BETWEEN = re.compile(r"(?<=\w\w)[^\w@$!|+(€£*]+|[^\w@$!|+(€£*]+(?=\w\w)")
_PARTS = re.compile(r"[^\n]+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_SPACED_HINT = re.compile(r"\s\S\s+\S\s+\S\s")


def disguised(word: str) -> bool:
    """Two letters or signs for letters at least, not all of them plain; digits alone are a number."""
    plain = sum(map(str.isalpha, word))
    coded = sum(c in LEET for c in word)
    return plain + coded >= 2 and (plain > 0 or any(c in _SIGNS for c in word)) and (plain < len(word) or bool(_TRIPLE.search(word)))


def restored(token: str, decoder: Decoder) -> list[str]:
    """The words that a lower-case token may stand for: itself if plain. Signs at its edges are read both as letters
    and as signs."""
    token = _RUN.sub(r"\1\1\1", token)  # longer runs have the same lattice
    word, whole = _EDGES.sub("", token), _OUTER.sub("", token)
    plain = [w for w in re.split(r"[\W\d_]+", word) if w]
    if word == whole and word.isalpha() and not _TRIPLE.search(word):
        return [word]
    parts = [m.span() for m in _PARTS.finditer(_BETWEEN.sub(lambda m: "\n" * len(m[0]), whole))]
    if len(parts) > JOINED_PARTS:  # keys, addresses, markup, whatever their length: parts, and neighbours joined
        runs = [whole[parts[k][0] : parts[min(k + n, len(parts)) - 1][1]] for n in (1, JOINED_PARTS) for k in range(len(parts) - n + 1)]
        return [w for run in dict.fromkeys(runs) for w in restored(run, decoder)] + plain
    if len(parts) > 1:
        plain += [w for a, z in parts for w in restored(whole[a:z], decoder)]
    if not disguised(whole):
        return plain
    best = decoder.decode(whole)
    return [s for c, s in best if c <= best[0][0] + 6 and s] + plain


def joined(text: str, decoder: Decoder) -> list[str]:
    """Words restored from letters set apart by white space."""
    shown = f" {text} "
    if not _SPACED_HINT.search(shown):
        return []
    out = []
    for m in _SPACED.finditer(shown):
        said = " ".join(m[0].split())
        best = decoder.decode(said)
        out += [w for c, s in best if c <= best[0][0] + 6 for w in s.split()]
        out += [w for w in (said.replace(" ", ""),) if w.isalpha()]
    return out


def features(word: str) -> list[str]:
    return [f"={word}", *(f"{n}{word[:n]}" for n in (4, 5) if len(word) >= n)]


@dataclass
class ToxicityModel:
    costs: np.ndarray
    weights: dict[str, float]
    intercept: float


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.decoder = model, Decoder(model.costs)
        self.memo: dict[str, tuple[str, ...]] = {}

    def known(self, words) -> tuple[str, ...]:
        weights = self.model.weights
        return tuple(f for w in words for f in features(w) if f in weights)

    def evidence(self, text: str) -> set[str]:
        """The features of the restored words that have a weight."""
        text = text.lower()
        memo, found = self.memo, set()
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for t in set(text.split()):
            fs = memo.get(t)
            if fs is None:
                fs = self.known(restored(t, self.decoder))
                if len(t) <= SHORT:
                    memo[t] = fs
            if fs:
                found.update(fs)
        found.update(self.known(joined(text, self.decoder)))
        return found

    def score(self, text: str) -> float:
        weights = self.model.weights
        z = self.model.intercept + sum(weights[f] for f in sorted(self.evidence(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def choose(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, n_features: int, times: int = 12, most: int = 400) -> list[int]:
    """Greedy cover: the feature that most toxic documents not yet covered times over have, a clean one counting 10
    against it, again and again. Copies of one toxic text can't bring in their chance words this way."""
    clean = np.bincount(feature[y[doc] == 0], minlength=n_features)
    d, f = doc[y[doc] == 1], feature[y[doc] == 1]
    covered, chosen = np.zeros(len(y), int), []
    free = np.ones(n_features, bool)
    while len(chosen) < most:
        gain = np.where(free, np.bincount(f[covered[d] < times], minlength=n_features) - 10 * clean, -1)
        best = int(gain.argmax())
        if gain[best] < MIN_TOXIC_DOCS:
            break
        chosen.append(best)
        free[best] = False
        covered[d[f == best]] += 1
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights, the intercept last, by Newton steps with halving."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    loss = lambda v: (w * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ v))).sum() + 0.5 * (penalty * v * v).sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (w * (p - y)) + penalty * beta)
        size, now = 1.0, loss(beta)
        while size > 1e-4 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> ToxicityModel:
    """usable: a condition on id_col; only rows that meet it lend their labels.

    Candidate features are those clearly likelier in the sample's toxic documents; a greedy cover picks few of them,
    and logistic regression weighs those. Without labels of both kinds every score is the share of toxic ones (0 without any).
    Rows with a null id or label lend nothing; a document labelled several times is toxic if one label says so; rows of
    documents that repeat an id count each.
    """
    costs = language_model(trigram_counts(docs, text_col))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col(id_col).alias("id__")).agg(F.max(F.col(label_col).cast("int")).alias("y__"))
    n = {r["y__"]: r["count"] for r in known.groupBy("y__").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    share = toxic / max(1, toxic + clean)
    if not toxic or not clean:
        return ToxicityModel(costs, {}, 30.0 if toxic else -30.0)
    draw = F.pmod(F.xxhash64("id__"), F.lit(1 << 40))
    most = {1: MAX_TOXIC, 0: MAX_CLEAN}
    threshold = F.when(F.col("y__") == 1, F.lit(int(min(1.0, MAX_TOXIC / toxic) * (1 << 40)))).otherwise(F.lit(int(min(1.0, MAX_CLEAN / clean) * (1 << 40))))
    drawn = known.where(draw < threshold).limit(2 * sum(most.values()))  # the bound makes the broadcast safe
    sample = docs.select(F.col(id_col).alias("d__"), F.col(text_col).alias("text__")).join(F.broadcast(drawn), F.col("d__") == F.col("id__"))
    sample = saved(sample.select("id__", "y__", "text__"), "toxic-sample")

    def count(batches):
        decoder = Decoder(costs)
        for b in batches:
            for s in range(0, b.num_rows, 250):
                part = b.slice(s, 250)
                hit: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = (text or "").lower()
                    words = {w for t in set(text.split()) for w in restored(t, decoder)} | set(joined(text, decoder))
                    hit[y].update({f for w in words for f in features(w)})
                names = list(hit[1] | hit[0])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([hit[y][k] for k in names], pa.int64()) for y in (1, 0))], ["f", "t", "c"])

    sizes = {r["y__"]: r["count"] for r in sample.groupBy("y__").count().collect()}
    n_t, n_c = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    found = sample.select("y__", "text__").mapInArrow(count, "f string, t bigint, c bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (n_t + 1.0)) - F.log((F.col("c") + 0.5) / (n_c + 1.0))
    strong = found.where(F.col("t") >= MIN_TOXIC_DOCS).select("f", "t", ratio.alias("w")).where("w > 2").orderBy(F.desc("t"), "f").limit(MAX_WEIGHTS)
    names = [r["f"] for r in strong.select("f").collect()]
    number = {f: k for k, f in enumerate(names)}
    finder = ToxicityModel(costs, dict.fromkeys(names, 0.0), 0.0)

    def look(batches):
        scorer = Scorer(finder)
        for b in batches:
            hits = [sorted(number[f] for f in scorer.evidence(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.int32()))], ["y", "f"])

    rows = sample.select("y__", "text__").mapInArrow(look, "y int, f array<int>").toPandas()  # MAX_TOXIC + MAX_CLEAN rows or so
    y = rows["y"].to_numpy(dtype=int)
    doc = np.repeat(np.arange(len(rows)), [len(f) for f in rows["f"]])
    feature = np.concatenate([np.asarray(f, int) for f in rows["f"]] or [np.zeros(0, int)])
    chosen = choose(doc, feature, y, len(names))
    x = np.zeros((len(rows), len(chosen)))
    place = np.full(len(names) + 1, -1)
    place[chosen] = np.arange(len(chosen))
    hit = place[feature] >= 0
    x[doc[hit], place[feature[hit]]] = 1
    # toxic rows were drawn more often than clean ones: weighted back
    w = np.where(y == 1, toxic / n_t, clean / n_c) / (toxic + clean) * len(y)
    beta = logistic(x, y, w)
    return ToxicityModel(costs, {names[k]: float(b) for k, b in zip(chosen, beta)}, float(beta[-1]))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score_col (double, 0 to 1) at the end, in place of one of that name. A null text scores as an
    empty one; texts may be of any length; repeated rows are scored each."""
    spark = bounded_batches(docs).sparkSession
    shared = spark.sparkContext.broadcast(model)  # a few hundred weights and ALPHABET ** 3 costs

    def step(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            scores = pa.array([scorer.score(t or "") for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], [*b.schema.names[:-1], "s"])

    from pyspark.sql import types as T

    row = T.StructType([T.StructField("r", docs.schema), T.StructField("s", T.DoubleType())])
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.col(text_col).alias("t"))
    out = packed.mapInArrow(step, row)
    return out.select(*(F.col(f"r.`{c}`") for c in docs.columns if c.lower() != score_col.lower()), F.col("s").alias(score_col))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, usable: Column | None = None) -> DataFrame:
    """docs without the rows that score threshold or more; same columns."""
    model, name = fit(docs, labels, usable), free_name(docs, "toxic_score")
    return score(docs, model, score_col=name).where(F.col(name) < threshold).drop(name)
