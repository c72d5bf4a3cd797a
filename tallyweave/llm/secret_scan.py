"""Secret scanning with a random forest that removes false positives.

Candidates are runs of key-like characters, dotted tokens, what follows an issuer's prefix and values after a key-like
name. Each is described by its length, shares of
kinds of characters, entropy, character transitions under a trigram model of all documents, dictionary coverage,
signs of a path around it and the words beside it. The forest learns from labelled findings; where the caller has
none, from a generated table of MAX_FINDINGS rows at most.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, saved
from .toxicity import classes, language_model, trigram_counts

MAX_FINDINGS = 6000
COMMON_SHARE, COMMON_DOCS = 1 / 1000, 5  # a word of the dictionary is in this share of all documents, and in so many
HELD_WORDS = 200_000  # different words that a task counts before it passes its counts on
TREES, DEPTH = 40, 9
THRESHOLD = 0.5
MASK = "[secret]"

# Runs of key-like signs, where a run begins; those under LONG signs need a digit or a capital after a small letter.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{12,}+={0,2}")
LONG = 16
DOTTED = re.compile(r"(?<![\w.\-])[A-Za-z0-9_\-]{2,}+(?:\.[A-Za-z0-9_\-]{2,}+){2,}+")  # three parts and more, one of them a run
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
# A value: what stands in quotes after a sign of assignment, or runs to the next white space or bracket.
ASSIGNED = re.compile(r"""(?:[=:]|\bbearer\s)>?\s*(?:(["'`])([^"'`\s]{4,}+)\1|["'`]?([^\s"'`<>&;,]{4,}+))""", re.I)
NAME = re.compile(r"""[A-Za-z0-9_.\-]*["'`\])]*\s*$""")
TAIL = ".,:)]}#?\\"
LETTERS = re.compile(r"[A-Za-z]{4,}")
# Words that speak for and against a secret beside them, and starts of issuers' keys.
FOR = re.compile(r"key|secret|token|passw|pwd|auth|credential|bearer|private|api", re.I)
AGAINST = re.compile(r"commit|sha|md5|sum|uuid|guid|image|img|src|href|url|http|file|version|example|sample|card|phone|isbn|order|invoice|revision|build", re.I)
ISSUED = re.compile(r"(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|xox[bap]-|AIza|glpat-|npm_)")
KEYS = re.compile(rf"(?<![A-Za-z0-9+/_\-]){ISSUED.pattern}[A-Za-z0-9+/_\-]{{8,}}+")

FEATURES = ["length", "digits", "upper", "lower", "other", "entropy", "transitions", "changes", "dictionary", "path", "said_for", "said_against", "hex", "issued", "assigned"]


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of everything that the forest is asked about, in order; what overlaps is one candidate."""
    spans = [m.span() for m in KEYS.finditer(text)]
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if (len(s) >= LONG or MIXED.search(s)) and any(map(str.isalnum, s)):
            spans.append(m.span())
    spans += [m.span() for m in DOTTED.finditer(text) if any(len(p) >= 12 for p in m[0].split("."))]
    for m in ASSIGNED.finditer(text):
        name = NAME.search(text, max(0, m.start() - 48), m.start())
        if not (m[0][0] in "bB" or (name and FOR.search(name[0]))):
            continue
        a, z = m.span(2) if m[2] else m.span(3)
        if not m[2]:
            z = a + len(text[a:z].rstrip(TAIL))
        if z - a >= 4:
            spans.append((a, z))
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def describe(text: str, start: int, end: int, costs: np.ndarray, words: frozenset[str]) -> list[float]:
    s = text[start:end]
    n = len(s)
    digits, upper, lower = (sum(map(f, s)) for f in (str.isdigit, str.isupper, str.islower))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    c = classes()[np.frombuffer(s.lower().encode("utf-32-le"), "u4")].astype(int)
    steps = costs[c[:-2], c[1:-1], c[2:]].mean() if n > 2 else 0.0
    kinds = [0 if x.isdigit() else 1 if x.isupper() else 2 if x.islower() else 3 for x in s]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / n
    covered = sum(len(w) for w in LETTERS.findall(s) if w.lower() in words) / n
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    token_before = before.rsplit(None, 1)[-1] if before and not before[-1].isspace() else ""
    path = float("/" in token_before or "\\" in token_before or s.count("/") > 1 or bool(re.match(r"\.[a-z]{2,4}\b|/", after)))
    near = " ".join(re.split(r"\s+", before)[-4:])
    assigned = float(bool(re.search(r"[=:]\s*[\"'`]?$", before)))
    return [
        float(n), digits / n, upper / n, lower / n, 1 - (digits + upper + lower) / n, entropy, float(steps), changes, covered, path,
        float(bool(FOR.search(near))), float(bool(AGAINST.search(near) or AGAINST.search(after))), float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))), float(bool(ISSUED.match(s))), assigned,
    ]


def generated_findings(n: int = MAX_FINDINGS, seed: int = 11, words: list[str] | None = None) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is_secret): secrets of common forms, and look-alikes, amid plain words (half of them of words, if given)."""
    r = random.Random(seed)
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    draw = lambda signs, k: "".join(r.choice(signs) for _ in range(k))
    syllables = ["the", "an", "re", "ing", "tion", "er", "ou", "es", "ment", "ver", "sch", "que", "os", "ción", "en", "ha", "le", "und", "de", "la", "st", "th"]
    made = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    word = lambda: r.choice(words) if words and r.random() < 0.5 else made()
    sign = "!#$%^*@?+-_"
    password = lambda: "".join(r.sample(a := r.choice(low) + r.choice(up) + r.choice(dig) + r.choice(sign) + draw(low + up + dig + sign, r.randint(4, 12)), len(a)))
    dotted = lambda: "eyJ" + ".".join(draw(low + up + dig + "_-", k) for k in (r.randint(12, 40), r.randint(4, 60), r.randint(20, 43)))
    name = lambda: r.choice(["token", "secret", "api_key", "apikey", "password", "passwd", "auth", "access_token", "client_secret", "SECRET_KEY", "private_key"])
    secret = [
        lambda: ("", "AKIA" + draw(up + dig, 16), ""),
        lambda: ("aws_access_key_id = ", "AKIA" + draw(up + dig, 16), ""),
        lambda: ("", r.choice(["ghp_", "gho_", "glpat-", "npm_"]) + draw(low + up + dig, 36), ""),
        lambda: ("", "sk-" + draw(low + up + dig, r.choice([24, 32, 48])), ""),
        lambda: (f'{name()} = "', draw(hexa, r.choice([32, 40, 64])), '"'),
        lambda: (f"{name()}=", draw(hexa, r.randint(16, 40)), ""),
        lambda: (f"{name()}: ", draw(low + up + dig, r.randint(18, 44)), ""),
        lambda: (f"{name()} = '", draw(low + up + dig + "+/", 40), "'"),
        lambda: ("Authorization: Bearer ", draw(low + up + dig + "_-", r.randint(30, 80)), ""),
        lambda: (r.choice(["", f"{name()}: "]), "AKIA" + draw(up, 16), ""),
        lambda: ("", r.choice(["ghp_", "gho_", "glpat-", "npm_"]) + draw(low + up, 36), ""),
        lambda: (f'{name()} = "', password(), '"'),
        lambda: (f"{name()}{r.choice(['=', ': '])}", draw(low + up, 2) + password() + draw(low + dig, 2), ""),
        lambda: (f'{name()} = "', draw(low + up + dig, r.randint(8, 15)), '"'),
        lambda: (f"{name()}{r.choice(['=', ': '])}", draw(low + up, r.randint(16, 40)), ""),
        lambda: (r.choice(["", f"{name()}=", "Authorization: Bearer "]), dotted(), ""),
    ]
    other = [
        lambda: ("", draw(dig, r.choice([16, 16, 17, 18, 20])), ""),
        lambda: (r.choice(["card ", "phone ", "order ", "invoice no. ", "id "]), draw(dig, 16), ""),
        lambda: (r.choice(["commit ", "revision ", "sha1 ", "checksum: ", "md5 = "]), draw(hexa, r.choice([32, 40])), ""),
        lambda: (f"https://{word()}.com/{word()}/", draw(hexa + "-", 36), r.choice(["", ".png", ".html", "/x"])),
        lambda: (f"http://{word()}.org/", f"{word()}-{word()}-{word()}-{draw(dig, 4)}-{word()}{word()}", ".html"),
        lambda: ('<img src="', f"/static/{word()}/{draw(low + dig, 16)}", '.jpg"'),
        lambda: ("", f"{word()}_{word()}_{word()}_{word()}_{draw(dig, 2)}", ""),
        lambda: ("", f"{word().title()}{word().title()}{word().title()}{word().title()}{word()}{draw(dig, 1)}", ""),
        lambda: (f"{name()} = ", r.choice(["your_api_key_here_123", "xxxxxxxxxxxxxxxxxxx1", "0000000000000000000", "example_token_value_1", "12345678901234567890"]), ""),
        lambda: ("", draw(dig, 8) + "T" + draw(dig, 6) + "Z" + draw(dig, 3), ""),
        lambda: ("version ", f"{draw(dig, 1)}-{draw(dig, 2)}-{word()}-build-{draw(dig, 5)}", ""),
        lambda: ("uuid ", "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), ""),
        lambda: ("", r.choice(["-", "_", "="]).replace("=", "-") * r.randint(16, 30) + draw(dig, 1), ""),
        lambda: ("", f"{word()}/{word()}/{word()}/{word()}-{draw(dig, 4)}", ""),
        lambda: (f"{name()}{r.choice([': ', ' = ', '='])}", word() + r.choice(["", "()", f".{word()}", f"_{word()}"]), ""),
        lambda: (r.choice(["author: ", "Author: ", "key: ", "keywords: ", "authority: ", "Keynote: "]), r.choice([word().title(), word()]), ""),
        lambda: (f'{name()}: "', r.choice([word(), "required", "string", "string", "password", "changeme", "null"]), '"'),
        lambda: (f"{name()} = ", r.choice([f"os.environ['{name()}']", f"config.{word()}.{name()}", f"get_{name()}({word()})", f"self.{name()}", f"${{{name()}}}"]), ""),
        lambda: ("", "".join(word() for _ in range(r.randint(4, 6))), ""),
        lambda: ("", word() + "".join(word().title() for _ in range(r.randint(2, 5))), ""),
        lambda: ("", r.choice("-_/").join(word() for _ in range(r.randint(3, 6))), ""),
        lambda: ("", f"www.{word()}{word()}-{word()}{word()}.{r.choice(['com', 'org', 'co.uk'])}", ""),
        lambda: ("", f"{word()}.{word()}_{word()}_{word()}.{word().title()}{word().title()}", ""),
    ]
    out = []
    while len(out) < n:
        is_secret = len(out) % 2
        a, body, z = r.choice(secret if is_secret else other)()
        left = " ".join(word() for _ in range(r.randint(0, 8)))
        text = left + r.choice([" ", "\n", "### ", "; "]) * bool(left) + a
        shown = text + body + z + r.choice([" ", "", "###", ".", "\n"]) + " ".join(word() for _ in range(r.randint(0, 8)))
        found = [(s, e) for s, e in candidates(shown) if s < len(text) + len(body) and e > len(text)]
        if found:
            out.append((shown, *found[0], is_secret))
    return out


def dictionary(docs: DataFrame, text_col: str = "text") -> frozenset[str]:
    """Lower-case words that at least COMMON_SHARE of all documents have, and COMMON_DOCS of them. Every count reaches the
    sum, so files and batches don't matter. Their number doesn't grow with the corpus: it is at most the mean number of
    different words of a document over COMMON_SHARE."""

    def step(batches):
        n, docs_seen = Counter(), 0

        def out():
            names = ["", *n]  # the empty word counts documents
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([docs_seen, *n.values()], pa.int64())], ["w", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                docs_seen += 1
                n.update({w for w in (t or "").lower().split() if len(w) >= 4 and w.isalpha()})
                if len(n) > HELD_WORDS:
                    yield out()
                    n, docs_seen = Counter(), 0
        yield out()

    counted = saved(bounded_batches(docs).select(text_col).mapInArrow(step, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "words")
    total = next((r["n"] for r in counted.where("w = ''").collect()), 0)
    return frozenset(r["w"] for r in counted.where((F.col("w") != "") & (F.col("n") >= max(COMMON_DOCS, total * COMMON_SHARE))).select("w").collect())


class SecretModel:
    def __init__(self, forest: RandomForestClassificationModel, costs: np.ndarray, words: frozenset[str]):
        self.forest, self.costs, self.words = forest, costs, words


def fit(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text") -> SecretModel:
    """findings: text, start, end (end excluded, in characters), is_secret; at most MAX_FINDINGS of its rows are used.
    Rows with a null in any of these are left out."""
    spark: SparkSession = docs.sparkSession
    costs, words = language_model(trigram_counts(docs, text_col)), dictionary(docs, text_col)
    if findings is None:
        rows = generated_findings(words=sorted(words))
    else:
        rows = [tuple(r) for r in findings.select("text", "start", "end", "is_secret").dropna().orderBy(F.xxhash64("text", "start"), "text", "start").limit(MAX_FINDINGS).collect()]
    table = [(describe(t, a, z, costs, words), float(y)) for t, a, z, y in rows]
    train = spark.createDataFrame(table, "f array<double>, label double").select(array_to_vector("f").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt").fit(train)
    return SecretModel(forest, costs, words)


def scan(docs: DataFrame, model: SecretModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per candidate: id_col, text_hash (64 bits, of the whole text), start, length (in characters), score,
    is_secret. Null and empty texts have none. Rows that repeat give theirs each. Whole texts are read, however long;
    candidates don't overlap, so there are no ties; score THRESHOLD itself is a secret."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast((model.costs, model.words))  # fixed size; the dictionary is bounded by COMMON_SHARE
    kind = dict(docs.dtypes)[id_col]

    def step(batches):
        costs, words = shared.value
        for b in batches:
            ids, hashes = b.column(0), b.column(1)
            at, starts, sizes, rows = [], [], [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                for a, z in candidates(t or ""):
                    at.append(k)
                    starts.append(a)
                    sizes.append(z - a)
                    rows.append(describe(t, a, z, costs, words))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(take), hashes.take(take), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["i", "text_hash", "start", "length", "f"])

    found = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).mapInArrow(step, f"i {kind}, text_hash bigint, start bigint, length bigint, f array<double>")
    scored = model.forest.transform(found.withColumn("features", array_to_vector("f")))
    score = vector_to_array("probability")[1]
    return scored.select(F.col("i").alias(id_col), "text_hash", "start", "length", score.alias("score"), (score >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, model: SecretModel | None = None, text_col: str = "text", id_col: str = "doc_id", size_col: str = "n_chars") -> DataFrame:
    """docs with each secret replaced by MASK, and size_col, where there is one, set to the new length; no row goes.
    Null and empty texts stay as they are; texts may be of any length, and columns of any names; repeated rows and rows
    that repeat an id are masked each by their own text."""
    model = model or fit(docs, text_col=text_col)
    secrets = scan(docs, model, text_col, id_col).where("is_secret").groupBy(F.col(id_col).alias("i"), F.col("text_hash").alias("h"))
    spans = secrets.agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("s"))
    # the caller's columns are out of the way inside a struct
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.col(text_col).alias("t"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("k"))
    joined = whole.join(spans, F.col("own").eqNullSafe(F.col("i")) & (F.col("k") == F.col("h")), "left")
    packed = joined.select("r", "t", "s")
    out = T.StructType([T.StructField("r", docs.schema), T.StructField("t", T.StringType()), T.StructField("changed", T.BooleanType())])

    def step(batches):
        for b in batches:
            texts, changed = [], []
            for t, spans_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for s in reversed(spans_ or []):
                    t = t[: s["start"]] + MASK + t[s["start"] + s["length"] :]
                texts.append(t)
                changed.append(bool(spans_))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(changed)], ["r", "t", "changed"])

    done = packed.mapInArrow(step, out)
    new = {text_col: F.col("t")}
    if size_col in docs.columns:
        new[size_col] = F.when(F.col("changed"), F.length("t").cast(docs.schema[size_col].dataType)).otherwise(F.col(f"r.`{size_col}`"))
    return done.select(*(new.get(c, F.col(f"r.`{c}`")).alias(c) for c in docs.columns))
