"""Toxic spans by a linear-chain conditional random field over tokens, and document scores from its marginals.

Only documents are labelled, so tokens get soft labels: of a clean document's tokens none is toxic, of a toxic document's
at least one. The first labels come from a ridge logistic regression on the words of a document (`word_weights`): a token
of a toxic document is toxic with 1 - exp(-weight), however small. The field has two states, emission weights for the token, its
first letters and its neighbours, and transition weights; it is trained by gradient ascent on the expected likelihood
of the soft labels (forward-backward). Then `ROUNDS` times its own marginals, given that a toxic document has a toxic
token somewhere (their exact posterior: less the path without any), label the tokens anew and it is trained again. So
neighbours, first letters and transitions move labels, and a word that its company explains loses them; no word list decides.

A document's score is a logistic function, fitted on the training documents, of the largest
marginal and of the expected number of toxic tokens; the offending tokens are those with a marginal of 1/2 or
more, given with their character offsets.

Training sample, documented bounds: at most `SAMPLE_PER_CLASS` rows of each label, chosen by a hash of the id among
rows whose crc32(id) mod 5 is not 0; of each, at most `TRAIN_WINDOWS` windows of `WINDOW` tokens evenly spread over
the whole text; equal texts count once. The field itself is fitted on the `TOXIC_WINDOWS` windows of a toxic document that
hold the likeliest tokens, and on at most `NEGATIVE_WINDOWS` windows of clean ones; the score on all.

Cases: a null or empty text has no tokens and gets the score of no evidence; without both labels in the training
rows every score is 0; several labels for one id count as their largest; null labels and null ids are not
learned from; repeated rows are scored each; very long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.llm.common import is_training

WINDOW, TRAIN_WINDOWS = 32, 64
SAMPLE_PER_CLASS = 2000
MIN_SUPPORT = 4
LOGISTIC_L2, LOGISTIC_STEPS = 2.0, 150
MIN_DF, EPOCHS, RATE, L2, SEED = 4, 40, 0.3, 1e-6, 11
ROUNDS, TOXIC_WINDOWS, NEGATIVE_WINDOWS = 2, 4, 4000
TOKEN = re.compile(r"\w+")


def tokens_of(text: str) -> list[str]:
    return list(map(str.lower, TOKEN.findall(text)))


def word_weights(toxic: list[set[str]], clean: list[set[str]]) -> dict[str, float]:
    """What each word adds to the log odds of a toxic document: a ridge logistic regression shares the evidence out, so
    that words which only accompany others (copies of one toxic text) stay low. Only positive weights are given."""
    seen = Counter(w for d in toxic + clean for w in d)
    names = sorted(w for w in set().union(*toxic) if seen[w] >= MIN_SUPPORT)
    if not names or not clean:
        return {}
    place = {w: k for k, w in enumerate(names)}
    sets = toxic + clean
    y = np.repeat([1.0, 0.0], [len(toxic), len(clean)])
    columns = [np.fromiter((place[w] for w in d if w in place), np.int64) for d in sets]
    row, col = np.repeat(np.arange(len(sets)), [len(c) for c in columns]), np.concatenate(columns)
    weight, bias = np.zeros(len(names)), math.log(len(toxic) / len(clean))
    m, v = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, LOGISTIC_STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weight[col], len(sets)), -30, 30)))
        g = np.bincount(col, (y - p)[row], len(names)) - LOGISTIC_L2 * weight
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weight += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias += 0.5 * float((y - p).mean())
    return {w: float(x) for w, x in zip(names, weight) if x > 0}


class ToxicField:
    """Weights of the field, and of the document score."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.token = self.head = self.before = self.after = np.zeros(1)
        self.bias, self.trans, self.start = 0.0, np.zeros((2, 2)), np.zeros(2)
        self.leak = 0.3
        self.doc = np.array([-50.0, 0.0, 0.0])

    def ids(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        word, head = self.words.get, self.heads.get
        return np.array([word(t, 0) for t in tokens], np.int32), np.array([head(t[:4], 0) for t in tokens], np.int32)

    def emissions(self, w: np.ndarray, h: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Score of state 1 over state 0 for token numbers [n, length]."""
        e = self.bias + self.token[w] + self.head[h]
        e[:, 1:] += self.before[w[:, :-1]]
        e[:, :-1] += self.after[w[:, 1:]]
        return np.where(valid, e, 0.0)

    def forward_backward(self, e: np.ndarray, valid: np.ndarray, weight: np.ndarray | None = None):
        """Marginals [n, length, 2], pair marginals summed over places and (weighted) chains [2, 2], log partition [n]."""
        n, length = e.shape
        psi = np.ones((n, length, 2))
        top = np.maximum(e, 0)
        psi[:, :, 0], psi[:, :, 1] = np.exp(-top), np.exp(e - top)
        step = np.exp(self.trans)
        alpha, scale, beta = np.empty((n, length, 2)), np.ones((n, length)), np.ones((n, length, 2))
        a = np.exp(self.start) * psi[:, 0]
        for t in range(length):
            if t:
                a = np.where(valid[:, t, None], (a @ step) * psi[:, t], a)
            scale[:, t] = a.sum(axis=1)
            a = a / scale[:, t, None]
            alpha[:, t] = a
        for t in range(length - 2, -1, -1):
            b = (beta[:, t + 1] * psi[:, t + 1]) @ step.T / scale[:, t + 1, None]
            beta[:, t] = np.where(valid[:, t + 1, None], b, beta[:, t + 1])
        marginal = alpha * beta
        marginal /= marginal.sum(axis=2, keepdims=True)
        into = beta[:, 1:] * psi[:, 1:] / scale[:, 1:, None] * valid[:, 1:, None]
        if weight is not None:
            into = into * weight[:, None, None]
        pairs = np.einsum("nti,ntj->ij", alpha[:, :-1], into) * step
        return marginal, pairs, np.log(scale).sum(axis=1) + np.where(valid, top, 0).sum(axis=1)

    NAMES = ("token", "head", "before", "after", "bias", "trans", "start")

    def parameters(self) -> dict[str, np.ndarray]:
        return {k: np.atleast_1d(np.array(getattr(self, k), float)) for k in self.NAMES}

    def assign(self, params: dict[str, np.ndarray]) -> None:
        for k in self.NAMES:
            setattr(self, k, params[k])
        self.bias = float(params["bias"][0])

    def gradient(self, w: np.ndarray, h: np.ndarray, valid: np.ndarray, gold: np.ndarray, pair_gold: np.ndarray, start_gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Expected log likelihood a token, and its gradient, for expected labels [n, length], pairs [2, 2] and starts [2]."""
        e = self.emissions(w, h, valid)
        marginal, pairs, log_z = self.forward_backward(e, valid)
        n = float(valid.sum())
        path = (e * gold).sum() + (pair_gold * self.trans).sum() + (start_gold * self.start).sum()
        d = np.where(valid, gold - marginal[:, :, 1], 0.0)
        g = {
            "token": np.bincount(w.ravel(), d.ravel(), len(self.words) + 1),
            "head": np.bincount(h.ravel(), d.ravel(), len(self.heads) + 1),
            "before": np.bincount(w[:, :-1].ravel(), d[:, 1:].ravel(), len(self.words) + 1),
            "after": np.bincount(w[:, 1:].ravel(), d[:, :-1].ravel(), len(self.words) + 1),
            "bias": np.array([d.sum()]),
            "trans": pair_gold - pairs,
            "start": start_gold - marginal[:, 0][valid[:, 0]].sum(axis=0),
        }
        for k in ("token", "head", "before", "after"):
            g[k][0] = 0.0  # what training has not seen has no weight
        return float((path - log_z.sum()) / n), {k: a / n for k, a in g.items()}

    def fit(self, w: np.ndarray, h: np.ndarray, valid: np.ndarray, gold: np.ndarray, pair_gold: np.ndarray, start_gold: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> list[float]:
        """Adam on the expected log likelihood, less a ridge, from the present weights."""
        params = self.parameters()
        m, v, out = {k: np.zeros_like(a) for k, a in params.items()}, {k: np.zeros_like(a) for k, a in params.items()}, []
        for epoch in range(1, epochs + 1):
            value, g = self.gradient(w, h, valid, gold, pair_gold, start_gold)
            out.append(value)
            for k, a in g.items():
                a = a - L2 * params[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a * a
                params[k] = params[k] + rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-8)
            self.assign(params)
        return out

    def labels(self, w: np.ndarray, h: np.ndarray, valid: np.ndarray, doc: np.ndarray):
        """Expected labels, pairs and starts of chains; `doc` is the number of a document labelled toxic, or -1 for chains of
        clean documents, which have no toxic token. A label is due to a toxic token, or (`leak`, estimated here too) to none."""
        e = self.emissions(w, h, valid)
        length, toxic = valid.sum(axis=1), doc >= 0
        none = self.start[0] + (length - 1) * self.trans[0, 0] - self.forward_backward(e, valid)[2]  # log chance of no toxic token
        free = np.exp(np.minimum(np.bincount(doc[toxic], none[toxic]), 0.0))  # of each document
        chance = 1 - free + self.leak * free
        scale, empty = np.zeros(len(doc)), np.ones(len(doc))
        scale[toxic] = (1 / chance)[doc[toxic]]
        empty[toxic] = ((self.leak - 1) * free / chance)[doc[toxic]]  # weight of the path without a toxic token, beside `scale`
        without, clean = (self.leak * free / chance).sum(), (~toxic).sum() / TOXIC_WINDOWS
        self.leak = float(np.clip(without / (without + clean), 0.01, 0.9))
        marginal, pairs, _ = self.forward_backward(e, valid, scale)
        gold = np.where(valid, np.minimum(marginal[:, :, 1] * scale[:, None], 1.0), 0.0)
        pairs[0, 0] += (empty * (length - 1)).sum()
        start = np.array([len(doc) - gold[:, 0].sum(), gold[:, 0].sum()])
        return gold, pairs, start

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Of state 1 for the tokens of each text; chains are windows of WINDOW tokens."""
        starts, at = [], 0
        for t in texts:
            starts.append(at)
            at += -(-len(t) // WINDOW) * WINDOW
        w, h, valid = np.zeros(at, np.int32), np.zeros(at, np.int32), np.zeros(at, bool)
        for s, t in zip(starts, texts):
            if t:
                w[s : s + len(t)], h[s : s + len(t)] = self.ids(t)
                valid[s : s + len(t)] = True
        w, h, valid = (a.reshape(-1, WINDOW) for a in (w, h, valid))
        p = np.zeros((len(w), WINDOW))
        for k in range(0, len(w), 4096):
            part = slice(k, k + 4096)
            p[part] = self.forward_backward(self.emissions(w[part], h[part], valid[part]), valid[part])[0][:, :, 1]
        p = np.where(valid, p, 0.0).ravel()
        return [p[s : s + len(t)] for s, t in zip(starts, texts)]

    def features(self, marginals: list[np.ndarray]) -> np.ndarray:
        return np.array([(1.0, p.max() if len(p) else 0.0, math.log1p(float(p.sum()))) for p in marginals]).reshape(-1, 3)

    def fit_documents(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Weighted logistic regression by Newton steps."""
        b, ridge = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            grad = x.T @ (weight * (y - p)) - ridge @ b
            b = b + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, grad)
        self.doc = b

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(marginals) @ self.doc, -50, 50)))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[pd.DataFrame, dict[int, int]]:
    """toxic and text windows (tokens joined by a space, windows by a line end) of the bounded sample; rows by label."""
    known = labels.where(F.col("toxic").isNotNull() & is_training()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("h", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = []
    for label, n in sorted(sizes.items()):
        bound = int(min(1.0, 3 * per_class / n) * (1 << 30))
        rows = known.where((F.col("toxic") == label) & (F.col("h") < bound)).orderBy("h", "doc_id").limit(per_class)
        chosen += [(r["doc_id"], r["toxic"]) for r in rows.collect()]
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")  # at most 2 * per_class rows

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                t = tokens_of(text)
                n = -(-len(t) // WINDOW)
                pick = range(n) if n <= TRAIN_WINDOWS else np.unique(np.linspace(0, n - 1, TRAIN_WINDOWS).astype(int))
                rows.append((toxic, "\n".join(" ".join(t[k * WINDOW : (k + 1) * WINDOW]) for k in pick)))
            yield pd.DataFrame(rows, columns=["toxic", "windows"])

    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "text")
    rows = found.mapInPandas(cut, "toxic int, windows string").distinct().toPandas()
    return rows.sort_values(["windows", "toxic"]).reset_index(drop=True), sizes


def train(docs: DataFrame, labels: DataFrame, **options) -> ToxicField:
    rows, sizes = training_rows(docs, labels, **options)
    field = ToxicField()
    y = rows["toxic"].to_numpy()
    if len(set(y)) < 2:
        return field
    windows = [[w.split() for w in t.split("\n")] for t in rows["windows"]]
    sets = [set().union(*d) for d in windows]
    weight = word_weights([s for s, k in zip(sets, y) if k], [s for s, k in zip(sets, y) if not k])
    chance = {w: 1 - math.exp(-x) for w, x in weight.items()}
    df = Counter(w for s in sets for w in s)
    field.words = {w: i for i, w in enumerate(sorted(w for w, n in df.items() if n >= MIN_DF), 1)}
    heads = Counter(h for s in sets for h in {w[:4] for w in s})
    field.heads = {w: i for i, w in enumerate(sorted(w for w, n in heads.items() if n >= 50), 1)}
    zeros = lambda names: np.zeros(len(names) + 1)
    field.token, field.head, field.before, field.after = zeros(field.words), zeros(field.heads), zeros(field.words), zeros(field.words)
    chains, of = [], []
    for d in (d for d, k in zip(windows, y) if k):
        likely = sorted((w for w in d if w), key=lambda w: -max(chance.get(t, 0.0) for t in w))
        chains += likely[:TOXIC_WINDOWS]
        of += [of[-1] + 1 if of else 0] * len(likely[:TOXIC_WINDOWS])
    clean = [w for d, k in zip(windows, y) if not k for w in d if w]
    clean = [clean[k] for k in np.random.default_rng(SEED).permutation(len(clean))[:NEGATIVE_WINDOWS]]
    chains, doc = chains + clean, np.array(of + [-1] * len(clean), np.int64)
    w, h, gold, valid = (np.zeros((len(chains), WINDOW), t) for t in (np.int32, np.int32, float, bool))
    for k, c in enumerate(chains):
        w[k, : len(c)], h[k, : len(c)] = field.ids(c)
        valid[k, : len(c)] = True
        if doc[k] >= 0:
            gold[k, : len(c)] = [chance.get(t, 0.0) for t in c]
    both, ends = valid[:, 1:], [1 - gold, gold]
    pairs = np.array([[(a[:, :-1] * b[:, 1:])[both].sum() for b in ends] for a in ends])
    field.fit(w, h, valid, gold, pairs, np.array([x[:, 0].sum() for x in ends]))
    for _ in range(ROUNDS):
        field.fit(w, h, valid, *field.labels(w, h, valid, doc))
    tokens = [[t for w in d for t in w] for d in windows]
    seen = {0: max(1, int((y == 0).sum())), 1: max(1, int((y == 1).sum()))}
    weight = np.array([sizes[int(k)] / seen[int(k)] for k in y])
    field.fit_documents(field.features(field.marginals(tokens)), y.astype(float), weight / weight.mean())
    return field


#: A name that no table is likely to have.
VERDICT = "__citeforge_toxic"


def score(docs: DataFrame, field: ToxicField, text: str = "text", spans: bool = True) -> DataFrame:
    """The rows with a struct column VERDICT: score, n_toxic, and the offending spans (start, end, marginal)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # weights of at most a bounded sample's words

    def spans_of(t: str, p: np.ndarray) -> list[dict]:
        hit = set(np.flatnonzero(p >= 0.5).tolist())
        return [{"start": x.start(), "end": x.end(), "marginal": float(p[k])} for k, x in enumerate(TOKEN.finditer(t)) if k in hit] if hit else []

    @F.pandas_udf("struct<score:double,n_toxic:long,spans:array<struct<start:int,end:int,marginal:double>>>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            whole, at, rows = [t or "" for t in texts], 0, []
            while at < len(whole):
                end, held = at, 0
                while end < len(whole) and held < 2_000_000:
                    held += len(whole[end])
                    end += 1
                p = shared.value.marginals([tokens_of(t) for t in whole[at:end]])
                rows += [(float(s), int((q >= 0.5).sum()), spans_of(t, q) if spans else []) for s, q, t in zip(shared.value.scores(p), p, whole[at:end])]
                at = end
            yield pd.DataFrame(rows, columns=["score", "n_toxic", "spans"])

    return docs.withColumn(VERDICT, tag(F.col(text)))


def detect(docs: DataFrame, labels: DataFrame, field: ToxicField | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic, spans of every row."""
    field = field or train(docs, labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    v = F.col(VERDICT)
    return score(docs.select("doc_id", "text"), field).select("doc_id", held_out.alias("held_out"), v["score"].alias("score"), (v["score"] >= 0.5).cast("int").alias("predicted"), v["n_toxic"].alias("n_toxic"), v["spans"].alias("spans"))
