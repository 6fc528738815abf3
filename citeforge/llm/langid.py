"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. Every byte position of a window gets a
label distribution from the states of a forward and a backward gated recurrence; a document's probabilities
are the mean over the positions of all its windows (the whole text, in windows of `WINDOW` bytes).

Training sample, a documented bound: at most `SAMPLE_PER_LANGUAGE` documents a language, chosen by a hash of the
id among rows with a language whose crc32(id) mod 5 is not 0; of each, at most `WINDOWS_PER_DOCUMENT` windows
evenly spread over the whole text. More than `MAX_LANGUAGES` languages are an error.

Cases: null text, or one without letters, is `und` with score 1.0; with no training rows every text is `und` with
score 0.0, and `keep` passes those with letters; repeated rows are predicted each; a null id is held_out false and predicted; very long texts are
read whole, in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeforge.llm.common import is_training

HIDDEN, WINDOW = 12, 64
SAMPLE_PER_LANGUAGE, WINDOWS_PER_DOCUMENT = 400, 6
MAX_LANGUAGES = 64
EPOCHS, MIN_STEPS, BATCH, RATE, SEED = 4, 200, 128, 0.01, 7
#: Windows that one step of the recurrence handles at once.
BLOCK = 2048
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


class ByteGru:
    """Weights of both directions (index 0 forward, 1 backward) and of the output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        n = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {"x": n(2, 3 * hidden, 256, scale=0.3), "u": n(2, 3 * hidden, hidden, scale=hidden**-0.5), "o": n(2, len(languages), hidden, scale=0.3), "b": np.zeros((len(languages), 1), np.float32)}

    def _run(self, d: int, x: np.ndarray, keep: list | None):
        """Yields (t, state) along direction d of x [length, n]; keep gets what the backward pass needs."""
        h_n, (wx, u) = self.hidden, (self.w["x"][d], self.w["u"][d])
        h = np.zeros((h_n, x.shape[1]), np.float32)
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            gi, gh = wx[:, x[t]], u @ h
            rz = np.tanh((gi[: 2 * h_n] + gh[: 2 * h_n]) * np.float32(0.5))
            rz *= np.float32(0.5)
            rz += np.float32(0.5)
            n = np.tanh(gi[2 * h_n :] + rz[:h_n] * gh[2 * h_n :])
            new = n + rz[h_n:] * (h - n)
            if keep is not None:
                keep.append((t, rz, n, h, gh[2 * h_n :]))
            h = new
            yield t, h

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each position: [length, languages, n] for bytes x [length, n]."""
        out = np.empty((len(x), len(self.languages), x.shape[1]), np.float32)
        for t, h in self._run(0, x, None):
            np.matmul(self.w["o"][0], h, out=out[t])
        for t, h in self._run(1, x, None):
            out[t] += self.w["o"][1] @ h
        out += self.w["b"]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def step(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the valid positions, and its gradients (backpropagation through time)."""
        h_n, length, n = self.hidden, *x.shape
        kept, states = ([], []), ([None] * length, [None] * length)
        logits = np.zeros((length, len(self.languages), n), np.float32)
        for d in (0, 1):
            for t, h in self._run(d, x, kept[d]):
                states[d][t] = h
                logits[t] += self.w["o"][d] @ h
        logits += self.w["b"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        total = max(1.0, float(valid.sum()))
        loss = -float((np.log(p[:, y, np.arange(n)] + 1e-9) * valid).sum()) / total
        p[:, y, np.arange(n)] -= 1
        p *= (valid / total)[:, None, :]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["b"][:, 0] = p.sum(axis=(0, 2))
        for d in (0, 1):
            wo, u = self.w["o"][d], self.w["u"][d]
            dh = np.zeros((h_n, n), np.float32)
            inputs = np.zeros((256, 3 * h_n), np.float32)
            for t, rz, cand, h, gh_n in reversed(kept[d]):
                g["o"][d] += p[t] @ states[d][t].T
                dh = dh + wo.T @ p[t]
                r, z = rz[:h_n], rz[h_n:]
                dn = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (h - cand) * z * (1 - z)
                dr = dn * gh_n * r * (1 - r)
                da = np.concatenate([dr, dz, dn])
                dgh = np.concatenate([dr, dz, dn * r])
                g["u"][d] += dgh @ h.T
                np.add.at(inputs, x[t], da.T)
                dh = dh * z + u.T @ dgh
            g["x"][d] = inputs.T
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam over shuffled batches of windows x [n, length] (0 pads) with language numbers y; at least MIN_STEPS."""
        rng = np.random.default_rng(seed)
        m, v, steps, losses = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}, 0, []
        each = -(-len(x) // batch)
        epochs = max(epochs, -(-MIN_STEPS // each))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                rows = np.ascontiguousarray(x[pick].T)
                loss, g = self.step(rows, y[pick], (rows > 0).astype(np.float32))
                steps += 1
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for k, a in g.items():
                    a *= np.float32(min(1.0, 1.0 / (norm + 1e-9)))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    lr = rate * 0.1 ** (steps / (epochs * each))
                    self.w[k] -= (lr * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
                losses.append(loss)
        return losses

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each whole text."""
        out: list[tuple[str, float]] = [(UNKNOWN, 1.0)] * len(texts)
        which = [k for k, t in enumerate(texts) if t and has_letter(t)]
        if not self.languages:
            return [(UNKNOWN, 1.0 if k not in set(which) else 0.0) for k in range(len(texts))]
        sums = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        blocks, owners, held = [], [], 0

        def flush():
            nonlocal blocks, owners, held
            x, owner = np.concatenate(blocks), np.concatenate(owners)
            for at in range(0, len(x), BLOCK):
                rows = np.ascontiguousarray(x[at : at + BLOCK].T)
                valid = (rows > 0).astype(np.float32)
                p = (self.probabilities(rows) * valid[:, None, :]).sum(axis=0).T
                np.add.at(sums, owner[at : at + BLOCK], p)
                np.add.at(count, owner[at : at + BLOCK], valid.sum(axis=0))
            blocks, owners, held = [], [], 0

        for k in which:
            windows = as_windows(texts[k].encode())
            for at in range(0, len(windows), BLOCK):
                part = windows[at : at + BLOCK]
                blocks.append(part)
                owners.append(np.full(len(part), k))
                held += len(part)
                if held >= BLOCK:
                    flush()
        if held:
            flush()
        for k in which:
            mean = sums[k] / max(count[k], 1)
            best = int(mean.argmax())
            out[k] = (self.languages[best], float(min(1.0, mean[best])))
        return out


def as_windows(raw: bytes) -> np.ndarray:
    """[n, WINDOW] bytes, padded with 0 (a zero byte of the text counts as padding)."""
    a = np.frombuffer(raw, dtype=np.uint8)
    out = np.zeros((max(1, -(-len(a) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[: len(a)] = a
    return out


def training_windows(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> pd.DataFrame:
    """lang, window: of the bounded sample described above, at the driver."""
    named = docs.where(is_training() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = named.select("doc_id", "lang", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)).alias("h"))
    sizes = key.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:  # none is left out silently
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return pd.DataFrame({"lang": [], "window": []})
    # a hash bound lets about three times the rows wanted through, however large a language is; the rest is ranked, in one scan
    bounds = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 3 * per_language / r["count"]) * (1 << 30))) for r in sizes], "lang string, bound long")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    wanted = key.join(F.broadcast(bounds), "lang").where("h < bound").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    ids = [r["doc_id"] for r in wanted.select("doc_id").distinct().collect()]  # at most MAX_LANGUAGES * per_language ids
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, lang in zip(batch["text"], batch["lang"]):
                if has_letter(text):
                    w = as_windows(text.encode())
                    pick = np.unique(np.linspace(0, len(w) - 1, WINDOWS_PER_DOCUMENT).astype(int))
                    rows += [(lang, w[k].tobytes()) for k in pick]
            yield pd.DataFrame(rows, columns=["lang", "window"])

    sample = named.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")
    out = sample.mapInPandas(cut, "lang string, window binary").toPandas()
    return out.sort_values(["lang", "window"]).reset_index(drop=True)


def train(docs: DataFrame, **options) -> ByteGru:
    rows = training_windows(docs, **options)
    languages = sorted(rows["lang"].unique())
    net = ByteGru(languages)
    if languages:
        x = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW)
        net.fit(x, rows["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy())
    return net


#: A name that no table is likely to have.
VERDICT = "__citeforge_lang"


def predict(docs: DataFrame, net: ByteGru, text: str = "text") -> DataFrame:
    """The rows with a struct column VERDICT of lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousand weights

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(shared.value.predict(texts.tolist()), columns=["lang_pred", "score"])

    return docs.withColumn(VERDICT, label(F.col(text)))


def identify(docs: DataFrame, net: ByteGru | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    net = net or train(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), f"{VERDICT}.lang_pred", f"{VERDICT}.score")


#: Documents whose best language has less than this mean probability are rejected by `keep`.
MIN_SCORE = 0.35


def keep(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows with a recognised language, with their columns unchanged; those with a letter where no row teaches one."""
    net = train(docs)
    if not net.languages:

        @F.pandas_udf("boolean")
        def lettered(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: t is not None and has_letter(t)).astype(bool)

        return docs.where(lettered(F.col("text")))
    judged = predict(docs, net)
    return judged.where((F.col(f"{VERDICT}.lang_pred") != UNKNOWN) & (F.col(f"{VERDICT}.score") >= min_score)).drop(VERDICT)
