"""Approximate nearest neighbours by additive quantisation.

Codebooks are full-dimensional: each of `BOOKS` residual codebooks of `WORDS` vectors is fitted by k-means to what
the earlier ones leave, then all are refitted together by least squares on the codes found. A vector (scaled to
length 1) is encoded by beam search as one word of each codebook whose sum is near it; the index stores the
codes, the norm of the sum and the original vector. A query scores every row through a table of its inner
products with the words (one look-up per codebook, divided by the stored norm). The `RERANK` best rows of a block
are compared exactly, in double precision on the original vectors; they give a score that the k nearest must reach.
Then every other row is compared too whose rough score r does not rule that out: a row at cosine a from its code has
at most r * a + sqrt((1 - r^2) (1 - a^2)). So no neighbour is lost, in a crowd of close vectors that share codes neither;
the codes only save comparisons.

Codebooks are fitted on at most `SAMPLE` vectors, chosen by a hash of the id; every row is encoded. Queries are
taken in blocks of `QUERY_BLOCK`, each broadcast (a bound of QUERY_BLOCK * dimensions numbers) and held against
all rows, so that a task sends at most k rows a query. Equal vectors of a batch are scored once, and stand for
their smallest ids.

Cases: vectors that are null, zero, or hold nulls or non-finite components take no part, neither do
vectors of another length than the most frequent; rows with a query's id are its own; rows that repeat an id
count once, with their best score; fewer candidates than k give fewer rows; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeforge.llm.common import durable

BOOKS, WORDS, BEAM = 8, 64, 8
SAMPLE, ROUNDS, SEED = 8192, 8, 3
RERANK, QUERY_BLOCK, BATCH = 48, 4096, 8192
#: Covers the single precision of rough scores and bounds; pairs compared at once.
SLACK, PAIRS = 2e-3, 1 << 17


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # first, so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Codebooks:
    """books [BOOKS, WORDS, dimensions]."""

    def __init__(self, books: np.ndarray):
        self.books = books

    @staticmethod
    def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = SEED) -> "Codebooks":
        rng = np.random.default_rng(seed)
        x = np.unique(x, axis=0)
        left, found, codes = x.copy(), np.zeros((books, words, x.shape[1])), []
        for m in range(books):
            c = left[rng.permutation(len(left))[:words]]
            c = np.concatenate([c, np.zeros((words - len(c), x.shape[1]))])
            for _ in range(rounds):
                near = ((c * c).sum(axis=1) - 2 * left @ c.T).argmin(axis=1)
                count = np.bincount(near, minlength=words)
                total = np.zeros_like(c)
                np.add.at(total, near, left)
                c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
            near = ((c * c).sum(axis=1) - 2 * left @ c.T).argmin(axis=1)
            codes.append(near + m * words)
            left = left - c[near]
            found[m] = c
        # refit all words together: x is about the sum of the chosen rows
        codes = np.stack(codes, axis=1)
        gram, right = np.zeros((books * words, books * words)), np.zeros((books * words, x.shape[1]))
        for i in range(books):
            np.add.at(right, codes[:, i], x)
            for j in range(books):
                np.add.at(gram, (codes[:, i], codes[:, j]), 1.0)
        ridge = 0.1 * np.eye(len(gram))
        refit = np.linalg.solve(gram + ridge, right + 0.1 * found.reshape(books * words, -1))
        return Codebooks(refit.reshape(found.shape))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes [n, BOOKS] (uint8) and the norm of the decoded sum, by beam search."""
        n, books, words = len(x), *self.books.shape[:2]
        flat = self.books.reshape(books * words, -1)
        inner = (x @ flat.T).reshape(n, books, words)
        cross = (flat @ flat.T).reshape(books, words, books, words)
        # |x - sum|^2 = |x|^2 - 2 <x, sum> + |sum|^2; a beam keeps its codes, its error and <sum, each word>
        codes, error = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1))
        products = np.zeros((n, 1, books, words))
        for m in range(books):
            grown = error[:, :, None] - 2 * inner[:, None, m] + 2 * products[:, :, m] + np.diagonal(cross[m, :, m])[None, None]
            width = min(beam, grown.shape[1] * words)
            pick = np.argpartition(grown.reshape(n, -1), width - 1, axis=1)[:, :width]
            parent, word = pick // words, pick % words
            rows = np.arange(n)[:, None]
            error = grown.reshape(n, -1)[rows, pick]
            codes = np.concatenate([codes[rows, parent], word[:, :, None]], axis=2)
            if m + 1 < books:
                products = products[rows, parent] + cross[m][word]
        best = codes[np.arange(n), error.argmin(axis=1)]
        decoded = sum(self.books[m][best[:, m]] for m in range(books))
        return best.astype(np.uint8), np.sqrt((decoded * decoded).sum(axis=1))


def fit_codebooks(rows: DataFrame, sample: int = SAMPLE) -> Codebooks | None:
    """On a sample of at most `sample` usable vectors."""
    n = rows.count()
    if not n:
        return None
    h = F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 30))
    some = rows.where(h < int(min(1.0, 2 * sample / n) * (1 << 30))).orderBy(h, "vec_id").limit(sample)
    return Codebooks.fit(_unit(np.array([r["v"] for r in some.select("v").toLocalIterator()])))


def build_index(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, v, codes, norm of every usable row."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                codes, norms = shared.value.encode(_unit(np.array(part["v"].tolist())))
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "codes": [c.tobytes() for c in codes], "norm": norms})

    return rows.mapInPandas(encode, "vec_id long, v array<double>, codes binary, norm double")


def exact_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of unit rows q [n, d] and x [n, d]; each row's sum runs in the same order wherever it stands."""
    return (np.ascontiguousarray(q) * np.ascontiguousarray(x)).sum(axis=1)


def search(index: DataFrame, queries: DataFrame, books: Codebooks, k: int = 5, rerank: int = RERANK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of the index for each query (vec_id, v)."""
    spark = index.sparkSession
    ask = queries.dropDuplicates(["vec_id", "v"])
    number = ask.count()
    blocks = max(1, -(-number // query_block))
    ask = ask.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found: DataFrame | None = None
    for b in range(blocks):
        rows = ask.where(F.col("block") == b).orderBy("vec_id").collect() if blocks > 1 else ask.orderBy("vec_id").collect()
        if not rows:
            continue
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        q = _unit(np.array([r["v"] for r in rows]))
        near = index.mapInPandas(_scan(spark.sparkContext.broadcast((ids, q, books)), k, rerank), "query_id long, vec_id long, score double")
        near = durable(near, "ann") if blocks > 1 else near
        found = near if found is None else found.unionAll(near)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(shared, k: int, rerank: int):
    """A task's k best rows for every query of the block."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, books = shared.value
        m, words = books.books.shape[:2]
        table = (q @ books.books.reshape(m * words, -1).T).astype(np.float32)
        best_score, best_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in _blocks(batches):
            vec_ids = batch["vec_id"].to_numpy()
            order = np.argsort(vec_ids, kind="stable")
            vec_ids = vec_ids[order]
            x = np.array(batch["v"].tolist())[order]
            codes = np.frombuffer(b"".join(batch["codes"]), np.uint8).reshape(-1, m)[order].astype(np.int64) + np.arange(m) * words
            norm = np.maximum(batch["norm"].to_numpy()[order], 1e-12).astype(np.float32)
            # equal vectors once: `of` gives each row's place among them, `first` a row of each
            _, first, of = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
            of = of.ravel()
            by = np.argsort(of, kind="stable")  # rows of a vector, smallest id first
            again = (of[by][1:] == of[by][:-1]) & (vec_ids[by][1:] == vec_ids[by][:-1])
            by = by[np.append(True, ~again)]  # a repeated row counts once
            begin = np.searchsorted(of[by], np.arange(len(first)))
            count = np.diff(np.append(begin, len(by)))
            x, codes, norm = _unit(x[first]), codes[first], norm[first]
            code_of = sum(books.books.reshape(m * words, -1)[codes[:, j]] for j in range(m)) / norm[:, None].astype(float)
            along = np.clip((x * code_of).sum(axis=1), -1, 1)  # cosine of each vector and its code
            across = np.sqrt(1 - along * along).astype(np.float32)
            along = along.astype(np.float32)
            take = min(rerank, len(first))
            for at in range(0, len(ids), 256):
                part = slice(at, min(at + 256, len(ids)))
                rough = np.zeros((part.stop - at, len(first)), np.float32)
                for j in range(m):
                    rough += table[part][:, codes[:, j]]
                rough /= norm
                pick = np.argpartition(-rough, take - 1, axis=1)[:, :take]
                # the (k + 1)th best of them (one may be the query's own) or the kth held is a score to reach
                near = np.einsum("id,ijd->ij", q[part], x[pick])
                least = best_score[part][:, -1]
                if take > k:
                    least = np.maximum(least, np.partition(near, take - k - 1, axis=1)[:, take - k - 1])
                np.clip(rough, -1, 1, out=rough)
                rough = rough * along + np.sqrt(1 - rough * rough) * across
                cols = np.flatnonzero((rough >= (least - SLACK)[:, None]).any(axis=0))
                near = q[part] @ x[cols].T
                if len(cols) > k:
                    least = np.maximum(least, np.partition(near, len(cols) - k - 1, axis=1)[:, len(cols) - k - 1])
                rows, at_col = np.nonzero(near >= (least - 1e-9)[:, None])
                cols = cols[at_col]
                score = np.concatenate([exact_cosine(q[part][rows[j : j + PAIRS]], x[cols[j : j + PAIRS]]) for j in range(0, max(1, len(rows)), PAIRS)])
                # each vector stands for its k + 1 smallest ids (one of them may be the query's own)
                times = np.minimum(count[cols], k + 1)
                rows, score, start = np.repeat(rows, times), np.repeat(score, times), np.repeat(begin[cols], times)
                within = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                found = vec_ids[by[start + within]]
                keep = found != ids[part][rows]
                rows, score, found = rows[keep], score[keep], found[keep]
                held = np.repeat(np.arange(part.stop - at), k)
                rows = np.concatenate([held, rows])
                score = np.concatenate([best_score[part].ravel(), score])
                found = np.concatenate([best_id[part].ravel(), found])
                order = np.lexsort((found, -score, rows))
                rows, score, found = rows[order], score[order], found[order]
                fresh = np.ones(len(rows), bool)
                fresh[1:] = ~((rows[1:] == rows[:-1]) & (found[1:] == found[:-1]) & (score[1:] == score[:-1]) & np.isfinite(score[1:]))
                rows, score, found = rows[fresh], score[fresh], found[fresh]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                top = place < k
                best_score[at + rows[top], place[top]] = score[top]
                best_id[at + rows[top], place[top]] = found[top]
        real = np.isfinite(best_score)
        yield pd.DataFrame({"query_id": np.repeat(ids, k)[real.ravel()], "vec_id": best_id[real], "score": best_score[real]})

    return scan


def _blocks(batches: Iterator[pd.DataFrame], rows: int = BATCH) -> Iterator[pd.DataFrame]:
    """Batches of about `rows` rows."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            whole, held = pd.concat(held, ignore_index=True), []
            for at in range(0, len(whole), rows):
                yield whole.iloc[at : at + rows].reset_index(drop=True)
    if held and (whole := pd.concat(held, ignore_index=True)).shape[0]:
        yield whole


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by `every`."""
    rows = usable(vectors)
    books = fit_codebooks(rows)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = durable(build_index(rows, books), "ann-index")
    return search(index, index.where(F.col("vec_id") % every == 0).select("vec_id", "v"), books, k)
