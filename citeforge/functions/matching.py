"""Functions that need Python: ordered-block matching, accents. Arrow batches; they run last in each cascade."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType


def block_share(q: str, p: str) -> float:
    """Share of q's characters in matching blocks of four or more; 0 where it cannot reach 0.9."""
    if not q or len(p) < 0.9 * len(q):
        return 0.0
    # every matched block of four or more is made of runs of four that p holds
    held = {p[k : k + 4] for k in range(len(p) - 3)}
    covered = end = 0
    for k in range(len(q) - 3):
        if q[k : k + 4] in held:
            covered += k + 4 - max(k, end)
            end = k + 4
    if covered < 0.9 * len(q):
        return 0.0
    blocks = SequenceMatcher(None, q, p, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks if b.size >= 4) / len(q)


@F.pandas_udf(DoubleType())
def aligned_share(quote: pd.Series, passage: pd.Series) -> pd.Series:
    return pd.Series([block_share(q or "", p or "") for q, p in zip(quote, passage)], dtype="float64")


@F.pandas_udf(BooleanType())
def near_any(text: pd.Series, others: pd.Series) -> pd.Series:
    """Whether a text and one of several hold nine tenths of each other in ordered blocks, in either direction."""
    plain = lambda t: " ".join(t.lower().split())

    def one(t, found):
        if t is None or found is None or not len(found):
            return False
        return any(block_share(plain(t), plain(o)) >= 0.9 or block_share(plain(o), plain(t)) >= 0.9 for o in found)

    return pd.Series([one(t, f) for t, f in zip(text, others)], dtype=bool)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """ASCII letters without accents, lower case."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower())


def folded(text):
    """`fold` for what is not plain ASCII already: the rest stays in the JVM."""
    return F.when(text.rlike("^[\\x00-\\x7f]*$"), F.lower(text)).otherwise(fold(text))


_ACCENT = {"´": "́", "˝": "̋", "¨": "̈", "ˆ": "̂", "˜": "̃", "ˇ": "̌"}


@F.pandas_udf(StringType())
def compose_accents(text: pd.Series) -> pd.Series:
    """Spacing accents between letters join the small letter after them."""
    import re

    pattern = re.compile("(?<=[A-Za-z])([" + "".join(_ACCENT) + "])([a-z])")
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", pattern.sub(lambda m: m[2] + _ACCENT[m[1]], s)))


@F.pandas_udf(ArrayType(DoubleType()))
def hashed_embedding(text: pd.Series) -> pd.Series:
    """A deterministic stand-in for an encoder: hashed character trigrams in 64 places, length 1."""
    import zlib

    import numpy as np

    def one(s):
        v = np.zeros(64)
        low = f"  {(s or '').lower()} "
        for k in range(len(low) - 2):
            v[zlib.crc32(low[k : k + 3].encode()) % 64] += 1
        return (v / max(1e-12, np.linalg.norm(v))).tolist()

    return text.map(one)


def section_windows(limit: int, least: int):
    """A UDF from a document's ordered paragraph sizes, and whether each begins a new path, to windows [begin, end) as alternating numbers.

    A window takes paragraphs of one path up to `limit`; the last one of a path, if it has less than `least`, joins the one before it.
    """

    @F.pandas_udf(ArrayType(IntegerType()))
    def pack(tokens: pd.Series, fresh: pd.Series) -> pd.Series:
        def one(sizes, starts):
            begins, held, paths, path = [], [], [], 0
            for k, (t, new) in enumerate(zip(sizes, starts)):
                path += bool(new)
                if not begins or new or held[-1] + t > limit and held[-1] > 0:
                    begins.append(k)
                    held.append(0)
                    paths.append(path)
                held[-1] += t
            paths.append(None)
            kept = [b for c, b in enumerate(begins) if not (held[c] < least and paths[c + 1] != paths[c] and c > 0 and paths[c - 1] == paths[c])]
            return [x for w in zip(kept, [*kept[1:], len(sizes)]) for x in w]

        return pd.Series([one(a, b) for a, b in zip(tokens, fresh)], dtype=object)

    return pack


def sliding_windows(size: int, overlap: int):
    """A UDF from a document's ordered paragraph sizes to windows [begin, end) as alternating numbers.

    A window takes paragraphs until it has `size`; the next begins where at least `overlap` is left, and always later.
    """

    @F.pandas_udf(ArrayType(IntegerType()))
    def windows(tokens: pd.Series) -> pd.Series:
        def one(sizes):
            out, begin, n = [], 0, len(sizes)
            while n:
                end, held = begin, 0
                while end < n and (held < size or end == begin):
                    held += sizes[end]
                    end += 1
                out += [begin, end]
                if end >= n:
                    return out
                back, kept = end, 0
                while back > begin + 1 and kept < overlap:
                    back -= 1
                    kept += sizes[back]
                begin = back if kept >= overlap else begin + 1
            return out

        return pd.Series([one(a) for a in tokens], dtype=object)

    return windows
