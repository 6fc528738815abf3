"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with those of each
language by Jensen-Shannon distance (base 2, so 0 to 1). The language references are sums over all rows of the
table with that `lang`; they are a few hundred numbers a language. A document is held against its nearest language (the
least sum of both distances) and rejected in either of two cases. Its characters are further than `max_char`: symbols
between the words, wrong scripts, base64. Or it has fewer common words than the language, and its words are further than `no_word_share` of the distance at
which a text without any common word would be: random words, lists, tables. Guards: the character verdict needs `min_chars` word characters, the
word verdict `min_words` words, and a language that has hardly any of the common words itself (a text without them is
nearer to it than `MIN_NO_WORD`) gives no word verdict.

Classes are ASCII's letters by case, digits, white space, sentence marks and other characters, and blocks of code points
beyond it, so that scripts and symbols are told apart.

Base rules come first (`base_failed`): fewer than 50 words, or more than half of the words inside repeated
3-word windows.

Cases: a null text has no words; without any row with a language there is no reference, and only the base
rules decide; of more than `MAX_LANGUAGES` languages those with the most text are references (a documented bound on what is
broadcast; all rows are judged); repeated rows are judged each; a null doc_id stays; texts are never cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words of languages that corpora commonly hold; public stop-word lists share them.
COMMON_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no".split()
    + "le la les de des du et un une en que qui dans pour pas sur ce il elle au aux est son par plus ne se avec sont ou mais nous vous leur cette".split()
    + "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem oder".split()
    + "el los las y que del por con una su para como lo al pero sus este ha si porque esta son entre cuando muy sin sobre ser tiene".split()
)
COMMON = tuple(dict.fromkeys(COMMON_WORDS))
#: Sentence marks; and the code points at which blocks beyond ASCII begin (each a run of first bytes in UTF-8).
MARKS = ".,;:!?'\"()-"
BLOCKS = (0x80, 0xC0, 0x100, 0x280, 0x800, 0x2000, 0x3000, 0x10000)
CLASSES = ("lower", "upper", "digit", "space", "mark", "other_ascii", *(f"from_{b:x}" for b in BLOCKS))
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
MIN_CHARS, MIN_JS_WORDS = 200, 50
MAX_CHAR_DISTANCE, NO_WORD_SHARE, MIN_NO_WORD = 0.2, 0.8, 0.2
#: Languages that are references.
MAX_LANGUAGES = 1000

_SYMBOLS = "#*$%&|<>"
_SPACES = re.compile("[ \t-\r]")
_INDEX = {w.encode(): i for i, w in enumerate(COMMON)}
_CLASS_OF = np.full(256, 5)
_CLASS_OF[ord("a") : ord("z") + 1] = 0
_CLASS_OF[ord("A") : ord("Z") + 1] = 1
_CLASS_OF[ord("0") : ord("9") + 1] = 2
_CLASS_OF[[9, 10, 11, 12, 13, 32]] = 3
_CLASS_OF[list(MARKS.encode())] = 4
for _k, _b in enumerate(BLOCKS):
    _CLASS_OF[chr(_b).encode()[0] :] = 6 + _k
_COUNTS = np.zeros((256, len(CLASSES)), dtype=np.int64)
_COUNTS[np.arange(256), _CLASS_OF] = 1
_COUNTS[0x80:0xC0] = 0  # continuation bytes: a code point counts once


def histograms(raw: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points by class; words by common word (ASCII case folded), with all others in the last bin."""
    chars = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _COUNTS
    bins = np.zeros(len(COMMON) + 1, dtype=np.int64)
    for word, n in Counter(words).items():
        bins[_INDEX.get(word.lower(), len(COMMON))] += n
    return chars, bins


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of q from p, both as counts; empty histograms are at distance 1."""
    if p.sum() == 0:
        return np.ones(len(q))
    p, q = p / p.sum(), q / np.maximum(q.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    word_chars = len(text) - len(_SPACES.findall(text))
    n_symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")] if "\n" in text else []
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        hit = np.zeros(len(words) + 2, dtype=bool)
        at = np.array([often[w] > 1 for w in windows])
        for k in range(3):
            hit[k : k + len(at)] |= at
        repeated = int(hit.sum())
    return word_chars, n_symbols, len(lines) - len(set(lines)), repeated


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Histograms of every language over all rows; each task sends one row per language."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, code in zip(batch["text"], batch["lang"]):
                raw = t.encode()
                both = np.concatenate(histograms(raw, raw.split()))
                found[code] = found[code] + both if code in found else both
        if found:
            yield pd.DataFrame({"lang": list(found), "bins": [v.tolist() for v in found.values()]})

    named = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    by_bin = named.mapInPandas(sums, "lang string, bins array<long>").select("lang", F.posexplode("bins").alias("bin", "n")).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    whole = by_bin.groupBy("lang").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    rows = whole.orderBy(F.desc("size"), "lang").limit(MAX_LANGUAGES).collect()  # one job; some hundred numbers a language
    out = {r["lang"]: np.array([b["n"] for b in r["bins"]]) for r in sorted(rows, key=lambda r: r["lang"])}
    out = {k: (v[: len(CLASSES)], v[len(CLASSES) :]) for k, v in out.items()}
    return {k: v for k, v in out.items() if v[1].sum()}


#: A name that no table is likely to have.
VERDICT = "__citeforge_quality"
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, nearest string, kept boolean"


def judge(docs: DataFrame, references: dict, text: str = "text", max_char: float = MAX_CHAR_DISTANCE, no_word_share: float = NO_WORD_SHARE, min_chars: int = MIN_CHARS, min_words: int = MIN_JS_WORDS) -> DataFrame:
    """The rows with a struct column VERDICT of RESULT's fields."""
    names = list(references)
    chars = np.array([references[k][0] for k in names]).reshape(len(names), len(CLASSES))
    words = np.array([references[k][1] for k in names]).reshape(len(names), len(COMMON) + 1)
    others = words[:, -1] / np.maximum(words.sum(axis=1), 1)
    no_word = js_distance(np.eye(len(COMMON) + 1)[-1], words)
    limits = np.where(no_word >= MIN_NO_WORD, no_word_share * no_word, np.inf)

    def of(t: str | None) -> tuple:
        t = t or ""
        raw = t.encode()
        parts = raw.split()
        n = len(parts)
        word_chars, n_symbols, n_dup, n_rep = base_counts(t, parts)
        failed = n < MIN_WORDS or 100 * n_rep > MAX_REPEATED_PERCENT * n
        dc = dw = nearest = None
        far = False
        if names and n:
            c, w = histograms(raw, parts)
            by_char, by_word = js_distance(c, chars), js_distance(w, words)
            best = int(np.argmin(by_char + by_word))
            nearest, dc, dw = names[best], float(by_char[best]), float(by_word[best])
            far = word_chars >= min_chars and dc > max_char or n >= min_words and dw > limits[best] and w[-1] / n > others[best]
        return n, word_chars, n_symbols, n_dup, n_rep, failed, dc, dw, nearest, not (failed or far)

    @F.pandas_udf("struct<" + RESULT.replace(" long", ":long").replace(" boolean", ":boolean").replace(" double", ":double").replace(" string", ":string") + ">")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RESULT.split(", ")]
        for texts in batches:
            yield pd.DataFrame([of(t) for t in texts], columns=columns)

    return docs.withColumn(VERDICT, quality(F.col(text)))


def assess(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the fields of RESULT for every row."""
    return judge(docs.select("doc_id", "text", "lang"), language_references(docs), **options).select("doc_id", f"{VERDICT}.*")


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows that pass, with their columns unchanged."""
    judged = judge(docs, language_references(docs), **options)
    return judged.where(f"{VERDICT}.kept").drop(VERDICT)
