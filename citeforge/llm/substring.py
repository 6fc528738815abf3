"""Substring deduplication by content-defined chunks under a gear rolling hash.

The gear hash of a place mixes the `GEAR_BYTES` bytes up to it. A chunk ends where that hash is the largest within
`RADIUS` places on either side, so ends depend on the bytes around them alone: they meet again soon after an
insertion, and every stretch of some hundred bytes has several. Chunks of more than `MAX_CHUNK` bytes (bytes that
repeat) are divided evenly. A chunk's digest tells equal chunks; of these the first place (smallest doc_id, then
place) stays. Neighbouring chunks that stand earlier make a run; both of its ends are compared, byte by byte, with the
`CONTEXT` bytes beside its first place, as a passage begins and ends inside chunks. Runs of `min_run` bytes or more
are cut out, so that short common phrases stay, and so does a single chunk whose digest is equal by chance.

Only digests and places meet all others: the first place of each digest is an aggregate with partial results, the way back an
equi-join that Spark splits where a digest is very frequent. Runs are put together inside one document. Of first
places only the ends of runs are asked for their bytes, each once. Texts are dealt out by document to meet
what is asked and what is cut; an unchanged text never goes to Python for that.

Cases: a null text stays null and an empty one empty; null ids come before all others and are not named as
sources; rows with equal doc_id are ordered by a hash of their text, and rows equal in both are one document
(all stay, or all are cut alike); a document that repeats itself is cut too; texts are never shortened to be compared;
characters are cut whole; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeforge.llm.common import durable

GEAR_BYTES, RADIUS, MAX_CHUNK = 16, 24, 256
MIN_RUN, CONTEXT = 120, 256
#: Bytes that are hashed at once, and those on each side of them that decide about chunk ends.
SEGMENT, MARGIN = 1 << 18, GEAR_BYTES + RADIUS
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)

#: Names that no table is likely to have.
SPANS, KEY = "__citeforge_spans", "__citeforge_key"
#: place * _PLACE + length of a chunk in one number.
_PLACE = 1 << 10


def _gear(a: np.ndarray) -> np.ndarray:
    """Sum of the gear values of the GEAR_BYTES bytes up to each place, each shifted by its distance."""
    h, span = np.take(_GEAR, a), 1
    while span < GEAR_BYTES:
        shifted = h << np.uint32(span)
        h[span:] += shifted[:-span]
        span *= 2
    return h


def _largest(h: np.ndarray, width: int) -> np.ndarray:
    """The largest of `width` values from each place."""
    at, span = h, 1
    while 2 * span <= width:
        at = np.maximum(at[:-span], at[span:])
        span *= 2
    n = len(h) - width + 1
    return np.maximum(at[:n], at[width - span : width - span + n])


def _ends(parts: list[np.ndarray]) -> list[np.ndarray]:
    """The places of each part whose hash is the largest around them (the first of equal ones, none where all are equal)."""
    gap = MARGIN + 1
    a = np.zeros(gap + sum(len(p) + gap for p in parts), np.uint8)
    inside, begin, at = np.zeros(len(a), bool), [], gap
    for p in parts:
        a[at : at + len(p)] = p
        inside[at : at + len(p)] = True
        begin.append(at)
        at += len(p) + gap
    h = _gear(a) | np.uint32(1)
    h[~inside] = 0
    top = _largest(h, RADIUS)  # of RADIUS places from each
    n = len(h) - 2 * RADIUS
    here = h[RADIUS : RADIUS + n]
    found = RADIUS + np.flatnonzero((here > top[:n]) & (here >= top[RADIUS + 1 : RADIUS + 1 + n]))
    cut = np.searchsorted(found, [*begin, len(a)])
    return [found[i:j] - b for i, j, b in zip(cut, cut[1:], begin)]


def _divided(ends: np.ndarray) -> np.ndarray:
    """The ends of chunks (0 first), with those of chunks above MAX_CHUNK divided."""
    if (ends[1:] - ends[:-1]).max() <= MAX_CHUNK:
        return ends[1:]
    return np.concatenate([np.append(np.arange(s + MAX_CHUNK, e, MAX_CHUNK), e) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())])


def chunk_ends(texts: list[bytes]) -> list[np.ndarray]:
    """Where each chunk of each text ends; a text is hashed in segments, so its length does not count."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    parts, owners, held = [], [], 0

    def flush() -> None:
        nonlocal parts, owners, held
        for (k, start, end, lead), e in zip(owners, _ends(parts) if parts else []):
            e = e - lead + start
            found[k].append(e[(e >= start) & (e < end)] + 1)
        parts, owners, held = [], [], 0

    for k, raw in enumerate(texts):
        a = np.frombuffer(raw, np.uint8)
        for start in range(0, len(a), SEGMENT):
            end, lead = min(len(a), start + SEGMENT), min(start, MARGIN)
            parts.append(a[start - lead : end + MARGIN])
            owners.append((k, start, end, lead))
            held += len(parts[-1])
            if held >= SEGMENT:
                flush()
    flush()
    out = []
    for f, raw in zip(found, texts):
        ends = [np.zeros(1, np.int64), *f]
        if not f or not len(f[-1]) or f[-1][-1] < len(raw):
            ends.append(np.full(1, len(raw)))
        out.append(_divided(np.concatenate(ends)) if raw else np.zeros(0, np.int64))
    return out


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, rank, key, at of every chunk."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        texts, rank, key = batch["raw"].to_pylist(), batch["rank"].to_numpy(zero_copy_only=False), batch["key"].to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and held < SEGMENT:
                held += len(texts[end])
                end += 1
            ends = chunk_ends(texts[at:end])
            starts = [np.append(0, e[:-1]) if len(e) else e for e in ends]
            count = [len(e) for e in ends]
            hashes = [digest(raw[i:j]) for raw, s, e in zip(texts[at:end], starts, ends) for i, j in zip(s.tolist(), e.tolist())]
            s, e = np.concatenate(starts), np.concatenate(ends)
            columns = [np.array(hashes, np.uint64).view(np.int64), rank[at:end].repeat(count), key[at:end].repeat(count), s * _PLACE + (e - s)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "rank", "key", "at"])
            at = end


def _beside(raw: bytes, ask: int) -> bytes:
    """The bytes before a place (ask is twice the place) or from it (and one more)."""
    place = ask >> 1
    return raw[place : place + CONTEXT] if ask & 1 else raw[max(0, place - CONTEXT) : place]


def _answer():
    @F.pandas_udf("array<struct<ask:long,beside:binary>>")
    def answer(texts: pd.Series, asks: pd.Series, _row: pd.Series) -> pd.Series:
        return pd.Series([[{"ask": int(x), "beside": _beside(raw, int(x))} for x in found] for raw, found in ((t.encode(), a) for t, a in zip(texts, asks))], dtype=object)

    return answer


def repeated_runs(keyed: DataFrame, text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """KEY, start, end (bytes), sources (ids), and skey, ask, side: each run of chunks with an earlier equal, a row for each of its
    ends, with the place beside which its first copy goes on. `keyed` has KEY, a hash of id and text."""
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    long = keyed.where(F.octet_length(text) >= min_run).select(rank.alias("rank"), F.col(KEY).alias("key"), F.col(text).cast("binary").alias("raw"))
    chunks = long.mapInArrow(_chunk_rows, "h long, rank long, key long, at long")
    first = chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "key", "at")).alias("f")).where("n > 1").select("h", F.col("f.rank").alias("rank0"), F.col("f.key").alias("key0"), F.col("f.at").alias("at0"))
    met = chunks.select("h", "key", "at").join(first, "h").where("key <> key0 or at <> at0")
    place, size = lambda c: F.shiftright(c, 10), lambda c: F.col(c).bitwiseAND(_PLACE - 1)
    # equal rows of the table have equal KEYs: one of them is enough
    met = met.dropDuplicates(["key", "at"]).select("key", place("at").alias("place"), size("at").alias("size"), "rank0", "key0", place("at0").alias("place0"))
    in_doc = Window.partitionBy("key").orderBy("place")
    met = met.withColumn("fresh", F.coalesce((F.lag(F.col("place") + F.col("size")).over(in_doc) != F.col("place")).cast("int"), F.lit(1)))
    met = met.withColumn("run", F.sum("fresh").over(in_doc))
    source = F.when(F.col("rank0") != -(1 << 63), F.col("rank0"))
    runs = met.groupBy("key", "run").agg(
        F.min("place").alias("start"),
        F.max(F.col("place") + F.col("size")).alias("end"),
        F.collect_set(source).alias("sources"),
        F.min(F.struct("place", F.col("key0").alias("skey"), (F.col("place0") * 2).alias("ask"))).alias("left"),
        F.max(F.struct("place", F.col("key0").alias("skey"), ((F.col("place0") + F.col("size")) * 2 + 1).alias("ask"))).alias("right"),
    )
    sides = F.array(*[F.struct(F.col(f"{c}.skey").alias("skey"), F.col(f"{c}.ask").alias("ask")) for c in ("left", "right")])
    return runs.select(F.col("key").alias(KEY), "start", "end", "sources", F.posexplode(sides).alias("side", "s")).select(KEY, "start", "end", F.when(F.col("side") == 0, F.col("sources")).alias("sources"), "side", "s.skey", "s.ask")


def _alike(a: bytes, b: bytes, order: str) -> int:
    """Equal bytes at the beginning (little) or end (big) of two strings of one length."""
    if a == b:
        return len(a)
    x = int.from_bytes(a, order) ^ int.from_bytes(b, order)
    return ((x & -x).bit_length() - 1) // 8


def _begins(raw: bytes, place: int) -> bool:
    return place == len(raw) or raw[place] & 0xC0 != 0x80


_SPAN = "struct<start:long,end:long,first_doc_ids:array<long>>"
_RESULT = f"struct<text:string,removed_chars:long,spans:array<{_SPAN}>>"


def _stretches(raw: bytes, sides) -> list[list]:
    """start, end, ids of each run, extended at both ends, those that meet joined."""
    runs: dict[int, list] = {}
    for r in sides:
        run = runs.setdefault(int(r["start"]), [int(r["start"]), int(r["end"]), []])
        beside = r["beside"] or b""
        if r["side"] == 0:
            n = min(len(beside), int(r["start"]))
            run[0] -= _alike(raw[int(r["start"]) - n : int(r["start"])], beside[len(beside) - n :], "big")
            run[2] = [int(x) for x in r["sources"]]
        else:
            n = min(len(beside), len(raw) - int(r["end"]))
            run[1] += _alike(raw[int(r["end"]) : int(r["end"]) + n], beside[:n], "little")
    out: list[list] = []
    for run in sorted(runs.values(), key=lambda r: r[:2]):
        if out and run[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], run[1])
            out[-1][2] += run[2]
        else:
            out.append(run)
    for r in out:
        while not _begins(raw, r[0]):
            r[0] += 1
        while not _begins(raw, r[1]):
            r[1] -= 1
    return out


def _cut(min_run: int):
    def of(text: str | None, sides) -> tuple:
        if text is None:
            return None, 0, []
        raw = text.encode()
        kept, spans, at, chars = [], [], 0, 0
        for start, end, ids in _stretches(raw, sides):
            if end - start < min_run:
                continue
            kept.append(raw[at:start].decode())
            chars += len(kept[-1])
            gone = len(raw[start:end].decode())
            spans.append({"start": chars, "end": chars + gone, "first_doc_ids": sorted(set(ids))})
            chars, at = chars + gone, end
        kept.append(raw[at:].decode())
        return "".join(kept), sum(s["end"] - s["start"] for s in spans), spans

    @F.pandas_udf(_RESULT)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, sides in batches:
            yield pd.DataFrame([of(t, s) for t, s in zip(texts, sides)], columns=["text", "removed_chars", "spans"])

    return cut


def deduplicate(docs: DataFrame, text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """The rows with a struct column SPANS: the text without repeats, removed_chars, and the spans (in characters) removed."""
    keyed = docs.withColumn(KEY, F.xxhash64(F.col("doc_id").cast("long"), F.col(text)))
    sides = durable(repeated_runs(keyed, text, min_run), "runs")  # it is read twice; a row for each end of a run
    asks = sides.groupBy("skey").agg(F.collect_set("ask").alias("asks"))
    # the texts are dealt by KEY here and below; a hash of all columns asks for them here too, so that Spark uses one exchange for both
    asked = keyed.join(asks, F.col(KEY) == F.col("skey")).select("skey", F.explode(_answer()(text, "asks", F.xxhash64(*docs.columns))).alias("a"))
    answers = asked.select("skey", "a.ask", "a.beside").dropDuplicates(["skey", "ask"])
    found = sides.join(answers, ["skey", "ask"]).groupBy(KEY).agg(F.collect_list(F.struct("start", "end", "side", "sources", "beside")).alias(SPANS))
    met = keyed.join(found, KEY, "left")
    cut = _cut(min_run)(F.when(F.col(SPANS).isNotNull(), F.col(text)), F.col(SPANS))
    out = met.withColumn(SPANS, cut).drop(KEY)
    s = F.col(SPANS)
    return out.withColumn(SPANS, F.struct(F.coalesce(s["text"], F.col(text)).alias("text"), s["removed_chars"].alias("removed_chars"), s["spans"].alias("spans")))


def clean(docs: DataFrame, text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """The rows with repeats taken out of the text; n_chars, where there is one, follows."""
    columns = docs.columns
    out = deduplicate(docs.drop("n_chars"), text, min_run)
    changed = {text: F.col(f"{SPANS}.text")}
    if "n_chars" in columns:
        changed["n_chars"] = F.length(F.col(f"{SPANS}.text")).cast(dict(docs.dtypes)["n_chars"])
    return out.withColumns(changed).select(columns)
