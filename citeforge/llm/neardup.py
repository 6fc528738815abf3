"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of `width` words (with fewer words: the whole sequence as one), as
64-bit hashes. Fast similarity sketching fills `bands * rows` bins: in round i every shingle is thrown into one
bin with a value between i and i + 1, and a bin keeps its least value; after as many rounds as there are bins,
each round aims at one bin, so every bin fills, and coordinates agree with a chance equal to the Jaccard
similarity, concentrated around it. `rows` neighbouring coordinates are a band; documents that agree in a band are
candidates, and a pair of similarity s shares one with probability 1 - (1 - s^rows)^bands (1 - 1e-6 at the
threshold with the settings here).

Links are confirmed on the full sets. Not all pairs of a bucket are listed: equal sets are first reduced to one
representative; each bucket then compares its members with its most central one (that which shares most of its
buckets), and the components of the confirmed links are found by minimum labels. Only buckets that still hold several components go on. Among their
documents, shingles that occur in one document only are counted; a document whose other shingles are too few to
reach the threshold leaves. The others are compared, where they are of different components, in blocks of about `BLOCK`
rows, so that a bucket of any size is dealt over tasks, each pair in the first band that it shares. A pair of sketches of `FINE`
coordinates that are alike is decided at once on the full sets, which blocks hold for documents of up to `SMALL` shingles; a block
writes only links that join components (fewer than its rows), so what leaves a bucket does not grow with its pairs. Larger
documents have sketches of `LONG` coordinates there; pairs which agree in enough of them are written and confirmed
afterwards on their texts. So no link that shares a band is lost, whatever the size of a bucket.

Before its texts are read, a pair must agree in `least_agreement` of the coordinates (one byte of each is kept): by
the concentration bound a pair at the threshold has fewer with a chance below 1e-7.

Cases: documents without words or text have an empty set and link with nothing; rows that share a doc_id are one
node (its component is linked by any of its texts), each keeping its n_shingles; rows with a null doc_id take no
part: component_id is null and kept true; very long texts are hashed whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.llm.common import Durable

#: Defaults for stages of this kind: five words, similarity 0.8 or more.
WIDTH, PERCENT = 5, 80
#: (bands, rows): a pair at the threshold shares a band with probability above 1 - 1e-6.
BANDING = {80: (27, 4), 85: (24, 5)}
#: Members of a bucket that are compared with as many others at once.
BLOCK = 1024
#: Coordinates of the finer sketches that blocks compare first, shingles up to which they hold sets, and coordinates beyond.
FINE, SMALL, LONG = 512, 1024, 8192
#: Shingle sets that a worker keeps while it confirms pairs.
KEPT_SETS = 4096
#: Ids that may be broadcast to pick texts. More go to the texts as a bitmap of their hashes; only texts that it lets pass are shuffled.
BROADCAST_NODES = 500_000
#: Bits of that bitmap an id, and of the whole bitmap at most (128 MB; a fuller one lets more texts pass).
ID_BITS, MOST_BITS = 16, 1 << 30

#: Names that no table is likely to have.
GONE, MAY = "__citeforge_gone", "__citeforge_may"

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    take = min(width, len(words))
    out = np.full(n, np.uint64(take))
    for k in range(take):
        out = _mix((out + _M1) * _M3 + hashed[k : k + n])
    return np.unique(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """[documents, bins] of a batch of non-empty sets."""
    n = len(sets)
    out = np.full(n * bins, _FULL)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    for i in range(2 * bins):
        h = _mix(items + np.uint64((i + 1) * int(_M1) & int(_FULL)))
        aim = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins
        at = owner * bins + aim
        fresh = (out[at] >> np.uint64(48)) >= np.uint64(i)
        value = (np.uint64(i) << np.uint64(48)) | (_mix(h) >> np.uint64(16))
        np.minimum.at(out, at[fresh], value[fresh])
        filled = (out.reshape(n, bins) != _FULL).all(axis=1)
        if filled.all():
            break
        todo = ~filled[owner]
        items, owner = items[todo], owner[todo]
    return out.reshape(n, bins)


def least_agreement(percent: int, bins: int, miss: float = 1e-7) -> int:
    """The largest number of coordinates below which Binomial(bins, percent / 100) falls with at most chance `miss`."""
    p, below, k = percent / 100, 0.0, 0
    while True:
        below += math.exp(math.lgamma(bins + 1) - math.lgamma(k + 1) - math.lgamma(bins - k + 1) + k * math.log(p) + (bins - k) * math.log(1 - p))
        if below > miss:
            return k
        k += 1


def _agree(least: int):
    @F.pandas_udf("boolean")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).sum(axis=1) >= least)

    return agree


def _prepare(width: int, bands: int, rows: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                sets = [shingles(t, width) for t in part["text"]]
                some = [k for k, s in enumerate(sets) if len(s)]
                keys, mini = [None] * len(part), [None] * len(part)
                if some:
                    found = sketch([sets[k] for k in some], bands * rows)
                    for k, row in zip(some, _mix(found).astype(np.uint8)):
                        mini[k] = row.tobytes()
                    found = found.reshape(len(some), bands, rows)
                    key = np.tile(np.arange(bands, dtype=np.uint64), (len(some), 1))
                    for r in range(rows):
                        key = _mix((key + _M1) * _M3 + found[:, :, r])
                    for k, row in zip(some, key.view(np.int64)):
                        keys[k] = row
                two = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_shingles": [len(s) for s in sets], "s1": [int(t[0]) for t in two], "s2": [int(t[1]) for t in two], "keys": keys, "mini": mini})

    return of


def _verify(width: int, percent: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, np.ndarray] = {}

        def held(text: str) -> np.ndarray:
            if text not in kept:
                if len(kept) >= KEPT_SETS:
                    del kept[next(iter(kept))]
                kept[text] = shingles(text, width)
            return kept[text]

        for batch in batches:
            hit = [linked(held(ta), held(tb), percent) for ta, tb in zip(batch["text_a"], batch["text_b"])]
            yield batch.loc[hit, ["a", "b"]]

    return of


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that are sorted by their keys."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        edges = [0, *cut.tolist()]
        for x, y in zip(edges, edges[1:]):
            yield batch.iloc[x:y]
        rest = batch.iloc[edges[-1] :]
    if rest is not None and len(rest):
        yield rest


class _Labels:
    """Components that a block's links join."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def of(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[max(x, y)] = min(x, y)


def _links(least: int, percent: int, small: int, long: int):
    """Of a bucket's block with another: links between components (sure), and pairs of large documents that may link."""

    def sure(a: np.ndarray, b: np.ndarray) -> bool:
        """`linked` of two sorted sets."""
        if len(a) > len(b):
            a, b = b, a
        if 100 * len(a) < percent * len(b):
            return False
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["key", "low", "high"]):
            low, high, own = int(group["low"].iloc[0]), int(group["high"].iloc[0]), group["own"].to_numpy()
            key, node, label, n, shared, size = (group[c].to_numpy() for c in ("key", "node", "label", "n", "shared", "size"))
            mini = np.frombuffer(b"".join(group["fine"]), np.uint8).reshape(len(group), -1)
            more = group["more"].to_numpy()
            keys = np.stack(group["keys"].to_numpy())
            left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
            step = max(1, (8 << 20) // max(1, len(right) * mini.shape[1]))
            joined, found = _Labels(), []
            for at in range(0, len(left), step):
                i, j = left[at : at + step, None], right[None]
                most = np.minimum(shared[i], shared[j])  # of common shingles
                may = (label[i] != label[j]) & (100 * most >= percent * (n[i] + n[j] - most))
                if low == high:
                    may &= node[i] < node[j]
                if not may.any():
                    continue
                x, y = np.nonzero(may)
                if 4 * len(x) < may.size:
                    good = (mini[i[x, 0]] == mini[j[0, y]]).sum(axis=1) >= least
                    x, y = x[good], y[good]
                else:
                    x, y = np.nonzero(may & ((mini[i[:, 0], None] == mini[j[0]][None]).sum(axis=2) >= least))
                x, y = i[x, 0], j[0, y]
                same = keys[x] == keys[y]
                once = keys[x, same.argmax(axis=1)] == key[0]
                for x, y in zip(x[once].tolist(), y[once].tolist()):
                    whole = size[x] <= small, size[y] <= small
                    if all(whole):
                        a, b = joined.of(int(label[x])), joined.of(int(label[y]))
                        if a != b and sure(np.frombuffer(more[x], np.uint64), np.frombuffer(more[y], np.uint64)):
                            joined.join(a, b)
                            found.append((node[x], node[y], True))
                    elif any(whole) or (np.frombuffer(more[x], np.uint8) == np.frombuffer(more[y], np.uint8)).sum() >= long:
                        found.append((node[x], node[y], False))
            if found:
                yield pd.DataFrame(found, columns=["a", "b", "sure"])

    return of


def _fine(width: int, bins: int, small: int, long: int):
    """node, size, a sketch of `bins` coordinates, and the set itself or, above `small`, a sketch of `long` coordinates."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = [shingles(t, width) for t in part["text"]]
                found = _mix(sketch(sets, bins)).astype(np.uint8)
                more = [s.tobytes() if len(s) <= small else _mix(sketch([s], long)).astype(np.uint8).tobytes() for s in sets]
                yield pd.DataFrame({"node": part["node"], "size": [len(s) for s in sets], "fine": [row.tobytes() for row in found], "more": more})

    return of


def _single(width: int):
    """node, t (a hash of the text), size, h of every shingle."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = [shingles(t, width) for t in part["text"]]
                count = [len(s) for s in sets]
                digest = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pd.DataFrame({"node": part["node"].to_numpy().repeat(count), "t": digest.repeat(count), "size": np.repeat(count, count), "h": np.concatenate(sets).view(np.int64)}).astype("int64")

    return of


def _marked(df: DataFrame, key: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows with MAY: true where `key` is one of the n ids, and for about one in ID_BITS others; never null."""
    part, bit, bits = (f"{MAY}_{c}" for c in ("part", "bit", "bits"))
    size = min(ID_BITS * n, MOST_BITS)

    def placed(rows: DataFrame, column: str) -> DataFrame:
        h = F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(size)))
        return rows.withColumn(bit, h).withColumn(part, F.shiftright(bit, 15)).withColumn(bit, F.col(bit).bitwiseAND(32767))  # bitmaps of 32,768 bits

    held = placed(ids, ids.columns[0]).select(part, bit).repartition(part).groupBy(part).agg(F.bitmap_construct_agg(bit).alias(bits))
    met = placed(df, key).join(F.broadcast(held), part, "left")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.withColumn(MAY, F.coalesce(F.getbit(byte, F.col(bit).bitwiseAND(7).cast("int")) == 1, F.lit(False))).select(*df.columns, MAY)


class NearDuplicates:
    """One run over a table of documents; `result` is the whole answer."""

    def __init__(self, docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT, banding: tuple[int, int] | None = None, block: int = BLOCK):
        self.width, self.percent = width, percent
        self.bands, self.rows = banding or BANDING[percent]
        self.block = block
        self.least = least_agreement(percent, self.bands * self.rows)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.kept: list[Durable] = []

    def _hold(self, df: DataFrame, name: str, counted=None) -> DataFrame:
        self.kept.append(Durable(df, name, counted))
        self.rows_held = self.kept[-1].rows
        return self.kept[-1].df

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept of every row."""
        rows = self._hold(self.docs.mapInPandas(_prepare(self.width, self.bands, self.rows), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, mini binary"), "sets")
        live = rows.where("doc_id is not null and n_shingles > 0")
        first = live.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
        of_doc = self._hold(live.select("doc_id", "n_shingles", "s1", "s2").join(first, ["s1", "s2"]).select("doc_id", "node", "n_shingles", "s1", "s2"), "nodes")
        # a node's own row; rows of other texts under its id are other nodes' members
        own = self._hold(live.join(first.withColumnRenamed("node", "doc_id"), ["s1", "s2", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "keys", "mini"), "own")
        self.own = own
        members = own.select("node", F.explode("keys").alias("key"))  # a key's hash holds its band
        shared = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("top")).where("low < top").select("key")
        met = self._hold(members.join(shared, "key", "left_semi"), "buckets")  # only buckets of two or more
        central = met.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        hubs = met.join(central, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("node"))).alias("h")).select("key", (-F.col("h.node")).alias("hub"))
        edges = self._confirm(met.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
        # documents whose rows have several sets tie these together
        several = of_doc.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
        label = self._components(edges.unionAll(several))
        label = self._rest(met, label)

        named = of_doc.join(label, "node", "left").select("doc_id", "s1", "s2", F.coalesce("label", "node").alias("component"))
        named = named.groupBy("doc_id").agg(F.min("component").alias("component_id"))
        empty = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        full = live.select("doc_id", "n_shingles").join(named, "doc_id").select("doc_id", "n_shingles", "component_id")
        out = full.unionAll(empty.join(named.withColumnRenamed("component_id", "c"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "component_id").alias("component_id")))
        answer = Durable(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "components")
        for held in self.kept:  # only the answer, a few numbers a row, stays
            held.drop()
        return answer.df

    def _texts(self, nodes: DataFrame, n: int) -> DataFrame:
        """node, text of some nodes; the ids go to the texts, or a bitmap of them."""
        docs = self.docs.where("text is not null").withColumnRenamed("doc_id", "node")
        if n <= BROADCAST_NODES:
            return docs.join(F.broadcast(nodes), "node", "left_semi")
        return _marked(docs, "node", nodes, n).where(MAY).drop(MAY).join(nodes, "node", "left_semi")

    def _confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose full sets reach the threshold."""
        a, b = (self.own.select(F.col("node").alias(c), F.col("mini").alias(f"mini_{c}")) for c in "ab")
        both = pairs.distinct().join(a, "a").join(b, "b")
        return self._exact(self._hold(both.where(_agree(self.least)(F.col("mini_a"), F.col("mini_b"))).select("a", "b"), "likely"))

    def _exact(self, likely: DataFrame) -> DataFrame:
        if not self.rows_held:
            return likely
        nodes = self._hold(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
        texts = self._texts(nodes, self.rows_held)
        a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = likely.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        return self._hold(both.mapInPandas(_verify(self.width, self.percent), "a long, b long").distinct(), "edges")

    def _shared(self, nodes: DataFrame, n: int) -> DataFrame:
        """node, n, shared: the least number of shingles of its texts, and the largest number of one text's that occur in several
        of these texts, where some text of it may reach the threshold."""
        seen = self._texts(nodes, n).mapInPandas(_single(self.width), "node long, t long, size long, h long")
        once = seen.groupBy("h").agg(F.min("t").alias("t"), F.max("t").alias("other"), F.min("node").alias("node"), F.max("node").alias("last")).where("t = other and node = last")
        alone = once.groupBy("node", "t").agg(F.count(F.lit(1)).alias("alone"))
        size = seen.groupBy("node", "t").agg(F.max("size").alias("size"))
        out = size.join(alone, ["node", "t"], "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))
        out = out.groupBy("node").agg(F.min("size").alias("n"), F.max("shared").alias("shared"), F.max(100 * F.col("shared") >= self.percent * F.col("size")).alias("able"))
        return self._hold(out.where("able").select("node", "n", "shared"), "shared")

    def _components(self, edges: DataFrame, label: DataFrame | None = None) -> DataFrame:
        """node, label (the least node reachable); nodes without a link may be missing."""
        if label is not None:  # earlier components are single nodes now
            x, y = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
            edges = edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
        both = self._hold(both.distinct(), "links")
        now = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label")
        changed = self.rows_held
        while changed:
            seen = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("seen"))
            low = now.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
            jump = now.select(F.col("node").alias("label"), F.col("label").alias("next"))
            now = self._hold(low.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels", F.col("was") != F.col("label")).select("node", "label")
            changed = self.rows_held
        if label is None:
            return now
        moved = label.join(now.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
        fresh = now.join(label.select("node"), "node", "left_anti")
        return self._hold(moved.unionAll(fresh).distinct(), "labels")

    def _rest(self, met: DataFrame, label: DataFrame) -> DataFrame:
        """Links between the components that a bucket still holds."""
        named = met.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = self._hold(self._mixed(named), "mixed")
        if not self.rows_held:
            return label
        nodes = self._hold(mixed.select("node").distinct(), "mixed-nodes")
        able = mixed.join(self._shared(nodes, self.rows_held), "node")
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        able = self._hold(self._mixed(able.drop("blocks")).withColumn("own", own), "able")
        nodes = self._hold(able.select("node").distinct(), "able-nodes")
        # of a node's rows with several texts, those with words
        fine = self._texts(nodes, self.rows_held).where("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").mapInPandas(_fine(self.width, FINE, SMALL, LONG), "node long, size long, fine binary, more binary")
        able = able.join(self.own.select("node", "keys"), "node").join(fine, "node")
        dealt = able.select("key", "node", "label", "n", "shared", "size", "keys", "fine", "more", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")
        sorted_ = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        links = _links(least_agreement(self.percent, FINE), self.percent, SMALL, least_agreement(self.percent, LONG))
        found = self._hold(sorted_.mapInPandas(links, "a long, b long, sure boolean").distinct(), "links", ~F.col("sure"))
        edges = found.where("sure").select("a", "b")
        return self._components(edges.unionAll(self._exact(found.where("not sure").select("a", "b"))), label)

    def _mixed(self, named: DataFrame) -> DataFrame:
        """The members of buckets that hold more than one component, with the number of blocks of these."""
        many = named.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
        return named.join(many.select("key", F.ceil(F.col("c") / self.block).cast("int").alias("blocks")), "key")


def link(docs: DataFrame, **options) -> DataFrame:
    return NearDuplicates(docs, **options).result()


def keep(docs: DataFrame, **options) -> DataFrame:
    """One document of each group stays (that of the smallest id; rows that share its id are one document)."""
    held = Durable(link(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias(GONE)).distinct(), "gone")
    gone = held.df
    if held.rows <= BROADCAST_NODES:
        return docs.join(F.broadcast(gone), F.col("doc_id") == F.col(GONE), "left_anti")
    marked = _marked(docs, "doc_id", gone, held.rows)
    stay = marked.where(~F.col(MAY)).unionAll(marked.where(MAY).join(gone, F.col("doc_id") == F.col(GONE), "left_anti"))
    return stay.drop(MAY)
