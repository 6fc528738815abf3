"""Bounded-space online packing of token sequences.

Each partition keeps `open_windows` open sequences. A document's ids (then one end id) are cut into whole
sequences; what remains is placed best-fit: into the open sequence that it fills most. When it fits in none,
the fullest open sequence is topped up with the head of the piece (if at least `min_cut` ids fit) and emitted,
and the rest opens or joins another. At the end, the pieces of the open sequences, at most
open_windows * seq_len ids a partition, are merged: groups of `fan_in` partitions at a time pack their
leftovers in the same way, until one group is left, which joins its pieces end to end and cuts them, so that
only the last sequence of all is padded.

Cases: a null or empty text is its end id alone; very long texts fill many sequences; repeated rows are packed
each; null ids stay null; an empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.llm.bpe import codec, default_path
from citeforge.llm.common import durable

SEQ_LEN, END_ID = 2048, 1
OPEN_WINDOWS, MIN_CUT, FAN_IN = 32, 16, 64

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, level int, part long, ids binary"
OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Open sequences of one partition. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, level: int, part: int, seq_len: int, open_windows: int, min_cut: int):
        self.level, self.part, self.seq_len, self.open_windows, self.min_cut = level, part, seq_len, open_windows, min_cut
        self.open: list[list] = []
        self.fill: list[int] = []
        self.emitted = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        sequence = (self.level << 56) | (self.part << 28) | self.emitted
        self.emitted += 1
        at = 0
        for doc_id, start, doc_tokens, ids in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, sequence, at, -1, self.part, None))
            at += len(ids)

    def place(self, piece: tuple) -> None:
        doc_id, start, doc_tokens, ids = piece
        while len(ids) >= self.seq_len:
            self.emit([(doc_id, start, doc_tokens, ids[: self.seq_len])])
            start, ids = start + self.seq_len, ids[self.seq_len :]
        while len(ids):
            n = len(ids)
            best = max((k for k, f in enumerate(self.fill) if f + n <= self.seq_len), key=self.fill.__getitem__, default=-1)
            if best < 0 and len(self.open) < self.open_windows:
                self.open.append([])
                self.fill.append(0)
                best = len(self.open) - 1
            if best >= 0:
                self.open[best].append((doc_id, start, doc_tokens, ids))
                self.fill[best] += n
                if self.fill[best] == self.seq_len:
                    self.close(best)
                return
            fullest = max(range(len(self.fill)), key=self.fill.__getitem__)
            room = self.seq_len - self.fill[fullest]
            if room >= self.min_cut:
                self.open[fullest].append((doc_id, start, doc_tokens, ids[:room]))
                start, ids = start + room, ids[room:]
            self.close(fullest)

    def close(self, k: int) -> None:
        self.emit(self.open.pop(k))
        self.fill.pop(k)

    def leftovers(self) -> None:
        """The pieces still open go on to the next level, with their ids."""
        for pieces in self.open:
            for doc_id, start, doc_tokens, ids in pieces:
                self.rows.append((doc_id, start, len(ids), 0, doc_tokens, 0, 0, self.level + 1, self.part, ids.tobytes()))
        self.open, self.fill = [], []

    def join_all(self, pieces: list) -> None:
        """The last merge: end to end, cut at each seq_len."""
        now, fill = [], 0
        for doc_id, start, doc_tokens, ids in pieces:
            while len(ids):
                head = ids[: self.seq_len - fill]
                now.append((doc_id, start, doc_tokens, head))
                fill, start, ids = fill + len(head), start + len(head), ids[len(head) :]
                if fill == self.seq_len:
                    self.emit(now)
                    now, fill = [], 0
        if now:
            self.emit(now)

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])
        return out.astype({"doc_id": "Int64", "start": "int64", "length": "int64", "ids_crc32": "int64", "doc_tokens": "int64", "sequence_id": "int64", "offset": "int64", "level": "int32", "part": "int64"})


def pack(docs: DataFrame, text: str = "text", path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path or default_path())
        p = Packer(0, TaskContext.get().partitionId(), seq_len, open_windows, min_cut)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for doc_id, t in zip(batch["doc_id"].astype("Int64").tolist(), batch["text"].tolist()):
                ids = np.concatenate([c.encode([t or ""])[0], end])
                p.place((doc_id, 0, len(ids), ids))
                if len(p.rows) > 20_000:
                    yield p.take()
        p.leftovers()
        yield p.take()

    def merge(level: int, last: bool):
        def of_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            p = Packer(level, int(key[0]), seq_len, open_windows, min_cut)
            group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
            pieces = [(d, s, n, np.frombuffer(b, dtype="<u4")) for d, s, n, b in zip(group["doc_id"].astype("Int64").tolist(), group["start"].tolist(), group["doc_tokens"].tolist(), group["ids"])]
            if last:
                p.join_all(pieces)
            else:
                for piece in pieces:
                    p.place(piece)
                p.leftovers()
            return p.take()

        return of_group

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    at = durable(narrow.mapInPandas(first, PIECE), "pack")
    done = [at.filter("level < 0").select(OUT)]
    groups, level = (at.filter("level > 0").agg(F.max("part")).first()[0] or 0) + 1, 1
    while True:
        groups = -(-groups // fan_in)
        open_pieces = at.filter(F.col("level") == level).withColumn("part", F.floor(F.col("part") / fan_in))
        at = durable(open_pieces.groupBy("part").applyInPandas(merge(level, groups == 1), PIECE), "pack")
        done.append(at.filter("level < 0").select(OUT))
        if groups == 1:
            break
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


