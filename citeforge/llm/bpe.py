"""Byte-level BPE encoding and decoding with the `tokenizers` library over Arrow batches.

The library encodes each distinct pre-token once per worker, while its results are kept; texts are put together
from those results, which gives the ids of encoding the whole text, as byte-level BPE never merges across
pre-tokens. Pre-tokens are found with a Latin-1 regular expression where a text has no other characters, and
with the published pattern otherwise. The vocabulary's path is a parameter; nothing is trained or copied.

A vocabulary is a file of the library (.json) or of ranks (.tiktoken); from ranks the library's model is built: each token of
several bytes is the merge of the two that ranks before its own make of it.

Byte-to-character mapping: byte-level vocabularies spell each byte as one printable character. `byte_table`
is that mapping, read backwards for decoding; ids decode to bytes, so a character that is split over two ids
is whole again once the bytes are joined (`decode_bytes`), and `decode_text` replaces only what is not UTF-8.

Cases: null text gives no ids (n_tokens 0); empty text the same; the strings of special tokens are ordinary
text; repeated rows give repeated results; texts are never cut.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens that a worker keeps; beyond it, it starts afresh (a bound on memory, not on results).
CACHE_ENTRIES = 500_000
#: Pre-tokens longer than this are encoded but not kept.
CACHE_CHARS = 64

_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: The published pattern for texts of Latin-1 characters, where its Unicode classes are these few ranges.
LATIN1 = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_NOT_LATIN1 = re.compile("[^\x00-\xff]")


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = 256 + n
    return {chr(c): b for b, c in chars.items()}


class Pretokens(dict):
    """The ids of pre-tokens as little-endian bytes; those not held are encoded when asked for."""

    def __init__(self, tokenizer, spell):
        super().__init__()
        self.tokenizer, self.spell = tokenizer, spell

    def __missing__(self, part: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([self.spell(part)], add_special_tokens=False)[0].ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[part] = raw
        return raw


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: a line for each, base64 and number."""
    with open(path, "rb") as lines:  # a file of the Python environment that every executor has
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the ranks below its own leave of a token."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        pairs = [ranks.get(a + b, len(ranks) + 256) for a, b in zip(parts, parts[1:])]
        at = min(range(len(pairs)), key=pairs.__getitem__)
        if pairs[at] >= ranks[token]:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], b"".join(parts[1:])


class Codec:
    """Encoder and decoder of one vocabulary file; one per Python worker (`codec`)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer, models

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        table = byte_table()
        if path.endswith(".tiktoken"):
            ranks, char = read_ranks(path), {b: c for c, b in table.items()}
            spelled = lambda raw: "".join(map(char.__getitem__, raw))
            merges = [tuple(map(spelled, merge_of(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda r: r[1]) if len(t) > 1]
            # a pre-token that is itself a token is that token, whatever its merges
            self.tokenizer = Tokenizer(models.BPE(vocab={spelled(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
            self.kept = Pretokens(self.tokenizer, lambda part: spelled(part.encode()))
            self.bytes_of = [b""] * (max(ranks.values()) + 1)
            for token, i in ranks.items():
                self.bytes_of[i] = token
        else:
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True
            self.kept = Pretokens(self.tokenizer, str)
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.bytes_of = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                self.bytes_of[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.sizes = np.array(list(map(len, self.bytes_of)), np.int64)

    def pretokens(self, text: str) -> list[str]:
        return (self.pattern if _NOT_LATIN1.search(text) else LATIN1).findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit arrays."""
        held = self.kept.__getitem__
        return [np.frombuffer(b"".join(map(held, self.pretokens(text))), dtype="<u4") for text in texts]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids) -> np.ndarray:
        """Where each id's bytes begin in the text's UTF-8 bytes, and at last their number."""
        return np.append(0, np.cumsum(self.sizes[np.asarray(ids, np.int64)]))


#: Names that no table is likely to have.
ENCODED, DECODED = "__citeforge_encoded", "__citeforge_decoded"
_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def with_ids(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds `ids` (array<int>) and `byte_offsets` (array<long>, one more than ids) to every row."""

    @F.pandas_udf("struct<ids:array<int>,byte_offsets:array<long>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path or default_path())
        for texts in batches:
            ids = c.encode(texts.fillna("").tolist())
            yield pd.DataFrame({"ids": [i.astype(np.int32) for i in ids], "byte_offsets": [c.offsets(i.tolist()) for i in ids]})

    return df.withColumn(ENCODED, encode(F.col(text))).select(*[c for c in df.columns if c not in ("ids", "byte_offsets")], f"{ENCODED}.ids", f"{ENCODED}.byte_offsets")


def decode_text(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds `decoded_bytes` and `decoded` (what isn't UTF-8 becomes U+FFFD); null ids give nulls."""

    @F.pandas_udf("struct<decoded_bytes:binary,decoded:string>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path or default_path())
        for rows in batches:
            raw = [None if r is None else c.decode_bytes(list(r)) for r in rows]
            yield pd.DataFrame({"decoded_bytes": raw, "decoded": [None if r is None else r.decode("utf-8", "replace") for r in raw]})

    return df.withColumn(DECODED, decode(F.col(ids))).select(*[c for c in df.columns if c not in ("decoded_bytes", "decoded")], f"{DECODED}.decoded_bytes", f"{DECODED}.decoded")


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded by the ranks, then decoded again; offsets_crc32 of the ids' byte
    offsets (and the number of bytes at last) as little-endian 64-bit numbers, and n_inside, the ids that begin inside a character."""

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string,offsets_crc32:long,n_inside:long>")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path or ranks_path())
        names = [str(i) for i in range(len(c.bytes_of))]
        for texts in batches:
            rows = []
            for text in texts:
                ids = c.encode([text or ""])[0]
                at, ids = c.offsets(ids), ids.tolist()
                said, raw = " ".join(map(names.__getitem__, ids)).encode(), c.decode_bytes(ids)
                inside = int((np.frombuffer(raw, np.uint8)[at[:-1]] & 0xC0 == 0x80).sum()) if ids else 0
                rows.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(raw).hexdigest(), zlib.crc32(at.astype("<i8").tobytes()), inside))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "offsets_crc32", "n_inside"])

    return df.select("doc_id", digest(F.col(text)).alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256", "d.offsets_crc32", "d.n_inside")
