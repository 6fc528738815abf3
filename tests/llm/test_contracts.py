"""The registered queries over whole small tables, held against brute force. LLM_SF_DIR names another folder of tables."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from citeforge.llm import ann, bpe, licenses, neardup, quality
from citeforge.llm.queries import QUERIES
from citeforge.llm.sql import ORACLE_SQL

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile("[^\x20\x09-\x0d]+")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
pytestmark = needs_data


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def result(spark):
    held = {}

    def of(name):
        if name not in held:
            held[name] = QUERIES[name](spark, SF).toPandas()
        return held[name]

    return of


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_base_rules(docs, result):
    got = {r.doc_id: r for r in result("op2_quality_rules").itertuples()}
    assert len(got) == len(docs)
    for d in docs:
        text = d["text"] or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d["doc_id"]]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_keeps_clean_documents(docs, result):
    out = result("op2_quality_rules")
    passed = out[~out.base_failed]
    assert passed.kept.mean() > 0.9


def test_language_held_out(docs, result):
    got = {r.doc_id: r for r in result("op3_language_id").itertuples()}
    assert len(got) == len(docs)
    right = [got[d["doc_id"]].lang_pred == d["lang"] for d in docs if d["lang"] and held_out(d["doc_id"]) and got[d["doc_id"]].lang_pred != "und"]
    assert all(got[d["doc_id"]].held_out == held_out(d["doc_id"]) for d in docs)
    assert np.mean(right) > 0.95, np.mean(right)


def test_packing(docs, result):
    out = result("op4_packing")
    c = bpe.Codec(bpe.default_path())
    text = {d["doc_id"]: d["text"] or "" for d in docs}
    pieces = defaultdict(list)
    for r in out.itertuples():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(text)
    for doc_id, rows in pieces.items():
        ids = np.append(np.array(c.tokenizer.encode(text[doc_id], add_special_tokens=False).ids, "<u4"), np.uint32(1))
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    fill = []
    for _, rows in out.groupby("sequence_id"):
        at = 0
        for r in rows.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 2048
        fill.append(at)
    assert sum(fill) / (2048 * len(fill)) > 0.99


def test_bpe_like_tiktoken(docs, result):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in result("op5_bpe").itertuples()}
    assert len(got) == len(docs)
    for d in docs:
        ids = enc.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d["text"] or "").encode()).hexdigest()
        pieces = [enc.decode_single_token_bytes(i) for i in ids]
        offsets = np.cumsum([0, *map(len, pieces)]).astype("<i8")
        assert r.offsets_crc32 == zlib.crc32(offsets.tobytes())
        assert r.n_inside == sum(p[0] & 0xC0 == 0x80 for p in pieces)


def test_sharding(docs, result):
    out = result("op6_sharding")
    assert set(out.law) == {"rows"} and out.grown_shard.isna().all()
    by = {d["doc_id"]: d for d in docs}
    assert sorted(out.doc_id) == sorted(by)
    for r in out.itertuples():
        raw = (by[r.doc_id]["text"] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    counts = out.groupby("shard").size()
    assert list(counts.index) == list(range(8)) and counts.max() - counts.min() <= 1
    for _, rows in out.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    # every source has its share in every shard
    source = out.doc_id.map(lambda i: by[i]["source"])
    mixture = out.groupby([source, "shard"]).size().unstack(fill_value=0)
    assert (mixture.max(axis=1) - mixture.min(axis=1)).max() <= 2


def test_neighbours_recall(result):
    rows = [r for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist() if r["embedding"] is not None]
    rows = [r for r in rows if all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in rows]), ann._unit(np.array([r["embedding"] for r in rows], dtype=float))
    found = result("op7_ann").sort_values(["query_id", "rank"])
    hit = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        score = x @ x[k]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[k]][:5]
        mine = found[found.query_id == ids[k]]
        assert list(mine["rank"]) == list(range(1, len(mine) + 1)) and list(mine.score) == sorted(mine.score, reverse=True)
        place = {int(i): j for j, i in enumerate(ids)}
        for r in mine.itertuples():
            assert abs(r.score - x[place[r.vec_id]] @ x[k]) < 1e-9
        total += len(order)
        hit += len({int(ids[j]) for j in order} & set(mine.vec_id))
    assert total and hit / total >= 0.9, hit / total


def test_toxicity_held_out(docs, result):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    out = result("op8_toxicity")
    assert len(out) == len(docs) and out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert all(r.held_out == held_out(r.doc_id) for r in out.itertuples())
    test = out[out.held_out & out.doc_id.isin(labels)]
    right = [labels[r.doc_id] == r.predicted for r in test.itertuples()]
    assert np.mean(right) > 0.9, np.mean(right)


def test_near_duplicates(docs, result):
    sets = {}
    for d in docs:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        sets[d["doc_id"]] = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    out = result("op9_minhash")
    assert len(out) == len(docs)
    for r in out.itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_substring_spans(docs, result):
    """Removed spans stand verbatim in the document named; what is kept is the rest."""
    out = result("op1_substring_dedup")
    text = {d["doc_id"]: d["text"] for d in docs}
    assert len(out) == len(docs)
    for r in out.itertuples():
        t = text[r.doc_id]
        rest, at = "", 0
        for s in r.spans:
            rest += t[at : s["start"]]
            at = s["end"]
        assert (rest + t[at:] if t is not None else None) == r.text
        assert r.changed == (r.removed_chars > 0)


def test_substring_finds_long_repeats(docs, result):
    """Of texts that wholly repeat an earlier one nothing long is left."""
    first = {}
    out = {r.doc_id: r for r in result("op1_substring_dedup").itertuples()}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        t = d["text"]
        if t and len(t) > 400:
            if t in first:
                assert out[d["doc_id"]].removed_chars == len(t)
            first.setdefault(t, d["doc_id"])


def test_licenses(docs, result):
    out = result("op10_license_scan")
    got = {(r.doc_id, r.template): (r.hits, r.first_word) for r in out.itertuples()}
    want = {}
    for d in docs:
        words = re.sub("[^a-z0-9]+", " ", (d["text"] or "").lower()).split()
        for t in licenses.prepared():
            wanted = set(t["shingles"])
            best = None
            for start in range(0, max(1, len(words)), t["stride"]):
                part = words[start : start + t["window"]]
                hits = len(wanted & {" ".join(part[k : k + t["width"]]) for k in range(len(part) - t["width"] + 1)})
                if hits >= t["need"]:
                    best = (max(hits, best[0]) if best else hits, best[1] if best else start)
            if best:
                want[d["doc_id"], t["template"]] = best
    assert got == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, result):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = db.execute(ORACLE_SQL[name]).df()
    got = result(name)[list(want.columns)]
    assert sorted(want.columns) == sorted(result(name).columns)
    key = list(want.columns)
    a = sorted(map(str, want[key].astype(object).where(want[key].notna(), None).itertuples(index=False)))
    b = sorted(map(str, got[key].astype(object).where(got[key].notna(), None).itertuples(index=False)))
    assert len(a) == len(b) and a == b


def test_shingles_and_references_are_used():
    assert neardup.BANDING and quality.COMMON
