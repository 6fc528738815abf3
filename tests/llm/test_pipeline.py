"""run() over a planted table against brute force: what goes, what stays, and what is packed of each text."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from citeforge.llm import bpe

EN = "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were".split()


def prose(rng, n, common=True):
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(3, 9))))
    return " ".join(str(rng.choice(EN)) if common and rng.random() < 0.3 else word() for _ in range(n))


def sets_of(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(31)
    rows = [(k, prose(rng, int(rng.integers(120, 260))), "en", f"s{k % 3}", 0) for k in range(60)]
    text = {r[0]: r[1] for r in rows}
    passage = prose(rng, 60)
    rows += [(100 + k, prose(rng, 80) + " " + passage + " " + prose(rng, 80), "en", "s0", 0) for k in range(4)]  # a passage that four share
    near = text[5].split()
    near[40] = "other"
    rows += [(200, text[3], "en", "s1", 0), (201, " ".join(near), "en", "s1", 0)]  # an exact and a near copy
    rows += [(300, "too short", "en", "s1", 0), (301, " ".join(["again and again"] * 60), "en", "s1", 0), (302, " ".join(w + "&&&" for w in prose(rng, 150).split()), None, "s1", 0)]
    rows += [(303, "1234 5678 " * 60, None, "s2", 0), (304, None, "en", "s2", 0), (305, "", None, None, 0)]
    rows += [(7, text[7], "en", "s1", 0)]  # a row twice
    return [(i, t, la, s, len(t or "")) for i, t, la, s, _ in rows]


def test_run_against_brute_force(spark, planted, tmp_path):
    spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r for r in planted if r[0] < 300]
    # near-duplicates by all pairs: the smallest id of each component stays
    first = {r[0]: r[0] for r in kept}
    shingles = {r[0]: sets_of(r[1]) for r in kept}
    for a, b in itertools.combinations(sorted(shingles), 2):
        both = len(shingles[a] & shingles[b])
        if 100 * both >= 80 * (len(shingles[a]) + len(shingles[b]) - both):
            first[b] = min(first[b], first[a])
    stay = {i for i, f in first.items() if i == f}
    assert {200, 201} & stay == set() and {r.doc_id for r in out} == stay
    # repeated passages by all stretches of 120 bytes: each stays in its first text only
    codec = bpe.Codec(bpe.default_path())
    seen: set[bytes] = set()
    for i in sorted(stay):
        raw = dict((r[0], r[1]) for r in kept)[i].encode()
        hit = np.zeros(len(raw), bool)
        for k in range(len(raw) - 119):
            if raw[k : k + 120] in seen:
                hit[k : k + 120] = True
        seen |= {raw[k : k + 120] for k in range(len(raw) - 119)}
        left = bytes(np.frombuffer(raw, np.uint8)[~hit]).decode()
        want = len(codec.encode([left])[0]) + 1
        rows = [r for r in out if r.doc_id == i]
        copies = sum(r[0] == i for r in kept)  # rows that share an id are one document, and all stay
        assert {r.doc_tokens for r in rows} == {want} and sum(r.length for r in rows) == copies * want, i
    ends = {}
    for r in out:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in ends.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_stage_by_stage(spark, planted):
    """What each stage does to the planted rows, on what the one before it left."""
    docs = spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        left[name] = {r.doc_id: r for r in docs.collect()}
    assert not {300, 301, 302, 303, 304, 305} & set(left["quality_rules"]) and set(range(60)) <= set(left["language_id"])
    assert {100, 101, 102, 103} <= set(left["near_dedup"]) and not {200, 201} & set(left["near_dedup"])
    cut = left["substring_dedup"]
    assert len(cut[100].text) > len(cut[101].text) + 150 and all(cut[k].n_chars == len(cut[k].text) for k in cut)
