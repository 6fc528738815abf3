"""Parts of the job that an earlier version left out."""

import types

import numpy as np
import pandas as pd
import pytest

from citeforge.llm import ann, langid, neardup, quality, substring


@pytest.mark.parametrize("spread", [0.005, 0.1])
def test_neighbours_in_a_crowd(spread):
    """A third of the rows stands around one centre; their neighbours are found as well as all others."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12000, 64))
    hot = rng.random(len(x)) < 1 / 3
    x[hot] = rng.normal(size=64) + spread * rng.normal(size=(hot.sum(), 64))
    u, ids = ann._unit(x), np.arange(0, len(x), 50)
    books = ann.Codebooks.fit(u[:4096], rounds=2)
    codes, norms = zip(*[books.encode(u[at : at + 1024]) for at in range(0, len(u), 1024)])
    rows = pd.DataFrame({"vec_id": np.arange(len(x)), "v": list(x), "codes": [c.tobytes() for c in np.concatenate(codes)], "norm": np.concatenate(norms)})
    out = pd.concat(ann._scan(types.SimpleNamespace(value=(ids, u[ids], books)), 5, ann.RERANK)(iter([rows])))
    score = u[ids] @ u.T
    score[np.arange(len(ids)), ids] = -2
    for i, found in zip(ids, score):
        assert set(out[out.query_id == i].vec_id) == set(np.argsort(-found)[:5])


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours_of_many_tasks(spark, parts):
    """The same neighbours however rows are dealt to tasks and queries to blocks; ties go to the smaller id."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24)).round(3)
    x[1000:2000] = x[0] + 0.02 * rng.normal(size=(1000, 24)).round(2)
    x[2500:2510] = x[50]
    rows = ann.usable(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(parts))
    books = ann.Codebooks.fit(ann._unit(x[:1500]), rounds=2)
    index = ann.build_index(rows, books).cache()
    got = {}
    for r in ann.search(index, index.where("vec_id % 50 = 0").select("vec_id", "v"), books, query_block=25).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    u = ann._unit(x)
    score = np.stack([ann.exact_cosine(np.broadcast_to(u[k], u.shape), u) for k in range(0, 3000, 50)])
    for k, row in zip(range(0, 3000, 50), score):
        row[k] = -2
        assert [got[k][r] for r in range(1, 6)] == np.lexsort((np.arange(3000), -row))[:5].tolist()


def _words(rng, n):
    return " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n))


def test_planted_passages(spark):
    """Passages of 51 words inside different documents are cut out whole, and nothing else."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for k in range(60):
        passage = " ü" + _words(rng, 51) + "é "
        rows.append((k, _words(rng, 40 + k) + passage + _words(rng, 60)))
        a, b = _words(rng, 30) + "!", "?" + _words(rng, 45 + k)
        rows.append((1000 + k, a + passage + b))
        want[1000 + k] = a + b
    got = {r["doc_id"]: r["text"] for r in substring.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == t for i, t in rows if i < 1000)
    assert got.items() >= want.items()


def test_chunks_of_segments(monkeypatch):
    """The same ends wherever a long text is divided; an insertion moves only the ends beside it; repeated bytes are divided."""
    raw = _words(np.random.default_rng(3), 4000).encode()
    whole = substring.chunk_ends([raw])[0]
    assert whole[-1] == len(raw) and np.diff(whole, prepend=0).max() <= substring.MAX_CHUNK and len(whole) < len(raw) / 30
    shifted = substring.chunk_ends([raw[:9000] + b"inserted" + raw[9000:]])[0]
    assert len(set(whole[whole > 9200] + 8) - set(shifted)) == 0 and set(whole[whole < 8900]) <= set(shifted)
    monkeypatch.setattr(substring, "SEGMENT", 1000)
    assert (whole == substring.chunk_ends([b"before", raw, b""])[1]).all()
    assert substring.chunk_ends([b"x" * 1000])[0].tolist()[-3:] == [516, 772, 1000] or np.diff(substring.chunk_ends([b"x" * 1000])[0], prepend=0).max() <= substring.MAX_CHUNK


def _shared(rows, width):
    """Brute force: of each row the bytes that lie in a stretch of `width` which an earlier row, or its own text before, holds."""
    seen, out = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        hit = np.zeros(len(raw), bool)
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                hit[k : k + width] = True
            seen.add(raw[k : k + width])
        out[i] = hit
    return out


def test_substring_by_brute_force(spark):
    """Passages copied into other texts, twice into one, at both ends and over each other: what is cut are the stretches that brute force finds."""
    rng = np.random.default_rng(17)
    pool = [_words(rng, int(rng.integers(30, 90))) + " ä" for _ in range(12)]
    rows = []
    for k in range(80):
        parts = [_words(rng, int(rng.integers(5, 60))) for _ in range(3)]
        for p in rng.choice(len(pool), int(rng.integers(0, 4))):
            parts.insert(int(rng.integers(0, len(parts) + 1)), pool[p])
        rows.append((k, " ".join(parts)))
    rows += [(200, rows[7][1]), (201, rows[9][1][:400] + rows[11][1][-300:]), (202, None), (203, ""), (200, rows[7][1])]
    want = _shared(sorted(set(rows[:-3]), key=lambda r: r[0]), substring.MIN_RUN)
    out = spark.createDataFrame(rows, "doc_id long, text string").transform(substring.deduplicate).collect()
    texts, lost, extra, total = dict(rows), 0, 0, 0
    for r in out:
        raw, spans = r["text"], r[substring.SPANS]["spans"]
        if not raw:
            assert r[substring.SPANS]["text"] == raw and not spans
            continue
        cut = np.zeros(len(raw.encode()), bool)
        for s in spans:
            b, e = len(raw[: s["start"]].encode()), len(raw[: s["end"]].encode())
            cut[b:e] = True
            piece = raw.encode()[b:e]
            sources = [texts[i].encode() for i in s["first_doc_ids"]]
            assert all(i <= r["doc_id"] for i in s["first_doc_ids"])
            stands = [any(piece[k : k + 20] in t for t in sources) for k in range(len(piece) - 19)]
            assert np.mean(stands) > 0.9
        lost += int((want[r["doc_id"]] & ~cut).sum())
        extra += int((cut & ~want[r["doc_id"]]).sum())
        total += int(want[r["doc_id"]].sum())
    assert total > 10000 and lost < 0.01 * total and extra < 0.01 * total, (lost, extra, total)


def test_quality_without_common_words(spark):
    """Random words go; clean texts stay, those of a language that has no common words too."""
    rng = np.random.default_rng(11)

    def prose(words, share):
        return " ".join(rng.choice(words) if rng.random() < share else _words(rng, 1) for _ in range(120))

    en, de = "the of and to in is that for it as".split(), "der die das und den von zu mit sich auf".split()
    rows = [(k, prose(en, 0.25), "en") for k in range(20)] + [(20 + k, prose(de, 0.25), "de") for k in range(20)]
    junk = [(100 + k, prose(en, 0), None) for k in range(5)]
    of = lambda rows: {r["doc_id"] for r in quality.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert of(rows + junk) == set(range(40))
    assert of([(k, prose(en, 0), "xx") for k in range(5)]) == set(range(5))


def test_quality_rejects_what_is_far(spark):
    """Shuffled letters, base64, a script that no reference has, symbols between words and word tables go; clean texts stay."""
    import base64

    rng = np.random.default_rng(23)
    common = {"en": "the of and to in is that for it as with was".split(), "de": "der die das und den von zu mit sich auf ist nicht".split()}

    def prose(lang, n=150):
        return " ".join(rng.choice(common[lang]) if rng.random() < 0.25 else _words(rng, 1) + ("." if rng.random() < 0.1 else "") for _ in range(n))

    clean = [(k, prose("de" if k % 2 else "en"), "de" if k % 2 else "en") for k in range(60)]
    text = clean[0][1]
    words = text.split()
    junk = [
        " ".join("".join(rng.permutation(list(w))) + "x" for w in words),
        " ".join(base64.b64encode(rng.bytes(30)).decode() for _ in range(80)),
        " ".join("".join(map(chr, rng.integers(0x430, 0x450, 6))) for _ in range(80)),
        " ".join(w + "&&&" for w in words),
        " | ".join(_words(rng, 1) for _ in range(150)),
    ]
    rows = clean + [(100 + k, t, None) for k, t in enumerate(junk)] + [(200, text[:250], None)]
    out = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert np.mean([out[k]["kept"] for k, _, _ in clean]) > 0.9
    assert [out[100 + k]["kept"] for k in range(len(junk))] == [False] * len(junk)
    assert not any(out[100 + k]["base_failed"] for k in range(len(junk)))


def test_language_bounds(spark):
    """Without a model texts with letters stay; more languages than the bound are an error."""
    plain = spark.createDataFrame([(1, "some words", None), (2, "123 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in langid.keep(plain).collect()] == [1]
    many = spark.createDataFrame([(k, "some words", f"l{k // 8}") for k in range(8 * (langid.MAX_LANGUAGES + 1))], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.training_windows(many)


@pytest.fixture
def no_broadcast(spark):
    """Spark broadcasts only what it is told to, as with large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _copies(spark):
    """Texts of which some are near copies under other ids; null, negative and shared ids."""
    rng = np.random.default_rng(9)
    rows = [(k - 20, _words(rng, 60)) for k in range(200)]
    rows += [(1000 + k, t + " more") for k, t in rows[::5]] + [(None, rows[0][1]), (3, rows[7][1]), (5000, ""), (5001, None)]
    return spark.createDataFrame(rows, "doc_id int, text string").repartition(3)


def test_kept_documents_are_not_shuffled(spark, no_broadcast):
    plan = neardup.keep(_copies(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("most", [1 << 30, 64])
def test_more_ids_than_a_broadcast_takes(spark, no_broadcast, monkeypatch, most):
    docs = _copies(spark)
    rows = lambda df: sorted(map(str, df.collect()))
    links, kept = rows(neardup.link(docs)), rows(neardup.keep(docs))
    assert len(kept) == docs.count() - 42  # 40 near copies, and both rows of an id of which one is a copy
    monkeypatch.setattr(neardup, "BROADCAST_NODES", 0)
    monkeypatch.setattr(neardup, "MOST_BITS", most)
    assert rows(neardup.link(docs)) == links and rows(neardup.keep(docs)) == kept


def test_bitmap_of_ids(spark):
    ids = spark.range(-30_000, 30_000, 3).withColumnRenamed("id", "x")
    docs = spark.range(-60_000, 60_000).unionAll(spark.sql("select cast(null as long)"))
    seen = neardup._marked(docs, "id", ids, 20_000).collect()
    among = {r.id: r[neardup.MAY] for r in seen}
    assert len(seen) == len(among) == 120_001 and among[None] is False
    assert all(among[k] for k in range(-30_000, 30_000, 3))  # none of the ids is missed
    assert sum(among.values()) - 20_000 < 0.08 * 100_000  # and few others pass
