"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeforge.llm import ann, bpe, langid, licenses, neardup, packing, quality, sharding, substring, toxicity

EN = "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no green river stone walks under seven quiet bridges while every lamp keeps burning through winter rain"
DE = "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem oder grünes Wasser fließt unter sieben stillen Brücken während jede Lampe weiter durch den Winterregen brennt und niemand schläft"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, score double, kept boolean"


def rows():
    out = [(None, None, None, None), (1, None, "en", "a"), (2, "", "en", None), (3, "  \n\t ", None, "a"), (None, EN, "en", "a"), (4, "12345 !!!", "de", "b")]
    out += [(5, EN, "en", "a"), (5, EN, "en", "a"), (6, EN, "en", "b"), (7, DE, "de", "b"), (8, " ".join([EN, DE] * 300), "en", "a"), (9, "x" * 50000, None, "a")]
    out += [(10, EN + " Licensed under CC BY-NC 4.0.", "en", "a"), (11, EN + "\n" + EN.upper(), "en", "b"), (12, DE + " <|endoftext|> ﷽ 漢字 😀", "de", "c")]
    out += [(20 + k, f"{DE if k % 2 else EN} number {k} stands idle {'idiot' if k % 3 == 0 else 'friend'}", "de" if k % 2 else "en", "a") for k in range(30)]
    return [(i, t, la, s, None if t is None else len(t), "q", 0.5, True) for i, t, la, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(20 + k, 1, int(k % 3 == 0)) for k in range(30)] + [(None, 1, 1), (5, None, None), (6, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


def counted(df):
    return df.collect()


def test_quality(docs, empty):
    got = counted(quality.assess(docs))
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[5]["kept"] and not by[5]["base_failed"]
    assert counted(quality.assess(empty)) == []
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and 5 in {r["doc_id"] for r in counted(kept)}


def test_language(docs, empty):
    net = langid.train(docs)
    by = {r["doc_id"]: r for r in counted(langid.identify(docs, net)) if r["doc_id"] is not None}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[4]["lang_pred"] == "und"
    assert by[5]["lang_pred"] == "en" and by[7]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in by.values())
    assert counted(langid.identify(empty)) == []
    assert langid.keep(docs).columns == docs.columns


def test_packing(docs, empty, spark):
    got = counted(packing.pack(docs))
    c = bpe.Codec(bpe.default_path())
    total = sum(len(c.encode([r[1] or ""])[0]) + 1 for r in rows())
    assert sum(r["length"] for r in got) == total
    assert counted(packing.pack(empty)) == []
    many = counted(packing.pack(docs.repartition(6), fan_in=2, open_windows=3))
    assert sum(r["length"] for r in many) == total


def test_bpe(docs, empty):
    got = counted(bpe.round_trip(docs))
    assert len(got) == len(rows())
    assert counted(bpe.round_trip(empty)) == []
    ids = bpe.with_ids(docs.select("doc_id", "text"))
    back = counted(bpe.decode_text(ids).where("text is not null and text <> decoded"))
    assert back == []


def test_sharding(docs, empty):
    got = counted(sharding.shard(docs))
    sizes = [sum(r["shard"] == k for r in got) for k in range(8)]
    assert sum(sizes) == len(rows()) and max(sizes) - min(sizes) <= 1
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    assert counted(sharding.shard(empty)) == []


def test_toxicity(docs, empty, labels):
    got = counted(toxicity.detect(docs, labels))
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert counted(toxicity.detect(empty, labels)) == []
    none = counted(toxicity.detect(docs, labels.limit(0)))
    assert len(none) == len(rows()) and all(r["predicted"] == 0 for r in none)


def test_near_duplicates(docs, empty):
    got = counted(neardup.link(docs, width=3, percent=85))
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["component_id"] == 5 for r in by[5] + by[6] + by[10]) and all(r["kept"] for r in by[5]) and not by[6][0]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    assert by[2][0]["component_id"] == 2 and by[2][0]["n_shingles"] == 0
    assert counted(neardup.link(empty)) == []
    assert neardup.keep(docs).columns == docs.columns


def test_substring(docs, empty):
    got = counted(substring.clean(docs))
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["text"] is None and by[2]["text"] == "" and len(by[6]["text"]) < len(EN)
    assert substring.clean(docs).columns == docs.columns
    assert counted(substring.clean(empty)) == []


def test_licences_of_licence_length(spark):
    """Whole licences with words left out and put in, twice, at both ends; below four fifths nothing is found."""
    words = {t["template"]: licenses.words_of(n) for t, (_, _, n) in zip(licenses.prepared(), licenses.TEMPLATES)}
    mit, bsd = words["mit-text"], words["bsd-2-text"]
    rows = [
        (1, "a b " + " ".join(mit)),
        (2, " ".join(bsd) + " tail " + " ".join(bsd)),
        (3, " ".join(mit[:60] + ["put", "in"] + mit[60:100] + mit[103:])),
        (4, " ".join(w if k % 9 else "x" for k, w in enumerate(mit))),
        (5, "All Rights, Reserved!"),
        (5, "All Rights, Reserved!"),
        (6, " ".join(["word"] * 20000 + mit)),
    ]
    got = {(r["doc_id"], r["template"]) for r in counted(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert {(1, "mit-text"), (2, "bsd-2-text"), (3, "mit-text"), (5, "rights-reserved"), (6, "mit-text")} <= got
    assert (4, "mit-text") not in got and len([x for x in got if x[0] == 5]) == 1


def test_licenses(docs, empty):
    got = counted(licenses.scan(docs))
    assert [(r["doc_id"], r["template"]) for r in got] == [(10, "cc-by-nc-notice")]
    assert counted(licenses.scan(empty)) == []


def test_neighbours(spark):
    v = [(k, [1.0, float(k), 0.5]) for k in range(0, 120, 10)] + [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 1.0]), (204, [1.0]), (0, [1.0, 0.0, 0.5]), (None, [1.0, 1.0, 1.0])]
    v += [(300 + k, [1.0, 0.0, 0.5]) for k in range(7)]
    df = spark.createDataFrame([(i, x, 1, 0.0) for i, x in v], "vec_id long, embedding array<float>, label int, score double")
    got = counted(ann.nearest(df))
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [(1, 300), (2, 301), (3, 302), (4, 303), (5, 304)]
    assert {r["query_id"] for r in got} == {0, 50, 100, 300}
    assert counted(ann.nearest(df.limit(0))) == []


def test_pipeline_stages_keep_columns(spark, docs, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, empty, "").count() == 0, name
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and F is not None
