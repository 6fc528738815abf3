"""Rules that plain SQL cannot express, on small inline tables."""

import math

import pytest
from pyspark.sql import functions as F

from citeforge.config import Settings
from citeforge.functions import matching
from citeforge.functions import text as T
from citeforge.operators import chunking, generation, ingest, judging, lookup, metrics, references, retrieval, verify
from citeforge.plans.fixtures import frame
from citeforge.sources import tables, transports
from citeforge.streaming import guard


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'string'}" for n in names)).select(column.alias("x")).first()["x"]


def test_answer_sentences(spark):
    s = "1. Rivers bend, e.g. here vs. there by 3.5 m. Lamps burn (see Fig. 2) at night!\n* 第一句話說明河流會彎曲。短句。"
    got = one(spark, T.sentences_answer(F.col("t")), t=s)
    assert got[0].startswith("Rivers bend, e.g. here vs. there by 3.5 m.") and got[1].startswith("Lamps burn (see Fig. 2)") and "短句。" not in got


@pytest.mark.parametrize(
    "statement, quote, passage, heading, route",
    [
        ("The lamps improved sleep", "", "We will compare sleep outcomes.", "Results", "wording"),
        ("The lamps are expected to improve sleep", "", "We will compare sleep outcomes.", "Results", None),
        ("Lamps are bright", "", "Plain words.", "Method > Hypotheses", "structural"),
        ("Lamps make people sleep longer", "", "H1: Lamps make people sleep longer at night.", "Method", "inline"),
        ("Lamps are bright", "", "Lamps are bright.", "Results", None),
    ],
)
def test_plan_route(spark, statement, quote, passage, heading, route):
    assert one(spark, verify.plan_route(F.col("s"), F.col("q"), F.array("p"), F.array("h")), s=statement, q=quote, p=passage, h=heading) == route


@pytest.mark.parametrize("s, cited, fires", [("這證明河流會彎", "Rivers may bend", True), ("這並未證明河流會彎", "Rivers may bend", False), ("這證明河流會彎", "This demonstrates that rivers bend", False), ("河流可能會彎", "Rivers bend", False)])
def test_zh_overclaim(spark, s, cited, fires):
    assert one(spark, verify.zh_overclaim(F.col("s"), F.array("c")), s=s, c=cited) is fires


@pytest.mark.parametrize("s, out", [("Rivers were Longer and More calm than lamps", "Rivers were Longer and Less calm than lamps"), ("Rivers can bend", "Rivers cannot bend"), ("Rivers bend", None), ("It is so", "It is not so")])
def test_negate(spark, s, out):
    assert one(spark, judging.negate(F.col("s")), s=s) == out


@pytest.mark.parametrize("s, out", [("Rain is positively associated with mud", "Rain is shown to directly cause mud"), ("It may rain", "It will always rain"), ("Data suggest that it suggests that", "Data prove that it suggests that"), ("It seems to rain", "It is proven to rain"), ("Rain", None)])
def test_overclaim(spark, s, out):
    assert one(spark, judging.overclaim(F.col("s")), s=s) == out


def test_quote_levels(spark):
    rows = spark.createDataFrame([(1, "Rivers  do “bend” here", 'x rivers do "bend" here y'), (2, "rivers do bend slowly over the wide green plains", "rivers do bend slowly over the wide grean plains"), (3, "nothing of the kind stands anywhere", "rivers bend"), (4, " . ", "rivers")], "k int, quote string, passage string")
    got = {r["k"]: r["status"] for r in verify.quote_status(rows, ["k"]).collect()}
    assert got == {1: "verbatim", 2: "near", 3: "not_found", 4: "missing"}
    assert matching.block_share("abcdefghij", "xxabcdefghijxx") == 1.0 and matching.block_share("", "a") == 0.0


def test_answers_and_claims(spark):
    by = {r["query_id"]: r for r in generation.parse_answers(frame(spark, "answers")).collect()}
    assert by[2]["refused"] and not by[3]["refused"] and by[3]["claims"][0]["quote"] == "lamps burn" and by[3]["claims"][0]["citation_ids"] == ["a"]
    assert by[4]["misplaced_refusal"] and by[4]["refused"] and by[6]["parse_failed"] and by[5]["claims"][0]["statement"] == "Open claim without an end"
    assert by[7]["claims"][0]["quote"] == "" and "</quote>" not in by[7]["claims"][0]["statement"] and by[7]["unsupported_note"] == "more"


def test_verify_claims_cascade(spark):
    claims = spark.createDataFrame([(1, 0, "Rivers bend", ["a"], "rivers bend in the plain"), (1, 1, "Lamps burn brightly tonight", ["a"], "lamps burn brightly all night"), (1, 2, "Made up", ["a"], "this was never written in any of these")], "query_id int, claim_idx int, statement string, citation_ids array<string>, quote string")
    passages = spark.createDataFrame([(1, "a", "Rivers bend in the plain.", "Results", 1), (1, "b", "Lamps burn brightly all night.", "Results", 2)], "query_id int, chunk_id string, text string, heading string, rank int")
    by = {r["claim_idx"]: r for r in verify.verify_claims(claims, passages).collect()}
    assert by[0]["quote_check"] == "verbatim" and by[0]["label"] == "supported"
    assert by[1]["citation_ids"] == ["b"] and by[1]["repaired_from"] == ["a"]
    assert by[2]["label"] == "unsupported" and by[2]["method"] == "quote"


def test_judges_without_votes_are_disputed(spark):
    pairs = spark.createDataFrame([(1, "a b", "text")], "item_id int, statement string, passage string")
    votes = spark.createDataFrame([], "item_id int, judge string, label string")
    r = verify.judge(pairs, votes, 2).first()
    assert (r["label"], r["method"]) == ("disputed", "none")
    assert verify.judge(pairs, None, 0).first()["method"] == "lexical"


def test_hypothesis_match_and_echo(spark):
    rows = spark.createDataFrame([(1, "Lamps make people sleep longer at night", ["Streets are quiet in the early winter."], [("Lamps make people sleep longer at night.", "Hypotheses")])], "item_id int, statement string, cited array<string>, context array<struct<text:string,heading:string>>")
    assert verify.hypothesis_match(rows).first()["matches"]
    same = spark.createDataFrame([("Lamps make people sleep longer", "Do lamps make people sleep longer?"), ("Streets", "Why do lamps burn?")], "statement string, question string")
    assert [r["echoes"] for r in verify.echo(same).collect()] == [True, False]


def test_audit(spark):
    refs = references.parse_references(frame(spark, "refs"))
    texts = spark.createDataFrame([(1, "See (Alder, 2019; Oakley, 2019). Pinewod (2017) and Tamarack (2014) differ from Cedar (1999).")], "doc_id long, text string")
    kinds = {r["surname"]: r["kind"] for r in references.audit_author_year(texts, refs).collect()}
    assert kinds == {"Oakley": "missing", "Pinewod": "misspelling", "Tamarack": "missing", "Cedar": "year_mismatch"}
    numbers = references.numbered_citations(spark.createDataFrame([(1, "[1-3] then [6, 8–9]")], "doc_id long, text string"))
    assert [r["number"] for r in numbers.orderBy("position").collect()] == [1, 2, 3, 6, 8, 9]


def test_reference_splits(spark):
    numbered = [(1, 0, "1. Alder J. Rivers."), (1, 1, "2019;14:1"), (1, 2, "2. Birch K. Lamps."), (1, 3, "12. ed. of a list"), (1, 4, "3."), (1, 5, "Cedar M. Stones-"), (1, 6, "and more"), (1, 7, "Copyright © nobody"), (1, 8, "4. Never read")]
    authors = [(2, 0, "Alder, J. (2019). Rivers and"), (2, 1, "their bridges."), (2, 2, "Birch, K., Elm, L.,"), (2, 3, "Fir, M. (2020). Lamps."), (2, 4, "van Berg, A. (2015). Low land."), (2, 5, "Conflict of Interest: none")]
    lines = spark.createDataFrame(numbered + authors, "doc_id long, idx int, text string")
    got = {(r["doc_id"], r["ordinal"]): r["raw"] for r in references.split_entries(lines).collect()}
    assert got == {
        (1, 1): "Alder J. Rivers. 2019;14:1", (1, 2): "Birch K. Lamps. 12. ed. of a list", (1, 3): "Cedar M. Stonesand more",
        (2, 1): "Alder, J. (2019). Rivers and their bridges.", (2, 2): "Birch, K., Elm, L., Fir, M. (2020). Lamps.", (2, 3): "van Berg, A. (2015). Low land.",
    }


@pytest.mark.parametrize("change, s, out", [
    (judging.change_number, "In 2019 we saw 12 of Table 3", "In 2019 we saw 27 of Table 3"),
    (judging.change_number, "Figure 2 has r = 0.45 here", "Figure 2 has r = 0.82 here"),
    (judging.change_number, "It rose by 3.5 points", "It rose by 3.1 points"),
    (judging.change_number, "Study 2 of 1999", None),
    (judging.plan_to_result, "H1a: Rivers will reduce mud", "The results showed that rivers reduced mud"),
    (judging.plan_to_result, "We expect that lamps will be lit", "The results showed that we expect that lamps were lit"),
    (judging.plan_to_result, "VR will not improve sleep", "The results showed that VR did not improve sleep"),
    (judging.plan_to_result, "Participants will be recruited", None),
    (judging.plan_to_result, "It will carry on as people will show", "The results showed that it carried on as people will show"),
    (judging.attribution_swap, "Alder et al. (2019) found that rivers bend", "This study found that rivers bend"),
    (judging.attribution_swap, "Notably, rivers were shown to bend (Alder, 2019)", "In this study, rivers were shown to bend"),
    (judging.attribution_swap, "Studies found that rivers bend (Alder, 2019)", None),
    (judging.attribution_swap, "We found that rivers bend (Alder, 2019)", None),
    (judging.attribution_swap, "Alder (2019) found, as Birch and colleagues did, that rivers bend", None),
])
def test_changes(spark, change, s, out):
    assert one(spark, change(F.col("s")), s=s) == out


def test_far_passages_and_turns(spark):
    chunks = spark.createDataFrame([(1, k, f"c{k}", n, t) for k, (n, t) in enumerate([("1", "Rivers bend slowly over plains."), ("1.2", "Rivers bend again in every plain."), ("2", "Lamps burn at night and many people sleep well under them when winter comes again. Short one."), ("3", "Rivers bend slowly plains again.")])], "doc_id long, chunk_no int, chunk_id string, section_number string, text string")
    sentences = spark.createDataFrame([(1, 0, "Rivers bend slowly over plains.", "1.1")], "doc_id long, position int, sentence string, section_number string")
    far = judging.distant(sentences, chunks)
    assert far.first()["far_chunk"] == "c2"
    got = {r["kind"]: (r["claim"], r["gold_label"]) for r in judging.swapped(far).collect()}
    assert got["swap_passage"] == ("Rivers bend slowly over plains.", "unsupported")
    assert got["conjunction"] == ("Rivers bend slowly over plains; moreover, lamps burn at night and many people sleep well under them when winter comes again.", "partially_supported")
    options = [(0, "number"), (0, "negation"), (1, "number"), (1, "negation"), (2, "negation"), (3, "overclaim"), (3, "negation"), (9, "number"), (9, "overclaim"), (10, "overclaim"), (10, "plan_to_result"), (11, "plan_to_result"), (12, "overclaim")]
    items = spark.createDataFrame(options, "turn int, kind string")
    assert {r["turn"]: r["kind"] for r in judging.rotate(items, 4).collect()} == {0: "negation", 1: "number", 2: "negation", 3: "overclaim"}
    more = judging.top_ups(items, 4, (("overclaim", 2), ("plan_to_result", 5)))
    assert sorted((r["turn"], r["kind"]) for r in more.collect()) == [(9, "overclaim"), (10, "overclaim"), (11, "plan_to_result")]


def test_lookup(spark):
    from citeforge.plans.queries import QUERIES

    by = {r["ref_id"]: (r["stage"], r["status"]) for r in QUERIES["lookup_compare"](spark, "").collect()}
    assert by == {"r1": (1, "verified"), "r2": (2, "mismatch"), "r3": (None, "not_found"), "r4": (2, "retracted"), "r5": (3, "verified"), "r6": (3, "mismatch"), "r9": (None, "not_found")}
    assert one(spark, lookup.title_match(F.col("t"), F.col("r")), t="Quiet streets: a long and winding other story", r="Dogwood. Quiet streets") == ""


def test_headings(spark):
    lines = [(1, 0, "Title", "Heading 1"), (1, 1, "Abstract", "Heading 1"), (1, 2, "a", "Normal"), (1, 3, "2 Method", "Heading 1"), (1, 4, "Deep", "Heading 3"), (1, 5, "b", "Normal"), (1, 6, "Results", "Heading 2"), (1, 7, "c", "Normal"), (1, 8, "References", "Heading 1"), (1, 9, "Alder", "Normal")]
    rows = ingest.headings_to_paragraphs(spark.createDataFrame(lines, "doc_id long, idx int, text string, style string")).orderBy("idx").collect()
    assert [(r["text"], r["section_path"]) for r in rows] == [("a", ["Abstract"]), ("b", ["2 Method", "Deep"]), ("c", ["2 Method", "Results"])]


def test_chunks_by_hand(spark):
    paras = [(1, k, " ".join(["w"] * n), ["s"], "", 0) for k, n in enumerate([100, 150, 100, 400, 20])]
    df = spark.createDataFrame(paras, "doc_id long, idx int, text string, section_path array<string>, section_number string, page int")
    got = [(r["para_start"], r["para_end"], r["n_words"]) for r in chunking.chunk_section(df).orderBy("chunk_no").collect()]
    assert got == [(0, 1, 250), (2, 2, 100), (3, 4, 420)]
    spans = [(r["para_start"], r["para_end"]) for r in chunking.chunk_fixed(df).orderBy("chunk_no").collect()]
    assert spans == [(0, 1), (1, 2), (2, 3), (3, 3), (4, 4)]


def test_zero_score_padding(spark):
    chunks = spark.createDataFrame([(1, k, "lamp" if k == 2 else "stone") for k in range(5)], "doc_id long, chunk_no int, text string")
    asked = spark.createDataFrame([(1, "lamp"), (2, "nowhere")], "query_id int, query string")
    got = retrieval.bm25_topk(asked, retrieval.Bm25Index(retrieval.with_ordinals(chunks)), 3).orderBy("query_id", "sparse_rank").collect()
    assert [r["ordinal"] % 10 for r in got] == [2, 0, 1, 0, 1, 2]


def test_logs_and_streams(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"run":"r","key":"a","seq":1}\n{"run":"r","key":"a","seq":2}\n{"run":"s","key":"b","seq":3}\n{"run":"r","ke')
    rows = tables.read_log(spark, str(log), "run string, key string, seq long", "r")
    assert rows.count() == 2
    src = tmp_path / "in"
    data = spark.createDataFrame([("h", k, f"2024-01-01 00:00:{10 * k:02d}", 50.0 + k, 95.0 if k in (1, 2, 4) else 10.0, 1.0) for k in range(6)], "host string, seq long, ts string, cpu double, ram_pct double, swap_gb double").withColumn("ts", F.to_timestamp("ts"))
    data.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(data.schema).parquet(str(src))
    q = guard.streaks_stream(stream).writeStream.format("memory").queryName("streaks").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["streak"] for r in spark.table("streaks").orderBy("seq").collect()] == [0, 1, 2, 0, 1, 0]
    batch = {r["seq"]: r["streak"] for r in guard.guard_windows(data, 3).collect()}
    assert [batch[k] for k in range(6)] == [0, 1, 2, 0, 1, 0]
    for turn in range(2):
        guard.append_once(stream.select(F.col("seq").cast("string").alias("key")), str(tmp_path / "out"), str(tmp_path / f"cp{turn}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    q = guard.guard_stream(stream, "30 seconds").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("tumbling").collect()) == [3, 3]


def test_transports(spark):
    prompts = spark.createDataFrame([(1, "hello\nthere")], "query_id int, prompt string")
    assert generation.complete(prompts, transports.mock()).first()["raw"] == "(mock) hello there"
    urls, known = spark.createDataFrame([("http://a/x",), ("http://b/y",)], "url string"), spark.createDataFrame([("http://a/x", 200, "old")], "url string, status int, body string")
    got = transports.fetch(urls, known, transports.http_json(0.0, get=lambda u: u.upper()))
    assert {r["url"]: r["body"] for r in got.collect()} == {"http://a/x": "old", "http://b/y": "HTTP://B/Y"}


def test_failed_calls_are_rows(spark, tmp_path):
    """Failures end no task and are not kept; what is known is not asked again."""
    import urllib.error

    def get(url):
        if "gone" in url:
            raise urllib.error.HTTPError(url, 404, "", None, None)
        if "bad" in url:
            raise urllib.error.HTTPError(url, 403, "", None, None)
        return url.upper()

    urls = spark.createDataFrame([("http://a/x",), ("http://a/gone",), ("http://b/bad",)], "url string")
    path = str(tmp_path / "answers")
    got = {r["url"]: (r["status"], r["body"]) for r in transports.fetch_and_keep(urls, path, transports.http_json(0.0, get=get), str.lower).collect()}
    assert got == {"http://a/x": (200, "http://a/x"), "http://a/gone": (404, None)}
    again = transports.fetch_and_keep(urls.where("url like '%a/%'"), path, transports.http_json(0.0, get=lambda u: 1 / 0)).count()
    assert again == 2 and spark.read.parquet(path).count() == 2


def test_translations(spark):
    claims = spark.createDataFrame([(1, "河流彎曲"), (2, "Rivers bend"), (3, "燈亮")], "claim_idx int, statement string")
    say = lambda: lambda texts: ["Rivers bend" if t == "河流彎曲" else None for t in texts]
    got = {r["claim_idx"]: (r["statement"], r["original"]) for r in verify.translated(claims, say).collect()}
    assert got == {1: ("Rivers bend", "河流彎曲"), 2: ("Rivers bend", "Rivers bend"), 3: ("燈亮", "燈亮")}
    assert verify.available_judges(["a", "b"], lambda j: j == "b") == ["b"] and verify.available_judges(["a"], lambda j: j == "g", "g") == ["g"]


def test_settings(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("CITEFORGE_RRF_K=10\n# no\nCITEFORGE_PANEL_RULE='majority'\n")
    monkeypatch.setenv("CITEFORGE_RRF_K", "7")
    s = Settings.from_env(str(env))
    assert s.rrf_k == 7 and s.panel_rule == "majority"


def test_mcnemar_of_large_counts(spark):
    """One step a term, not an array a term."""
    counts = [(0, 0), (5, 0), (3, 8), (30000, 29400), (29400, 30000), (20000, 20000)]
    got = spark.createDataFrame(counts, "b long, c long").select("b", "c", metrics.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        n = r["b"] + r["c"]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(min(r["b"], r["c"]) + 1))
        assert abs(r["p"] - min(1.0, 2 * want)) < 2e-6
