"""The commands end to end over a small store."""

import json

import pytest

from citeforge import commands
from citeforge.config import DEFAULTS
from citeforge.functions import text as T
from citeforge.sources import tables

LINES = [
    "Rivers bend slowly over the wide green plain because the ground is soft and the water is heavy there.",
    "Lamps may burn brightly in every street at night and people sleep longer under them in the winter months.",
    "Stones were increased in number near 12 old bridges when the builders came back again after the flood.",
    "H1: Reading outdoors will reduce stress in most people who live close to noisy streets and large squares.",
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("store")
    docs = spark.createDataFrame([(1, "\n".join(LINES), "a"), (2, "Nothing of note is written in this other text.", "b"), (3, None, None)], "doc_id long, text string, source string")
    docs.write.parquet(f"{place}/documents")
    commands.build(spark, f"{place}/documents", f"{place}/store", DEFAULTS.with_(section_max=30, section_min=1, fixed_tokens=20, fixed_overlap=5))
    return f"{place}/store"


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, question string")


def test_ask_and_check(spark, store):
    found = commands.search(spark, store, asked(spark, "Why do lamps burn at night?")).orderBy("rank").collect()
    assert "Lamps may burn" in found[0]["text"] and [r["rank"] for r in found] == list(range(1, len(found) + 1))
    r = commands.ask(spark, store, asked(spark, "Why do lamps burn at night?")).first()
    assert r["answer"].startswith("✔ (mock) Lamps may burn") and "quote" in r["answer"] and r["n_supported"] == 1 and not r["refused"]
    told = lambda: lambda prompts: ['<answer><claim citation_ids="nowhere">Lamps burn<quote>people sleep longer under them</quote></claim><claim citation_ids="x">Pigs fly<quote>pigs can fly very high</quote></claim></answer>' for _ in prompts]
    r = commands.ask(spark, store, asked(spark, "Why do lamps burn at night?"), told).first()
    assert r["n_supported"] == 1 and r["n_unsupported"] == 1 and "✘ Pigs fly" in r["answer"]
    labels = {x["query_id"]: x["label"] for x in commands.check(spark, store, asked(spark, "Rivers bend slowly over the plain", "Whales sing underwater everywhere")).collect()}
    assert labels == {1: "supported", 2: "unsupported"}


def test_evaluate(spark, store, tmp_path):
    golden = {"retrieval": [{"id": "q1", "question": "Where do rivers bend slowly?", "target_paras": [0], "section": ""}, {"id": "q2", "question": "How many old bridges stand?", "target_paras": [2], "section": ""}], "traps": [{"id": "t1", "question": "x", "note": ""}]}
    path = tmp_path / "golden.json"
    path.write_text(json.dumps(golden))
    rows = {r["strategy"]: r for r in commands.evaluate(spark, store, str(path)).collect()}
    assert set(rows) == {"section", "fixed"} and rows["section"]["hit_at_1"] == 1.0 and rows["fixed"]["n"] == 2
    assert tables.golden_set(spark, str(path))[1].first()["type"] == "far_absent"
    assert "| n |" in commands.markdown(spark.createDataFrame([(1,)], "n int"), "x")


def test_judge_items(spark, store):
    items = commands.judge_build(spark, store, 4)
    rows = items.collect()
    kinds = [r["perturbation"] for r in rows]
    assert kinds.count("original") == 4 and {"negation", "number"} & set(kinds)
    assert all(r["claim"] != "" and r["passage"] for r in rows)
    votes = spark.createDataFrame([(r["id"], j, r["gold_label"] if j == "a" else "supported") for r in rows for j in "ab"], "item_id string, judge string, label string")
    got = {r["judge"]: r for r in commands.judge_eval(items, votes, ["a", "b"]).collect()}
    assert got["a"]["accuracy"] == 1.0 and got["a"]["kappa"] == 1.0 and got["b"]["fa_rate"] == 1.0 and got["a+b"]["false_accept"] == 0


def test_logs_are_retired(spark, tmp_path):
    log = tmp_path / "log"
    tables.append_log(spark.createDataFrame([("r", "k", 1, "a"), ("r", "k", 2, "b"), ("s", "k", 3, "c")], "run string, key string, seq long, record string"), str(log))
    assert [tuple(r) for r in tables.last_records(spark, str(log), "run string, key string, seq long, record string", "r").collect()] == [("k", "b")]
    assert tables.retire_log(spark, str(log), "r", limited=True) is None and tables.retire_log(spark, str(log), "r").endswith("log.done-r") and not log.exists()


def test_prefixes(spark):
    say = lambda model, role: spark.range(1).select(T.with_prefix(commands.F.lit("x"), model, role)).first()[0]
    assert say("e5-base", "query") == "query: x" and say("e5-base", "passage") == "passage: x" and say("bge-m3", "query") == "x"
    assert say("bge-small-en-v1.5", "query").endswith("x") and say("bge-small-en-v1.5", "query") != "x" and say("bge-small-en-v1.5", "passage") == "x"
