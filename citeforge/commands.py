"""The engine's commands: build a store, ask it, check sentences against it, evaluate it, and make and score judge items.

`python -m citeforge.commands build DOCUMENTS STORE`, and so on (`--help`). A store is a folder of Parquet tables: chunks by strategy,
the lexical index (terms of chunks, term weights, stats), vectors by model and strategy. Models are transports; without one, stand-ins answer.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeforge.config import DEFAULTS, Settings
from citeforge.functions import matching
from citeforge.functions import text as T
from citeforge.operators import chunking, generation, ingest, judging, metrics, retrieval, verify
from citeforge.sources import tables, transports

#: The stand-in encoder's name.
MODEL = "hashed-trigrams"


def encode_texts(rows: DataFrame, key: str, text: str, role: str = "passage", model: str = MODEL, encode=matching.hashed_embedding) -> DataFrame:
    """key, v: vectors of texts under the model's prefix rule."""
    return rows.select(key, encode(T.with_prefix(F.col(text), model, role)).alias("v"))


# ---- build -------------------------------------------------------------------------------------------------------
def build(spark: SparkSession, documents: str, store: str, s: Settings = DEFAULTS) -> None:
    """documents: a Parquet table (doc_id, text, source). Each strategy's tables replace the earlier ones."""
    rows = ingest.whole_documents(spark.read.parquet(documents))
    for strategy, cut in chunking.STRATEGIES.items():
        chunks = retrieval.with_ordinals(cut(rows, s))
        place = f"{store}/{strategy}"
        chunks.write.mode("overwrite").parquet(f"{place}/chunks")
        kept = spark.read.parquet(f"{place}/chunks")
        retrieval.Bm25Index(kept, s).write(place)
        encode_texts(kept, "ordinal", "text").write.mode("overwrite").parquet(f"{place}/vectors")


def store_of(spark: SparkSession, store: str, s: Settings = DEFAULTS) -> tuple[DataFrame, retrieval.Bm25Index, DataFrame]:
    place = f"{store}/{s.chunk_strategy}"
    return spark.read.parquet(f"{place}/chunks"), retrieval.Bm25Index.stored(spark, place), spark.read.parquet(f"{place}/vectors")


def search(spark: SparkSession, store: str, questions: DataFrame, s: Settings = DEFAULTS, k: int = 0) -> DataFrame:
    """questions (query_id, question) to query_id, rank, score and the chunk's columns: both rankings, fused, cut to k. Questions that
    skip lexical search are ranked by their vectors alone."""
    chunks, index, vectors = store_of(spark, store, s)
    asked = retrieval.route(questions.select("query_id", F.col("question").alias("query")), s)
    coded = encode_texts(asked, "query_id", "query", "query").withColumnRenamed("v", "qv").withColumn("query_id", F.col("query_id").cast("string"))
    dense = retrieval.dense_topk(coded, vectors.withColumn("id", F.col("ordinal").cast("string")).select("id", "v"), s=s)
    dense = dense.withColumn("query_id", F.col("query_id").cast(dict(questions.dtypes)["query_id"])).withColumn("id", F.col("id").cast("long"))
    sparse = retrieval.bm25_topk(asked.where(~F.col("dense_only")).select("query_id", "query"), index, s=s).withColumnRenamed("ordinal", "id")
    fused = retrieval.final_top(retrieval.rrf(dense, sparse, s), k, s)
    return fused.select("query_id", F.col("id").alias("ordinal"), "rank", "score", "dense_rank", "sparse_rank").join(chunks, "ordinal")


# ---- ask ---------------------------------------------------------------------------------------------------------
def ask(spark: SparkSession, store: str, questions: DataFrame, transport=None, s: Settings = DEFAULTS) -> DataFrame:
    """query_id, n_claims and the other counts, precision, and `answer`: each claim under its badge with its places."""
    found = tables.settled(search(spark, store, questions, s).withColumn("heading", T.heading(F.col("section_path"), F.col("section_number"), F.col("section"))).withColumn("source", F.lit("")))
    if transport is None:
        mock = generation.mock_generate(questions, found, s)
        answers = mock.select("query_id", F.when(F.col("refused"), F.lit("<answer><refusal/></answer>")).otherwise(F.format_string('<answer><claim citation_ids="%s">%s</claim></answer>', "chunk_id", "statement")).alias("raw"))
    else:
        context = generation.build_context(generation.order_context(found, s))
        prompts = questions.join(context, "query_id").select("query_id", F.concat("context", F.lit("\n\n"), "question").alias("prompt"))
        answers = generation.complete(prompts, transport)
    parsed = tables.settled(generation.parse_answers(answers, s))
    verdicts = tables.settled(verify.verify_claims(generation.claims_of(parsed), found.select("query_id", "chunk_id", "text", "heading", "rank"), s=s, questions=questions))
    return parsed.select("query_id", "refused", "unsupported_note").join(render(verdicts, found), "query_id", "left").join(verify.report(verdicts).drop("verdicts"), "query_id", "left")


def render(verdicts: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, answer: a line for each claim: badge, statement, where it is cited from, and what the quote check said."""
    badge = F.when(F.col("label") == "supported", "✔").when(F.col("label") == "partially_supported", "◐").when(F.col("label") == "disputed", "⚖").otherwise("✘")
    place = T.locator(F.lit("source"), F.col("chunk_id"), F.col("section_number"), F.col("section"), F.col("page_start"), F.col("page_end"), F.col("para_start"), F.col("para_end"))
    places = found.select("query_id", "chunk_id", place.alias("place"))
    cited = verdicts.select("query_id", "claim_idx", F.posexplode_outer("citation_ids").alias("n", "chunk_id")).join(places, ["query_id", "chunk_id"], "left")
    where = cited.groupBy("query_id", "claim_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("place", "chunk_id").alias("p")))), lambda x: x["p"]), "; ").alias("where"))
    line = F.concat(badge, F.lit(" "), F.col("statement"), F.lit(" ("), F.coalesce("where", F.lit("")), F.lit("; "), F.col("method"), F.when(F.col("quote_check") != "", F.concat(F.lit(", quote "), F.col("quote_check"))).otherwise(""), F.lit(")"))
    rows = verdicts.join(where, ["query_id", "claim_idx"], "left").select("query_id", "claim_idx", line.alias("line"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_idx", "line"))), lambda r: r["line"]), "\n").alias("answer"))


# ---- check -------------------------------------------------------------------------------------------------------
def check(spark: SparkSession, store: str, sentences: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """sentences (query_id, question = the sentence) to query_id, label, calls: against their first `check_passages` passages."""
    found = search(spark, store, sentences, s, s.check_passages)
    pairs = found.join(sentences.select("query_id", F.col("question").alias("statement")), "query_id")
    item = F.concat_ws("|", F.col("query_id").cast("string"), "chunk_id")
    shown = pairs.select(item.alias("item_id"), "query_id", "statement", (F.col("rank") - 1).alias("position"), F.col("text").alias("passage"), T.heading(F.col("section_path"), F.col("section_number"), F.col("section")).alias("heading"))
    return verify.verify_statements(shown, s=s).select("query_id", "label", "calls")


# ---- eval --------------------------------------------------------------------------------------------------------
def evaluate(spark: SparkSession, store: str, golden: str, s: Settings = DEFAULTS, language: str = "en") -> DataFrame:
    """strategy, n, hit_at_1/3/5/10 and mrr of a golden set's questions (targets are paragraphs of document 1), for each strategy."""
    questions, _ = tables.golden_set(spark, golden, language)
    asked = questions.select(F.col("id").alias("query_id"), "question")
    targets = questions.select(F.col("id").alias("query_id"), F.lit(1).cast("long").alias("doc_id"), F.explode("target_paras").alias("para"))
    out = None
    for strategy in chunking.STRATEGIES:
        ranked = search(spark, store, asked, s.with_(chunk_strategy=strategy), 10)
        rows = metrics.hit_at_k(retrieval.first_hit(ranked, targets)).select(F.lit(strategy).alias("strategy"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def markdown(rows: DataFrame, title: str) -> str:
    """A small aggregate as a Markdown table."""
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    for r in rows.limit(1000).collect():
        lines.append("| " + " | ".join("n/a" if v is None else str(v) for v in r) + " |")
    return "\n".join(lines) + "\n"


# ---- judge items -------------------------------------------------------------------------------------------------
def judge_build(spark: SparkSession, store: str, sentences: int = 60, s: Settings = DEFAULTS, seed: str = "42") -> DataFrame:
    """id, split, source, perturbation, gold_label, claim, passage, chunk_id: originals, one change each in turn, and top-ups."""
    chunks, _, _ = store_of(spark, store, s)
    every = chunks.select("doc_id", "chunk_id", "section_number", "text", F.posexplode(T.sentences_candidate(F.col("text"))).alias("n", "sentence"))
    order = Window.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "chunk_id", F.col("n").cast("string"))), "chunk_id", "n")
    # only as many sentences as the set and its top-ups can use get a turn
    room = every.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "chunk_id", F.col("n").cast("string"))), "chunk_id", "n").limit(50 * sentences)
    turns = tables.settled(room.withColumn("turn", F.row_number().over(order) - 1).withColumn("position", F.col("turn")))
    changed = judging.perturbed(turns).select("turn", "kind", "claim", F.lit(None).cast("string").alias("far_chunk"))
    far = judging.swapped(judging.distant(turns.where(F.col("turn") < sentences).select("doc_id", "position", "turn", "sentence", "section_number"), chunks)).select("turn", "kind", "claim", F.when(F.col("kind") == "swap_passage", F.col("far_chunk")).alias("far_chunk"))
    options = tables.settled(changed.unionByName(far))
    chosen = judging.rotate(options, sentences).join(options, ["turn", "kind"])
    originals = turns.where(F.col("turn") < sentences).select("turn", F.lit("original").alias("kind"), F.col("sentence").alias("claim"), F.lit(None).cast("string").alias("far_chunk"))
    picked = originals.unionByName(chosen).unionByName(judging.top_ups(options, sentences).select("turn", "kind", "claim", "far_chunk"))
    where = picked.join(turns.select("turn", F.col("chunk_id").alias("own")), "turn").withColumn("chunk_id", F.coalesce("far_chunk", "own"))
    group = F.format_string("S%05d", "turn")
    rows = where.join(chunks.select("chunk_id", F.col("text").alias("passage")), "chunk_id")
    return rows.select(F.concat(group, F.lit("-"), F.col("kind")).alias("id"), group.alias("group"), T.split_of(group).alias("split"), F.lit("synthetic").alias("source"), F.col("kind").alias("perturbation"), judging._gold(F.col("kind")).alias("gold_label"), "claim", "passage", "chunk_id")


def judge_eval(items: DataFrame, votes: DataFrame, judges: list[str], rule: str = "unanimous") -> DataFrame:
    """judge (or panel), n, false accepts and rejects, accuracy, disputed share and kappa: each judge and each panel on all items.
    votes: item_id, judge, label."""
    gold = items.select(F.col("id").alias("item_id"), "gold_label")
    panel = judging.panels(votes, judges, rule).select("item_id", F.col("panel").alias("judge"), "label") if len(judges) > 1 else None
    every = votes.select("item_id", "judge", "label")
    every = every.unionByName(panel) if panel is not None else every
    out = None
    for name in [*judges, *(["+".join(sorted(judges))] if len(judges) > 1 else [])]:
        rows = gold.join(every.where(F.col("judge") == name), "item_id").select("gold_label", F.coalesce("label", F.lit("unparsed")).alias("pred"))
        one = metrics.judge_scores(rows).crossJoin(metrics.kappa(rows).select("kappa")).select(F.lit(name).alias("judge"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="citeforge")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in {"build": ("documents", "store"), "ask": ("store", "question"), "check": ("store", "sentence"), "eval": ("store", "golden"), "judge-build": ("store", "out"), "judge-eval": ("items", "votes")}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        p.add_argument("--env", default=None)
        p.add_argument("--chat", default=None, help="address and model of a chat server, as URL#MODEL")
    a = parser.parse_args(argv)
    s = Settings.from_env(a.env)
    spark = SparkSession.builder.appName("citeforge").getOrCreate()
    one = lambda text: spark.createDataFrame([(1, text)], "query_id int, question string")
    if a.command == "build":
        build(spark, a.documents, a.store, s)
    elif a.command == "ask":
        chat = transports.http_chat(*a.chat.split("#", 1)) if a.chat else None
        for r in ask(spark, a.store, one(a.question), chat, s).collect():
            print(r["answer"] or s.refusal_marker)
    elif a.command == "check":
        for r in check(spark, a.store, one(a.sentence), s).collect():
            print(r["label"])
    elif a.command == "eval":
        print(markdown(evaluate(spark, a.store, a.golden, s), "Retrieval"))
    elif a.command == "judge-build":
        judge_build(spark, a.store, s=s).write.mode("overwrite").json(a.out)
    else:
        votes = spark.read.schema("item_id string, judge string, label string").json(a.votes)
        judges = sorted(r["judge"] for r in votes.select("judge").distinct().limit(100).collect())
        print(markdown(judge_eval(spark.read.schema(tables.ITEM).json(a.items), votes, judges, s.panel_rule), "Judges"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
