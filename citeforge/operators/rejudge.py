"""Question records, saved verdicts that are used again, second judgments, and the comparison of two arms."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.config import DEFAULTS, Settings
from citeforge.functions import text as T
from citeforge.operators import metrics, verify

QUOTE_STATUSES = ("verbatim", "near", "not_found", "missing")
#: Saved answers of this many characters were cut.
RAW_LIMIT = 3000


# ---- keys --------------------------------------------------------------------------------------------------------
def question_key(kind: Column, question_id: Column, question: Column) -> Column:
    return F.concat_ws("|", kind, question_id, F.left(F.md5(question), F.lit(10)))


def claim_key(arm: Column, part: Column, question_id: Column, statement: Column) -> Column:
    return F.concat_ws("|", arm, part, question_id, F.left(F.md5(statement), F.lit(10)))


def run_signature(parts: list[str], s: Settings = DEFAULTS, reuse_from: str = "") -> str:
    """Names a run by what its results depend on: arm, models, prompts and code (`parts`), and the settings; those at their
    defaults say nothing, so that older runs go on."""
    said = [*parts, s.chunk_strategy, s.plan_rule, str(s.quote_required), str(s.final_k)]
    if s.context_order != "rank":
        said.append(f"order:{s.context_order}")
    if s.hypothesis_match:
        said.append(f"match:{s.hypothesis_min_sim}:{s.hypothesis_margin}")
    if s.zh_rule != "off":
        said.append(f"zh-overclaim:{s.zh_rule}")
    if s.echo_rule != "off":
        said.append(f"echo:{s.echo_rule}:{s.echo_min_sim}:{s.echo_min_overlap}")
    if reuse_from:
        said.append(f"reuse:{reuse_from}")
    return hashlib.sha256("\x00".join(said).encode()).hexdigest()[:16]


# ---- records -----------------------------------------------------------------------------------------------------
def question_records(answers: DataFrame, verdicts: DataFrame, passages: DataFrame) -> DataFrame:
    """answers (query_id, raw, claims, refused, parse_failed, misplaced_refusal), verdicts (query_id, claim_idx, label, method,
    quote_check, repaired_from, votes map) and passages (query_id, chunk_id, text): what the metrics need, a row a question."""
    n = lambda c, name: F.count_if(c).alias(name)
    label, votes = F.col("label"), F.map_values("votes")
    counts = verdicts.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_claims"),
        *[n(label == x, name) for x, name in (("supported", "n_supported"), ("partially_supported", "n_partial"), ("unsupported", "n_unsupported"), ("disputed", "n_disputed"))],
        n(F.col("repaired_from").isNotNull(), "n_citation_repaired"),
        n(F.size(votes) >= 2, "n_panel_judged"),
        n((F.size(votes) >= 2) & (F.size(F.array_distinct(votes)) == 1), "n_panel_agreed"),
        n(F.col("method") == "none", "n_unjudged"),
        *[n(F.col("quote_check") == q, f"quote_{q}") for q in QUOTE_STATUSES],
    )
    claims = answers.select("query_id", F.posexplode("claims").alias("claim_idx", "c")).select("query_id", "claim_idx", F.col("c.quote").alias("quote"), F.explode_outer("c.citation_ids").alias("chunk_id"))
    cited = claims.join(passages.select("query_id", "chunk_id", "text"), ["query_id", "chunk_id"], "left").groupBy("query_id", "claim_idx").agg(F.first("quote").alias("quote"), F.concat_ws("", F.collect_list("text")).alias("cited"))
    foreign = cited.groupBy("query_id").agg(n(T.is_translated_quote(F.col("quote"), F.col("cited")), "n_translated_quotes"))
    rows = answers.select("query_id", "refused", "parse_failed", "misplaced_refusal", F.when(F.col("parse_failed"), F.substring("raw", 1, 2000)).alias("raw")).join(counts, "query_id", "left").join(foreign, "query_id", "left")
    zero = [c for c in rows.columns if c.startswith(("n_", "quote_"))]
    return rows.fillna(0, zero)


def reusable(saved: DataFrame) -> DataFrame:
    """Saved records whose whole answer was kept."""
    return saved.where(F.col("raw").isNotNull() & (F.length("raw") < RAW_LIMIT))


def reuse_verdicts(sentences: DataFrame, saved: DataFrame) -> DataFrame:
    """sentences (query_id, statement) with the saved label of the same sentence (saved: query_id, raw, claims of statement and label);
    `known` is false where it must be judged."""
    kept = reusable(saved).select("query_id", F.explode("claims").alias("c")).select("query_id", "c.statement", "c.label").dropDuplicates(["query_id", "statement"])
    return sentences.join(kept, ["query_id", "statement"], "left").withColumn("known", F.col("label").isNotNull())


# ---- second judgments --------------------------------------------------------------------------------------------
def needs_second(claims: DataFrame) -> DataFrame:
    """claims (part, label): in answers all that is not supported, in traps what is unsupported or disputed."""
    return claims.where(F.when(F.col("part") == "answer", F.col("label") != "supported").otherwise(F.col("label").isin("unsupported", "disputed")))


def unseen(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """claims (claim_id, query_id, seen array) by the passages (query_id, chunk_id, ...) of their question that they were not judged by."""
    return claims.join(passages, "query_id").where(~F.array_contains("seen", F.col("chunk_id")))


def second_judgment(claims: DataFrame, passages: DataFrame, votes: DataFrame | None = None, judges: int = 0, s: Settings = DEFAULTS) -> DataFrame:
    """claims (claim_id, query_id, part, statement, label, seen) to claim_id, old, new, extra, reason: claims that could change meet their
    unseen passages (query_id, chunk_id, text, heading, rank); the better label counts."""
    asked = needs_second(claims)
    rest = unseen(asked, passages)
    pairs = rest.select(F.concat_ws("|", "claim_id", "chunk_id").alias("item_id"), F.col("claim_id").alias("query_id"), "statement", F.col("rank").alias("position"), F.col("text").alias("passage"), "heading")
    again = verify.verify_statements(pairs, votes, judges, s).select(F.col("query_id").alias("claim_id"), F.col("label").alias("again"))
    extra = rest.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("extra"))
    rows = asked.join(again, "claim_id", "left").join(extra, "claim_id", "left")
    better = F.when(verify.label_rank(F.col("again")) > verify.label_rank(F.col("label")), F.col("again")).otherwise(F.col("label"))
    none = F.col("extra").isNull()
    return rows.select("claim_id", F.col("label").alias("old"), F.when(none, F.col("label")).otherwise(better).alias("new"), F.coalesce("extra", F.array().cast("array<string>")).alias("extra"), F.when(none, "no unseen passage").otherwise("").alias("reason"))


# ---- arms --------------------------------------------------------------------------------------------------------
def question_flags(records: DataFrame) -> DataFrame:
    """records (arm, part, question_id, type, labels, refused, parse_failed) with flags for each question: unsupported and not_clean of
    answers; safe, strict_safe, correct, correct_strict of traps."""
    has = lambda *names: F.exists("labels", lambda x: x.isin(*names))
    trap = F.col("part") == "trap"
    rows = records.withColumn("unsupported", F.when(~trap, has("unsupported"))).withColumn("not_clean", F.when(~trap, F.exists("labels", lambda x: x != "supported")))
    safe = ~has("unsupported", "disputed") & ~F.col("parse_failed")
    strict = safe & ~has("partially_supported")
    must = F.col("type").isin(*metrics.MUST_REFUSE)
    return rows.withColumns({"safe": F.when(trap, safe), "strict_safe": F.when(trap, strict), "correct": F.when(trap, F.when(must, F.col("refused")).otherwise(safe)), "correct_strict": F.when(trap, F.when(must, F.col("refused")).otherwise(strict))})


def arm_summary(records: DataFrame) -> DataFrame:
    """arm, metric, k, n, rate: strict, lenient, hallucination over the claims of answers; answers with an unsupported claim or any
    that is not supported; must-refuse traps that are safe. One pass over the records."""
    flagged = question_flags(records)
    answer, must = F.col("part") == "answer", F.col("type").isin(*metrics.MUST_REFUSE) & (F.col("part") == "trap")
    of = lambda *names: F.sum(F.when(answer, F.size(F.filter("labels", lambda x: x.isin(*names)))).otherwise(0))
    claims, answers = F.sum(F.when(answer, F.size("labels")).otherwise(0)), F.count_if(answer)
    found = {
        "strict": (of("supported"), claims),
        "lenient": (of("supported", "partially_supported"), claims),
        "hallucination": (of("unsupported"), claims),
        "answers_unsupported": (F.count_if(answer & F.col("unsupported")), answers),
        "answers_not_clean": (F.count_if(answer & F.col("not_clean")), answers),
        "must_refuse_safe": (F.count_if(must & F.col("safe")), F.count_if(must)),
    }
    wide = flagged.groupBy("arm").agg(*[c.cast("long").alias(f"{name}_{x}") for name, pair in found.items() for c, x in zip(pair, "kn")])
    long = wide.select("arm", F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"{name}_k").alias("k"), F.col(f"{name}_n").alias("n")) for name in found])).alias("m")).select("arm", "m.*")
    return long.withColumn("rate", metrics.share(F.col("k"), F.col("n")))


#: Name, part, types (None: all), flag.
_PREMISE, _BAIT = ("false_premise", "hypothesis_bait"), ("hypothesis_bait",)
COMPARISONS = [
    ("answers_unsupported", "answer", None, "unsupported"),
    ("answers_not_clean", "answer", None, "not_clean"),
    ("must_refuse_safe", "trap", metrics.MUST_REFUSE, "safe"),
    ("traps_correct", "trap", ("core",), "correct"),
    ("bait_safe", "trap", _BAIT, "safe"),
    ("premise_safe", "trap", _PREMISE, "safe"),
    ("premise_strict_safe", "trap", _PREMISE, "strict_safe"),
    ("traps_correct_strict", "trap", ("core",), "correct_strict"),
]


def compare_arms(records: DataFrame, a: str = "grounded", b: str = "baseline") -> DataFrame:
    """comparison, n, k_a, k_b, a_only, b_only, p: eight paired tests on the questions that both arms answered; core traps are all but
    hypothesis bait. One join of the arms, one pass over the pairs."""
    flags = ["unsupported", "not_clean", "safe", "strict_safe", "correct", "correct_strict"]
    rows = question_flags(records)
    pick = lambda arm, x: rows.where(F.col("arm") == arm).select("part", "question_id", *(["type"] if x == "x" else []), *[F.col(c).alias(f"{x}_{c}") for c in flags])
    both = pick(a, "x").join(pick(b, "y"), ["part", "question_id"])

    def within(part: str, types) -> Column:
        rule = F.col("part") == part
        if types == ("core",):
            return rule & (F.col("type") != "hypothesis_bait")
        return rule & F.col("type").isin(*types) if types else rule

    one = lambda name, part, types, flag: F.when(within(part, types), F.struct(F.lit(name).alias("comparison"), F.col(f"x_{flag}").alias("x"), F.col(f"y_{flag}").alias("y")))
    pairs = both.select(F.explode(F.array_compact(F.array(*[one(*c) for c in COMPARISONS]))).alias("c")).select("c.*")
    out = pairs.groupBy("comparison").agg(F.count(F.lit(1)).alias("n"), F.count_if("x").alias("k_a"), F.count_if("y").alias("k_b"), F.count_if(F.col("x") & ~F.col("y")).alias("a_only"), F.count_if(~F.col("x") & F.col("y")).alias("b_only"))
    return out.withColumn("p", metrics.mcnemar(F.col("a_only"), F.col("b_only")))
