"""Retrieval and grounding metrics, intervals and paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959964


def share(k: Column, n: Column, places: int = 4) -> Column:
    """k / n rounded half to even, null where n is 0."""
    return F.when(n > 0, F.bround(k / n, places))


def wilson(k: Column, n: Column) -> Column:
    """The 95 % interval as an array, null where n is 0."""
    p, zz = k / n, F.lit(Z * Z)
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(Z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.array(F.bround(F.greatest(F.lit(0.0), middle - half), 4), F.bround(F.least(F.lit(1.0), middle + half), 4)))


def rate(k: Column, n: Column) -> Column:
    return F.struct(k.cast("long").alias("k"), n.cast("long").alias("n"), share(k, n).alias("rate"), wilson(k, n).alias("ci"))


def rate_text(k: Column, n: Column) -> Column:
    """84% [67-93] (26/31), or n/a; percentages round half to even."""
    ci = wilson(k, n)
    pct = lambda x: F.bround(x * 100, 0).cast("int")
    return F.when(n > 0, F.format_string("%d%% [%d–%d] (%d/%d)", pct(k / n), pct(ci[0]), pct(ci[1]), k.cast("long"), n.cast("long"))).otherwise("n/a")


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided test on the discordant counts, through logarithms of factorials, so that no count overflows."""
    n, low = b + c, F.least(b, c)
    nothing = F.struct((-n * F.ln(F.lit(2.0))).alias("term"), F.exp(-n * F.ln(F.lit(2.0))).alias("total"))

    def more(x: Column, i: Column) -> Column:  # the logarithm of each term from the one before
        term = x["term"] + F.ln((n - i + 1) / i)
        return F.struct(term.alias("term"), (x["total"] + F.exp(term)).alias("total"))

    steps = F.when(low > 0, F.sequence(F.lit(1), low.cast("int"))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, nothing, more, lambda x: x["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), 6))


def hit_at_k(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """hits (query_id, hit_rank) to n, hit_at_1/3/5/10 and mrr, by `keys` (a language, a strategy)."""
    within = lambda k: F.round(F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)), 4).alias(f"hit_at_{k}")
    return hits.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), *[within(k) for k in (1, 3, 5, 10)], F.round(F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))), 4).alias("mrr"))


def label_counts(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda name: F.count_if(F.col("label") == name)
    return verdicts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_claims"), n("supported").alias("n_supported"), n("partially_supported").alias("n_partial"), n("disputed").alias("n_disputed"), n("unsupported").alias("n_unsupported"))


def report_precision(counts: DataFrame) -> DataFrame:
    """Per report: 0.0 without verdicts (pooled metrics have null there)."""
    n = F.col("n_claims")
    zero = lambda k: F.when(n > 0, F.bround(k / n, 4)).otherwise(0.0)
    return counts.withColumns({"strict_precision": zero(F.col("n_supported")), "lenient_precision": zero(F.col("n_supported") + F.col("n_partial")), "hallucination": zero(F.col("n_unsupported"))})


def pooled(counts: DataFrame) -> DataFrame:
    """Micro-averages: counters are summed over questions, then divided; null without claims."""
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_claims", "n_supported", "n_partial", "n_disputed", "n_unsupported")], F.count_if(F.col("n_claims") > 0).alias("answers"), F.count_if(F.col("n_unsupported") > 0).alias("bad_answers"))
    n = F.col("n_claims")
    return total.select("*", share(F.col("n_supported"), n).alias("strict_precision"), share(F.col("n_supported") + F.col("n_partial"), n).alias("lenient_precision"), share(F.col("n_unsupported"), n).alias("hallucination"), share(F.col("bad_answers"), F.col("answers")).alias("answer_hallucination"))


MUST_REFUSE = ("far_absent", "near_absent")


def trap_flags(records: DataFrame) -> DataFrame:
    """Adds safe, strict_safe, correct: traps of MUST_REFUSE are decided by refusal, all others by safety."""
    safe = (F.col("n_unsupported") == 0) & (F.col("n_disputed") == 0) & ~F.col("parse_failed")
    kind = F.coalesce("type", F.lit("far_absent"))
    return records.withColumns({"type": kind, "safe": safe, "strict_safe": safe & (F.col("n_partial") == 0), "correct": F.when(kind.isin(*MUST_REFUSE), F.col("refused")).otherwise(safe)})


def trap_rollup(flagged: DataFrame) -> DataFrame:
    """n and the four counts by type and in all (type null), in one pass."""
    return flagged.rollup("type").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in ("correct", "refused", "safe", "strict_safe")])


def refusal_rates(answerable: DataFrame, traps: DataFrame) -> DataFrame:
    """records (refused) of answerable questions and traps (type, refused): over-refusal, and refusal of the traps that ask for it."""
    must = traps.where(F.coalesce("type", F.lit("far_absent")).isin(*MUST_REFUSE))
    one = lambda rows, name: rows.agg(F.lit(name).alias("name"), F.count_if("refused").alias("k"), F.count(F.lit(1)).alias("n"))
    both = one(answerable, "over_refusal").unionAll(one(must, "correct_refusal"))
    return both.select("name", "k", "n", share(F.col("k"), F.col("n")).alias("rate"))


def quote_histogram(verdicts: DataFrame) -> DataFrame:
    """Counts of the four quote statuses, and the share not found."""
    out = verdicts.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("quote_check") == q).alias(q) for q in ("verbatim", "near", "not_found", "missing")])
    return out.withColumn("fabricated_rate", share(F.col("not_found"), F.col("n")))


def panel_agreement(verdicts: DataFrame) -> DataFrame:
    """Items with two votes or more, and those of them that agree; votes is a map from judge to label."""
    votes = F.map_values("votes")
    judged = F.size(votes) >= 2
    out = verdicts.agg(F.count_if(judged).alias("judged"), F.count_if(judged & (F.size(F.array_distinct(votes)) == 1)).alias("agreed"))
    return out.withColumn("agreement", share(F.col("agreed"), F.col("judged")))


def format_errors(records: DataFrame) -> DataFrame:
    return records.agg(*[F.count_if(F.col(c)).alias(c) for c in ("parse_failed", "misplaced_refusal")], *[F.sum(c).alias(c) for c in ("n_translated_quotes", "n_unjudged", "n_citation_repaired")])


def paired_test(a: DataFrame, b: DataFrame, flag: str) -> DataFrame:
    """Two arms (question_id, flag): shared questions, discordant counts, exact p."""
    both = a.select("question_id", F.col(flag).alias("x")).join(b.select("question_id", F.col(flag).alias("y")), "question_id")
    out = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") & ~F.col("y")).alias("only_a"), F.count_if(~F.col("x") & F.col("y")).alias("only_b"))
    return out.withColumn("p", mcnemar(F.col("only_a"), F.col("only_b")))


def judge_scores(items: DataFrame) -> DataFrame:
    """items (gold_label, pred): false accepts and rejects, accuracy, disputed and unparsed shares."""
    gold, pred = F.col("gold_label"), F.col("pred")
    c = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(gold != "supported").alias("neg"), F.count_if(gold == "supported").alias("pos"), F.count_if((gold != "supported") & (pred == "supported")).alias("false_accept"), F.count_if((gold == "supported") & (pred != "supported")).alias("false_reject"), F.count_if(gold == pred).alias("right"), F.count_if(pred == "disputed").alias("disputed"), F.count_if(pred == "unparsed").alias("unparsed"))
    n = F.col("n")
    return c.select("n", "false_accept", "false_reject", share(F.col("false_accept"), F.col("neg")).alias("fa_rate"), share(F.col("false_reject"), F.col("pos")).alias("fr_rate"), share(F.col("right"), n).alias("accuracy"), share(F.col("disputed"), n).alias("disputed_rate"), share(F.col("unparsed"), n).alias("unparsed_rate"))


def detection(items: DataFrame) -> DataFrame:
    """By perturbation: originals are to be supported, the others not (or supported where gold says so)."""
    ok = F.when((F.col("perturbation") == "original") | (F.col("gold_label") == "supported"), F.col("pred") == "supported").otherwise(F.col("pred") != "supported")
    return items.groupBy("perturbation").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("k")).withColumn("correct", share(F.col("k"), F.col("n")))


def kappa(items: DataFrame) -> DataFrame:
    """Cohen's kappa over the union of labels; null where chance agreement is 1 or there are no items."""
    cell = items.groupBy("gold_label", "pred").agg(F.count(F.lit(1)).alias("c"))
    both = cell.select(F.col("gold_label").alias("l"), F.col("c").alias("g"), F.lit(0).alias("p"), F.when(F.col("gold_label") == F.col("pred"), F.col("c")).otherwise(0).alias("d")).unionAll(cell.select(F.col("pred").alias("l"), F.lit(0).alias("g"), F.col("c").alias("p"), F.lit(0).alias("d")))
    per = both.groupBy("l").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("d").alias("d"))
    t = per.agg(F.sum("g").alias("n"), F.sum("d").alias("agree"), F.sum(F.col("g") * F.col("p")).alias("chance"))
    po, pe = F.col("agree") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return t.select("n", F.when((F.col("n") > 0) & (pe < 1), F.bround((po - pe) / (1 - pe), 4)).alias("kappa"))
