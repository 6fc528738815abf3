"""Paragraphs to chunks: section-aware packing and fixed sliding windows.

Chunks are cut inside a row that holds a document's ordered paragraphs, so texts are not shuffled where documents come as one row each.
Packing is sequential: a document's paragraph sizes (a short array of numbers, never its texts) go to Python in Arrow batches and come
back as windows of paragraphs. Documents are independent and spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.config import DEFAULTS, Settings
from citeforge.functions import matching
from citeforge.functions import text as T


def by_document(paras: DataFrame) -> DataFrame:
    """doc_id, p: a document's paragraphs in order, with their words counted; the texts are shuffled once."""
    page = F.coalesce("page", F.lit(0)) if "page" in paras.columns else F.lit(0)
    row = F.struct("idx", "text", "section_path", "section_number", page.alias("page"), F.size(T.words(F.col("text"))).alias("n_words"))
    return paras.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("p"))


def _tokens(s: Settings):
    return F.transform("p", lambda x: T.est_tokens(x["n_words"], s.tokens_per_word))


def _cut(rows: DataFrame, windows, strategy: str, s: Settings) -> DataFrame:
    """One row a chunk: text in order, span, words, tokens, and the last paragraph's section. windows: [begin, end) as alternating numbers."""
    parts = F.transform(F.sequence(F.lit(0), F.size("w") - 2, F.lit(2)), lambda k: F.slice("p", F.get("w", k) + 1, F.get("w", k + 1) - F.get("w", k)))
    # no filter on `w`: it would be pushed below the arrays that `w` comes from, and each of their elements would make them anew
    out = rows.withColumn("w", windows).select("doc_id", F.posexplode(F.when(F.size("w") > 0, parts)).alias("chunk_no", "r"))
    out = out.withColumn("n_words", F.aggregate("r", F.lit(0), lambda n, x: n + x["n_words"]))
    last = F.element_at("r", -1)
    return out.select(
        "doc_id",
        "chunk_no",
        F.format_string(f"d%d_{strategy}_%04d", "doc_id", "chunk_no").alias("chunk_id"),
        F.lit(strategy).alias("strategy"),
        F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"),
        F.coalesce(F.try_element_at(last["section_path"], F.lit(-1)), F.lit("")).alias("section"),
        last["section_number"].alias("section_number"),
        last["section_path"].alias("section_path"),
        F.element_at("r", 1)["idx"].alias("para_start"),
        last["idx"].alias("para_end"),
        "n_words",
        T.est_tokens(F.col("n_words"), s.tokens_per_word).alias("est_tokens"),
        F.element_at("r", 1)["page"].alias("page_start"),
        last["page"].alias("page_end"),
    )


def cut_sections(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Paragraphs of one path are packed greedily up to `section_max` tokens; a last chunk of a path with fewer than `section_min`
    joins the one before it."""
    path = F.transform("p", lambda x: F.array_join(x["section_path"], "\u0001"))
    rows = rows.withColumn("path", path)
    fresh = F.transform("path", lambda x, k: F.coalesce(x != F.get("path", k - 1), F.lit(True)))
    return _cut(rows, matching.section_windows(s.section_max, s.section_min)(_tokens(s), fresh), "section", s)


def cut_fixed(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Windows take paragraphs until they have `fixed_tokens`, then step back over at least `fixed_overlap` tokens, and always move on."""
    return _cut(rows, matching.sliding_windows(s.fixed_tokens, s.fixed_overlap)(_tokens(s)), "fixed", s)


def with_citations(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds citations: the distinct works that a chunk's text cites (ref_id, display, resolved), in the order of their first mention."""
    from citeforge.operators.references import extract_citations

    found = extract_citations(chunks.select("doc_id", F.col("chunk_no").alias("idx"), "text"), refs)
    row = F.transform(F.array_sort(F.collect_list(F.struct("position", "ref_id", "display", "resolved"))), lambda c: F.struct(c["ref_id"].alias("ref_id"), c["display"].alias("display"), c["resolved"].alias("resolved")))
    cited = found.groupBy("doc_id", F.col("idx").alias("chunk_no")).agg(row.alias("citations"))
    none = F.array().cast("array<struct<ref_id:string,display:string,resolved:boolean>>")
    return chunks.join(cited, ["doc_id", "chunk_no"], "left").withColumn("citations", F.coalesce("citations", none))


def chunk_section(paras: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return cut_sections(by_document(paras), s)


def chunk_fixed(paras: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return cut_fixed(by_document(paras), s)


#: From one row a document (`by_document`, `ingest.whole_documents`) to chunks.
STRATEGIES = {"section": cut_sections, "fixed": cut_fixed}
