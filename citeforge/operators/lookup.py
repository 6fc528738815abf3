"""Bibliography entries against the records that a catalogue returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeforge.functions import fixed, matching

CROSSREF, EUTILS = "https://api.crossref.org/works", "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"


# ---- the entry as listed -----------------------------------------------------------------------------------------
def listed_fields(refs: DataFrame) -> DataFrame:
    """refs (ref_id, raw, key_surname, key_year) with the entry's own fields: year, doi, volume, first_page, surnames, n_authors,
    et_al, non_article (no volume and page: a book, a chapter, a manual)."""
    raw = F.trim("raw")
    doi = F.regexp_extract(raw, fixed.LISTED_DOI, 1)
    body = F.when(doi != "", F.substr(raw, F.lit(1), F.regexp_instr(raw, F.lit(fixed.LISTED_DOI)) - 1)).otherwise(raw)
    mark = F.concat(F.lit("("), F.col("key_year"))
    at = F.when(F.col("key_year") != "", F.position(mark, body))
    rows = refs.withColumns({"_body": body, "_at": F.coalesce(at, F.lit(0)), "doi": F.lower(F.regexp_replace(F.regexp_replace(doi, "(?U)\\s+", ""), "\\.+$", ""))})
    head = F.when(F.col("_at") > 0, F.substr("_body", F.lit(1), F.col("_at") - 1)).otherwise(F.col("_body"))
    tail = F.when(F.col("_at") > 0, F.substr("_body", F.col("_at") + F.length(mark))).otherwise(F.col("_body"))
    last = lambda k: F.coalesce(F.try_element_at(F.regexp_extract_all(tail, F.lit(fixed.LISTED_VOLUME_PAGE), k), F.lit(-1)), F.lit(""))
    names = F.transform(F.regexp_extract_all(head, F.lit(f"({fixed.LISTED_AUTHOR})"), 1), lambda a: F.regexp_replace(F.trim(F.split(a, ",")[0]), "^(?:&|and)\\s+", ""))
    out = rows.withColumns({"volume": last(1), "first_page": last(3), "surnames": names, "et_al": head.rlike("et al\\.|\\.\\.\\.|…"), "year": F.regexp_replace("key_year", "[a-h]+$", "")})
    return out.withColumns({"n_authors": F.size("surnames"), "non_article": F.col("first_page") == ""}).drop("_body", "_at")


# ---- records -----------------------------------------------------------------------------------------------------
_DATE = "struct<`date-parts`:array<array<int>>>"
_WORK = f"DOI string, title array<string>, author array<struct<family:string,name:string>>, issued {_DATE}, `published-print` {_DATE}, `published-online` {_DATE}, volume string, page string, `article-number` string, type string, `updated-by` array<struct<type:string>>"
_SUMMARY = "title string, authors array<struct<name:string,authtype:string>>, pubdate string, volume string, pages string, articleids array<struct<idtype:string,value:string>>, pubtype array<string>"
RECORD = ["title", "families", "years", "record_volume", "record_page", "article_number", "record_doi", "type", "pmid", "retracted"]


def _none(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def crossref_record(work: Column) -> Column:
    """A struct of RECORD from one work's JSON text."""
    w = F.from_json(work, _WORK)
    year = lambda name: w[name]["date-parts"][0][0].cast("string")
    years = F.array_compact(F.array(year("published-print"), year("issued"), year("published-online")))
    families = F.filter(F.coalesce(F.transform(w["author"], lambda a: a["family"]), F.array().cast("array<string>")), lambda f: _none(f) != "")
    gone = F.exists(F.coalesce(w["updated-by"], F.array().cast("array<struct<type:string>>")), lambda u: F.coalesce(u["type"].isin(*fixed.RETRACTION_TYPES), F.lit(False)))
    values = [F.array_join(w["title"], " "), families, years, _none(w["volume"]), _none(w["page"]), _none(w["article-number"]), _none(w["DOI"]), _none(w["type"]), F.lit(""), gone]
    return F.struct(*[v.alias(n) for v, n in zip(values, RECORD)])


def pubmed_record(summary: Column, pmid: Column) -> Column:
    """A struct of RECORD from one summary's JSON text; null without a title. Group names have no initials and are left out."""
    s = F.from_json(summary, _SUMMARY)
    people = F.filter(F.coalesce(s["authors"], F.array().cast("array<struct<name:string,authtype:string>>")), lambda a: (F.coalesce(a["authtype"], F.lit("Author")) == "Author") & F.contains(_none(a["name"]), F.lit(" ")))
    families = F.transform(people, lambda a: F.regexp_replace(a["name"], " [^ ]*$", ""))
    year = F.substring(_none(s["pubdate"]), 1, 4)
    ids = F.filter(F.coalesce(s["articleids"], F.array().cast("array<struct<idtype:string,value:string>>")), lambda a: a["idtype"] == "doi")
    years = F.when(year.rlike("^\\d+$"), F.array(year.cast("int").cast("string"))).otherwise(F.array().cast("array<string>"))
    gone = F.array_contains(F.coalesce(s["pubtype"], F.array().cast("array<string>")), "Retracted Publication")
    values = [s["title"], families, years, _none(s["volume"]), _none(s["pages"]), F.lit(""), _none(F.get(ids, 0)["value"]), F.lit("pubmed"), pmid, gone]
    return F.when(_none(s["title"]) != "", F.struct(*[v.alias(n) for v, n in zip(values, RECORD)]))


# ---- matching and comparison -------------------------------------------------------------------------------------


def title_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda w: (F.length(w) >= 3) & ~w.isin(*fixed.TITLE_STOP))


def _share(words: Column, held: Column) -> Column:
    """Repeated words count as often as they stand."""
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.array_contains(held, w))) / F.size(words))


def title_match(title: Column, raw: Column) -> Column:
    """full: 80 % of the title's words are in the entry; main: all words before the subtitle, three or more. Both are folded texts."""
    whole, main, held = title_words(title), title_words(F.split(title, "[:?]\\s")[0]), F.array_distinct(title_words(raw))
    return F.when(_share(whole, held) >= 0.8, "full").when((F.size(main) >= 3) & (_share(main, held) >= 1.0), "main").otherwise("")


def letters(name: Column) -> Column:
    """Of a folded name."""
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def page_key(page: Column) -> Column:
    return F.regexp_replace(F.lower(page), "[^a-z0-9]", "")


def same_work(rows: DataFrame) -> DataFrame:
    """Adds same: the title agrees, the first author is the listed one, and for books the year too."""
    rows = rows.withColumns({"_title": matching.folded(F.col("title")), "_raw": matching.folded(F.replace(F.replace(F.col("raw"), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))), "_first": matching.folded(F.get("families", 0)), "_want": matching.folded(F.col("surname"))})
    first, want = F.col("_first"), F.col("_want")
    author = first.isNull() | (first == want) | first.contains(want) | want.contains(first) | (F.levenshtein(first, want, 2) >= 0)
    year = ~(F.col("non_article") & (F.col("year") != "") & (F.size("years") > 0)) | F.array_contains("years", F.col("year"))
    return rows.withColumn("title_match", title_match(F.col("_title"), F.col("_raw"))).withColumn("same", (F.col("title_match") != "") & author & year).drop("_title", "_raw", "_first", "_want")


def compare(rows: DataFrame) -> DataFrame:
    """Adds diffs: fields (year, volume, first_page, doi) that both have and that differ."""
    volume = F.regexp_replace("record_volume", "^\\D+", "")
    article = F.when(F.col("article_number").rlike("^e?\\d+$"), F.col("article_number")).otherwise("")
    page = F.split(F.when(F.col("record_page") != "", F.col("record_page")).otherwise(article), "-")[0]
    one = lambda name, bad, listed, record: F.when(bad, F.struct(F.lit(name).alias("field"), listed.alias("listed"), record.alias("record")))
    c = F.col
    found = [
        one("year", (c("year") != "") & (F.size("years") > 0) & ~F.array_contains("years", c("year")), c("year"), F.get("years", 0)),
        one("volume", (c("volume") != "") & (volume != "") & (c("volume") != volume), c("volume"), volume),
        one("first_page", (c("first_page") != "") & (page != "") & (page_key(c("first_page")) != page_key(page)), c("first_page"), page),
        one("doi", (c("doi") != "") & (c("record_doi") != "") & (c("doi") != F.lower("record_doi")) & ~c("by_doi"), c("doi"), F.lower("record_doi")),
    ]
    return rows.withColumn("diffs", F.array_compact(F.array(*found)))


def compare_authors(rows: DataFrame) -> DataFrame:
    """Adds author_diffs: other counts (unless et al.) and listed names that the record lacks; a shortened record is let pass."""
    like = lambda a, b: a.contains(b) | b.contains(a)
    # names are folded whole, in one string, as a Python function cannot run inside a lambda
    folded = lambda c: F.transform(F.when(F.size(c) > 0, F.split(matching.folded(F.array_join(c, "\n")), "\n")).otherwise(F.array().cast("array<string>")), letters)
    rows = rows.withColumn("_rec", folded(F.col("families"))).withColumn("_lst", folded(F.col("surnames")))
    rec, lst = F.col("_rec"), F.col("_lst")
    short = (F.size(rec) < F.size(lst)) & F.forall(rec, lambda f: F.exists(lst, lambda n: like(f, n)))
    absent = F.transform(F.filter(F.arrays_zip(F.col("surnames").alias("n"), F.col("_lst").alias("k")), lambda x: ~F.exists(rec, lambda f: like(f, x["k"]))), lambda x: x["n"])
    extra = F.transform(F.filter(F.arrays_zip(F.col("families").alias("n"), F.col("_rec").alias("k")), lambda x: ~F.exists(lst, lambda n: like(x["k"], n))), lambda x: x["n"])
    count = F.when(~F.col("et_al") & (F.size(lst) > 0) & (F.size(lst) != F.size(rec)), F.struct(F.lit("authors").alias("field"), F.size(lst).cast("string").alias("listed"), F.size(rec).cast("string").alias("record")))
    names = F.when(F.size(absent) > 0, F.struct(F.lit("author_names").alias("field"), F.array_join(absent, ", ").alias("listed"), F.array_join(extra, ", ").alias("record")))
    return rows.withColumn("author_diffs", F.when((F.size("families") == 0) | short, F.array().cast("array<struct<field:string,listed:string,record:string>>")).otherwise(F.array_compact(F.array(count, names)))).drop("_rec", "_lst")


def resolve(refs: DataFrame, responses: DataFrame) -> DataFrame:
    """refs (ref_id, doi, ...) against recorded responses (ref_id, stage, ...): the first stage with the same work.

    Stages in order: 1 record by DOI, 2 search, 3 citation match. Retracted beats mismatch beats verified.
    """
    rows = same_work(refs.join(responses, "ref_id"))
    best = rows.where("same").groupBy("ref_id").agg(F.min("stage").alias("stage"))
    met = compare_authors(compare(rows.join(best, ["ref_id", "stage"]).withColumn("by_doi", F.col("stage") == 1)))
    main = F.when(F.col("title_match") == "main", F.array(F.struct(F.lit("title").alias("field"), F.lit("main title only").alias("listed"), F.col("title").alias("record"))))
    met = met.withColumn("diffs", F.concat("diffs", F.coalesce(main, F.array().cast("array<struct<field:string,listed:string,record:string>>")), "author_diffs")).select("ref_id", "stage", "diffs", "retracted")
    status = F.when(F.col("stage").isNull(), "not_found").when(F.col("retracted"), "retracted").when(F.size("diffs") > 0, "mismatch").otherwise("verified")
    return refs.select("ref_id").join(met, "ref_id", "left").select("ref_id", "stage", status.alias("status"), "diffs")


def summary(found: DataFrame) -> DataFrame:
    """Counts by status and by differing field, in one table (kind, name, n)."""
    by_status = found.groupBy(F.lit("status").alias("kind"), F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_field = found.select(F.explode("diffs.field").alias("name")).groupBy(F.lit("field").alias("kind"), "name").agg(F.count(F.lit(1)).alias("n"))
    return by_status.unionByName(by_field)


def fuller(records: DataFrame) -> DataFrame:
    """Of several records of one entry (ref_id, place, ...) the one with the most authors, the first of equal ones."""
    order = Window.partitionBy("ref_id").orderBy(F.desc(F.size("families")), "place")
    return records.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def hints(refs: DataFrame, found: DataFrame) -> DataFrame:
    """refs (ref_id, doi, non_article) and found (ref_id, stage, status, doi_seen: whether the listed DOI has a record) to ref_id, hint."""
    rows = refs.join(found, "ref_id", "left")
    doi = F.when((F.col("doi") != "") & ~F.coalesce(F.col("stage") == 1, F.lit(False)), F.when(F.col("doi_seen"), "listed DOI points to another work").otherwise("listed DOI not registered"))
    none = F.col("stage").isNull()
    check = F.when(none & F.col("non_article"), "no volume/pages listed (book, chapter, manual, software?): check by hand").when(none & (doi == "listed DOI not registered"), "DOI not registered and no matching record: check that this work exists")
    return rows.select("ref_id", F.coalesce(check, doi, F.lit("")).alias("hint"))


def errors(found: DataFrame, failed: DataFrame) -> DataFrame:
    """Entries whose look-up failed (ref_id, error) get the status error."""
    rows = found.join(failed.select("ref_id", "error"), "ref_id", "left")
    return rows.withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status"))).drop("error")


# ---- addresses ---------------------------------------------------------------------------------------------------
def crossref_url(ref: Column) -> Column:
    """The bibliographic search of one entry: its first 500 characters, three rows."""
    return F.concat(F.lit(f"{CROSSREF}?query.bibliographic="), F.url_encode(F.substring(ref, 1, 500)), F.lit("&rows=3"))


def doi_url(doi: Column) -> Column:
    return F.concat(F.lit(f"{CROSSREF}/"), F.replace(F.url_encode(doi), F.lit("%2F"), F.lit("/")))


def _ncbi(page: str, last: Column, email: str) -> Column:
    mail = f"&email={email}" if email else ""
    return F.concat(F.lit(f"{EUTILS}/{page}.fcgi?db=pubmed&retmode=json{mail}&"), last)


def pubmed_doi_url(doi: Column, email: str = "") -> Column:
    return _ncbi("esearch", F.concat(F.lit("term="), F.url_encode(F.concat(doi, F.lit("[doi]")))), email)


def pubmed_citation_url(surname: Column, volume: Column, first_page: Column, email: str = "") -> Column:
    """First author, volume and first page, without the year, so that a wrong year is found too; null without volume or page."""
    term = F.concat(surname, F.lit("[1au] AND "), volume, F.lit("[vi] AND "), first_page, F.lit("[pg]"))
    return F.when((volume != "") & (first_page != ""), _ncbi("esearch", F.concat(F.lit("term="), F.url_encode(term)), email))


def pubmed_record_url(pmid: Column, email: str = "") -> Column:
    return _ncbi("esummary", F.concat(F.lit("id="), pmid), email)


def pubmed_ids(body: Column, by_doi: bool) -> Column:
    """Ids of a search's answer: by DOI only a single hit counts, else the first three."""
    ids = F.coalesce(F.from_json(body, "esearchresult struct<idlist:array<string>>")["esearchresult"]["idlist"], F.array().cast("array<string>"))
    return F.when(F.size(ids) == 1, ids).otherwise(F.array().cast("array<string>")) if by_doi else F.slice(ids, 1, 3)
