"""Small inline tables for rules that the corpus does not exercise; the same rows serve Spark and SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

LABEL = ["supported", "partially_supported", "disputed", "unsupported"]

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "refs": (
        "doc_id long, ordinal int, raw string",
        [
            (1, 1, "Alder, J. (2019). Rivers and their bridges. Journal of Water, 14(2), 117-131."),
            (1, 2, "Birch, K., & Oak, L. (2020a). Lamps in winter. Light, 3, 5-9."),
            (1, 3, ""),
            (1, 4, "Cedar, M. (2018). A first book of stones. North Press."),
            (1, 5, "Dogwood, P. (2021). Quiet streets. City Studies, 8, 44-60."),
            (1, 6, "Dogwood, P. (2021). Quiet streets. City Studies, 8, 44-60."),
            (1, 7, "Pinewood, A. (2017). Needles. Trees, 1, 1-4."),
            (2, 1, "van den Berg, A. (2015). Low land. Maps, 2, 10-12."),
            (2, 2, "Fir 2016 a note without brackets"),
            (2, 3, "Mr. nobody wrote nothing"),
        ],
    ),
    "bodies": (
        "doc_id long, idx int, text string",
        [
            (1, 0, "Rivers bend (Alder, 2019; Birch et al., 2020a). Oakley (2019) denies it, and Pinewod (2017) agrees."),
            (1, 1, "As Tamarack (2014) and Cedar's (2017) work shows, stones roll (see Cedar, 2018, 2019). Figure (2020) is no name."),
            (2, 0, "The land is low (van den Berg, 2015) and Fir 2016 says so [1-3], [5], [2, 4] [7-1]."),
            (3, 0, "Numbers only: [2], [1], [3-5] and [9]."),
        ],
    ),
    "votes_json": (
        "item_id int, raw string",
        [
            (1, '{"label": "supported", "reason": "said"}'),
            (2, 'Sure: {"label": "supported", "strength": "claim_stronger", "reason": "too strong"} done'),
            (3, '{"label": "supported", "plan_as_result": "true"}'),
            (4, '{"label": "partially_supported", "misattributed": " TRUE "}'),
            (5, '{"label": "maybe"}'),
            (6, "no answer at all"),
            (7, '{"label": "supported", "plan_as_result": "false", "strength": "equal"}'),
            (8, '{"label": "supported"'),
        ],
    ),
    "stages": (
        "source string, claim string, attribution string",
        list(product(["result", "hypothesis", "plan_or_method", "other_study", "background", "odd"], ["finding", "method", "hypothesis_or_plan", "odd"], ["this_study", "other", None])),
    ),
    "panel3": ("item_id int, a string, b string, c string", [(k, *t) for k, t in enumerate(product([*LABEL, None], repeat=3))]),
    "sentences": (
        "item_id int, s string",
        [
            (1, "The passages do not mention any such effect."),
            (2, "This is not stated in the given context."),
            (3, "Rivers were longer in spring."),
            (4, "You would need to consult the original article."),
            (5, "Is the river longer in spring?"),
            (6, "Do lamps burn at night?"),
            (7, "研究中未提及相關數據。"),
            (8, "河流是否較長？"),
            (9, "Further research is needed to tell."),
            (10, "There is no information on lamps."),
            (11, "燈會亮嗎？"),
            (12, "It was reported that lamps burn."),
        ],
    ),
    "paths": (
        "item_id int, section_path string, section string",
        [
            (1, "Results|Main effects", "Main effects"),
            (2, "Method|Hypotheses", "Hypotheses"),
            (3, "Introduction|Discussion of rivers", "Discussion of rivers"),
            (4, "Stones|Procedure", "Procedure"),
            (5, "Hypotheses|Participants", "Participants"),
            (6, "", "Limitations"),
            (7, "", ""),
            (8, "研究方法", "研究方法"),
            (9, "Stones|Findings|Analysis", "Analysis"),
            (10, "Theory", "Theory"),
        ],
    ),
    "works": (
        "ref_id string, raw string, surname string, surnames string, et_al boolean, non_article boolean, year string, volume string, first_page string, doi string, stage int, title string, families string, years string, record_volume string, record_page string, article_number string, record_doi string, retracted boolean",
        [
            ("r1", "Alder, J. (2019). Rivers and their bridges. Journal of Water, 14(2), 117-131.", "Alder", "Alder", False, False, "2019", "14", "117", "10.1/a", 1, "Rivers and their bridges", "Alder", "2019", "14", "117-131", "", "10.1/A", False),
            ("r2", "Birch, K., & Oak, L. (2020). Lamps in winter. Light, 3, 5-9.", "Birch", "Birch|Oak", False, False, "2020", "3", "5", "", 2, "Lamps in winter", "Birch|Oak", "2021|2020", "Volume 4", "5-9", "", "10.1/b", False),
            ("r3", "Cedar, M. (2018). A first book of stones: rolling home. North Press.", "Cedar", "Cedar", False, True, "2018", "", "", "", 2, "A first book of stones: rolling home", "Ceder", "2016", "", "", "", "", False),
            ("r4", "Dogwood, P. (2021). Quiet streets. City Studies, 8, 44-60.", "Dogwood", "Dogwood", False, False, "2021", "8", "44", "", 2, "Quiet streets", "Dogwood", "2021", "8", "e44-60", "", "", True),
            ("r5", "Elm, Q. (2011). Roots run deep. Trees, 1, 617814.", "Elm", "Elm|Fir", False, False, "2011", "1", "617814", "", 3, "Roots run deep", "Elm", "2011", "1", "", "617814", "", False),
            ("r6", "Gum, R. (2012). Leaves fall. Trees, 2, 7-8.", "Gum", "Gum", False, False, "2012", "2", "7", "", 2, "A wholly other title here", "Gum", "2012", "2", "7-8", "", "", False),
            ("r6", "Gum, R. (2012). Leaves fall. Trees, 2, 7-8.", "Gum", "Gum", False, False, "2012", "2", "7", "", 3, "Leaves fall", "Gum|Hazel", "2012", "2", "9-10", "", "", False),
        ],
    ),
    "rates": ("item_id int, k long, n long", [(1, 0, 20), (2, 20, 20), (3, 3, 55), (4, 10, 20), (5, 0, 0), (6, 26, 31), (7, 1, 3), (8, 999, 100000)]),
    "pairs2": ("item_id int, b long, c long", [(1, 5, 0), (2, 0, 0), (3, 3, 3), (4, 8, 2), (5, 40, 21), (6, 1, 0)]),
    "answers": (
        "query_id int, raw string",
        [
            (1, '<answer><claim citation_ids="a, b">Rivers bend.<quote>rivers do bend</quote></claim></answer>'),
            (2, '<answer><refusal/></answer>'),
            (3, '<answer><claim citation_ids="[chunk_id: a]">Lamps burn.</claim> <quote>lamps burn</quote><refusal>rest</refusal></answer>'),
            (4, '<answer><claim citation_ids="a">查無直接支持此說法的段落。</claim></answer>'),
            (5, '<answer><claim citation_ids="a">Open claim without an end'),
            (6, "plain words"),
            (7, '<answer><claim citation_ids="">x</quote> y</claim><unsupported_note> more </unsupported_note></answer>'),
        ],
    ),
    "changeable": (
        "item_id int, s string",
        [
            (1, "In 2019 the share increased to 12 percent"),
            (2, "H1a: Lamps will reduce mud in 3.5 weeks"),
            (3, "Alder et al. (2019) found that rivers may bend"),
            (4, "Birch (2020) reported that rivers suggest that streets are positively associated with rain"),
            (5, "Stones were shown to roll (Cedar, 2018)"),
            (6, "Quiet words"),
        ],
    ),
    "styled": (
        "doc_id long, idx int, text string, style string",
        [(1, k, t, y) for k, (t, y) in enumerate([("A title", "Heading 1"), ("Abstract", "Heading 1"), ("First words", "Normal"), ("2 Method", "Heading 1"), ("2.1 Deep", "Heading 3"), ("2.1.1.1 Deeper", "Heading 6"), ("Second words", "Normal"), ("2.2 Flat", "Heading 2"), ("  ", "Normal"), ("Third words", "Normal"), ("x" * 121, "Heading 1"), ("References", "Heading 1"), ("Alder", "Normal")])],
    ),
    "sectioned": (
        "doc_id long, idx int, text string, path string, section_number string, page int",
        [
            (1, 0, "Rivers bend (Alder, 2019) and lamps burn", "Intro", "1", 1),
            (1, 1, "streets are quiet now (Dogwood, 2021; Oak, 2000)", "Intro", "1", 2),
            (1, 2, "tail", "Intro", "1", 2),
            (1, 3, "Alder (2019) says so", "Method", "2", 2),
            (1, 4, "more of it here (Alder, 2019)", "Method|Deep", "2.1", 3),
        ],
    ),
    "near_quotes": (
        "item_id int, quote string, passage string",
        [
            (1, "Rivers  do “bend” here", 'x rivers do "bend" here y'),
            (2, "rivers do bend slowly over the wide green plains", "rivers do bend slowly over the wide grean plains"),
            (3, "nothing of the kind stands anywhere", "rivers bend"),
            (4, " . ", "rivers"),
            (5, "lamps burn", "streets are quiet"),
            (5, "lamps burn", "Lamps burn at night"),
        ],
    ),
    "claims": (
        "query_id int, claim_idx int, statement string, ids string, quote string",
        [
            (1, 0, "Rivers bend", "a", "rivers bend in the wide plain"),
            (1, 1, "Lamps burn brightly tonight", "a", "lamps burn brightly all night"),
            (1, 2, "Made up", "a", "this was never written in any of these"),
            (1, 3, "Rivers bend in the wide plain.", "a", ""),
            (1, 4, "Lamps burn and rivers bend", "a", "Rivers bend in the wide plain. Lamps burn brightly all night."),
            (1, 5, "People sleep longer with lamps at night", "c", ""),
            (1, 6, "Bridges are strong", "zz", ""),
            (2, 0, "這證明河流彎曲", "e", ""),
            (2, 1, "The lamps improved sleep", "d", ""),
            (2, 2, "Rivers bend in spring", "e", ""),
            (2, 3, "Rivers are dry", "e", ""),
            (2, 4, "Rivers in the northern plains bend more in early spring.", "e", ""),
            (2, 5, "Lamps are lit", "e", ""),
            (3, 0, "Reading outdoors makes people calmer", "g", ""),
        ],
    ),
    "contexts": (
        "query_id int, chunk_id string, text string, heading string, rank int",
        [
            (1, "a", "Rivers bend in the wide plain.", "Results", 1),
            (1, "b", "Lamps burn brightly all night. They were lit early.", "Results", 2),
            (1, "c", "H1: Lamps make people sleep longer at night.", "Introduction > Hypotheses", 3),
            (2, "d", "We will compare sleep outcomes between the two groups.", "Method", 1),
            (2, "e", "Rivers may bend in spring.", "Results", 2),
            (3, "f", "H1: Reading outdoors makes people calmer in the evening.", "Introduction", 1),
            (3, "g", "Participants read books in a garden.", "Results", 2),
        ],
    ),
    "asked": ("query_id int, question string", [(1, "What do rivers do?"), (2, "Do rivers in the northern plains bend more in early spring?"), (3, "Why do people read?")]),
    "claim_votes": (
        "item_id string, judge string, label string",
        [(f"{i}|{c}", j, x) for i, c, *two in [("2|0", "e", "supported", "supported"), ("2|1", "d", "supported", "supported"), ("2|2", "e", "supported", "partially_supported"), ("2|3", "e", "unsupported", "partially_supported"), ("2|4", "e", "partially_supported", "partially_supported"), ("3|0", "g", "partially_supported", "partially_supported")] for j, x in zip("pq", two)],
    ),
    "nli": ("item_id string, entailment double, contradiction double", [("1|0|a", 0.7, 0.1), ("1|1|b", 0.1, 0.8), ("1|3|a", 0.3, 0.2), ("1|4|a", 0.1, 0.9), ("1|4|b", 0.61, 0.1)]),
    "entries": (
        "ref_id string, raw string, key_surname string, key_year string",
        [
            ("l1", "Alder, J., & Birch, K. B. (2019). Rivers and their bridges. Journal of Water, 14(2), 117–131. https://doi.org/10. 1016/j.x.2019.01. 002", "Alder", "2019"),
            ("l2", "Cedar, M., et al. (2018a). A first book of stones. North Press.", "Cedar", "2018a"),
            ("l3", "van den Berg, A., Oak, L., … Elm, Q. (2015). Low land. Maps 12, e44. doi:10.1000/ABC.", "van den Berg", "2015"),
            ("l4", "No year here. Plain, 3, 5.", "No", ""),
        ],
    ),
    "records": (
        "id string, kind string, body string",
        [
            ("w1", "crossref", '{"DOI":"10.1/A","title":["Rivers","and bridges"],"author":[{"family":"Alder"},{"name":"A group"},{"family":"Birch"}],"issued":{"date-parts":[[2019,3]]},"published-print":{"date-parts":[[2020]]},"volume":"Volume 14","page":"117-131","type":"journal-article","updated-by":[{"type":"retraction"}]}'),
            ("w2", "crossref", '{"title":["Stones"],"issued":{"date-parts":[[null]]},"article-number":"e12"}'),
            ("p1", "pubmed", '{"title":"Low land.","authors":[{"name":"Van Orden GC","authtype":"Author"},{"name":"Group","authtype":"CollectiveName"},{"name":"Oak L"}],"pubdate":"2015 Mar","volume":"12","pages":"44-9","articleids":[{"idtype":"pii","value":"x"},{"idtype":"doi","value":"10.1/P"}],"pubtype":["Retracted Publication"]}'),
            ("p2", "pubmed", '{"title":"","pubdate":"none"}'),
        ],
    ),
    "searches": (
        "id string, body string",
        [("s1", '{"esearchresult":{"idlist":["11"]}}'), ("s2", '{"esearchresult":{"idlist":["21","22","23","24"]}}'), ("s3", '{"esearchresult":{}}')],
    ),
    "arms": (
        "arm string, part string, question_id string, type string, labels string, refused boolean, parse_failed boolean",
        [
            *[("grounded", "answer", f"q{k}", None, x, False, False) for k, x in enumerate(["supported|supported", "supported|partially_supported", "unsupported", "", "supported"])],
            *[("baseline", "answer", f"q{k}", None, x, False, False) for k, x in enumerate(["supported|unsupported", "unsupported", "unsupported|disputed", "supported", "partially_supported"])],
            *[("grounded", "trap", f"t{k}", t, x, r, f) for k, (t, x, r, f) in enumerate([("far_absent", "", True, False), ("near_absent", "supported", False, False), ("false_premise", "supported|partially_supported", False, False), ("hypothesis_bait", "supported", False, False), ("hypothesis_bait", "", False, True)])],
            *[("baseline", "trap", f"t{k}", t, x, r, f) for k, (t, x, r, f) in enumerate([("far_absent", "unsupported", False, False), ("near_absent", "disputed", True, False), ("false_premise", "supported", False, False), ("hypothesis_bait", "unsupported", False, False)])],
        ],
    ),
    "judged_claims": (
        "claim_id string, query_id int, part string, statement string, label string, seen string",
        [
            ("c1", 1, "answer", "Rivers bend in the wide plain", "unsupported", "b"),
            ("c2", 1, "answer", "Lamps burn", "supported", "a"),
            ("c3", 1, "trap", "Lamps burn brightly", "partially_supported", "a"),
            ("c4", 1, "trap", "Nothing fits at all here", "disputed", "a|b|c"),
            ("c5", 2, "answer", "Walls crumble everywhere", "disputed", "d"),
        ],
    ),
    "pdf_lines": (
        "doc_id long, page int, block int, line int, text string, size double, bold boolean, italic boolean, x0 double, x1 double, y1 double",
        [
            (1, 1, 0, 0, "Journal of Water and Light", 8.0, False, False, 50.0, 200.0, 20.0),
            (1, 1, 1, 0, "A B S T R A C T", 8.0, True, False, 50.0, 200.0, 60.0),
            (1, 1, 2, 0, "Rivers bend in the plain and their brid-", 9.0, False, False, 50.0, 300.0, 80.0),
            (1, 1, 2, 1, "ges are old.", 9.0, False, False, 50.0, 120.0, 92.0),
            (1, 1, 3, 0, "Received 3 March", 7.0, False, False, 50.0, 120.0, 700.0),
            (1, 1, 4, 0, "https://doi.org/10.1/x", 7.0, False, False, 50.0, 120.0, 712.0),
            (1, 1, 5, 0, "After the abstract the body goes on in its own size.", 10.0, False, False, 50.0, 300.0, 300.0),
            (1, 1, 6, 0, "1", 10.0, False, False, 290.0, 300.0, 780.0),
            (1, 2, 0, 0, "Journal of Water and Light", 8.0, False, False, 50.0, 200.0, 20.0),
            (1, 2, 1, 0, "2.1.", 10.0, True, False, 50.0, 70.0, 60.0),
            (1, 2, 1, 1, "Lamps at night", 10.0, True, False, 72.0, 160.0, 60.4),
            (1, 2, 2, 0, "Lamps burn, and people sleep under them when the winter is long.", 10.0, False, False, 50.0, 300.0, 80.0),
            (1, 2, 3, 0, "Table 1 Lamps by street", 10.0, False, False, 50.0, 200.0, 200.0),
            (1, 2, 4, 0, "12 (3.4) 5.6", 10.0, False, False, 50.0, 120.0, 212.0),
            (1, 2, 5, 0, "See doi 10.1234/abc.", 10.0, False, False, 50.0, 160.0, 300.0),
            (1, 2, 5, 1, "2019", 10.0, False, False, 50.0, 80.0, 312.0),
            (1, 3, 0, 0, "Journal of Water and Light", 8.0, False, False, 50.0, 200.0, 20.0),
            (1, 3, 1, 0, "References", 10.0, True, False, 50.0, 120.0, 60.0),
            (1, 3, 2, 0, "Alder, J. (2019). Rivers and", 10.0, False, False, 50.0, 200.0, 80.0),
            (1, 3, 2, 1, "their bridges.", 10.0, False, False, 50.0, 120.0, 92.0),
        ],
    ),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def cte(name: str) -> str:
    """The same rows as a named SQL table expression."""
    schema, rows = TABLES[name]
    names = ", ".join(f.split()[0] for f in schema.split(", "))
    return f"{name}({names}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"
