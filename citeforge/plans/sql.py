"""DuckDB SQL with the results of the registered queries, written apart from their plans."""

from __future__ import annotations

from citeforge.functions import fixed
from citeforge.plans.fixtures import cte

_WORDS = r"len(regexp_extract_all({}, '[^\x09-\x0D \x85\xA0]+'))"

_PARAS = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents WHERE text IS NOT NULL),
paras AS (SELECT doc_id, idx::INT AS idx, text, {_WORDS.format('text')}::INT AS w, floor({_WORDS.format('text')} * 1.3::DOUBLE)::INT AS tok,
    row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rn FROM lines WHERE regexp_matches(text, '[^\\x09-\\x0D \\x85\\xA0]'))"""

_SECTION = f"""{_PARAS},
fold AS (SELECT doc_id, rn, 0 AS c, tok AS t FROM paras WHERE rn = 1 UNION ALL
    SELECT p.doc_id, p.rn, CASE WHEN f.t + p.tok > 380 AND f.t > 0 THEN f.c + 1 ELSE f.c END, CASE WHEN f.t + p.tok > 380 AND f.t > 0 THEN p.tok ELSE f.t + p.tok END
    FROM fold f JOIN paras p ON p.doc_id = f.doc_id AND p.rn = f.rn + 1),
raw AS (SELECT doc_id, c, sum(tok) AS t, max(c) OVER (PARTITION BY doc_id) AS top FROM fold JOIN paras USING (doc_id, rn) GROUP BY doc_id, c),
chunk AS (SELECT p.doc_id, CASE WHEN r.t < 40 AND r.c = r.top AND r.c > 0 THEN r.c - 1 ELSE r.c END AS chunk_no, p.idx, p.text, p.w FROM fold f JOIN paras p USING (doc_id, rn) JOIN raw r ON r.doc_id = f.doc_id AND r.c = f.c),
section_chunks AS (SELECT doc_id, chunk_no::INT AS chunk_no, min(idx)::INT AS para_start, max(idx)::INT AS para_end, sum(w)::INT AS n_words, floor(sum(w) * 1.3::DOUBLE)::INT AS est_tokens, string_agg(text, chr(10) ORDER BY idx) AS text,
    doc_id * 1000000 + chunk_no AS ordinal, 'd' || doc_id || '_section_' || lpad(chunk_no::VARCHAR, 4, '0') AS chunk_id FROM chunk GROUP BY doc_id, chunk_no)"""

_FIXED = f"""cum AS (SELECT doc_id, rn, idx, text, w, sum(tok) OVER (PARTITION BY doc_id ORDER BY rn) AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM paras),
edge AS (SELECT doc_id, rn AS k, s FROM cum UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM cum),
stop AS (SELECT a.doc_id, a.k AS i, a.s AS si, coalesce(min(CASE WHEN b.s - a.s >= 320 THEN b.k END), max(b.k)) AS j FROM edge a JOIN edge b ON a.doc_id = b.doc_id AND b.k > a.k GROUP BY a.doc_id, a.k, a.s),
stop_s AS (SELECT p.*, e.s AS sj, (SELECT max(k) FROM edge x WHERE x.doc_id = p.doc_id) AS n FROM stop p JOIN edge e ON e.doc_id = p.doc_id AND e.k = p.j),
hop AS (SELECT p.doc_id, p.i, p.j, p.n, coalesce(max(CASE WHEN p.sj - e.s >= 64 THEN e.k END), p.i + 1) AS nx FROM stop_s p LEFT JOIN edge e ON e.doc_id = p.doc_id AND e.k > p.i AND e.k < p.j GROUP BY p.doc_id, p.i, p.j, p.n),
walk AS (SELECT doc_id, 0 AS no, i, j, n, nx FROM hop WHERE i = 0 UNION ALL SELECT h.doc_id, w.no + 1, h.i, h.j, h.n, h.nx FROM walk w JOIN hop h ON h.doc_id = w.doc_id AND h.i = w.nx AND w.j < w.n),
fixed_chunks AS (SELECT w.doc_id, w.no::INT AS chunk_no, min(c.idx)::INT AS para_start, max(c.idx)::INT AS para_end, sum(c.w)::INT AS n_words, floor(sum(c.w) * 1.3::DOUBLE)::INT AS est_tokens, string_agg(c.text, chr(10) ORDER BY c.idx) AS text FROM walk w JOIN cum c ON c.doc_id = w.doc_id AND c.rn > w.i AND c.rn <= w.j GROUP BY w.doc_id, w.no)"""

_TERMS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda t: lower(t))"
_BM25 = f"""{_SECTION},
posted AS (SELECT term, ordinal, count(*) AS tf, any_value(dl) AS dl FROM (SELECT ordinal, unnest(terms) AS term, len(terms) AS dl FROM (SELECT ordinal, {_TERMS.format('text')} AS terms FROM section_chunks)) GROUP BY term, ordinal),
size AS (SELECT count(*) AS n, avg(len({_TERMS.format('text')})) AS avgdl FROM section_chunks),
df AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
raw_idf AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS r FROM df, size),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT avg(r) FROM raw_idf) ELSE r END AS idf FROM raw_idf),
asked AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
part AS (SELECT query_id, ordinal, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM asked JOIN posted USING (term) JOIN idf USING (term), size GROUP BY query_id, ordinal),
every AS (SELECT item_id AS query_id, section_chunks.ordinal, coalesce(score, 0.0::DOUBLE) AS score FROM benchmark CROSS JOIN section_chunks LEFT JOIN part p ON p.query_id = item_id AND p.ordinal = section_chunks.ordinal),
sparse AS (SELECT query_id, ordinal, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) - 1)::INT AS sparse_rank FROM every QUALIFY sparse_rank < 20),
passages AS (SELECT s.query_id, c.chunk_id, s.sparse_rank AS position, c.text, c.doc_id, c.para_start, c.para_end FROM sparse s JOIN section_chunks c USING (ordinal))"""

_VEC = "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE embedding IS NOT NULL)"
_DENSE = f"""{_VEC},
dense AS (SELECT q.id AS query_id, x.id, round(list_dot_product(q.v, x.v), 9) AS sim, (row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, x.v), 9) DESC, x.id) - 1)::INT AS dense_rank
    FROM vec q JOIN vec x ON q.id <> x.id WHERE q.id % 50 = 0 QUALIFY dense_rank < 20)"""

_HIT = "count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN hit_rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS hit_at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0::DOUBLE / hit_rank, 0.0::DOUBLE)), 4) AS mrr"
_HITS = f"""{_BM25},
item AS (SELECT item_id AS query_id, string_split(text, chr(10))[1] AS line FROM benchmark),
target AS (SELECT query_id, doc_id, idx AS para FROM item JOIN paras ON CASE WHEN len(string_split(line, ' ')) > 2 THEN contains(paras.text, line) ELSE paras.text = line END WHERE length(line) > 0),
hits AS (SELECT t.query_id, min(CASE WHEN p.position < 10 AND t.para BETWEEN p.para_start AND p.para_end THEN p.position + 1 END) AS hit_rank FROM target t LEFT JOIN passages p ON p.query_id = t.query_id AND p.doc_id = t.doc_id GROUP BY t.query_id)"""


def _form(c: str) -> str:
    flat = f"lower(translate({c}, '“”‘’–—', '\"\"''''--'))"
    flat = rf"regexp_replace(regexp_replace({flat}, '[\x09-\x0D \x85\xA0]+', ' ', 'g'), '^ | $', '', 'g')"
    return f"regexp_replace({flat}, '^[ .…\"'']+|[ .…\"'']+$', '', 'g')"


_CONTENT = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{4,}}'))"


def _lexical(claim: str, passage: str) -> str:
    a, b = _CONTENT.format(claim), _CONTENT.format(passage)
    share = f"(CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE 0.0::DOUBLE END)"
    return f"CASE WHEN {share} >= 0.5 THEN 'supported' WHEN {share} >= 0.2 THEN 'partially_supported' ELSE 'unsupported' END"


_RANK = "CASE label WHEN 'supported' THEN 3 WHEN 'partially_supported' THEN 2 WHEN 'disputed' THEN 1 ELSE 0 END"
_TURNS = "turns AS (SELECT * FROM (SELECT conv_id, turn, role, text AS statement, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS passage FROM conversations) WHERE role = 'assistant' AND statement IS NOT NULL)"
_LABELLED = f"{_TURNS}, labelled AS (SELECT conv_id, turn, {_lexical('statement', chr(99) + 'oalesce(passage, ' + chr(39) * 2 + ')')} AS label FROM turns)"
_COUNTS = "count(*) AS n_claims, count(*) FILTER (label = 'supported') AS n_supported, count(*) FILTER (label = 'partially_supported') AS n_partial, count(*) FILTER (label = 'disputed') AS n_disputed, count(*) FILTER (label = 'unsupported') AS n_unsupported"


def _wilson(k: str, n: str, sign: str) -> str:
    z = "1.959964::DOUBLE"
    p = f"({k} / {n})"
    middle = f"(({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})) / (1 + {z} * {z} / {n}))"
    bound = f"least(1.0::DOUBLE, {middle} + {half})" if sign == "+" else f"greatest(0.0::DOUBLE, {middle} - {half})"
    return f"CASE WHEN {n} > 0 THEN round_even({bound}, 4) END"


_BEST3 = f"""{_BM25},
judged AS (SELECT query_id AS item_id, position, {_lexical('b.text', 'passages.text')} AS label FROM passages JOIN benchmark b ON b.item_id = passages.query_id WHERE position < 3)"""


def _early(top: int) -> str:
    return f"""best{top} AS (SELECT item_id, arg_max(label, {_RANK} * 100 - position) AS label, count(*) AS calls, sum(position + 1.5::DOUBLE) AS seconds FROM (
    SELECT *, coalesce(max((label = 'supported')::INT) OVER (PARTITION BY item_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM judged WHERE position < {top}) WHERE done = 0 GROUP BY item_id)"""


_JUDGED = """judged AS (SELECT l.doc_id AS item_id, coalesce(lang, 'original') AS perturbation, CASE WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS gold_label,
    CASE WHEN n_chars % 11 = 0 THEN 'disputed' WHEN n_chars > 300 THEN 'supported' ELSE 'unsupported' END AS pred FROM labels l JOIN documents USING (doc_id))"""


def _re(pattern: str) -> str:
    """Without the flag that means another thing here."""
    return "'" + pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''").replace("\\u3400", "\\x{3400}").replace("\\u9fff", "\\x{9fff}") + "'"


_PREDICATES = {"refusal": _re(fixed.REFUSAL_HINT), "meta": _re(fixed.META_ADVICE)}
_YES_NO = f"(regexp_matches({{0}}, {_re(fixed.YES_NO_ZH)}) OR regexp_matches({{0}}, {_re(fixed.YES_NO_EN)}))"
# Written out here, so that another rule in the operators shows
_OVERCLAIMS = [
    (r"(?i)\b(is|are|was|were)( positively| negatively| significantly)? (associated|correlated|linked) with\b", r"\1 shown to directly cause"),
    (r"(?i)\b(may|might|could) ", "will always "),
    (r"(?i)\bsuggest(s|ed)? that\b", {"suggests that": "proves that", "suggested that": "proved that", "suggest that": "prove that"}),
    (r"(?i)\b(likely|possibly|potentially) ", "certainly "),
    (r"(?i)\bindicat(es|ed|e) that\b", {"indicates that": "proves that", "indicated that": "proved that", "indicate that": "prove that"}),
    (r"(?i)\b(appears|appear|seems|seem) to\b", {"appears to": "is proven to", "seems to": "is proven to", "appear to": "are proven to", "seem to": "are proven to"}),
    (r"(?i)\bcan ", "will always "),
    (r"(?i)\b(partially|partly) ", "fully "),
]
_FLIPS = "increased decreased increase decrease increases decreases increasing decreasing higher lower greater smaller improved impaired improve impair improves impairs enhanced diminished positive negative positively negatively more less larger smaller stronger weaker better worse reduced increased reduces increases reduce increase".split()


def _overclaims(s: str) -> str:
    """The first rule that matches, its leftmost match replaced: the pieces before, of and after it."""
    out = "CASE"
    for pattern, new in _OVERCLAIMS:
        if isinstance(new, str):
            out += f" WHEN regexp_matches({s}, '{pattern}') THEN regexp_replace({s}, '{pattern}', '{new}')"
        else:
            found = f"regexp_extract({s}, '{pattern}')"
            said = f"CASE lower({found}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in new.items()) + " END"
            out += f" WHEN regexp_matches({s}, '{pattern}') THEN {s}[:strpos({s}, {found}) - 1] || ({said}) || {s}[strpos({s}, {found}) + length({found}):]"
    return out + " END"


def _negate(whole: str) -> str:
    """Letters beyond ASCII count as letters at a word's edge: matching runs on a copy with x for them."""
    s = f"regexp_replace({whole}, '[À-ɏ]', 'x', 'g')"
    table: dict[str, str] = {}
    for a, b in zip(_FLIPS[::2], _FLIPS[1::2]):
        table.setdefault(a, b)
        table.setdefault(b, a)
    flip = r"(?i)\b(" + "|".join(sorted(table, key=lambda w: (-len(w), w))) + r")\b"
    helper = r"\b(is|are|was|were|has|have|does|did|can)\b"
    pairs = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in table.items()) + "}"
    w = f"regexp_extract({s}, '{flip}')"
    turned = f"{pairs}[lower({w})]"
    turned = f"CASE WHEN regexp_matches({w}, '^[A-Z]') THEN upper({turned}[1]) || {turned}[2:] ELSE {turned} END"
    head = lambda p: f"length(string_split_regex({s}, '{p}')[1])"
    v = f"regexp_extract({s}, '{helper}')"
    return f"CASE WHEN regexp_matches({s}, '{flip}') THEN {whole}[:{head(flip)}] || ({turned}) || {whole}[{head(flip)} + length({w}) + 1:] WHEN regexp_matches({s}, '{helper}') THEN {whole}[:{head(helper)}] || CASE WHEN {v} = 'can' THEN 'cannot' ELSE {v} || ' not' END || {whole}[{head(helper)} + length({v}) + 1:] END"


_TRIM = r"regexp_replace({}, '^[\x09-\x0D \x85\xA0]+|[\x09-\x0D \x85\xA0]+$', '', 'g')"
_SPACE = r"[\x09-\x0D \x85\xA0]+"
_CUT_A = f"string_split(regexp_replace({{}}, '([.!?]){_SPACE}([A-Z])', '\\1' || chr(30) || '\\2', 'g'), chr(30))"
_CUT_B = f"string_split(regexp_replace({{}}, '([.!?。！？]){_SPACE}', '\\1' || chr(30), 'g'), chr(30))"
_ITEMS = f"""parts AS (SELECT doc_id, unnest({_CUT_A.format("replace(text, chr(10), ' ')")}) AS s, generate_subscripts({_CUT_A.format("replace(text, chr(10), ' ')")}, 1) AS place FROM documents WHERE text IS NOT NULL),
fit AS (SELECT doc_id, {_TRIM.format('s')} AS s, place FROM parts WHERE length({_TRIM.format('s')}) BETWEEN 60 AND 350 AND {_WORDS.format('s')} >= 8 AND NOT regexp_matches({_TRIM.format('s')}, '^(?:Table|Figure)'))"""

_TYPE = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, {_re(p)}) THEN '{n}'" for n, p in fixed.PASSAGE_TYPES[1:]) + " END"


def _panel(rule: str) -> str:
    n = lambda x: f"len(list_filter(l, lambda x: x = '{x}'))"
    names = ["supported", "partially_supported", "disputed", "unsupported"]
    out = "CASE WHEN len(l) = 0 THEN NULL" + "".join(f" WHEN {n(x)} = len(l) THEN '{x}'" for x in names)
    if rule == "majority":
        out += "".join(f" WHEN {n(x)} * 2 > len(l) THEN '{x}'" for x in names)
    return out + f" WHEN {n('supported')} = 0 THEN CASE WHEN {n('unsupported')} >= {n('partially_supported')} THEN 'unsupported' ELSE 'partially_supported' END ELSE 'disputed' END"


_STAGE = "lower(trim(coalesce({}, '')))"
def _rows(columns: str, rows: list[tuple]) -> str:
    """Rows that were worked out by hand from the rules, for small inline tables. columns: name type, ..."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")))
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names, kinds)) + f" FROM (VALUES {values}) t({', '.join(names)})"


_VERDICT = "query_id INT, claim_idx INT, citation_ids VARCHAR, label VARCHAR, method VARCHAR, quote_check VARCHAR, repaired_from VARCHAR"
_ARMS = f"""{cte('arms')}, lists AS (SELECT *, list_filter(string_split(labels, '|'), lambda x: x <> '') AS l FROM arms),
flags AS (SELECT *, part = 'trap' AS trap, list_contains(l, 'unsupported') AS unsupported, len(list_filter(l, lambda x: x <> 'supported')) > 0 AS not_clean,
    NOT list_contains(l, 'unsupported') AND NOT list_contains(l, 'disputed') AND NOT parse_failed AS safe, type IN ('far_absent', 'near_absent') AS must FROM lists),
q AS (SELECT *, safe AND NOT list_contains(l, 'partially_supported') AS strict_safe, CASE WHEN must THEN refused ELSE safe END AS correct, CASE WHEN must THEN refused ELSE safe AND NOT list_contains(l, 'partially_supported') END AS correct_strict FROM flags)"""
_SUMMED = {
    "strict": ("sum(len(list_filter(l, lambda x: x = 'supported')))", "sum(len(l))", "NOT trap"),
    "lenient": ("sum(len(list_filter(l, lambda x: x IN ('supported', 'partially_supported'))))", "sum(len(l))", "NOT trap"),
    "hallucination": ("sum(len(list_filter(l, lambda x: x = 'unsupported')))", "sum(len(l))", "NOT trap"),
    "answers_unsupported": ("count(*) FILTER (unsupported)", "count(*)", "NOT trap"),
    "answers_not_clean": ("count(*) FILTER (not_clean)", "count(*)", "NOT trap"),
    "must_refuse_safe": ("count(*) FILTER (safe)", "count(*)", "trap AND must"),
}
_PAIRED = [("answers_unsupported", "NOT g.trap", "unsupported"), ("answers_not_clean", "NOT g.trap", "not_clean"), ("must_refuse_safe", "g.trap AND g.must", "safe"), ("traps_correct", "g.trap AND g.type <> 'hypothesis_bait'", "correct"), ("bait_safe", "g.trap AND g.type = 'hypothesis_bait'", "safe"), ("premise_safe", "g.trap AND g.type IN ('false_premise', 'hypothesis_bait')", "safe"), ("premise_strict_safe", "g.trap AND g.type IN ('false_premise', 'hypothesis_bait')", "strict_safe"), ("traps_correct_strict", "g.trap AND g.type <> 'hypothesis_bait'", "correct_strict")]
_PAIRS = " UNION ALL ".join(f"SELECT '{name}' AS comparison, g.{flag} AS x, b.{flag} AS y FROM q g JOIN q b ON g.arm = 'grounded' AND b.arm = 'baseline' AND g.part = b.part AND g.question_id = b.question_id WHERE {rule}" for name, rule, flag in _PAIRED)
_EXACT = "CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))))), 6) END"
_SENT = "string_split(regexp_replace({}, '([.!?。！？])" + _SPACE + "', '\\1' || chr(30), 'g'), chr(30))"
ORACLE_SQL: dict[str, str] = {
    "paragraphs_split": f"WITH {_PARAS} SELECT doc_id, idx, md5(text) AS text_md5, w AS n_words, tok AS est_tokens FROM paras",
    "sentence_counts": f"""WITH d AS (SELECT coalesce(lang, 'none') AS lang, text FROM documents WHERE text IS NOT NULL), p AS ({"SELECT lang, {0} AS a, {1} AS b, {2} AS m, {3} AS c FROM d".format(_CUT_A.format('text'), _CUT_B.format('text'), "string_split(regexp_replace(regexp_replace(text, '([.!?。！？])" + _SPACE + "', '\\1' || chr(30), 'g'), chr(10) || '+', chr(30), 'g'), chr(30))", _CUT_A.format("replace(text, chr(10), ' ')"))})
SELECT lang, sum(len(list_filter(a, lambda s: length({_TRIM.format('s')}) > 15)))::BIGINT AS n_check, sum(len(b))::BIGINT AS n_plain, sum(len(list_filter(m, lambda s: length({_TRIM.format('s')}) >= 15)))::BIGINT AS n_match,
sum(len(list_filter(c, lambda s: length({_TRIM.format('s')}) BETWEEN 60 AND 350 AND {_WORDS.format('s')} >= 8 AND NOT regexp_matches({_TRIM.format('s')}, '^(?:Table|Figure)'))))::BIGINT AS n_candidate FROM p GROUP BY lang""",
    "chunk_section": f"WITH RECURSIVE {_SECTION} SELECT doc_id, chunk_no, para_start, para_end, n_words, est_tokens, md5(text) AS text_md5 FROM section_chunks",
    "chunk_fixed": f"WITH RECURSIVE {_PARAS}, {_FIXED} SELECT doc_id, chunk_no, para_start, para_end, n_words, est_tokens, md5(text) AS text_md5 FROM fixed_chunks",
    "chunk_token_stats": f"WITH RECURSIVE {_SECTION}, {_FIXED}, b AS (SELECT 'section' AS strategy, est_tokens FROM section_chunks UNION ALL SELECT 'fixed', est_tokens FROM fixed_chunks) SELECT strategy, count(*) AS n_chunks, min(est_tokens) AS least, list_sort(list(est_tokens))[count(*) // 2 + 1] AS median, max(est_tokens) AS most FROM b GROUP BY strategy",
    "bm25_term_stats": f"WITH RECURSIVE {_BM25} SELECT term, df, round(idf, 9) AS idf FROM idf",
    "bm25_top20": f"WITH RECURSIVE {_BM25} SELECT query_id, ordinal, round(score, 6) AS score, sparse_rank FROM sparse",
    "dense_top20": f"WITH {_DENSE} SELECT query_id, id, sim, dense_rank FROM dense",
    "dense_label_hit": f"WITH {_DENSE}, hits AS (SELECT d.query_id, min(CASE WHEN x.label = q.label THEN dense_rank + 1 END) AS hit_rank FROM dense d JOIN vec x ON x.id = d.id JOIN vec q ON q.id = d.query_id GROUP BY d.query_id) SELECT {_HIT} FROM hits",
    "rrf_fused_top20": f"""WITH RECURSIVE {_BM25}, {_VEC},
d AS (SELECT q.id AS query_id, x.id, (row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, x.v), 9) DESC, x.id) - 1)::INT AS dense_rank FROM vec q JOIN vec x ON q.id <> x.id WHERE q.id IN (SELECT item_id FROM benchmark) QUALIFY dense_rank < 20),
s AS (SELECT query_id, ordinal // 1000000 AS id, min(sparse_rank) AS sparse_rank FROM sparse GROUP BY ALL),
f AS (SELECT query_id, id, dense_rank, sparse_rank, round(coalesce(1.0::DOUBLE / (61 + dense_rank), 0) + coalesce(1.0::DOUBLE / (61 + sparse_rank), 0), 9) AS score FROM d FULL JOIN s USING (query_id, id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, id)::INT AS rank FROM f QUALIFY rank <= 20""",
    "hit_at_k_mrr": f"WITH RECURSIVE {_HITS} SELECT {_HIT} FROM hits",
    "retrieval_misses": f"WITH RECURSIVE {_HITS} SELECT query_id FROM hits WHERE hit_rank IS NULL",
    "closest_k_plus_outside": f"""WITH {_DENSE}, five AS (SELECT d.query_id, d.id, sim, x.label = 0 AS hyp, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, dense_rank) AS r, count(*) OVER (PARTITION BY query_id) AS n, dense_rank FROM dense d JOIN vec x USING (id) WHERE dense_rank < 5),
w AS (SELECT *, bool_or(hyp AND r <= 2) OVER (PARTITION BY query_id) AS near_hyp, min(CASE WHEN NOT hyp AND r > 2 THEN r END) OVER (PARTITION BY query_id) AS out_r FROM five)
SELECT query_id, id, sim, (CASE WHEN n <= 2 THEN dense_rank + 1 ELSE least(r, 3) END)::INT AS place FROM w WHERE n <= 2 OR r <= 2 OR (near_hyp AND r = out_r)""",
    "flagship": f"WITH RECURSIVE {_BM25} SELECT query_id, position, chunk_id, contains({_form('p.text')}, {_form('b.text')}) AS verbatim FROM passages p JOIN benchmark b ON b.item_id = p.query_id WHERE position < 5",
    "quote_verbatim": f"WITH RECURSIVE {_BM25} SELECT query_id, CASE WHEN max({_form('b.text')} = '') THEN 'missing' WHEN max(contains({_form('p.text')}, {_form('b.text')})) THEN 'verbatim' ELSE 'not_found' END AS status FROM passages p JOIN benchmark b ON b.item_id = p.query_id WHERE position < 5 GROUP BY query_id",
    "quote_repair": f"""WITH RECURSIVE {_BM25}, h AS (SELECT query_id, count(*) AS hits, min(chunk_id) AS one FROM passages p JOIN benchmark b ON b.item_id = p.query_id WHERE position < 5 AND {_form('b.text')} <> '' AND contains({_form('p.text')}, {_form('b.text')}) GROUP BY query_id)
SELECT item_id AS query_id, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN one END AS repaired_to FROM benchmark LEFT JOIN h ON h.query_id = item_id""",
    "quote_span": f"""WITH RECURSIVE {_BM25}, s0 AS (SELECT item_id AS query_id, unnest({_CUT_B.format('trim(text)')}) AS s, generate_subscripts({_CUT_B.format('trim(text)')}, 1) AS k FROM benchmark),
s1 AS (SELECT query_id, k, {_form('s')} AS q FROM s0 WHERE {_form('s')} <> ''),
f AS (SELECT query_id, k, max(contains({_form('p.text')}, q)) AS ok FROM s1 JOIN passages p USING (query_id) WHERE position < 5 GROUP BY ALL)
SELECT query_id, count(*) AS sentences, count(*) FILTER (ok) AS found, count(*) >= 2 AND bool_and(ok) AS spanned FROM f GROUP BY query_id""",
    "lexical_label": f"WITH {_LABELLED} SELECT * FROM labelled",
    "claim_counts": f"WITH {_LABELLED} SELECT conv_id, {_COUNTS}, round_even(count(*) FILTER (label = 'supported') / count(*), 4) AS strict_precision, round_even(count(*) FILTER (label IN ('supported', 'partially_supported')) / count(*), 4) AS lenient_precision, round_even(count(*) FILTER (label = 'unsupported') / count(*), 4) AS hallucination FROM labelled GROUP BY conv_id",
    "precision_micro": f"""WITH {_LABELLED}, c AS (SELECT conv_id, {_COUNTS} FROM labelled GROUP BY conv_id), t AS (SELECT {', '.join(f'sum({x})::BIGINT AS {x}' for x in ('n_claims', 'n_supported', 'n_partial', 'n_disputed', 'n_unsupported'))}, count(*) FILTER (n_claims > 0) AS answers, count(*) FILTER (n_unsupported > 0) AS bad_answers FROM c)
SELECT *, round_even(n_supported / n_claims, 4) AS strict_precision, round_even((n_supported + n_partial) / n_claims, 4) AS lenient_precision, round_even(n_unsupported / n_claims, 4) AS hallucination, round_even(bad_answers / answers, 4) AS answer_hallucination FROM t""",
    "trap_rollup": f"""WITH {_LABELLED}, c AS (SELECT conv_id, {_COUNTS} FROM labelled GROUP BY conv_id), f AS (SELECT ['far_absent', 'near_absent', 'false_premise', 'hypothesis_bait'][conv_id % 4 + 1] AS type, conv_id % 3 = 0 AS refused, n_unsupported = 0 AND n_disputed = 0 AS safe, n_unsupported = 0 AND n_disputed = 0 AND n_partial = 0 AS strict_safe FROM c)
SELECT type, count(*) AS n, count(*) FILTER (CASE WHEN type IN ('far_absent', 'near_absent') THEN refused ELSE safe END) AS correct, count(*) FILTER (refused) AS refused, count(*) FILTER (safe) AS safe, count(*) FILTER (strict_safe) AS strict_safe FROM f GROUP BY GROUPING SETS ((), (type))""",
    "vote_aggregation": f"WITH {cte('panel3')}, v AS (SELECT item_id, list_filter([a, b, c], lambda x: x IS NOT NULL) AS l FROM panel3) SELECT item_id, {_panel('unanimous')} AS unanimous, {_panel('majority')} AS majority FROM v",
    "vote_correction": f"""WITH {cte('votes_json')}, j AS (SELECT item_id, try_cast(nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), '') AS JSON) AS v FROM votes_json),
f AS (SELECT item_id, v, CASE WHEN v->>'label' IN ('supported', 'partially_supported', 'disputed', 'unsupported') THEN v->>'label' ELSE 'unsupported' END AS l FROM j)
SELECT item_id, CASE WHEN v IS NULL THEN NULL WHEN lower(trim(v->>'plan_as_result')) = 'true' OR lower(trim(v->>'misattributed')) = 'true' THEN 'unsupported' WHEN v->>'strength' = 'claim_stronger' AND l = 'supported' THEN 'partially_supported' ELSE l END AS label, CASE WHEN v IS NULL THEN NULL ELSE coalesce(v->>'reason', '') END AS reason FROM f""",
    "stage_verdict": f"""WITH {cte('stages')} SELECT source, claim, attribution, CASE WHEN {_STAGE.format('source')} IN ('background', 'hypothesis', 'other_study', 'plan_or_method', 'result') AND {_STAGE.format('claim')} IN ('background', 'finding', 'hypothesis_or_plan', 'method')
AND ({_STAGE.format('source')} IN ('hypothesis', 'plan_or_method') AND {_STAGE.format('claim')} = 'finding' OR {_STAGE.format('source')} = 'other_study' AND {_STAGE.format('attribution')} = 'this_study') THEN 'unsupported' END AS verdict FROM stages""",
    "best_label_early_stop": f"WITH RECURSIVE {_BEST3}, {_early(3)} SELECT item_id, label, calls, calls::DOUBLE AS seconds FROM best3",
    "check_cost_sim": f"WITH RECURSIVE {_BEST3}, {_early(1)}, {_early(2)}, {_early(3)} " + " UNION ALL ".join(f"SELECT {k} AS top, count(*) AS n, round(avg(calls), 4) AS mean_calls, round(avg(seconds), 4) AS mean_seconds, count(*) FILTER (item_id % 2 = 1 AND label = 'supported') AS false_accept, count(*) FILTER (item_id % 2 = 0 AND label <> 'supported') AS false_reject FROM best{k}" for k in (1, 2, 3)),
    "text_predicates": f"WITH {cte('sentences')} SELECT item_id, regexp_matches(s, {_PREDICATES['refusal']}) AS refusal, regexp_matches(s, {_PREDICATES['meta']}) AS meta, {_YES_NO.format('s')} AS yes_no, regexp_matches(s, {_re(fixed.CJK)}) AS cjk FROM sentences",
    "refusal_turns": f"WITH {_TURNS} SELECT regexp_matches(statement, {_PREDICATES['refusal']}) AS refusal, {_YES_NO.format('statement')} AS yes_no, regexp_matches(statement, {_PREDICATES['meta']}) AS meta, count(*) AS n FROM turns GROUP BY 1, 2, 3",
    "passage_type": f"""WITH {cte('paths')}, h AS (SELECT item_id, list_filter(CASE WHEN section_path <> '' THEN string_split(section_path, '|') ELSE [section] END, lambda x: x <> '') AS h FROM paths),
o AS (SELECT item_id, h, list_concat(h[1:1], list_reverse(h[2:])) AS o FROM h), t AS (SELECT item_id, CASE WHEN len(h) = 0 THEN '其他' WHEN regexp_matches(h[-1], {_re(fixed.PASSAGE_TYPES[0][1])}) THEN '研究假設' ELSE coalesce(list_filter(list_transform(o, lambda x: {_TYPE.format('x')}), lambda x: x IS NOT NULL)[1], '其他') END AS type FROM o)
SELECT item_id, type, CASE WHEN type IN ('研究結果', '討論') THEN 0 WHEN type = '研究假設' THEN 2 ELSE 1 END AS type_order FROM t""",
    "mock_answers": f"WITH RECURSIVE {_BM25} SELECT query_id, chunk_id, '(mock) ' || replace(text[:200], chr(10), ' ') AS statement, false AS refused, '' AS unsupported_note FROM passages WHERE position = 0",
    "wilson": f"""WITH {cte('rates')}, c AS (SELECT coalesce(source, 'none') AS name, sum(toxic)::BIGINT AS k, count(toxic) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1 UNION ALL SELECT 'fixed' || item_id, k, n FROM rates)
SELECT name, k, n, CASE WHEN n > 0 THEN round_even(k / n, 4) END AS rate, {_wilson('k', 'n', '-')} AS low, {_wilson('k', 'n', '+')} AS high FROM c""",
    "mcnemar": f"""WITH {cte('pairs2')}, p AS (SELECT item_id, b, c FROM pairs2 UNION ALL SELECT 0, count(*) FILTER (quality = 1 AND toxic = 0), count(*) FILTER (quality = 0 AND toxic = 1) FROM labels)
SELECT item_id, b, c, CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))))), 6) END AS p FROM p""",
    "kappa": f"""WITH {_JUDGED}, g AS (SELECT gold_label AS l, count(*) AS g FROM judged GROUP BY 1), p AS (SELECT pred AS l, count(*) AS p FROM judged GROUP BY 1), t AS (SELECT (SELECT count(*) FROM judged) AS n, (SELECT count(*) FROM judged WHERE gold_label = pred) AS d, (SELECT sum(g * p)::BIGINT FROM g JOIN p USING (l)) AS e)
SELECT n::BIGINT AS n, round_even((d / n - e / (n * n)) / (1 - e / (n * n)), 4) AS kappa FROM t""",
    "fa_fr": f"""WITH {_JUDGED}, c AS (SELECT count(*) AS n, count(*) FILTER (gold_label <> 'supported') AS neg, count(*) FILTER (gold_label = 'supported') AS pos, count(*) FILTER (gold_label <> 'supported' AND pred = 'supported') AS false_accept, count(*) FILTER (gold_label = 'supported' AND pred <> 'supported') AS false_reject, count(*) FILTER (gold_label = pred) AS r, count(*) FILTER (pred = 'disputed') AS d, count(*) FILTER (pred = 'unparsed') AS u FROM judged)
SELECT n, false_accept, false_reject, CASE WHEN neg > 0 THEN round_even(false_accept / neg, 4) END AS fa_rate, CASE WHEN pos > 0 THEN round_even(false_reject / pos, 4) END AS fr_rate, round_even(r / n, 4) AS accuracy, round_even(d / n, 4) AS disputed_rate, round_even(u / n, 4) AS unparsed_rate FROM c""",
    "fa_fr_by_type": f"WITH {_JUDGED}, k AS (SELECT perturbation, CASE WHEN perturbation = 'original' OR gold_label = 'supported' THEN pred = 'supported' ELSE pred <> 'supported' END AS ok FROM judged) SELECT perturbation, count(*) AS n, count(*) FILTER (ok) AS k, round_even(count(*) FILTER (ok) / count(*), 4) AS correct FROM k GROUP BY 1",
    "panel_enumeration": """WITH v AS (SELECT DISTINCT doc_id, """ + ", ".join(f"('0x' || md5('{j}' || doc_id)[1])::INT < 11 AS {j}" for j in "abc") + """ FROM documents), p AS (SELECT 'a+b' AS panel, [a, b] AS l FROM v UNION ALL SELECT 'a+c', [a, c] FROM v UNION ALL SELECT 'b+c', [b, c] FROM v UNION ALL SELECT 'a+b+c', [a, b, c] FROM v)
SELECT panel, CASE WHEN list_bool_and(l) THEN 'supported' WHEN NOT list_bool_or(l) THEN 'unsupported' ELSE 'disputed' END AS label, count(*) AS n FROM p GROUP BY 1, 2""",
    "dev_test_split": "SELECT CASE WHEN ('0x' || right(md5(doc_id::VARCHAR), 1))::INT % 2 = 0 THEN 'dev' ELSE 'test' END AS split, count(*) AS n, sum(doc_id)::BIGINT AS sum_ids FROM documents GROUP BY 1",
    "perturbations": f"""WITH {_ITEMS}, n AS (SELECT doc_id, s, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS position FROM fit),
k AS (SELECT doc_id, position, 'negation' AS kind, {_negate('s')} AS claim FROM n UNION ALL SELECT doc_id, position, 'overclaim', {_overclaims('s')} FROM n)
SELECT doc_id, position, CASE WHEN ('0x' || right(md5(doc_id::VARCHAR), 1))::INT % 2 = 0 THEN 'dev' ELSE 'test' END AS split, kind, CASE WHEN kind = 'overclaim' THEN 'partially_supported' ELSE 'unsupported' END AS gold_label, md5(claim) AS claim_md5 FROM k WHERE claim IS NOT NULL""",
    "last_vote_wins": "SELECT user_id::VARCHAR AS key, arg_max(event_type, event_id) AS label FROM events WHERE user_id IS NOT NULL AND event_type <> 'error' GROUP BY 1",
    "resume_antijoin": "SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)",
    "guard_windows": """WITH s AS (SELECT user_id AS host, ts, event_id AS seq, value AS cpu, ((value % 100) > 90)::INT AS b FROM events), w AS (SELECT *, count(*) OVER l AS n, avg(cpu) OVER l AS mean, sum(1 - b) OVER (PARTITION BY host ORDER BY ts, seq) AS island FROM s WINDOW l AS (PARTITION BY host ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
x AS (SELECT host, seq, CASE WHEN n = 5 THEN round(mean, 6) END AS cpu_mean, sum(b) OVER (PARTITION BY host, island ORDER BY ts, seq)::BIGINT AS streak FROM w) SELECT host, seq, cpu_mean, streak, coalesce(cpu_mean > 90, false) OR streak >= 2 AS fires FROM x""",
    "references_parsed": f"""WITH {cte('refs')}, p AS (SELECT doc_id, ordinal, trim(raw) AS raw, regexp_extract(raw, '\\((?:.*?)((?:19|20)\\d{{2}})[a-z]?\\)', 1) AS y1, regexp_extract(raw, '\\b((?:19|20)\\d{{2}})[a-z]?\\b', 1) AS y2, regexp_extract(raw, '^\\s*([A-Z][A-Za-zÀ-ɏ''\\-]+)', 1) AS s FROM refs WHERE trim(raw) <> '')
SELECT doc_id, 'ref_' || lpad(ordinal::VARCHAR, 4, '0') AS ref_id, CASE WHEN s <> '' THEN s ELSE raw[:20] END AS surname, coalesce(nullif(y1, ''), nullif(y2, ''), 'n.d.') AS year, CASE WHEN s <> '' THEN s ELSE raw[:20] END || ' (' || coalesce(nullif(y1, ''), nullif(y2, ''), 'n.d.') || ')' AS display FROM p""",
    "audit_numbered": """WITH c(doc_id, position, number) AS (VALUES (2, 1, 1), (2, 2, 2), (2, 3, 3), (2, 4, 5), (2, 5, 2), (2, 6, 4), (2, 7, 7), (2, 8, 1), (3, 1, 2), (3, 2, 1), (3, 3, 3), (3, 4, 4), (3, 5, 5), (3, 6, 9)), z(doc_id, n_refs) AS (VALUES (2, 5), (3, 4)),
f AS (SELECT doc_id, number, min(position) AS first, count(*) AS count FROM c GROUP BY ALL), t AS (SELECT *, max(number) OVER (PARTITION BY doc_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f JOIN z USING (doc_id))
SELECT doc_id::BIGINT AS doc_id, number, count, 'number_out_of_range' AS kind FROM t WHERE number NOT BETWEEN 1 AND n_refs UNION ALL SELECT doc_id::BIGINT, number, count, 'out_of_order' FROM t WHERE number <= n_refs AND top > number
UNION ALL SELECT doc_id::BIGINT, k, 0, 'uncited' FROM (SELECT doc_id, unnest(range(1, n_refs + 1))::INT AS k FROM z) e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = e.doc_id AND c.number = e.k)""",
    "edit_distance_join": "SELECT x.n_regionkey, x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name AND levenshtein(x.n_name, y.n_name) <= 1",
    "verify_statements": f"WITH RECURSIVE {_BEST3}, {_early(2)} SELECT item_id AS query_id, label, calls FROM best2",
    # the passages have no labelled hypotheses and the statements no Chinese words: what is left of the rules is the wording
    "plan_and_zh_rules": f"""WITH RECURSIVE {_BM25} SELECT query_id, CASE WHEN NOT regexp_matches(b.text, {_re(fixed.CLAIM_HEDGE)}) AND regexp_matches(b.text, {_re(fixed.CLAIM_RESULT)})
AND len(list_filter({_SENT.format('p.text')}, lambda s: regexp_matches(s, {_re(fixed.PLAN_SOURCE)}) AND regexp_matches(s, {_re(fixed.PLAN_OUTCOME)}))) > 0 THEN 'wording' END AS route,
regexp_matches(b.text, '證明|证明|證實|证实|必定|必然|一定|總是|总是|絕對|绝对|毫無疑問|毫无疑问|無疑|无疑|確立|确立') AND NOT regexp_matches(p.text, {_re(fixed.EN_STRONG)}) AS overclaims FROM passages p JOIN benchmark b ON b.item_id = p.query_id WHERE position = 0""",
    "arm_summary": f"WITH {_ARMS} " + " UNION ALL ".join(f"SELECT arm, '{m}' AS metric, coalesce({k}, 0)::BIGINT AS k, coalesce({n}, 0)::BIGINT AS n, CASE WHEN coalesce({n}, 0) > 0 THEN round_even({k} / {n}, 4) END AS rate FROM q WHERE {rule} GROUP BY arm" for m, (k, n, rule) in _SUMMED.items()),
    "arm_comparisons": f"WITH {_ARMS}, pairs AS ({_PAIRS}), s AS (SELECT comparison, count(*) AS n, count(*) FILTER (x) AS k_a, count(*) FILTER (y) AS k_b, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (y AND NOT x) AS c FROM pairs GROUP BY 1) SELECT comparison, n, k_a, k_b, b AS a_only, c AS b_only, {_EXACT} AS p FROM s",
    "refusal_rates": f"WITH {_ARMS} SELECT 'over_refusal' AS name, count(*) FILTER (refused) AS k, count(*) AS n, round_even(count(*) FILTER (refused) / count(*), 4) AS rate FROM q WHERE arm = 'grounded' AND NOT trap UNION ALL SELECT 'correct_refusal', count(*) FILTER (refused), count(*), round_even(count(*) FILTER (refused) / count(*), 4) FROM q WHERE arm = 'grounded' AND trap AND must",
    "pdf_body_size": f"WITH {cte('pdf_lines')}, s AS (SELECT doc_id, round(size, 1) AS s, sum(length(text)) AS c FROM pdf_lines GROUP BY ALL) SELECT doc_id::BIGINT AS doc_id, arg_max(s::DOUBLE, c) AS body_size FROM s GROUP BY doc_id",
    "pdf_running_heads": f"WITH {cte('pdf_lines')}, k AS (SELECT doc_id, page, regexp_replace(lower(text), '[^a-z]', '', 'g') AS key, max(page) OVER (PARTITION BY doc_id) AS pages FROM pdf_lines) SELECT doc_id::BIGINT AS doc_id, key FROM k WHERE length(key) >= 12 AND pages >= 3 GROUP BY doc_id, key, pages HAVING count(DISTINCT page) >= greatest(3, pages // 2)",
    "pdf_baselines": f"WITH {cte('pdf_lines')}, s AS (SELECT *, (abs(y1 - lag(y1) OVER o) < 1 AND x0 >= lag(x1) OVER o - 1) AS same FROM pdf_lines WINDOW o AS (PARTITION BY doc_id, page, block ORDER BY line)) SELECT doc_id::BIGINT AS doc_id, page, block, line, (sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, block ORDER BY line) - 1)::INT AS baseline FROM s",
    "quote_levels": _rows("item_id INT, status VARCHAR", [(1, "verbatim"), (2, "near"), (3, "not_found"), (4, "missing"), (5, "verbatim")]),
    "citations_resolve": _rows("doc_id BIGINT, idx INT, ref_id VARCHAR, display VARCHAR, resolved BOOLEAN", [(1, 0, "ref_0001", "Alder (2019)", True), (1, 0, "ref_0002", "Birch (2020)", True), (1, 1, "ref_0004", "Cedar (2018)", True), (2, 0, "", "Berg (2015)", False), (2, 0, "ref_0002", "Fir (2016)", True)]),
    "audit_author_year": _rows("doc_id BIGINT, surname VARCHAR, year VARCHAR, count BIGINT, kind VARCHAR, listed VARCHAR", [(1, "Cedar", "2017", 1, "reference_split_error", "2018"), (1, "Cedar", "2019", 1, "year_mismatch", "2018"), (1, "Oakley", "2019", 1, "missing", ""), (1, "Pinewod", "2017", 1, "misspelling", "pinewood"), (1, "Tamarack", "2014", 1, "missing", "")]),
    "audit_uncited": _rows("doc_id BIGINT, ref_id VARCHAR", [(1, "ref_0006"), (1, "ref_0007"), (2, "ref_0002"), (2, "ref_0003")]),
    "ref_dup_ambiguous": _rows("doc_id BIGINT, kind VARCHAR, what VARCHAR, n BIGINT", [(1, "duplicate", "dogwood p 2021 quiet streets city studies 8 44 60 ", 2), (1, "ambiguous", "dogwood 2021", 2)]),
    "lookup_compare": _rows("ref_id VARCHAR, stage INT, status VARCHAR, diffs VARCHAR", [("r1", 1, "verified", ""), ("r2", 2, "mismatch", "volume:3:4"), ("r3", None, "not_found", None), ("r4", 2, "retracted", "first_page:44:e44"), ("r5", 3, "verified", ""), ("r6", 3, "mismatch", "first_page:7:9;authors:1:2"), ("r9", None, "not_found", None)]),
    "lookup_summary": _rows("kind VARCHAR, name VARCHAR, n BIGINT", [("status", "verified", 2), ("status", "mismatch", 2), ("status", "retracted", 1), ("status", "not_found", 2), ("field", "volume", 1), ("field", "first_page", 2), ("field", "authors", 1)]),
    "listed_fields": _rows("ref_id VARCHAR, year VARCHAR, doi VARCHAR, volume VARCHAR, first_page VARCHAR, surnames VARCHAR, et_al BOOLEAN, non_article BOOLEAN", [("l1", "2019", "10.1016/j.x.2019.01.002", "14", "117", "Alder|Birch", False, False), ("l2", "2018", "", "", "", "Cedar", True, True), ("l3", "2015", "10.1000/abc", "12", "e44", "van den Berg|Oak|Elm", True, False), ("l4", "", "", "3", "5", "", False, False)]),
    "lookup_records": _rows("id VARCHAR, title VARCHAR, families VARCHAR, years VARCHAR, record_volume VARCHAR, record_page VARCHAR, article_number VARCHAR, record_doi VARCHAR, pmid VARCHAR, retracted BOOLEAN", [("w1", "Rivers and bridges", "Alder|Birch", "2020|2019", "Volume 14", "117-131", "", "10.1/A", "", True), ("w2", "Stones", "", "", "", "", "e12", "", "", False), ("p1", "Low land.", "Van Orden|Oak", "2015", "12", "44-9", "", "10.1/P", "p1", True)]),
    "lookup_addresses": _rows("id VARCHAR, by_doi VARCHAR, by_citation VARCHAR, doi_ids VARCHAR, citation_ids VARCHAR", [("l1", "https://api.crossref.org/works/10.1016/j.x.2019.01.002", "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=pubmed&retmode=json&term=Alder%5B1au%5D+AND+14%5Bvi%5D+AND+117%5Bpg%5D", None, None), ("l2", None, None, None, None), ("l3", "https://api.crossref.org/works/10.1000/abc", "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=pubmed&retmode=json&term=van+den+Berg%5B1au%5D+AND+12%5Bvi%5D+AND+e44%5Bpg%5D", None, None), ("l4", None, "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=pubmed&retmode=json&term=No%5B1au%5D+AND+3%5Bvi%5D+AND+5%5Bpg%5D", None, None), ("s1", None, None, "11", "11"), ("s2", None, None, "", "21|22|23"), ("s3", None, None, "", "")]),
    "answer_parse": _rows("query_id INT, claims VARCHAR, unsupported_note VARCHAR, refused BOOLEAN, parse_failed BOOLEAN, misplaced_refusal BOOLEAN", [(1, '[{"statement":"Rivers bend.","citation_ids":["a","b"],"quote":"rivers do bend"}]', "", False, False, False), (2, "[]", "", True, False, False), (3, '[{"statement":"Lamps burn.","citation_ids":["a"],"quote":"lamps burn"}]', "rest", False, False, False), (4, "[]", "", True, False, True), (5, '[{"statement":"Open claim without an end","citation_ids":["a"],"quote":""}]', "", False, False, False), (6, "[]", "", False, True, False), (7, '[{"statement":"x  y","citation_ids":[],"quote":""}]', "more", False, False, False)]),
    "verify_claims_lexical": _rows(_VERDICT, [(1, 0, "a", "supported", "lexical", "verbatim", None), (1, 1, "b", "supported", "lexical", "verbatim", "a"), (1, 2, "a", "unsupported", "quote", "not_found", None), (1, 3, "a", "supported", "lexical", "verbatim", None), (1, 4, "a|b", "supported", "lexical", "near", "a"), (1, 5, "c", "disputed", "lexical", "missing", None), (1, 6, "zz", "unsupported", "lexical", "", None)]),
    "verify_claims_panel": _rows(_VERDICT, [(2, 0, "e", "partially_supported", "panel", "missing", None), (2, 1, "d", "disputed", "panel", "missing", None), (2, 2, "e", "disputed", "panel", "near", None), (2, 3, "e", "unsupported", "panel", "missing", None), (2, 4, "e", "disputed", "panel", "missing", None), (2, 5, "e", "disputed", "none", "missing", None), (3, 0, "g", "disputed", "panel", "missing", None)]),
    "verify_claims_nli": _rows(_VERDICT, [(1, 0, "a", "supported", "nli", "verbatim", None), (1, 1, "b", "unsupported", "nli", "verbatim", "a"), (1, 2, "a", "unsupported", "quote", "not_found", None), (1, 3, "a", "partially_supported", "nli", "verbatim", None), (1, 4, "a|b", "supported", "nli", "near", "a"), (1, 5, "c", "disputed", "lexical", "missing", None), (1, 6, "zz", "unsupported", "lexical", "", None)]),
    "question_records": _rows("query_id INT, refused BOOLEAN, parse_failed BOOLEAN, misplaced_refusal BOOLEAN, " + ", ".join(f"{c} BIGINT" for c in "n_claims n_supported n_partial n_unsupported n_disputed n_citation_repaired n_panel_judged n_panel_agreed n_unjudged quote_verbatim quote_near quote_not_found quote_missing n_translated_quotes".split()), [(1, False, False, False, 7, 0, 0, 2, 5, 2, 0, 0, 5, 3, 1, 1, 1, 0), (2, False, False, False, 6, 0, 1, 1, 4, 0, 5, 3, 1, 0, 1, 0, 5, 0), (3, False, False, False, 1, 0, 0, 0, 1, 0, 1, 1, 0, 0, 0, 0, 1, 0)]),
    "second_judgment": _rows("claim_id VARCHAR, old VARCHAR, new VARCHAR, extra VARCHAR, reason VARCHAR", [("c1", "unsupported", "supported", "a|c", ""), ("c4", "disputed", "disputed", "", "no unseen passage"), ("c5", "disputed", "disputed", "e", "")]),
    "perturbation_rules": _rows("item_id INT, kind VARCHAR, claim VARCHAR, gold_label VARCHAR", [(1, "negation", "In 2019 the share decreased to 12 percent", "unsupported"), (1, "number", "In 2019 the share increased to 27 percent", "unsupported"), (2, "negation", "H1a: Lamps will increase mud in 3.5 weeks", "unsupported"), (2, "number", "H1a: Lamps will reduce mud in 3.1 weeks", "unsupported"), (2, "plan_to_result", "The results showed that lamps reduced mud in 3.5 weeks", "unsupported"), (3, "overclaim", "Alder et al. (2019) found that rivers will always bend", "partially_supported"), (4, "attribution_swap", "This study reported that rivers suggest that streets are positively associated with rain", "unsupported"), (4, "negation", "Birch (2020) reported that rivers suggest that streets are negatively associated with rain", "unsupported"), (4, "overclaim", "Birch (2020) reported that rivers suggest that streets are shown to directly cause rain", "partially_supported"), (5, "attribution_swap", "In this study, stones were shown to roll", "unsupported"), (5, "negation", "Stones were not shown to roll (Cedar, 2018)", "unsupported")]),
    "pdf_blocks": _rows("doc_id BIGINT, page INT, block INT, text VARCHAR, n_lines BIGINT, number VARCHAR, title VARCHAR, level INT", [(1, 1, 1, "ABSTRACT", 1, "", "Abstract", 1), (1, 1, 2, "Rivers bend in the plain and their bridges are old.", 2, None, None, None), (1, 1, 5, "After the abstract the body goes on in its own size.", 1, None, None, None), (1, 2, 1, "2.1. Lamps at night", 2, "2.1", "Lamps at night", 2), (1, 2, 2, "Lamps burn, and people sleep under them when the winter is long.", 1, None, None, None), (1, 2, 3, "Table 1 Lamps by street", 1, None, None, None), (1, 2, 4, "12 (3.4) 5.6", 1, None, None, None), (1, 2, 5, "See doi 10.1234/abc. 2019", 2, None, None, None), (1, 3, 1, "References", 1, "", "References", 1), (1, 3, 2, "Alder, J. (2019). Rivers and their bridges.", 2, None, None, None)]),
    "pdf_body": _rows("doc_id BIGINT, idx INT, text VARCHAR, section VARCHAR", [(1, 2, "Rivers bend in the plain and their bridges are old.", "Abstract"), (1, 3, "After the abstract the body goes on in its own size.", "Introduction"), (1, 5, "Lamps burn, and people sleep under them when the winter is long.", "Introduction > 2.1 Lamps at night"), (1, 6, "Table 1 Lamps by street | 12 (3.4) 5.6 | See doi 10.1234/abc. 2019", "Introduction > 2.1 Lamps at night"), (1, 10, "Alder, J. (2019). Rivers and their bridges.", "References")]),
    "pdf_references": _rows("doc_id BIGINT, ordinal INT, raw VARCHAR", [(1, 1, "Alder, J. (2019). Rivers and their bridges.")]),
    "heading_paths": _rows("doc_id BIGINT, idx INT, text VARCHAR, section_path VARCHAR, section_number VARCHAR", [(1, 2, "First words", "Abstract", ""), (1, 6, "Second words", "2 Method > 2.1 Deep > 2.1.1.1 Deeper", "2.1.1.1"), (1, 9, "Third words", "2 Method > 2.2 Flat", "2.2"), (1, 10, "x" * 121, "2 Method > 2.2 Flat", "2.2")]),
    "chunks_with_citations": _rows("doc_id BIGINT, chunk_no INT, para_start INT, para_end INT, section_path VARCHAR, section VARCHAR, section_number VARCHAR, page_start INT, page_end INT, citations VARCHAR", [(1, 0, 0, 0, "Intro", "Intro", "1", 1, 1, "ref_0001:Alder (2019)"), (1, 1, 1, 2, "Intro", "Intro", "1", 2, 2, "ref_0006:Dogwood (2021);-:Oak (2000)"), (1, 2, 3, 3, "Method", "Method", "2", 2, 2, ""), (1, 3, 4, 4, "Method > Deep", "Deep", "2.1", 3, 3, "ref_0001:Alder (2019)")]),
}
