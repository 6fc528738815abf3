"""DuckDB SQL with the results of the training-data queries, where SQL can express them."""

from __future__ import annotations

from citeforge.llm import licenses, quality, sharding

_W = r"[^\x20\x09-\x0D]+"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_COUNT = "length(regexp_replace(text, '[^{0}]', '', 'g'))"
#: In the order of quality.CLASSES.
_CHARS = [_COUNT.format(c) for c in ("a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r""".,;:!?'"()\-""".replace("'", "''"))]
_CHARS += [r"""length(regexp_replace(text, '[a-zA-Z0-9\x20\x09-\x0D.,;:!?''"()\-]|[^\x00-\x7F]', '', 'g'))"""]
_CHARS += [_COUNT.format(c) for c in (r"\x{80}-\x{BF}", r"\x{C0}-\x{FF}", r"\x{100}-\x{27F}", r"\x{280}-\x{7FF}", r"\x{800}-\x{1FFF}", r"\x{2000}-\x{2FFF}", r"\x{3000}-\x{FFFF}", r"\x{10000}-\x{10FFFF}")]


def _js(doc: str, lang: str, bins: str) -> str:
    """doc(doc_id, bin, n) against lang(lang, bin, n): the distance d of each document and language."""
    return f"""(
    SELECT doc_id, lang, sqrt(greatest(0, least(1, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS d FROM (
        SELECT t.doc_id, l.lang, b.bin, coalesce(d.n, 0)::DOUBLE / t.total AS p, coalesce(r.n, 0)::DOUBLE / l.total AS q
        FROM (SELECT doc_id, sum(n) AS total FROM {doc} GROUP BY doc_id) t CROSS JOIN (SELECT lang, sum(n) AS total FROM {lang} GROUP BY lang) l CROSS JOIN {bins} b
        LEFT JOIN {doc} d ON d.doc_id = t.doc_id AND d.bin = b.bin LEFT JOIN {lang} r ON r.lang = l.lang AND r.bin = b.bin) GROUP BY doc_id, lang)"""


_QUALITY = f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, text IS NULL AS gone FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_W}')) AS w, generate_subscripts(regexp_extract_all(text, '{_W}'), 1) AS i FROM d),
tri AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM tri WHERE w3 IS NOT NULL) WHERE n > 1),
inside AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM often CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_W}') GROUP BY doc_id),
base AS (SELECT doc_id, len(regexp_extract_all(text, '{_W}')) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)),
char_doc AS (SELECT doc_id, lang, gone, unnest([{', '.join(_CHARS)}]) AS n, unnest(range({len(_CHARS)})) AS bin FROM d),
char_lang AS (SELECT lang, bin, sum(n) AS n FROM char_doc WHERE lang IS NOT NULL AND NOT gone GROUP BY ALL),
char_bins AS (SELECT unnest(range({len(_CHARS)})) AS bin),
common AS (SELECT unnest([{_quoted(quality.COMMON)}]) AS w, unnest(range({len(quality.COMMON)})) AS bin),
word_doc AS (SELECT doc_id, lang, coalesce(bin, {len(quality.COMMON)}) AS bin, count(*) AS n FROM words JOIN d USING (doc_id) LEFT JOIN common ON common.w = {_ASCII_LOWER.format('words.w')} GROUP BY ALL),
word_lang AS (SELECT lang, bin, sum(n) AS n FROM word_doc WHERE lang IS NOT NULL GROUP BY ALL),
word_bins AS (SELECT unnest(range({len(quality.COMMON) + 1})) AS bin),
char_sum AS (SELECT doc_id, bin, n FROM char_doc WHERE doc_id IN (SELECT doc_id FROM base WHERE n_words > 0)), word_sum AS (SELECT doc_id, bin, n FROM word_doc),
lang AS (SELECT lang, o AS others, sqrt((log2(2 / (1 + o)) + CASE WHEN o > 0 THEN o * log2(2 * o / (1 + o)) ELSE 0 END + (1 - o)) / 2) AS no_word
    FROM (SELECT lang, coalesce(sum(n) FILTER (bin = {len(quality.COMMON)}), 0)::DOUBLE / sum(n) AS o FROM word_lang GROUP BY lang)),
own AS (SELECT doc_id, coalesce(sum(n) FILTER (bin = {len(quality.COMMON)}), 0)::DOUBLE / sum(n) AS others FROM word_sum GROUP BY doc_id),
cd AS {_js('char_sum', 'char_lang', 'char_bins')}, wd AS {_js('word_sum', 'word_lang', 'word_bins')},
near AS (SELECT cd.doc_id, cd.d AS dc, wd.d AS dw, no_word, lang.others AS usual, own.others FROM cd JOIN wd ON cd.doc_id = wd.doc_id AND cd.lang = wd.lang JOIN lang ON lang.lang = cd.lang JOIN own ON own.doc_id = cd.doc_id
    QUALIFY row_number() OVER (PARTITION BY cd.doc_id ORDER BY cd.d + wd.d, cd.lang) = 1),
flag AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(word_chars >= {quality.MIN_CHARS} AND dc > {quality.MAX_CHAR_DISTANCE}, false)
    AND NOT coalesce(n_words >= {quality.MIN_JS_WORDS} AND no_word >= {quality.MIN_NO_WORD} AND dw > {quality.NO_WORD_SHARE} * no_word AND others > usual, false) AS kept
FROM flag LEFT JOIN near USING (doc_id)"""

_CRC = "list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_SHARD = f"""WITH bytes AS (SELECT doc_id, source, text, md5('{sharding.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS digest, strlen(coalesce(text, '')) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
crc AS (SELECT {_CRC} AS t),
r AS (SELECT doc_id, coalesce('=' || source, '') AS stratum, digest, size, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32, ('0x' || digest[:8])::BIGINT % {sharding.BUCKETS} AS bucket FROM bytes, crc),
k AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY bucket, digest, doc_id NULLS FIRST, text_crc32, size) - 1) / (2 * count(*) OVER (PARTITION BY stratum)) AS place FROM r),
g AS (SELECT *, row_number() OVER (ORDER BY place, stratum, digest, doc_id NULLS FIRST, text_crc32, size) - 1 AS g, count(*) OVER () AS n FROM k)
SELECT doc_id, size, text_crc32, 'rows' AS law, (g * {sharding.SHARDS} // n)::INT AS shard, g - ((g * {sharding.SHARDS} // n) * n + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS slot, NULL::INT AS grown_shard FROM g"""

_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_W}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT met.a, met.b FROM met JOIN n x ON x.doc_id = met.a JOIN n y ON y.doc_id = met.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM way UNION SELECT r.a, w.b FROM reach r JOIN way w ON w.a = r.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id, least(n.doc_id, coalesce(min(r.b), n.doc_id)) = n.doc_id AS kept FROM n LEFT JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""


def _license_sql() -> str:
    known = licenses.prepared()
    wanted = ", ".join(f"('{t['template']}', '{t['license']}', '{s}', {len(t['shingles'])}, {t['need']}, {t['window']}, {t['stride']}, {t['width']})" for t in known for s in t["shingles"])
    widths = sorted({t["width"] for t in known})
    shingles = " UNION ALL ".join(f"SELECT doc_id, {n} AS width, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS shingle, unnest(range(len(w) - {n - 1})) AS p FROM w WHERE len(w) >= {n}" for n in widths)
    return f"""WITH t(template, license, shingle, n, need, wide, stride, width) AS (VALUES {wanted}),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
s AS ({shingles}),
h AS (SELECT doc_id, template, license, n, need, wide, stride, t.width, s.shingle, p FROM s JOIN t ON s.shingle = t.shingle AND s.width = t.width),
x AS (SELECT doc_id, template, license, n, need, s.start, count(DISTINCT shingle) AS hits FROM (SELECT *, unnest(range(greatest(0, (p + width - wide + stride - 1) // stride) * stride, p + 1, stride)) AS start FROM h) s GROUP BY doc_id, template, license, n, need, s.start)
SELECT doc_id, template, license, max(hits)::BIGINT AS hits, n::BIGINT AS n_shingles, min(start)::BIGINT AS first_word FROM x WHERE hits >= need GROUP BY doc_id, template, license, n"""


ORACLE_SQL: dict[str, str] = {"op2_quality_rules": _QUALITY, "op6_sharding": _SHARD, "op9_minhash": _NEAR, "op10_license_scan": _license_sql()}
