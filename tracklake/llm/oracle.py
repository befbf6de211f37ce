"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from tracklake.llm import quality_rules as Q

_WORDS = r"[^\x20\x09-\x0D]+"


def _rates() -> str:
    return ", ".join(f"least({Q.BINS}, ({scale} * {top}) // greatest({bottom}, 1)) AS r_{k}" for k, (top, bottom, scale, _, _) in Q.RATES.items())


def quality_rules_sql() -> str:
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, r_{k} AS bin FROM rated WHERE NOT base_failed" for k in Q.RATES)
    spread = "CASE rate " + " ".join(f"WHEN '{k}' THEN {v[3]}" for k, v in Q.RATES.items()) + " END"

    tests = " AND ".join(f"2 * r_{k} <= high_{k}" + (f" AND 2 * r_{k} >= low_{k}" if v[4] else "") for k, v in Q.RATES.items())
    at = lambda p: f"min(CASE WHEN 1000 * upto >= {p} * total THEN bin END)"
    mean = ", ".join(f"(f1.n * f1.{c}_{k} + {Q.SHRINK} * ((f2.n * f2.{c}_{k} + {Q.SHRINK} * f3.{c}_{k}) // (f2.n + {Q.SHRINK}))) // (f1.n + {Q.SHRINK}) AS {c}_{k}" for k in Q.RATES for c in ("low", "high"))
    wide = ", ".join(f"max(CASE WHEN rate = '{k}' THEN {c} END) AS {c}_{k}" for k in Q.RATES for c in ("low", "high"))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '{_WORDS}')) AS word, generate_subscripts(regexp_extract_all(text, '{_WORDS}'), 1) AS i FROM d),
win AS (SELECT rid, i, word, CASE WHEN count(*) OVER f = {Q.WINDOW} THEN string_agg(word, ' ') OVER f END AS key FROM w
        WINDOW f AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {Q.WINDOW - 1} FOLLOWING)),
twice AS (SELECT rid, i, CASE WHEN key IS NOT NULL AND count(*) OVER (PARTITION BY rid, key) > 1 THEN 1 ELSE 0 END AS t FROM win),
hit AS (SELECT rid, max(t) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {Q.WINDOW - 1} PRECEDING AND CURRENT ROW) AS h FROM twice),
st AS (SELECT rid, count(*) AS n FROM (SELECT rid, word, lag(word) OVER (PARTITION BY rid ORDER BY i) AS before FROM w) WHERE word = before GROUP BY rid),
rep AS (SELECT rid, CAST(sum(h) AS BIGINT) AS n FROM hit GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '{_WORDS}') GROUP BY rid),
c AS (SELECT d.doc_id, d.lang, d.source, len(regexp_extract_all(text, '{_WORDS}')) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
        coalesce(lines.dup, 0) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(st.n, 0) AS n_stutter
      FROM d LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN st USING (rid)),
rated AS (SELECT *, {_rates()}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
long AS ({long}),
levels AS (SELECT 1 AS level, lang, source, rate, bin FROM long UNION ALL SELECT 2, lang, NULL, rate, bin FROM long UNION ALL SELECT 3, NULL, NULL, rate, bin FROM long),
sk AS (SELECT level, lang, source, rate, bin, count(*) AS n FROM levels GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM sk),
q AS (SELECT level, lang, source, rate, max(total) AS n, {at(250)} AS q1, {at(750)} AS q3, {spread} AS spread FROM cum GROUP BY ALL),
edge AS (SELECT *, q1 - {Q.REACH} * greatest(q3 - q1, spread) AS least, q3 + {Q.REACH} * greatest(q3 - q1, spread) AS most FROM q),
part AS (SELECT e.*, sk.bin, sk.n AS k FROM sk JOIN edge e ON e.level = sk.level AND e.rate = sk.rate AND e.lang IS NOT DISTINCT FROM sk.lang AND e.source IS NOT DISTINCT FROM sk.source WHERE sk.bin BETWEEN e.least AND e.most),
cum2 AS (SELECT *, sum(k) OVER (PARTITION BY level, lang, source, rate ORDER BY bin) AS upto, sum(k) OVER (PARTITION BY level, lang, source, rate) AS total FROM part),
tails AS (SELECT level, lang, source, rate, n, least, most, spread, {at(500)} AS mid, {at(Q.TAIL)} AS top, {at(1000 - Q.TAIL)} AS bottom FROM cum2 GROUP BY ALL),
f AS (SELECT level, lang, source, rate, n, CAST(greatest(0, 2 * least, 2 * mid - {Q.HALVES} * (mid - bottom) - spread) AS BIGINT) AS low, CAST(least(2 * most, 2 * mid + {Q.HALVES} * (top - mid) + spread) AS BIGINT) AS high FROM tails),
wide AS (SELECT level, lang, source, CAST(max(n) AS BIGINT) AS n, {wide} FROM f GROUP BY ALL),
fence AS (SELECT f1.lang, f1.source, {mean} FROM wide f1 JOIN wide f2 ON f2.level = 2 AND f2.lang IS NOT DISTINCT FROM f1.lang JOIN wide f3 ON f3.level = 3 WHERE f1.level = 1)
SELECT r.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce({tests}, true) AS kept
FROM rated r
LEFT JOIN fence f ON f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source
"""


DECONTAMINATE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS key FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM bi)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS key FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
hits AS (SELECT rid, k, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.key = bw.key),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rid, k, n FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

NGRAM_JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + least(4, len(w)) - 1), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.doc_id AND reach.r < e.b),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""

ORACLE_SQL = {"op10_ngram_jaccard": NGRAM_JACCARD, "op3_quality_rules": quality_rules_sql(), "op4_decontaminate": DECONTAMINATE}
