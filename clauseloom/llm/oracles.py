"""DuckDB SQL for the queries that SQL can express, on tables with unique document ids."""

from __future__ import annotations

from clauseloom.llm import decontam, licenses, line_templates, quality
from clauseloom.llm.common import LOWER, UPPER

BLANK_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def alnum(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}')"


def quality_sql() -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{BLANK_WORD}') AS w FROM d),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l WHERE regexp_matches(l, '{BLANK_WORD}') GROUP BY doc_id),
h AS (SELECT DISTINCT doc_id, source, t, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS k FROM l),
f AS (SELECT source, k, min(doc_id) AS first FROM h WHERE k <> '' GROUP BY source, k HAVING count(DISTINCT t) > {quality.MAX_DOCS}),
gone AS (SELECT h.doc_id, sum(length(h.k)) AS n FROM h JOIN f ON h.k = f.k AND h.source IS NOT DISTINCT FROM f.source WHERE h.doc_id <> f.first GROUP BY h.doc_id),
tot AS (SELECT doc_id, sum(length(k)) AS n FROM h GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(tot.n, 0) AS BIGINT) AS line_chars, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_chars
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN tot USING (doc_id) LEFT JOIN gone USING (doc_id)),
x AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT removed_chars > {quality.MAX_REMOVED}::DOUBLE * line_chars AS kept, line_chars, removed_chars FROM x"""


def line_templates_sql() -> str:
    most, least, long = line_templates.MAX_DOCS, line_templates.MIN_CONSTANT, line_templates.LONG
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, unnest(range(len(s))) AS pos, unnest(s) AS raw FROM (SELECT doc_id, t, string_split(t, chr(10)) AS s FROM d)),
e AS (SELECT doc_id, t, pos, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS v FROM l),
m AS (SELECT doc_id, t, pos, v, list_transform(string_split(v, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tk FROM e WHERE v <> ''),
k AS (SELECT doc_id, t, pos, v, tk, len(tk) AS n, array_to_string(tk, ' ') AS line FROM m),
u AS (SELECT DISTINCT t, line, n, tk FROM k),
c AS (SELECT t, line, n, 0 AS r, array_to_string(tk[1:2], ' ') AS leaf FROM u UNION ALL SELECT t, line, n, 1, tk[2] || ' ' || tk[3] FROM u WHERE n >= {line_templates.MIN_WILD} UNION ALL SELECT t, line, n, 2, tk[1] || ' ' || tk[3] FROM u WHERE n >= {line_templates.MIN_WILD}),
reached AS (SELECT n, r, leaf FROM c GROUP BY ALL HAVING count(DISTINCT t) > {most}),
chosen AS (SELECT line, n, arg_min(leaf, r) AS leaf, min(r) AS r FROM (SELECT DISTINCT line, n, r, leaf FROM c) JOIN reached USING (n, r, leaf) GROUP BY line, n),
kinds AS (SELECT line, n, r, leaf, any_value(tk) AS tk, count(DISTINCT t) AS docs FROM u JOIN chosen USING (line, n) GROUP BY ALL),
tok AS (SELECT line, n, r, leaf, docs, unnest(range(n)) AS spot, unnest(tk) AS token FROM kinds),
stays AS (SELECT n, r, leaf, spot, token FROM tok WHERE token <> '<*>' GROUP BY ALL HAVING sum(docs) > {most}),
general AS (SELECT line, n || ' ' || string_agg(coalesce(s.token, '<*>'), ' ' ORDER BY spot) AS template FROM tok LEFT JOIN stays s USING (n, r, leaf, spot, token) GROUP BY line, n HAVING count(s.token) >= {least} * n),
o AS (SELECT doc_id, t, pos, template FROM k JOIN general USING (line)),
often AS (SELECT template, min(doc_id) AS first FROM o GROUP BY template HAVING count(DISTINCT t) > {most}),
words AS (SELECT v, min(doc_id) AS first FROM k GROUP BY v, n HAVING count(DISTINCT t) > CASE WHEN n >= {long} THEN 1 ELSE {most} END),
gone AS (SELECT doc_id, pos FROM o JOIN often USING (template) WHERE doc_id <> first UNION SELECT doc_id, pos FROM k JOIN words USING (v) WHERE doc_id <> first),
left_ AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS s FROM l WHERE (doc_id, pos) NOT IN (SELECT (doc_id, pos) FROM gone) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_dropped, CAST(length(coalesce(s, '')) AS BIGINT) AS n_chars, md5(coalesce(s, '')) AS text_md5 FROM d LEFT JOIN left_ USING (doc_id) LEFT JOIN n USING (doc_id)"""


def decontamination_sql() -> str:
    n = decontam.WINDOW
    return f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {alnum('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, list_slice(w, i, i + {n - 1}) AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM bw),
d AS (SELECT doc_id, {alnum('text')} AS w FROM documents),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {decontam.MIN_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


def licenses_sql() -> str:
    rows, labels = [], []
    for t, (label, notice, key) in enumerate(licenses.TEMPLATES):
        lead, size = licenses.key_place(notice, key), len(key.split())
        labels.append(f"({t}, '{label}', {size})")
        rows += [f"({t}, {j}, '{x}', {str(lead <= j < lead + size).lower()})" for j, x in enumerate(notice.split())]
    base = [f"('{label}', {j}, '{x}', {len(p.split())})" for p, label in licenses.BASE.items() for j, x in enumerate(p.split())]
    return f"""
WITH w AS (SELECT doc_id, {alnum('text')} AS w FROM documents),
p0(t, pos, word, iskey) AS (VALUES {', '.join(rows)}),
l(t, label, size) AS (VALUES {', '.join(labels)}),
b(label, pos, word, n) AS (VALUES {', '.join(base)}),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
v0 AS (SELECT DISTINCT word FROM p0),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM o JOIN v0 USING (word) GROUP BY word),
idf AS (SELECT word, round(1 + ln(((SELECT count(*) FROM w) + 1)::DOUBLE / (coalesce(n, 0) + 1)), 9) AS idf FROM v0 LEFT JOIN df USING (word)),
p AS (SELECT t, pos, word, iskey, idf, idf / sum(idf) OVER (PARTITION BY t) AS weight FROM p0 JOIN idf USING (word)),
a AS (SELECT t, word, pos, row_number() OVER (PARTITION BY t ORDER BY idf DESC, word) AS r FROM (SELECT t, word, min(pos) AS pos, any_value(idf) AS idf FROM p WHERE iskey GROUP BY t, word)),
c AS (SELECT doc_id, t, i - pos AS s FROM o JOIN a ON o.word = a.word AND r = 1 INTERSECT SELECT doc_id, t, i - pos FROM o JOIN a ON o.word = a.word AND r = 2),
k AS (SELECT c.doc_id, c.t, c.s FROM c JOIN p ON c.t = p.t AND p.iskey JOIN o ON o.doc_id = c.doc_id AND o.i = c.s + p.pos AND o.word = p.word JOIN l ON l.t = c.t GROUP BY c.doc_id, c.t, c.s, l.size HAVING count(*) = l.size),
h AS (SELECT DISTINCT k.doc_id, k.t, k.s, p.pos, p.weight FROM k JOIN p ON k.t = p.t JOIN o ON o.doc_id = k.doc_id AND o.word = p.word AND o.i BETWEEN k.s + p.pos - {licenses.SLACK} AND k.s + p.pos + {licenses.SLACK}),
m AS (SELECT doc_id, label, least(1.0, score) AS score FROM (SELECT doc_id, t, s, round(sum(weight), 6) AS score FROM h GROUP BY doc_id, t, s) JOIN l USING (t) WHERE score >= {licenses.MIN_SCORE}),
bs AS (SELECT doc_id, i - pos AS s, label FROM o JOIN b ON o.word = b.word GROUP BY doc_id, s, label, n HAVING count(*) = n),
ba AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bs GROUP BY doc_id),
la AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bs UNION ALL SELECT doc_id, label FROM m) GROUP BY doc_id),
sc AS (SELECT doc_id, max(score) AS score FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN ba USING (doc_id) LEFT JOIN la USING (doc_id) LEFT JOIN sc USING (doc_id)"""
