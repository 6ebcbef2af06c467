"""DuckDB SQL that says what the registered queries say, where SQL can."""

from satchel.llm.topk import TOP_K_SQL

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

SUBSTRING_DEDUP_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_WORDS}), []) AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM w),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
x AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d)),
k AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM x LEFT JOIN (SELECT doc_id, unnest(gone) AS p FROM g) y ON x.doc_id = y.doc_id AND x.i = y.p WHERE y.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

_SHINGLES = """SELECT DISTINCT {id}, array_to_string(ws[s:s + {k} - 1], ' ') AS sh
FROM (SELECT {id}, ws, unnest(range(1, greatest(len(ws) - {k} + 1, 1) + 1)) AS s FROM {words} WHERE len(ws) > 0)"""

JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_WORDS}), []) AS ws FROM documents),
s AS ({_SHINGLES.format(id="doc_id", k=3, words="d")}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT b.a, b.b FROM b JOIN n p ON p.doc_id = b.a JOIN n q ON q.doc_id = b.b WHERE 100 * n_both >= 90 * (p.n + q.n - n_both)),
t AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM t GROUP BY a) c ON c.a = d.doc_id
"""

_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS ws FROM benchmark WHERE text IS NOT NULL),
x AS ({_SHINGLES.format(id="item_id", k=5, words="i")}),
n AS (SELECT item_id, count(*) AS n_item FROM x GROUP BY item_id),
y AS ({_SHINGLES.format(id="doc_id", k=5, words="(SELECT * FROM d WHERE len(ws) >= 5)")}),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM x JOIN y ON x.sh = y.sh GROUP BY doc_id, item_id)
SELECT doc_id, m.item_id, n_item, n_shared, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM m JOIN n ON n.item_id = m.item_id WHERE 100 * n_shared >= 80 * n_item
"""

ORACLE_SQL = {
    "op1_substring_dedup": SUBSTRING_DEDUP_SQL,
    "op2_decontamination": CONTAMINATION_SQL,
    "op3_jaccard_join": JACCARD_SQL,
    "op5_exact_top_k": TOP_K_SQL,
}
