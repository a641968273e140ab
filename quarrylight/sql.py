"""SQL for DuckDB of the core queries, written apart from their operators."""

from __future__ import annotations

P1_FOUND = """
SELECT 'qrels' AS tbl, 'document_id' AS field, line_no FROM qrels q WHERE document_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM documents d WHERE d.id = q.document_id AND (q.judged_at IS NULL
    OR (d.ingested_at <= q.judged_at AND (d.deleted_at IS NULL OR d.deleted_at > q.judged_at))))
UNION ALL
SELECT 'qrels', 'IN', line_no FROM qrels q WHERE "IN" IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM queries d WHERE d."IN" = q."IN" AND (q.judged_at IS NULL OR d.received_at <= q.judged_at))
UNION ALL
SELECT 'queries', 'IN', line_no FROM queries q WHERE "IN" IS NOT NULL AND NOT EXISTS (SELECT 1 FROM qrels d WHERE d."IN" = q."IN")
"""

_Q = 'q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 20 = 0)'
_V = 'v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)'


def _dense(score: str, where: str = "true", k: int | None = 10, by_id: str = "id::VARCHAR DESC") -> str:
    rank = f"row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {by_id})"
    keep = f"WHERE rank <= {k}" if k else ""
    return f"""WITH {_Q}, {_V}, s AS (SELECT query_id, id, round({score}, 6) + 0 AS score FROM q, v WHERE {where})
    SELECT query_id, rank, id, score FROM (SELECT *, {rank}::INT AS rank FROM s) {keep}"""


_COS = "list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)))"

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_BM25 = f"""
WITH d AS (SELECT doc_id AS id, {_WORDS.format("content")} AS w FROM documents WHERE content IS NOT NULL),
dd AS (SELECT * FROM d WHERE len(w) > 0), st AS (SELECT count(*) AS n, avg(len(w)) AS m FROM dd),
t AS (SELECT id, len(w) AS l, unnest(w) AS term FROM dd), tf AS (SELECT id, any_value(l) AS l, term, count(*) AS f FROM t GROUP BY id, term),
df AS (SELECT term, count(*) AS c FROM tf GROUP BY term),
qt AS (SELECT line_no AS query_id, unnest(list_distinct({_WORDS.format("content")})) AS term FROM queries WHERE line_no % 20 = 0 AND content IS NOT NULL),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - c + 0.5) / (c + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), st {{where}} GROUP BY query_id, id)
SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR DESC)::INT AS rank FROM s) WHERE rank <= 10"""

_SP = """x AS (SELECT vec_id, label, unnest(embedding) AS w, unnest(range(len(embedding))) AS dim FROM embeddings),
p AS (SELECT vec_id AS ordinal, label, dim::INT AS dim, w::DOUBLE AS weight FROM x WHERE w > 0)"""


def _sparse(k: int, least: float = 0.0, extra: str = "") -> str:
    return f"""WITH {_SP}, s AS (SELECT a.ordinal AS query_id, b.ordinal, round(sum(a.weight * b.weight), 6) AS score
      FROM p a JOIN p b ON a.dim = b.dim {extra} WHERE a.ordinal % 20 = 0 GROUP BY 1, 2)
    SELECT query_id, rank, ordinal, ordinal::VARCHAR AS id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal)::INT AS rank FROM s WHERE score > {least}) WHERE rank <= {k}"""


_W = "(VALUES ('dense-baseline', 1.0::DOUBLE), ('dense-repeated', 0.5), ('sparse-ccsa', 2.0)) w(run_id, weight)"


def _fuse(amount: str, weights: str = _W, missing: float = 0.0) -> str:
    return f"""WITH r AS (SELECT query_id, run_id, rank, id, weight, coalesce(score, {missing}::DOUBLE) AS s FROM predictions JOIN {weights} USING (run_id)),
    n AS (SELECT *, min(s) OVER l AS lo, max(s) OVER l AS hi, avg(s) OVER l AS mean, stddev_pop(s) OVER l AS dev FROM r WINDOW l AS (PARTITION BY query_id, run_id))
    SELECT query_id, id, round(sum(weight * ({amount})), 8) AS score FROM n GROUP BY query_id, id"""


_MINMAX = "CASE WHEN lo = hi THEN 1.0 ELSE (s - lo) / (hi - lo) END"
_RS = "CASE WHEN score IS NULL OR isnan(score) OR isinf(score) THEN -rank::DOUBLE ELSE score - rank * 1e-12 END"

_LABELS = 'l AS (SELECT "IN" AS need, document_id, max(label) AS label FROM qrels WHERE "IN" IS NOT NULL AND document_id IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)'
_NEEDS = 'needs AS (SELECT id AS query_id, min("IN") AS need FROM queries GROUP BY id)'
_PERQ = f"""
{_LABELS}, {_NEEDS},
c AS (SELECT run_id, query_id, document_id, max({_RS}) AS s, min(rank) AS r FROM predictions WHERE document_id IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY s DESC, r, document_id) AS place FROM c),
a AS (SELECT DISTINCT run_id, query_id, need FROM predictions JOIN needs USING (query_id) WHERE need IN (SELECT need FROM l WHERE label > 0)),
h AS (SELECT g.run_id, g.query_id, place, label, row_number() OVER (PARTITION BY g.run_id, g.query_id ORDER BY place) AS nth
  FROM g JOIN needs USING (query_id) JOIN l ON l.need = needs.need AND l.document_id = g.document_id WHERE label > 0 AND place <= 10),
i AS (SELECT need, label, row_number() OVER (PARTITION BY need ORDER BY label DESC) AS pos FROM l WHERE label > 0),
pos AS (SELECT need, count(*) AS n FROM i GROUP BY need), ks AS (SELECT unnest([1, 5, 10]) AS k),
ideal AS (SELECT need, k, sum(label / log2(pos + 1)) AS v FROM i, ks WHERE pos <= k GROUP BY 1, 2),
o AS (SELECT a.run_id, a.query_id, k, any_value(pos.n) AS n, any_value(ideal.v) AS ideal, count(place) AS hits, min(place) AS first_,
    sum(label / log2(place + 1)) AS gain, sum(nth / place) AS prec
  FROM a JOIN pos USING (need) CROSS JOIN ks JOIN ideal USING (need, k) LEFT JOIN h ON h.run_id = a.run_id AND h.query_id = a.query_id AND place <= k GROUP BY 1, 2, 3),
m AS (SELECT run_id, query_id, unnest([
    {{'metric': 'Recall@' || k, 'value': hits / n}}, {{'metric': 'Precision@' || k, 'value': hits / k}},
    {{'metric': 'HitRate@' || k, 'value': CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END}}, {{'metric': 'MRR@' || k, 'value': coalesce(1 / first_, 0)}},
    {{'metric': 'NDCG@' || k, 'value': coalesce(gain / ideal, 0)}}, {{'metric': 'MAP@' || k, 'value': coalesce(prec / hits, 0)}}], recursive := true) FROM o)"""


def _metrics(only: str = "true") -> str:
    return f"""WITH {_PERQ}, runs AS (SELECT DISTINCT run_id FROM predictions), names AS (SELECT DISTINCT metric FROM m)
    SELECT run_id, metric, round(coalesce(avg(value), 0), 6) AS value FROM runs CROSS JOIN names LEFT JOIN m USING (run_id, metric) WHERE {only} GROUP BY 1, 2"""


_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _collapse(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_WHITE}+', ' ', 'g'), '^ +| +$', '', 'g')"


_ACCEPT = r"""content IS NOT NULL AND len(regexp_extract_all(content, '[\p{L}\p{N}_]+')) BETWEEN 20 AND 400
  AND regexp_matches(content, '(?i)(dense|sparse|metric)') AND NOT regexp_matches(content, '(?i)shard')"""

_INNER = r"regexp_replace(regexp_replace({0}, '^\s*\{{\s*', ''), '\s*\}}\s*$', '')"


def _hash(seed: str, x: str) -> str:
    return f"md5('{seed}|' || {x})"


_POOLS = """
docs AS (SELECT id AS document_id, min(doc_id) AS pos FROM documents GROUP BY id),
n AS (SELECT "IN" AS need, min(line_no) AS pos FROM queries WHERE "IN" IS NOT NULL GROUP BY 1),
prs AS (SELECT "IN" AS need, document_id, max(label) > 0 AS positive FROM qrels WHERE "IN" IS NOT NULL AND document_id IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2),
ann AS (SELECT need, document_id, pos FROM prs JOIN docs USING (document_id) WHERE need IN (SELECT need FROM n)),
pool_random AS (SELECT document_id FROM docs),
pool_easy AS (SELECT document_id FROM docs WHERE document_id NOT IN (SELECT document_id FROM prs)),
pool_gold AS (SELECT document_id FROM docs WHERE document_id IN (SELECT document_id FROM prs WHERE positive))"""


def _ring(name: str, pool: str, barred: str, count: int, seed: str) -> str:
    """A draw: ring of the pool, start of each need, the first documents that aren't barred."""
    return f"""
{name}_ring AS (SELECT document_id, row_number() OVER (ORDER BY {_hash(seed, 'document_id')}, document_id) - 1 AS place FROM {pool}),
{name}_size AS (SELECT count(*) AS z FROM {pool}),
{name}_met AS (SELECT need, document_id, (place - (('0x' || substr({_hash(seed, 'need')}, 1, 8))::BIGINT % z) + z) % z AS step
  FROM n, {name}_ring, {name}_size WHERE NOT EXISTS (SELECT 1 FROM ({barred}) b WHERE b.need = n.need AND b.document_id = {name}_ring.document_id)),
{name} AS (SELECT need, document_id, row_number() OVER (PARTITION BY need ORDER BY step) - 1 AS turn FROM {name}_met QUALIFY row_number() OVER (PARTITION BY need ORDER BY step) <= {count})"""


def _mapped(*parts: str) -> str:
    rows = " UNION ALL ".join(parts)
    return f"""SELECT need AS "IN", (row_number() OVER (PARTITION BY need ORDER BY part, turn, document_id) - 1)::INT AS pos, document_id FROM ({rows})"""


_ANN = "SELECT need, document_id, 0 AS part, pos AS turn FROM ann"
_LIMIT = """ WITH chosen AS (SELECT "IN" AS need, min(line_no) AS turn FROM qrels WHERE "IN" IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 25),
req AS (SELECT DISTINCT document_id FROM qrels WHERE "IN" IN (SELECT need FROM chosen) AND document_id IS NOT NULL),
must AS (SELECT doc_id, id FROM documents WHERE id IN (SELECT document_id FROM req)),
fill AS (SELECT id, min(doc_id) AS doc_id FROM documents WHERE id NOT IN (SELECT document_id FROM req) GROUP BY id ORDER BY 2
  LIMIT (SELECT greatest(400 - count(*), 0) FROM must)),
kept AS (SELECT doc_id, id FROM must UNION ALL SELECT doc_id, id FROM fill)"""

_JUDGED = f"""{_LABELS}, {_NEEDS}, j AS (SELECT run_id, query_id, need, rank, p.document_id, coalesce(label, 0) > 0 AS rel
  FROM predictions p LEFT JOIN needs USING (query_id) LEFT JOIN l USING (need, document_id)),
pos AS (SELECT need, count(*) AS n FROM l WHERE label > 0 GROUP BY need),
sm AS (SELECT run_id, query_id, need, count(DISTINCT document_id) AS retrieved_document_count, count(DISTINCT document_id) FILTER (WHERE rel) AS retrieved_relevant_count,
  coalesce(any_value(pos.n), 0) AS relevant_document_count, min(rank) FILTER (WHERE rel) AS first_relevant_rank FROM j LEFT JOIN pos USING (need) GROUP BY ALL),
s AS (SELECT *, coalesce(1 / first_relevant_rank, 0) AS rr, CASE WHEN relevant_document_count > 0 THEN retrieved_relevant_count / relevant_document_count ELSE 0 END AS rc FROM sm)"""

_NEST = "nested AS (SELECT DISTINCT ON (run_id, query_id, rank, id) run_id || '/' || query_id AS query_id, rank, id, document_id, score FROM predictions)"

SQL: dict[str, str] = {
    "p1_found": P1_FOUND,
    "dense_topk_cosine": _dense(_COS),
    "dense_topk_dot": _dense("list_dot_product(q.e, v.e)"),
    "dense_topk_candidates": _dense(_COS, "q.label = v.label"),
    "dense_empty_candidates": _dense(_COS, "false"),
    "rerank_bi_encoder": f"SELECT query_id, id, score FROM ({_dense(_COS, 'q.label = v.label', None, 'id')})",
    "bm25_topk": _BM25.replace("{where}", ""),
    "bm25_candidates": _BM25.replace("{where}", 'WHERE (query_id, id) IN (SELECT q.line_no, d.doc_id FROM queries q JOIN input_mapping i ON i."IN" = q."IN" JOIN documents d ON d.id = i.document_id WHERE q.line_no % 20 = 0)'),
    "term_statistics": f"WITH t AS (SELECT doc_id, unnest({_WORDS.format('content')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term",
    "sparse_postings": f"WITH {_SP} SELECT dim, ordinal, round(weight, 6) AS weight FROM p",
    "sparse_index_stats": f"WITH {_SP} SELECT (SELECT count(*) FROM embeddings) AS document_count, max(dim) + 1 AS sparse_dimension, count(DISTINCT dim) AS active_dimension_count, count(*) AS posting_count FROM p",
    "sparse_topk": _sparse(10),
    "sparse_candidates": _sparse(10, extra="AND a.label = b.label"),
    "sparse_min_score": _sparse(1000, 0.25),
    "fuse_rrf": _fuse("1 / (60.0::DOUBLE + rank)"),
    "fuse_sum": _fuse("s"),
    "fuse_sum_norm": _fuse(_MINMAX),
    "fuse_linear": _fuse(_MINMAX, "(VALUES ('sparse-ccsa', 1.0::DOUBLE), ('dense-baseline', -0.25)) w(run_id, weight)"),
    "fuse_zscore": _fuse("CASE WHEN lo = hi OR dev = 0 THEN 0.0 ELSE (s - mean) / dev END"),
    "fuse_missing_score": _fuse("s", missing=-1.0),
    "topk_documents": f"""WITH f AS (SELECT query_id, id, round(sum(weight * (1 / (60.0::DOUBLE + rank))), 9) AS score FROM predictions JOIN {_W} USING (run_id) GROUP BY 1, 2)
      SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC)::INT AS rank FROM f) WHERE rank <= 3""",
    "chunk_cascade": f"""WITH r AS (SELECT DISTINCT run_id AS source, query_id, rank AS old, id, document_id, {_RS} AS s FROM predictions),
      b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source, query_id, document_id ORDER BY s DESC, id DESC) <= 1)
      SELECT source, query_id, row_number() OVER (PARTITION BY source, query_id ORDER BY s DESC, id DESC)::INT AS rank, id, round(s, 6) AS score FROM b""",
    "chunk_collapse": f"SELECT run_id, query_id, document_id, round(max({_RS}), 6) AS score, min(rank) AS rank FROM predictions GROUP BY 1, 2, 3",
    "metrics_all": _metrics(),
    **{f"metric_{m.lower()}": _metrics(f"metric LIKE '{m}@%'") for m in ("Recall", "Precision", "HitRate", "MRR", "NDCG", "MAP")},
    "metrics_per_query": f"WITH {_PERQ} SELECT run_id, query_id, metric, round(value, 6) AS value FROM m WHERE metric IN ('NDCG@10', 'MRR@10')",
    "prefix_documents": f"SELECT doc_id, 'passage: ' || {_collapse('content')} AS content FROM documents",
    "preprocess_queries": "SELECT line_no, 'query: ' || " + _collapse(r"regexp_replace(regexp_replace(content, '" + _WHITE + r"+', ' ', 'g'), '([\p{L}\p{N}_]+)@(\p{Nd}+)', '\1 at \2', 'g')") + " || ' ?' AS content FROM queries",
    "repeat_queries": f"SELECT line_no, 'query: ' || regexp_replace(content || ' ' || content, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS content FROM queries",
    "content_filter_kept": f"SELECT doc_id FROM documents WHERE {_ACCEPT}",
    "content_filter_rejected": f"SELECT doc_id FROM documents WHERE NOT coalesce({_ACCEPT}, false)",
    "identity_parse": "SELECT doc_id, content FROM documents WHERE content IS NOT NULL",
    "query_to_string": "SELECT content AS text FROM queries WHERE content IS NOT NULL",
    "enrich_documents": f"""WITH c AS (SELECT document_id AS id, '"judgments":' || count(*) AS x FROM qrels WHERE document_id IS NOT NULL GROUP BY 1),
      e AS (SELECT doc_id, meta, x, {_INNER.format("coalesce(meta, '{}')")} AS a FROM documents LEFT JOIN c USING (id))
      SELECT doc_id, CASE WHEN x IS NULL THEN meta ELSE '{{' || a || CASE WHEN a = '' THEN '' ELSE ',' END || x || '}}' END AS meta FROM e""",
    "enrich_conflicts": "SELECT id, array_to_string(list_sort(list_filter(json_keys(meta), lambda k: k IN ('topic', 'dataset'))), ',') AS keys FROM documents WHERE len(list_filter(json_keys(meta), lambda k: k IN ('topic', 'dataset'))) > 0",
    "reformulate_explode": "SELECT line_no, v::INT AS variant, content || CASE WHEN v = 1 THEN ' ?' ELSE '' END AS content FROM queries, (VALUES (0), (1)) x(v) WHERE content IS NOT NULL",
    "mapping_annotated": f"WITH {_POOLS} {_mapped(_ANN)}",
    "mapping_all_docs": f"""WITH {_POOLS}, a AS (SELECT document_id, pos FROM docs ORDER BY {_hash('7d', 'document_id')}, document_id LIMIT 100), b AS (SELECT need FROM n ORDER BY {_hash('7q', 'need')}, need LIMIT 20)
      {_mapped("SELECT need, document_id, 0 AS part, pos AS turn FROM a, b")}""",
    "mapping_random": f"WITH {_POOLS}, {_ring('r', 'pool_random', 'SELECT need, document_id FROM ann WHERE false', 5, '71')} {_mapped('SELECT need, document_id, 1 AS part, turn FROM r')}",
    "mapping_easy_negatives": f"WITH {_POOLS}, {_ring('r', 'pool_easy', 'SELECT need, document_id FROM ann', 2, '72')} {_mapped(_ANN, 'SELECT need, document_id, 2 AS part, turn FROM r')}",
    "mapping_gold_negatives": f"WITH {_POOLS}, {_ring('r', 'pool_gold', 'SELECT need, document_id FROM prs', 4, '73')} {_mapped('SELECT need, document_id, 3 AS part, turn FROM r')}",
    "mapping_mixed": f"""WITH {_POOLS}, {_ring('r', 'pool_random', 'SELECT need, document_id FROM ann', 3, '71')},
      {_ring('g', 'pool_gold', 'SELECT need, document_id FROM prs UNION SELECT need, document_id FROM r', 3, '73')}
      {_mapped(_ANN, 'SELECT need, document_id, 1 AS part, turn FROM r', 'SELECT need, document_id, 3 AS part, turn FROM g')}""",
    "mapping_stats": f"""WITH {_POOLS}, c AS (SELECT n.need, count(ann.document_id) AS k FROM n LEFT JOIN ann USING (need) GROUP BY n.need)
      SELECT count(*) AS query_count, min(k) AS candidate_count_min, max(k) AS candidate_count_max, round(avg(k), 6) AS candidate_count_mean, (SELECT count(*) FROM docs) AS active_document_count FROM c""",
    "mapping_first_places": """WITH f AS (SELECT "IN", document_id, min(pos) AS p FROM input_mapping WHERE "IN" IN (SELECT "IN" FROM queries) AND document_id IN (SELECT id FROM documents) GROUP BY 1, 2)
      SELECT "IN", (row_number() OVER (PARTITION BY "IN" ORDER BY p) - 1)::INT AS pos, document_id FROM f""",
    "limit_documents": f"{_LIMIT} SELECT doc_id FROM kept",
    "limit_queries": f'{_LIMIT} SELECT line_no FROM queries WHERE "IN" IN (SELECT need FROM chosen)',
    "limit_qrels": f'{_LIMIT} SELECT line_no FROM qrels WHERE "IN" IN (SELECT need FROM chosen) AND document_id IN (SELECT id FROM kept)',
    "duplicate_ids": "SELECT id, count(*) AS n FROM documents GROUP BY id HAVING count(*) > 1",
    "qrel_conflicts": 'SELECT "IN", document_id, count(DISTINCT label) AS n_labels, count(*) AS n_rows FROM qrels GROUP BY 1, 2 HAVING count(DISTINCT label) > 1',
    "validate_records": """WITH x AS (
      SELECT 'queries' AS tbl, CASE WHEN "IN" IS NULL THEN 'missing IN' WHEN content IS NULL THEN 'missing content' WHEN meta IS NULL THEN 'missing meta' WHEN "IN" = '' THEN 'IN is empty' WHEN id = '' THEN 'id is empty' END AS problem FROM queries
      UNION ALL SELECT 'qrels', CASE WHEN "IN" IS NULL THEN 'missing IN' WHEN document_id IS NULL THEN 'missing document_id' WHEN label IS NULL THEN 'missing label' WHEN "IN" = '' THEN 'IN is empty' WHEN document_id = '' THEN 'document_id is empty' END FROM qrels)
      SELECT tbl, problem, count(*) AS n FROM x WHERE problem IS NOT NULL GROUP BY 1, 2""",
    "predictions_flat": f"WITH {_NEST} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, id)::INT AS rank, id, document_id, round(score, 6) AS score FROM nested",
    "query_summary": f"""WITH {_JUDGED} SELECT run_id, query_id, need AS "IN", retrieved_document_count, retrieved_relevant_count, relevant_document_count, first_relevant_rank, round(rr, 6) AS reciprocal_rank, round(rc, 6) AS recall_at_run_depth FROM s""",
    "run_means": f"WITH {_JUDGED} SELECT run_id, round(avg(rr), 6) AS mean_reciprocal_rank, round(avg(rc), 6) AS mean_recall, count(*) AS n_queries FROM s GROUP BY 1",
    "run_comparison": f"""WITH v AS ({_metrics()}) SELECT metric, a.value AS baseline, b.value AS treatment, round(b.value - a.value, 6) AS delta
      FROM (SELECT * FROM v WHERE run_id = 'dense-baseline') a FULL JOIN (SELECT * FROM v WHERE run_id = 'sparse-ccsa') b USING (metric)""",
    "paired_outcomes": f"""WITH {_JUDGED}, d AS (SELECT b.rr - a.rr AS x FROM s a JOIN s b USING (query_id) WHERE a.run_id = 'dense-baseline' AND b.run_id = 'sparse-ccsa')
      SELECT count(*) FILTER (WHERE x > 0) AS improved, count(*) FILTER (WHERE x < 0) AS degraded, count(*) FILTER (WHERE x = 0) AS unchanged, round(avg(x), 6) AS mean_delta FROM d""",
    "event_windows": "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
