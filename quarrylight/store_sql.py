"""SQL for DuckDB of the queries in ``quarrylight.store_queries``, written apart from their operators."""

from __future__ import annotations

from quarrylight.sql import _BM25, _COS, _LABELS, _NEEDS, _NEST, _PERQ, _SP, _WHITE, SQL as CORE, _dense, _sparse

_ORDINAL = "o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS ordinal FROM embeddings)"


def _stripped(x: str) -> str:
    return f"nullif(regexp_replace(coalesce({x}, ''), '^{_WHITE}+|{_WHITE}+$', '', 'g'), '')"


def _split(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{_WHITE}+'), lambda x: x <> '')"


_OVERLAP = f"""
pairs AS (SELECT DISTINCT q.line_no AS query_id, d.doc_id AS id, q.content AS a, d.content AS t FROM queries q
  JOIN (SELECT DISTINCT "IN", document_id FROM input_mapping) m ON m."IN" = q."IN" JOIN documents d ON d.id = m.document_id
  WHERE q.line_no % 20 = 0 AND q.content IS NOT NULL AND d.content IS NOT NULL),
w AS (SELECT query_id, id, list_distinct({_split('a')}) AS a, list_distinct({_split('t')}) AS t FROM pairs),
raw AS (SELECT query_id, id, len(list_intersect(a, t)) / greatest(len(a), 1) AS raw FROM w)"""


def _rerank(score: str, k: int, where: str = "true") -> str:
    return f"""WITH {_OVERLAP}, s AS (SELECT query_id, id, {score} AS score FROM raw)
      SELECT query_id, rank, id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR DESC)::INT AS rank FROM s WHERE {where}) WHERE rank <= {k}"""


_CODES = """
e AS (SELECT vec_id, g, list_slice(embedding, g * 8 + 1, g * 8 + 8) AS v FROM embeddings, range(8) r(g)),
c AS (SELECT vec_id, (g * 8 + list_position(v, list_max(v)) - 1)::INT AS dim FROM e)"""

_FUSED = f"""
d AS ({_dense(_COS, k=20)}), s AS ({_sparse(20)}),
u AS (SELECT query_id::VARCHAR AS query_id, id::VARCHAR AS id, 1.0::DOUBLE / (60 + rank) AS x FROM d UNION ALL SELECT query_id::VARCHAR, id, 0.5::DOUBLE / (60 + rank) FROM s),
f AS (SELECT query_id, id, sum(x) AS score FROM u GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC)::INT AS rank FROM f)"""


def _zeros(*rules: str) -> str:
    """No rule may be broken."""
    return f"SELECT rule, 0::BIGINT AS n FROM (VALUES {', '.join(f'({chr(39)}{r}{chr(39)})' for r in rules)}) r(rule)"


def _cascade(rounds: int = 5) -> str:
    """Direct orphans and, unrolled, so many rounds of inheritance between queries and qrels."""
    parts = [f"o0 AS (SELECT *, 0 AS level FROM ({CORE['p1_found']}))"]
    for k in range(rounds):
        lost = lambda t: f"SELECT line_no FROM o{k} WHERE tbl = '{t}'"  # noqa: B023, E731
        listed = lambda t: f"SELECT line_no FROM o{k} WHERE tbl = '{t}' AND field = 'IN'"  # noqa: B023, E731
        parts.append(f"""n{k} AS (
          SELECT 'qrels' AS tbl, 'IN' AS field, line_no, {k + 1} AS level FROM qrels q WHERE "IN" IS NOT NULL AND line_no NOT IN ({listed('qrels')}) AND NOT EXISTS (
            SELECT 1 FROM queries d WHERE d."IN" = q."IN" AND (q.judged_at IS NULL OR d.received_at <= q.judged_at) AND d.line_no NOT IN ({lost('queries')}))
          UNION ALL SELECT 'queries', 'IN', line_no, {k + 1} FROM queries q WHERE "IN" IS NOT NULL AND line_no NOT IN ({listed('queries')}) AND NOT EXISTS (
            SELECT 1 FROM qrels d WHERE d."IN" = q."IN" AND d.line_no NOT IN ({lost('qrels')})))""")
        parts.append(f"o{k + 1} AS (SELECT * FROM o{k} UNION ALL SELECT * FROM n{k})")
    return "WITH " + ", ".join(f"{p.partition(' AS ')[0]} AS MATERIALIZED {p.partition(' AS ')[2]}" for p in parts)


_ROUNDS = 5
_LETTERS = "[length(content), length(content) - length(replace(content, 'e', ''))]"

SQL: dict[str, str] = {
    "jsonl_roundtrip": "SELECT doc_id, id, title, content FROM documents",
    "strict_records": "SELECT id, content, \"IN\" FROM queries WHERE content IS NOT NULL AND \"IN\" <> '' AND id <> '' AND meta IS NOT NULL",
    "indexing_input": "WITH n AS (SELECT count(DISTINCT id) AS n FROM documents WHERE content IS NOT NULL AND id <> '') SELECT n AS documents, ceil(n / 64)::BIGINT AS batches, n AS lines, 64 AS digest_length FROM n",
    "metadata_roundtrip": "SELECT document_id AS id, '{\"judgments\":' || count(*) || '}' AS meta FROM qrels WHERE document_id <> '' GROUP BY 1",
    "json_artifacts": "SELECT r_regionkey, r_name, sha256(r_name) AS digest FROM region",
    "content_digests": "SELECT doc_id, sha256(content) AS digest FROM documents WHERE content IS NOT NULL",
    "predictions_store": f"WITH {_NEST} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, id)::INT AS rank, id, document_id, round(score, 6) AS score FROM nested",
    "predictions_nested": f"""WITH {_NEST.replace("document_id, score FROM", "document_id, score, data FROM")}
      SELECT query_id, '[' || string_agg('{{' || concat_ws(',', '"id":' || to_json(id), '"document_id":' || to_json(document_id), '"score":' || score, '"data":' || to_json(data)) || '}}', ',' ORDER BY rank, id) || ']' AS results
      FROM nested GROUP BY query_id""",
    "query_extra_data": "SELECT line_no::VARCHAR AS query_id, json(meta)::VARCHAR AS data FROM queries WHERE meta IS NOT NULL",
    "benchmark_corpus": f"SELECT id, concat_ws(chr(10), {_stripped('arg_min_null(title, doc_id)')}, {_stripped('arg_min_null(text, doc_id)')}) AS content FROM documents GROUP BY id",
    "benchmark_queries": "SELECT \"IN\" AS id, \"IN\", arg_min_null(content, line_no) AS content FROM queries WHERE \"IN\" <> '' GROUP BY ALL",
    "benchmark_qrels": "SELECT regexp_replace(\"IN\", '^ +| +$', '', 'g') AS \"IN\", regexp_replace(document_id, '^ +| +$', '', 'g') AS document_id, max(label) AS label FROM qrels WHERE \"IN\" <> '' AND document_id <> '' AND NOT regexp_matches(\"IN\" || document_id, '[\\t\\n\\r]') GROUP BY qrels.\"IN\", qrels.document_id",
    "benchmark_prepared": """WITH j AS (SELECT DISTINCT "IN", document_id FROM qrels WHERE "IN" <> '' AND document_id <> '' AND NOT regexp_matches("IN" || document_id, '[\\t\\n\\r]')), n AS (SELECT DISTINCT regexp_replace("IN", '^ +| +$', '', 'g') AS need FROM j)
      SELECT 'documents' AS name, count(DISTINCT id) AS n FROM documents UNION ALL SELECT 'qrels', count(*) FROM j
      UNION ALL SELECT 'queries', count(DISTINCT "IN") FROM queries WHERE "IN" <> '' AND "IN" IN (SELECT need FROM n)""",
    "dense_store": "SELECT vec_id::VARCHAR AS id, label, len(embedding)::INT AS dimension, round(list_sum(embedding::DOUBLE[]), 5) AS total, 'dot_product' AS similarity FROM embeddings",
    "sparse_store": f"WITH {_ORDINAL} SELECT vec_id::VARCHAR AS id, ordinal, label, len(list_filter(embedding, lambda x: x > 0))::INT AS n_active FROM embeddings JOIN o USING (vec_id)",
    "sparse_store_postings": f"WITH {_SP}, {_ORDINAL} SELECT dim, o.ordinal, round(weight, 6) AS weight FROM p JOIN o ON o.vec_id = p.ordinal",
    "sparse_store_stats": f"WITH {_SP} SELECT (SELECT count(*) FROM embeddings) AS document_count, (max(dim) + 1)::BIGINT AS sparse_dimension, count(DISTINCT dim) AS active_dimension_count, count(*) AS posting_count FROM p",
    "mapping_store": 'SELECT "IN", pos, document_id, \'own\' AS dataset FROM input_mapping',
    "prepared_mapping": CORE["mapping_stats"],
    "search_engine_store": "SELECT doc_id::VARCHAR AS id, content FROM documents WHERE content IS NOT NULL",
    "stream_store": "SELECT doc_id::VARCHAR AS id, content FROM documents",
    "run_discovery": "SELECT regexp_replace(n_name, '[^A-Za-z0-9._-]+', '-', 'g') AS name, n_regionkey AS value FROM nation WHERE n_nationkey % 2 = 0",
    "ordinals": "SELECT doc_id, row_number() OVER (ORDER BY id, doc_id) - 1 AS ordinal FROM documents",
    "embedded_documents": f"SELECT doc_id, unnest([0, 1])::INT AS place, unnest({_LETTERS})::FLOAT AS value FROM documents WHERE content IS NOT NULL",
    "embedded_queries": f"SELECT line_no, unnest([0, 1, 2])::INT AS place, unnest(list_append({_LETTERS}, 1))::FLOAT AS value FROM queries WHERE content IS NOT NULL",
    "encoded_postings": """WITH v AS (SELECT doc_id AS ordinal, length(content)::DOUBLE AS n, (length(content) - length(replace(content, 'e', '')))::DOUBLE AS e FROM documents WHERE content IS NOT NULL)
      SELECT 0 AS dim, ordinal, n AS weight FROM v WHERE n > 0 UNION ALL SELECT 1, ordinal, e FROM v WHERE e > 0""",
    "rerank_cross_encoder": _rerank("raw", 10),
    "rerank_scaled": _rerank("1 / (1 + exp(-2 * raw))", 5, "score >= 0.6"),
    "model_codes": f"WITH {_CODES} SELECT vec_id AS ordinal, dim FROM c",
    "model_losses": f"""WITH {_CODES}, x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS dim FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings),
      err AS (SELECT avg((0.125 + CASE WHEN c.dim IS NULL THEN 0 ELSE 0.5 END - v) ** 2) AS e FROM x LEFT JOIN c ON c.vec_id = x.vec_id AND c.dim = x.dim),
      used AS (SELECT r.dim, count(c.dim) AS k FROM range(64) r(dim) LEFT JOIN c ON c.dim = r.dim GROUP BY 1), u AS (SELECT sqrt(sum((k - n / 8) ** 2)) / sqrt(any_value(n)) AS u FROM used, n)
      SELECT n, 64 AS dimension, round(e, 6) AS reconstruction_loss, round(u, 6) AS uniformity_loss, round(e + 0.5::DOUBLE * u, 6) AS loss FROM n, err, u""",
    "training_violations": _zeros("epoch missing", "loss not finite", "reconstruction not better", "code outside its codebook", "other codes by the same seed"),
    "chunk_violations": _zeros("blank and chunks", "numbers with gaps", "over the size", "blank chunk", "other than the text", "other id"),
    "pipeline_fused": f"WITH {_FUSED} SELECT query_id, rank, id, round(score, 8) AS score FROM p WHERE rank <= 10",
    "pipeline_metrics": f"""WITH {_FUSED}, l AS (SELECT vec_id::VARCHAR AS id, label FROM embeddings), big AS (SELECT label, count(*) AS n FROM l GROUP BY 1),
      q AS (SELECT id AS query_id, label, n FROM l JOIN big USING (label) WHERE id::BIGINT % 20 = 0),
      h AS (SELECT q.query_id, any_value(q.n) AS n, count(*) FILTER (WHERE l.label = q.label) AS hits, count(*) FILTER (WHERE l.label = q.label AND rank <= 5) AS hits5, min(rank) FILTER (WHERE l.label = q.label) AS first_
        FROM q JOIN p ON p.query_id = q.query_id AND rank <= 10 JOIN l ON l.id = p.id GROUP BY 1)
      SELECT 'Recall@10' AS metric, round(avg(hits / n), 6) AS value FROM h UNION ALL SELECT 'Precision@5', round(avg(hits5 / 5), 6) FROM h UNION ALL SELECT 'MRR@10', round(avg(coalesce(1 / first_, 0)), 6) FROM h""",
    "pipeline_lexical": "SELECT b.query_id::VARCHAR AS query_id, rank, b.id::VARCHAR AS id, d.id AS document_id, score FROM (" + CORE["bm25_candidates"] + ") b JOIN documents d ON d.doc_id = b.id",
    "metrics_shared_in": f"""WITH {_PERQ}, shared AS (SELECT need FROM needs WHERE need IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
      SELECT run_id, metric, round(avg(value), 6) AS value, count(*) AS n_wordings FROM m JOIN needs USING (query_id) WHERE need IN (SELECT need FROM shared) AND metric IN ('NDCG@10', 'MRR@10') GROUP BY 1, 2""",
    "p1_cascade": f"{_cascade(_ROUNDS)} SELECT tbl, field, line_no, level FROM o{_ROUNDS}",
    "p1_report": f"""{_cascade(_ROUNDS)}, t AS (SELECT 'qrels' AS tbl, line_no, date_trunc('month', judged_at)::DATE AS month FROM qrels UNION ALL SELECT 'queries', line_no, date_trunc('month', received_at)::DATE FROM queries)
      SELECT tbl, field, month::VARCHAR AS month, count(*) FILTER (WHERE level = 0) AS direct, count(*) FILTER (WHERE level > 0) AS inherited FROM o{_ROUNDS} JOIN t USING (tbl, line_no) GROUP BY ALL""",
    "p1_inherited": """WITH j AS (SELECT line_no, "IN", document_id IS NOT NULL AND document_id NOT IN (SELECT id FROM documents WHERE form = 'fields') AS gone FROM qrels),
      n AS (SELECT "IN", bool_and(gone) AS gone FROM j WHERE "IN" IS NOT NULL GROUP BY 1),
      a AS (SELECT line_no, id, CASE WHEN q."IN" IS NULL THEN NULL WHEN n."IN" IS NULL THEN 0 WHEN gone THEN 1 END AS level FROM queries q LEFT JOIN n ON n."IN" = q."IN"),
      w AS (SELECT id, bool_and(level IS NOT NULL) AS gone, max(level) + 1 AS level FROM a GROUP BY id)
      SELECT 'judged' AS tbl, 'document_id' AS field, line_no, 0 AS level FROM j WHERE gone UNION ALL SELECT 'asked', 'IN', line_no, level FROM a WHERE level IS NOT NULL
      UNION ALL SELECT 'wordings', 'id', line_no, w.level FROM queries JOIN w USING (id) WHERE gone""",
    "dense_metrics": f"""WITH d AS ({_dense(_COS)}), big AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), k AS (SELECT unnest(range(1, 11)) AS i),
      r AS (SELECT d.query_id, d.rank, (e.label = q.label) AS rel, big.n FROM d JOIN embeddings e ON e.vec_id = d.id JOIN embeddings q ON q.vec_id = d.query_id JOIN big ON big.label = q.label),
      h AS (SELECT *, count(*) FILTER (WHERE rel) OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM r),
      o AS (SELECT query_id, any_value(n) AS n, count(*) FILTER (WHERE rel) AS hits, min(rank) FILTER (WHERE rel) AS first_, sum(1 / log2(rank + 1)) FILTER (WHERE rel) AS gain, sum(nth / rank) FILTER (WHERE rel) AS prec FROM h GROUP BY 1),
      i AS (SELECT query_id, sum(1 / log2(i + 1)) AS ideal FROM o, k WHERE i <= n GROUP BY 1),
      m AS (SELECT unnest([{{'metric': 'Recall@10', 'value': hits / n}}, {{'metric': 'Precision@10', 'value': hits / 10}}, {{'metric': 'HitRate@10', 'value': CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END}},
        {{'metric': 'MRR@10', 'value': coalesce(1 / first_, 0)}}, {{'metric': 'NDCG@10', 'value': coalesce(gain / ideal, 0)}}, {{'metric': 'MAP@10', 'value': coalesce(prec / hits, 0)}}], recursive := true) FROM o JOIN i USING (query_id))
      SELECT metric, round(avg(value), 6) AS value FROM m GROUP BY 1""",
}
