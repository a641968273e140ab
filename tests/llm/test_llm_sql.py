from __future__ import annotations

import pytest

from compare import DATA, connect, rows
from quarrylight.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test tables")
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    found = QUERIES[name](spark, str(DATA)).toPandas()
    wanted = con.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_splits_hold_on_the_tables(spark, con):
    found = QUERIES["p3_splits"](spark, str(DATA)).toPandas()
    con.register("s", found)
    assert con.sql("SELECT count(*) FROM queries").fetchall() == con.sql("SELECT count(*) FROM s").fetchall()
    assert con.sql('SELECT 1 FROM queries JOIN s USING (line_no) WHERE "IN" IS NOT NULL GROUP BY lower(trim("IN", chr(32) || chr(9))) HAVING count(DISTINCT split_name) > 1').fetchall() == []
    assert con.sql("SELECT 1 FROM queries JOIN s USING (line_no) GROUP BY id HAVING count(DISTINCT split_name) > 1").fetchall() == []
    for target, actual in con.sql("SELECT target_share, (SELECT count(*) FROM s WHERE s.split_name = t.split_name) / (SELECT count(*) FROM s) FROM split_targets t").fetchall():
        assert abs(target - actual) < 0.06


def test_ids_decode_to_the_texts(spark, con):
    from quarrylight.llm import tokens

    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    found = {r.doc_id: r.ids for r in QUERIES["p6_ids"](spark, str(DATA)).collect()}
    assert found.keys() == texts.keys() and all(tokens.decode(found[d]) == (t or "") for d, t in texts.items())


def test_mixture_keeps_shares_and_repeats(spark, con):
    shares = {r.source: r for r in QUERIES["p7_shares"](spark, str(DATA)).collect()}
    there = {s: r for s, r in shares.items() if r.target_share and r.available_tokens}
    whole = sum(r.target_share for r in there.values())
    assert all(abs(r.actual_share - r.target_share / whole) < 0.02 for r in there.values())
    assert all(r.most_copies <= r.max_repeats for r in there.values())
    assert all(r.used_tokens == 0 for s, r in shares.items() if s not in there)


def test_pieces_cover_the_contents(spark, con):
    found = QUERIES["p4_pieces"](spark, str(DATA)).toPandas()
    con.register("p", found)
    bad = con.sql("SELECT count(*) FROM p JOIN documents d USING (doc_id) WHERE p.piece <> substr(d.content, start_pos + 1, end_pos - start_pos) OR length(p.piece) > 360").fetchall()
    assert bad == [(0,)]
    gaps = con.sql("SELECT count(*) FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.piece_no = a.piece_no + 1 WHERE b.start_pos <> a.end_pos - 60").fetchall()
    assert gaps == [(0,)]
    ends = con.sql("SELECT count(*) FROM (SELECT doc_id, max(end_pos) AS e FROM p GROUP BY doc_id) JOIN documents USING (doc_id) WHERE e <> length(content)").fetchall()
    assert ends == [(0,)]
