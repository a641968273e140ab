from __future__ import annotations

from datetime import datetime as dt

import pytest

from quarrylight.operators.references import Reference, orphan_cascade, orphan_report

DOCS = "doc_id BIGINT, id STRING, ingested_at TIMESTAMP, deleted_at TIMESTAMP, tbl STRING, row_key STRING"
RELS = "line_no BIGINT, need STRING, document_id STRING, judged_at TIMESTAMP, level INT"
REFS = [
    Reference("rels", "document_id", "docs", "id", "judged_at", "ingested_at", "deleted_at"),
    Reference("asked", "need", "rels", "need"),
]
KEYS = {"docs": "doc_id", "rels": "line_no", "asked": "line_no"}


def day(n):
    return dt(2024, 1, n)


def tables(spark, docs, rels, asked):
    return {
        "docs": spark.createDataFrame(docs, DOCS),
        "rels": spark.createDataFrame(rels, RELS),
        "asked": spark.createDataFrame(asked, "line_no BIGINT, need STRING, received_at TIMESTAMP, parent STRING"),
    }


def found(df):
    return sorted((r.tbl, r.field, r.row_key, r.level) for r in df.collect())


def test_direct_and_inherited_with_periods(spark):
    docs = [
        (1, "a", day(2), day(5), "x", "y"), (2, "a", day(8), None, "x", "y"), (3, "a", day(9), day(7), "x", "y"),
        (4, "", day(1), None, None, None), (4, "b", day(1), day(1), None, None),
    ]
    rels = [
        (1, "n1", "a", day(1), 0),  # before the first delivery
        (2, "n2", "a", day(2), 0),  # inclusive start
        (3, "n3", "a", day(5), 0),  # exclusive end
        (4, "n4", "a", day(10), 0),
        (5, "n5", "gone", None, 0),
        (6, "n6", "b", None, 0),  # any time
        (7, "n7", "b", day(1), 0),  # empty period
        (8, "n8", None, day(1), 0),  # no reference
        (9, "n9", "", day(3), 0),  # empty key is a key
        (10, "n3", "gone", day(3), 0), (10, "n3", "gone", day(3), 0),
    ]
    asked = [(1, "n1", day(1), None), (2, "n2", day(1), None), (3, "n3", None, None), (4, "nobody", day(40 - 10), None), (5, None, day(1), None), (6, "n8", day(1), None)]
    got = found(orphan_cascade(spark, tables(spark, docs, rels, asked), KEYS, REFS))
    assert got == [
        ("asked", "need", 1, 1), ("asked", "need", 3, 1), ("asked", "need", 4, 0),
        *[("rels", "document_id", k, 0) for k in (1, 3, 5, 7, 10, 10)],
    ]


def test_long_chain_and_cycle(spark):
    rows = [(i, f"k{i}", f"k{i + 1}") for i in range(6)] + [(10, "c1", "c2"), (11, "c2", "c1"), (12, "own", "own")]
    t = {"t": spark.createDataFrame(rows, "n BIGINT, id STRING, up STRING")}
    got = found(orphan_cascade(spark, t, {"t": "n"}, [Reference("t", "up", "t", "id")]))
    assert got == [("t", "up", i, 5 - i) for i in range(6)]
    with pytest.raises(ValueError):
        orphan_cascade(spark, t, {"t": "n"}, [Reference("t", "up", "t", "id")], max_rounds=2)


def test_empty_tables_and_report(spark):
    t = tables(spark, [], [(1, "n", "a", day(3), 0), (2, "n", "b", None, 0)], [])
    got = orphan_cascade(spark, t, KEYS, REFS)
    assert found(got) == [("rels", "document_id", 1, 0), ("rels", "document_id", 2, 0)]
    report = orphan_report(got, t, KEYS, {"rels": "judged_at"}).collect()
    assert sorted((str(r.month), r.direct, r.inherited) for r in report) == [("2024-01-01", 1, 0), ("None", 1, 0)]
    assert found(orphan_cascade(spark, tables(spark, [], [], []), KEYS, REFS)) == []


def test_bad_specifications(spark):
    with pytest.raises(ValueError):
        Reference("a", "b", "c", "d", child_time="t")
    with pytest.raises(ValueError):
        orphan_cascade(spark, {}, {}, [Reference("a", "b", "c", "d")])


def test_hot_key_merges_into_few_periods(spark):
    docs = [(i, "hot", day(1 + i % 20), None if i % 3 else day(2 + i % 20), None, None) for i in range(300)]
    rels = [(i, "n", "hot", day(1 + i % 28), 0) for i in range(200)]
    got = orphan_cascade(spark, tables(spark, docs, rels, []), KEYS, REFS[:1]).collect()
    brute = [r[0] for r in rels if not any(d[2] <= r[3] and (d[3] is None or d[3] > r[3]) for d in docs)]
    assert sorted(r.row_key for r in got) == brute


def test_salted_keys_change_nothing(spark, monkeypatch):
    from quarrylight.operators import references, skew

    docs = [(i, f"k{i % 3}", day(1 + i % 20), None if i % 3 else day(2 + i % 20), None, None) for i in range(60)]
    rels = [(i, "n", f"k{i % 5}", day(1 + i % 28) if i % 7 else None, 0) for i in range(200)]
    plain = found(orphan_cascade(spark, tables(spark, docs, rels, []), KEYS, REFS[:1]))
    monkeypatch.setattr(references, "heavy_keys_of", lambda df, key: skew.heavy_keys_of(df, key, heavy_rows=10))
    assert found(orphan_cascade(spark, tables(spark, docs, rels, []), KEYS, REFS[:1])) == plain and plain
