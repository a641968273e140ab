from __future__ import annotations

from datetime import datetime as dt

import pytest

from quarrylight.llm import components, copies


def test_copies_of_prose_and_fields(spark):
    rows = [
        (5, "Über  das Maß!", "prose", dt(2024, 1, 1), "k"), (2, "über-das maß", "prose", dt(2024, 3, 1), "k"),
        (9, '{"a": "X y", "b_c": "1"}', "fields", None, "k"), (8, "B_C = 1 | a = x  Y", "fields", dt(2024, 2, 1), "k"), (7, "\nbc: 1; A: xy ", "fields", dt(2024, 2, 1), "k"),
        (6, "a=1\nbc=xy", "fields", dt(2024, 2, 1), "k"),  # values exchanged
        (1, None, "prose", dt(2024, 1, 1), "k"), (3, "", "prose", dt(2024, 1, 1), "k"), (4, "!!", "prose", dt(2024, 1, 1), "k"), (10, "??", "prose", dt(2024, 1, 1), "k"),
        (11, "über das maß", "fields", dt(2024, 1, 1), "k"),  # other form
        (12, "x" * 200_000, "prose", dt(2024, 1, 1), "k"), (13, "X " * 200_000, "prose", dt(2024, 1, 1), "k"),
        (14, "ΟΔΟΣ ΚΑΙ", "prose", dt(2024, 1, 1), "k"), (15, "οδος και", "prose", dt(2024, 1, 1), "k"),
    ]
    df = spark.createDataFrame(rows, "doc_id BIGINT, content STRING, form STRING, ingested_at TIMESTAMP, key STRING")
    ledger, got = copies.find_copies(spark, [("documents", df, "doc_id", "ingested_at"), ("empty", df.limit(0), "doc_id", "ingested_at")])
    assert sorted((r.tbl, r.kept_key, r.copy_key) for r in got.collect()) == [
        ("documents", 2, 5), ("documents", 7, 8), ("documents", 7, 9), ("documents", 12, 13), ("documents", 14, 15),
    ]
    assert sorted((r.kept_key, r.copies) for r in ledger.collect()) == [(2, 2), (6, 1), (7, 3), (11, 1), (12, 2), (14, 2)]


BATCH = "tbl STRING, row_key BIGINT, key BINARY, at DOUBLE"


def state(ledger):
    return sorted((bytes(r.key), r.copies, r.kept_key, r.first_key) for r in ledger.rows().collect())


def test_ledger_batches_are_idempotent_and_survive(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    ledger = copies.CopyLedger(spark, path)
    one = spark.createDataFrame([("t", 5, b"a", 4.0), ("t", 6, b"b", None), ("t", 7, None, 1.0)], BATCH)
    assert ledger.apply(one, "1") and not ledger.apply(one, "1")
    again = copies.CopyLedger(spark, path)
    assert not again.apply(one, "1")
    assert again.apply(spark.createDataFrame([("t", 3, b"a", 9.0)] * 3 + [("t", 9, b"c", 1.0), ("t", 1, b"b", 0.5)], BATCH), "2")
    assert again.apply(spark.createDataFrame([], BATCH), "3")
    assert state(again) == [(b"a", 4, 3, 5), (b"b", 2, 1, 6), (b"c", 1, 9, 9)]
    assert state(copies.CopyLedger(spark, path)) == state(again)


def test_ledger_appends_merges_and_grows(spark, tmp_path):
    import random

    rng = random.Random(2)
    ledger = copies.CopyLedger(spark, f"file://{tmp_path}/ledger", bucket_rows=20, least_buckets=2, merge_share=0.5)
    rows, written = [], []
    for k in range(7):
        batch = [("t", rng.randrange(10**6), f"k{rng.randrange(30 + 40 * (k == 2))}".encode(), float(rng.randrange(50))) for _ in range(40 if k < 3 else 6)]
        rows += batch
        ledger.apply(spark.createDataFrame(batch, BATCH), str(k))
        written.append((ledger.state["buckets"], len(ledger.state["fresh"])))
        keys = {r[2] for r in rows}
        want = sorted((key, sum(r[2] == key for r in rows), min(r[1] for r in rows if r[2] == key), min((r[3], r[1]) for r in rows if r[2] == key)[1]) for key in keys)
        assert state(ledger) == want
    assert written[0] == (2, 0) and written[2][0] > 2 and any(f for _, f in written)  # grown buckets; small batches aren't merged at once
    before = state(ledger)
    gone = ledger.vacuum()
    assert gone and state(copies.CopyLedger(spark, f"file://{tmp_path}/ledger")) == before
    ledger.merge()
    assert state(ledger) == before and not ledger.state["fresh"]


def test_ledger_loses_nothing_to_a_crash(spark, tmp_path, monkeypatch):
    from quarrylight import session

    path = f"file://{tmp_path}/ledger"
    ledger = copies.CopyLedger(spark, path)
    ledger.apply(spark.createDataFrame([("t", 1, b"a", 0.0)], BATCH), "1")
    before = state(ledger)
    with monkeypatch.context() as m:
        m.setattr(session, "_rename", lambda fs, a, b: False)
        with pytest.raises(OSError):
            ledger.apply(spark.createDataFrame([("t", 2, b"a", 0.0)], BATCH), "2")
    again = copies.CopyLedger(spark, path)
    assert state(again) == before
    assert again.apply(spark.createDataFrame([("t", 2, b"a", 0.0)], BATCH), "2") and state(again) == [(b"a", 2, 1, 1)]
    for m in tmp_path.joinpath("ledger").glob("manifest-*"):
        m.unlink()
    with pytest.raises(ValueError, match="no manifest"):
        copies.CopyLedger(spark, path)


def brute(edges):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("name", ["path", "hot", "random"])
def test_star_components_against_union_find(spark, name):
    import random

    rng = random.Random(3)
    edges = {
        "path": [(f"{i:03}", f"{i + 1:03}") for i in range(60)],
        "hot": [("hub", f"{i:03}") for i in range(300)] + [("x", "y")],
        "random": [(f"{rng.randrange(200):03}", f"{rng.randrange(200):03}") for _ in range(150)],
    }[name]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame([*edges, (None, "q"), ("q", "q")], "u STRING, v STRING")
    assert {r.node: r.component for r in components.star_components(spark, df).collect()} == brute(edges)


def test_groups_and_splits(spark):
    rows = [
        (1, "q1", " Need-1\t", None), (2, "q2", "need-1", None), (3, "q2", "NEED-0", None), (4, "q3", None, None), (5, "q3", None, None),
        (6, "q4", "alone", None), (7, None, None, None), (8, None, "alone2", None), (9, None, "Alone2 ", None),
    ]
    df = spark.createDataFrame(rows, "line_no BIGINT, id STRING, IN STRING, component STRING")
    got = {r.row_key: (r.group_in, r.n_rows) for r in components.related_groups(spark, df, "line_no", "IN", "id").collect()}
    assert got == {1: ("need-0", 3), 2: ("need-0", 3), 3: ("need-0", 3), 4: (None, 2), 5: (None, 2), 6: ("alone", 1), 7: (None, 1), 8: ("alone2", 2), 9: ("alone2", 2)}
    assert components.related_groups(spark, df.limit(0), "line_no", "IN", "id").count() == 0


def test_shares_hold_with_a_hot_group(spark):
    rows = [(i, f"c{i if i > 3000 else 0}") for i in range(9000)]
    groups = spark.createDataFrame(rows, "row_key BIGINT, component STRING")
    groups = groups.join(groups.groupBy("component").count().withColumnRenamed("count", "n_rows"), "component")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", None)], "split_name STRING, target_share DOUBLE")
    got = components.assign_splits(groups, targets).join(groups, "row_key").collect()
    assert len(got) == 9000 and len({(r.component, r.split_name) for r in got}) == len({r.component for r in got})
    for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r.split_name == split for r in got) / 9000 - share) < 0.02
    assert {r.split_name for r in components.assign_splits(groups.limit(3), targets.limit(0)).collect()} == {None}


def test_fixed_ranges_don_t_move_with_the_data(spark):
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("validation", 0.1)], "split_name STRING, target_share DOUBLE")
    rows = [(k, f"need{k % 400}", f"id{k}") for k in range(1200)]
    df = spark.createDataFrame(rows, "line_no BIGINT, IN STRING, id STRING")
    place = lambda d: {r.row_key: r.split_name for r in components.assign_splits(components.related_groups(spark, d, "line_no", "IN", "id"), targets, fixed=True).collect()}
    some, every = place(df.where("line_no % 400 < 100")), place(df)
    assert all(every[k] == v for k, v in some.items()) and len({every[k] for k in range(400)}) == 3
    assert all(every[k] == every[k % 400] for k in every)
    share = sum(v == "train" for v in every.values()) / len(every)
    assert abs(share - 0.8) < 0.06
