from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import analysis, cascade, fusion, metrics

LIST = "query_id STRING, source STRING, rank INT, id STRING, score DOUBLE, content STRING"


def ranked(spark, lists, query="q"):
    rows = [(query, s, i, d, score, f"{d} from {s}") for s, items in lists.items() for i, (d, score) in enumerate(items, 1)]
    return spark.createDataFrame(rows, LIST)


def order(df):
    return [(r.id, r.score) for r in df.orderBy("rank").collect()]


def fused_by_hand(lists, weights, amount):
    """(id, score) by score, then id, both descending; ``amount(scores of the list, rank, score)`` is what a place is worth."""
    sums: dict = {}
    for name, items in lists.items():
        if name in weights:
            scores = [s for _, s in items]
            for rank, (d, score) in enumerate(items, 1):
                sums[d] = sums.get(d, 0.0) + weights[name] * amount(scores, rank, score)
    return sorted(((d, pytest.approx(v)) for d, v in sums.items()), key=lambda x: (-x[1].expected, [-ord(c) for c in x[0]]))


LISTS = {
    "title": [("oak", 7.5), ("elm", 6.0), ("fir", -2.0), ("yew", -2.0)],
    "body": [("yew", 0.031), ("ash", 0.027), ("oak", 0.002)],
    "links": [("ash", 1000.0)],
    "noise": [("elm", 5.0), ("oak", 4.0)],
}
WEIGHTS = {"title": 0.3, "body": 1.7, "links": -0.4}


def test_ranks_are_fused(spark):
    df = ranked(spark, LISTS)
    for k in (0, 3, 60):
        wanted = fused_by_hand(LISTS, WEIGHTS, lambda _, rank, __: 1 / (k + rank))  # noqa: B023
        assert order(fusion.reciprocal_rank_fusion(df, WEIGHTS, rrf_k=k)) == wanted
    both = [fusion.reciprocal_rank_fusion(df, w, payload=["content"]).where("id = 'oak'").first().content for w in ({"body": 1, "title": 1}, {"title": 1, "body": 1})]
    assert both == ["oak from body", "oak from title"]  # what a document carries comes from the first source by the order of weights


def test_scores_are_fused(spark):
    df = ranked(spark, LISTS)
    deviation = lambda x: math.sqrt(sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x))
    amounts = {
        "none": lambda _, __, s: s,
        "minmax": lambda x, _, s: 1.0 if max(x) == min(x) else (s - min(x)) / (max(x) - min(x)),
        "zscore": lambda x, _, s: (s - sum(x) / len(x)) / deviation(x) if deviation(x) else 0.0,
    }
    for kind, amount in amounts.items():
        assert order(fusion.score_fusion(df, WEIGHTS, normalize=kind)) == fused_by_hand(LISTS, WEIGHTS, amount)
    assert order(fusion.linear_score_fusion(df, WEIGHTS)) == order(fusion.score_fusion(df, WEIGHTS, normalize="minmax"))
    assert order(fusion.zscore_fusion(df, WEIGHTS)) == order(fusion.score_fusion(df, WEIGHTS, normalize="zscore"))
    with pytest.raises(ValueError):
        fusion.score_fusion(df, WEIGHTS, normalize="rank")


def test_missing_scores_count_before_they_are_normalised(spark):
    df = ranked(spark, {"title": [("oak", 8.0), ("elm", None), ("fir", 4.0)]})
    assert dict(order(fusion.linear_score_fusion(df, {"title": 1.0}))) == {"oak": 1.0, "fir": 0.5, "elm": 0.0}
    assert dict(order(fusion.linear_score_fusion(df, {"title": 1.0}, missing_score=6.0))) == {"oak": 1.0, "elm": 0.5, "fir": 0.0}


def test_fusion_edges(spark):
    df = ranked(spark, {"a": [(None, 9.0), ("d1", None), ("d1", 1.0)], "ignored": [("d9", 5.0)]})
    assert order(fusion.score_fusion(df, {"a": 1.0}, missing_score=-1.0)) == [("d1", 0.0)]
    assert order(fusion.reciprocal_rank_fusion(df, {"a": 1.0}, rrf_k=0)) == [("d1", pytest.approx(1 / 2 + 1 / 3))]
    assert order(fusion.score_fusion(df, {"a": -2.0}, normalize="minmax")) == [("d1", pytest.approx(-2 * (0 + 1 / 9)))]
    assert order(fusion.score_fusion(df, {})) == [] and order(fusion.zscore_fusion(df.limit(0), {"a": 1.0})) == []


def test_cuts_against_plain_python(spark):
    import random

    rng = random.Random(8)
    rows = [(f"q{k % 3}", f"p{k:02}", rng.choice([None, "", f"s{k % 4}"]), float(rng.randrange(6))) for k in range(45)]
    df = spark.createDataFrame(rows, "query_id STRING, id STRING, source_document_id STRING, score DOUBLE")
    best_first = {q: sorted((r for r in rows if r[0] == q), key=lambda r: (r[3], r[1]), reverse=True) for q in ("q0", "q1", "q2")}
    listed = lambda d: {q: [r.id for r in d.where(F.col("query_id") == q).orderBy("rank").collect()] for q in best_first}
    for k in (0, 1, 4, 99, -3, -99):
        assert listed(cascade.top_k_documents(df, k)) == {q: [r[1] for r in x[:k]] for q, x in best_first.items()}
    for k in (1, 2, 50):

        def few(x):
            seen: dict = {}
            for r in x:
                mine = seen.setdefault(r[2] or r[1], [])
                if len(mine) < k:  # noqa: B023
                    mine.append(r[1])
            return [r[1] for r in x if any(r[1] in v for v in seen.values())]

        assert listed(cascade.chunk_cascade(df, k)) == {q: few(x) for q, x in best_first.items()}
    for bad in (0, -1):
        with pytest.raises(ValueError):
            cascade.chunk_cascade(df, bad)
    for cut in (cascade.top_k_documents, cascade.chunk_cascade):
        with pytest.raises(Exception, match="no score"):
            cut(df.withColumn("score", F.when(F.col("id") != "p07", F.col("score"))), 2).collect()


PRED = "query_id STRING, rank INT, id STRING, document_id STRING, score DOUBLE"


def evaluate(spark, preds, needs, qrels, names, **options):
    p = spark.createDataFrame(preds, PRED)
    q = spark.createDataFrame(needs, "id STRING, IN STRING")
    j = spark.createDataFrame(qrels, "IN STRING, document_id STRING, label INT")
    return {r.metric: r.value for r in metrics.evaluate(spark, p, q, j, names, **options).collect()}


def measured_by_hand(places, labels, k):
    """All six metrics of one list of documents, best first, by their definitions; ``labels`` are the positive ones."""
    hits = [i for i, d in enumerate(places[:k], 1) if d in labels]
    gain = sum(labels[d] / math.log2(i + 1) for i, d in enumerate(places[:k], 1) if d in labels)
    ideal = sum(v / math.log2(i + 1) for i, v in enumerate(sorted(labels.values(), reverse=True)[:k], 1))
    return {
        f"Recall@{k}": len(hits) / len(labels), f"Precision@{k}": len(hits) / k, f"HitRate@{k}": float(bool(hits)), f"MRR@{k}": 1 / hits[0] if hits else 0.0,
        f"NDCG@{k}": gain / ideal, f"MAP@{k}": sum((n + 1) / i for n, i in enumerate(hits)) / len(hits) if hits else 0.0,
    }


def test_metrics_by_their_definitions(spark):
    import random

    rng = random.Random(21)
    needs = [(f"wording{i}", f"need{i // 2}") for i in range(10)]  # two wordings of a need are scored apart
    judged = [(f"need{n}", f"doc{d}", rng.choice([0, 0, 1, 2, 3])) for n in range(5) for d in range(12) if rng.random() < 0.6]
    lists = {q: rng.sample([f"doc{d}" for d in range(15)], rng.randrange(1, 13)) for q, _ in needs}
    preds = [(q, i, f"{d}#{c}", d, 50.0 - i - c / 10) for q, docs in lists.items() for i, d in enumerate(docs, 1) for c in range(rng.randrange(1, 4))]  # chunks fall together
    names = [f"{alias}@{k}" for alias in ("recall", "P", "Hit-Rate", "mrr", "NDCG", "map") for k in (1, 3, 10)]
    got = evaluate(spark, preds, needs, judged, names)
    per_query = []
    for q, need in needs:
        labels = {d: v for n, d, v in judged if n == need and v > 0}
        assert labels
        per_query.append({m: v for k in (1, 3, 10) for m, v in measured_by_hand(lists[q], labels, k).items()})
    assert got == pytest.approx({m: sum(x[m] for x in per_query) / len(per_query) for m in per_query[0]})


def test_what_metrics_divide_by(spark):
    needs = [("a", "judged"), ("b", "judged"), ("c", "unjudged"), ("d", "refused")]
    judged = [("judged", "hill", 1), ("judged", "lake", 2), ("refused", "hill", 0)]
    preds = [("a", 1, "sea", "sea", 3.0), ("a", 2, "lake", "lake", 2.0), ("c", 1, "hill", "hill", 1.0), ("d", 1, "hill", "hill", 1.0)]
    got = evaluate(spark, preds, needs, judged, ["Recall@5", "Precision@5", "MRR@5"])
    assert got == {"Recall@5": 0.5, "Precision@5": 0.2, "MRR@5": 0.5}  # only "a": "b" has no list, "c" and "d" nothing to find


def test_metrics_edges(spark):
    none = evaluate(spark, [("q", 1, "a", "a", 1.0)], [("q", "unjudged")], [("n", "a", 1)], ["Recall@5"])
    assert none == {"Recall@5": 0.0}
    assert evaluate(spark, [], [], [], ["Recall@5"]) == {"Recall@5": 0.0} and evaluate(spark, [], [], [], []) == {}
    empty_list = evaluate(spark, [("q", 1, None, None, None), ("p", 1, "a", "a", float("nan"))], [("q", "n"), ("p", "n")], [("n", "a", 1)], ["Recall@5"])
    assert empty_list == {"Recall@5": 0.5}
    with pytest.raises(Exception, match="conflicting"):
        evaluate(spark, [("q", 1, "a", "a", 1.0)], [("q", "n")], [("n", "a", 1), ("n", "a", 0)], ["Recall@5"])
    assert evaluate(spark, [("q", 1, "a", "a", 1.0)], [("q", "n")], [("n", "a", 1), ("n", "a", 0)], ["Recall@5"], policy="max") == {"Recall@5": 1.0}
    with pytest.raises(Exception, match="unknown query"):
        evaluate(spark, [("who", 1, "a", "a", 1.0)], [("q", "n")], [("n", "a", 1)], ["Recall@5"])
    with pytest.raises(ValueError):
        evaluate(spark, [], [("q", "n"), ("q", "m")], [], ["Recall@5"])
    for bad in ("Recall", "Recall@0", "Foo@3", "@3"):
        with pytest.raises(ValueError):
            metrics.Metric.parse(bad)
    with pytest.raises(TypeError):
        metrics.Metric.parse(3)


def test_summaries_of_runs(spark):
    rows = [
        ("old", "wind", 1, "w#0", "west", 0.4), ("old", "wind", 2, "e#3", "east", 0.3), ("old", "wind", 3, "e#1", "east", 0.2), ("old", "rain", 1, "n#0", "north", 0.1),
        ("new", "wind", 1, "e#3", "east", 0.9), ("new", "rain", 1, None, None, None), ("new", "snow", 4, "n#1", "north", 0.5),
    ]
    p = spark.createDataFrame(rows, "run_id STRING, query_id STRING, rank INT, id STRING, document_id STRING, score DOUBLE")
    q = spark.createDataFrame([("wind", "air"), ("rain", "water"), ("snow", "water")], "id STRING, IN STRING")
    j = spark.createDataFrame([("air", "east", 3), ("air", "south", 1), ("air", "west", 0), ("water", "north", 1)], "IN STRING, document_id STRING, label INT")
    summary = analysis.query_summary(p, q, j)
    got = {(r.run_id, r.query_id): (r.retrieved_document_count, r.retrieved_relevant_count, r.relevant_document_count, r.first_relevant_rank, r.reciprocal_rank, r.recall_at_run_depth) for r in summary.collect()}
    assert got == {
        ("old", "wind"): (2, 1, 2, 2, 0.5, 0.5), ("old", "rain"): (1, 1, 1, 1, 1.0, 1.0), ("new", "wind"): (1, 1, 2, 1, 1.0, 0.5),
        ("new", "rain"): (0, 0, 1, None, 0.0, 0.0), ("new", "snow"): (1, 1, 1, 4, 0.25, 1.0),
    }
    outcome = analysis.paired_outcomes(summary, "old", "new").first()
    assert (outcome.improved, outcome.degraded, outcome.unchanged, outcome.mean_delta) == (1, 1, 0, -0.25)
    assert {r.run_id: r.mean_reciprocal_rank for r in analysis.run_means(summary).collect()} == {"old": 0.75, "new": pytest.approx(1.25 / 3)}
