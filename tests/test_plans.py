"""What reaches the scans, and what the plans must not contain."""

from __future__ import annotations

import re

import pytest

from compare import DATA
from quarrylight.operators import cascade, fusion, metrics
from quarrylight.queries import QUERIES


@pytest.fixture(autouse=True)
def tables():
    if not DATA.exists():
        pytest.skip("no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name, columns", [
    ("prefix_documents", {"doc_id", "content"}),  # id is only for a message of rows without content
    ("repeat_queries", {"line_no", "content"}),
    ("content_filter_kept", {"doc_id", "content"}),
    ("chunk_collapse", {"run_id", "query_id", "rank", "document_id", "score"}),
    ("term_statistics", {"doc_id", "content"}),
])
def test_scans_read_what_is_needed(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<(.*?)>\n", plan(QUERIES[name](spark, str(DATA))))
    assert read and all({c.partition(":")[0] for c in r.split(",")} <= columns for r in read)


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["identity_parse"](spark, str(DATA)))
    assert "PushedFilters: [IsNotNull(content)" in text


@pytest.mark.parametrize("name", ["dense_topk_cosine", "bm25_topk", "sparse_topk", "fuse_zscore", "metrics_all", "mapping_mixed", "p1_found", "query_summary", "enrich_documents"])
def test_no_pairs_of_everything(spark, name):
    text = plan(QUERIES[name](spark, str(DATA)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin Inner" not in text


def test_cuts_limit_their_groups_before_the_shuffle(spark):
    ranked = spark.read.parquet(f"{DATA}/predictions.parquet").withColumnRenamed("run_id", "source")
    fused = fusion.reciprocal_rank_fusion(ranked, {"dense-baseline": 1.0})
    assert "WindowGroupLimit" in plan(cascade.top_k_documents(fused, 3))
    assert "WindowGroupLimit" in plan(metrics.rank_documents(ranked, 5))


def executed(spark, make):
    """The physical plans of all that runs while ``make`` builds its result and it is read."""
    seen = []
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store = spark.sparkContext._jvm.org.apache.spark.sql.classic.SparkSession.getActiveSession().get().sharedState().statusStore()
        old = store.executionsCount()
        make().collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        all_ = store.executionsList()
        seen = [all_.apply(i).physicalPlanDescription() for i in range(old, all_.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return seen


def test_the_corpus_is_cut_into_words_once(spark):
    plans = executed(spark, lambda: QUERIES["bm25_topk"](spark, str(DATA)))
    cutting = [p for p in plans if "regexp_extract_all" in p and "documents.parquet" in p]
    assert plans and len(cutting) == 1


def test_sparse_vectors_are_scanned_without_a_shuffle(spark):
    text = plan(QUERIES["sparse_topk"](spark, str(DATA)))
    tree = text.split("\n\n")[0]
    below = tree[tree.index("MapInArrow") :]
    assert "Exchange" not in below[: below.index("Scan parquet")] and "collect_list" not in text
