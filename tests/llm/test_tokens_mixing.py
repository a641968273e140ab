from __future__ import annotations

import random

import pytest
from hypothesis import given, settings, strategies as st

from quarrylight.llm import mixing, tokens


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_round_trip_and_offsets(text):
    text = text.encode("utf-8", "replace").decode("utf-8")
    (ids,) = tokens.encode([text])
    assert tokens.decode(ids) == text
    spans = tokens.offsets(text, ids)
    assert all(0 <= a < b <= len(text) for a, b in spans)
    assert sorted({i for a, b in spans for i in range(a, b)}) == list(range(len(text)))


@given(st.text(alphabet="ab1 \n\t'.s 語", max_size=400), st.integers(1, 50))
@settings(max_examples=150, deadline=None)
def test_segments_change_nothing(text, size):
    parts = tokens.segments(text, size)
    assert "".join(parts) == text
    whole = tokens.tokenizer(tokens.DEFAULT).encode(text, add_special_tokens=False).ids
    assert [i for p in parts for i in tokens.tokenizer(tokens.DEFAULT).encode(p, add_special_tokens=False).ids] == whole


def test_agrees_with_the_rank_file():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["<|endoftext|> a", "Über 1,5 % 語彙", "x  \n\n y", "🙂👍🏽", "it's I'LL"]
    assert [list(i) for i in tokens.encode(texts)] == [other.encode_ordinary(t) for t in texts]


def test_documents_with_nulls_and_long_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (4, "word " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_documents(df, "doc_id", "text").collect())
    assert [x[0] for x in got] == [1, 2, 3, 3, 4] and got[0][1] == got[1][1] == [] and got[2] == got[3]
    assert tokens.decode(got[4][1]) == "word " * 60_000
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, ["doc_id"], "text").collect()}
    assert counts[1] == 0 and counts[4] == len(got[4][1])
    assert tokens.encode_documents(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("total", [None, 40_000])
def test_shares_and_repeats(spark, total):
    rng = random.Random(1)
    rows = [(i, rng.choices(["big", "mid", "small", "other"], [60, 30, 3, 7])[0], rng.randrange(0, 60)) for i in range(6000)] + [(9000, None, 5), (9001, "hot", 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, n_tokens BIGINT")
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("absent", 0.0, 4), ("never", 0.2, 0)], "source STRING, target_share DOUBLE, max_repeats INT")
    mixture, shares = mixing.mix_sources(spark, docs, targets, total_tokens=total)
    used = mixture.collect()
    cap = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r.copies <= cap[r.source] for r in used) and len({r.doc_id for r in used}) == len(used)
    sums = {s: sum(r.n_tokens * r.copies for r in used if r.source == s) for s in cap}
    have = {s: sum(n for _, x, n in rows if x == s) for s in cap}
    whole = total or min(have[s] * cap[s] / share for s, share in (("big", 0.6), ("mid", 0.3), ("small", 0.1)))
    for s, share in (("big", 0.6), ("mid", 0.3), ("small", 0.1)):
        assert 0 <= share * whole - sums[s] < 60 + 1e-6
    report = {r.source: r for r in shares.collect()}
    assert report["absent"].used_tokens == 0 and report["other"].target_share is None and report["never"].actual_share == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([], "doc_id BIGINT, source STRING, n_tokens BIGINT")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    mixture, shares = mixing.mix_sources(spark, docs, targets)
    assert mixture.count() == 0 and shares.first().actual_share is None
    with pytest.raises(ValueError):
        mixing.mix_sources(spark, docs, targets.union(targets))
