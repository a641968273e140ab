from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight import session
from quarrylight.operators import cascade, ccsa, dense, lexical, mapping, models, skew, sparse
from quarrylight.plans import config, graph, stages
from quarrylight.sources import artifacts, benchmark, indexes, predictions as preds
from quarrylight.streaming import indexing

DOCS = "id STRING, content STRING, source_document_id STRING, embedding ARRAY<FLOAT>, pos INT"


def vectors(spark):
    rows = [("north", None, [0.0, 2.0], 0), ("east", "", [3.0, 0.0], 1), ("northeast", "map", [1.0, 1.0], 2), ("still", "map", [0.0, 0.0], 3)]
    return spark.createDataFrame([(n, n, owner, v, pos) for n, owner, v, pos in rows], DOCS)


def queries(spark):
    return spark.createDataFrame([("walk", [1.0, 0.2]), ("stand", [0.0, 0.0])], "query_id STRING, embedding ARRAY<FLOAT>")


def test_dense(spark):
    found = lambda df: [(r.query_id, r.rank, r.id) for r in df.orderBy("query_id", "rank").collect()]
    wanted = [("stand", 1, "still"), ("stand", 2, "northeast"), ("walk", 1, "east"), ("walk", 2, "northeast")]
    assert found(dense.dense_retrieve(queries(spark), vectors(spark), 2)) == wanted
    assert found(dense.dense_retrieve(queries(spark), vectors(spark), 2, block_bytes=1)) == wanted
    asked = spark.createDataFrame([("walk", "map"), ("walk", "north"), ("walk", "north"), ("walk", None)], "query_id STRING, document_id STRING")
    some = dense.dense_retrieve_candidates(queries(spark), vectors(spark), asked, 5)
    assert found(some) == [("walk", 1, "northeast"), ("walk", 2, "north"), ("walk", 3, "still")]
    assert dense.dense_retrieve_candidates(queries(spark), vectors(spark), asked.limit(0)).count() == 0
    assert dense.dense_retrieve(queries(spark).limit(0), vectors(spark)).count() == 0 and dense.dense_retrieve(queries(spark), vectors(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        dense.dense_retrieve(queries(spark), vectors(spark), 0)
    missing, ragged, holed = F.lit(None).cast("array<float>"), F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(None).cast("double"))
    for bad in (missing, ragged, holed):
        with pytest.raises(Exception, match="no embedding"):
            dense.dense_retrieve(queries(spark), vectors(spark).withColumn("embedding", F.when(F.col("id") == "east", bad).otherwise(F.col("embedding")))).collect()


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(2)
    docs, asked = rng.normal(size=(300, 8)).round(1), rng.normal(size=(7, 8)).round(1)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "id BIGINT, embedding ARRAY<DOUBLE>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id BIGINT, embedding ARRAY<DOUBLE>")
    for kind in dense.SIMILARITIES:
        s = asked @ docs.T
        if kind == "cosine":
            s = s / (np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(docs, axis=1)[None])
        want = {(i, r + 1): j for i in range(7) for r, j in enumerate(sorted(range(300), key=lambda j: (round(s[i, j], 6), str(j)), reverse=True)[:10])}
        assert {(r.query_id, r.rank): r.id for r in dense.dense_retrieve(q, d, 10, kind, 6).collect()} == want


def test_stable_reranking(spark):
    pairs = vectors(spark).withColumns({"query_id": F.lit("q"), "query_embedding": F.array(F.lit(1.0), F.lit(1.0))})
    assert [r.id for r in dense.rank_candidates(pairs).orderBy("rank").collect()] == ["northeast", "north", "east", "still"]
    with pytest.raises(Exception, match="wrong dimension"):
        dense.rank_candidates(pairs.withColumn("query_embedding", F.array(F.lit(1.0)))).collect()


SPARSE = "ordinal BIGINT, id STRING, source_document_id STRING, sparse STRUCT<indices: ARRAY<INT>, values: ARRAY<DOUBLE>>"


def sparse_tables(spark):
    rng = random.Random(17)
    vector = lambda n: (d := sorted(rng.sample(range(30), n)), [rng.choice([-1.5, 0.25, 0.5, 2.0, 3.0]) for _ in d])
    docs = [(i, f"u{i}", rng.choice([None, "", f"book{i % 5}"]), vector(rng.randrange(1, 9))) for i in range(40)]
    asked = [(f"q{i}", vector(rng.randrange(1, 6))) for i in range(7)]
    return docs, asked, spark.createDataFrame(docs, SPARSE), spark.createDataFrame(asked, "query_id STRING, sparse STRUCT<indices: ARRAY<INT>, values: ARRAY<DOUBLE>>")


def test_sparse(spark):
    docs, asked, d, q = sparse_tables(spark)
    entries = sparse.postings(d)
    owner = {o: src or name for o, name, src, _ in docs}

    def brute(k, least=0.0, listed=None):
        out = {}
        for name, (dims, weights) in asked:
            own = dict(zip(dims, weights, strict=True))
            scores = {o: round(sum(own[x] * w for x, w in zip(*v, strict=True) if x in own), 9) for o, _, _, v in docs if set(v[0]) & set(dims)}
            mine = {o for o in scores if scores[o] > least and (not (listed or {}).get(name) or owner[o] in listed[name])}
            out[name] = [(f"u{o}", scores[o]) for o in sorted(mine, key=lambda o: (-scores[o], o))[:k]]
        return {n: v for n, v in out.items() if v}

    def lists(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append((r.id, r.score))
        return out

    for documents in (d, d.drop("sparse")):  # by the stored vectors, and put together from postings
        assert lists(sparse.sparse_retrieve(q, entries, documents, 5)) == brute(5)
        assert lists(sparse.sparse_retrieve(q, entries, documents, 50, min_score=1.0, block=2)) == brute(50, 1.0)
        carried = {r.id: r.sparse for r in sparse.sparse_retrieve(q, entries, documents, 3, with_vectors=True).collect()}
        assert carried and all((v["indices"], v["values"]) == docs[int(name[1:])][3] for name, v in carried.items())
    listed = {"q0": {"book1", "u3", "nowhere"}, "q1": {"nowhere"}, "q2": {"book0", "book2"}}
    some = spark.createDataFrame([(n, x) for n, xs in listed.items() for x in xs] + [("q3", None)], "query_id STRING, document_id STRING")
    assert lists(sparse.sparse_retrieve(q, entries, d, 5, candidates=some)) == brute(5, 0.0, listed)
    assert sparse.sparse_retrieve(q.limit(0), entries, d).count() == 0 and sparse.sparse_retrieve(q, entries.limit(0), d.limit(0)).count() == 0
    stats = sparse.index_statistics(entries, d).first()
    used = [x for *_, v in docs for x in v[0]]
    assert (stats.document_count, stats.sparse_dimension, stats.active_dimension_count, stats.posting_count) == (40, max(used) + 1, len(set(used)), len(used))
    assert {r.ordinal: (r.sparse["indices"], r.sparse["values"]) for r in sparse.sparse_from_postings(entries).collect()} == {o: v for o, _, _, v in docs}
    for bad in (([0, 0], [1.0, 1.0]), ([-1], [1.0]), ([1], [0.0]), ([1], [float("nan")]), ([1, 2], [1.0])):
        with pytest.raises(Exception, match="invalid sparse"):
            sparse.postings(spark.createDataFrame([(0, "x", None, bad)], SPARSE)).collect()
    with pytest.raises(Exception, match="beyond"):
        sparse.postings(d, 12).collect()
    numbered = sparse.with_ordinal(spark.range(1000).withColumn("k", F.md5(F.col("id").cast("string"))), "k", start=5).collect()
    assert [r.id for r in sorted(numbered, key=lambda r: r.ordinal)] == [r.id for r in sorted(numbered, key=lambda r: r.k)] and {r.ordinal for r in numbered} == set(range(5, 1005))


def test_bm25_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 12))) if i % 9 else (None if i % 2 else "")) for i in range(80)]
    asked = [(i, " ".join(rng.choices("abcxyz", k=3))) for i in range(9)] + [(9, None), (10, "!!")]
    d = spark.createDataFrame(docs, "id BIGINT, content STRING").repartition(3)
    q = spark.createDataFrame(asked, "query_id BIGINT, content STRING")
    words = {i: t.split() for i, t in docs if t}
    mean = sum(map(len, words.values())) / len(words)

    def score(terms, w):
        return sum(np.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if t in w for n in [sum(t in x for x in words.values())])

    want = {}
    for i, text in asked:
        scored = [(round(s, 6), str(j), j) for j, w in words.items() if (s := score(set((text or "").split()), w)) > 0]
        for rank, (_, _, j) in enumerate(sorted(scored, reverse=True)[:5], 1):
            want[i, rank] = j
    for block in (100, 2):
        assert {(r.query_id, r.rank): r.id for r in lexical.bm25_retrieve(q, d, 5, block=block).collect()} == want
    every = q.select("query_id").crossJoin(d.select(F.col("id").alias("document_id")))
    assert {(r.query_id, r.rank): r.id for r in lexical.bm25_candidates(q, d, every, 5).collect()} == want
    assert lexical.bm25_retrieve(q.limit(0), d).count() == 0 and lexical.bm25_retrieve(q, d.limit(0)).count() == 0


TOWNS = "Ulm Ems Inn Bad Ley Aue Jena Gera Suhl".split()
#: Town -> (label by river); some towns aren't there, some rivers aren't asked for.
JUDGED = {"Elbe": {"Ulm": 2, "Inn": 0, "Rom": 1}, "Oder": {"Bad": 1, "Ulm": 0}, "Main": {}, "Nile": {"Ley": 0, "Aue": 1, "Jena": 2}}


def mapping_tables(spark):
    docs = spark.createDataFrame([(t, 10 * i) for i, t in enumerate(TOWNS)] + [("Ems", 99)], "id STRING, pos INT")
    asked = spark.createDataFrame([("Oder", 1), ("Elbe", 2), ("Main", 3), ("Elbe", 7), (None, 8)], "IN STRING, pos INT")
    rows = [(river, town, label) for river, towns in JUDGED.items() for town, label in towns.items()] + [(None, "Jena", 1), ("Elbe", None, 1), ("Elbe", "Ulm", 1)]
    return docs, asked, spark.createDataFrame(rows, "IN STRING, document_id STRING, label INT")


def recipe(**changes):
    base = {"seed": 1, "query_subset_size": None, "document_subset_size": None, "include_annotated_docs": False, "use_all_selected_documents_for_every_query": False}
    return base | {"random_docs_per_query": None, "easy_negative_docs_per_query": 0, "gold_passage_docs_per_query": 0} | changes


def lists(df):
    out: dict = {}
    for r in df.orderBy("IN", "pos").collect():
        out.setdefault(r.IN, []).append(r.document_id)
    return out


def test_mappings(spark):
    docs, asked, qrels = mapping_tables(spark)
    make = lambda **c: lists(mapping.generate_mapping(spark, docs, asked, qrels, recipe(**c)))
    rivers = ["Elbe", "Main", "Oder"]
    annotated = {r: [t for t in TOWNS if t in JUDGED[r]] for r in rivers}
    nowhere = {t for t in TOWNS if not any(t in v for v in JUDGED.values())}
    positive = {t for v in JUDGED.values() for t, label in v.items() if label > 0} & set(TOWNS)
    assert make(include_annotated_docs=True) == {r: v for r, v in annotated.items() if v}
    easy = make(include_annotated_docs=True, easy_negative_docs_per_query=2)
    for r in rivers:
        head, tail = easy[r][:-2], easy[r][-2:]
        assert head == annotated[r] and len(set(tail)) == 2 and set(tail) <= nowhere
    gold = make(gold_passage_docs_per_query=2)
    for r in rivers:
        assert len(gold[r]) == 2 and set(gold[r]) <= positive - set(JUDGED[r])
    drawn = make(random_docs_per_query=5, include_annotated_docs=True)
    assert all(v[: len(annotated[r])] == annotated[r] and len(set(v)) == len(v) == len(annotated[r]) + 5 for r, v in drawn.items()) and set(drawn) == set(rivers)
    assert drawn == make(random_docs_per_query=5, include_annotated_docs=True) != make(random_docs_per_query=5, include_annotated_docs=True, seed=2)
    some = make(use_all_selected_documents_for_every_query=True, query_subset_size=2, document_subset_size=4)
    assert len(some) == 2 and len({tuple(v) for v in some.values()}) == 1 and all(len(v) == 4 and sorted(v, key=TOWNS.index) == v for v in some.values())
    assert make(query_subset_size=0) == {} and make() == {}
    for bad in ({"query_subset_size": 4}, {"document_subset_size": 10}, {"random_docs_per_query": 10}, {"easy_negative_docs_per_query": len(nowhere) + 1}, {"random_docs_per_query": -1}, {"use_all_selected_documents_for_every_query": True, "random_docs_per_query": 1}):
        with pytest.raises(ValueError):
            make(**bad)
    with pytest.raises(ValueError, match="lacks"):
        mapping.parse_recipe({"seed": 1})
    stats = mapping.mapping_statistics(mapping.generate_mapping(spark, docs, asked, qrels, recipe(include_annotated_docs=True)), asked.where("`IN` IS NOT NULL"), docs.withColumnRenamed("id", "document_id")).first()
    sizes = [len(v) for v in annotated.values()]
    assert (stats.query_count, stats.active_document_count, stats.candidate_count_min, stats.candidate_count_max) == (3, len(TOWNS), min(sizes), max(sizes)) and stats.candidate_count_mean == pytest.approx(sum(sizes) / 3)
    picked = mapping.exact_sample(TOWNS, 4, 99)
    assert picked == mapping.exact_sample(TOWNS, 4, 99) and len(set(picked)) == 4 and sorted(picked, key=TOWNS.index) == picked


@pytest.mark.parametrize("few", [1, 40, 10_000])
def test_subsets_by_hash_thresholds(spark, monkeypatch, few):
    monkeypatch.setattr(mapping, "FEW_KEYS", few)
    monkeypatch.setattr(mapping, "PREFIX", 1)
    keys = [f"k{i}" for i in range(700)]
    df = spark.createDataFrame([(k, n) for k in keys for n in range(1 + len(k) % 2)] + [(None, 5)], "key STRING, n INT")
    order = sorted(keys, key=lambda k: (hashlib.md5(f"s|{k}".encode()).hexdigest(), k))
    for size in (0, 1, 37, 699, 700):
        got = mapping.sample_keys(df, "key", size, "s", "keys").collect()
        assert {r.key for r in got} == set(order[:size]) and len(got) == sum(1 + len(k) % 2 for k in order[:size])
    with pytest.raises(ValueError, match="701 keys were asked for, 700 exist"):
        mapping.sample_keys(df, "key", 701, "s", "keys")
    assert mapping.sample_keys(df, "key", None, "s", "keys").count() == df.count()
    first = mapping.first_rows(df.where("key IS NOT NULL"), 55, "key", "n").collect()
    assert sorted(map(tuple, first)) == sorted((k, n) for k in keys for n in range(1 + len(k) % 2))[:55]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limits", [{}, {"plain_rows": 0}, {"plain_rows": 0, "heavy_rows": 10}, {"plain_rows": 0, "left_rows": 10**13}])
def test_skewed_joins_are_joins(spark, how, limits):
    rng = random.Random(6)
    left = [(rng.choice(["hot", "hot", *"abcdefg", None]), i) for i in range(400)]
    right = [(k, f"{k}!") for k in ("hot", "a", "b", "zzz")]
    counted = [(k, v, sum(x[0] == k for x in left)) for k, v in right]
    a = spark.createDataFrame(left, "key STRING, n INT")
    b = spark.createDataFrame(counted, "key STRING, value STRING, rows INT")
    got = skew.join_unique_skewed(a, b, "key", F.col("rows"), how, **limits).select("key", "n", "value").collect()
    wanted = [(k, n, dict(right).get(k)) for k, n in left if how == "left" or k in dict(right)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    heavy = skew.heavy_keys_of(a, "key", heavy_rows=20)
    assert heavy is not None and {r.key: r.salts for r in heavy.collect()}["hot"] == -(-sum(k == "hot" for k, _ in left) // 20)
    assert skew.heavy_keys_of(a, "key") is None
    salted = skew.salted(a, b, "key", heavy, F.col("n"))
    assert sorted(r.n for r in salted[0].join(salted[1], ["key", "_salt"]).collect()) == sorted(n for k, n in left if k in dict(right))
    assert skew.heavy_limit(10**13) * skew.MOST_HEAVY >= 10**13


def test_mapping_checks_and_limits(spark):
    docs, asked, qrels = mapping_tables(spark)
    stored = spark.createDataFrame([("Main", 3, "Jena"), ("Main", 1, "Suhl"), ("Main", 9, "Suhl"), ("Oder", 0, "Ulm")], "IN STRING, pos INT, document_id STRING")
    assert lists(mapping.resolve_mapping(stored, asked, docs)) == {"Main": ["Suhl", "Jena"], "Oder": ["Ulm"]}
    for bad, message in ((stored.withColumn("document_id", F.lit("Rom")), "unknown document"), (stored.withColumn("IN", F.lit("Nile")), "unknown need")):
        with pytest.raises(ValueError, match=message):
            mapping.resolve_mapping(bad, asked, docs)
    wordings = spark.createDataFrame([("w1", "Main"), ("w2", "Main"), ("w3", "Oder"), ("w4", "Elbe")], "id STRING, IN STRING")
    found = mapping.query_candidates(wordings, stored, docs)
    assert {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()} == {"w1": 3, "w2": 3, "w3": 1, "w4": docs.count()}
    with pytest.raises(KeyError, match="Elbe"):
        mapping.query_candidates(wordings, stored)
    ordered = qrels.withColumn("pos", F.monotonically_increasing_id())
    d, q, j = mapping.limit_dataset(docs, asked, ordered, 1, 1)  # the first need of the judgments is the Elbe: what it names comes whatever the limit
    assert sorted(r.id for r in d.collect()) == ["Inn", "Ulm"] and {r.IN for r in q.collect()} == {"Elbe"} and j.count() == 3
    d, _, _ = mapping.limit_dataset(docs, asked, ordered, 4, 1)
    assert sorted(r.id for r in d.collect()) == sorted(["Inn", "Ulm", "Ems", "Bad"])  # filled up in the order of the corpus
    assert mapping.limit_dataset(docs, asked, ordered, None, None)[0] is docs


def test_models(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", "b a"), ("3", "")], "id STRING, content STRING")
    got = [list(r.embedding) for r in models.embed(df, models.HashEncoder, normalize=True).orderBy("id").collect()]
    assert got[0] == got[1] and np.linalg.norm(got[0]) == pytest.approx(1) and not any(got[2])
    with pytest.raises(Exception, match="no text"):
        models.embed(df, models.HashEncoder, blanks="error").collect()

    class Roles:
        def encode_query(self, texts):
            return [[1.0]] * len(texts)

        def encode(self, texts):
            return np.array([2.0])

    assert models.encode_texts(Roles(), ["x", "y"], "query").tolist() == [[1.0], [1.0]] and models.encode_texts(Roles(), ["x"], "document").tolist() == [[2.0]]
    pairs = df.withColumns({"query_id": F.lit("q"), "query_content": F.lit("a")})
    best = models.rerank(pairs, lambda: lambda a, b: [float(len(t)) for t in b], 2, scale_score=True, score_threshold=0.6).orderBy("rank").collect()
    assert [r.id for r in best] == ["2", "1"] and best[0].score == pytest.approx(1 / (1 + np.exp(-3)))


def failing_at(n):
    """A renaming that fails at its n-th call."""
    calls = iter(range(1, 100))
    return lambda fs, a, b: False if next(calls) == n else fs.rename(a, b)


def test_autoencoder(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4, 6)) * 3
    x = centres[rng.integers(0, 4, 400)] + rng.normal(size=(400, 6)) * 0.1
    model, history = ccsa.train(x, 2, 4, epochs=30, batch_size=64, learning_rate=0.02, balance_weight=0.05)
    assert history[-1]["reconstruction_loss"] < history[0]["reconstruction_loss"] / 2 and len(history) == 30
    codes = model.encode(x)
    assert codes.shape == (400, 2) and (codes[:, 0] < 4).all() and (codes[:, 1] >= 4).all() and (codes[:, 1] < 8).all()
    path = f"file://{tmp_path}/models/small"
    ccsa.write_model(spark, model, path, {"note": 1})
    again = ccsa.read_model(spark, path)
    assert (again.encode(x) == codes).all() and again.decode(again.one_hot(codes)).shape == x.shape
    assert again.weights.keys() == model.weights.keys() and all((again.weights[k] == v).all() for k, v in model.weights.items())
    with pytest.raises(FileExistsError):
        ccsa.write_model(spark, model, path)
    with monkeypatch.context() as m:
        m.setattr(session, "_rename", failing_at(3))  # two arrays of files are there, the folder isn't yet in its place
        with pytest.raises(OSError):
            ccsa.write_model(spark, ccsa.Autoencoder.create(6, 1, 2), path, overwrite=True)
    assert (ccsa.read_model(spark, path).encode(x) == codes).all() and [p.name for p in (tmp_path / "models").iterdir()] == ["small"]
    with pytest.raises(FileNotFoundError):
        ccsa.read_model(spark, f"file://{tmp_path}/none")
    (tmp_path / "models" / "small" / ".arrays.bin.crc").unlink()
    (tmp_path / "models" / "small" / "arrays.bin").write_bytes(b"12345678")
    with pytest.raises(ValueError):
        ccsa.read_model(spark, path)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:50])], "ordinal BIGINT, embedding ARRAY<DOUBLE>")
    got = ccsa.encode_sparse(df, model).orderBy("ordinal").collect()
    assert [r.sparse["indices"] for r in got] == codes[:50].tolist() and sparse.postings(ccsa.encode_sparse(df, model)).count() == 100
    assert ccsa.training_vectors(df, limit=10).shape == (10, 6)
    for bad in (lambda: ccsa.train(x[:1], 2, 4), lambda: ccsa.train(x, 2, 4, epochs=0), lambda: ccsa.training_vectors(df.limit(1)), lambda: model.encode(x[:, :3])):
        with pytest.raises(ValueError):
            bad()


def test_dense_store(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/dense"
    docs = spark.createDataFrame([(f"v{i}", [float(i), 1.0]) for i in range(4)], "id STRING, embedding ARRAY<FLOAT>")
    assert indexes.write_dense_index(docs, path, "dot_product") == 4
    found, kind = indexes.read_dense_index(spark, path, embeddings=False)
    assert kind == "dot_product" and found.columns == ["id"]
    with pytest.raises(FileExistsError):
        indexes.write_dense_index(docs, path)
    with pytest.raises(ValueError, match="more than once"):
        indexes.write_dense_index(docs.union(docs.limit(1)), f"file://{tmp_path}/twice")
    with pytest.raises(Exception):
        indexes.write_dense_index(docs.withColumn("embedding", F.lit(None).cast("array<float>")), f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        indexes.read_sparse_index(spark, path)
    other = docs.where("id = 'v1'")
    for n in (2, 3):  # the former store can't be set aside, or the new one can't be put in its place (the head is renamed first)
        with monkeypatch.context() as m:
            m.setattr(session, "_rename", failing_at(n))
            with pytest.raises(OSError):
                indexes.write_dense_index(other, path, overwrite=True)
        assert indexes.read_dense_index(spark, path)[0].count() == 4
    (tmp_path / "dense").rename(tmp_path / "dense.123.old")  # as a process leaves it that dies in between
    assert indexes.read_dense_index(spark, path)[0].count() == 4
    assert indexes.write_dense_index(other, path, overwrite=True) == 1 and indexes.read_dense_index(spark, path)[0].count() == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["dense"]


def test_sparse_store_takes_batches(spark, tmp_path, monkeypatch):
    path, schema = f"file://{tmp_path}/sparse", "id STRING, pos INT, title STRING, sparse STRUCT<indices: ARRAY<INT>, values: ARRAY<DOUBLE>>"
    batch = lambda *names: spark.createDataFrame([(n, i, n.upper(), ([i, 9], [0.5 + i, 2.0])) for i, n in enumerate(names)], schema)
    with pytest.raises(FileNotFoundError):
        indexes.write_sparse_index(batch("a"), path, append=True)
    assert indexes.write_sparse_index(batch("c", "a", "b"), path) == 3
    before = sorted(p for p in (tmp_path / "sparse").rglob("*.parquet"))
    assert indexes.write_sparse_index(batch("z", "y"), path, append=True) == 2
    assert set(before) <= set((tmp_path / "sparse").rglob("*.parquet"))  # nothing of the first batch was written again

    def check():
        documents, entries, stats = indexes.read_sparse_index(spark, path)
        assert {r.id: r.ordinal for r in documents.collect()} == {"c": 0, "a": 1, "b": 2, "z": 3, "y": 4}
        assert stats == {"document_count": 5, "sparse_dimension": 10, "active_dimension_count": 4, "posting_count": 10} and entries.count() == 10
        asked = spark.createDataFrame([("q", ([1], [1.0]))], "query_id STRING, sparse STRUCT<indices: ARRAY<INT>, values: ARRAY<DOUBLE>>")
        whole = documents.withColumn("source_document_id", F.lit(None).cast("string"))
        assert [r.id for r in sparse.sparse_retrieve(asked, entries, whole).orderBy("rank").collect()] == ["a", "y"]

    check()
    with pytest.raises(ValueError, match="already"):
        indexes.write_sparse_index(batch("b"), path, append=True)
    with pytest.raises(Exception, match="invalid sparse"):
        indexes.write_sparse_index(batch("w").withColumn("sparse", F.struct(F.array(F.lit(1)).alias("indices"), F.array(F.lit(0.0)).alias("values"))), path, append=True)
    with monkeypatch.context() as m:
        m.setattr(session, "_rename", lambda fs, a, b: False)
        with pytest.raises(OSError):
            indexes.write_sparse_index(batch("w"), path, append=True)
    check()
    indexes.merge_segments(spark, path)
    check()
    assert len(list((tmp_path / "sparse").glob("segment-*"))) == 1
    with pytest.raises(Exception, match="beyond"):
        indexes.write_sparse_index(batch("k"), f"file://{tmp_path}/narrow", dimension=5)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["sparse"]


def test_search_engine_gets_bulks(spark, tmp_path):
    class Client:
        def bulk(self, index, documents, refresh):
            assert len(documents) <= 3
            (tmp_path / f"{index}-{documents[0][0]}.json").write_text(json.dumps(documents))

    df = spark.createDataFrame([(f"n{i:02}", f"text {i}", '{"k":[1]}' if i % 2 else None) for i in range(20)], "id STRING, content STRING, meta STRING")
    indexes.write_to_search_engine(df, Client, "idx", batch=3)
    sent = dict(x for p in tmp_path.glob("idx-*.json") for x in json.loads(p.read_text()))
    assert sent == {f"n{i:02}": {"content": f"text {i}", "meta": {"k": [1]} if i % 2 else {}} for i in range(20)}


def test_predictions(spark, tmp_path):
    ranked = spark.createDataFrame([("q", 2, "b", None, None, None), ("q", 1, "a::0", "a", 0.5, '{"_extra_data":{"x":1}}')], "query_id STRING, rank INT, id STRING, source_document_id STRING, score DOUBLE, meta STRING")
    rows = preds.project_results(ranked)
    assert {r.id: (r.document_id, r.data) for r in rows.collect()} == {"a::0": ("a", '{"x":1}'), "b": ("b", None)}
    asked = spark.createDataFrame([("q",), ("none",)], "id STRING")
    preds.write_predictions(rows, str(tmp_path / "p"), asked)
    back = preds.read_predictions(spark, str(tmp_path / "p"))
    assert {r.query_id: r.results for r in back.collect()}["none"] == "[]"
    assert [(r.rank, r.id) for r in preds.flatten(back).orderBy("rank").collect()] == [(1, "a::0"), (2, "b")]
    with pytest.raises(Exception, match="empty source"):
        preds.project_results(ranked.withColumn("source_document_id", F.lit(""))).collect()
    with pytest.raises(Exception, match="no query id"):
        preds.nest(rows.withColumn("query_id", F.lit(""))).collect()


def corpus(spark):
    trees = "oak elm fir yew ash pine lime box may bay".split()
    docs = spark.createDataFrame([(f"p{i}#{c}", f"p{i}", f"{t} {t} leaf part{c}", "{}") for i, t in enumerate(trees) for c in range(2)], "id STRING, source_document_id STRING, content STRING, meta STRING")
    asked = spark.createDataFrame([(f"q{i}", f"{t} leaf", f"need{i}") for i, t in enumerate(trees) if i % 3 == 0], "id STRING, content STRING, IN STRING")
    judged = spark.createDataFrame([(f"need{i}", f"p{i}", 1) for i in range(0, 10, 3)], "IN STRING, document_id STRING, label INT")
    return docs, asked, judged


def test_stages_over_all_kinds_of_indexes(spark, tmp_path):
    docs, asked, judged = corpus(spark)
    root = f"file://{tmp_path}"
    embed = lambda role: lambda df: models.embed(df, lambda: models.HashEncoder(2048), role)
    thin = lambda df: df.withColumn("sparse", sparse.dense_to_sparse(F.transform("embedding", lambda x: F.abs(x)))).drop("embedding")
    numbered = docs.withColumn("pos", F.substring_index(F.substring_index("id", "#", 1), "p", -1).cast("int"))
    assert stages.build_index(spark, docs, f"{root}/dense", [embed("document")]) == 20
    assert stages.build_index(spark, numbered, f"{root}/sparse", [embed("document"), thin], "sparse") == 20
    assert stages.build_index(spark, docs, f"{root}/text", [], "text") == 20
    for bad in (lambda: stages.build_index(spark, None, f"{root}/x", []), lambda: stages.build_index(spark, docs, f"{root}/x", [], "other"), lambda: stages.build_index(spark, docs.union(docs), f"{root}/x", [], "text")):
        with pytest.raises(ValueError):
            bad()
    sources = [
        stages.Source("d", "dense", f"{root}/dense", 8, 1.0, (embed("query"),)),
        stages.Source("s", "sparse", f"{root}/sparse", 8, 0.5, (embed("query"), thin)),
        stages.Source("l", "lexical", f"{root}/text", 8, 2.0),
    ]
    perfect = {"Recall@1": 1.0, "MRR@3": 1.0}
    best_of_document = lambda df: cascade.chunk_cascade(df, 1)
    for n, chosen in enumerate(([sources[0]], [sources[1]], [sources[2]], sources)):
        found = stages.infer(spark, asked, chosen, k=3, steps=[best_of_document])
        assert found.groupBy("query_id").count().where("count <> 3").count() == 0 and found.groupBy("query_id", "document_id").count().where("count > 1").count() == 0
        assert stages.evaluate(spark, f"{root}/runs", f"run-{n}", found, asked, judged, list(perfect), {"text": f"{root}/text/index.json", "dense": f"{root}/dense"}) == perfect
    listed = spark.createDataFrame([("need0", 0, "p1"), ("need0", 1, "p0"), ("need3", 0, "p0")], "IN STRING, pos INT, document_id STRING")
    for source in sources:
        rows = stages.infer(spark, asked, [source], listed, k=9).collect()
        assert {r.query_id: set() for r in rows} == {"q0": set(), "q3": set()} and {r.document_id for r in rows if r.query_id == "q0"} == {"p0", "p1"} and {r.document_id for r in rows if r.query_id == "q3"} == {"p0"}
    for bad in ([], [sources[0], sources[0]], [stages.Source("x", "dense", f"{root}/dense")], [stages.Source("x", "odd", f"{root}/dense")]):
        with pytest.raises(ValueError):
            stages.infer(spark, asked, bad)
    with pytest.raises(ValueError):
        stages.infer(spark, asked, sources, fuse="other")
    assert artifacts.discover(spark, f"{root}/runs", stage="evaluation") == [f"run-{n}" for n in range(4)]
    about = artifacts.Run(spark, f"{root}/runs", "run-0").about()
    assert about["from"]["text"]["sha256"] and about["from"]["dense"]["sha256"] is None and about["code"]["pyspark"]
    assert json.loads(session.read_text(spark, artifacts.Run(spark, f"{root}/runs", "run-3").artifact("metrics"))) == perfect
    with pytest.raises(KeyError):
        artifacts.Run(spark, f"{root}/runs", "run-3").artifact("model")
    with pytest.raises(FileExistsError):
        stages.evaluate(spark, f"{root}/runs", "run-1", found, asked, judged, ["Recall@1"])
    artifacts.Run(spark, f"{root}/runs", "died").begin({})
    (tmp_path / "runs" / "run-2" / "run.json").write_text("{")
    assert artifacts.discover(spark, f"{root}/runs") == ["run-0", "run-1", "run-3"] and artifacts.discover(spark, f"{root}/nothing") == []
    with pytest.raises(FileNotFoundError):
        artifacts.Run(spark, f"{root}/runs", "died").artifact("metrics")
    where = stages.prepare_mapping(spark, f"{root}/maps", "m1", numbered, asked.withColumn("pos", F.lit(0)), judged.withColumn("document_id", F.concat("document_id", F.lit("#0"))), recipe(include_annotated_docs=True))
    assert indexes.read_mapping(spark, where)[1]["query_count"] == 4


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from quarrylight.plans import cli

    docs, asked, judged = corpus(spark)
    for name, df in (("documents", docs), ("queries", asked), ("qrels", judged)):
        df.write.parquet(str(tmp_path / name))
    monkeypatch.setattr("quarrylight.session.build_session", lambda *a, **k: spark)
    tables = "".join(f"  {n}: {tmp_path}/{n}\n" for n in ("documents", "queries", "qrels"))
    (tmp_path / "base.yaml").write_text(f"tables:\n{tables}logging: {{level: WARNING}}\n")
    (tmp_path / "index.yaml").write_text(f"options: {{path: 'file://{tmp_path}/dense', kind: dense, encoder: '???'}}\n")
    (tmp_path / "infer.yaml").write_text(f"options:\n  output: {tmp_path}/found\n  k: 2\n  sources:\n  - {{name: d, kind: dense, index: 'file://{tmp_path}/dense', encoder: 'quarrylight.operators.models:HashEncoder'}}\n")
    base = str(tmp_path / "base.yaml")
    call = lambda stage, file, *more: cli.main(["stage", stage, "--config", base, "--config", str(tmp_path / file), *more])
    assert call("indexing", "index.yaml") == 1  # an encoder has to be named
    assert call("indexing", "index.yaml", "options.encoder=quarrylight.operators.models:Missing") == 1
    assert call("indexing", "index.yaml", "options.encoder=quarrylight.operators.models:HashEncoder") == 0
    with pytest.raises(SystemExit):
        call("inference", "infer.yaml", "--strange")
    assert call("inference", "infer.yaml") == 0 and spark.read.parquet(str(tmp_path / "found")).count() == 8
    (tmp_path / "judge.yaml").write_text(f"tables: {{predictions: {tmp_path}/found}}\noptions: {{root: 'file://{tmp_path}/runs', run: r1, metrics: [Recall@2]}}\n")
    assert call("evaluation", "judge.yaml") == 0
    value = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["Recall@2"]
    assert 0.5 <= value <= 1


def test_names_graphs_and_configs(tmp_path):
    for bad in ("", "..", ".", "a/b", "a:b", None, "x?", " ", "a|b", 'q"'):
        with pytest.raises(ValueError):
            artifacts.valid_name(bad)
    assert artifacts.valid_name(" .a.b ") == ".a.b" and artifacts.slugify("--Über 7 (b)--") == "ber-7-b" and artifacts.slugify("//") == "run"
    registry = graph.Registry({"twice": lambda x: x * 2})
    registry = registry.layer()
    registry.add("plus", lambda a, b=1: {"sum": a + b})
    p = graph.Pipeline.from_config({"components": {"t": {"operator": "twice"}, "p": {"operator": "plus", "options": {"b": 5}}}, "connections": [{"from": "t.out", "to": "p.a"}]}, registry)
    assert p.run({"t": {"x": 4}})["p"]["sum"] == 13 and p.order() == ["t", "p"] and "t -->|a| p" in p.diagram()
    with pytest.raises(ValueError):
        p.connect("p.sum", "nowhere.x")
    with pytest.raises(ValueError):
        p.connect("p.sum", "t.unknown")
    with pytest.raises(KeyError):
        registry.find("missing")
    assert registry.find("math:sqrt")(9) == 3
    made = config.resolve(config.override(config.merge({"a": {"b": 1, "c": "${a.b}"}}, {"a": {"d": "x-${a.b}"}}), ["a.b=2"]))
    assert made == {"a": {"b": 2, "c": 2, "d": "x-2"}}
    for bad in ({"a": "???"}, {"a": "${b}", "b": "${a}"}):
        with pytest.raises(ValueError):
            config.resolve(bad)


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id":"1","title":" T ","text":"body","metadata":{"y":1}}\n{"_id":"2","title":"","text":" x "}\n{"_id":"3","text":"z"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id":"q1","text":"one"}\n{"_id":"q2","text":"two"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\t1\t1\n\nq1\t3\t0\n")
    got = {r.id: r.content for r in benchmark.benchmark_documents(spark, str(tmp_path / "corpus.jsonl"), "toy").collect()}
    assert got == {"1": "T\nbody", "2": "x", "3": "z"}
    assert [(r.IN, r.document_id, r.label, r.pos) for r in benchmark.benchmark_qrels(spark, str(tmp_path / "qrels" / "test.tsv")).orderBy("pos").collect()] == [("q1", "1", 1, 0), ("q1", "3", 0, 1)]
    assert benchmark.prepare_benchmark(spark, str(tmp_path), f"{tmp_path}/out", "toy") == {"documents": 3, "queries": 1, "qrels": 2}
    (tmp_path / "trec.tsv").write_text("q9\t0\td7\t2\n")
    row = benchmark.benchmark_qrels(spark, str(tmp_path / "trec.tsv")).first()
    assert (row.IN, row.document_id, row.label) == ("q9", "d7", 2)


def test_fetched_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.writestr("inner/corpus.jsonl", '{"_id":"1","text":"a"}\n')
    url = f"file://{tmp_path}/set.zip"
    path = benchmark.fetch(f"{url}", tmp_path / "cache")
    root = benchmark.extract(path, tmp_path / "raw")
    assert [r.content for r in benchmark.benchmark_documents(spark, f"{root}/corpus.jsonl", "d").collect()] == ["a"]
    (tmp_path / "set.zip").write_bytes(b"other")
    assert benchmark.fetch(url, tmp_path / "cache").read_bytes() != b"other" and benchmark.fetch(url, tmp_path / "cache", force=True).read_bytes() == b"other"
    with pytest.raises(OSError):
        benchmark.fetch(f"file://{tmp_path}/none.zip", tmp_path / "cache")
    assert [p.name for p in (tmp_path / "cache").iterdir()] == ["set.zip"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../corpus.jsonl", "x")
    with pytest.raises(ValueError, match="outside"):
        benchmark.extract(tmp_path / "bad.zip", tmp_path / "raw2")


def test_boundaries_of_graphs(spark):
    from quarrylight.schemas import DOCUMENT

    df = spark.range(3)
    assert graph.boundary(spark, df, DOCUMENT) is df
    empty = graph.boundary(spark, None, DOCUMENT)
    assert empty.count() == 0 and empty.schema == DOCUMENT


def test_stream_of_documents(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    schema = "id STRING, content STRING"
    spark.createDataFrame([("a", "1"), ("b", "2")], schema).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    indexing.index_stream(stream(), out, str(tmp_path / "c"), []).awaitTermination()
    spark.createDataFrame([("c", "3"), ("a", "9")], schema).write.mode("append").parquet(str(source))
    indexing.index_stream(stream(), out, str(tmp_path / "c"), [], on_duplicate="skip").awaitTermination()
    assert sorted((r.id, r.content) for r in spark.read.parquet(out).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    spark.createDataFrame([("b", "x")], schema).write.mode("append").parquet(str(source))
    with pytest.raises(Exception, match="already"):
        indexing.index_stream(stream(), out, str(tmp_path / "c"), []).awaitTermination()
