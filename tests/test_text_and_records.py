from __future__ import annotations

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from quarrylight import schemas
from quarrylight.functions.text import java_pattern, strip, word_count
from quarrylight.operators import chunking, enrich, reformulate, text
from quarrylight.sources import records


def by_hand(text, replace, strip, lower, prefix, suffix):
    """The order of the transforms: replacements one by one, ends, letter case, then what is put around."""
    for pattern, new in replace.items():
        text = re.sub(pattern, new, text)
    text = text.strip() if strip else text
    return prefix + (text.lower() if lower else text) + suffix


@pytest.mark.parametrize("replace", [{}, {r"[aeiou]+": "*", r"\*": "+"}, {r"(\d)(\d)": r"\2-\1"}, {r"^\s*Z": "  y "}])
@pytest.mark.parametrize("strip", [True, False])
@pytest.mark.parametrize("lower", [True, False])
def test_transforms_come_in_their_order(spark, replace, strip, lower):
    texts = ["\tZoo 4711 \u2003", "", "ÄÖ  aeiou\n", "Zz 12 21", "$1 \\ cost"]
    df = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts)], "id STRING, content STRING, extra INT")
    got = text.preprocess(df, prefix=" >A ", suffix=" B< ", strip_ends=strip, lowercase=lower, replace=replace).orderBy("extra").collect()
    assert [r.content for r in got] == [by_hand(t, replace, strip, lower, " >A ", " B< ") for t in texts] and [r.extra for r in got] == list(range(5))


def test_queries_without_content(spark):
    df = spark.createDataFrame([("left", None), ("right", "x")], "id STRING, content STRING")
    with pytest.raises(Exception, match="null content of left"):
        text.preprocess(df, prefix="p").collect()
    kept = text.preprocess(df, nulls="keep", prefix="p").orderBy("id").collect()
    assert [r.content for r in kept] == [None, "px"]
    assert text.repeat_query(df.where("id = 'right'")).first().content == "x x"
    assert text.query_text(df.where("id = 'right'")).collect()[0].asDict() == {"text": "x"} and text.identity_parse(df.where("id = 'right'")).first().content == "x"


def test_unicode_rules(spark):
    df = spark.createDataFrame([("　 über_1 Дом-2 ",)], "t STRING")
    got = df.select(strip(F.col("t")).alias("s"), word_count(F.col("t")).alias("n")).first()
    assert got.s == "über_1 Дом-2" and got.n == 3
    assert java_pattern(r"[\s,]\w\\s") .endswith(r"\\s")


def test_filter_takes_what_every_rule_takes(spark):
    texts = ["ice", "ice and snow", "snow, snow: snow; snow", "Eis_1 schnee-2", "", "the ice\nthe end of it", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n INT, content STRING")
    rules = [
        {"min_words": 3}, {"max_words": 3}, {"min_words": 3, "max_words": 4}, {"include_regex": "^the|snow$"}, {"exclude_regex": "ice|schnee"},
        {"include_regex": "SNOW", "flags": "i", "exclude_regex": ";"}, {"include_regex": "", "exclude_regex": ""}, {"include_regex": "^the end", "flags": "m"},
    ]
    for rule in rules:
        flags = {"i": re.I, "m": re.M}.get(rule.get("flags", ""), 0)

        def fits(t):
            n = len(re.findall(r"\b\w+\b", t))
            include, exclude = rule.get("include_regex"), rule.get("exclude_regex")  # noqa: B023
            inside = rule.get("min_words", 0) <= n <= rule.get("max_words", 99)  # noqa: B023
            return inside and (not include or bool(re.search(include, t, flags))) and not (exclude and re.search(exclude, t, flags))  # noqa: B023

        wanted = [i for i, t in enumerate(texts) if t is not None and fits(t)]
        kept, rejected = text.filter_by_content(df, nulls="reject", **rule)
        assert sorted(r.n for r in kept.collect()) == wanted and sorted(r.n for r in rejected.collect()) == [i for i in range(7) if i not in wanted]
    with pytest.raises(Exception, match="null content"):
        text.filter_by_content(df)[1].collect()


def test_enrichment(spark):
    df = spark.createDataFrame([("d::chunk-0", "d", '{"a": {"b": [1]}}'), ("e", None, None)], "id STRING, source_document_id STRING, meta STRING")
    m = spark.createDataFrame([("d", '{"c": "x"}'), ("e", "{}")], "id STRING, meta STRING")
    got = {r.id: json.loads(r.meta) for r in enrich.enrich(df, m, enrich.document_key()).collect()}
    assert got == {"d::chunk-0": {"a": {"b": [1]}, "c": "x"}, "e": {}}
    with pytest.raises(Exception, match="exist already: a"):
        enrich.enrich(df, spark.createDataFrame([("d", '{"a": 1}'), ("e", "{}")], m.schema), enrich.document_key()).collect()
    with pytest.raises(Exception, match="no metadata for e"):
        enrich.enrich(df, m.limit(1), enrich.document_key()).collect()
    assert enrich.enrich(df, m.limit(1), enrich.document_key(), on_missing="keep").count() == 2
    with pytest.raises(ValueError):
        enrich.enrich(df, m.union(m))
    with pytest.raises(Exception, match="empty source"):
        enrich.enrich(df.withColumn("source_document_id", F.lit("")), m, enrich.document_key()).collect()


def test_chunks(spark):
    long = "One two three.\n\n" + "word " * 40 + "\n\n" + "x" * 120
    assert all(len(c) <= 50 for c in chunking.split_recursively(long, 50, 10)) and chunking.split_recursively("  \n ", 5, 0) == []
    joined = "".join(chunking.split_recursively("a" * 95, 20, 0))
    assert joined == "a" * 95
    overlapping = chunking.split_recursively("aa bb cc dd ee ff", 8, 3)
    assert all(a.split()[-1] == b.split()[0] for a, b in zip(overlapping, overlapping[1:]))
    rows = [("d", long, "m", 0.5, [1.0], "q"), ("e", " \n", "m", None, None, "q"), ("f", "", "m", None, None, "q")]
    df = spark.createDataFrame(rows, "id STRING, content STRING, meta STRING, score DOUBLE, embedding ARRAY<DOUBLE>, chunk_index STRING")
    got = chunking.chunk_documents(df, 50, 10).orderBy("chunk_index").collect()
    assert {r.source_document_id for r in got} == {"d"} and [r.id for r in got] == [f"d::chunk-{i}" for i in range(len(got))]
    assert "embedding" not in got[0].asDict() and {r.chunk_count for r in got} == {len(got)} and got[0].score == 0.5
    tokens = chunking.chunk_documents(df.limit(1), 20, 5, "/opt/tokenizers/byte_bpe_50k.json").collect()
    assert len(tokens) > 3
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, 10, 11)


def test_reformulation(spark):
    df = spark.createDataFrame([("1", "sun"), ("2", "moon"), ("3", "mute")], "id STRING, content STRING")
    call = lambda p: {"answer": [{"texts": [] if p["ask"] == "mute" else [p["ask"] + p["mark"], p["ask"].upper()]}]}
    got = sorted((r.id, r.variant, r.content) for r in reformulate.reformulate(df, call, "ask", "answer.0.texts", {"mark": "?"}).collect())
    assert got == [("1", 0, "sun?"), ("1", 1, "SUN"), ("2", 0, "moon?"), ("2", 1, "MOON"), ("3", -1, "mute")]
    with pytest.raises(TypeError):
        reformulate.walk({"answer": "x"}, "answer.texts")
    single = reformulate.reformulate(df.limit(1), lambda p: {"r": 7}, "ask", "r").first()
    assert (single.variant, single.content) == (0, "7")


@pytest.mark.parametrize("kind, line, problem", [
    ("query", '{"id":"q","content":"c","IN":"n","meta":{}}', None),
    ("query", '{"id":"q","content":"c","IN":"n","meta":{},"more":1}', "unexpected field"),
    ("query", '{"id":"q","content":null,"IN":"n","meta":{}}', "content is no string"),
    ("query", '{"id":"","content":"c","IN":"n","meta":{}}', "id is empty"),
    ("query", '{"id":"q","content":"c","IN":"n","meta":[]}', "meta is no object"),
    ("document", '{"id":"d","content":"c","meta":{"a":{"b":1}},"score":1}', None),
    ("document", '{"content":"c","meta":{}}', "missing id"),
    ("qrel", '{"IN":"n","document_id":"d","label":2}', None),
    ("qrel", '{"IN":"n","document_id":"d","label":true}', "label is no integer"),
    ("qrel", '{"IN":"n","document_id":"d","label":"1"}', "label is no integer"),
    ("qrel", '{"IN":7,"document_id":"d","label":1}', "IN is no string"),
    ("qrel", "[1]", "not an object"),
])
def test_strict_records(spark, tmp_path, kind, line, problem):
    got = spark.createDataFrame([(line,)], "v STRING").select(schemas.record_problem(F.col("v"), kind).alias("p")).first().p
    assert got == problem
    path = tmp_path / "x.jsonl"
    path.write_text(f"\n  \n{line}\n", encoding="utf-8")
    if problem is None:
        assert records.read_records(spark, str(path), kind).count() == 1
    else:
        with pytest.raises(Exception, match=problem):
            records.read_records(spark, str(path), kind).collect()


def test_files(spark, tmp_path):
    path = tmp_path / "docs.jsonl"
    body = "".join(json.dumps({"id": f"d{i}", "content": f"té {i}", "meta": {}}, ensure_ascii=False) + "\n" + "\n" * (i % 2) for i in range(5))
    path.write_text(body, encoding="utf-8")
    plan = records.batch_plan(spark, str(path), 2)
    assert plan == {"document_count": 5, "batch_count": 3, "sha256": hashlib.sha256(body.encode()).hexdigest()} and records.count_lines(spark, str(path)) == 5
    assert plan["sha256"] == records.path_sha256(spark, f"file://{path}") and records.path_sha256(spark, str(path)) == plan["sha256"]
    path.write_text(body + body, encoding="utf-8")
    with pytest.raises(ValueError, match="more than once"):
        records.batch_plan(spark, str(path), 2)
    records.write_jsonl(spark.createDataFrame([("é", None)], "a STRING, b INT"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":"é","b":null}'
    assert records.to_jsonable({1: {"b", "a"}, "p": (tmp_path,)}) == {"1": ["a", "b"], "p": [str(tmp_path)]}
    written = records.write_json(spark, f"file://{tmp_path}/a/x.json", {"k": "é", 2: {"z"}})
    assert (tmp_path / "a" / "x.json").read_text(encoding="utf-8") == '{\n  "k": "é",\n  "2": [\n    "z"\n  ]\n}\n' and records.read_json(spark, written) == {"k": "é", "2": ["z"]}
    with pytest.raises(TypeError):
        records.write_json(spark, f"file://{tmp_path}/a/y.json", object())
    with pytest.raises(FileNotFoundError):
        records.read_json(spark, f"file://{tmp_path}/a/y.json")
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.endswith(".crc")] == ["x.json"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-1").write_bytes(b"2")
    (tmp_path / "b" / "part-0").write_bytes(b"1")
    assert records.path_sha256(spark, str(tmp_path / "b")) == hashlib.sha256(b"12").hexdigest()
    (tmp_path / "l.yaml").write_text("- 1\n")
    assert records.read_yaml_mapping(tmp_path / "l.yaml") == {}


def test_lines_have_numbers(spark, tmp_path):
    path = tmp_path / "docs.jsonl"
    good = '{"id":"d%d","content":"c","meta":{}}'
    lines = [good % 1, "", "  ", good % 2, "[3]", good % 4, '{"id":"d5","meta":{}}', good % 6]
    path.write_text("\n".join(lines) + "\n")
    got = [(r.line_no, r.problem) for r in records.record_problems(spark, str(path), "document").orderBy("line_no").collect()]
    assert got == [(5, "not an object"), (7, "missing content")]
    with pytest.raises(ValueError, match="line 5 of"):
        records.batch_plan(spark, str(path), 3)
    many = tmp_path / "many.txt"
    many.write_text("".join(f"row {i} {'x' * (i % 90)}\n" for i in range(1, 5001)))
    parts = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        numbered = records.numbered_lines(spark, str(many))
        assert numbered.rdd.getNumPartitions() > 3 and all(r.value.split()[1] == str(r.line_no) for r in numbered.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", parts)
    path.write_text('{"id":"a","meta":{}}\n\n{"id":"b","meta":2}\n{"id":"a","meta":{"x":1}}\n{"id":"","meta":{}}\n')
    assert sorted(map(tuple, records.mapping_problems(spark, str(path)).collect())) == [(3, "meta is no object"), (4, "repeated id"), (5, "empty id")]


def test_metadata_mapping(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"id":"a","meta":{"n":{"x":[1]}}}\n\n{"meta":{},"id":"b"}\n')
    got = {r.id: json.loads(r.meta) for r in records.read_metadata_mapping(spark, str(path)).collect()}
    assert got == {"a": {"n": {"x": [1]}}, "b": {}}
    for bad in ("{", "[]", '{"id":"","meta":{}}', '{"id":"a","meta":1}', '{"id":"a","meta":{},"z":1}', '{"id":"a","meta":{}}\n{"id":"a","meta":{}}', '{"id":1,"meta":{}}'):
        path.write_text(bad + "\n")
        with pytest.raises(Exception):
            records.read_metadata_mapping(spark, str(path)).collect()
