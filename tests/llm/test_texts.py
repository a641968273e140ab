from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from compare import DATA
from pyspark.sql import functions as F

from quarrylight.llm import near_duplicates as nd, pieces, sentences
from quarrylight.llm.transducer import Transducer


@given(st.lists(st.lists(st.integers(0, 9), max_size=70), max_size=8))
@settings(max_examples=150, deadline=None)
def test_stretches_compose_to_the_whole(stretches):
    rules: Transducer = sentences.RULES
    whole = [x for stretch in stretches for x in stretch]
    begins = np.cumsum([0, *map(len, stretches)])
    found = [int(begins[k] + i) for k, part in enumerate(rules.run_stretches(stretches)) for i in part]
    assert found == rules.run(whole, rules.start)[0]
    if whole:
        ends = [s for s in range(len(rules.step)) if rules.run(whole, s)[1] != rules.function(np.array(whole))[s]]
        assert ends == []


BITS = ["Dr. ", "word ", "Word ", "\n", "\n\n", "“", "”", "(", ")", "! ", "? ", ". ", "...", "。", "「", "」", "5. ", "- ", "z. B. ", "etc. ", '"', "«", "»", " p.m. ", "3.", "`a. b`", "α;", "ก ข", "a.b", "Aa.Bb", "\r\n", " \n"]


@given(st.lists(st.sampled_from(BITS), min_size=1, max_size=120), st.integers(1, 60), st.booleans())
@settings(max_examples=300, deadline=None)
def test_chunks_of_characters_change_nothing(bits, chunk, fields):
    text = "".join(bits)
    whole = sentences.units(text, fields)
    assert sentences.units(text, fields, chunk=chunk) == whole
    parts = list(sentences._rows(text, chunk))
    assert "".join(t for _, t in parts) == text
    assert [(s + o, e + o) for o, t in parts for s, e in sentences.units(t, fields)] == whole


GENERAL = [  # sentences of no table: titles, ranks, places, degrees, initials, units, numbers
    ["Gen. Smith met Col. Brown and Sen. White in Wash. on Jan. 5.", "They left."],
    ["Mt. Everest is high.", "Ft. Worth is hot."],
    ["El Ing. Pérez no."],
    ["He met Lt. Gen. Park.", "They spoke."],
    ["She has a Ph.D. from M.I.T. and works at Acme Inc. in N.Y.", "He doesn't."],
    ["The U.S. Army came.", "It left."],
    ["Das Werk (vgl. Bd. 3, S. 12 ff.) ist gut.", "Am 3. Okt. kam er.", "Evtl. später."],
    ["Le Dr. Martin et Mme. Petit sont là.", "Ils partent."],
    ["В 1999 г. он уехал.", "Ул. Ленина, д. 5, кв. 7.", "Всё."],
    ["Vol. IV is out.", "See no. 5.", "No.", "I said so."],
    ["It cost $3.50.", "Really?", "Yes!"],
    ["Use Node.js today.", "The file main.py is big."],
    ["J. R. R. Tolkien wrote it.", "It was long."],
]


@pytest.mark.parametrize("wanted", GENERAL)
def test_sentences_in_general(wanted):
    text = " ".join(wanted)
    assert [text[a:b] for a, b in sentences.units(text)] == wanted


@pytest.mark.parametrize("n", [20, 60, 2000])
def test_long_quotations_stay_whole(n):
    text = "He said: “" + "It is a nice day for all of us. " * n + "” and left. Then rain."
    got = [text[a:b] for a, b in sentences.units(text)]
    assert len(got) == 2 and got[1] == "Then rain."


def test_compiled_rules_are_the_rules():
    from itertools import product

    from quarrylight.llm import boundaries as b

    for kinds in list(product(*map(range, b._SIZES)))[::37]:
        assert b.look_up(*kinds) == b._rule(*kinds[:6], bool(kinds[6]))


UNITS = {
    "en": ['Dr. Bo and Prof. Li kept it, e.g. by 1.5 rows.', 'He wrote "it broke!" and left.', "Version 2.7.6 of a.log ended at 2:42 p.m.", "See J. Q. Li et al. for more...", "Done?!", "It waited ... and went on."],
    "de": ["Am 27. März kam z. B. Bo.", "„Sie ist klein!“, schrieb das Team.", "Der Wert stieg auf 0,5, d. h. um ca. 11-mal.", "Bei Bo usw. fehlte es."],
    "fr": ["L'art. 8 et M. Bo passent, etc., et c'est tout.", "Pourquoi confirme-t-il ?", "« Elle est vide ! », note Bo."],
    "es": ["¿Por qué cae?", "«La memoria es frágil», anota la Dra. Bo.", "Según la fig. 20, cae."],
    "ru": ["«Память сгладила Bo!» — отметили в Li.", "См. рис. 10, где т. е. всё.", "Это и т. д. не менялось."],
    "el": ["Γιατί αλλάζει;", "Η τιμή πήγε, π.χ. όταν μειώνει."],
    "hi": ["डॉ. Bo ने बनाया।", "क्यों?"],
    "ar": ["قال د. Bo إن الفهرس!", "لماذا حذف؟", "من 0.5 إلى 0.6."],
}


@pytest.mark.parametrize("lang", UNITS)
@pytest.mark.parametrize("gap", [" ", "  ", "\n\n"])
def test_units_by_language(lang, gap):
    text = gap.join(UNITS[lang])
    assert [text[a:b] for a, b in sentences.units(text)] == UNITS[lang]


def test_units_without_spaces_and_other_rules():
    def cut(t, fields=False):
        return [t[a:b] for a, b in sentences.units(t, fields)]

    assert cut("召回率从0.1升到0.2。审阅者说：“坏了！”随后关闭。好！") == ["召回率从0.1升到0.2。", "审阅者说：“坏了！”随后关闭。", "好！"]
    assert cut("担当者は「消した。」と書いた。次。") == ["担当者は「消した。」と書いた。", "次。"]
    assert cut("ค่าเพิ่มจาก0.5เป็น0.6 ทำไมBoจึงลบ Boลบ") == ["ค่าเพิ่มจาก0.5เป็น0.6 ทำไมBoจึงลบ", "Boลบ"]
    assert cut("Sampler 40: บันทึก") == ["Sampler 40: บันทึก"]
    assert cut("A heading\r\n\r\n- one\r\n- two. Three\r\nfour.\r\n") == ["A heading", "- one", "- two.", "Three\r\nfour."]
    assert cut("the need (see eq. 25.) came back.the queue drained. it did!") == ["the need (see eq. 25.) came back.", "the queue drained.", "it did!"]
    assert cut("see kestbalor.log for it.dunbapryn kept a.b.") == ["see kestbalor.log for it.dunbapryn kept a.b."]
    assert cut("see kestbalor.log unchanged.dunbapryn kept it.") == ["see kestbalor.log unchanged.", "dunbapryn kept it."]
    assert cut("the need (see eq. 25.) came back.the queue drained. it did!") == ["the need (see eq. 25.) came back.", "the queue drained.", "it did!"]
    assert cut("a: 1\nb: 2", True) == ["a: 1", "b: 2"]
    assert cut("The team behind Bo! padded it. It held.The rest too.") == ["The team behind Bo! padded it.", "It held.", "The rest too."]
    assert cut("It fell (see Eq. 25.) Bo kept it. (All of it.) Then it rose.") == ["It fell (see Eq. 25.) Bo kept it.", "(All of it.)", "Then it rose."]
    assert cut("Γιατί η κρυφή στάθμη κλειδώνει το Filter; Η τιμή;") == ["Γιατί η κρυφή στάθμη κλειδώνει το Filter;", "Η τιμή;"]
    assert cut("a; b.") == ["a; b."]
    assert cut("Im 2. Lauf und am 3. Mai fiel es. Es stieg auf 12. Dann nicht.") == ["Im 2. Lauf und am 3. Mai fiel es.", "Es stieg auf 12.", "Dann nicht."]
    assert cut("it ended at 2:42 p.m. see a.log. bo kept them, etc. were lost. li et al. padded it…the rest fell.")[:2] == ["it ended at 2:42 p.m.", "see a.log."]
    assert cut(" \n \t") == [] and cut("") == [] and sentences.units(None) == []
    long = "One two. " * 30_000
    assert len(cut(long)) == 30_000


def test_sentence_rows(spark):
    rows = [(1, " Abc.  Cde. ", "prose", 0), (2, None, "prose", 0), (3, "", None, 0), (4, "x: 1\ny: 2", "fields", 0), (4, "x: 1\ny: 2", "fields", 0), (5, "zz.", None, 0)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, form STRING, start_pos INT")
    got = sorted((r.doc_id, r.start_pos, r.end_pos) for r in sentences.sentence_units(df).collect())
    assert got == [(1, 1, 5), (1, 7, 11), (4, 0, 4), (4, 0, 4), (4, 5, 9), (4, 5, 9), (5, 0, 3)]
    assert sentences.sentence_units(df.limit(0)).count() == 0
    long = "One two. “Three. Four.” five.\n \n" * 400 + "Ab cd. Ef gh! " * 3000
    many = spark.createDataFrame([(7, long, None, 0), (8, "Ab. Cd.", None, 0)], df.schema)
    got = sorted((r.doc_id, r.start_pos, r.end_pos) for r in sentences.sentence_units(many, row_chars=500).collect())
    assert got == [(7, a, b) for a, b in sentences.units(long)] + [(8, 0, 3), (8, 4, 7)] and len(got) > 4096


@given(st.text(alphabet="ab .\n#-。", max_size=600), st.integers(20, 80), st.integers(0, 19))
@settings(max_examples=300, deadline=None)
def test_pieces_cover_and_overlap(text, limit, overlap):
    got = pieces.split_text(text, limit, overlap)
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e, _ in got)
    for (_, e, kind), (s2, e2, _) in zip(got, got[1:]):
        assert s2 == e - overlap and e2 > e
        assert kind in ("hard", *pieces.COARSE, *(name for name, _ in pieces.FINE))


def test_pieces_keep_structure(spark):
    text = "# One\n" + "First part. " * 5 + "\n\n# Two\n" + "Second part. " * 5
    got = pieces.split_text(text, 90, 10)
    assert got[0][1] == text.index("# Two") and got[0][2] == "section"
    assert [k for *_, k in pieces.split_text("One two three four. Five six  seven eight. Nine ten.", 30, 0)] == ["sentence", "sentence", "end"]
    assert [k for *_, k in pieces.split_text("one two three four five six seven", 12, 2)][:2] == ["word", "word"]
    rows = [(1, text, 0), (2, None, 0), (3, "", 0), (4, "x" * 300, 0), (5, "short", 0), (1, text, 0)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, content STRING, piece_no INT")
    out = pieces.split_documents(df, "doc_id", "content", 90, 10).collect()
    assert {r.doc_id for r in out} == {1, 4} and all(len(r.piece) <= 90 and r.piece == (text if r.doc_id == 1 else "x" * 300)[r.start_pos : r.end_pos] for r in out)
    assert {r.solid for r in out if r.doc_id == 4} == {300, 0} and {r.boundary for r in out if r.doc_id == 4} == {"hard", "end"}
    assert pieces.split_documents(df.limit(0), "doc_id", "content", 90, 10).count() == 0
    with pytest.raises(ValueError):
        pieces.split_documents(df, "doc_id", "content", 10, 10)


def test_the_tree_of_a_text():
    text = "Start.\n\n# A\nBody of A.\n\n### A.x\n- one\n  - one a\n  - one b\nrest of it\n- two\n\nTitle\n=====\n\nLast.\n"

    def shape(node):
        return (node.kind, text[node.start : node.end].split("\n")[0].strip(), [shape(c) for c in node.children])

    kind, _, parts = shape(pieces.parse(text))
    assert kind == "start" and [p[:2] for p in parts] == [("paragraph", "Start."), ("section", "# A"), ("section", "Title")]
    body, sub = parts[1][2]
    assert body[:2] == ("paragraph", "# A") and sub[:2] == ("section", "### A.x")
    items = sub[2][0][2]
    assert [i[1] for i in items] == ["### A.x", "- two"] and [i[1] for i in items[0][2]] == ["### A.x", "- one a", "- one b"]


def test_sections_stay_apart_and_headings_with_their_text():
    text = "# A\n\nIntro.\n\n## A1\n\n" + "Some words go here. " * 12 + "\n\n## A2\n\nDr. Smith came in. " + "It went on. " * 6 + "\n\n# B\n\n" + "Last text. " * 8
    got = pieces.split_text(text, 200, 0)
    assert all(not text[s:e].strip("\n").endswith(("# A", "## A1", "## A2", "# B")) for s, e, _ in got)
    assert any(s == text.index("# B") for s, _, _ in got)  # a part of A isn't joined with B
    assert all(not text[s:e].rstrip().endswith("Dr.") for s, e, _ in pieces.split_text(text, 40, 5))
    small = "# A\n\n## A1\n\nOne.\n\n## A2\n\nTwo.\n\n# B\n\nThree.\n\n# C\n\n" + "Long text. " * 9
    assert [text_[:3] for text_ in (small[s:e] for s, e, _ in pieces.split_text(small, 60, 0))][0] == "# A" and pieces.split_text(small, 60, 0)[0][1] == small.index("# C")
    deep = "".join(" " * k + "- x\n" for k in range(200))
    assert pieces.split_text(deep, 500, 10)[-1][1] == len(deep)


def test_violations_are_seen(spark):
    text = "One two three. " * 20
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "y" * 100)], "doc_id BIGINT, content STRING")
    made = pieces.split_documents(df, "doc_id", "content", 60, 6)
    count = lambda p: {r.rule: r.n for r in pieces.piece_violations(p, df, "doc_id", "content", 60, 6).collect()}
    assert set(count(made).values()) == {0} and len(count(made)) == 6
    assert count(made.where("doc_id <> 4"))["text without pieces"] == 1
    assert count(made.where("piece_no <> 1"))["wrong overlap"] == 1
    longer = count(made.withColumn("piece", F.concat("piece", F.lit("z" * 60))))
    assert longer["over the limit"] > 0 and longer["other than the text"] > 0
    assert count(made.where("piece_no < n_pieces - 1"))["end not reached"] == 2
    assert count(made.withColumn("end_pos", F.col("end_pos") - 1))["end not reached"] == 2


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(n)]


@pytest.mark.parametrize("heavy", [200_000, 5])
def test_near_duplicates_against_brute_force(spark, heavy):
    rng = random.Random(5)
    base = words(rng, 60)
    rows = []
    for g in range(12):
        own = words(rng, rng.randrange(8, 160)) + base * (g % 3 == 0)
        for _ in range(6):
            w = list(own)
            for _ in range(rng.randrange(0, len(w) // 8 + 1)):
                w[rng.randrange(len(w))] = "".join(rng.choices("xyz", k=5))
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[k:] + w[:k]
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rows += [(2000, rows[0][1].upper() + "!!"), (2001, rows[0][1]), (2002, None), (2003, ""), (2004, "short"), (2005, "exactlytwelv"), (2006, "Exactly Twelv")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id BIGINT, content STRING, id STRING")
    members, links = nd.near_duplicates(spark, df, "doc_id", "content", nd.Setting(block=4, heavy=heavy))
    texts = {k: nd.reduce_text(t) for k, t in rows if t and len(nd.reduce_text(t)) >= 12}
    least: dict = {}
    for k, t in texts.items():
        least[t] = min(least.get(t, k), k)
    assert {r.id: r.class_id for r in members.collect()} == {k: least[t] for k, t in texts.items()}
    reps = sorted(least.items(), key=lambda x: x[1])
    brute = {(a, b) for i, (x, a) in enumerate(reps) for y, b in reps[i + 1 :] if nd.jaccard(x, y, 12) >= 0.6}
    assert len(brute) > 40 and {(r.a, r.b) for r in links.collect()} == brute
    members, links = nd.near_duplicates(spark, df.limit(0), "doc_id", "content")
    assert members.count() == 0 and links.count() == 0


def plain_hashes(text, width):
    """Every run's hash by its definition, character by character."""
    out = []
    for i in range(len(text) - width + 1):
        h = 0
        for c in text[i : i + width]:
            h = (h * int(nd._A) + ord(c)) % 2**64
        for shift, factor in ((30, int(nd._B)), (27, int(nd._C)), (31, 1)):
            h = (h ^ h >> shift) * factor % 2**64
        out.append(h)
    return out


@given(st.text(max_size=70), st.sampled_from([1, 2, 5, 12, 20, 24]))
@settings(max_examples=60, deadline=None)
def test_hashes_by_doubling(text, width):
    assert nd.run_hashes(text, width).tolist() == plain_hashes(text, width)


@given(st.lists(st.text(alphabet="ab√é", max_size=90), max_size=6))
@settings(max_examples=60, deadline=None)
def test_joint_hashing_is_that_of_each_text(texts):
    s = nd.Setting(tiers=((0, 12, 1), (20, 20, 12), (40, 24, 20)))
    joint = nd.Described(texts, s)
    for i, t in enumerate(texts):
        n = len(set(plain_hashes(t, 12)))
        assert joint.n_runs(i) == n
        for tier, found in enumerate(joint.anchors(i, n)):
            least, length, window = s.tiers[tier]
            end = s.tiers[tier + 1][0] if tier < 2 else 10**9
            h = plain_hashes(t, length) if least <= n < end / 0.6 else []
            wanted = {min(h[k : k + window]) for k in range(max(len(h) - window + 1, min(len(h), 1)))}
            assert set(found.tolist()) == {x >> 2 << 2 | tier for x in wanted}


@given(st.text(alphabet="abc", min_size=43, max_size=120), st.text(alphabet="abc", max_size=60))
@settings(max_examples=60, deadline=None)
def test_a_common_stretch_has_a_common_anchor(shared, other):
    for tier in nd.Setting().tiers:
        both = nd.Described([shared, other + shared], nd.Setting(tiers=((0, *tier[1:]),)))
        assert len(np.intersect1d(both.anchors(0, 100)[0], both.anchors(1, 100)[0]))


@given(st.integers(1, 5000), st.floats(0.6, 1.0))
@settings(max_examples=200, deadline=None)
def test_sizes_that_can_be_similar_share_a_tier(n, ratio):
    text = nd.Described(["ab" * 40], nd.Setting())
    both = [[len(x) > 0 for x in text.anchors(0, k)] for k in (int(n), int(n / ratio))]
    assert any(a and b for a, b in zip(*both, strict=True))


def evenly_edited(rng, n_texts=24, length=900):
    """Texts that differ from one base at evenly spaced places, the hardest case for anchors."""
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=length))
    out = []
    for k in range(n_texts):
        t = list(base)
        for at in range(k * 7 % 40, length, 60 + k % 5 * 12):
            t[at] = rng.choice("0123")
        out.append("".join(t))
    return out


def brute_pairs(rows):
    texts = [(k, nd.reduce_text(t)) for k, t in rows if t and len(nd.reduce_text(t)) >= 12]
    return {(min(a, b), max(a, b)) for i, (a, x) in enumerate(texts) for b, y in texts[i + 1 :] if nd.jaccard(x, y, 12) >= 0.6}


def test_the_exact_setting_loses_nothing(spark):
    rows = list(enumerate(evenly_edited(random.Random(3))))
    df = spark.createDataFrame(rows, "doc_id BIGINT, content STRING")
    _, links = nd.near_duplicates(spark, df, "doc_id", "content", nd.Setting.exact())
    brute = brute_pairs(rows)
    assert len(brute) > 30 and {(r.a, r.b) for r in links.collect()} == brute


def test_the_exact_setting_agrees_on_the_tables(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    prose = spark.read.parquet(f"{DATA}/documents.parquet").where("form = 'prose'")
    found = [{tuple(r) for r in nd.near_duplicates(spark, prose, "doc_id", "content", s)[1].select("a", "b").collect()} for s in (nd.Setting(), nd.Setting.exact())]
    assert found[0] == found[1]


def test_templates_make_no_pairs_and_lose_none(spark, monkeypatch):
    rng = random.Random(14)
    template = words(rng, 60)
    rows = []
    for g in range(40):
        own = words(rng, 70)
        for _ in range(1 + g % 3):
            t = list(template) + own
            for _ in range(rng.randrange(0, 9)):
                t[rng.randrange(len(t))] = "zzzz"
            rows.append((len(rows), " ".join(t)))
    rows += [(1000 + k, " ".join(words(rng, 50) + template[:8])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, content STRING")
    brute = brute_pairs(rows)
    seen = []
    inner = nd._candidates

    def watched(space, reps, setting):
        found, templated = inner(space, reps, setting)
        seen.append((setting.frequent, spark.read.parquet(space.path("prefix")).where("NOT frequent").agg(F.max("df")).first()[0], found.count(), templated.count() if templated is not None else None))
        return found, templated

    monkeypatch.setattr(nd, "_candidates", watched)
    _, links = nd.near_duplicates(spark, df, "doc_id", "content", nd.Setting(frequent=20))
    assert len(brute) > 30 and {(r.a, r.b) for r in links.collect()} == brute
    (limit, most, _, templated), (exact, inside, pairs, _) = seen
    assert limit == 20 and most <= 20 and templated >= 60 and exact is None
    assert inside < 30 and pairs < 5 * len(brute)  # the template is no reason to compare


@pytest.mark.parametrize("block", [2, 512])
@pytest.mark.parametrize("salt", [1, 1000])
def test_all_pairs_with_hot_classes(spark, block, salt, monkeypatch):
    monkeypatch.setattr(nd, "PAIRS_OF_A_SALT", salt)
    rng = random.Random(11)
    base = words(rng, 80)
    texts = [" ".join(base[:k] + ["qqqqq"] + base[k:]) for k in range(0, 60, 20)]
    rows = [(k * 5 % 31, texts[k % 3] if k % 4 else texts[0].upper()) for k in range(20)] + [(100 + k, " ".join(words(rng, 40))) for k in range(5)]
    df = spark.createDataFrame([(k, t, t) for k, t in rows], "doc_id BIGINT, content STRING, id STRING")
    found = [(r.a, r.b) for r in nd.similar_pairs(*nd.near_duplicates(spark, df, "doc_id", "content"), block=block).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(rows) and len(found) == 190
    assert nd.similar_pairs(*nd.near_duplicates(spark, df.limit(0), "doc_id", "content"), block=block).count() == 0


def test_short_texts_with_edits(spark):
    rng = random.Random(9)
    rows = []
    for n in (14, 30, 50, 66, 90, 150, 300, 420):
        base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        for _ in range(5):
            t = list(base)
            for at in range(60, n, 60):  # evenly spaced changes, the worst case for common stretches
                t[at + rng.randrange(-2, 3) if at + 2 < n else at] = rng.choice("0123")
            cut = rng.randrange(0, max(1, n // 8))
            rows.append((len(rows), "".join(t)[cut:] + "9" * (cut if rng.random() < 0.5 else 0), None))
    df = spark.createDataFrame(rows, "doc_id BIGINT, content STRING, anchor STRING")
    _, links = nd.near_duplicates(spark, df, "doc_id", "content")
    least: dict = {}
    for k, t, _ in rows:
        if len(t) >= 12:
            least.setdefault(t, k)
    reps = list(least.items())
    brute = {(a, b) for i, (x, a) in enumerate(reps) for y, b in reps[i + 1 :] if nd.jaccard(x, y, 12) >= 0.6}
    assert len(brute) > 30 and {(r.a, r.b) for r in links.collect()} == brute
