"""Sentence units of texts in many languages and scripts.

A lexer, one regular expression, finds what may end a unit or change how it is read: line
breaks, end marks, quotes and brackets. What stands around a mark is reduced to kinds of
tokens, and the compiled rules of :mod:`quarrylight.llm.boundaries` give the symbol that the
mark is. A finite transducer over the symbols knows whether a quotation or bracket is open,
and whether it stood at the start of its sentence, and says where units end.

A long text is cut into chunks of characters at line breaks or white space. Every chunk is
lexed and summed up as a function of states by itself; a prefix scan of these functions gives the
state in which each begins. A blank line puts the transducer into one state whatever came
before, so very long texts travel as several rows, cut there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from quarrylight.llm import boundaries as b
from quarrylight.llm.transducer import Transducer

#: Characters of a chunk; a longer text is run in chunks.
CHUNK_CHARS = 50_000
#: Characters after which a text is cut into rows at its next blank line.
ROW_CHARS = 500_000

END_MARKS = ".!?…。！？｡।॥؟۔։።။។‼⁇⁈⁉"
CLOSERS = "\"'”’“»›)]}」』）】〉》〕"
LINE = "\n\r\x0b\x0c\x85\u2028\u2029"
EVENT = re.compile(
    rf"(?P<line>(?:\r\n|[{LINE}])\s*)"
    rf"|(?P<skip>`[^`{LINE}]*`|\d[\d.,:]*\d)"
    rf"|(?P<mark>[{re.escape(END_MARKS)}]+)"
    r"|(?P<greek>[;\u037e])"
    r"|(?P<thai>(?<=[\u0e00-\u0e7f])[ \t\xa0\u2000-\u200a\u3000]+)"
    r"|(?P<quote>[\"“”„«»‹›「」『』（）()\[\]【】《》〈〉])"
)
BREAKS = re.compile(rf"\r\n|[{LINE}]")
_BREAK = r"(?:\r\n|\r(?!\n)|[\n\x0b\x0c\x85\u2028\u2029])"
#: A whole run of blank lines.
PARAGRAPH = re.compile(rf"{_BREAK}(?:[^\S{LINE}]*{_BREAK})+")
#: German articles and contracted prepositions, before which a number with a point is an ordinal.
ARTICLES = set("am im der die das dem den des vom zum beim ins ans".split())
MARKER = re.compile(r"(?:[-*+•‣◦▪·–]|\(?\d{1,3}\)|\(?[A-Za-z]\)|\d{1,3}\.)[ \t\xa0\u3000]")
DOTTED = re.compile(r"\d{1,3}\.[ \t]")
AFTER = re.compile(rf"(?:[ \xa0\u202f]?[»›]|[{re.escape(CLOSERS)}])*")
WORD = re.compile(r"[^\W\d_][\w'’]*")
ROMAN = re.compile(r"[IVXLC]{2,}\b|[VXLC]\b")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞΆΈ-ΏΑ-ΫЀ-Я]")
LETTER = re.compile(r"[^\W\d_]")
GREEK = re.compile(r"[\u0370-\u03ff\u1f00-\u1fff]")
SPACE = re.compile(r"[^\S" + LINE + "]*")
#: What a token before a mark cannot hold.
STOPS = frozenset("([\"“„«‘’`—–/")
BRACKET_SIGNS = frozenset(")]}）】")
OPENING, CLOSING = frozenset("„«‹「『（([【《〈"), frozenset("»›」』）)]】》〉")
PARTNER = {"„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", '"': '"', "“": "”“"}

RULES = Transducer(*b.quotation_tables())


def _token_before(text: str, at: int) -> str:
    """The run of characters before a position that are neither white space nor opening signs."""
    low = at
    while low and text[low - 1] not in STOPS and not text[low - 1].isspace():
        low -= 1
    return text[low:at]


def _solid_before(text: str, at: int, blanks: str = " \t") -> str:
    """The nearest character before a position other than blanks, or an empty string."""
    while at and text[at - 1] in blanks:
        at -= 1
    return text[at - 1 : at]


def _case_tells(piece: str) -> bool:
    """Whether letter case says anything in a paragraph: neither all capitals nor all small letters."""
    capitals = len(CAPITAL.findall(piece))
    return 0 < capitals < len(piece) / 2 or not capitals and not piece.islower()


class _Paragraphs:
    """What holds for whole paragraphs, by position: letter case, script, and the last partner of each opening sign."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, 0, -1
        self._case: bool | None = None
        self._greek: bool | None = None
        self._last: dict[str, int] = {}

    def move(self, at: int) -> _Paragraphs:
        if not self.start <= at < self.end:
            if self.end < 0 or at < self.start:  # a chunk may begin anywhere
                self.end = _paragraph_start(self.text, at)
            while self.end <= at:
                self.start = self.end
                found = PARAGRAPH.search(self.text, self.start)
                self.end = found.end() if found else len(self.text) + 1
            self._case = self._greek = None
            self._last = {}
        return self

    def case(self, at: int) -> bool:
        self.move(at)
        if self._case is None:
            self._case = _case_tells(self.text[self.start : self.end])
        return self._case

    def greek(self, at: int) -> bool:
        self.move(at)
        if self._greek is None:
            piece = self.text[self.start : self.end]
            self._greek = 2 * len(GREEK.findall(piece)) > len(LETTER.findall(piece))
        return self._greek

    def closes(self, sign: str, at: int) -> bool:
        """Whether an opening sign finds a partner before the paragraph ends; else it is ignored."""
        self.move(at)
        for p in PARTNER[sign]:
            if p not in self._last:
                self._last[p] = self.text.rfind(p, self.start, self.end)
            if self._last[p] >= at:
                return True
        return False


def _paragraph_start(text: str, at: int) -> int:
    """The end of the last blank line before a position, 0 if there is none."""
    size = 1024
    while True:
        low = max(0, at - size)
        ends = [m.end() for m in PARAGRAPH.finditer(text, low, at)]
        if ends or not low:
            return ends[-1] if ends else 0
        size *= 4


def _before(text: str, start: int) -> int:
    """The kind of what stands before a point."""
    token = _token_before(text, start)
    if not token:
        return b.NOTHING
    low = token.lower().rpartition("'")[2]  # "l'art" is "art"
    head, _, tail = low.rpartition(".")
    if len(head.rpartition(".")[2]) > 2:  # the end of a word before, written without a space
        low = tail
    short = low.rpartition(".")[2].lstrip("-")
    at = start - len(token)
    if low in b.LEADING:
        return b.LEAD
    letter = len(short) == 1 and short.isalpha() or len(short) == 2 and not short[1].isalnum() and short[0].isalpha()
    if low in b.NUMBERED:
        return b.COUNTED_LETTER if letter else b.COUNTED
    if low.isdigit():
        if MARKER.match(text, at) and DOTTED.match(text, at) and _solid_before(text, at) in ("", *LINE):
            return b.LISTED
        return b.ORDINAL if len(low) < 3 and at and _token_before(text, at - 1).lower() in ARTICLES else b.NUMBER
    pair = _pair(text, at, low)
    if letter and pair not in b.TRAILING and low not in b.TRAILING:
        return b.LEAD if pair in b.LEADING else b.INITIAL if low == short else b.PART
    if pair in b.TRAILING:
        low = pair
    if low in b.TRAILING:
        return b.TIME if low in b.CLOCK else b.MID if low in b.MIDDLE else b.NAME if low in b.NAMED else b.TRAIL
    if pair in b.LEADING:
        return b.LEAD
    return b.WORD


def _pair(text: str, at: int, low: str) -> str:
    """An abbreviation's two parts as one, such as "z. b" at its second: "z.b"."""
    while at and text[at - 1].isspace():
        at -= 1
    if not at or text[at - 1] != ".":
        return ""
    return _token_before(text, at - 1).lower() + "." + low


def _follows(text: str, at: int) -> tuple[int, int]:
    """(kind, shape) of what begins at a position."""
    first = text[at]
    word = WORD.match(text, at)
    if word is None:
        if first.isdigit():
            return b.DIGIT, b.LOWER
        if first in ",;:—–":
            return b.PAUSE, b.LOWER
        return (b.HYPHEN if first == "-" else b.OTHER), b.LOWER
    if ROMAN.match(text, at):
        return b.DIGIT, b.UPPER
    head = word.group(0)
    if not first.isupper() and not first.islower():
        return b.NO_CASE, b.LOWER
    shape = b.LOWER if first.islower() else b.SHOUTED if len(head) > 1 and head.isupper() else b.UPPER
    return b.next_kind(head.lower()), shape


def _mark(text: str, start: int, end: int, paragraphs: _Paragraphs) -> tuple[int, int]:
    """(symbol, position) of the end mark at text[start:end]."""
    n, mark = len(text), text[start:end]
    after = AFTER.match(text, end).end()
    while after > end and text[after - 1] in "\"'“’" and after < n and text[after].isalnum():
        after -= 1  # it opens what follows
    closers = text[end:after]
    closed = 0 if not closers else sum(c in CLOSERS for c in closers)
    if mark[-1] not in ".!?…":  # marks that only end sentences
        if closed and after < n and text[after].isalnum():
            return b.NO, end
        return (b.END, end) if not closed else (b.ENDS_CLOSED if closed == 1 else b.ENDS_CLOSED_2, after)
    kind = b.POINT if mark == "." else b.DOTS if set(mark) <= {".", "…"} else b.STRONG
    cased = paragraphs.case(start)
    if not closed and after < n and text[after].isalnum():
        return b.look_up(_before_attached(text, start, kind), kind, b.OPEN, b.ATTACHED, *_attached(text, end), cased), end
    at = SPACE.match(text, after).end()
    if at < n and text[at] in LINE:  # what follows a single line break goes on; a blank line ends it anyway
        line = EVENT.match(text, at)
        more = line.end()
        at = more if more < n and len(BREAKS.findall(text, at, more)) < 2 and not MARKER.match(text, more) else n
    before = _before(text, start) if kind == b.POINT and not closed else b.NOTHING if start and text[start - 1].isspace() else b.WORD
    nxt, shape = _follows(text, at) if at < n else (b.END_OF_LINE, b.LOWER)
    signs = b.OPEN if not closed else (b.BRACKET if closed == 1 else b.BRACKETS) if BRACKET_SIGNS.intersection(closers) else b.QUOTE if closed == 1 else b.QUOTES
    symbol = b.look_up(before, kind, signs, b.SPACED, nxt, shape, cased)
    return symbol, after if symbol != b.END else end


def _before_attached(text: str, start: int, kind: int) -> int:
    """The kind of what stands before a mark that a letter or digit follows at once."""
    last = text[start - 1 : start]
    if not last.isalnum() and last not in CLOSERS or not last:
        return b.SIGN
    found = _before(text, start) if kind == b.POINT else b.WORD
    if found in (b.LEAD, b.COUNTED, b.COUNTED_LETTER, b.INITIAL, b.PART, b.TIME):
        return found
    token = _token_before(text, start)
    if "." in token and len(token.rpartition(".")[2]) < 2:
        return b.PART
    return b.CAPITAL_END if last.isupper() else b.LONG if len(token) > 3 and token.isalpha() else b.WORD


def _attached(text: str, at: int) -> tuple[int, int]:
    """(kind, shape) of what follows a mark at once; a longer word before white space is no part of a name."""
    word = WORD.match(text, at)
    if word is None:
        return b.DIGIT, b.LOWER
    head = word.group(0)
    before = _token_before(text, at - 1)
    dotted = len(head) == 1 and text[word.end() : word.end() + 1] == "." and (len(before) <= 3 or text[word.end() + 1 : word.end() + 2].isalnum())
    if head.lower() in b.ENDINGS or dotted:
        return b.FILE, b.LOWER  # of a file, or of an abbreviation with points
    kind, shape = _follows(text, at)
    if kind in (b.NO_CASE, b.STARTER):
        return kind, shape
    alone = len(head) > 3 and len(before) > 3 and before.isalpha() and text[word.end() : word.end() + 1].isspace()
    return (b.LONE if alone else b.ANY), shape


def events(text: str, fields: bool, start: int = 0, end: int | None = None) -> tuple[list[int], list[int]]:
    """The symbols of text[start:end] and the positions at which a unit would end with each."""
    symbols: list[int] = []
    ends: list[int] = []
    paragraphs = _Paragraphs(text)
    for m in EVENT.finditer(text, start, len(text) if end is None else end):
        kind, s, e = m.lastgroup, m.start(), m.end()
        if kind == "mark":
            symbol, at = _mark(text, s, e, paragraphs)
            if symbol:
                symbols.append(symbol)
                ends.append(at)
        elif kind == "line":
            if fields or len(BREAKS.findall(m.group(0))) > 1 or e >= len(text) or MARKER.match(text, e) and not _wrapped_number(text, s, e):
                symbols.append(b.BREAK)
                ends.append(s)
            elif "\u0e00" <= text[s - 1 : s] <= "\u0e7f":
                symbols.append(b.END)
                ends.append(s)
        elif kind == "thai":
            if e < len(text) and text[e] not in LINE:
                symbols.append(b.END)
                ends.append(s)
        elif kind == "greek":  # the question mark of Greek
            if text[s] == "\u037e" or GREEK.match(text[s - 1 : s]) or _solid_before(text, s, " \u0301\u0308").isalpha() and paragraphs.greek(s):
                symbols.append(b.END)
                ends.append(e)
        elif kind == "quote":
            if _opens(text, s, e):
                if paragraphs.closes(text[s], e):
                    symbols.append(_opening(text, s))
                    ends.append(s)
            elif not (symbols and b.ENDS_CLOSED <= symbols[-1] <= b.MAY_CLOSED_2 and ends[-1] >= e):
                symbols.append(b.CLOSE)
                ends.append(e)
    return symbols, ends


def _opens(text: str, s: int, e: int) -> bool:
    """Whether a quote or bracket opens; the same sign may do either."""
    c, before, after = text[s], text[s - 1 : s] if s else "", text[e : e + 1]
    if c in OPENING:
        return True
    if c in CLOSING or c == "”" or not after.strip():
        return False
    return not before.strip() or before in "([{-—–:：、，,「『/" or before in END_MARKS and after.isalnum()


def _opening(text: str, s: int) -> int:
    prior = _solid_before(text, s, " \t\xa0\u3000")
    first = not prior or prior in LINE or prior in END_MARKS or prior in CLOSERS or _after_marker(text, s)
    return b.OPEN_FIRST if first else b.OPEN_LATER


def _after_marker(text: str, at: int) -> bool:
    """Whether a list marker and nothing else stands between a line's start and a position."""
    low = at
    while low and at - low < 8 and text[low - 1] not in LINE:  # a marker is shorter than that
        low -= 1
    line = text[low:at].lstrip()
    return (not low or text[low - 1] in LINE or text[low - 1].isspace()) and bool(MARKER.fullmatch(line.rstrip() + " ")) and _solid_before(text, low + len(text[low:at]) - len(line)) in ("", *LINE)


def _wrapped_number(text: str, s: int, e: int) -> bool:
    """Whether "27. " at a line's start is a number of the sentence before the line break."""
    return bool(DOTTED.match(text, e)) and _solid_before(text, s) not in END_MARKS + ":" + CLOSERS


def _chunks(text: str, size: int) -> list[tuple[int, int]]:
    """Bounds of chunks of at least ``size`` characters, cut before a line break that follows something else."""
    cuts, at = [0], 0
    cut = re.compile(rf"(?<=\S)(?=[{LINE}])")
    while len(text) - at > size and (m := cut.search(text, at + size)):
        at = m.start()
        cuts.append(at)
    return list(pairwise([*cuts, len(text)]))


def units(text: str | None, fields: bool = False, chunk: int = CHUNK_CHARS) -> list[tuple[int, int]]:
    """(start, end) of each unit in code points, surrounding white space left out."""
    if not text or text.isspace():
        return []
    if len(text) <= chunk:
        symbols, ends = events(text, fields)
        found = [ends[i] for i in RULES.run(symbols, RULES.start)[0]]
    else:
        lexed = [events(text, fields, *c) for c in _chunks(text, chunk)]
        found = [lexed[k][1][i] for k, stretch in enumerate(RULES.run_stretches([s for s, _ in lexed])) for i in stretch]
    out = []
    for x, y in pairwise([0, *found, len(text)]):
        piece = text[x:y]
        body = piece.strip()
        if body:
            s = x + len(piece) - len(piece.lstrip())
            out.append((s, s + len(body)))
    return out


def _rows(text: str, size: int) -> Iterator[tuple[int, str]]:
    """(offset, part) of a long text, cut behind blank lines."""
    start = 0
    while len(text) - start > size and (m := PARAGRAPH.search(text, start + size)):
        yield start, text[start : m.end()]
        start = m.end()
    yield start, text[start:]


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text", form: str = "form", row_chars: int = ROW_CHARS) -> DataFrame:
    """(key, start_pos INT, end_pos INT): one row per sentence unit of each text.

    Positions count code points, end exclusive. Null, empty and blank texts have no rows;
    a null form counts as prose; repeated rows give their units again. Whole texts are read,
    whatever their length: texts of over ``row_chars`` are cut behind blank lines into rows that
    are spread over the tasks. Other columns of ``df`` are neither read nor kept.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("start_pos", T.IntegerType(), False), T.StructField("end_pos", T.IntegerType(), False)])
    parts = T.StructType([T.StructField(key, key_type), T.StructField("_text", T.StringType()), T.StructField("_fields", T.BooleanType()), T.StructField("_offset", T.IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(_rows(batch.column(1)[i].as_py(), row_chars))
                same = [batch.column(k).take(pa.array([i] * len(found))) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([same[0], pa.array([t for _, t in found]), same[1], pa.array([o for o, _ in found], pa.int32())], names=parts.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [units(t, f) for t, f in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                rows = np.repeat(np.arange(part.num_rows), [len(x) for x in found])
                flat = np.array([p for x in found for p in x], np.int32).reshape(-1, 2) + part.column(3).to_numpy()[rows].reshape(-1, 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=schema.fieldNames())

    chosen = df.select(df[f"`{key}`"].alias(key), df[f"`{text}`"].cast("string").alias("_text"), F.coalesce(df[f"`{form}`"] == "fields", F.lit(False)).alias("_fields"))
    long = F.length("_text") > row_chars
    short = chosen.where(F.col("_text").isNotNull() & (F.col("_text") != "") & ~long).withColumn("_offset", F.lit(0))
    spread = chosen.where(long).mapInArrow(cut, parts).repartition(F.xxhash64(key, "_offset"))
    return short.unionByName(spread).mapInArrow(run, schema)


def unit_violations(df: DataFrame, key: str = "doc_id", text: str = "text", form: str = "form", per_text: int = 200) -> DataFrame:
    """(rule, n): how many units of all texts of ``df`` (key a unique BIGINT) break each rule; 0 everywhere if all is well.

    ``per_text`` texts of neighbouring keys are joined by blank lines to a long text; its units
    have to be those of its parts.
    """
    texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.col(form).alias("form")).where("text IS NOT NULL")
    found = sentence_units(texts, "key", "text", "form")
    white = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    place = Window.partitionBy("key").orderBy("start_pos")
    unit = F.expr("substring(text, start_pos + 1, end_pos - start_pos)")
    each = found.join(texts, "key").select("key", "text", "start_pos", "end_pos", F.lag("end_pos").over(place).alias("before"), unit.alias("unit"))
    solid = lambda c: F.length(F.regexp_replace(c, white, ""))
    sums = each.groupBy("key").agg(F.sum(solid(F.col("unit"))).alias("inside"))
    outside = texts.join(sums, "key", "left").where(solid(F.col("text")) != F.coalesce("inside", F.lit(0)))
    # Long texts: the offset of each part follows from the lengths before it.
    group = F.struct(F.col("form"), F.floor(F.col("key") / per_text).alias("n"))
    placed = texts.withColumn("group", F.to_json(group))
    order = Window.partitionBy("group").orderBy("key")
    offset = F.sum(F.length("text") + 2).over(order) - F.length("text") - 2
    joined = placed.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("key", "text"))).alias("parts"), F.first("form").alias("form"))  # of at most per_text rows
    long = sentence_units(joined.select("group", F.array_join(F.col("parts.text"), "\n\n").alias("text"), "form"), "group", "text", "form")
    moved = found.join(placed.select("key", "group", offset.alias("offset")), "key").select("group", (F.col("start_pos") + F.col("offset")).cast("int").alias("start_pos"), (F.col("end_pos") + F.col("offset")).cast("int").alias("end_pos"))
    otherwise = long.exceptAll(moved).union(moved.exceptAll(long))
    counts = each.agg(
        F.count_if(solid(F.col("unit")) == 0).alias("empty or blank"),
        F.count_if((F.col("start_pos") < 0) | (F.col("end_pos") > F.length("text"))).alias("beyond the text"),
        F.count_if(F.col("unit").rlike(f"^{white}|{white}\\z")).alias("white space around"),
        F.count_if(F.col("start_pos") < F.col("before")).alias("overlap"),
    )
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in counts.columns])).alias("r")).select("r.*")
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    return rows.unionByName(count(outside, "text outside of units")).unionByName(count(otherwise, "long text cut otherwise"))
