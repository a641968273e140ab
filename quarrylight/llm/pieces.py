"""Splitting oversized texts at natural boundaries by packing a structure tree.

A text is parsed into a tree: sections by the depth of their headings, blocks (paragraphs and
lists), list items by their indentation. A block without further structure is a leaf; if it is
too large for a piece it gets children as well: its sentence units, then lines, clauses and
words. Nodes are stretches between two positions, so nothing is copied and every character
belongs to a leaf. A heading belongs to the first block below it.

Packing goes bottom-up. A subtree that fits is one group. Only a node that doesn't fit is
descended into: its children are packed first, then neighbours among their groups are merged
as long as they fit together. Groups of different sections merge only if they are whole
sections. A stretch without any boundary is cut where the limit is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from quarrylight.llm.sentences import units

#: Punctuation that counts as a natural boundary beside white space; fixed by the problem.
BOUNDARY_MARKS = ".!?;:,。！？；：，、"
SOLID = re.compile(rf"[^\s{re.escape(BOUNDARY_MARKS)}]+")
_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x85  ])"
LINES = re.compile(rf"(?s)[^\n\r\x0b\x0c\x85  ]*(?:{_BREAK}|\Z)")
HEADING = re.compile(r"[ \t]{0,3}(?:(#{1,6})(?=[ \t\r\n]|\Z)|<h([1-6])\b)")
UNDERLINE = re.compile(r"[ \t]{0,3}(?:={3,}|-{3,})[ \t]*(?:[\r\n]|\Z)")
ITEM = re.compile(r"([ \t]*)(?:(?:[-*+•‣◦▪]|\(?\d{1,3}[.)])[ \t\xa0]|<(?:li|p|tr)\b)")
#: Levels of lists that are told apart; deeper items count as this level.
DEEPEST = 40
_BLOCK, _ITEMS = 10, 11

#: The levels below a block, from coarse to fine. A pattern matches the end of a child.
FINE: list[tuple[str, re.Pattern | None]] = [
    ("sentence", None),  # the units of :mod:`quarrylight.llm.sentences`
    ("line", re.compile(rf"{_BREAK}\s*")),
    ("clause", re.compile(r"(?:[;:,]\s+|[；：，、]\s*|[|)\]}]\s+|</\w+>\s*)")),
    ("word", re.compile(rf"(?:\s+|[{re.escape(BOUNDARY_MARKS)}]+(?=\S))")),
]


COARSE = ("section", "paragraph", "item", "sentence")


@dataclass(slots=True)
class Node:
    """A stretch of the text; ``rank`` orders structure (sections 1 to 6, blocks, items), leaves have the level of their children in FINE."""

    start: int
    end: int
    kind: str
    rank: int = 0
    children: list[Node] = field(default_factory=list)


def parse(text: str) -> Node:
    """The tree of sections, blocks and items that a text's lines say."""
    openings: list[tuple[int, str, int]] = []
    lines = [(m.start(), m.end()) for m in LINES.finditer(text) if m.end() > m.start()]
    open_block, indents = "", []
    for n, (start, end) in enumerate(lines):
        if text[start:end].isspace():
            open_block = "" if open_block != "list" else "list "  # items go on after a blank line
            continue
        heading, item = HEADING.match(text, start), ITEM.match(text, start)
        underlined = open_block in ("", "list ", "heading") and n + 1 < len(lines) and not item and UNDERLINE.match(text, lines[n + 1][0])
        if heading or underlined:
            depth = len(heading[1]) if heading and heading[1] else int(heading[2]) if heading else 1 if "=" in underlined[0] else 2
            openings.append((start, "section", depth))
            open_block = "heading"
        elif item:
            if not open_block.startswith("list"):
                openings.append((start, "paragraph", _BLOCK))
                indents = []
            width = len(item[1].expandtabs(4))
            while indents and indents[-1] > width:
                indents.pop()
            if not indents or indents[-1] < width:
                indents.append(width)
            openings.append((start, "item", _ITEMS + min(len(indents), DEEPEST)))
            open_block = "list"
        elif open_block == "heading" and UNDERLINE.match(text, start):
            pass  # the line under a heading
        elif open_block not in ("paragraph", "list"):  # an unmarked line right after an item belongs to it
            openings.append((start, "paragraph", _BLOCK))
            open_block = "paragraph"
    root = Node(0, len(text), "start")
    stack = [root]
    for start, kind, rank in openings:
        while stack[-1].rank >= rank:
            stack.pop().end = start
        stack[-1].children.append(Node(start, len(text), kind, rank))
        stack.append(stack[-1].children[-1])
    _close(root)
    return root


def _close(root: Node) -> None:
    """Children cover their node: what comes before the first one goes to it, but an item's own text is a leaf."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.children:
            first = node.children[0]
            if node.kind == "item" and first.start > node.start:
                node.children.insert(0, Node(node.start, first.start, "item"))
            first = node.children[0]
            first.start = node.start
            for a, b in pairwise(node.children):
                a.end = b.start
            node.children[-1].end = node.end
            todo += node.children


def _children(text: str, node: Node, level: int) -> list[Node]:
    """The parts of a node that has no structure of its own, at a level of FINE."""
    kind, pattern = FINE[level]
    if pattern is None:
        cuts = [node.start + s for s, _ in units(text[node.start : node.end])][1:]
    else:
        cuts = [m.end() for m in pattern.finditer(text, node.start, node.end) if node.start < m.end() < node.end]
    return [Node(a, b, kind) for a, b in pairwise([node.start, *cuts, node.end])]


class _Packer:
    def __init__(self, text: str, limit: int, overlap: int):
        self.text, self.limit, self.overlap = text, limit, overlap
        self.kinds: dict[int, str] = {}  # of each boundary, by the coarsest level that has it

    def room(self, start: int) -> int:
        """How many new characters a piece may hold: a later one repeats the overlap."""
        return self.limit - self.overlap if start else self.limit

    def fits(self, start: int, end: int) -> bool:
        return end - start <= self.room(start)

    def pack(self, node: Node, level: int = 0) -> list[tuple[int, int]]:
        """The groups of a node's characters, each of which fits."""
        if self.fits(node.start, node.end):
            return [(node.start, node.end)]
        children = node.children
        while not children and level < len(FINE):
            found = _children(self.text, node, level)
            level += 1
            children = found if len(found) > 1 else []
        if not children:
            cuts = [node.start]
            while not self.fits(cuts[-1], node.end):
                cuts.append(cuts[-1] + self.room(cuts[-1]))
                self.kinds.setdefault(cuts[-1], "hard")
            return list(pairwise([*cuts, node.end]))
        out: list[tuple[int, int]] = []
        whole = True  # whether the last group consists of whole children
        for child in children:
            if out:
                self.kinds.setdefault(child.start, child.kind)
            groups = self.pack(child, level)
            apart = child.kind == "section" and not (whole and len(groups) == 1)
            if out and not apart and self.fits(out[-1][0], groups[0][1]):
                out[-1] = (out[-1][0], groups[0][1])
                out += groups[1:]
                whole = whole and len(groups) == 1
            else:
                out += groups
                whole = len(groups) == 1
        return out

    def best_cut(self, coarse: list[tuple[int, str]], low: int, high: int) -> int:
        """The last place from low to high at the coarsest level that has one there."""
        near = coarse[bisect_left(coarse, (low, "")) : bisect_left(coarse, (high + 1, ""))]
        for kind in COARSE:
            if places := [at for at, k in near if k == kind]:
                return places[-1]
        stretch = Node(max(low - 1, 0), min(high + 1, len(self.text)), "")
        for level in range(1, len(FINE)):
            if cuts := [c.start for c in _children(self.text, stretch, level)[1:] if low <= c.start <= high]:
                self.kinds.setdefault(cuts[-1], FINE[level][0])
                return cuts[-1]
        self.kinds.setdefault(high, "hard")
        return high

    def evened(self, groups: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Groups of fewer new characters than the overlap are joined with a neighbour, or take from the next one."""
        out: list[tuple[int, int]] = []
        todo = groups[::-1]
        coarse = sorted((at, k) for at, k in self.kinds.items() if k in COARSE)
        while todo:
            start, end = todo.pop()
            if end - start >= max(self.overlap, 1) or not (todo or out):
                out.append((start, end))
            elif out and self.fits(out[-1][0], end):
                out[-1] = (out[-1][0], end)
            elif todo:
                last = todo.pop()[1]
                low, high = start + max(self.overlap, 1), min(start + self.room(start), last)
                if self.fits(start, last):
                    todo.append((start, last))
                elif low <= high:
                    high = max(low, min(high, last - self.overlap))
                    cut = self.best_cut(coarse, max(low, last - self.room(1)), high)
                    out.append((start, cut))
                    todo.append((cut, last))
                else:
                    out.append((start, end))
                    todo.append((end, last))
            else:
                out.append((start, end))
        return out


def cut_positions(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """Where a text is cut, and at which kind of boundary ("hard" where there was none)."""
    packer = _Packer(text, limit, overlap)
    groups = packer.evened(packer.pack(parse(text)))
    return [(end, packer.kinds[end]) for _, end in groups[:-1]]


def solid_around(text: str, at: int) -> int:
    """The length of the stretch without white space and boundary marks that a cut at ``at`` goes through; 0 at a boundary."""
    right = SOLID.match(text, at)
    if right is None or SOLID.match(text, at - 1) is None:
        return 0
    left, size = at, 64
    while left == at or left > 0 and at - left >= size // 2:  # look further back while all of it is solid
        near = text[max(0, at - size) : at]
        left = at - len(SOLID.match(near[::-1])[0])
        size *= 2
    return right.end() - left


def split_text(text: str | None, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the boundary at its end) of each piece; one piece if the text fits.

    Null and empty texts have no piece. Every piece has at most ``limit`` characters; each
    begins exactly ``overlap`` characters before the end of the one before.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text), "end")]
    cuts = [*cut_positions(text, limit, overlap), (len(text), "end")]
    starts = [0, *(max(c - overlap, 0) for c, _ in cuts[:-1])]
    return [(s, e, kind) for s, (e, kind) in zip(starts, cuts, strict=True)]


def split_documents(df: DataFrame, key: str, text: str, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """(key, piece_no, n_pieces, start_pos, end_pos, boundary, solid[, piece]) of oversized texts.

    Only texts longer than ``limit`` code points have rows; they alone are sent to Python.
    ``solid`` is the length of the stretch without a natural boundary that the cut at the
    piece's end goes through, 0 where it is cut at one. Null and empty texts have no rows,
    repeated rows give their pieces again, other columns of ``df`` are neither read nor kept.
    ``overlap`` has to be below ``limit``, both positive (overlap may be 0).
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap has to be at least 0 and below the limit")
    fields = [
        T.StructField(key, df.schema[key].dataType),
        *(T.StructField(n, T.IntegerType(), False) for n in ("piece_no", "n_pieces", "start_pos", "end_pos")),
        T.StructField("boundary", T.StringType(), False),
        T.StructField("solid", T.IntegerType(), False),
    ]
    if with_text:
        fields.append(T.StructField("piece", T.StringType(), False))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows, counts = [], []
                for t in part.column(1).to_pylist():
                    found = split_text(t, limit, overlap)
                    counts.append(len(found))
                    rows += [(i, len(found), s, e, kind, solid_around(t, e), t[s:e] if with_text else None) for i, (s, e, kind) in enumerate(found)]
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                taken = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
                kinds = [pa.int32()] * 4 + [pa.string(), pa.int32()] + [pa.string()] * with_text
                yield pa.RecordBatch.from_arrays([taken, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=names)

    chosen = df.select(df[f"`{key}`"].alias(key), df[f"`{text}`"].cast("string").alias("_text"))
    return chosen.where(F.length("_text") > limit).mapInArrow(run, T.StructType(fields))


def piece_violations(pieces: DataFrame, df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """(rule, n): how many pieces (with their texts) of :func:`split_documents` break each rule; 0 everywhere if all is well."""
    source = df.select(df[f"`{key}`"].alias(key), df[f"`{text}`"].alias("_text"), F.length(df[f"`{text}`"]).alias("_length")).where(F.col("_length") > limit)
    joined = source.join(pieces, key, "left")
    later = F.col("piece_no") > 0
    place = Window.partitionBy(key).orderBy("piece_no")
    counted = joined.withColumns({"_before": F.lag("end_pos").over(place), "_last": F.lead("piece_no").over(place).isNull()}).agg(
        F.count_if(F.col("piece_no").isNull()).alias("text without pieces"),
        F.count_if(F.length("piece") > limit).alias("over the limit"),
        F.count_if(F.col("piece") != F.expr("substring(_text, start_pos + 1, end_pos - start_pos)")).alias("other than the text"),
        F.count_if(later & (F.col("start_pos") != F.col("_before") - overlap) | ~later & (F.col("start_pos") != 0)).alias("wrong overlap"),
        F.count_if(F.col("_last") & (F.col("end_pos") != F.col("_length"))).alias("end not reached"),
        F.count_if((F.col("boundary") == "hard") & (F.col("solid") > 0) & (F.col("solid") <= limit - 2 * overlap - 2)).alias("cut inside a word with a boundary in reach"),
    )
    rules = [F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in counted.columns]
    return counted.select(F.explode(F.array(*rules)).alias("r")).select("r.*")
