"""Oversized texts cut into pieces within a token limit, by packing their structure tree.

A text is parsed into a tree: elements of markup and the sections that headings open hold blocks, which are paragraphs, lists
with nested items, tables and fenced code; lines, sentences and clauses are made only where a block must be entered. Sibling
subtrees merge, whole, up to the limit; only an oversized node is entered; a heading stays with what it heads. Every
piece but the first repeats the last `overlap_tokens` tokens before it. Texts are cut where they lie: there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import TOKEN

PIECE_SCHEMA = (
    "doc_id string, source string, doc_tokens int, max_tokens int, overlap_tokens int, piece int, pieces int, start_token int, end_token int, "
    "n_tokens int, start_char int, fresh_char int, end_char int, text string"
)
_EACH_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_FENCE = re.compile(r"[ \t>]*(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t>]*(#{1,6})[ \t]+\S")
_UNDERLINE = re.compile(r"[ \t]*(?:(={3,})|(-{3,}))[ \t\r]*$")
_RULED = re.compile(r"[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t\r]*$")
_ROW = re.compile(r"[ \t]*\|.*\|[ \t\r]*$")
_ITEM = re.compile(r"([ \t>]*)(?:[-*+•·]|\(?\d{1,3}[.)]|\(?[a-z][.)])[ \t]+(?=\S)", re.I)
_TAG = re.compile(r"<(/?)(p|div|section|article|main|header|footer|aside|nav|ul|ol|dl|table|thead|tbody|tr|blockquote|pre|figure|form|li|dt|dd|h[1-6])\b[^<>]*>", re.I)
# Elements that end where another of theirs begins.
_OPEN_ENDED = {"p", "li", "dt", "dd", "tr"}
_WORD = re.compile(r"\w")
_LINE = re.compile(r"\n|<br[ /]*>|\r", re.I)
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?:\s+|(?<=[。！？]))")
_CLAUSE = re.compile(r"[,;:—–][\"'”’)\]]*\s+")
# Elements nested deeper than this are plain text.
_DEEPEST = 60


@dataclass
class Node:
    """A stretch of characters; siblings tile their parent. `level` is a heading's, or how far a block was entered."""

    start: int
    end: int
    kind: str
    level: int = 0
    children: list[Node] = field(default_factory=list)


def _blocks(text: str, start: int, end: int) -> list[Node]:
    """Headings, fences, tables, lists and paragraphs of a stretch, in order; blank lines belong to what is before them."""
    lines = [(m.start(), m.end()) for m in _EACH_LINE.finditer(text, start, end)]
    out: list[Node] = []
    at = 0

    def line(k: int) -> str:
        return text[lines[k][0] : lines[k][1]].rstrip("\n")

    def blank(k: int) -> bool:
        return not line(k).strip(" \t\r>")

    def starts_block(k: int) -> bool:
        own = line(k)
        return bool(_FENCE.match(own) or _HEADING.match(own) or _ROW.match(own) or _ITEM.match(own))

    while at < len(lines):
        first, own = at, line(at)
        if blank(at):
            at += 1
            if out:
                out[-1].end = lines[first][1]
            continue
        kind, level, children = "paragraph", 0, []
        fence, heading = _FENCE.match(own), _HEADING.match(own)
        under = _UNDERLINE.match(line(at + 1)) if at + 1 < len(lines) else None
        if fence:
            kind, at = "fence", at + 1
            while at < len(lines) and not re.match(rf"[ \t>]*{re.escape(fence[1])}", line(at)):
                at += 1
            at = min(at + 1, len(lines))
        elif heading:
            kind, level, at = "heading", len(heading[1]), at + 1
        elif under and _WORD.search(own) and not _ITEM.match(own):
            kind, level, at = "heading", 1 if under[1] else 2, at + 2
        elif _ROW.match(own) or ("|" in own and at + 1 < len(lines) and _RULED.match(line(at + 1))):
            kind = "table"
            while at < len(lines) and "|" in line(at):
                at += 1
        elif _ITEM.match(own):
            kind, at = "list", at + 1
            while at < len(lines):
                if blank(at):
                    if at + 1 < len(lines) and not blank(at + 1) and (_ITEM.match(line(at + 1)) or line(at + 1)[:2].isspace()):
                        at += 1
                        continue
                    break
                if not _ITEM.match(line(at)) and not line(at)[:2].isspace() and starts_block(at):
                    break
                at += 1
            children = _items(text, [lines[k] for k in range(first, at)])
        else:
            at += 1
            while at < len(lines) and not blank(at) and not starts_block(at) and not (at + 1 < len(lines) and _UNDERLINE.match(line(at + 1)) and _WORD.search(line(at))):
                at += 1
        out.append(Node(lines[first][0], lines[at - 1][1], kind, level, children))
    return out


def _items(text: str, lines: list[tuple[int, int]]) -> list[Node]:
    """A list's items, those indented further within the one before them."""
    root: list[Node] = []
    held: list[tuple[int, Node]] = []
    for start, end in lines:
        m = _ITEM.match(text, start, end)
        if not m:
            continue
        indent = len(m[1].expandtabs(4))
        node = Node(start, end, "item")
        while held and held[-1][0] >= indent:
            held.pop()
        if held and len(held) < _DEEPEST:
            parent = held[-1][1]
            if not parent.children:  # what stands before the nested items is a child as well
                parent.children.append(Node(parent.start, start, "paragraph"))
            parent.children.append(node)
        else:
            root.append(node)
        held.append((indent, node))
    return root


def _sections(blocks: list[Node]) -> list[Node]:
    """Blocks with what follows a heading, up to the next one of its level or above, in a section."""
    root: list[Node] = []
    open_: list[Node] = []
    for block in blocks:
        if block.kind == "heading":
            while open_ and open_[-1].level >= block.level:
                open_.pop()
            section = Node(block.start, block.end, "section", block.level, [block])
            (open_[-1].children if open_ else root).append(section)
            open_.append(section)
        else:
            (open_[-1].children if open_ else root).append(block)
    return root


def parse(text: str) -> Node:
    """The tree of a text."""
    root = Node(0, len(text), "text")
    fences = [(b.start, b.end) for b in _blocks(text, 0, len(text)) if b.kind == "fence"] if "```" in text or "~~~" in text else []
    stack, at = [root], 0
    for m in _TAG.finditer(text):
        if any(a <= m.start() < b for a, b in fences):
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].kind == tag), None)
            if depth is None:
                continue
            stack[-1].children += _blocks(text, at, m.start())
            for node in stack[depth:]:
                node.end = m.end()
            del stack[depth:]
            at = m.end()
        elif len(stack) < _DEEPEST:
            stack[-1].children += _blocks(text, at, m.start())
            if stack[-1].kind == tag and tag in _OPEN_ENDED:
                stack.pop().end = m.start()
            node = Node(m.start(), len(text), tag)
            stack[-1].children.append(node)
            stack.append(node)
            at = m.end()
    stack[-1].children += _blocks(text, at, len(text))
    for node in stack:
        node.end = len(text)
    _settle(root)
    return root


def _settle(node: Node) -> None:
    """Headings open sections, and siblings tile their parent."""
    for child in node.children:
        if re.fullmatch("h[1-6]", child.kind):
            child.kind, child.level, child.children = "heading", int(child.kind[1]), []
    if any(c.kind == "heading" for c in node.children) and node.kind != "section":
        node.children = _sections(node.children)
    for child, after in zip(node.children, [*node.children[1:], None]):
        child.end = after.start if after else node.end
    if node.children:
        node.children[0].start = node.start
    for child in node.children:
        _settle(child)


def _lines(text: str, a: int, b: int) -> list[int]:
    return [m.end() for m in _LINE.finditer(text, a, b)]


def _finished_lines(text: str, a: int, b: int) -> list[int]:
    """Line ends, where lines end with their sentences and are not just wrapped."""
    ends = _lines(text, a, b)
    finished = sum(text[max(a, e - 40) : e].rstrip()[-1:] in ".!?…。！？:;\"”’)" for e in ends)
    return ends if 2 * finished >= len(ends) else []


def _ends(pattern: re.Pattern):
    return lambda text, a, b: [m.end() for m in pattern.finditer(text, a, b)]


_ENTER = [_finished_lines, _ends(_SENTENCE), _lines, _ends(_CLAUSE)]
_ENTER_LINES = [_lines, _ends(_SENTENCE), _ends(_CLAUSE)]


def _entered(text: str, node: Node) -> list[Node]:
    """The children of an oversized node: its own, or the finer parts of a block."""
    if node.children:
        return node.children
    steps = _ENTER_LINES if node.kind in ("fence", "table", "pre", "row") else _ENTER
    kind, level = ("row" if node.kind in ("fence", "table", "pre", "row") else "part"), 0 if node.kind not in ("row", "part") else node.level
    for k in range(level, len(steps)):
        cuts = sorted({e for e in steps[k](text, node.start, node.end) if node.start < e < node.end})
        if cuts:
            edges = [node.start, *cuts, node.end]
            return [Node(a, b, kind, k + 1) for a, b in zip(edges, edges[1:])]
    return []


def pack(text: str, starts: list[int], node: Node, limit: int, first: int) -> list[tuple[int, int]]:
    """Consecutive spans of at most `limit` tokens from token `first`, where a heading before the node may stand, to its end."""
    end = bisect_left(starts, node.end)
    if end - first <= limit:
        return [(first, end)] if end > first else []
    units, at = [], first
    children = _entered(text, node)
    for k, child in enumerate(children):
        stop = bisect_left(starts, child.end)
        if stop <= at or (child.kind == "heading" and stop < end and stop - at < limit):
            continue  # a heading goes with the sibling after it
        units.append((at, stop, child))
        at = stop
    if len(units) == 0 or (len(units) == 1 and not children):
        count = -(-(end - first) // limit)
        edges = [first + (end - first) * i // count for i in range(count + 1)]
        return list(zip(edges, edges[1:]))
    out: list[tuple[int, int]] = []
    held = None
    for low, high, child in units:
        if high - low > limit:
            out += [held] if held else []
            held = None
            out += pack(text, starts, child, limit, low)
        elif held and high - held[0] <= limit:
            held = (held[0], high)
        else:
            out += [held] if held else []
            held = (low, high)
    return out + ([held] if held else [])


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(first token, end token, first char, char where new text begins, end char) of each piece.

    The new text of the pieces, put together, is the text. An overlap at or above the limit counts as limit - 1.
    """
    starts = [m.start() for m in TOKEN.finditer(text)]
    n = len(starts)
    if n <= limit:
        return [(0, n, 0, 0, len(text))]
    overlap = max(0, min(overlap, limit - 1))
    spans = pack(text, starts, parse(text), limit - overlap, 0)
    out = []
    for a, b in spans:
        first = max(0, a - overlap)
        out.append((first, b, starts[first] if first else 0, starts[a] if a else 0, starts[b] if b < n else len(text)))
    return out


def _pieces(batches):
    names = [part.split()[0] for part in PIECE_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), *[pa.int32()] * 11, pa.string()]
    for batch in batches:
        rows, chars = [], 0

        def flush(rows):
            columns = [*zip(*rows, strict=True)] or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for doc, source, text, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            spans = split_text(text, limit, overlap)
            if len(spans) < 2:
                continue
            total = spans[-1][1]
            for k, (first, end, char, fresh, last) in enumerate(spans):
                rows.append((doc, source, total, limit, overlap, k, len(spans), first, end, end - first, char, fresh, last, text[char:last]))
                chars += last - char
            if chars > 8_000_000:
                yield flush(rows)
                rows, chars = [], 0
        yield flush(rows)


def split_oversized(df: DataFrame, limits: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of the texts with more tokens than their source's limit; limits has (source, max_tokens, overlap_tokens).

    One row per piece, from 0: its tokens start_token..end_token of the document's doc_tokens, its characters, and the
    place fresh_char where the text not in the piece before begins. Texts within their limit, null and empty texts and
    documents of a source without a limit (or one null or below 1) yield no rows. A null overlap is 0. Of repeated limits
    the smallest holds. A source is matched as it stands; a null source has no limit. Repeated ids are cut each on their
    own, null ids too; other columns are ignored; an empty table gives an empty result.
    """
    limit = limits.select(F.col("source").cast("string").alias("source"), F.col("max_tokens").cast("int").alias("max_tokens"), F.coalesce(F.col("overlap_tokens").cast("int"), F.lit(0)).alias("overlap_tokens"))
    limit = limit.filter("source is not null and max_tokens >= 1").groupBy("source").agg(F.min(F.struct("max_tokens", "overlap_tokens")).alias("l")).select("source", "l.max_tokens", "l.overlap_tokens")
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    # A token has a character at least, so shorter texts cannot be oversized.
    return rows.join(limit, "source").filter(F.length("text") > F.col("max_tokens")).select("doc_id", "source", "text", "max_tokens", "overlap_tokens").mapInArrow(_pieces, PIECE_SCHEMA)
