"""Where the blocks of a Markdown text are: a line automaton that runs on the documents of an Arrow batch.

It tells headings, code (fenced or indented), thematic breaks, quotes, lists and their items, HTML, pipe tables and
paragraphs apart, within quotes and list items as well. Cells, cleaning, cutting and numbering are Spark expressions
over its blocks, see ``chunking``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = re.compile(r"\r\n|\r|\n")
HEADING = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}+(?=[^`]*$)|~{3,}+)")
BREAK = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
QUOTE = re.compile(r" {0,3}> ?")
MARK = re.compile(r" {0,3}(?:([-*+])|(\d{1,9})([.)]))(?=[ \t]|$)")
TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
COLUMN = re.compile(r"(?<!\\)\|")
#: HTML that lasts until its end is found.
HTML_UNTIL = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
]
#: Any other tag at the start of a line: HTML until a blank line. A tag alone on its line does not end a paragraph.
HTML_TAG = re.compile(
    r" {0,3}</?(?:address|article|aside|body|center|details|dialog|dd|div|dl|dt|fieldset|figure|footer|form|frame|h[1-6]|head|header"
    r"|hr|html|iframe|li|link|main|menu|nav|ol|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:\s|/?>|$)", re.I
)
HTML_ALONE = re.compile(r" {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)[ \t]*$")
#: Quotes and lists deeper than this are not looked into.
DEEPEST = 20
#: Bytes of text that Python works on at once.
SLICE = 1 << 20


def _indent(line: str) -> int:
    wide = 0
    for c in line:
        if c == " ":
            wide += 1
        elif c == "\t":
            wide += 4 - wide % 4
        else:
            break
    return wide


def _without(line: str, wide: int) -> str:
    """The line without so many columns of indent; a tab that reaches further leaves blanks."""
    at = gone = 0
    while at < len(line) and gone < wide and line[at] in " \t":
        gone += 1 if line[at] == " " else 4 - gone % 4
        at += 1
    return " " * (gone - wide) + line[at:] if gone > wide else line[at:]


def _title(rest: str) -> str:
    """Heading text without closing signs, which stand alone or after a blank."""
    text = rest.strip(" \t")
    open_ = text.rstrip("#")
    return open_.rstrip(" \t") if not open_ or open_[-1] in " \t" else text


def _columns(line: str) -> int:
    inner = line.strip().removeprefix("|")
    inner = inner[:-1] if inner.endswith("|") and not inner.endswith("\\|") else inner
    return len(COLUMN.split(inner))


def _opens_table(lines: list[str], i: int) -> bool:
    return (
        i + 1 < len(lines) and "|" in lines[i] and _indent(lines[i]) < 4 and "-" in lines[i + 1]
        and TABLE_RULE.match(lines[i + 1]) is not None and _columns(lines[i]) == _columns(lines[i + 1])
    )


def _interrupts(line: str) -> bool:
    """Whether a line ends the paragraph above it."""
    if _indent(line) > 3:
        return False
    mark = MARK.match(line)
    listed = mark is not None and line[mark.end() :].strip() != "" and mark[2] in (None, "1")
    return bool(listed or HEADING.match(line) or FENCE.match(line) or BREAK.match(line) or QUOTE.match(line)
                or HTML_TAG.match(line) or any(start.match(line) for start, _ in HTML_UNTIL))


def _closes(mark: str, line: str) -> bool:
    """Whether a line is a fence of the sign of an opening one, as long at least."""
    own = line.strip(" \t")
    return _indent(line) < 4 and len(own) >= len(mark) and own == mark[0] * len(own)


def _fence_end(lines: list[str], i: int) -> int:
    """Last line of the code that is fenced from line i on."""
    mark = FENCE.match(lines[i])[1]
    return next((k for k in range(i + 1, len(lines)) if _closes(mark, lines[k])), len(lines) - 1)


class _Inner:
    """Lines of a quote or list item, and whether a line without mark or indent may go on with the last one's text."""

    def __init__(self, *lines: str) -> None:
        self.lines: list[str] = []
        self._fence: str | None = None
        for line in lines:
            self.add(line)

    def add(self, line: str) -> None:
        mark = FENCE.match(line)
        if self._fence:
            self._fence = None if _closes(self._fence, line) else self._fence
        elif mark:
            self._fence = mark[1]
        self.lines.append(line)

    def takes(self, line: str) -> bool:
        last = self.lines[-1] if self.lines else ""
        text_before = last.strip() and not self._fence and not any(p.match(last) for p in (HEADING, BREAK, FENCE))
        return bool(text_before and line.strip() and not MARK.match(line) and not _interrupts(line))


@dataclass
class Blocks:
    """Blocks found so far, as (first line, last line, kind, headings in force, lines without quote marks and indents)."""

    found: list[tuple[int, int, str, list[str], list[str]]] = field(default_factory=list)
    headings: dict[int, str] = field(default_factory=dict)
    _seen: set[tuple[int, int, str]] = field(default_factory=set)

    def heading(self, level: int, title: str) -> None:
        self.headings = {k: v for k, v in self.headings.items() if k < level} | {level: title}

    def add(self, first: int, last: int, kind: str, lines: list[str]) -> None:
        """A block; a container and its only content of the same lines are one."""
        if (first, last, kind) not in self._seen:
            self._seen.add((first, last, kind))
            self.found.append((first, last, kind, [self.headings[k] for k in sorted(self.headings)], lines))

    def walk(self, lines: list[str], base: int = 0, depth: int = 0) -> None:
        i = 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                i += 1
            elif _indent(line) > 3:
                i = self._until(lines, i, base, lambda s: not s.strip() or _indent(s) > 3)
            elif mark := HEADING.match(line):
                self.heading(len(mark[1]), _title(line[mark.end() :]))
                i += 1
            elif FENCE.match(line):
                end = _fence_end(lines, i)
                self.add(base + i, base + end, "prose", lines[i : end + 1])
                i = end + 1
            elif BREAK.match(line):
                self.add(base + i, base + i, "prose", [line])
                i += 1
            elif QUOTE.match(line):
                i = self._quote(lines, i, base, depth)
            elif MARK.match(line):
                i = self._list(lines, i, base, depth)
            elif (end := self._html_end(lines, i)) is not None:
                self.add(base + i, base + end, "prose", lines[i : end + 1])
                i = end + 1
            elif _opens_table(lines, i):
                i = self._until(lines, i, base, lambda s: s.strip() and _indent(s) < 4 and not _interrupts(s) and not MARK.match(s), "pipe", 2)
            else:
                i = self._paragraph(lines, i, base)

    def _until(self, lines: list[str], i: int, base: int, goes_on, kind: str = "prose", least: int = 1) -> int:
        end = i + least
        while end < len(lines) and goes_on(lines[end]):
            end += 1
        last = end - 1
        while not lines[last].strip():
            last -= 1
        self.add(base + i, base + last, kind, lines[i : last + 1])
        return end

    @staticmethod
    def _html_end(lines: list[str], i: int) -> int | None:
        for start, stop in HTML_UNTIL:
            if start.match(lines[i]):
                return next((k for k in range(i, len(lines)) if stop.search(lines[k])), len(lines) - 1)
        if HTML_TAG.match(lines[i]) or HTML_ALONE.match(lines[i]):
            return next((k - 1 for k in range(i + 1, len(lines)) if not lines[k].strip()), len(lines) - 1)
        return None

    def _paragraph(self, lines: list[str], i: int, base: int) -> int:
        end = i + 1
        while end < len(lines) and lines[end].strip():
            if _indent(lines[end]) < 4 and (under := UNDERLINE.match(lines[end])):
                self.heading(1 if under[1][0] == "=" else 2, " ".join(s.strip() for s in lines[i:end]))
                return end + 1
            if _interrupts(lines[end]) or _opens_table(lines, end):
                break
            end += 1
        self.add(base + i, base + end - 1, "prose", lines[i:end])
        return end

    def _quote(self, lines: list[str], i: int, base: int, depth: int) -> int:
        inner, end = _Inner(), i
        while end < len(lines) and ((mark := QUOTE.match(lines[end])) or inner.takes(lines[end])):
            inner.add(lines[end][mark.end() :] if mark else lines[end])
            end += 1
        self.add(base + i, base + end - 1, "prose", lines[i:end])
        if depth < DEEPEST:
            self.walk(inner.lines, base + i, depth + 1)
        return end

    def _list(self, lines: list[str], i: int, base: int, depth: int) -> int:
        kind = lambda m: m[1] or m[3]
        text = lambda k: next((j for j in range(k, len(lines)) if lines[j].strip()), len(lines))
        first, items, own = i, [], kind(MARK.match(lines[i]))
        while i < len(lines) and (mark := MARK.match(lines[i])) and kind(mark) == own and not BREAK.match(lines[i]):
            rest = lines[i][mark.end() :]
            gap = _indent(rest)
            wide = mark.end() + (gap if rest.strip() and gap < 5 else 1)
            inner, end = _Inner(_without(" " * mark.end() + rest, wide)), i + 1
            while end < len(lines):
                if not lines[end].strip():
                    after = text(end)
                    if after == len(lines) or _indent(lines[after]) < wide or (not rest.strip() and end == i + 1):
                        break
                    for _ in range(after - end):
                        inner.add("")
                    end = after
                elif _indent(lines[end]) >= wide:
                    inner.add(_without(lines[end], wide))
                    end += 1
                elif inner.takes(lines[end]):
                    inner.add(lines[end].lstrip())
                    end += 1
                else:
                    break
            items.append((i, end - 1, inner.lines))
            i = text(end)
        last = items[-1][1]
        self.add(base + first, base + last, "prose", lines[first : last + 1])
        for at, to, own_lines in items:
            self.add(base + at, base + to, "prose", lines[at : to + 1])
            if depth < DEEPEST:
                self.walk(own_lines, base + at, depth + 1)
        return last + 1


BLOCK = "struct<line_start:int,line_end:int,kind:string,headings:array<string>,raw:string,lines:array<string>>"


def blocks_of(text: str | None) -> list[dict]:
    """Blocks of one text in reading order, containers before their content. Lines are numbered from 1; ``raw`` are the
    lines as they stand in the text, ``lines`` those of a table without quote marks and indents."""
    whole = LINE_END.split(text or "")
    found = Blocks()
    found.walk(whole)
    return [
        {
            "line_start": first + 1, "line_end": last + 1, "kind": kind, "headings": headings,
            "raw": "\n".join(whole[first : last + 1]), "lines": lines if kind == "pipe" else None,
        }
        for first, last, kind, headings, lines in found.found
    ]


def slices(batch: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """A batch of texts in consecutive slices of about so many bytes, one text at least. An Arrow batch has thousands of
    texts, and what Python makes of them is many times as large."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // most)) + 1
    for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
        yield batch.slice(at, to - at)


def blocks(text: Column | str) -> Column:
    """Array of the blocks of a Markdown text. Bytes that are not UTF-8, which Spark keeps, become replacement characters."""
    kind = pa.list_(pa.struct([
        ("line_start", pa.int32()), ("line_end", pa.int32()), ("kind", pa.string()), ("headings", pa.list_(pa.string())),
        ("raw", pa.string()), ("lines", pa.list_(pa.string())),
    ]))

    @F.arrow_udf(f"array<{BLOCK}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield pa.array([blocks_of(s.as_py()) for s in part], type=kind)

    return run(F.make_valid_utf8(text))
