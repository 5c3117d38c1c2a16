"""Table functions for SQL: ``register(spark)``, then ``SELECT * FROM chunk_markdown(TABLE(corpus))``."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .functions.text import MARKDOWN_CLEANUP, WHITE_SPACE
from .operators import chunking
from .operators.markdown import blocks_of

_CLEANUP = [(re.compile(pattern), replacement.replace("$", "\\")) for pattern, replacement in MARKDOWN_CLEANUP]
_PIPE = re.compile(r"(?<!\\)\|")
_GRID = re.compile(chunking.GRID_EDGE)


def _clean(text: str) -> str:
    for pattern, replacement in _CLEANUP:
        text = pattern.sub(replacement, text)
    return text.strip(WHITE_SPACE)


def _pipe_rows(lines: list[str]) -> list[list[str]]:
    inner = [re.sub(r"^\||(?<!\\)\|$", "", line.strip(WHITE_SPACE)) for i, line in enumerate(lines) if i != 1]
    return [[_clean(cell.replace("\\|", "|")) for cell in _PIPE.split(line)] for line in inner]


def _grid_rows(lines: list[str]) -> list[list[str]]:
    columns = list(pairwise(i for i, c in enumerate(lines[0]) if c == "+"))
    edges = [i for i, line in enumerate(lines) if line.lstrip(" ").startswith("+") and "-" in line]
    rows: list[list[str]] = []
    for top, bottom in pairwise(edges):
        held = [line.rstrip(" ") for line in lines[top + 1 : bottom] if line.lstrip(" ").startswith("|")]
        cells = [" ".join(x for x in (line[a + 1 : z].strip(WHITE_SPACE) for line in held) if x) for a, z in columns]
        if any(cells) and (not rows or cells != rows[0]):
            rows.append(cells)
    return [[_clean(cell) for cell in row] for row in rows]


def _chunks(text: str | None, size: int, overlap: int) -> Iterator[tuple]:
    """(section, line_start, line_end, type, headers, content) in reading order."""
    dumped = lambda cells: json.dumps(cells, ensure_ascii=False, separators=(",", ":"))
    for block in blocks_of(text):
        raw = block["raw"].strip(WHITE_SPACE)
        section = " > ".join(_clean(re.sub(r"[*`]|__", "", h)) for h in block["headings"])
        at = section, block["line_start"], block["line_end"]
        grid = block["kind"] == "prose" and _GRID.match(raw.split("\n", 1)[0])
        if not raw:
            continue
        if block["kind"] == "pipe" or grid:
            rows = _grid_rows(raw.split("\n")) if grid else _pipe_rows(block["lines"])
            if len(rows) < 2:
                yield *at, "table_raw", "", raw
                continue
            header, wide = dumped(rows[0]), len(rows[0])
            yield *at, "table_full", header, raw
            for row in rows[1:]:
                yield *at, "table_row", header, dumped((row + [""] * wide)[:wide])
        elif clean := _clean(raw):
            yield *at, "paragraph_full", "", clean
            for piece in chunking.cut_by_size(clean, size, overlap):
                yield *at, "", "", piece


class ChunkMarkdown:
    """``chunking.chunk_markdown`` of a table (doc, source, text), row by row and over Arrow batches. ``doc`` is a text."""

    def eval(self, row: Row, size: int = chunking.CHUNK_SIZE, overlap: int = chunking.CHUNK_OVERLAP) -> Iterator[tuple]:
        numbers: dict[tuple[str, str], int] = {}
        for section, first, last, kind, headers, content in _chunks(row["text"], size, overlap):
            number = numbers.get((section, kind), 0 if kind == "table_row" else 1)
            numbers[section, kind] = number + 1
            doc = None if row["doc"] is None else str(row["doc"])
            yield doc, row["source"], section, first, last, kind, headers, content, number


CHUNK_COLUMNS = "doc string, source string, section string, line_start int, line_end int, chunk_type string, table_headers string, content string, chunk_index int"


def register(spark: SparkSession) -> None:
    """Make ``chunk_markdown(TABLE(corpus) [, size, overlap])`` known to the session's SQL."""
    spark.udtf.register("chunk_markdown", udtf(ChunkMarkdown, returnType=CHUNK_COLUMNS, useArrow=True))
