"""Named knowledge-base operators with checked arguments: ``name -> (bounds, function)``."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .operators import nearest, search, sections


@dataclass(frozen=True)
class Operator:
    fn: Callable[..., DataFrame]
    summary: str
    bounds: dict[str, tuple[int, int | None]] = field(default_factory=dict)


# The names of the operators. With them the least (and, where there is one, largest) values of the size arguments.
REGISTRY: dict[str, Operator] = {
    "semantic_search": Operator(nearest.semantic_search, "chunks closest to a vector", {"top_k": (1, None)}),
    "exact_search": Operator(search.exact_search, "chunks holding a text", {"limit": (1, None)}),
    "multi_term_exact_search": Operator(search.multi_term_search, "chunks by number of matched terms", {"limit": (1, None)}),
    "search_section_by_name": Operator(
        sections.search_sections, "sections by name, meaning, spelling or content",
        {"limit": (1, None), "semantic_top_k": (1, None), "fuzzy_top_k": (1, None)},
    ),
    "regex_search": Operator(search.regex_search, "pattern matches", {"max_results": (1, None)}),
    "search_abbreviation": Operator(search.find_expansions, "what an abbreviation stands for", {"max_results": (1, None)}),
    "read_table": Operator(search.read_table, "table rows as maps", {"limit": (1, None)}),
    "get_section_content": Operator(search.section_content, "whole text of a section"),
    "list_sections": Operator(sections.list_sections, "sections with chunk counts"),
    "get_neighbor_chunks": Operator(search.neighbor_chunks, "chunks around a line", {"before": (0, None), "after": (0, None)}),
    "get_chunks_by_index": Operator(search.chunks_by_index, "chunks by index"),
    "list_sources": Operator(sections.list_sources, "sources with chunk counts"),
    "list_all_sections": Operator(sections.list_leaf_sections, "last breadcrumb levels"),
}

def summaries() -> dict[str, str]:
    return {name: op.summary for name, op in REGISTRY.items()}


def check(name: str, args: dict) -> None:
    """Raise ``ValueError`` for unknown names, unknown or missing arguments and sizes out of bounds."""
    if name not in REGISTRY:
        raise ValueError(f"unknown operator {name!r}; known: {', '.join(REGISTRY)}")
    op = REGISTRY[name]
    parameters = list(inspect.signature(op.fn).parameters.values())[1:]
    known = {p.name for p in parameters}
    unknown = set(args) - known
    if unknown:
        raise ValueError(f"{name}: unknown arguments {sorted(unknown)}")
    missing = [p.name for p in parameters if p.default is p.empty and p.name not in args]
    if missing:
        raise ValueError(f"{name}: missing arguments {missing}")
    for arg, (low, high) in op.bounds.items():
        value = args.get(arg)
        if value is not None and (value < low or (high is not None and value > high)):
            raise ValueError(f"{name}: {arg} must be at least {low}" + (f" and at most {high}" if high is not None else "") + f", got {value}")
    if name == "get_chunks_by_index" and not args["indices"]:
        raise ValueError(f"{name}: indices must have a member")
    if name == "get_neighbor_chunks" and args["line"] < 1:
        raise ValueError(f"{name}: line must be at least 1")


def call(name: str, chunks: DataFrame, **args) -> DataFrame:
    check(name, args)
    return REGISTRY[name].fn(chunks, **args)
