"""URL filters: a trie over reversed host labels and path segments, the longest fitting rule decides."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules go to the tasks as one trie up to these sizes, and are joined as a table beyond them.
TRIE_RULES, TRIE_CHARS = 100_000, 4_000_000
VERDICTS = ("allow", "block")

#: The rules of the query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_URL = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _pieces(path: str) -> tuple[list[str], str]:
    """Segments with their slash, and what stands after the last slash."""
    *segments, tail = path.split("/")
    return [s + "/" for s in segments], tail


class UrlTrie:
    """Rules by reversed host label, then by path segment.

    A node is a number. Below a node hang labels (a longer host), segments (a longer path) and tails: ends of rules
    that stop within a segment, the empty tail being a rule that stops at the node.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.rules: list[tuple[str, str]] = []
        self._labels: dict[tuple[int, str], int] = {}
        self._segments: dict[tuple[int, str], int] = {}
        self._tails: dict[int, dict[str, int]] = {}
        self._sizes: dict[int, list[int]] = {}
        self._with_rules: set[int] = set()
        self._nodes = 1
        for host, path, verdict in rules:
            node = 0
            for label in reversed(host.split(".")) if host else ():
                node = self._child(self._labels, node, label)
            self._with_rules.add(node)
            segments, tail = _pieces(path)
            for segment in segments:
                node = self._child(self._segments, node, segment)
            self._tails.setdefault(node, {})[tail] = len(self.rules)
            self.rules.append((host + path, verdict))
        for node, tails in self._tails.items():
            self._sizes[node] = sorted({len(t) for t in tails}, reverse=True)

    def _child(self, edges: dict[tuple[int, str], int], node: int, token: str) -> int:
        if (node, token) not in edges:
            edges[node, token] = self._nodes
            self._nodes += 1
        return edges[node, token]

    def hosts(self, host: str) -> list[int]:
        """Nodes of the host and its parents that have rules, the longest first."""
        found, node = [0] if 0 in self._with_rules else [], 0
        for label in reversed(host.split(".")) if host else ():
            node = self._labels.get((node, label))
            if node is None:
                break
            if node in self._with_rules:
                found.append(node)
        return found[::-1]

    def longest_path(self, node: int, segments: list[str], tail: str) -> int | None:
        """Number of the rule below a host's node with the longest fitting path."""
        trail = [node]
        for segment in segments:
            node = self._segments.get((node, segment))
            if node is None:
                break
            trail.append(node)
        for depth in range(len(trail) - 1, -1, -1):
            tails = self._tails.get(trail[depth])
            if tails:
                following = segments[depth] if depth < len(segments) else tail
                for size in self._sizes[trail[depth]]:
                    if size <= len(following) and following[:size] in tails:
                        return tails[following[:size]]
        return None

    def match(self, host: str, path: str, nodes: list[int] | None = None) -> int | None:
        segments, tail = _pieces(path)
        for node in self.hosts(host) if nodes is None else nodes:
            rule = self.longest_path(node, segments, tail)
            if rule is not None:
                return rule
        return None


def _clean(rules: DataFrame) -> DataFrame:
    """One row per rule: nulls as empty text, hosts lower-cased, a block where both verdicts are given."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (
        rules.where(F.col("verdict").isNotNull())
        .groupBy(ascii_lower(text("host")).alias("host"), text("path").alias("path"))
        .agg(F.max("verdict").alias("verdict"), F.min("verdict").alias("_least"))
    )


def _by_trie(pairs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    shared = pairs.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def longest(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        trie = shared.value
        encoded = hosts.dictionary_encode()
        nodes = [trie.hosts(h) for h in encoded.dictionary.to_pylist()]
        names = encoded.dictionary.to_pylist()
        found = [
            trie.match(names[i], path, nodes[i]) if nodes[i] else None
            for i, path in zip(encoded.indices.to_pylist(), paths.to_pylist(), strict=True)
        ]
        picked = [(None, None) if r is None else trie.rules[r] for r in found]
        return pa.StructArray.from_arrays([pa.array([p[0] for p in picked], pa.string()), pa.array([p[1] for p in picked], pa.string())], fields=list(kind))

    return pairs.withColumn("_found", longest("host", "path"))


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same without a limit on the rules: each pair of host and path asks for its parent hosts and for the lengths
    that paths of rules below them have. Only exact keys are joined, at most hosts x lengths rows a pair."""
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("_lengths")).withColumnRenamed("host", "_rule_host")
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = (
        urls.select("host", "path").distinct()
        .withColumn("_rule_host", F.explode(F.array_distinct(F.concat(parents, F.array(F.lit(""))))))
        .join(lengths, "_rule_host")
        .withColumn("_length", F.explode("_lengths"))
        .where(F.col("_length") <= F.length("path"))
        .withColumn("_rule_path", F.substring("path", F.lit(1), F.col("_length")))
    )
    named = rules.select(F.col("host").alias("_rule_host"), F.col("path").alias("_rule_path"), "verdict")
    order = F.struct(F.length("_rule_host"), F.length("_rule_path"))
    best = asked.join(named, ["_rule_host", "_rule_path"]).groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("_rule_host", "_rule_path").alias("rule"), "verdict"), order).alias("_found")
    )
    return urls.join(best, ["host", "path"], "left")


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", most_rules: int = TRIE_RULES, most_chars: int = TRIE_CHARS
) -> DataFrame:
    """pages with host, path, rule and verdict of every url.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's. Of the
    fitting rules the one with the longest host decides, of these the one with the longest path. Where none fits, rule
    is null and the verdict is ``default``.

    A null url, or one without ``://``, has an empty host and path, which only rules without a host and a path fit. A
    rule's null host or path is empty; an empty host fits every url. Rules without a verdict are left out, of equal
    rules with both verdicts the block stands. Without rules every url gets the default. Columns of pages named host,
    path, rule or verdict are replaced; all other columns and all rows, repeated ones too, stay.

    The rules' number and length are counted first: up to most_rules and most_chars they are sent to the tasks as one
    trie, beyond that they stay a table and are joined by exact host and path.
    """
    rules = _clean(rules.select("host", "path", "verdict"))
    n, chars, wrong = rules.agg(
        F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)),
        F.count(F.when(~F.col("verdict").isin(*VERDICTS) | ~F.col("_least").isin(*VERDICTS), 1)),
    ).first()
    if wrong or default not in VERDICTS:
        raise ValueError(f"a verdict is one of {VERDICTS}")
    source = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    urls = source.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    if url in ("host", "path", "rule", "verdict"):
        urls = urls.drop(url)
    urls = urls.withColumnsRenamed({"_host": "host", "_path": "path"})
    if n <= most_rules and chars <= most_chars:
        found = _by_trie(urls, [tuple(r) for r in rules.select("host", "path", "verdict").collect()])
    else:
        found = _by_join(urls, rules.drop("_least"))
    kept = [c for c in urls.columns if c not in ("host", "path")]
    return found.select(
        *kept, "host", "path", F.col("_found.rule").alias("rule"), F.coalesce("_found.verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
urls AS (
    SELECT page_id, row_number() OVER () AS row_no,
           coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
),
best AS (
    SELECT row_no, arg_max(rule_host || rule_path, length(rule_host) * 100000 + length(rule_path)) AS rule,
           arg_max(rule_verdict, length(rule_host) * 100000 + length(rule_path)) AS verdict
    FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY row_no
)
SELECT page_id, host, path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM urls LEFT JOIN best USING (row_no)
"""
