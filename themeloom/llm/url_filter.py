"""Allow and block lists of urls in a trie over reversed host labels and path segments.

A rule names a host and the start of a path. It fits its host and all subdomains, where the url's path
starts with the rule's; of the rules that fit, the one with the longest host wins, and of those the one
with the longest path. A walk down the labels from the right meets every host a rule could name, and a
walk down the segments every path, so a url costs its own length however many rules there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import free_name, query, table

#: Bytes of rule texts in one trie, which bounds the broadcast; more rules are looked up in more tries.
TRIE_BYTES = 16 * 1024 * 1024
RULES = "host string, path string, verdict string"
#: The rules of the query.
QUERY_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@dataclass
class Trie:
    """Nodes are numbers, edges a dictionary (node, label or segment) -> node; no recursion anywhere.

    A rule's path ends inside a segment: `ends` holds, for each node, the beginnings of the next segment
    at which rules end, by length.
    """

    edges: dict[tuple[int, str], int] = field(default_factory=dict)
    paths: dict[int, int] = field(default_factory=dict)  # node of a host -> first node of its paths
    ends: dict[int, dict[str, tuple[str, str]]] = field(default_factory=dict)
    lengths: dict[int, list[int]] = field(default_factory=dict)  # longest first
    nodes: int = 1

    def _step(self, node: int, label: str) -> int:
        at = self.edges.setdefault((node, label), self.nodes)
        self.nodes += at == self.nodes
        return at

    def add(self, host: str, path: str, verdict: str) -> None:
        """One rule; the same host and path allowed and blocked counts as blocked."""
        node = 0
        for label in reversed(host.split(".")) if host else ():
            node = self._step(node, label)
        if node not in self.paths:
            self.paths[node] = self.nodes
            self.nodes += 1
        node = self.paths[node]
        *whole, tail = path.split("/")
        for segment in whole:
            node = self._step(node, segment)
        ends = self.ends.setdefault(node, {})
        if ends.get(tail, ("", ""))[1] != "block":
            ends[tail] = (host + path, verdict)
        self.lengths[node] = sorted({len(t) for t in ends}, reverse=True)

    def hosts(self, host: str) -> list[tuple[int, int]]:
        """(labels, first node of the paths) of all hosts with rules that this host is or lies under, longest first."""
        found = [(0, self.paths[0])] if 0 in self.paths else []
        node = 0
        for n, label in enumerate(reversed(host.split(".")), 1):
            node = self.edges.get((node, label))
            if node is None:
                break
            if node in self.paths:
                found.append((n, self.paths[node]))
        return found[::-1]

    def find(self, hosts: Sequence[tuple[int, int]], path: str) -> tuple[int, int, str, str] | None:
        """(labels of the host, characters of the path, rule, verdict) of the longest rule that fits."""
        segments = path.split("/")
        for labels, node in hosts:
            best, before = None, 0
            for segment in segments:
                for length in self.lengths.get(node, ()):
                    end = self.ends[node].get(segment[:length]) if length <= len(segment) else None
                    if end is not None:
                        best = (labels, before + length, *end)
                        break
                node = self.edges.get((node, segment))
                if node is None:
                    break
                before += len(segment) + 1
            if best:
                return best
        return None


def build_trie(rules: Sequence[tuple[str, str, str]]) -> Trie:
    trie = Trie()
    for host, path, verdict in rules:
        trie.add(host, path, verdict)
    return trie


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A to Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


FOUND = "labels int, chars int, rule string, verdict string"


def _lookup(spark: SparkSession, rules: Sequence[tuple[str, str, str]]):
    trie = spark.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf(FOUND)
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tree = trie.value
        for hosts, paths in batches:
            known: dict[str, list] = {}  # of this batch only
            rows = []
            for host, path in zip(hosts, paths, strict=True):
                if host not in known:
                    known[host] = tree.hosts(host)
                rows.append(tree.find(known[host], path) or (None, None, None, None))
            yield pd.DataFrame(rows, columns=["labels", "chars", "rule", "verdict"]).astype(
                {"labels": "Int32", "chars": "Int32", "rule": object, "verdict": object}
            )

    return look


def rule_blocks(rules: DataFrame, trie_bytes: int = TRIE_BYTES) -> list[list[tuple[str, str, str]]]:
    """The distinct rules on the driver, in blocks of at most trie_bytes of text (or one rule).

    Rules are read in one sorted stream, so that a block holds neighbours and all entries of one host and
    path are in one block.
    """
    clean = rules.select(
        F.translate(F.coalesce("host", F.lit("")), ascii_uppercase, ascii_lowercase).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.lower("verdict").alias("verdict"),
    ).distinct()
    blocks: list[list[tuple[str, str, str]]] = [[]]
    size, last = 0, None
    for r in clean.orderBy("host", "path", "verdict").toLocalIterator():
        if r.verdict not in ("allow", "block"):
            raise ValueError(f"a rule's verdict is allow or block, not {r.verdict}")
        if size > trie_bytes and (r.host, r.path) != last:
            blocks.append([])
            size = 0
        blocks[-1].append((r.host, r.path, r.verdict))
        size += len(r.host) + len(r.path)
        last = (r.host, r.path)
    return blocks


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """`pages` with host, path, rule and verdict (underscores before a name that is taken).

    rules: (host, path, verdict), the verdict allow or block. A rule's host is compared label by label and
    its path by its beginning, so `/de` fits `/deutsch`; an empty host fits every url, an empty path every
    path; null is empty. Upper-case hosts are lowered, ports and user names stay part of the host. A rule
    both allowed and blocked blocks. Without a fitting rule the verdict is `default`: allow, as entries name
    what to keep out and the exceptions from that. A null url, or one without `://`, has an empty host and
    path. Every row comes back once, repeated rows too; there is no shuffle. Rules beyond trie_bytes are
    looked up in several tries one after the other, and the best of their answers counts.
    """
    names = {x: free_name(pages.columns, x) for x in ("host", "path", "rule", "verdict")}
    hit = free_name(pages.columns, "hit")
    source = F.col(f"`{url}`")
    parts = pages.withColumns({names["host"]: host_of(source), names["path"]: path_of(source)})
    parts = parts.fillna("", [names["host"], names["path"]])
    finds = [_lookup(pages.sparkSession, block)(names["host"], names["path"]) for block in rule_blocks(rules, trie_bytes)]
    found = finds[0]
    if len(finds) > 1:  # structs compare by labels, then characters; a missing answer is least
        found = F.greatest(*[F.when(f["labels"].isNotNull(), f) for f in finds])
    judged = parts.withColumn(hit, found)
    return judged.withColumns(
        {names["rule"]: F.col(hit)["rule"], names["verdict"]: F.coalesce(F.col(hit)["verdict"], F.lit(default))}
    ).drop(hit)


def _rules_sql() -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in QUERY_RULES)


@query(
    "op11_url_filter",
    f"""WITH rules(r_host, r_path, r_verdict) AS (VALUES {_rules_sql()}),
        rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
                 FROM pages),
        parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                    translate(regexp_extract(rest, '^[^/?#]*'), '{ascii_uppercase}', '{ascii_lowercase}') AS host FROM rest)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM (SELECT p.*, r_host || r_path AS rule, r_verdict AS verdict,
                row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) DESC NULLS LAST, length(r_path) DESC) AS place
              FROM parts p LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
        WHERE place = 1""",
)
def op11_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(QUERY_RULES, RULES)
    pages = table(spark, sf, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")
