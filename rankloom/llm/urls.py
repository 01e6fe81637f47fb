"""Allow and block lists for urls: a broadcast trie over reversed host labels and path segments.

A rule is ``host/path``; it fits its host and all subdomains if the url's path starts with the rule's path. Of all rules
that fit, the longest wins (host and path together, on a tie the longer host); if the same rule is in both lists, block
wins. The trie holds the caller's rule list and nothing of the data, so its size is the list's.

Defined results: a null url, or one without ``://``, has an empty host and path; without a fitting rule ``rule`` is null
and ``verdict`` the default. Rows are judged one by one; repeated rows stay, extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import by_batch

UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
PARTS = re.compile(r"([^/?#]*)([^?#]*)")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host, with A-Z in lower case, and path of a url."""
    if url is None or "://" not in url:
        return "", ""
    host, path = PARTS.match(url, url.index("://") + 3).groups()
    return host.translate(UPPER), path


class RuleTrie:
    """Nested dictionaries: by host label from the right, then by whole path segment, then by begun segment."""

    def __init__(self, allow: Iterable[str] = (), block: Iterable[str] = ()):
        self.root: dict = {}
        for verdict, rules in (("allow", allow), ("block", block)):
            for rule in rules:
                self._add(rule, verdict)

    def _add(self, rule: str, verdict: str) -> None:
        host, slash, rest = rule.partition("/")
        node = self.root
        for label in reversed(host.translate(UPPER).split(".")):
            node = node.setdefault("labels", {}).setdefault(label, {})
        *whole, begun = (slash + rest).split("/")
        node = node.setdefault("paths", {})
        for segment in whole:
            node = node.setdefault("segments", {}).setdefault(segment, {})
        node.setdefault("begun", {})[begun] = (rule, verdict)

    @staticmethod
    def _longest_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for segment in segments:
            fitting = [b for b in node.get("begun", ()) if segment.startswith(b)]
            if fitting:
                found = node["begun"][max(fitting, key=len)]
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict."""
        best, segments, node = None, path.split("/"), self.root
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            found = self._longest_path(node["paths"], segments) if "paths" in node else None
            if found and (best is None or len(found[0]) >= len(best[0])):
                best = found
        return best


def judged(
    pages: DataFrame,
    allow: Iterable[str],
    block: Iterable[str],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule, verdict of every row. Nothing is shuffled."""
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(list(allow), list(block)))
    schema = pa.schema(
        [(id_col, pa.int64()), *((n, pa.string()) for n in ("host", "path", "rule", "verdict"))]
    )

    def work(batch: pa.RecordBatch) -> dict:
        parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
        found = [trie.value.match(*p) for p in parts]
        return {
            id_col: batch.column(0),
            "host": [h for h, _ in parts],
            "path": [p for _, p in parts],
            "rule": [f and f[0] for f in found],
            "verdict": [f[1] if f else default for f in found],
        }

    wanted = pages.select(F.col(id_col).cast("bigint").alias(id_col), F.col(url_col).cast("string").alias(url_col))
    return wanted.mapInArrow(by_batch(work, schema), f"{id_col} bigint, host string, path string, rule string, verdict string")
