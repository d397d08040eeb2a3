"""URL allow and block lists: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    action: str  # allow or block
    host: str
    path: str  # the url's path starts with it


class UrlTrie:
    """Rules by host labels from the last one on, then by whole path segments; the last segment may be the start of one."""

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(("host", label), {})
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            starts = node.setdefault("starts", {})
            if last not in starts or rule.action == "block":  # of two equal rules, block holds
                starts[last] = rule

    def match(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of equally long ones that with the longer host."""
        best, node = None, self.root
        if not host:
            return None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            below = node
            for segment in segments:
                for start, rule in below.get("starts", {}).items():
                    size = (len(rule.host) + len(rule.path), len(rule.host))
                    if segment.startswith(start) and (best is None or size > best[0]):
                        best = size, rule
                below = below.get(("path", segment))
                if below is None:
                    break
        return best[1] if best else None


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that holds, or null) and verdict for every row of `pages`.

    The trie of the rules, a list the caller writes, goes to the executors; pages aren't shuffled. The longest rule
    holds, of equally long ones that with the longer host, and of equal ones block. A null url or one without :// has
    empty host and path and gets the default verdict; urls may be of any length. Repeated rows give repeated results, null ids stay
    null, an empty table gives no rows; only page_id and url are read, so other columns can't clash.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [trie.value.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            rule = pa.array([r and r.host + r.path for r in found], pa.string())
            verdict = pa.array([r.action if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*batch.schema.names, "rule", "verdict"])

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(url, shape, 2).alias("path"))
    return parts.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
