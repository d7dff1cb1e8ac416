"""Allow and block lists for addresses, matched in one broadcast trie.

The trie goes down the labels of the host from the right, then the segments of
the path. Of the rules that fit, the one with the most host labels decides, and
of those the one with the longest path; of equal rules, block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rules up to which their trie may be sent to every task.
MAX_RULE_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str  # allow or block


class _Node:
    """A place in the trie: labels below it, path segments below it, and the
    rules whose last path segment begins here."""

    __slots__ = ("labels", "segments", "ends")

    def __init__(self):
        self.labels, self.segments, self.ends = {}, {}, {}


class Trie:
    def __init__(self, rules: list[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.labels.setdefault(label, _Node())
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            old = node.ends.get(last)
            if old is None or rule.verdict == "block":
                node.ends[last] = rule

    def match(self, host: str, path: str) -> Rule | None:
        """The deciding rule for a host and path, if any."""
        node, found = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            found = self._longest(node, segments) or found
        return found

    @staticmethod
    def _longest(node: _Node, segments: list[str]) -> Rule | None:
        found = None
        for segment in segments:
            fits = [end for end in node.ends if segment.startswith(end)]
            if fits:
                found = node.ends[max(fits, key=len)]
            node = node.segments.get(segment)
            if node is None:
                break
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` with A-Z in lower case, and the path;
    both empty without ``://`` or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _judged(trie, default: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [trie.value.match(h, p) if h else None for h, p in zip(frame["host"], frame["path"], strict=True)]
            frame["rule"] = [f"{r.host}{r.path}" if r else None for r in found]
            frame["verdict"] = [r.verdict if r else default for r in found]
            yield frame

    return run


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Judges every url by the longest rule that fits.

    ``pages`` has page_id and url; other columns are ignored. A rule fits its
    host and all its subdomains where the url's path starts with the rule's.
    Returns one row per row: page_id, host, path, rule (host and path of the
    rule, or null), verdict (the rule's, else ``default``).

    A null, empty or malformed url has empty host and path and gets the default.
    Repeated rows are judged alike. The trie is sent to every task, so rules
    beyond MAX_RULE_BYTES are refused.
    """
    if sum(len(r.host.encode()) + len(r.path.encode()) for r in rules) > MAX_RULE_BYTES:
        raise ValueError("the rules are too large for a broadcast trie")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    schema = T.StructType([*split.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return split.mapInPandas(_judged(trie, default), schema)
