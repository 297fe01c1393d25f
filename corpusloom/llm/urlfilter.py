"""URL allow and block rules in a trie over reversed host labels and path segments.

A rule's host is stored label by label from the right, its path segment by segment below the host
it belongs to. Walking a URL down the trie meets every rule that fits; the one with the most host
labels wins, and among those the one with the longest path, whether it allows or blocks. A rule's
path that doesn't end at a slash fits any continuation of its last segment.

The trie holds the rules only, and goes to the executors as a broadcast; above ``max_rules`` it is
refused (rules are a hand-kept list, not data).

Cases: a null URL or one without ``://`` has an empty host and path and gets the default verdict;
of two rules for the same host and path the later one wins; an empty rule list gives every URL
the default. Extra columns stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, held

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class _Node:
    __slots__ = ("labels", "paths")

    def __init__(self):
        self.labels: dict[str, _Node] = {}
        self.paths: _Path | None = None


class _Path:
    """Whole segments lead on; ``rule`` ends here; ``starts`` are beginnings of the next segment."""

    __slots__ = ("segments", "rule", "starts")

    def __init__(self):
        self.segments: dict[str, _Path] = {}
        self.rule: Rule | None = None
        self.starts: dict[str, Rule] = {}


class Trie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.labels.setdefault(label, _Node())
            at = node.paths = node.paths or _Path()
            *whole, last = rule.path.split("/")
            for segment in whole:
                at = at.segments.setdefault(segment, _Path())
            if last:
                at.starts[last] = rule
            else:
                at.rule = rule

    @staticmethod
    def _longest(at: _Path, path: str) -> Rule | None:
        best, segments = at.rule, path.split("/")
        for i, segment in enumerate(segments):
            fitting = [s for s in at.starts if segment.startswith(s)]
            if fitting:
                best = at.starts[max(fitting, key=len)]
            if i == len(segments) - 1 or segment not in at.segments:  # the last one has no slash after it
                return best
            at = at.segments[segment]
            best = at.rule or best
        return best

    def find(self, host: str, path: str) -> Rule | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            if (node := node.labels.get(label)) is None:
                break
            if node.paths:
                best = self._longest(node.paths, path) or best
        return best


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", max_rules: int = 1_000_000) -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict of the column ``url``,
    in a struct column, ``free_name(pages, "url_verdict")``."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are broadcast")
    shared, name = pages.sparkSession.sparkContext.broadcast(list(rules)), uuid.uuid4().hex

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def judge(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        trie = held(("urls", name), lambda: Trie(shared.value))
        found = [trie.find(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array([r and r.name for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())], names=["rule", "verdict"]
        )

    url, kept = F.col("url"), pages.columns
    # in a struct of their own, the columns of `pages` can't clash with ours
    split = pages.select(F.struct(*kept).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = split.select("*", judge(F.col("host"), F.col("path")).alias("found"))
    return judged.select(*[F.col("row")[c].alias(c) for c in kept], F.struct("host", "path", "found.rule", "found.verdict").alias(free_name(pages, "url_verdict")))
