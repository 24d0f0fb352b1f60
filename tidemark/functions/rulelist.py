"""Long rule lists as one automaton over a path's segments.

The rules share a trie: a node's literal segments are found by a dictionary, segments with wildcards by their
literal end or beginning where they have one. A path is read once, segment by segment, with the set of
nodes that it may be at; a rule's end is noted by its place in the list, and the largest place decides. So
the work follows the path, and hardly the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.functions.ignore import Rule, segment_regex

_glob = re.compile(r"[*?]")


class _Node:
    __slots__ = ("literal", "ends", "begins", "other", "deep", "rest", "loops", "last", "last_dir")

    def __init__(self, loops: bool = False):
        self.literal: dict[str, _Node] = {}
        self.ends: dict[int, dict[str, _Node]] = {}  # *text, by the text's length
        self.begins: dict[int, dict[str, _Node]] = {}  # text*
        self.other: list[tuple[re.Pattern, str, _Node]] = []
        self.deep: _Node | None = None  # any number of segments, none too
        self.rest: _Node | None = None  # one segment or more, to the pattern's end
        self.loops = loops
        self.last = self.last_dir = -1  # places of the last rule that ends here; of those for directories only

    def child(self, segment: str) -> _Node:
        if not _glob.search(segment):
            return self.literal.setdefault(segment, _Node())
        bare = segment.replace("**", "*")
        for side, text in ((self.ends, bare[1:]), (self.begins, bare[:-1])):
            if bare.count("*") == 1 and "?" not in bare and bare == (f"*{text}" if side is self.ends else f"{text}*"):
                return side.setdefault(len(text), {}).setdefault(text, _Node())
        for _, known, node in self.other:
            if known == segment:
                return node
        node = _Node()
        self.other.append((re.compile(segment_regex(segment), re.S), segment, node))
        return node

    def next(self, segment: str) -> Iterator[_Node]:
        if found := self.literal.get(segment):
            yield found
        for side, cut in ((self.ends, lambda n: segment[len(segment) - n :]), (self.begins, lambda n: segment[:n])):
            for n, texts in side.items():
                if n <= len(segment) and (found := texts.get(cut(n))):
                    yield found
        for pattern, _, node in self.other:
            if pattern.fullmatch(segment):
                yield node


def _reached(nodes: set[_Node]) -> set[_Node]:
    """nodes, and what any number of segments leads to, none too."""
    for node in list(nodes):
        while node.deep:
            node = node.deep
            nodes.add(node)
    return nodes


class RuleList:
    """last_match(path, is_dir): the place of the last rule that matches, or -1; as the chain of deciding_rule()."""

    def __init__(self, rules: Sequence[Rule]):
        self.start = _Node()
        self.start.deep = _Node(loops=True)
        for i, rule in enumerate(rules):
            self._add(i, rule.pattern)

    def _add(self, place: int, pattern: str) -> None:
        only_dirs, anchored = pattern.endswith("/"), pattern.startswith("/")
        p = pattern[: len(pattern) - only_dirs]
        p = p[1:] if anchored else p
        if not p:
            return
        parts = p.split("/")
        node = self.start
        if not anchored and len(parts) == 1:
            node = node.deep
            parts = ["?*"] if parts == ["**"] else parts
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part == "**" and not last:
                if node.deep is None:
                    node.deep = _Node(loops=True)
                node = node.deep
            elif part == "**" and last and k:
                if node.rest is None:
                    node.rest = _Node(loops=True)
                node = node.rest
            else:
                node = node.child(part)
        if only_dirs:
            node.last_dir = place
        else:
            node.last = place

    def last_match(self, path: str, is_dir: bool = False) -> int:
        segments = path.replace("\\", "/").split("/")
        best = -1
        on = _reached({self.start})
        for i, segment in enumerate(segments):
            inner = is_dir or i < len(segments) - 1
            then = set()
            for node in on:
                if node.loops and segment:
                    then.add(node)
                for found in node.next(segment):
                    then.add(found)
                if node.rest:
                    then.add(node.rest)
            for node in _reached(then):
                best = max(best, node.last, node.last_dir if inner else -1)
            on = then
            if not on:
                break
        return best


def last_rule(rules: Sequence[Rule]) -> Callable[..., Column]:
    """A column function (path, is_dir) of the place of the last rule that matches, -1 if none does."""
    rules = list(rules)

    @arrow_udf("int")
    def place(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        listed = RuleList(rules)
        for paths, dirs in columns:
            yield pa.array([None if p is None else listed.last_match(p, bool(d)) for p, d in zip(paths.to_pylist(), dirs.to_pylist())], pa.int32())

    def of(path: Column | str, is_dir: Column | bool = False) -> Column:
        return place(F.col(path) if isinstance(path, str) else path, F.lit(is_dir) if isinstance(is_dir, bool) else is_dir)

    return of
