"""Ignore rules over path columns.

A rule list is ordered and its last match decides; `!` negates. Unlike git, a rule that
lets a path through works below an ignored directory too, and brackets are literal.

Each rule becomes one Java regular expression over the whole path, so a short list is a
CASE chain of constant patterns inside generated code; long lists are one automaton
(rulelist.py). Paths may use / or \\.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOOL = "tidemark"  # names the tool's own files: .<tool>-trash, .<tool>-folder, *.<tool>-tmp, *.<tool>-partial
#: Directories of version control, never exchanged.
HARD_NAMES = (".git", ".git-rewrite", ".hg", ".svn")
#: Fixed value: how conflict copies are named, a time and a device between the name and its extension.
CONFLICT_COPY = r"^(.+)\.sync-conflict-[0-9a-z]+(?:-[0-9a-z]+)?-([A-Z2-7]{10})(\.[^./]*)?$"


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool = False


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules of lines; comments and blank lines are none."""
    out = []
    for line in (x.strip() for x in lines):
        negated = line.startswith("!")
        body = line[1:] if negated else line
        if body and not line.startswith("#"):
            out.append(Rule(body, negated))
    return out


def builtin_lines(tool: str = TOOL) -> list[str]:
    return [*HARD_NAMES, f".{tool}-trash", f".{tool}-folder"]


_piece = re.compile(r"(?P<deep>(?:^|(?<=/))\*\*/)|(?P<rest>(?<=/)\*\*$)|(?P<star>\*\*?)|(?P<one>\?)|(?P<text>[^*?]+)")
_AS = {"deep": "(?:[^/]+/)*", "rest": ".*", "star": "[^/]*", "one": "[^/]"}


def _body(pattern: str) -> str:
    """The pattern as a regular expression of a relative path or segment: ** spans directories
    only next to a slash, elsewhere it is *."""
    return "".join(_AS.get(m.lastgroup) or re.sub(r"([^\w/ \-])", r"\\\1", m[0], flags=re.ASCII) for m in _piece.finditer(pattern))


def segment_regex(segment: str) -> str:
    """One segment's pattern as a regular expression of the whole segment."""
    return _body(f"/{segment}")[1:] if segment == "**" else _body(segment)


def rule_regex(rule: Rule, is_dir: bool | None = False) -> str | None:
    """A regular expression of the whole path that matches what the rule does; None if nothing.

    is_dir None: for paths that carry a trailing / when they are directories.
    """
    p = rule.pattern
    only_dirs, anchored = p.endswith("/"), p.startswith("/")
    p = p[:-1] if only_dirs else p
    p = p[1:] if anchored else p
    if not p:
        return None
    lead = "" if anchored or "/" in p else "(?:.*/)?"
    body = "[^/]+" if p == "**" and lead else _body(p)
    if is_dir is None:
        tail = "/.*" if only_dirs else "(?:/.*)?"
    else:
        tail = "/.*" if only_dirs and not is_dir else "(?:/.*)?"
    return f"(?s)^{lead}{body}{tail}$"


def _path(path: Column | str) -> Column:
    return F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/")


def hard_ignored(path: Column | str, tool: str = TOOL) -> Column:
    """Any segment is version control's or the tool's own, a conflict copy or a scratch file."""
    names = [*builtin_lines(tool)]

    def bad(s: Column) -> Column:
        low = F.lower(s)
        return low.isin(*names) | s.rlike(CONFLICT_COPY) | low.endswith(f".{tool}-tmp") | low.endswith(f".{tool}-partial")

    return F.exists(F.split(_path(path), "/"), lambda s: (s != "") & bad(s))


def deciding_rule(rules: list[Rule], path: Column | str, is_dir: Column | bool = False) -> Column:
    """struct(ord, pattern, negated) of the last rule that matches; null if none does."""
    p = _path(path)
    as_struct = lambda i, r: F.struct(F.lit(i).alias("ord"), F.lit(r.pattern).alias("pattern"), F.lit(r.negated).alias("negated"))
    out = None
    for i, r in reversed(list(enumerate(rules))):
        on = None
        if isinstance(is_dir, bool):
            if x := rule_regex(r, is_dir):
                on = p.rlike(x)
        elif (x := rule_regex(r, False)) and (y := rule_regex(r, True)):
            on = p.rlike(x) if x == y else F.when(is_dir, p.rlike(y)).otherwise(p.rlike(x))
        if on is not None:
            out = F.when(on, as_struct(i, r)) if out is None else out.when(on, as_struct(i, r))
    none = F.lit(None).cast("struct<ord:int,pattern:string,negated:boolean>")
    return none if out is None else out.otherwise(none)


def ignored(rules: list[Rule], path: Column | str, is_dir: Column | bool = False) -> Column:
    return F.coalesce(~deciding_rule(rules, path, is_dir)["negated"], F.lit(False))


def matching_rule(rules: list[Rule], path: Column | str, is_dir: Column | bool = False) -> Column:
    """Pattern of the rule that ignores the path; null if it isn't ignored."""
    last = deciding_rule(rules, path, is_dir)
    return F.when(~last["negated"], last["pattern"])


def ignored_path(rules: list[Rule], path: Column | str, is_dir: Column | bool = False, tool: str = TOOL) -> Column:
    """The gate of an exchange: hard rules first, then the list."""
    return hard_ignored(path, tool) | ignored(rules, path, is_dir)


def explain_ignore(rules: list[Rule], path: Column | str, is_dir: Column | bool = False, tool: str = TOOL) -> Column:
    """struct(ignored, hard, rule, negated_rule)."""
    last, hard = deciding_rule(rules, path, is_dir), hard_ignored(path, tool)
    return F.struct(
        (hard | F.coalesce(~last["negated"], F.lit(False))).alias("ignored"),
        hard.alias("hard"),
        F.when(~last["negated"], last["pattern"]).alias("rule"),
        F.when(last["negated"], last["pattern"]).alias("negated_rule"),
    )
