"""Rule files of a tree as data: which of them count, and what they decide for each path.

Priority rises from built-in lines over the root's file and nested files, by depth, to a caller's own lines; the
last match decides. A nested file speaks for what lies below its directory, with patterns as if that were the
root. It counts only if no directory down to its own is ignored by what counts above, and if its directory's name
can be written in a pattern (no * ? [ ] or \\).

Rule files of any number stay a table. If all their patterns together are small (FEW_BYTES) they go to every task and
no path is shuffled; otherwise paths are dealt to the files above them, in salted parts, each part headed by the file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.functions.ignore import TOOL, Rule, builtin_lines, deciding_rule, hard_ignored, parse_rules
from tidemark.functions.rulelist import RuleList
from tidemark.operators.common import KEYS, ancestors
from tidemark.session import ship_package

FILE = ["folder_id", "dir"]
UNSAFE = r"[*?\[\]\\]"
FEW_BYTES = 8 << 20
SALTS = 32
_RULES = "array<struct<pattern:string,negated:boolean>>"
_FOUND = "struct<dir:string,pattern:string,negated:boolean>"


def rule_files(lines: DataFrame) -> DataFrame:
    """(folder_id, dir, rules) of the lines (folder_id, dir, line_no, line) of rule files; dir "" at the root."""
    text = F.trim(F.regexp_replace("line", r"[\s]+$|^[\s]+", ""))
    bare = F.when(text.startswith("!"), F.substring(text, 2, 1 << 30)).otherwise(text)
    rule = F.struct("line_no", bare.alias("pattern"), text.startswith("!").alias("negated"))
    each = lines.where((bare != "") & ~text.startswith("#")).groupBy(*FILE).agg(F.array_sort(F.collect_list(rule)).alias("l"))
    return each.select(*FILE, F.transform("l", lambda r: F.struct(r["pattern"].alias("pattern"), r["negated"].alias("negated"))).alias("rules"))


@lru_cache(256)
def _compiled(rules: tuple[tuple[str, bool], ...]) -> RuleList:
    return RuleList([Rule(*r) for r in rules])


class _Above:
    """The lists that speak for a path, the deepest last."""

    def __init__(self, tool: str):
        base = tuple((r.pattern, r.negated) for r in parse_rules(builtin_lines(tool)))
        self.lists = [("", base, _compiled(base))]

    def add(self, directory: str, rules: Iterable[dict]) -> None:
        listed = tuple((r["pattern"], r["negated"]) for r in rules)
        self.lists.append((directory, listed, _compiled(listed)))

    def verdict(self, path: str, is_dir: bool) -> tuple[str, str, bool] | None:
        for directory, listed, compiled in reversed(self.lists):
            at = compiled.last_match(path[len(directory) + 1 :] if directory else path, is_dir)
            if at >= 0:
                return directory, *listed[at]
        return None


def _chains(directory: str) -> list[str]:
    """"", then each directory down to this one."""
    parts = directory.split("/") if directory else []
    return ["", *("/".join(parts[: i + 1]) for i in range(len(parts)))]


def active_rule_files(files: DataFrame, tool: str = TOOL) -> DataFrame:
    """Those of rule_files() that count. Each file meets the files above it, as many as its directory is deep."""
    ship_package(files.sparkSession)
    rules = files.select(*FILE, F.col("rules").cast(_RULES).alias("rules"))
    can = rules.where(~F.col("dir").rlike(UNSAFE) & ~hard_ignored("dir", tool))
    up = F.concat(F.when(F.col("dir") != "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), ancestors("dir"))
    over = can.select("folder_id", F.col("dir").alias("_of"), F.explode(up).alias("dir")).join(can, FILE)
    over = over.groupBy("folder_id", F.col("_of").alias("dir")).agg(F.collect_list(F.struct("dir", "rules")).alias("above"))

    @arrow_udf("boolean")
    def counts(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def one(directory, above):
            by, on = {a["dir"]: a["rules"] for a in above or ()}, _Above(tool)
            for place in _chains(directory):
                if place:
                    found = on.verdict(place, True)
                    if found and not found[2]:
                        return False
                if place in by:
                    on.add(place, by[place])
            return True

        for dirs, above in columns:
            yield pa.array([one(d, a) for d, a in zip(dirs.to_pylist(), above.to_pylist())], pa.bool_())

    return can.join(over, FILE, "left").where(counts("dir", "above")).select(*FILE, "rules")


def _by_table(paths: DataFrame, known: dict[tuple[str, str], list], tool: str) -> DataFrame:
    @arrow_udf(_FOUND)
    def decide(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("dir", pa.string()), ("pattern", pa.string()), ("negated", pa.bool_())])

        @lru_cache(1024)
        def above(folder: str, parent: str) -> _Above:
            on = _Above(tool)
            for place in _chains(parent):
                if (folder, place) in known:
                    on.add(place, known[folder, place])
            return on

        for folders, names, dirs in columns:
            out = []
            for folder, path, is_dir in zip(folders.to_pylist(), names.to_pylist(), dirs.to_pylist()):
                found = above(folder, path.rpartition("/")[0]).verdict(path, bool(is_dir)) if path else None
                out.append(found and dict(zip(("dir", "pattern", "negated"), found)))
            yield pa.array(out, kind)

    return paths.withColumn("rule", decide("folder_id", "path", "_is_dir"))


def _dealt(tool: str):
    names = ["folder_id", "path", "_is_dir", "depth", "rule"]
    kind = pa.struct([("dir", pa.string()), ("pattern", pa.string()), ("negated", pa.bool_())])

    def run(batches):
        at, listed, compiled = None, (), None
        for b in batches:
            out = []
            for folder, directory, salt, rules, path, is_dir in zip(*(b.column(i).to_pylist() for i in range(6))):
                if rules is not None:
                    at, listed = (folder, directory, salt), tuple((r["pattern"], r["negated"]) for r in rules)
                    compiled = _compiled(listed)
                elif at == (folder, directory, salt):
                    place = compiled.last_match(path[len(directory) + 1 :] if directory else path, bool(is_dir))
                    if place >= 0:
                        out.append((folder, path, is_dir, directory.count("/") + 1 if directory else 0, {"dir": directory, "pattern": listed[place][0], "negated": listed[place][1]}))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), (pa.string(), pa.string(), pa.bool_(), pa.int32(), kind))], names)

    return run


def _by_deal(paths: DataFrame, active: DataFrame, tool: str) -> DataFrame:
    keys = [*KEYS, "_is_dir"]
    each = paths.select(*keys).distinct().withColumn("dir", F.explode(F.concat(F.array(F.lit("")), ancestors("path"))))
    each = each.select(*FILE, F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast(_RULES).alias("rules"), "path", "_is_dir")
    heads = active.select(*FILE, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "rules", F.lit(None).cast("string").alias("path"), F.lit(None).cast("boolean").alias("_is_dir"))
    rows = heads.unionByName(each).repartition(*FILE, "salt").sortWithinPartitions(*FILE, "salt", F.col("rules").isNull())
    found = rows.mapInArrow(_dealt(tool), f"folder_id string, path string, _is_dir boolean, depth int, rule {_FOUND}")
    deepest = found.groupBy(*keys).agg(F.max_by("rule", "depth").alias("rule"))
    base = deciding_rule(parse_rules(builtin_lines(tool)), "path", F.col("_is_dir"))
    built_in = F.when(base.isNotNull(), F.struct(F.lit("").alias("dir"), base["pattern"].alias("pattern"), base["negated"].alias("negated")))
    return paths.join(deepest, keys, "left").withColumn("rule", F.coalesce("rule", built_in))


def rules_for(paths: DataFrame, files: DataFrame, own_lines: list[str] = (), is_dir: Column | None = None, tool: str = TOOL, few_bytes: int = FEW_BYTES) -> DataFrame:
    """paths (folder_id, path, ...) with `rule`, struct(dir, pattern, negated): the one that decides, null if none does.

    files: rule_files() of all folders. dir is null for own lines. The hard rules are not asked here (ignored_by_files does).
    """
    ship_package(paths.sparkSession)
    active = active_rule_files(files, tool)
    given = paths.withColumn("_is_dir", F.lit(False) if is_dir is None else F.coalesce(is_dir, F.lit(False)))
    size = F.sum(F.aggregate("rules", F.lit(0).cast("long"), lambda n, r: n + F.octet_length(r["pattern"]) + 32) + F.octet_length("dir"))
    if (active.agg(size).first()[0] or 0) <= few_bytes:
        known = {(r["folder_id"], r["dir"]): [x.asDict() for x in r["rules"]] for r in active.collect()}  # of a checked size
        out = _by_table(given, known, tool)
    else:
        out = _by_deal(given, active, tool)
    own = deciding_rule(parse_rules(list(own_lines)), "path", F.col("_is_dir"))
    mine = F.when(own.isNotNull(), F.struct(F.lit(None).cast("string").alias("dir"), own["pattern"].alias("pattern"), own["negated"].alias("negated")))
    return out.withColumn("rule", F.coalesce(mine, "rule")).drop("_is_dir")


def ignored_by_files(paths: DataFrame, files: DataFrame, own_lines: list[str] = (), is_dir: Column | None = None, tool: str = TOOL, few_bytes: int = FEW_BYTES) -> DataFrame:
    """rules_for() with `ignored`: the hard rules, else what the deciding rule says."""
    out = rules_for(paths, files, own_lines, is_dir, tool, few_bytes)
    return out.withColumn("ignored", hard_ignored("path", tool) | F.coalesce(~F.col("rule.negated"), F.lit(False)))


def composed_rules(lines: DataFrame, own_lines: list[str] = (), tool: str = TOOL) -> DataFrame:
    """(folder_id, layer, depth, dir, line_no, line) of all lines that count, as they read from the root; order by the columns.

    layer: 0 built-in, 1 root, 2 nested, 3 own. Comments stay, as in the files.
    """
    active = active_rule_files(rule_files(lines), tool).select(*FILE).unionByName(lines.where("dir = ''").select(*FILE)).distinct()
    kept = lines.join(active, FILE)
    bare = F.trim("line")
    negated = bare.startswith("!")
    body = F.when(negated, F.substring(bare, 2, 1 << 30)).otherwise(bare)
    core = F.regexp_replace(body, "/$", "")
    inner = F.when(core.startswith("/"), F.substring(core, 2, 1 << 30)).when(core.contains("/") | (core == "**"), core).otherwise(F.concat(F.lit("**/"), core))
    nested = F.concat(F.when(negated, "!").otherwise(""), F.col("dir"), F.lit("/"), inner, F.when(body.endswith("/"), "/").otherwise(""))
    line = F.when((F.col("dir") == "") | (core == "") | bare.startswith("#"), F.col("line")).otherwise(nested)
    depth = F.size(F.split("dir", "/"))
    out = kept.select("folder_id", F.when(F.col("dir") == "", 1).otherwise(2).alias("layer"), F.when(F.col("dir") == "", 0).otherwise(depth).alias("depth"), "dir", F.col("line_no").cast("int").alias("line_no"), line.alias("line"))
    fixed = [(0, i, x) for i, x in enumerate(builtin_lines(tool))] + [(3, i, x) for i, x in enumerate(own_lines)]
    listed = F.array(*[F.struct(F.lit(a).alias("layer"), F.lit(0).alias("depth"), F.lit("").alias("dir"), F.lit(i).alias("line_no"), F.lit(x).alias("line")) for a, i, x in fixed])
    return out.unionByName(lines.select("folder_id").distinct().select("folder_id", F.inline(listed)))
