"""Version vectors: map<string,bigint> columns, an absent device counting 0.

Vectors are a partial order, so nothing here sorts or maximises them; canonical() is the
form to join or group by. A null vector is the empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "cast(map() as map<string,bigint>)"


def _v(v: Column | str) -> Column:
    return F.coalesce(F.col(v) if isinstance(v, str) else v, F.expr(EMPTY))


def compare_versions(a: Column | str, b: Column | str) -> Column:
    """equal, a-newer, b-newer or concurrent."""
    a, b = _v(a), _v(b)
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    at = lambda v, k: F.coalesce(F.try_element_at(v, k), F.lit(0))
    a_covers = F.forall(keys, lambda k: at(a, k) >= at(b, k))
    b_covers = F.forall(keys, lambda k: at(b, k) >= at(a, k))
    return F.when(a_covers & b_covers, "equal").when(a_covers, "a-newer").when(b_covers, "b-newer").otherwise("concurrent")


def increment_version(v: Column | str, device: Column | str) -> Column:
    """v with one more for a device (a literal name or a column)."""
    v, d = _v(v), F.lit(device) if isinstance(device, str) else device
    rest = F.map_filter(v, lambda k, _: k != d)
    return F.map_concat(rest, F.create_map(d, F.coalesce(F.try_element_at(v, d), F.lit(0)) + F.lit(1)))


def merge_versions(a: Column | str, b: Column | str) -> Column:
    """The larger count of each device."""
    return F.map_zip_with(_v(a), _v(b), lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def canonical(v: Column | str) -> Column:
    """Entries sorted by device, zeros left out: equal exactly if the vectors are."""
    return F.array_sort(F.map_entries(F.map_filter(_v(v), lambda _, n: n != 0)))


def vectors_equal(a: Column | str, b: Column | str) -> Column:
    """Structurally equal: the same devices with the same counts."""
    return F.array_sort(F.map_entries(_v(a))) == F.array_sort(F.map_entries(_v(b)))


def merge_groups(df: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """(*keys, version): the merge of all vectors of each group, by partial aggregation."""
    long = df.select(*keys, F.explode_outer(version).alias("device", "n"))
    each = long.groupBy(*keys, "device").agg(F.max("n").alias("n"))
    some = F.filter(F.collect_list(F.struct("device", "n")), lambda e: e["device"].isNotNull())
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(some)).alias("version"))


def compare_file_state(l_there: Column, r_there: Column, l_version: Column | str, r_version: Column | str) -> Column:
    """local-newer, remote-newer, conflict or equal for two sides that may be missing."""
    relation = compare_versions(l_version, r_version)
    return (
        F.when(l_there & ~r_there, "local-newer")
        .when(~l_there & r_there, "remote-newer")
        .when(~l_there & ~r_there, "equal")
        .when(relation == "a-newer", "local-newer")
        .when(relation == "b-newer", "remote-newer")
        .when(relation == "concurrent", "conflict")
        .otherwise("equal")
    )
