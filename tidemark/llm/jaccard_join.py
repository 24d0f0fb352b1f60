"""N-gram Jaccard self-join by a token-group matrix.

1. Texts become sets of hashed word shingles. Equal sets are one class, named by its
   smallest doc_id; copies are never paired with each other.
2. Classes are partitioned into groups of similar ones. Classes with one of `HASHES` MinHash
   values in common form a bucket. Its head is the class with the smallest share of tokens
   that no other text has: in a cluster of near copies, the one nearest to the middle. A class
   joins the first of its buckets' heads with which its estimated similarity (`BINS` minima)
   is high enough, and with it that one's group.
   Any partition gives the same result; a good one puts each cluster into one group.
3. The token-group matrix has a row (token, group, smallest and largest set) for each token
   of the union of a group's prefixes. Prefixes follow one global order, rare tokens first:
   a class of n shingles shares at least ceil(t * n) with any partner, so its first
   n - ceil(t * n) + 1 tokens must meet the partner's. The order comes from a frequency
   sketch of bounded size, so frequent passages, and what copies of one text share, stay out
   of prefixes as far as can be; any order would be exact.
4. A query class meets the groups that own one of its prefix tokens and fit in size; the
   number of prefix tokens met bounds its overlap with every class of the group, and only
   groups that reach the bound are opened: one of a single class by verifying the pair, a
   larger one in blocks.
5. Blocks: the classes of a group among themselves, and queries against an opened group, are
   verified block against block, by products of 0/1 matrices. Blocks are as large as memory
   allows (`BLOCK_TOKENS`, `BLOCK_SETS`), so a class is sent to few. A pair is met in one
   place only. Spanning links and sums of links leave the task, never all pairs.

No cap is set anywhere: a link is missed only if two 64-bit hashes collide within a pair.
Rows with a null doc_id or an empty set take no part in links. Rows that share a doc_id are
versions of one document: a link of one joins it to a component. Links are counted for each
text of a doc_id. Columns besides doc_id and text are left out whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, maybe_in, of, spread, written
from ._text import mix, shingle_sets
from .components import components

MAX_CELLS = 1 << 24  # of the frequency sketch: 16 MB on the driver and in each task, at most
SHARDS, FAN = 64, 8
BLOCK_TOKENS, BLOCK_SETS = 1 << 20, 2048  # of a block of classes (8 MB), but for one larger class
HASHES, BINS = 8, 32  # MinHash values by which classes meet; minima by which similarity is estimated
_ODD = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def _packed(shard: int, salt: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["shard", "salt", "counts"])


def _counts(k: int, cells: int):
    """Each task's document counts of hashed tokens, up to 255, as compressed shards."""

    def run(batches):
        counts, wide = np.zeros(cells, np.uint8), cells // SHARDS
        for b in batches:
            for _, s in shingle_sets(b.column(0), k):
                at = (s & np.uint64(cells - 1)).astype(np.int64)
                seen = counts[at]
                counts[at] = seen + (seen < 255)
        for shard in range(SHARDS):
            part = counts[shard * wide : (shard + 1) * wide]
            if part.any():
                yield _packed(shard, TaskContext.get().partitionId() % FAN, part)

    return run


def _summed(kind, classes: bool):
    """Adds up shards, streaming; at last gives each cell's class, the bits of its count."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for shard, _, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                x = np.frombuffer(zlib.decompress(x), kind).astype(np.uint32)
                sums[shard] = sums[shard] + x if shard in sums else x
        for shard, x in sums.items():
            yield _packed(shard, 0, np.ceil(np.log2(x + 1.0)).astype(np.uint8) if classes else x)

    return run


def token_order(docs: DataFrame, k: int):
    """Broadcast of each sketch cell's frequency class. Its size follows the input's up to MAX_CELLS."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << 16
    while 8 * cells < size and cells < MAX_CELLS:
        cells *= 2
    kind, wide = "shard int, salt int, counts binary", cells // SHARDS
    parts = docs.select("text").mapInArrow(_counts(k, cells), kind)
    parts = parts.repartition("shard", "salt").mapInArrow(_summed(np.uint8, False), kind)
    parts = parts.repartition("shard").mapInArrow(_summed(np.uint32, True), kind)
    order = np.zeros(cells, np.uint8)
    for r in parts.toLocalIterator():  # SHARDS rows
        order[r.shard * wide : (r.shard + 1) * wide] = np.frombuffer(zlib.decompress(r.counts), np.uint8)
    return docs.sparkSession.sparkContext.broadcast(order)


def _fingerprint(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes(), usedforsecurity=False).digest()


def _bins(h: np.ndarray) -> np.ndarray:
    """The least hash in each of BINS equal ranges, 32 bits of each; 0 where there is none."""
    h = np.sort(h)
    at = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(59))
    out = (h[np.minimum(at, len(h) - 1)] >> np.uint64(27)).astype(np.uint32) | np.uint32(1)
    return np.where(np.diff(np.append(at, len(h))) > 0, out, np.uint32(0)).astype(np.uint32).view(np.int32)


def _signatures(k: int, num: int, den: int, order):
    def run(batches):
        for b in batches:
            n, fp, rare, mins, bins, prefix = [], [], [], [], [], []
            for _, s in shingle_sets(b.column(1), k):
                n.append(len(s))
                fp.append(_fingerprint(s))
                h = mix(s ^ np.uint64(0x632BE59BD9B4E019))
                mins.append((h[None, :] * _ODD[:, None]).min(axis=1).astype(np.int64).tolist() if len(s) else None)
                bins.append(_bins(h) if len(s) else None)
                p = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                rank = order.value[(s & np.uint64(len(order.value) - 1)).astype(np.int64)]
                rare.append(int(1000 * np.count_nonzero(rank < 2)) // max(len(s), 1))
                prefix.append(s[np.argsort(rank, kind="stable")[:p]].astype(np.int64))
            ends = np.cumsum([0, *map(len, prefix)])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefix])))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(rare, pa.int32()), pa.array(mins, pa.list_(pa.int64())), pa.array(bins, pa.list_(pa.int32())), tokens]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "fp", "rare", "mins", "bins", "prefix"])

    return run


def _verified(k: int, num: int, den: int):
    """Rows (a, b, ta, tb) whose texts are similar, as (a, b, fa, fb) with the sets' fingerprints."""

    def run(batches):
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        for b in batches:
            left = shingle_sets(b.column(2), k)
            ids = b.column(1).to_pylist()
            ok, fa, fb = np.zeros(len(ids), bool), [], []
            right = _cached(b.column(3), ids, k, kept)
            for i, ((_, x), y) in enumerate(zip(left, right)):
                if len(x) and len(y) and den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = den * both >= num * (len(x) + len(y) - both)
                    if ok[i]:
                        fa.append(_fingerprint(x))
                        fb.append(_fingerprint(y))
            a, b = (b.column(j).filter(pa.array(ok)) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(fa, pa.binary()), pa.array(fb, pa.binary())], ["a", "b", "fa", "fb"])

    return run


def _cached(texts: pa.Array, ids: list, k: int, kept: OrderedDict):
    """Sets of texts in order; runs of one text (a hot leader) are hashed once."""
    last, value = None, None
    for i, _ in enumerate(ids):
        text = texts[i]
        key = (ids[i], len(text.as_buffer()) if text.is_valid else -1)
        if key != last:
            value = kept.get(key)
            if value is None:
                value = next(s for _, s in shingle_sets(texts.slice(i, 1), k))
                kept[key] = value
                if len(kept) > 64:
                    kept.popitem(last=False)
            last = key
        yield value


def _sets(k: int):
    def run(batches):
        for b in batches:
            found = [(_fingerprint(s), s.tobytes()) for _, s in shingle_sets(b.column(1), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[j] for x in found], pa.binary()) for j in (0, 1))], ["doc_id", "fp", "tokens"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 1 << 11) -> np.ndarray:
    """Shared tokens of each set of left and each of right, by products of 0/1 matrices of `width` tokens."""
    out = np.zeros((len(left), len(right)))
    entries = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (x, xi), (y, yi) = entries(left), entries(right)
    known = np.intersect1d(x, y)
    sides = []
    for tokens, at in ((x, xi), (y, yi)):
        place = np.searchsorted(known, tokens)
        hit = place < len(known)
        hit[hit] = known[place[hit]] == tokens[hit]
        place, at = place[hit], at[hit]
        order = np.argsort(place, kind="stable")
        sides.append((place[order], at[order]))
    for lo in range(0, len(known), width):
        parts = []
        for (place, at), n in zip(sides, out.shape):
            a, b = np.searchsorted(place, (lo, lo + width))
            m = np.zeros((n, min(width, len(known) - lo)), np.float32)
            m[at[a:b], place[a:b] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def spanning(ok: np.ndarray) -> list[tuple[int, int, int]]:
    """Links that join up each component of a bipartite graph: (row, 0, column) or (row, 1, row)."""
    rows, columns, out = np.zeros(ok.shape[0], bool), np.zeros(ok.shape[1], bool), []
    for i in np.flatnonzero(ok.any(axis=1)).tolist():
        if rows[i]:
            continue
        rows[i], new = True, np.array([i])
        while len(new):
            reached = np.flatnonzero(ok[new].any(axis=0) & ~columns)
            columns[reached] = True
            new = np.flatnonzero(ok[:, reached].any(axis=1) & ~rows) if len(reached) else reached
            rows[new] = True
            out += [(i, 0, j) for j in reached.tolist()] + [(i, 1, j) for j in new.tolist()]
    return out


_MET = "fp binary, n_links long, a long, b long"


def _met(num: int, den: int, count: bool):
    """Of two blocks of classes (or one, against itself): weights of similar classes, added up for each, and spanning links."""

    def run(key, rows):
        side, weight, ids = (rows.column(c).to_numpy() for c in ("side", "w", "doc_id"))
        fp = rows.column("fp").to_pylist()
        sets = [np.frombuffer(t, np.uint64) for t in rows.column("tokens").to_pylist()]
        one = np.flatnonzero(side == 0)
        two = one if key[1] == key[2] else np.flatnonzero(side == 1)
        out = []
        if len(one) and len(two):
            both, sizes = overlaps([sets[i] for i in one], [sets[i] for i in two]), np.array([len(s) for s in sets])
            ok = den * both >= num * (sizes[one][:, None] + sizes[two][None, :] - both)
            if two is one:
                np.fill_diagonal(ok, False)
            out += [(None, None, int(ids[one[i]]), int(ids[one[j] if same else two[j]])) for i, same, j in spanning(ok)]
            if count:
                for at, sums in ((one, ok @ weight[two]), (two, weight[one] @ ok))[: 1 if two is one else 2]:
                    out += [(fp[i], n, None, None) for i, n in zip(at[sums > 0].tolist(), sums[sums > 0].tolist())]
        x = list(zip(*out)) or [()] * 4
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(x, (pa.binary(), *[pa.int64()] * 3))], ["fp", "n_links", "a", "b"])

    return run


def opened_groups(docs: DataFrame, classes: DataFrame, asked: DataFrame, words: int, num: int, den: int, count: bool) -> DataFrame:
    """Rows of _MET: the classes of each group among themselves, and the classes asked against their groups.

    classes: (doc_id, fp, n, g, w); asked: (g, a), g of several classes.
    """
    groups = classes.groupBy("g").agg(F.count("*").alias("members"), F.sum("n").alias("n_held")).where("members > 1")
    asked = cut(asked.join(classes.drop("g").withColumnRenamed("doc_id", "a"), "a").withColumnRenamed("a", "doc_id"))
    queries = asked.groupBy("g").agg(F.count("*").alias("queries"), F.sum("n").alias("n_asked"))
    blocks = lambda n, rows: F.coalesce(F.ceil(F.greatest(F.col(n) / BLOCK_TOKENS, F.col(rows) / BLOCK_SETS)).cast("int"), F.lit(0))
    groups = cut(groups.join(queries, "g", "left").select("g", blocks("n_held", "members").alias("nb"), blocks("n_asked", "queries").alias("nq")))
    members = cut(classes.join(groups, "g"))
    ids = members.select("doc_id").unionByName(asked.select("doc_id"))
    known = maybe_in(docs.where("doc_id is not null"), "doc_id", ids).where("maybe").select("doc_id", "text")
    known = written(known.mapInArrow(_sets(words), "doc_id long, fp binary, tokens binary").dropDuplicates(["doc_id", "fp"]))

    block = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    keyed = lambda i, j, s: [F.col("g"), i.alias("i"), j.alias("j"), s.alias("side"), F.col("doc_id"), F.col("fp"), F.col("w")]
    inside = members.withColumn("at", block("nb")).withColumn("to", F.explode(F.expr("sequence(0, nb + nq - 1)")))
    inside = inside.select(*keyed(F.least("at", "to"), F.greatest("at", "to"), F.when(F.col("to") < F.col("at"), 1).otherwise(0)))
    outside = asked.join(groups, "g").withColumn("to", F.explode(F.expr("sequence(0, nb - 1)")))
    outside = outside.select(*keyed(F.col("to"), F.col("nb") + block("nq"), F.lit(1)))
    met = inside.unionByName(outside).join(known, ["doc_id", "fp"]).select("g", "i", "j", "side", "doc_id", "fp", "w", "tokens")
    return cut(met.groupBy("g", "i", "j").applyInArrow(_met(num, den, count), _MET))


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, ta, tb); texts that no pair needs stay out of the shuffle."""

    def texts(side: str) -> DataFrame:
        near = maybe_in(docs.where("doc_id is not null"), "doc_id", pairs.select(side)).where("maybe")
        return near.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}"))

    return pairs.join(texts("a"), "a").join(texts("b"), "b").select("a", "b", "ta", "tb")


def token_group_matrix(rows: DataFrame) -> DataFrame:
    """(token, g, large, lo, hi) from prefix tokens of classes (token, a, n, g, big)."""
    return rows.groupBy("token", "g").agg(F.max("big").alias("large"), F.min("n").alias("lo"), F.max("n").alias("hi"))


def _need(n, lo, hi, num: int, den: int):
    """Least number of matching prefix tokens of a class of n shingles and a similar one of lo to hi.

    Similar classes of n and m share at least s = ceil(num * (n + m) / (num + den)). Up to the
    earlier end of both prefixes every shared token is matched and at most n - s (or m - s)
    are not, so matches are at least s - ceil(t * n) + 1, or the same with m. The first rises
    with m and the second falls; over several m one is taken off for rounding.
    """
    share = lambda m: F.ceil(num * (n + m) / (num + den))
    least = lambda m: F.ceil(num * m / den)
    return F.least(share(lo) - least(n), share(hi) - least(hi)) + F.when(lo == hi, 1).otherwise(0)


def bounded_groups(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, g): classes and the groups that they may be similar to.

    Of two groups, one's classes ask for the other: a class alone for a group of several, else
    the larger id for the smaller, so the classes of a cluster don't each ask for what is left
    over of it. Matches with a group's union bound those with any of its classes from above.
    """
    matrix = token_group_matrix(rows)
    asked = rows.withColumnRenamed("g", "own")
    turn = (~F.col("big") & F.col("large")) | ((F.col("big") == F.col("large")) & (F.col("own") > F.col("g")))
    fits = turn & (den * F.col("n") >= num * F.col("lo")) & (num * F.col("n") <= den * F.col("hi"))
    met = asked.join(matrix, "token").where(fits).groupBy("a", "g", "n").agg(F.count("*").alias("met"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return met.where(F.col("met") >= _need(F.col("n"), F.col("lo"), F.col("hi"), num, den)).select("a", "g").distinct()


def _without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key isn't in ids (a column of the same name); the rest of df stays out of the shuffle."""
    marked = maybe_in(df, key, ids)
    return marked.where("not maybe").unionByName(marked.where("maybe").join(ids, key, "left_anti")).drop("maybe")


def grouped_classes(live: DataFrame, copies: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): class a belongs to the group named b; other classes are groups of their own, those of a doc_id with several texts too."""
    several = live.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x < y").select("doc_id")
    apart = cut(copies.select("doc_id").unionByName(several).distinct())
    first = written(_without(live.select("doc_id", "n", "rare", "mins", "bins"), "doc_id", apart).withColumnRenamed("doc_id", "a"))
    place = lambda rare, a: F.struct(rare, F.xxhash64(a).alias("o"), F.col(a).alias("head"))
    keyed = first.select("a", "rare", F.posexplode("mins").alias("r", "v"))
    buckets = keyed.groupBy("r", "v").agg(F.min(place("rare", "a"))["head"].alias("b"), F.count("*").alias("size"))
    buckets = cut(buckets.where("size > 1").select("r", "v", "b"))
    met = maybe_in(keyed, "v", buckets.select("v")).where("maybe").join(buckets, ["r", "v"]).where("a <> b")
    met = cut(met.select("a", "b").distinct())

    near = met.join(maybe_in(first, "a", met.select("a")).where("maybe").select("a", "n", "bins"), "a")
    heads = maybe_in(first, "a", met.select("b")).where("maybe")
    near = near.join(heads.select(F.col("a").alias("b"), F.col("n").alias("nb"), F.col("rare").alias("rb"), F.col("bins").alias("to")), "b")
    near = near.where(den * F.least("n", "nb") >= num * F.greatest("n", "nb"))
    pairs = F.arrays_zip("bins", "to")
    same = F.size(F.filter(pairs, lambda x: (x["bins"] == x["to"]) & (x["to"] != 0)))
    seen = F.size(F.filter(pairs, lambda x: (x["bins"] != 0) | (x["to"] != 0)))
    near = near.where(10 * den * same >= (10 * num - 4 * den) * seen)
    led = cut(near.groupBy("a").agg(F.min(place("rb", "b"))["head"].alias("b")))
    while True:  # heads that have a head themselves hand their classes on; each comes before its classes, so this ends
        up = led.select(F.col("a").alias("b"), F.col("b").alias("to"))
        moved = cut(led.join(up, "b", "left").select("a", F.coalesce("to", "b").alias("b"), F.col("to").isNotNull().alias("moved")))
        led = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return led


def jaccard_links(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles) of all documents, and links (a, b) that join up each component.

    The links are spanning ones, not all; with `count`, rows have n_links, the number of all.

    Two documents are similar when den * |intersection| >= num * |union|.
    """
    docs = spread(of(docs, doc_id="long", text="string"))
    kinds = "doc_id long, n long, fp binary, rare int, mins array<long>, bins array<int>, prefix array<long>"
    sigs = written(docs.mapInArrow(_signatures(words, num, den, token_order(docs, words)), kinds))
    live = sigs.where("doc_id is not null and n > 0")
    firsts = cut(live.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last"))
    copies = cut(live.select("doc_id", "fp").join(firsts, "fp").where("doc_id > rep"))
    led = grouped_classes(live, copies, num, den)

    led = cut(led.withColumnRenamed("a", "doc_id").unionByName(led.select(F.col("b").alias("doc_id"), "b").distinct()))  # heads too
    marked = maybe_in(live.select("doc_id", "fp", "n", "prefix"), "doc_id", copies.select("doc_id").unionByName(led.select("doc_id")))
    alone = marked.where("not maybe").select("doc_id", "fp", "n", "prefix", F.col("doc_id").alias("g"), F.lit(False).alias("big"))
    grouped = marked.where("maybe").join(copies, ["doc_id", "fp"], "left_anti").join(led, "doc_id", "left")
    grouped = grouped.select("doc_id", "fp", "n", "prefix", F.coalesce("b", "doc_id").alias("g"), F.col("b").isNotNull().alias("big"))
    classes = alone.unionByName(grouped)
    rows = classes.select(F.explode("prefix").alias("token"), F.col("doc_id").alias("a"), F.col("n").cast("int"), "g", "big")
    shared = rows.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x < y").select("token")
    rows = cut(maybe_in(rows, "token", cut(shared)).where("maybe").drop("maybe"))
    candidates = cut(bounded_groups(rows, num, den))

    weights = copies.select("doc_id", "fp").distinct().groupBy("fp").agg((1 + F.count("*")).alias("w"))
    classes = cut(classes.select("doc_id", "fp", "n", "g").distinct().join(weights, "fp", "left").fillna(1, ["w"]))
    several = cut(classes.groupBy("g").agg(F.count("*").alias("members")).where("members > 1").select("g"))
    pairs = candidates.join(several, "g", "left_anti").select("a", F.col("g").alias("b"))
    found = cut(_with_texts(cut(pairs), docs).mapInArrow(_verified(words, num, den), "a long, b long, fa binary, fb binary").distinct())
    opened = opened_groups(docs, classes, candidates.join(several, "g", "left_semi").select("g", "a"), words, num, den, count)

    links = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).unionByName(found.select("a", "b")).unionByName(opened.where("a is not null").select("a", "b"))
    out = sigs.select("doc_id", F.col("n").alias("n_shingles"))
    if count:
        weight = lambda s: classes.select(F.col("fp").alias(f"f{s}"), F.col("doc_id").alias(s), F.col("w").alias(f"w{s}"))
        each = found.join(weight("a"), ["a", "fa"]).join(weight("b"), ["b", "fb"])
        sums = weights.select("fp", (F.col("w") - 1).alias("n_links")).unionByName(opened.where("fp is not null").select("fp", "n_links"))
        sums = sums.unionByName(each.groupBy(F.col("fa").alias("fp")).agg(F.sum("wb").alias("n_links")))
        sums = cut(sums.unionByName(each.groupBy(F.col("fb").alias("fp")).agg(F.sum("wa").alias("n_links"))).groupBy("fp").agg(F.sum("n_links").alias("n_links")))
        n_links = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
        out = sigs.select("doc_id", "fp", F.col("n").alias("n_shingles")).join(sums, "fp", "left").select("doc_id", "n_shingles", n_links.alias("n_links"))
    return out, links


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, count: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and,
    with `count`, n_links (other documents with a similar text, exact copies among them).

    An empty or null text is alone; a null doc_id gives a null component_id; an empty table
    gives no rows.
    """
    rows, links = jaccard_links(docs, words, num, den, count)
    of_node = components(links, "a", "b").select(F.col("node").alias("doc_id"), "component")
    return rows.join(of_node, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), *(["n_links"] if count else []))


def without_near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without every document that another of its group comes before; rows with null doc_id stay."""
    gone = near_duplicates(docs, words, num, den, count=False).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
