"""Exact top-k search by inner product over M-trees.

Inner product becomes distance by one more coordinate: with M2 the largest squared length,
a vector x gets sqrt(M2 - |x|^2) and a query 0, so that d(q, x)^2 = |q|^2 + M2 - 2 q.x.
Components are integers, so q.x is exact and distances serve only for bounds.

Index: pivots from a bounded sample of the vectors (`SAMPLE` rows by the least hashes of
vec_id, farthest-first) are the root's entries. Every vector goes to its nearest pivot's
node, a node of more than `SHARD` vectors to several trees of about that size. A tree is one
row: inner nodes of about `FAN` pages, pages of at most `PAGE` vectors. Inner nodes and pages
have a centre, a covering radius and the distance of their centre to their parent's, vectors
their distance to the page's centre.

Search, best first: a query first descends into one tree of its nearest node, which gives a
k-th distance; then, in blocks of queries, into the trees of each node whose ball it may
reach. In a tree, one queue for each query holds inner nodes and pages by their lower bound
d(q, centre) - radius, until that passes the k-th distance. The distance to a centre or a
vector is not computed at all where the parent's, |d(q, parent) - d(x, parent)| less the
radius, already passes it. Bounds are kept with a margin for rounding, and a
bound equal to the k-th distance does not exclude, so ties are resolved by vec_id exactly.

Vectors that are null, empty or hold a null or non-finite component take no part. Vectors
meet those of their own length only. Repeated rows count once; rows with a null vec_id
don't. An empty table gives no rows; further columns are left out whatever their names.
Components beyond the range of long are taken as its ends. Inner products are exact at any
size; those beyond the range of long are given as its ends, and tie there.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, of

SAMPLE, PIVOTS = 2048, 32
SHARD, FAN, PAGE, BLOCK, TOGETHER = 8192, 8, 256, 256, 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # of a long
EXACT = 1 << 52  # inner products below this are exact in floating point
_HIT = "query_id long, vec_id long, score long"
_TREE = "dim int, node int, shard int, centre array<double>, radius double, n int, ids binary, vectors binary, to_centre binary, pages binary, inner binary"


def integers(table: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) of vectors that take part."""
    rows = of(table, vec_id="long", embedding="array<double>").where("vec_id is not null and size(embedding) > 0")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x * float(scale)).cast("long"))
    return rows.where(sound).select("vec_id", v.alias("v")).dropDuplicates(["vec_id", "v"])


def _distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of all rows of q to all rows of x, both with the extra coordinate."""
    d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)
    return np.sqrt(np.maximum(d, 0))


def lifted(v: np.ndarray, most: int) -> np.ndarray:
    """Vectors with the extra coordinate, as floats."""
    f = v.astype(float)
    return np.concatenate([f, np.sqrt(np.maximum(most - (f * f).sum(1), 0))[:, None]], axis=1)


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pivots(vectors: DataFrame, most: dict[int, int]) -> dict[int, np.ndarray]:
    """Per length of vectors, root entries chosen farthest-first from the sample."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    out = {}
    for dim in {len(r.v) for r in sample} | set(most):
        rows = np.array([r.v for r in sample if len(r.v) == dim], np.int64).reshape(-1, dim)
        if not len(rows):
            out[dim] = lifted(np.zeros((1, dim), np.int64), most[dim])
            continue
        x = lifted(rows, most[dim])
        chosen, d = [0], _distance(x[:1], x)[0]
        while len(chosen) < min(PIVOTS, max(1, len(x) // 32)):
            chosen.append(int(d.argmax()))
            d = np.minimum(d, _distance(x[chosen[-1:]], x)[0])
        out[dim] = x[chosen]
    return out


def _nearest(root):
    """(vec_id, v, dim) -> (vec_id, v, dim, node)."""

    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            node = np.zeros(b.num_rows, np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                most, centres = root.value[int(dim)]
                x = lifted(_stack(b.column(1).take(pa.array(at)), int(dim)), most)
                node[at] = _distance(x, centres).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node)], ["vec_id", "v", "dim", "node"])

    return run


def _pages(x: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Splits rows by two far-apart members until no part has more than `size`; equal rows are cut evenly."""
    todo, done = [at], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            done.append(at)
            continue
        a = at[_distance(x[at[:1]], x[at])[0].argmax()]
        b = at[_distance(x[a : a + 1], x[at])[0].argmax()]
        near = np.less(*_distance(x[[a, b]], x[at]))
        if near.all() or not near.any():
            near = np.arange(len(at)) < len(at) // 2
        todo += [at[near], at[~near]]
    return done


def _entry(x: np.ndarray, count: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of vectors x: count, covering radius, distance to the parent, centre; centre; distances to it)."""
    centre = x.mean(axis=0)
    d = _distance(centre[None], x)[0]
    return np.concatenate([[count, d.max(), _distance(centre[None], parent[None])[0, 0]], centre]), centre, d


def _tree(root):
    def run(key, rows):
        dim, node, shard = (k.as_py() for k in key)
        most, centres = root.value[dim]
        rows = rows.combine_chunks()
        v = _stack(rows.column("v").combine_chunks() if isinstance(rows.column("v"), pa.ChunkedArray) else rows.column("v"), dim)
        ids = rows.column("vec_id").to_numpy()
        x = lifted(v, most)
        inner, pages, order, to_centre = [], [], [], []
        for held in _pages(x, np.arange(len(x)), PAGE * FAN):
            parts = _pages(x, held, PAGE)
            entry, middle, _ = _entry(x[held], len(parts), centres[node])
            inner.append(entry)
            for at in parts:
                entry, _, d = _entry(x[at], len(at), middle)
                pages.append(entry)
                to_centre.append(d)
                order.append(at)
        order, centre = np.concatenate(order), centres[node]
        columns = [[dim], [node], [shard], [centre.tolist()], [float(_distance(centre[None], x).max())], [len(x)], [ids[order].astype("<i8").tobytes()], [v[order].astype("<i8").tobytes()], [np.concatenate(to_centre).tobytes()], [np.array(pages).tobytes()], [np.array(inner).tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int32(), *[pa.binary()] * 5]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split(" ")[0] for f in _TREE.split(", ")])

    return run


class _Entries:
    """Entries of one level: where their children are, and what bounds them."""

    def __init__(self, packed: bytes, dim: int):
        p = np.frombuffer(packed, float).reshape(-1, dim + 4)
        self.ends = np.cumsum(p[:, 0]).astype(int)
        self.starts = self.ends - p[:, 0].astype(int)
        self.radius, self.to_parent, self.centres = p[:, 1], p[:, 2], p[:, 3:]


class Tree:
    """A tree's row, opened. computed, skipped: distances to centres that searches needed, and did without."""

    def __init__(self, row: dict, most: int):
        self.dim, n = row["dim"], row["n"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.v = np.frombuffer(row["vectors"], "<i8").reshape(n, self.dim)
        self.to_centre = np.frombuffer(row["to_centre"], float)
        self.pages, self.inner = _Entries(row["pages"], self.dim), _Entries(row["inner"], self.dim)
        self.centre = np.array(row["centre"])
        self.most = most
        self.exact = most < EXACT
        self.f = self.v.astype(float) if self.exact else self.v.astype(object)
        self.computed = self.skipped = 0

    def _reached(self, level: _Entries, a: int, z: int, q: np.ndarray, away: float, limit: float):
        """(lower bound, entry, distance) of entries a to z within the limit; away: the query's distance to their parent."""
        low = np.abs(away - level.to_parent[a:z]) - level.radius[a:z]
        at = a + np.flatnonzero(low <= limit)
        self.computed += len(at)
        self.skipped += z - a - len(at)
        x = level.centres[at] - q
        d = np.sqrt(np.einsum("ij,ij->i", x, x))
        lower = np.maximum(d - level.radius[at], 0)
        near = lower <= limit
        return zip(lower[near].tolist(), at[near].tolist(), d[near].tolist())

    def search(self, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int):
        """(query, vec_id, score) of up to k best per query, none farther than its bound."""
        f = q.astype(float)
        norm = (f * f).sum(1)
        full = np.concatenate([f, np.zeros((len(f), 1))], axis=1)
        away = _distance(full, self.centre[None])[:, 0]
        margin = 1e-6 * (1 + np.sqrt(norm + self.most))
        for i in range(len(q)):
            best: list[tuple[int, int]] = []  # a heap of (score, -vec_id)
            limit = bound[i] + margin[i]
            use = f[i] if self.exact else q[i].astype(object)
            queue = [(low, 0, j, d) for low, j, d in self._reached(self.inner, 0, len(self.inner.ends), full[i], away[i], limit)]
            heapq.heapify(queue)
            while queue:
                low, is_page, j, d = heapq.heappop(queue)
                if low > limit:
                    break
                if not is_page:
                    for low, p, to in self._reached(self.pages, self.inner.starts[j], self.inner.ends[j], full[i], d, limit):
                        heapq.heappush(queue, (low, 1, p, to))
                    continue
                a, z = self.pages.starts[j], self.pages.ends[j]
                at = a + np.flatnonzero(np.abs(d - self.to_centre[a:z]) <= limit)
                at = at[self.ids[at] != ids[i]]
                if not len(at):
                    continue
                s = self.f[at] @ use
                if len(at) > k:
                    first = np.lexsort((self.ids[at], -s))[:k] if self.exact else sorted(range(len(at)), key=lambda x: (-s[x], self.ids[at[x]]))[:k]
                    at, s = at[first], s[first]
                for hit in zip(map(int, s.tolist()), (-self.ids[at]).tolist()):
                    if len(best) < k:
                        heapq.heappush(best, hit)
                    elif hit > best[0]:
                        heapq.heapreplace(best, hit)
                if len(best) == k:
                    limit = min(limit, np.sqrt(max(norm[i] + self.most - 2.0 * best[0][0], 0)) + margin[i])
            for s, v in best:
                yield int(ids[i]), -v, min(max(s, LEAST), MOST)


def _searched(root, k: int):
    """Rows of trees and of queries, a tree before the blocks of queries for it: the tree is opened once, when a query may reach it."""

    def run(batches):
        held, tree = None, None
        for b in batches:
            hits = []
            for row in b.to_pylist():
                if row["q_ids"] is None:
                    held, tree = row, None
                    continue
                most, _ = root.value[row["dim"]]
                ids, q = np.array(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"], "<i8").reshape(-1, row["dim"])
                bound = np.array(row["q_bounds"], float)
                away = _distance(np.concatenate([q.astype(float), np.zeros((len(q), 1))], axis=1), np.array([held["centre"]]))[:, 0]
                near = away - held["radius"] <= bound + 1e-6 * (1 + away)
                if near.any():
                    tree = tree or Tree(held, most)
                    hits += tree.search(ids[near], q[near], bound[near], k)
            x = list(zip(*hits)) if hits else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in x], ["query_id", "vec_id", "score"])

    return run


def _block(key, rows):
    dim, node, block = (k.as_py() for k in key)
    v = rows.column("v").combine_chunks()
    v = v.flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    columns = [pa.array([dim], pa.int32()), pa.array([node], pa.int32()), pa.array([block], pa.int32()), pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([v], pa.binary()), pa.array([rows.column("bound").to_pylist()], pa.list_(pa.float64()))]
    return pa.Table.from_arrays(columns, ["dim", "node", "block", "q_ids", "q_vectors", "q_bounds"])


_QUERIES = {"q_ids": "array<long>", "q_vectors": "binary", "q_bounds": "array<double>"}


def _searches(asked: DataFrame, trees: DataFrame, shards: DataFrame, root, k: int) -> DataFrame:
    """Hits of queries (vec_id, v, dim, node, bound) in all trees of their nodes. shards: (dim, node, shards) to look in.

    Queries of a node go as blocks of about BLOCK to each of its trees; a tree is sent once for TOGETHER blocks.
    """
    load = asked.groupBy("dim", "node").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    dealt = asked.join(load, ["dim", "node"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int"))
    blocks = dealt.select("dim", "node", "block", "vec_id", "v", "bound").groupBy("dim", "node", "block").applyInArrow(_block, "dim int, node int, block int, " + ", ".join(f"{c} {t}" for c, t in _QUERIES.items()))
    each = F.explode(F.expr("sequence(0, shards - 1)")).alias("shard")
    blocks = blocks.join(shards, ["dim", "node"]).select("dim", "node", F.floor(F.col("block") / TOGETHER).cast("int").alias("part"), each, *_QUERIES)
    parts = F.explode(F.expr(f"sequence(0, cast(ceil(blocks / {TOGETHER}) as int) - 1)")).alias("part")
    heads = trees.join(load.select("dim", "node", "blocks"), ["dim", "node"]).select(*trees.columns, parts)
    rows = heads.unionByName(blocks, allowMissingColumns=True).repartition("dim", "node", "shard", "part")
    return rows.sortWithinPartitions("dim", "node", "shard", "part", F.col("q_ids").isNotNull()).mapInArrow(_searched(root, k), _HIT)


def _reaches(root, radii):
    """Queries (vec_id, v, dim, bound) -> a row for each node whose ball is within the bound."""

    def run(batches):
        for b in batches:
            dims, bound = b.column(2).to_numpy(), b.column(3).to_numpy()
            take, nodes = [], []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                _, centres = root.value[int(dim)]
                q = _stack(b.column(1).take(pa.array(at)), int(dim)).astype(float)
                away = _distance(np.concatenate([q, np.zeros((len(q), 1))], axis=1), centres)
                r = radii[int(dim)]
                row, node = np.nonzero((away - r <= bound[at][:, None] + 1e-6 * (1 + away)) & (r >= 0))
                take.append(at[row])
                nodes.append(node)
            at = np.concatenate([np.zeros(0, np.int64), *take])
            out = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *nodes]).astype(np.int32))], ["vec_id", "v", "dim", "bound", "node"])

    return run


def _top(hits: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(table: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query's integers
    with those of every other vec_id, ties to the smaller vec_id.

    table, queries: vec_id and embedding.
    """
    spark = table.sparkSession
    vectors = cut(integers(table, scale).withColumn("dim", F.size("v")))
    asked = cut(integers(queries, scale).withColumn("dim", F.size("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    longest = {r.dim: int(r.most) for r in vectors.groupBy("dim").agg(F.max(norm).alias("most")).collect()}  # one row for each length of vectors
    asked = asked.where(F.col("dim").isin(*longest)) if longest else asked.limit(0)
    chosen = pivots(vectors.select("vec_id", "v"), longest)
    root = spark.sparkContext.broadcast({d: (longest[d], chosen[d]) for d in longest})

    placed = cut(vectors.select("vec_id", "v", "dim").mapInArrow(_nearest(root), "vec_id long, v array<long>, dim int, node int"))
    sizes = placed.groupBy("dim", "node").agg(F.count("*").alias("rows")).withColumn("shards", F.ceil(F.col("rows") / SHARD).cast("int")).drop("rows")
    sizes = cut(sizes)
    dealt = placed.join(sizes, ["dim", "node"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    trees = cut(dealt.select("dim", "node", "shard", "vec_id", "v").groupBy("dim", "node", "shard").applyInArrow(_tree(root), _TREE))

    radii = {d: np.full(len(chosen[d]), -1.0) for d in longest}
    for r in trees.groupBy("dim", "node").agg(F.max("radius").alias("r")).collect():  # PIVOTS rows for each length
        radii[r.dim][r.node] = r.r

    near = asked.select("vec_id", "v", "dim").mapInArrow(_nearest(root), "vec_id long, v array<long>, dim int, node int").withColumn("bound", F.lit(float("inf")))
    first = cut(_searches(near, trees.where("shard = 0"), sizes.withColumn("shards", F.lit(1)), root, k))
    kth = _top(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
    q2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    most = F.element_at(F.create_map(*[F.lit(x) for d, m in longest.items() for x in (d, float(m))]), F.col("dim")) if longest else F.lit(0.0)
    bounded = asked.join(kth, "vec_id", "left").withColumn("bound", F.when(F.col("score").isNull() | (F.col("score") == F.lit(LEAST)), float("inf")).otherwise(F.sqrt(F.greatest(q2 + most - 2.0 * F.col("score"), F.lit(0.0)))))
    reach = bounded.select("vec_id", "v", "dim", "bound").mapInArrow(_reaches(root, radii), "vec_id long, v array<long>, dim int, bound double, node int")
    return _top(_searches(reach, trees, sizes, root, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: DuckDB: every pair of query and candidate.
ORACLE = """
WITH x AS (SELECT vec_id, unnest(embedding) AS c, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id IS NOT NULL),
v AS (SELECT vec_id, list(floor(256 * CAST(c AS DOUBLE)) ORDER BY i) AS v FROM x GROUP BY vec_id
      HAVING count(*) FILTER (c IS NULL OR NOT isfinite(c)) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
