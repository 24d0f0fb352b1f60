"""Mixing of sources to target weights by weighted fair queueing.

Sources, by code point with null last, weigh 3, 1, 2, 3, 1, 2, ... and share a budget of 150 % of all
words. A source's target stops at EPOCHS times its size; what is over goes to the others by
weight until no target is above (so far as sources have words, targets add up to the budget).

Each source is a queue: its documents in an order shuffled by hash, EPOCHS times over. A document's virtual
finish time is the source's words up to its end, divided by the source's target. All are
sorted by that time over the whole input and taken until the budget is used up. A
document in which its source's target ends is two packets, the first of which
finishes at time 1, so each source gets its target but for rounding, in any prefix
of the mix its share but for a document.

Sums over an order (ordered_sums) are sums of range partitions: the order is split by ranges of the sort
keys, also within a source, so no source is one task, and only a total for each partition meets in one.

Null texts have no words; documents without words are never taken. A null doc_id is shuffled as an empty
one. Repeated rows are documents each for itself; which of two equal rows is taken is the
same. An empty table gives no rows. Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, of

#: Fixed values of the task: weights in order of sources, share of all words, times that a document may be taken.
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
EPOCHS = 2
SPACE = r" \t\n\x0B\f\r"
FEW = 10_000  # sources whose table is sent to all executors; more are joined by shuffle


def _sums(names: list[str]):
    def run(batches):
        at = TaskContext.get().partitionId()
        carry = np.zeros(len(names), np.int64)
        for b in batches:
            columns = list(b.columns)
            for k, c in enumerate(names):
                v = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(v) + carry[k]
                columns.append(pa.array(total - v))
                carry[k] = total[-1] if len(v) else carry[k]
            columns.append(pa.array(np.full(b.num_rows, at, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, *(f"{c}_before" for c in names), "_part"])

    return run


def ordered_sums(df: DataFrame, order: list, *names: str) -> DataFrame:
    """df with <name>_before for each name: the sum of that long column over all rows before, by `order`.

    Equal rows may stand in any order. One range shuffle; the sorted rows are kept in the shared folder,
    since a lost partition that were sorted anew could have other bounds.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    totals = ranged.groupBy(F.spark_partition_id().alias("_part")).agg(*[F.sum(c).alias(f"_{c}") for c in names])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in names])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{c}_before` long" for c in names] + ["_part int"])
    out = ranged.mapInArrow(_sums(list(names)), schema).join(F.broadcast(base), "_part")
    return out.select(*df.columns, *[(F.col(f"{c}_before") + F.col(f"_{c}")).alias(f"{c}_before") for c in names])


def n_words(text: str):
    """Number of runs of other than white space, as a column: each, with the space behind it, becomes one letter."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+", "")
    return F.char_length(F.regexp_replace(inner, f"[^{SPACE}]+[{SPACE}]*", "x")).cast("long")


def targets(sources: DataFrame) -> tuple[DataFrame, int]:
    """(source, rank, source_size, target, base) of (source, source_size), and the budget.

    With caps and weights summed over sources in order of cap to weight, the level (words for a unit of
    weight) is the largest of (share of all words - caps so far) / (weights not yet capped). The budget is the
    share in whole words. base: words of the sources before.
    """
    kinds = F.array(*map(F.lit, WEIGHTS))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = ordered_sums(sources.withColumn("one", F.lit(1).cast("long")), order, "one", "source_size")
    ranked = ranked.select("source", F.col("one_before").alias("rank"), "source_size", F.col("source_size_before").alias("base"))
    ranked = cut(ranked.withColumn("weight", F.element_at(kinds, (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")))
    every = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    budget = every["words"] * SHARE[0] // SHARE[1]
    cap = (F.col("source_size") * EPOCHS).alias("cap")
    filling = ordered_sums(ranked.select("rank", "weight", cap), [F.col("cap") / F.col("weight"), F.col("rank")], "cap", "weight")
    left = F.lit(every["words"] * SHARE[0]) - SHARE[1] * F.col("cap_before")
    level = filling.agg(F.max(left.cast("double") / (SHARE[1] * (F.lit(every["weights"]) - F.col("weight_before"))).cast("double"))).first()[0]
    target = F.least((F.col("source_size") * EPOCHS).cast("double"), F.lit(level or 0.0) * F.col("weight").cast("double"))
    return ranked.select("source", "rank", "source_size", target.alias("target"), "base"), budget


def packets(docs: DataFrame, shares: DataFrame) -> DataFrame:
    """What the queues send: a row for each document and time that it is taken, two where its source's target ends.

    docs: (doc_id, source, size, key, tie). Gives rank, place (of the document in its source's queue), doc_id, size,
    source_size, target, begin (words of its queue before), words and finish (virtual time).
    """
    placed = ordered_sums(docs.withColumn("one", F.lit(1).cast("long")), [F.col("source").isNull(), F.col("source"), F.col("key"), F.col("doc_id"), F.col("tie")], "size", "one")
    shares = shares.withColumnRenamed("source", "_source")
    if len(shares.take(FEW + 1)) <= FEW:
        shares = F.broadcast(shares)
    p = placed.join(shares, placed["source"].eqNullSafe(shares["_source"]))
    goal = F.floor("target").cast("long")
    p = p.select("rank", F.col("one_before").alias("place"), "doc_id", "size", "source_size", "target", goal.alias("goal"), (F.col("size_before") - F.col("base")).alias("at"))
    p = p.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    begin = F.col("at") + F.col("turn") * F.col("source_size")
    p = p.withColumns({"begin": begin, "end": begin + F.col("size")})
    ends = F.when((F.col("begin") < F.col("goal")) & (F.col("goal") < F.col("end")), F.array("goal", "end")).otherwise(F.array("end"))
    p = p.withColumn("stop", F.explode(ends)).withColumn("begin", F.when(F.col("stop") > F.col("goal"), F.greatest("begin", F.least("goal", "end"))).otherwise(F.col("begin")))
    finish = F.when(F.col("target") > 0, F.col("stop").cast("double") / F.col("target")).otherwise(F.lit(0.0))
    return p.select("rank", "place", "doc_id", "size", "source_size", "target", "begin", (F.col("stop") - F.col("begin")).alias("words"), finish.alias("finish"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix: packets in order of `position`, with `taken` words each; 0 for what comes after the budget's end."""
    d = of(docs, doc_id="long", text="string", source="string")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    sized = cut(d.select("doc_id", "source", n_words("text").alias("size"), key.alias("key"), F.xxhash64("text").alias("tie")))
    shares, budget = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sent = ordered_sums(packets(sized, shares), [F.col("finish"), F.col("rank"), F.col("begin"), F.col("place")], "words")
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.lit(budget) - F.col("words_before")))
    return sent.withColumn("taken", taken).withColumnRenamed("words_before", "position")


def mixed_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs."""
    return mix(docs, seed).groupBy("place", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("place")


#: DuckDB: the queues' words by window sums, and the mix by a sum over virtual finish times.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':0') AS key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][1 + rank % {len(WEIGHTS)}] AS weight, {EPOCHS} * source_size AS cap FROM sources),
total AS (SELECT sum(source_size)::BIGINT * {SHARE[0]} AS shared, sum(source_size)::BIGINT * {SHARE[0]} // {SHARE[1]} AS budget, sum(weight)::BIGINT AS weights FROM weighed),
filling AS (
  SELECT coalesce(sum(cap) OVER w, 0)::BIGINT AS caps, coalesce(sum(weight) OVER w, 0)::BIGINT AS capped FROM weighed
  WINDOW w AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((shared - {SHARE[1]} * caps)::DOUBLE / ({SHARE[1]} * (weights - capped))::DOUBLE) AS level FROM filling, total),
shares AS (SELECT source, rank, source_size, least(cap::DOUBLE, level * weight::DOUBLE) AS target FROM weighed, level),
queued AS (
  SELECT doc_id, size, source_size, rank, target, floor(target)::BIGINT AS goal,
         coalesce(sum(size) OVER q, 0)::BIGINT AS ahead, row_number() OVER (PARTITION BY rank ORDER BY key, doc_id) AS place
  FROM sized JOIN shares ON sized.source IS NOT DISTINCT FROM shares.source
  WINDOW q AS (PARTITION BY rank ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
turns AS (SELECT *, ahead + turn * source_size AS start, ahead + turn * source_size + size AS stop FROM queued, (SELECT unnest(range({EPOCHS})) AS turn)),
sent AS (
  SELECT rank, place, start, least(stop, greatest(goal, start)) - start AS words, least(stop, goal) AS finish, target FROM turns WHERE start < goal
  UNION ALL
  SELECT rank, place, greatest(start, goal), stop - greatest(start, goal), stop, target FROM turns WHERE stop > goal),
mix AS (
  SELECT rank, place, words, coalesce(sum(words) OVER (ORDER BY CASE WHEN target > 0 THEN finish / target ELSE 0 END, rank, start
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM sent WHERE words > 0),
taken AS (SELECT rank, place, sum(greatest(0, least(words, budget - position)))::BIGINT AS taken FROM mix, total GROUP BY rank, place)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued LEFT JOIN taken USING (rank, place)
"""
