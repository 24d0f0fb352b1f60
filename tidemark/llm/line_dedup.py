"""Removal of cross-site boilerplate lines by distinct-site spread.

Per line hash, a HyperLogLog sketch of the sites (sources) that show the line; sketches are
made in map tasks and merged by aggregation, so a line that a third of all rows hold costs
one sketch per task. Lines whose estimate is near the threshold get an exact distinct count;
lines clearly above it don't need one. A line on at least `min_sites` sites is boilerplate:
it is removed everywhere but in the smallest doc_id that has it, so its text is not lost.

Lines are what stands between line feeds, compared trimmed of spaces and tabs; blank lines
always stay. Null text has no lines and stays null. A null source is no site; rows with a
null doc_id lose boilerplate lines but never count as the one that keeps them.
Repeated rows get the same result each; an empty table gives no rows; texts of any length
are split whole; columns that aren't kept can't clash, and kept ones may have any name but
those of the result. Only DataFrame functions are used. What is found of the lines is cut off
before it is joined back to them, so adaptive execution can split a line that many rows have;
other lines are kept out of these shuffles by a bitmap of bounded size, and for exact counts a
line's sites are made distinct in each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, maybe_in, of

MIN_SITES = 10
LG_K = 10  # sketch of at most 2**10 cells; a relative error of about 3.3 %
NEAR = 0.25  # estimates within this share of the threshold, over seven deviations, are counted exactly


def _lines(docs: DataFrame) -> DataFrame:
    line = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    out = docs.select("doc_id", "tie", "source", line).withColumn("line", F.trim(F.col("line"), F.lit(" \t\r")))
    return out.where("line <> ''").select("doc_id", "tie", "source", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, keeper) of lines on at least min_sites sites."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("source", LG_K).alias("sites"), F.count("source").alias("rows"), F.min("doc_id").alias("keeper"))
    estimate = F.hll_sketch_estimate("sites")
    likely = sketched.where(F.col("rows") >= min_sites).select("h1", "h2", "keeper", estimate.alias("spread"))
    likely = cut(likely.where(F.col("spread") >= min_sites * (1 - NEAR)))
    sure = F.col("spread") > min_sites * (1 + NEAR)
    near = likely.where(~sure).select("h1", "h2", "keeper")
    on = maybe_in(lines.select("h1", "h2", "source"), "h1", near.select("h1")).where("maybe").select("h1", "h2", "source").distinct()
    exact = on.join(near, ["h1", "h2"]).groupBy("h1", "h2", "keeper").agg(F.count("source").alias("exact")).where(F.col("exact") >= min_sites)
    return cut(likely.where(sure).select("h1", "h2", "keeper").unionByName(exact.drop("exact")))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, source, *keep, n_lines, n_removed, kept_text) for each row of docs. keep: further text columns."""
    d = of(docs, doc_id="long", text="string", source="string", **{c: "string" for c in keep}).withColumn("tie", F.xxhash64("text"))
    lines = _lines(d)
    bad = boilerplate(lines, min_sites)
    found = maybe_in(lines.select("doc_id", "tie", "pos", "h1", "h2"), "h1", bad.select("h1")).where("maybe").drop("maybe")
    found = found.join(bad, ["h1", "h2"]).where("doc_id is null or doc_id > keeper")
    gone = found.groupBy("doc_id", "tie").agg(F.collect_set("pos").alias("gone")).withColumnRenamed("doc_id", "_id").withColumnRenamed("tie", "_tie")
    out = d.join(gone, d["doc_id"].eqNullSafe(gone["_id"]) & (d["tie"] == gone["_tie"]), "left")
    parts = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))  # by a hash set: linear in the lines
    row = F.array(F.struct(parts.alias("parts"), stay.alias("stay")))  # bound once, so the text isn't split again for each line
    kept = F.get(F.transform(row, lambda r: F.array_join(F.transform(r["stay"], lambda i: F.get(r["parts"], i)), "\n")), 0)
    return out.select(
        "doc_id",
        "text",
        "source",
        *keep,
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


#: DuckDB, with exact counts throughout; the query gives digests of the kept text.
ORACLE = f"""
WITH docs AS (SELECT doc_id, text, source FROM documents),
lines AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
                 unnest(string_split(text, chr(10))) AS raw FROM docs),
marked AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines),
bad AS (SELECT line, min(doc_id) AS keeper FROM marked WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
kept AS (SELECT m.doc_id, count(*) AS n_lines, count(*) FILTER (b.line IS NOT NULL AND m.doc_id > b.keeper) AS n_removed,
                coalesce(string_agg(m.raw, chr(10) ORDER BY m.pos) FILTER (b.line IS NULL OR m.doc_id <= b.keeper), '') AS kept_text
         FROM marked m LEFT JOIN bad b USING (line) GROUP BY m.doc_id)
SELECT doc_id, n_lines, n_removed, length(kept_text) AS kept_chars, sha256(kept_text) AS kept_sha256 FROM kept
"""
