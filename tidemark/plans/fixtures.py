"""Manifests, histories and listings derived from the given tables.

Each is one SQL text in the dialect that Spark and DuckDB share: {orders} and the like stand
for the tables. Work on them grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-30 12:00:00"
TARGET = 1705363200000  # 2024-01-16 00:00:00 UTC


def _side(remote: bool) -> str:
    pick = lambda a, b: b if remote else a
    return f"""
SELECT 'f' || CAST(o_custkey % 8 AS STRING) AS folder_id,
       'c' || CAST(o_custkey AS STRING) || '/o' || CAST(o_orderkey AS STRING) || '.bin' AS path,
       1 + o_orderkey % 3 {pick('', '- CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END')} AS va,
       o_orderkey % 2 {pick('', '+ CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END')} AS vb,
       CAST(floor(o_totalprice) AS BIGINT) {pick('', '+ CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END')} AS size,
       {pick('o_orderkey % 17 = 0', '(o_orderkey % 17 = 0 OR o_orderkey % 29 = 0)')} AS deleted,
       'b' || CAST(o_orderkey % 13 {pick('', '+ CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END')} AS STRING) AS b0,
       1700000000000 + o_orderkey * 1000 {pick('', '+ CASE WHEN o_orderkey % 2 = 0 THEN 500 ELSE -500 END')} AS mtime
FROM {{orders}} WHERE {pick('o_orderkey % 19 <> 0', 'o_orderkey % 11 <> 0')}"""


M1_LOCAL, M1_REMOTE = _side(False), _side(True)
M2 = """
SELECT 'f0' AS folder_id, 'o' || CAST(l_orderkey AS STRING) AS path,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS slot,
       CAST(l_partkey % 500 AS STRING) AS local_hash,
       CAST(CASE WHEN l_suppkey % 10 = 0 THEN 1000 + l_partkey ELSE l_partkey % 500 END AS STRING) AS remote_hash,
       CAST(l_quantity AS BIGINT) * 1000 AS length
FROM {lineitem}"""
M4 = """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, 'f' || CAST(user_id % 4 AS STRING) AS folder_id,
       'p' || CAST(user_id % 50 AS STRING) || '.txt' AS path,
       CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'conflict' ELSE 'update' END AS action,
       CASE WHEN value >= 10 THEN 'remote' ELSE 'local' END AS direction,
       CASE WHEN value >= 10 THEN 'd' || CAST(user_id % 7 AS STRING) END AS device_id,
       CAST(floor(value * 1000) AS BIGINT) AS bytes
FROM {events}"""
M5 = """
SELECT 'f' || CAST(page_id % 3 AS STRING) AS folder_id, page_id,
       regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$|/$', ''%s) AS path
FROM {pages}"""
M5_SPARK, M5_DUCK = M5.replace("%s", ""), M5.replace("%s", ", 'g'")
M7 = "SELECT DISTINCT 'f' || CAST(c_nationkey % 8 AS STRING) AS folder_id, 'd' || CAST(c_custkey % 7 AS STRING) AS device_id FROM {customer}"
RULES = ["*.example.org/", "en/", "!fr/", "/blog*", "de/7*", "**/es/**"]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def manifest(spark: SparkSession, sf_dir: str, remote: bool = False) -> DataFrame:
    """M1 with its vector as a map and one block of each live file."""
    m = spark_sql(spark, sf_dir, M1_REMOTE if remote else M1_LOCAL)
    blocks = F.when(F.col("deleted"), F.array().cast("array<string>")).otherwise(F.array("b0"))
    version = F.create_map(F.lit("A"), F.col("va").cast("bigint"), F.lit("B"), F.col("vb").cast("bigint"))
    return m.select("folder_id", "path", version.alias("version"), "size", "deleted", blocks.alias("blocks"), "mtime")


SLOTS_A_TASK = 500_000  # rows of lineitem that a task sorts at a time


def slot_tasks(spark: SparkSession, sf_dir: str) -> int:
    """In how many tasks slots are sorted: by lineitem's rows, since a fixed number would make tasks grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // SLOTS_A_TASK))


def slots(spark: SparkSession, sf_dir: str, side: str, offsets: bool = True) -> DataFrame:
    """M2's slots of one side; with offsets, and then dealt by path."""
    from pyspark.sql import Window

    tasks = slot_tasks(spark, sf_dir)
    m = spark.sql(M2, lineitem=table(spark, sf_dir, "lineitem").repartition(tasks, "l_orderkey"))
    if not offsets:
        return m.select("folder_id", "path", "slot", F.col(f"{side}_hash").alias("hash"), "length")
    m = m.repartition(tasks, "path")
    w = Window.partitionBy("path").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return m.select("folder_id", "path", "slot", F.col(f"{side}_hash").alias("hash"), "length", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, M4)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, M5_SPARK)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, M7)


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: documents as files (folder_id, path, content)."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(F.lit("f0").alias("folder_id"), path.alias("path"), F.col("text").cast("binary").alias("content"))


#: DuckDB: both sides joined, with the relation of their states and the planned action.
PLAN = duck(f"""
l AS ({M1_LOCAL}), r AS ({M1_REMOTE}),
j AS (SELECT coalesce(l.folder_id, r.folder_id) AS folder_id, coalesce(l.path, r.path) AS path,
             l.path IS NOT NULL AS lt, r.path IS NOT NULL AS rt, l.va AS lva, l.vb AS lvb, r.va AS rva, r.vb AS rvb,
             l.size AS lsize, r.size AS rsize, l.deleted AS ldel, r.deleted AS rdel, l.b0 AS lb, r.b0 AS rb, l.mtime AS lm, r.mtime AS rm
      FROM l FULL OUTER JOIN r ON l.folder_id = r.folder_id AND l.path = r.path),
s AS (SELECT *, CASE WHEN NOT rt THEN 'local-newer' WHEN NOT lt THEN 'remote-newer'
                     WHEN lva = rva AND lvb = rvb THEN 'equal' WHEN lva >= rva AND lvb >= rvb THEN 'local-newer'
                     WHEN lva <= rva AND lvb <= rvb THEN 'remote-newer' ELSE 'conflict' END AS state FROM j),
p AS (SELECT *, CASE state WHEN 'local-newer' THEN CASE WHEN ldel THEN 'delete' ELSE 'send' END
                           WHEN 'remote-newer' THEN CASE WHEN rdel THEN 'delete' ELSE 'receive' END
                           WHEN 'conflict' THEN 'conflict' END AS action FROM s)""")
PAGES, EVENTS, SLOTS = duck(f"g AS ({M5_DUCK})"), duck(f"e AS ({M4})"), duck(f"b AS ({M2})")
