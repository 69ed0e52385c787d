"""How the places, the road graph, events, runs and messages are read from the supplied tables.

Each has its statement in SQL beside it: the tables are stand-ins with the shapes that the
operators need, derived by rule so that both sides agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that states its result."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lng(key: str):
    return F.lit(114.346) + (F.col(key) * 7919 % 4200) / F.lit(1e5)


def lat(key: str):
    return F.lit(30.517) + (F.col(key) * 104729 % 3400) / F.lit(1e5)


def lng_sql(key: str) -> str:
    return f"(114.346::DOUBLE + (({key}) * 7919 % 4200)::DOUBLE / 1e5::DOUBLE)"


def lat_sql(key: str) -> str:
    return f"(30.517::DOUBLE + (({key}) * 104729 % 3400)::DOUBLE / 1e5::DOUBLE)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type, subcategory, scenery, importance, lng, lat."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("subcategory"),
        F.col("p_size").alias("scenery"), F.col("p_retailprice").alias("importance"), lng("p_partkey").alias("lng"), lat("p_partkey").alias("lat"),
    )


PLACES = f"""places AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS type, p_brand AS subcategory, p_size AS scenery, p_retailprice AS importance,
    {lng_sql("p_partkey")} AS lng, {lat_sql("p_partkey")} AS lat FROM part
)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, lng, lat, nation."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), lng("s_suppkey").alias("lng"), lat("s_suppkey").alias("lat"), F.col("s_nationkey").alias("nation"))


NODES = f"nodes AS (SELECT s_suppkey AS node, {lng_sql('s_suppkey')} AS lng, {lat_sql('s_suppkey')} AS lat, s_nationkey AS nation FROM supplier)"


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, k, quantity: consecutive suppliers of an order; k numbers parallel edges from 0."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("u"), F.lead("l_suppkey").over(line).alias("v"), F.col("l_quantity").alias("quantity"),
    )
    parallel = Window.partitionBy("u", "v").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    kept = steps.filter(F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    return kept.select("u", "v", (F.row_number().over(parallel) - 1).alias("k"), "quantity")


HOPS = """steps AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS u,
    lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS v, l_quantity AS quantity FROM lineitem
), hops AS (
  SELECT u, v, (row_number() OVER (PARTITION BY u, v ORDER BY l_orderkey, l_linenumber, l_partkey) - 1)::INTEGER AS k, quantity FROM steps
  WHERE v IS NOT NULL AND u <> v
)"""


def attributed(hops_: DataFrame, length) -> DataFrame:
    key = F.col("u") + F.col("v")
    return hops_.select(
        "u", "v", "k", length.alias("length"), (key % 5 + 1).cast("int").alias("slope"), F.when(key % 11 == 0, None).otherwise((F.col("u") * 3 + F.col("v")) % 5 + 1).cast("int").alias("scenery"),
        F.when(key % 7 == 0, "steps").when(key % 7 < 4, "residential").otherwise("footway").alias("highway"),
        F.concat(F.lit("road "), (F.floor(key / 10) % 9).cast("string")).alias("road"),
    )


ATTRIBUTES = """(u + v) % 5 + 1 AS slope, CASE WHEN (u + v) % 11 = 0 THEN NULL ELSE (u * 3 + v) % 5 + 1 END AS scenery,
    CASE WHEN (u + v) % 7 = 0 THEN 'steps' WHEN (u + v) % 7 < 4 THEN 'residential' ELSE 'footway' END AS highway,
    'road ' || ((u + v) // 10 % 9)::VARCHAR AS road"""


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, k, length, slope, scenery, highway, road: the multigraph."""
    return attributed(hops(spark, sf_dir), F.col("quantity") * 10)


ALL_EDGES = HOPS + f", all_edges AS (SELECT u, v, k, quantity * 10 AS length, {ATTRIBUTES} FROM hops)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest of parallel edges, with k = 0."""
    shortest = hops(spark, sf_dir).groupBy("u", "v").agg(F.min("quantity").alias("quantity")).withColumn("k", F.lit(0))
    return attributed(shortest, F.col("quantity") * 10)


EDGES = HOPS + f", edges AS (SELECT u, v, 0 AS k, min(quantity) * 10 AS length, {ATTRIBUTES} FROM hops GROUP BY u, v)"

#: The moment that queries with a validity, a lease or a deadline take as now, in seconds.
NOW = 893462400


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, edge key, kind, start, until (null: open), revoked, multiplier, mode: road events from orders."""
    at = F.to_timestamp("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("place"),
        F.when(F.col("o_orderstatus") == "F", "closure").when(F.col("o_orderstatus") == "O", "slowdown").otherwise("notice").alias("kind"),
        F.unix_seconds(at).alias("start"), F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(F.unix_seconds(at) + 30 * 86400).alias("until"),
        F.when(F.col("o_orderkey") % 13 == 0, F.unix_seconds(at) + 86400).alias("revoked"),
        (F.lit(1.0) + F.col("o_orderkey") % 5).alias("multiplier"),
        F.element_at(F.array(F.lit("walk"), F.lit("bike"), F.lit("drive")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("mode"),
    )


EVENTS = """events_ AS (
  SELECT o_orderkey AS id, o_custkey AS place, CASE o_orderstatus WHEN 'F' THEN 'closure' WHEN 'O' THEN 'slowdown' ELSE 'notice' END AS kind,
    epoch(o_orderdate)::BIGINT AS start, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE epoch(o_orderdate)::BIGINT + 30 * 86400 END AS until,
    CASE WHEN o_orderkey % 13 = 0 THEN epoch(o_orderdate)::BIGINT + 86400 END AS revoked, 1.0::DOUBLE + o_orderkey % 5 AS multiplier,
    ['walk', 'bike', 'drive'][o_orderkey % 3 + 1] AS mode FROM orders
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue of runs from orders: status, created, lease and deadline in seconds, attempts, cancel flag."""
    at, key = F.unix_seconds(F.to_timestamp("o_orderdate")), F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        key.alias("run_id"), (key % 97).alias("task_id"), (key % 7).alias("task_revision"), F.col("o_custkey").alias("owner_id"),
        F.element_at(F.array(*map(F.lit, ("queued", "running", "completed", "failed", "needs_review"))), (key % 5 + 1).cast("int")).alias("status"),
        at.alias("created"), (at + (key % 400) * 86400).alias("lease"), (at + (key % 900) * 86400).alias("deadline"),
        (key % 4).alias("attempts"), (key % 17 == 0).alias("cancel_requested"), F.col("o_orderpriority").alias("priority"),
    )


RUNS = """runs AS (
  SELECT o_orderkey AS run_id, o_orderkey % 97 AS task_id, o_orderkey % 7 AS task_revision, o_custkey AS owner_id,
    ['queued', 'running', 'completed', 'failed', 'needs_review'][o_orderkey % 5 + 1] AS status, epoch(o_orderdate)::BIGINT AS created,
    epoch(o_orderdate)::BIGINT + o_orderkey % 400 * 86400 AS lease, epoch(o_orderdate)::BIGINT + o_orderkey % 900 * 86400 AS deadline,
    o_orderkey % 4 AS attempts, o_orderkey % 17 = 0 AS cancel_requested, o_orderpriority AS priority FROM orders
)"""

def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, seconds, micros, value, kind, id: a time series from the events table."""
    micros = F.unix_micros(F.to_timestamp("ts"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), micros.alias("micros"), F.col("value"), F.col("event_type").alias("kind"), "props")


READINGS = "readings AS (SELECT user_id AS \"user\", event_id AS id, epoch_us(ts) AS micros, value, event_type AS kind, props FROM events)"
