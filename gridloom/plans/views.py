"""Array views of the relational tables, as DataFrames and as SQL for the comparison engine.

E(y, x, v): the embedding matrix.  V(d, h, k, v): events by day (from the first to the last), hour
and type (in alphabetical order), missing cells null.  L(s, l, v): line items by
supplier and line number.  P(id, lon, lat): a point for every event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import ship
from gridloom.operators.select import rows_to_cells

HOURS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str):
    """Seconds since 1970 of a timestamp's own clock reading, whatever the session's time zone."""
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def matrix(spark: SparkSession, sf_dir: str, x=None) -> DataFrame:
    return rows_to_cells(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", x)


def _domain(events: DataFrame) -> DataFrame:
    """One row: first and last day (since 1970) and the types of all events."""
    return events.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.sort_array(F.collect_set("event_type")).alias("types"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("ts IS NOT NULL AND event_type IS NOT NULL")
    return events.select(F.floor(seconds("ts") / 86400).cast("int").alias("day"), F.hour("ts").cast("long").alias("h"), "event_type", "value")


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array of all days, hours and types between the first event and the last; it is as large as that domain, however many events there are."""
    events = _days(spark, sf_dir)
    filled = events.groupBy("day", "h", "event_type").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("v"))
    days = _domain(events).where("first IS NOT NULL").select("first", "types", F.explode(F.sequence("first", "last")).alias("day"))
    hours = days.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOURS - 1).cast("long"))))
    frame = hours.select((F.col("day") - F.col("first")).cast("long").alias("d"), "day", "h", F.posexplode("types").alias("k", "event_type"))
    return frame.join(filled, ["day", "h", "event_type"], "left").select("d", "h", F.col("k").cast("long").alias("k"), "v")


def volume_shape(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Length of each dimension of the volume."""
    r = _domain(_days(spark, sf_dir)).first()
    return {"d": 0 if r["first"] is None else r["last"] - r["first"] + 1, "h": HOURS, "k": len(r["types"])}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast("long").alias("l")).agg(F.sum("l_quantity").alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("id"), ((e * 37 % 3600) / 10.0).alias("lon"), ((e * 53 % 1799) / 10.0 - 89.9).alias("lat"))


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable per part: its path is type, brand and name."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat_ws("/", F.lower("p_type"), F.regexp_replace(F.lower("p_brand"), "#", ""), F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"))).alias("name"),
        F.initcap("p_name").alias("long_name"),
        F.when(F.col("p_size") % 3 == 0, "K").when(F.col("p_size") % 3 == 1, "m/s").alias("units"),
        F.col("p_partkey").alias("pos"),
        F.col("p_size").cast("long").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resident block per order: source, variable, bytes, last access, and steps start to stop."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("block"), F.concat(F.lit("store"), (k % 4).cast("string")).alias("source"), F.col("o_orderpriority").alias("variable"), F.floor("o_totalprice").cast("long").alias("bytes"),
        seconds("o_orderdate").alias("last_access"), F.floor(k % 1000 / 8).cast("long").alias("_c"),
    ).select("block", "source", "variable", "bytes", "last_access", (F.col("_c") * 8).alias("start"), (F.col("_c") * 8 + 8).alias("stop"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("request"), F.concat(F.lit("store"), (k % 5).cast("string")).alias("source"), F.element_at(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"])), (k % 6 + 1).cast("int")).alias("variable"), (k * 7 % 1200).alias("step"))


SQL = {
    "E": "E AS (SELECT vec_id AS y, unnest(range(0, len(embedding))) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "V": """V_D AS (SELECT floor(epoch(ts)::DOUBLE / 86400)::BIGINT AS day, hour(ts)::BIGINT AS h, event_type AS t, value FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
V_G AS (SELECT day, h, t, sum(value::DECIMAL(18,4))::DOUBLE AS v FROM V_D GROUP BY 1, 2, 3),
V_T AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM (SELECT DISTINCT t FROM V_D)),
V AS (SELECT day - (SELECT min(day) FROM V_D) AS d, h, k, v FROM (SELECT unnest(range((SELECT min(day) FROM V_D), (SELECT max(day) + 1 FROM V_D))) AS day) CROSS JOIN (SELECT unnest(range(0, 24)) AS h) CROSS JOIN V_T LEFT JOIN V_G USING (day, h, t)),
V_N AS (SELECT max(d) + 1 AS days, max(k) + 1 AS kinds FROM V)""",
    "L": "L AS (SELECT l_suppkey AS s, l_linenumber::BIGINT AS l, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "P": "P AS (SELECT event_id AS id, (event_id * 37 % 3600) / 10.0::DOUBLE AS lon, (event_id * 53 % 1799) / 10.0::DOUBLE - 89.9 AS lat FROM events)",
    "VAR": "VAR AS (SELECT lower(p_type) || '/' || replace(lower(p_brand), '#', '') || '/' || replace(p_name, ' ', '_') || '_' || p_partkey AS name, p_name AS long_name, CASE p_size % 3 WHEN 0 THEN 'K' WHEN 1 THEN 'm/s' END AS units, p_partkey AS pos, p_size::BIGINT AS size, p_retailprice AS price, lower(p_type) || '/' || replace(lower(p_brand), '#', '') AS grp FROM part)",
    "B": "B AS (SELECT o_orderkey AS block, 'store' || (o_orderkey % 4) AS source, o_orderpriority AS variable, floor(o_totalprice)::BIGINT AS bytes, epoch(o_orderdate)::BIGINT AS last_access, (o_orderkey % 1000 // 8) * 8 AS start, (o_orderkey % 1000 // 8) * 8 + 8 AS stop FROM orders)",
    "R": "R AS (SELECT c_custkey AS request, 'store' || (c_custkey % 5) AS source, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NONE'][c_custkey % 6 + 1] AS variable, c_custkey * 7 % 1200 AS step FROM customer)",
}


def sql(names: str, body: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + " " + body
