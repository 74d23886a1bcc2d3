"""Relational queries over the star schema (the engine baseline, not part of the keyed engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkv.operators.baseline import as_of_join, range_join, revenue
from sparkkv.plans.registry import query
from sparkkv.sources.tables import table

REV = "sum(round(l_extendedprice * (1 - l_discount), 4)::DECIMAL(18,4))::DOUBLE"


def _sum(c, name: str):
    return F.sum(c).cast("double").alias(name)


def _dec(c: str):
    return F.col(c).cast("decimal(18,4)")


@query(f"""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS sum_qty, {REV} AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def base_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(_sum(_dec("l_quantity"), "sum_qty"), _sum(revenue(), "sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query(f"""SELECT l_orderkey, {REV} AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def base_top_orders(spark, d):
    c, o, li = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    rows = li.join(o.join(c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"), li["l_orderkey"] == o["o_orderkey"])
    return rows.groupBy("l_orderkey", "o_orderdate").agg(_sum(revenue(), "revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query(f"""SELECT n_name, r_name, {REV} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def base_local_suppliers(spark, d):
    li, o, c, s, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation", "region"))
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, (li["l_suppkey"] == s["s_suppkey"]) & (c["c_nationkey"] == s["s_nationkey"]))
    return rows.join(places, rows["s_nationkey"] == places["n_nationkey"]).groupBy("n_name", "r_name").agg(_sum(revenue(), "revenue"))


@query("SELECT sum(round(l_extendedprice * l_discount, 4)::DECIMAL(18,4))::DOUBLE AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
def base_forecast(spark, d):
    rows = table(spark, d, "lineitem").where("l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
    return rows.agg(_sum(F.round(F.col("l_extendedprice") * F.col("l_discount"), 4).cast("decimal(18,4)"), "revenue"), F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def base_left_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS suppliers, coalesce(b.n, 0) AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) b ON a.k = b.k")
def base_full_join(spark, d):
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = table(spark, d, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("suppliers"), F.coalesce("b", F.lit(0)).alias("customers"))


@query("""SELECT event_id, ts, user_id, v AS last_purchase FROM (SELECT event_id, ts, user_id FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id AS u, ts AS t, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.u AND e.ts >= p.t""")
def base_as_of(spark, d):
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("t")).agg(F.max("value").alias("last_purchase"))
    return as_of_join(e.where("event_type = 'error'").select("event_id", "ts", "user_id"), bought, "user_id", "ts", "t", ["last_purchase"])


@query("SELECT p_partkey, low FROM part JOIN (SELECT unnest(range(0, 2000, 150)) AS low) s ON p_retailprice >= low AND p_retailprice < low + 200")
def base_range_join(spark, d):
    spans = spark.range(0, 2000, 150).select(F.col("id").alias("low"), (F.col("id") + 200).alias("high"))
    return range_join(table(spark, d, "part"), spans, F.col("p_retailprice"), "low", "high", 200).select("p_partkey", "low")


@query("SELECT p_brand, p_size, count(*) AS n, grouping(p_brand, p_size)::BIGINT AS g FROM part GROUP BY CUBE (p_brand, p_size)")
def base_cube(spark, d):
    return table(spark, d, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def base_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), _sum(_dec("o_totalprice"), "total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def base_grouping_sets(spark, d):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, d, "lineitem").groupingSets([[f], [s], []], f, s).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def base_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr,
lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, sum(o_totalprice::DECIMAL(18,4)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DOUBLE AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def base_windows(spark, d):
    w, s = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return table(spark, d, "orders").select(
        "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(s).cast("long").alias("rk"), F.dense_rank().over(s).cast("long").alias("dr"), F.lag("o_orderkey").over(w).alias("before"),
        F.lead("o_orderkey").over(w).alias("after"), F.sum(_dec("o_totalprice")).over(w.rowsBetween(-2, 0)).cast("double").alias("moving"),
    )


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def base_top_per_key(spark, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("rn", rank).where("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def base_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def base_except(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").where("s_acctbal < 0").select("s_nationkey").distinct())


@query("""SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity::DECIMAL(18,4) END)::DOUBLE AS "F", sum(CASE WHEN l_linestatus = 'O' THEN l_quantity::DECIMAL(18,4) END)::DOUBLE AS "O" FROM lineitem GROUP BY 1""")
def base_pivot(spark, d):
    rows = table(spark, d, "lineitem").withColumn("q", _dec("l_quantity"))
    out = rows.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("q"))
    return out.select("l_returnflag", F.col("F").cast("double").alias("F"), F.col("O").cast("double").alias("O"))
