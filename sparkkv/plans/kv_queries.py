"""Queries of the keyed data plane: reads, mutations, folds, counters, time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkv.operators import counters, kv, ttl
from sparkkv.plans.registry import query
from sparkkv.sources.tables import mutation_log, table

#: The time at which time-to-live queries read.
NOW = "2024-01-31 00:00:00"
DAY = 86_400

LOG = """log AS (SELECT event_id AS sid, ts, user_id AS k, CASE event_type WHEN 'signup' THEN 'set' WHEN 'error' THEN 'del' WHEN 'purchase' THEN 'inc' ELSE 'hit' END AS op, value AS v, event_type AS kind FROM events)"""


def fold_sql(log: str = "log", name: str = "folded") -> str:
    return f"""{name}_b AS (SELECT *, max(CASE WHEN op IN ('set', 'del') THEN sid END) OVER (PARTITION BY k) AS base FROM {log}),
{name}_g AS (SELECT k, max(CASE WHEN sid = base AND op = 'set' THEN v END) AS set_v, sum(CASE WHEN op = 'inc' AND sid > coalesce(base, -1) THEN v::DECIMAL(18,4) END) AS inc_v,
  count(*) FILTER (op = 'inc' AND sid > coalesce(base, -1)) AS n_inc, count(*) FILTER (op = 'hit') AS hits, max(sid) AS last_sid, max(ts) AS last_ts FROM {name}_b GROUP BY k),
{name} AS (SELECT k, (coalesce(set_v::DECIMAL(18,4), 0) + coalesce(inc_v, 0))::DOUBLE AS v, n_inc, hits, last_sid, last_ts FROM {name}_g WHERE set_v IS NOT NULL OR n_inc > 0)"""


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"WITH {LOG}, {fold_sql()} SELECT k, to_hex(k) AS k_hex, v, n_inc, hits, last_sid FROM folded WHERE last_ts + INTERVAL 10 DAY > TIMESTAMP '{NOW}'")
def kv_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the log folded into its current state, keys that ended left out, one row for each key."""
    live = ttl.live(kv.fold(mutation_log(spark, d)), "last_ts", _now(), F.lit(10 * DAY))
    return live.select("k", F.hex("k").alias("k_hex"), "v", "n_inc", "hits", "last_sid")


@query(f"WITH {LOG}, {fold_sql()} SELECT * FROM folded")
def kv_log_fold(spark, d):
    return kv.fold(mutation_log(spark, d))


@query(f"WITH {LOG}, {fold_sql()} SELECT * FROM folded")
def kv_log_fold_hot(spark, d):
    """The same for logs with hot keys: folded by key and span of 200 sids, then by key."""
    return kv.fold(mutation_log(spark, d), span=200)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 77")
def kv_get(spark, d):
    return kv.get(table(spark, d, "customer"), "c_custkey", 77)


@query("WITH r AS (SELECT DISTINCT user_id * 10 AS c_custkey FROM events) SELECT r.c_custkey, c_name, c_acctbal, c_name IS NOT NULL AS found FROM r LEFT JOIN customer USING (c_custkey)")
def kv_multiget(spark, d):
    asked = table(spark, d, "events").select((F.col("user_id") * 10).alias("c_custkey"))
    return kv.multi_get(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), asked, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def kv_exist(spark, d):
    asked = table(spark, d, "customer").select("c_custkey", "c_name")
    return kv.existing(asked, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey >= 20 AND c_custkey < 140 ORDER BY c_custkey DESC LIMIT 50")
def kv_list(spark, d):
    return kv.listing(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 20, 140, 50, descending=True)


@query("""SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey * 17, s_acctbal FROM supplier WHERE s_suppkey * 17 NOT IN (SELECT c_custkey FROM customer)""")
def kv_add(spark, d):
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return kv.add(stored, table(spark, d, "supplier").select((F.col("s_suppkey") * 17).alias("k"), F.col("s_acctbal").alias("v")), "k")


@query(f"WITH {LOG} SELECT k, max(sid) AS sid, arg_max(v, sid) AS v, arg_max(kind, sid) AS kind FROM log WHERE op <> 'hit' GROUP BY k")
def kv_set(spark, d):
    return kv.put(mutation_log(spark, d).where("op != 'hit'"), "k", "sid", ["v", "kind"])


@query(f"""WITH {LOG}, new AS (SELECT k AS c_custkey, arg_max(v, sid) AS n FROM log WHERE op = 'set' GROUP BY k)
SELECT c_custkey, coalesce(n, c_acctbal) AS c_acctbal FROM customer LEFT JOIN new USING (c_custkey)""")
def kv_update(spark, d):
    new = kv.put(mutation_log(spark, d).where("op = 'set'"), "k", "sid", ["v"]).select(F.col("k").alias("c_custkey"), F.col("v").alias("c_acctbal"))
    return kv.update(table(spark, d, "customer").select("c_custkey", "c_acctbal"), new, "c_custkey", "c_acctbal")


@query("""SELECT c_custkey, (c_acctbal::DECIMAL(18,4) + coalesce(s, 0))::DOUBLE AS v FROM customer
LEFT JOIN (SELECT o_custkey AS c_custkey, sum(o_totalprice::DECIMAL(18,4)) AS s FROM orders GROUP BY 1) USING (c_custkey)""")
def kv_inc(spark, d):
    stored = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,4)").alias("v"))
    deltas = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").cast("decimal(18,4)").alias("v"))
    return kv.increase(stored, deltas, "c_custkey", "v").select("c_custkey", F.col("v").cast("double").alias("v"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def kv_del(spark, d):
    return kv.remove(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS field_k FROM events")
def kv_project(spark, d):
    """A named field of a structured value."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("field_k"))


@query("SELECT CAST(concat('0x', substr(md5(c_custkey::VARCHAR), 1, 15)) AS BIGINT) % 16 AS part, count(*) AS n, min(c_custkey) AS low, max(c_custkey) AS high FROM customer GROUP BY 1")
def kv_partition_hash(spark, d):
    c = table(spark, d, "customer").withColumn("part", kv.hash_partition(F.col("c_custkey"), 16))
    return c.groupBy("part").agg(F.count("*").alias("n"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))


@query("SELECT (c_custkey >= 50)::BIGINT + (c_custkey >= 400)::BIGINT + (c_custkey >= 1000)::BIGINT AS part, count(*) AS n, sum(c_acctbal::DECIMAL(18,4))::DOUBLE AS v FROM customer GROUP BY 1")
def kv_partition_range(spark, d):
    c = table(spark, d, "customer").withColumn("part", kv.range_partition(F.col("c_custkey"), [50, 400, 1000]))
    return c.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,4)")).cast("double").alias("v"))


@query("SELECT ((o_orderkey >> 0) & 63)::BIGINT AS grp, count(*) AS n, min(o_orderkey) AS low FROM orders GROUP BY 1")
def key_group_bits(spark, d):
    o = table(spark, d, "orders").withColumn("grp", kv.key_group(F.col("o_orderkey"), 0, 5))
    return o.groupBy("grp").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"))


@query("SELECT c_custkey, reverse(c_custkey::VARCHAR) AS sort_key, rank() OVER (PARTITION BY c_nationkey ORDER BY reverse(c_custkey::VARCHAR))::BIGINT AS place FROM customer")
def kv_order_override(spark, d):
    """A store whose keys compare by their digits from the right."""
    rank = F.rank().over(Window.partitionBy("c_nationkey").orderBy("sort_key"))
    c = table(spark, d, "customer").withColumn("sort_key", F.reverse(F.col("c_custkey").cast("string")))
    return c.select("c_custkey", "sort_key", rank.cast("long").alias("place"))


@query("SELECT c_custkey, to_hex(c_custkey) AS upper_hex, lower(to_hex(c_custkey)) AS lower_hex, to_hex(-c_custkey) AS negative_hex, c_custkey::VARCHAR AS plain FROM customer")
def key_hex(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.hex(k).alias("upper_hex"), F.lower(F.hex(k)).alias("lower_hex"), F.hex(-k).alias("negative_hex"), k.cast("string").alias("plain"))


@query("SELECT c_custkey, lpad(to_hex(c_custkey), 32, '0') AS key128, lpad(to_hex(c_custkey), 64, '0') AS key256, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer")
def key_wide(spark, d):
    """16- and 32-byte keys whose binary order is the order of their numbers."""
    c = table(spark, d, "customer").withColumns({"w": kv.wide_key(F.col("c_custkey"), 16), "x": kv.wide_key(F.col("c_custkey"), 32)})
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("x"))
    return c.select("c_custkey", F.hex("w").alias("key128"), F.hex("x").alias("key256"), place.cast("long").alias("place"))


@query(f"WITH {LOG}, cut AS (SELECT * FROM log WHERE sid <= 700), {fold_sql('cut')} SELECT * FROM folded")
def kv_as_of(spark, d):
    return kv.as_of(mutation_log(spark, d), 700)


@query(f"WITH {LOG}, {fold_sql()} SELECT k, v FROM folded")
def kv_snapshot_and_tail(spark, d):
    """A folded beginning of the log plus its tail gives the state of the whole log."""
    log = mutation_log(spark, d)
    return kv.fold_tail(kv.as_of(log, 500), log.where("sid > 500")).select("k", "v")


@query(f"""WITH {LOG}, early AS (SELECT * FROM log WHERE sid <= 500), {fold_sql('early', 'a')}, {fold_sql('log', 'b')}
SELECT 'gone' AS change, k, v FROM (SELECT k, v FROM a EXCEPT ALL SELECT k, v FROM b) UNION ALL SELECT 'new', k, v FROM (SELECT k, v FROM b EXCEPT ALL SELECT k, v FROM a)""")
def kv_snapshot_diff(spark, d):
    log = mutation_log(spark, d)
    a, b = kv.as_of(log, 500).select("k", "v"), kv.fold(log).select("k", "v")
    return a.exceptAll(b).select(F.lit("gone").alias("change"), "k", "v").union(b.exceptAll(a).select(F.lit("new"), "k", "v"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def counter_long(spark, d):
    return counters.totals(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def counter_wide(spark, d):
    return counters.as_row(table(spark, d, "events"), "user_id", "event_type", ["click", "view", "purchase"])


@query("SELECT user_id, event_type, sum(CASE event_type WHEN 'view' THEN 10 ELSE 3 END)::BIGINT AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2")
def counter_configured(spark, d):
    definition = spark.createDataFrame([("view", 10), ("click", 3)], "event_type string, step long")
    return counters.configured(table(spark, d, "events"), definition, "user_id", "event_type")


@query("SELECT user_id, count(*) AS n FROM events WHERE ts::DATE <= DATE '2024-01-20' AND ts::DATE > DATE '2024-01-13' GROUP BY 1")
def counter_reserved_days(spark, d):
    recent = counters.recent(table(spark, d, "events"), F.lit("2024-01-20").cast("date"), 7)
    return recent.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS keys, max(event_id) AS last_sid, sum(value::DECIMAL(18,4))::DOUBLE AS total, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1")
def op_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("keys"), F.max("event_id").alias("last_sid"),
        F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"), F.sum(F.length("props")).alias("bytes"),
    )


_SECONDS = "CASE WHEN event_type = 'view' THEN NULL ELSE user_id * 3600 END"


@query(f"SELECT event_id, user_id FROM events WHERE ts + to_seconds(coalesce({_SECONDS}, 3600)) > TIMESTAMP '2024-01-15 00:00:00'")
def ttl_live(spark, d):
    """Times given for some rows; the default for the rest."""
    return ttl.live(table(spark, d, "events"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), F.expr(_SECONDS)).select("event_id", "user_id")


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts + to_seconds(coalesce({_SECONDS}, 3600)) <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def ttl_sweep(spark, d):
    rows = ttl.ended(table(spark, d, "events"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), F.expr(_SECONDS))
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id, ts + to_seconds(3600) AS ends FROM events")
def ttl_default(spark, d):
    return table(spark, d, "events").select("event_id", ttl.expiry(F.col("ts")).alias("ends"))


@query("SELECT count(*) AS n FROM events")
def ttl_off(spark, d):
    return ttl.live(table(spark, d, "events"), "ts", _now(), enabled=False).agg(F.count("*").alias("n"))
