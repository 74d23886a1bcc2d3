"""Queries over the mutation log as such, packages, routing and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkv.operators import log, package, routing
from sparkkv.plans.kv_queries import LOG
from sparkkv.plans.registry import query
from sparkkv.plans.sql import CRC32_TABLE, crc32_sql
from sparkkv.sources import files, messages
from sparkkv.sources.tables import mutation_log, table


@query("""WITH b AS (SELECT event_id AS sid, user_id AS stream, length(props) + 64 AS size FROM events),
f AS (SELECT *, floor(coalesce(sum(size) OVER (PARTITION BY stream ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000)::BIGINT AS file_no FROM b)
SELECT stream, file_no, count(*) AS n, min(sid) AS first_sid, max(sid) AS last_sid, sum(size)::BIGINT AS bytes FROM f GROUP BY 1, 2""")
def log_rotate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("sid"), F.col("user_id").alias("stream"), (F.length("props") + 64).alias("size"))
    rows = log.rotate(rows, F.col("size"), 1000, "stream")
    return rows.groupBy("stream", "file_no").agg(F.count("*").alias("n"), F.min("sid").alias("first_sid"), F.max("sid").alias("last_sid"), F.sum("size").alias("bytes"))


@query("""WITH b AS (SELECT event_id AS sid, user_id AS stream, length(props) + 64 AS size FROM events),
f AS (SELECT *, floor(coalesce(sum(size) OVER (PARTITION BY stream ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000)::BIGINT AS file_no FROM b)
SELECT stream, file_no, n FROM (SELECT stream, file_no, count(*) AS n FROM f GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY stream ORDER BY file_no DESC) <= 2""")
def log_retention(spark, d):
    """Only the two newest files of a stream are kept."""
    return log.retained(log_rotate(spark, d), "stream", 2).select("stream", "file_no", "n")


@query("""WITH s AS (SELECT user_id AS stream, event_id AS seq, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events)
SELECT stream, seq - step AS after_seq, step - 1 AS missing FROM s WHERE step > 1""")
def log_gaps(spark, d):
    return log.gaps(table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq")), "stream")


@query(f"WITH {LOG} SELECT sid, k, op, v FROM log")
def log_replayed_once(spark, d):
    """The log delivered twice counts once."""
    rows = mutation_log(spark, d).select("sid", "k", "op", "v")
    return log.once(rows.unionByName(rows.where("sid % 3 = 0")))


@query(f"WITH {LOG}, a AS (SELECT k, max(sid) FILTER (op = 'set') AS p FROM log GROUP BY k) SELECT a.k, (SELECT count(*) FROM log l WHERE l.k = a.k AND l.sid > a.p) AS lag, (SELECT count(*) FROM log l WHERE l.k = a.k AND l.sid > a.p) <= 20 AS tolerated FROM a WHERE p IS NOT NULL")
def log_lag(spark, d):
    rows = mutation_log(spark, d)
    applied = rows.where("op = 'set'").groupBy("k").agg(F.max("sid").alias("applied_sid"))
    return log.lag_of(rows, applied, "k", 20)


@query(f"WITH {LOG} SELECT sid, k, kind FROM log WHERE kind IN ('purchase', 'signup')")
def log_subscribe(spark, d):
    return mutation_log(spark, d).where(F.col("kind").isin("purchase", "signup")).select("sid", "k", "kind")


@query(f"WITH {LOG} SELECT sid, k, op FROM log WHERE sid > 600")
def log_resume(spark, d):
    """What a subscriber gets that has seen everything up to sid 600."""
    return mutation_log(spark, d).where("sid > 600").select("sid", "k", "op")


@query("""WITH b AS (SELECT user_id AS stream, event_id AS sid, length(props) + 64 AS size FROM events),
f AS (SELECT *, floor(coalesce(sum(size) OVER (PARTITION BY stream ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 65536)::BIGINT AS chunk FROM b)
SELECT stream, chunk, count(*) AS n, sum(size)::BIGINT AS bytes FROM f GROUP BY 1, 2""")
def log_chunks(spark, d):
    """Transfer units of 64 KB."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("sid"), (F.length("props") + 64).alias("size"))
    rows = log.rotate(rows, F.col("size"), 65536, "stream").withColumnRenamed("file_no", "chunk")
    return rows.groupBy("stream", "chunk").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT event_id, md5(concat(event_id::VARCHAR, '|', user_id::VARCHAR, '|', event_type)) AS signature FROM events")
def log_sign(spark, d):
    return table(spark, d, "events").select("event_id", F.md5(F.concat_ws("|", "event_id", "user_id", "event_type")).alias("signature"))


@query(f"WITH {CRC32_TABLE}, b AS (SELECT event_id, concat_ws('|', event_id, user_id, event_type) AS body FROM events) SELECT event_id, {crc32_sql('hex(encode(body))')} AS crc, strlen(body)::INT AS bytes FROM b, crc32_table")
def log_crc(spark, d):
    """CRC-32 of every record."""
    e = table(spark, d, "events").withColumn("body", F.concat_ws("|", "event_id", "user_id", "event_type").cast("binary"))
    return e.select("event_id", F.crc32("body").alias("crc"), F.length("body").alias("bytes"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS queued, count(*) > 20 AS refused FROM events GROUP BY 1")
def log_backpressure(spark, d):
    """Hours in which more than 20 writes queue up, so that further ones would fail."""
    return table(spark, d, "events").groupBy(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("queued")).withColumn("refused", F.col("queued") > 20)


@query("""WITH a AS (SELECT user_id AS k, ts, event_id AS sid, 'east' AS site, value AS v FROM events WHERE event_type = 'purchase'),
b AS (SELECT user_id AS k, ts + INTERVAL 1 HOUR AS ts, event_id AS sid, 'west' AS site, value * 2 AS v FROM events WHERE event_type = 'view'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT k, ts, sid, site, v FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, sid DESC, site DESC) = 1""")
def log_cross_site(spark, d):
    e = table(spark, d, "events")
    east = e.where("event_type = 'purchase'").select(F.col("user_id").alias("k"), "ts", F.col("event_id").alias("sid"), F.lit("east").alias("site"), F.col("value").alias("v"))
    west = e.where("event_type = 'view'").select(F.col("user_id").alias("k"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("event_id").alias("sid"), F.lit("west").alias("site"), (F.col("value") * 2).alias("v"))
    return log.merged(east, west)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def kv_range_export(spark, d):
    return files.export_range(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 100, 1100)


# Packages ------------------------------------------------------------------------------------------------------------------------


def _packages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    items = F.array(package.item(F.lit("Name"), F.col("c_name")), package.item(F.lit("segment"), F.col("c_mktsegment")), package.item(F.lit("name"), F.reverse("c_name")), package.item(F.lit("empty"), F.lit("")))
    return c.select("c_custkey", "c_name", "c_mktsegment", items.alias("items"))


@query("SELECT c_custkey, 4 AS n, (32 + 20 + 2 * strlen(c_name) + strlen(c_mktsegment))::INT AS bytes, c_name AS first_name, c_mktsegment AS segment, true AS ok FROM customer")
def package_roundtrip(spark, d):
    """Encoded, decoded (count, size, first and named item)."""
    p = _packages(spark, d).withColumn("wire", package.encode(F.col("items"))).withColumn("back", package.decode("wire"))
    at = package.by_index(F.col("back"), 0)
    return p.select(
        "c_custkey", F.size("back").alias("n"), F.octet_length("wire").alias("bytes"), at["value"].cast("string").alias("first_name"),
        package.by_name(F.col("back"), "SEGMENT", case=False)["value"].cast("string").alias("segment"), (package.valid(F.col("back")) & (F.col("back") == F.col("items"))).alias("ok"),
    )


@query("""SELECT c_custkey, 2 AS after_all, 2 AS removed_all, 3 AS after_first, 'segment' AS first_key, 3 AS after_index, 'x' AS changed, reverse(c_name) AS second_name, 'new' AS last_key, NULL::BINARY IS NULL AS refused FROM customer""")
def package_edit(spark, d):
    p, i = _packages(spark, d), F.col("items")
    every, one = package.remove(i, "NAME", every=True, case=False), package.remove(i, "name", case=False)
    changed = package.modify(i, "name", F.lit("x"), case=False)
    return p.select(
        "c_custkey", F.size(every["items"]).alias("after_all"), every["removed"].alias("removed_all"), F.size(one["items"]).alias("after_first"),
        package.by_index(one["items"], 0)["key"].alias("first_key"), F.size(package.remove_at(i, 1)).alias("after_index"), package.by_index(changed, 0)["value"].cast("string").alias("changed"),
        package.by_index(changed, 2)["value"].cast("string").alias("second_name"), F.element_at(package.append(i, F.lit("new"), F.lit("y")), -1)["key"].alias("last_key"),
        package.append(i, F.lit("new"), F.lit("y"), 10).isNull().alias("refused"),
    )


@query("SELECT c_custkey, concat('Name=', c_name, chr(10), 'segment=', c_mktsegment, chr(10), 'name=', reverse(c_name), chr(10), 'empty=', chr(10)) AS text FROM customer")
def package_render(spark, d):
    return _packages(spark, d).select("c_custkey", package.render(F.col("items")).alias("text"))


@query("SELECT event_id, 1::BIGINT AS version, user_id % 7 AS attr, length(event_type)::BIGINT AS kind, event_id AS task, length(props)::BIGINT AS size FROM events")
def message_head(spark, d):
    """Packed and read again; the checksum holds."""
    e = table(spark, d, "events")
    head = package.pack_head(F.lit(1), F.col("user_id") % 7, F.length("event_type"), F.col("event_id"), F.length("props"))
    return e.withColumn("h", package.read_head(head)).select("event_id", "h.version", "h.attr", "h.kind", "h.task", "h.size")


#: Bytes of messages in a file: the unit in which logs are decoded.
LOG_FILE = 65536


@query("SELECT event_id AS task, length(event_type)::INT AS kind, event_type AS body, NULL::VARCHAR AS error FROM events")
def message_log(spark, d):
    """Messages of one key in files of about ``LOG_FILE`` bytes, read back."""
    e = table(spark, d, "events")
    m = F.concat(package.pack_head(F.lit(1), F.lit(0), F.length("event_type"), F.col("event_id"), F.octet_length("event_type")), F.col("event_type").cast("binary"))
    rows = e.select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("stream"), F.col("event_id").alias("sid"), m.alias("m")).where("m IS NOT NULL")
    rows = log.rotate(rows, F.octet_length("m"), LOG_FILE, "stream")
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sid", "m"))), lambda x: F.hex(x["m"])), "")
    logs = rows.groupBy("stream", "file_no").agg(F.unhex(one).alias("content")).select(F.concat_ws("/", "stream", "file_no").alias("path"), "content")
    return messages.decoded(logs).select("task", "kind", F.col("body").cast("string").alias("body"), "error")


# Routing -------------------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, list_sum(list_transform(range(1, strlen(url) + 1), lambda i: ascii(substr(url, i, 1))))::BIGINT % 5 AS host FROM pages")
def route_bytesum(spark, d):
    return table(spark, d, "pages").select("page_id", routing.route(F.col("url"), 5, F.xxhash64("url")).alias("host"))


@query("SELECT p.page_id, CASE WHEN split_part(split_part(url, '://', 2), '/', 1) IN (SELECT split_part(split_part(url, '://', 2), '/', 1) FROM pages WHERE page_id < 20) THEN 'hashed' ELSE 'spread' END AS policy FROM pages p")
def route_keys(spark, d):
    """Only listed hosts are routed by hash."""
    p = table(spark, d, "pages").withColumn("host", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)))
    listed = p.where("page_id < 20").select("host").distinct().withColumn("listed", F.lit(True))
    return p.join(listed, "host", "left").select("page_id", F.when(F.col("listed"), "hashed").otherwise("spread").alias("policy"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' AND user_id % 3 = 0 THEN 900 WHEN user_id % 3 = 1 THEN 500 ELSE 200 END::INT AS timeout_ms,
CASE WHEN user_id % 3 = 1 THEN 5 ELSE 2 END::INT AS retries FROM events""")
def policy_resolve(spark, d):
    asked = table(spark, d, "events").select("event_id", (F.col("user_id") % 3).cast("int").alias("service"), F.col("event_type").alias("message"))
    messages = spark.createDataFrame([(0, "view", 900, None)], "service int, message string, timeout_ms int, retries int")
    services = spark.createDataFrame([(1, 500, 5), (2, None, None)], "service int, timeout_ms int, retries int")
    return routing.resolved(asked, messages, services, {"timeout_ms": 200, "retries": 2}).select("event_id", "timeout_ms", "retries")


@query("""WITH h AS (SELECT n_nationkey AS host_no, n_name AS host, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey * 100 END::BIGINT AS invalid_ms, (n_nationkey - 7 + 25) % 25 AS place FROM nation),
u AS (SELECT *, invalid_ms IS NULL OR 2500 - invalid_ms > 900 AS ok FROM h)
SELECT host_no, host, invalid_ms, CASE WHEN ok THEN count(*) FILTER (ok) OVER (ORDER BY place) - 1 END::INT AS attempt FROM u""")
def route_failover(spark, d):
    """Every fourth host has failed at some time; those that failed within 900 ms are passed over."""
    failed = F.when(F.col("n_nationkey") % 4 == 0, (F.col("n_nationkey") * 100).cast("long"))
    hosts = table(spark, d, "nation").select(F.col("n_nationkey").alias("host_no"), F.col("n_name").alias("host"), failed.alias("invalid_ms"))
    return routing.failover(hosts, F.lit(7), 25, now=2500, restore_ms=900)


@query("SELECT event_id, CASE WHEN value::INT * 4 - 100 < 0 THEN 400 WHEN value::INT * 4 - 100 >= 400 THEN value::INT * 4 - 100 ELSE 200 END AS status FROM (SELECT event_id, floor(value) AS value FROM events)")
def response_code(spark, d):
    code = F.floor("value").cast("int") * 4 - 100
    return table(spark, d, "events").select("event_id", routing.response(code).alias("status"))


@query("""WITH e AS (SELECT event_id, user_id, list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) AS kind FROM events)
SELECT a.event_id AS request, min(b.event_id) AS reply FROM e a JOIN e b ON a.user_id = b.user_id AND b.kind = a.kind + 1 AND b.event_id > a.event_id GROUP BY 1""")
def reply_match(spark, d):
    """Replies: the same key's next message whose type is the request's type plus one."""
    kind = F.array_position(F.array(*map(F.lit, ["view", "click", "signup", "purchase", "error"])), F.col("event_type"))
    return routing.replies(table(spark, d, "events").select("event_id", "user_id", kind.cast("int").alias("kind")), "user_id", "event_id", "kind")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS hosts FROM nation GROUP BY 1")
def host_order(spark, d):
    hosts = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(hosts["n_name"], ",").alias("hosts"))


@query("SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000 AS delay_ms FROM events")
def delay_ms(spark, d):
    return routing.delays(table(spark, d, "events"), "user_id").select("event_id", "delay_ms")


# Files ---------------------------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS p FROM documents), u AS (SELECT id, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS line_no, len(p) AS n FROM l)
SELECT id, line_no, line FROM u WHERE NOT (line_no = n AND line = '')""")
def text_lines(spark, d):
    return files.numbered_lines(table(spark, d, "documents"), "doc_id", "text")
