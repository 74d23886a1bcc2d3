"""Queries of the scalar and text functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkv.functions import codecs, dates, net, text
from sparkkv.operators import textmatch
from sparkkv.plans.registry import query
from sparkkv.plans.sql import CRC32_TABLE, crc32_sql
from sparkkv.sources.tables import table

TERMS = [("the", 1), ("tion", 2), ("able", 4), ("license", 16), ("mit", 8), ("zebra", 64)]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query("SELECT doc_id, md5(text) AS digest, strlen(text)::INT AS bytes FROM documents")
def md5_digest(spark, d):
    return _docs(spark, d).select("doc_id", F.md5("text").alias("digest"), F.octet_length("text").alias("bytes"))


@query(f"WITH {CRC32_TABLE} SELECT doc_id, {crc32_sql('hex(encode(text))')} AS crc, {crc32_sql('hex(encode(text))', 1)} AS seeded FROM documents, crc32_table")
def crc32_digest(spark, d):
    """CRC-32, whole and carried on from a seed."""
    b = F.col("text").cast("binary")
    return _docs(spark, d).select("doc_id", F.crc32(b).alias("crc"), codecs.crc32_from(F.lit(1), b).alias("seeded"))


def _url_encode_sql(x: str) -> str:
    out = f"url_encode({x})"
    for c in text.URL_SAFE:
        out = f"replace({out}, '%{ord(c):02X}', '{c if c != chr(39) else chr(39) * 2}')"
    return out


@query(f"SELECT page_id, {_url_encode_sql('url')} AS encoded, url_decode({_url_encode_sql('url')}) = url AS back FROM pages")
def url_codec(spark, d):
    p = table(spark, d, "pages").withColumn("encoded", text.url_encode(F.col("url")))
    return p.select("page_id", "encoded", (text.url_decode(F.col("encoded")) == F.col("url")).alias("back"))


@query("SELECT doc_id, trim(trim(text), ' .ATt') AS t, ltrim(text, ' AT') AS l, rtrim(text, ' .') AS r FROM documents")
def trim_chars(spark, d):
    x = F.col("text")
    return _docs(spark, d).select("doc_id", text.trim(x, ".ATt").alias("t"), text.ltrim(x, "AT").alias("l"), text.rtrim(x, ".").alias("r"))


@query("SELECT doc_id, replace(text, 'the', 'THE') AS t, substr(replace(text, 'tion', '-'), 1, 40) AS cut FROM documents")
def replace_all(spark, d):
    x = F.col("text")
    return _docs(spark, d).select("doc_id", text.replace_all(x, "the", "THE").alias("t"), text.replace_all(x, "tion", "-", 40).alias("cut"))


@query("SELECT event_id, event_type AS a, user_id::VARCHAR AS b, 2 AS n FROM events")
def split_pairs(spark, d):
    line = F.concat(F.lit("a="), F.col("event_type"), F.lit(";junk;b="), F.col("user_id").cast("string"), F.lit(";x"))
    p = table(spark, d, "events").withColumn("p", text.pairs(line, ";"))
    return p.select("event_id", F.get("p", F.lit(0))["value"].alias("a"), F.get("p", F.lit(1))["value"].alias("b"), F.size("p").alias("n"))


@query("SELECT c_custkey, hex(c_name) AS h, c_name AS back, NULL IS NULL AS bad FROM customer")
def hex_codec(spark, d):
    c = table(spark, d, "customer").withColumn("h", F.hex("c_name"))
    return c.select("c_custkey", "h", text.unhex(F.col("h")).cast("string").alias("back"), text.unhex(F.concat("h", F.lit("4"))).isNull().alias("bad"))


@query("""WITH i AS (SELECT event_id, user_id % 240 AS a, event_id % 256 AS b, (event_id // 7) % 256 AS c, user_id % 256 AS e FROM events)
SELECT event_id, a * 16777216 + b * 65536 + c * 256 + e AS number, CASE WHEN a * 16777216 + b * 65536 + c * 256 + e = 0 THEN 'any' WHEN a = 127 THEN 'loopback' WHEN a >= 224 THEN 'multicast' WHEN a = 169 AND b = 254 THEN 'linklocal' ELSE 'other' END AS kind FROM i""")
def ipv4(spark, d):
    parts = [F.col("user_id") % 240, F.col("event_id") % 256, F.expr("(event_id div 7) % 256"), F.col("user_id") % 256]
    e = table(spark, d, "events").withColumn("number", net.ipv4_number(F.concat_ws(".", *[p.cast("string") for p in parts])))
    return e.select("event_id", "number", net.ipv4_kind(F.col("number")).alias("kind"))


@query("SELECT event_id, 'h' || user_id AS host, CASE WHEN event_id % 2 = 0 THEN event_id::INT ELSE 0 END AS port FROM events")
def endpoint_parse(spark, d):
    s = F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(":"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("x"))
    return table(spark, d, "events").withColumn("e", net.endpoint(s)).select("event_id", "e.host", "e.port")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fe80::1' WHEN 1 THEN 'db' ELSE '0.0.0.0' END AS host, CASE WHEN event_id % 3 = 2 THEN 80 ELSE 8080 END AS port FROM events")
def address_parse(spark, d):
    n = F.col("event_id") % 3
    s = F.when(n == 0, "[fe80::1]:8080").when(n == 1, "db:8080").otherwise("80")
    return table(spark, d, "events").withColumn("a", net.address(s)).select("event_id", "a.host", "a.port")


@query("SELECT event_id, list_extract(['any', 'loopback', 'multicast', 'linklocal', 'mapped', 'other', NULL], (event_id % 7 + 1)::INT) AS kind FROM events")
def ipv6(spark, d):
    forms = ["::", "::1", "ff02::1", "fe80::2", "::ffff:1.2.3.4", "2001:db8::1", "junk"]
    s = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", net.ipv6_kind(s).alias("kind"))


@query("SELECT event_id, printf('%06d|%-8s|%.2f', event_id, event_type, value) AS line FROM events")
def formatted(spark, d):
    return table(spark, d, "events").select("event_id", F.format_string("%06d|%-8s|%.2f", "event_id", "event_type", "value").alias("line"))


@query("""SELECT c_custkey, regexp_full_match(c_mktsegment, '[A-Za-z]+') AS alpha, regexp_full_match(c_mktsegment, '[A-Z]+') AS upper, regexp_full_match(c_mktsegment, '[a-z]+') AS lower,
regexp_full_match(c_name, '[A-Za-z0-9]+') AS alnum, regexp_full_match(c_custkey::VARCHAR, '[0-9]+') AS digit, regexp_full_match(c_custkey::VARCHAR, '[0-9A-Fa-f]+') AS xdigit,
regexp_full_match(c_name, '[!-~]+') AS graph, regexp_full_match(c_name, '[ -~]+') AS print, regexp_full_match(c_name, '[\\x00-\\x7F]+') AS ascii,
c_custkey % 4 < 2 AS blank, c_custkey % 4 < 3 AS space, c_custkey % 4 = 1 OR c_custkey % 4 = 2 AS cntrl, c_custkey % 4 = 3 AS punct FROM customer""")
def char_classes(spark, d):
    seg, name, key = F.col("c_mktsegment"), F.col("c_name"), F.col("c_custkey").cast("string")
    of = {"alpha": seg, "upper": seg, "lower": seg, "alnum": name, "digit": key, "xdigit": key, "graph": name, "print": name, "ascii": name}
    # Two blanks; a tab; a tab and a line break; signs.
    white = F.element_at(F.array(*map(F.lit, ["  ", "\t", "\t\n", "#!"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    of |= {c: white for c in ("blank", "space", "cntrl", "punct")}
    return table(spark, d, "customer").select("c_custkey", *[text.of_class(x, c).alias(c) for c, x in of.items()])


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain, strftime(ts, '%Y%m%d%H%M%S') AS compact, strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') AS http, date_trunc('second', ts) AS back FROM events""")
def date_formats(spark, d):
    ts = F.col("ts").cast("timestamp")
    e = table(spark, d, "events").select("event_id", dates.show(ts).alias("plain"), dates.show(ts, dates.COMPACT).alias("compact"), dates.show(ts, dates.HTTP).alias("http"))
    return e.withColumn("back", dates.parse(F.col("compact"), dates.COMPACT).cast("timestamp_ntz"))


@query("SELECT event_id, date_trunc('hour', ts) AS hour, date_trunc('day', ts)::TIMESTAMP AS day, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS dd, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, epoch_us(ts) AS micros FROM events")
def date_parts(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", dates.to_hour(ts).cast("timestamp_ntz").alias("hour"), dates.to_day(ts).cast("timestamp_ntz").alias("day"), F.year(ts).alias("y"), F.month(ts).alias("m"),
        F.dayofmonth(ts).alias("dd"), F.hour(ts).alias("h"), F.minute(ts).alias("mi"), F.second(ts).alias("s"), F.unix_micros(ts.cast("timestamp")).alias("micros"),
    )


@query("""WITH t AS (SELECT event_id, (event_id % 11 - 5) * 1000000 + (event_id * 777777 % 5000000 - 2500000) AS u FROM events)
SELECT event_id, floor(u / 1000000)::BIGINT AS sec, (u - floor(u / 1000000) * 1000000)::BIGINT AS usec FROM t""")
def duration_normalise(spark, d):
    n = dates.normalised(F.col("event_id") % 11 - 5, F.col("event_id") * 777777 % 5000000 - 2500000)
    return table(spark, d, "events").withColumn("n", n).select("event_id", "n.sec", "n.usec")


@query("SELECT doc_id, (2 * (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))))::INT AS bytes, true AS same FROM documents")
def utf16_roundtrip(spark, d):
    b = codecs.utf16_bytes(F.col("text"))
    return _docs(spark, d).select("doc_id", F.octet_length(b).alias("bytes"), (codecs.utf16_text(b) == F.col("text")).alias("same"))


#: Letters outside ASCII that the fixture's languages share with GBK (fixed values); GBK has two bytes for each.
_GBK_LETTERS = "àáèéêìíòóùúü"


@query(f"""WITH g AS (SELECT doc_id, text, NOT regexp_matches(text, '[^\x00-\x7F{_GBK_LETTERS}]') AS ok FROM documents)
SELECT doc_id, CASE WHEN ok THEN length(text) + length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) END::INT AS bytes, CASE WHEN ok THEN md5(text) END AS back,
CASE WHEN ok THEN 2 * length(text) END::INT AS utf16_bytes FROM g""")
def gbk_roundtrip(spark, d):
    """GBK and back, and UTF-16 to GBK and back; texts with letters that GBK lacks give null."""
    b = _docs(spark, d).withColumn("gbk", codecs.utf16_to_gbk(codecs.utf16_bytes(F.col("text"))))
    return b.select("doc_id", F.octet_length("gbk").alias("bytes"), F.md5(codecs.gbk_text("gbk").cast("binary")).alias("back"), F.octet_length(codecs.gbk_to_utf16(F.col("gbk"))).alias("utf16_bytes"))


@query("SELECT page_id, list_extract(string_split(rtrim(url, '/'), '/'), -1) AS last FROM pages")
def path_name(spark, d):
    return table(spark, d, "pages").select("page_id", text.base_name(F.col("url")).alias("last"))


@query("SELECT c_custkey, true AS same, c_acctbal FROM customer")
def xml_roundtrip(spark, d):
    """Rows to XML and back."""
    c = table(spark, d, "customer").withColumn("x", F.to_xml(F.struct("c_custkey", "c_name", "c_acctbal")))
    back = F.from_xml("x", "c_custkey long, c_name string, c_acctbal double")
    return c.withColumn("b", back).select("c_custkey", (F.col("b.c_name") == F.col("c_name")).alias("same"), "b.c_acctbal")


@query("""WITH q AS (SELECT event_id, concat('k=', event_type, '&Name=a%20b+c&x=', user_id::VARCHAR, '&junk') AS s FROM events),
p AS (SELECT event_id, unnest(string_split(s, '&')) AS part, generate_subscripts(string_split(s, '&'), 1) - 1 AS pos FROM q)
SELECT event_id, pos::INT AS pos, split_part(part, '=', 1) AS key, lower(split_part(part, '=', 1)) AS lower_key, replace(split_part(part, '=', 2), '%20', ' ') AS value FROM p WHERE part LIKE '%=%'""")
def query_args(spark, d):
    url = F.concat(F.lit("http://h/p?k="), F.col("event_type"), F.lit("&Name=a%20b+c&x="), F.col("user_id").cast("string"), F.lit("&junk#f"))
    e = table(spark, d, "events").select("event_id", F.posexplode(text.query_arguments(url)).alias("pos", "a"))
    return e.select("event_id", "pos", "a.key", "a.lower_key", "a.value")


_HIT = "greatest(" + ", ".join(f"CASE WHEN contains({{t}}, '{w}') THEN {n} ELSE 0 END" for w, n in TERMS) + ")"


@query(f"SELECT doc_id, {_HIT.format(t='text')}::INT AS level, {_HIT.format(t='lower(text)')}::INT AS level_nocase FROM documents")
def filter_level(spark, d):
    x = F.col("text")
    return _docs(spark, d).select("doc_id", textmatch.level(x, TERMS).cast("int").alias("level"), textmatch.level(F.lower(x), TERMS).cast("int").alias("level_nocase"))


def _places(text: str, between: str) -> str:
    """SQL for each document's match: the highest level, then leftmost, then shortest; ``between`` may stand between its characters."""
    terms = ", ".join(f"('{between.join(w)}', {1 << (n.bit_length() - 1)})" for w, n in TERMS)
    return f"""WITH h AS (SELECT doc_id, level, t, regexp_extract({text}, w) AS hit FROM (SELECT doc_id, {text} AS t, text FROM documents), (VALUES {terms}) v(w, level)),
p AS (SELECT doc_id, level, strpos(t, hit) - 1 AS start, length(hit) AS length FROM h WHERE hit <> ''),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC, start, length) = 1)
SELECT d.doc_id, b.level::INT AS level, b.start::INT AS start, b.length::INT AS length FROM documents d LEFT JOIN b USING (doc_id)"""


@query(_places("text", ""))
def filter_match(spark, d):
    """The match itself (level, place, length)."""
    m = textmatch.matcher(textmatch.dictionary(spark.createDataFrame(TERMS, "term string, level int")))
    return _docs(spark, d).withColumn("m", m("text")).select("doc_id", "m.level", "m.start", "m.length")


@query(_places("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "[- ]*"))
def filter_match_stop_words(spark, d):
    m = textmatch.matcher(textmatch.dictionary(spark.createDataFrame(TERMS, "term string, level int")), stop_words=["-", " "], case=False)
    return _docs(spark, d).withColumn("m", m("text")).select("doc_id", "m.level", "m.start", "m.length")


@query("SELECT term, bit_or(level)::INT AS level, (1 << floor(log2(bit_or(level)))::INT)::INT AS top FROM (VALUES ('a', 1), ('a', 4), ('b', 2), ('c', 64), ('c', 3)) t(term, level) GROUP BY 1")
def filter_dictionary(spark, d):
    rows = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2), ("c", 64), ("c", 3)], "term string, level int")
    return textmatch.dictionary(rows).withColumn("top", textmatch.top_bit(F.col("level")).cast("int"))


@query("SELECT doc_id, replace(replace(replace(text, 'tion', chr(1)), 'the', 'XX'), chr(1), 'N') AS t FROM documents")
def multi_replace(spark, d):
    """One pass: what was put in isn't searched again."""
    rows = spark.createDataFrame([("the", "zz", 1), ("the", "XX", 2), ("tion", "N", 1)], "src string, repl string, seq int")
    return _docs(spark, d).select("doc_id", textmatch.replacer(textmatch.replacements(rows))("text").alias("t"))


@query("SELECT doc_id, regexp_replace(text, 'license', '', 'gi') AS t FROM documents")
def multi_replace_nocase(spark, d):
    rows = spark.createDataFrame([("LICENSE", None, 1)], "src string, repl string, seq int")
    return _docs(spark, d).select("doc_id", textmatch.replacer(textmatch.replacements(rows), case=False)("text").alias("t"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type").where("k IS NOT NULL")
