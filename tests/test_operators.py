"""Hand-computed cases, properties and edge cases of the keyed engine."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkkv.functions import codecs, dates, net, text
from sparkkv.operators import kv, log, package, routing, textmatch, ttl
from sparkkv.operators.baseline import as_of_join
from sparkkv.sources import files, shared

LOG = "sid long, ts timestamp_ntz, k long, op string, v double"
T0 = dt.datetime(2024, 1, 1)


def of(spark, rows, schema=LOG):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def folded(df) -> dict:
    return {r["k"]: r["v"] for r in df.collect()}


def by_hand(rows) -> dict:
    state = {}
    for sid, _, k, op, v in sorted(rows):
        if op == "set":
            state[k] = v
        elif op == "del":
            state.pop(k, None)
        elif op == "inc":
            state[k] = state.get(k, 0) + v
    return state


ROWS = [(1, T0, 1, "set", 5.0), (2, T0, 1, "inc", 2.0), (3, T0, 2, "inc", 1.0), (4, T0, 2, "del", 0.0), (5, T0, 3, "hit", 9.0), (6, T0, 2, "inc", 4.0), (7, T0, 4, "set", 1.0), (8, T0, 4, "del", 0.0)]


def test_fold_by_hand(spark):
    assert folded(kv.fold(of(spark, ROWS))) == by_hand(ROWS) == {1: 7.0, 2: 4.0}


def test_fold_of_an_empty_log(spark):
    assert kv.fold(of(spark, [])).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ops=st.lists(st.tuples(st.integers(0, 4), st.sampled_from(["set", "inc", "del", "hit"]), st.integers(0, 9)), max_size=30), cut=st.integers(0, 30))
def test_fold_is_replay_and_needs_no_order(spark, ops, cut):
    rows = [(i, T0, k, op, float(v)) for i, (k, op, v) in enumerate(ops)]
    whole = of(spark, rows)
    assert folded(kv.fold(whole.repartition(3, "sid"))) == by_hand(rows)
    assert folded(kv.fold(log.once(whole.union(whole)))) == by_hand(rows)
    assert folded(kv.fold(whole, span=4)) == by_hand(rows)
    assert folded(kv.fold_tail(kv.as_of(whole, cut), whole.where(F.col("sid") > cut))) == by_hand(rows)


def test_reads_and_mutations(spark):
    store, new = of(spark, [(1, "a"), (2, "b")], "k long, v string"), of(spark, [(2, "x"), (3, "c")], "k long, v string")
    assert {tuple(r) for r in kv.add(store, new, "k").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in kv.update(store, new, "k", "v").collect()} == {(1, "a"), (2, "x")}
    assert {tuple(r) for r in kv.remove(store, new, "k").collect()} == {(1, "a")}
    assert {(r["k"], r["found"]) for r in kv.multi_get(store, new, "k").collect()} == {(2, True), (3, False)}
    assert [r["k"] for r in kv.listing(store, "k", 0, 9, 1, descending=True).collect()] == [2]
    assert kv.get(of(spark, [], "k long, v string"), "k", 1).count() == 0


def test_point_read_reaches_the_scan(spark, sf, capsys):
    kv.get(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name"), "c_custkey", 7).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(c_custkey,7)" in plan and "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan


def test_fold_shuffles_once(spark, sf, capsys):
    from sparkkv.sources.tables import mutation_log

    kv.fold(mutation_log(spark, sf)).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_wide_keys_keep_their_order(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, 255, 256, 2**62)], "k long").select("k", kv.wide_key(F.col("k"), 32).alias("w"))
    assert [r["k"] for r in rows.orderBy("w").collect()] == [0, 1, 255, 256, 2**62]
    assert len(rows.first()["w"]) == 32


def test_ttl(spark):
    rows = of(spark, [(1, T0, None), (2, T0, 10), (3, T0, 7200)], "k long, ts timestamp_ntz, s int")
    now = F.lit(T0 + dt.timedelta(seconds=1800)).cast("timestamp_ntz")
    assert {r["k"] for r in ttl.live(rows, "ts", now, F.col("s")).collect()} == {1, 3}
    assert {r["k"] for r in ttl.ended(rows, "ts", now, F.col("s")).collect()} == {2}
    assert ttl.live(rows, "ts", now, F.col("s"), enabled=False).count() == 3


#: RFC 1321's test suite (fixed values).
MD5 = {
    "": "d41d8cd98f00b204e9800998ecf8427e",
    "a": "0cc175b9c0f1b6a831c399e269772661",
    "abc": "900150983cd24fb0d6963f7d28e17f72",
    "message digest": "f96b697d7cb7938d525a2f31aaf161d0",
    "abcdefghijklmnopqrstuvwxyz": "c3fcd3d76192e4007dfb496cca67e13b",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "d174ab98d277d9f5a5611c2c9f419d9f",
    "12345678901234567890123456789012345678901234567890123456789012345678901234567890": "57edf4a22be3c955ac49da2e2107b67a",
}


def test_md5(spark):
    got = {r["s"]: r["m"] for r in spark.createDataFrame([(s,) for s in MD5], "s string").select("s", F.md5("s").alias("m")).collect()}
    assert got == MD5


@pytest.mark.parametrize(
    ("column", "value"),
    [
        (lambda: text.url_encode(F.lit("a b/c~(x)*")), "a%20b/c~(x)*"),
        (lambda: text.url_decode(F.lit("a%2Bb+c")), "a+b+c"),
        (lambda: text.url_decode(F.lit("%4A")), "J"),
        (lambda: text.url_decode(F.lit("%zz")), None),
        (lambda: text.unhex(F.lit("4A4b")).cast("string"), "JK"),
        (lambda: text.unhex(F.lit("4")), None),
        (lambda: text.rtrim(F.lit("ab.. "), "."), "ab"),
        (lambda: text.trim(F.lit("  a ")), "a"),
        (lambda: text.base_name(F.lit("/a/b/")), "b"),
        (lambda: text.of_class(F.lit(""), "alpha"), False),
        (lambda: net.ipv4_number(F.lit("1.2.3.4")), 0x01020304),
        (lambda: net.ipv4_number(F.lit("1.2.3.256")), 0),
        (lambda: net.endpoint(F.lit("h:80"))["port"], 80),
        (lambda: net.endpoint(F.lit(":80")), None),
        (lambda: net.endpoint(F.lit("h")), None),
        (lambda: net.endpoint(F.lit("h:x"))["port"], 0),
        (lambda: net.address(F.lit("[::1]:9"))["family"], "v6"),
        (lambda: net.address(F.lit("?")), None),
        (lambda: dates.normalised(F.lit(1), F.lit(-1))["usec"], 999999),
        (lambda: dates.normalised(F.lit(0), F.lit(-2_500_000))["sec"], -3),
        (lambda: dates.parse(F.lit("junk")), None),
        (lambda: codecs.crc32_from(F.lit(0), F.lit("abc").cast("binary")), 0x352441C2),
        (lambda: codecs.gbk_text(codecs.gbk_bytes(F.lit("a中文"))), "a中文"),
        (lambda: codecs.gbk_bytes(F.lit("😀")), None),
        (lambda: codecs.utf16_text(codecs.utf16_bytes(F.lit("é中"))), "é中"),
        (lambda: routing.byte_sum(F.lit("ab")), 195),
        (lambda: routing.response(F.lit(-1)), 400),
        (lambda: routing.response(F.lit(503)), 503),
        (lambda: textmatch.top_bit(F.lit(6)), 4),
        (lambda: textmatch.top_bit(F.lit(0)), 0),
    ],
)
def test_functions(spark, column, value):
    assert one(spark, column()) == value


def test_message_head_by_hand(spark):
    head = package.pack_head(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5))
    assert one(spark, F.hex(head)) == "010200030000000400000005000F"
    assert one(spark, package.read_head(head))["task"] == 4
    assert one(spark, package.read_head(head, most=4)) is None
    assert one(spark, package.read_head(F.unhex(F.lit("0102000300000004000000050010")))) is None


def test_package_item_by_hand(spark):
    items = F.array(package.item(F.lit("a"), F.lit("xy")))
    assert one(spark, F.hex(package.encode(items))) == "0000000B000161007879" + "00"


@given(st.lists(st.tuples(st.text(max_size=5).filter(lambda s: "�" not in s), st.binary(max_size=9), st.booleans()), max_size=6))
def test_package_parse(items):
    wire = b"".join((8 + len(k.encode()) + len(v) | (n << 31)).to_bytes(4, "big") + len(k.encode()).to_bytes(2, "big") + k.encode() + b"\0" + v + b"\0" for k, v, n in items)
    assert package.parse(wire) == items
    if wire:
        assert package.parse(wire[:-1]) is None
        assert package.parse(wire[:-1] + b"x") is None


def test_damaged_packages_are_null(spark):
    rows = spark.createDataFrame([(None,), (bytearray(b"\0\0\0\x05"),), (bytearray(b""),)], "b binary").select(package.decode("b").alias("x"))
    assert [r["x"] for r in rows.collect()] == [None, None, []]


def test_matcher(spark):
    terms = spark.createDataFrame([("bad", 1), ("worse", 4), ("badly", 1), ("", 8)], "term string, level int")
    m = textmatch.matcher(textmatch.dictionary(terms), stop_words=["-"])
    rows = spark.createDataFrame([("so b-a-d",), ("bad, worse",), ("fine",), (None,), ("-badly",)], "t string")
    got = [r["m"] and (r["m"]["level"], r["m"]["start"], r["m"]["length"]) for r in rows.select(m("t").alias("m")).collect()]
    assert got == [(1, 3, 5), (4, 5, 5), (None, None, None), (None, None, None), (1, 1, 3)]  # the first end of a term counts, not the longest


def test_matcher_places_and_order(spark):
    """Places are those of the text as it is; of equal levels the leftmost, then the shortest counts; only A-Z and a-z are one without case."""
    terms = spark.createDataFrame([("mit", 1), ("mi", 1), ("LICENSE", 2), ("k", 4)], "term string, level int")
    m = textmatch.matcher(textmatch.dictionary(terms), stop_words=["-", "--x"], case=False)
    rows = [("ßß mit",), ("licenſe \u212a",), ("a LiCe-n--x-se",), ("",), (None,), ("-m-",)]
    got = [tuple(r["m"]) for r in spark.createDataFrame(rows, "t string").withColumn("m", m("t")).collect()]
    assert got == [(1, 3, 2), (None, None, None), (2, 2, 12), (None,) * 3, (None,) * 3, (None,) * 3]


def test_replacer_without_case(spark):
    r = textmatch.replacer(textmatch.replacements(spark.createDataFrame([("LICENSE", "x", 1), ("li", "y", 1)], "src string, repl string, seq int")), case=False)
    rows = [("a licenſe, License LICENSES li",), (None,), ("",)]
    assert [x["o"] for x in spark.createDataFrame(rows, "t string").withColumn("o", r("t")).collect()] == ["a ycenſe, x xS y", None, ""]


def test_add_stores_a_repeated_new_key_once(spark):
    store, new = spark.createDataFrame([(1, "a", 1)], "k int, v string, w int"), spark.createDataFrame([(2, "c", 1), (2, "b", 2), (1, "z", 3)], "k int, v string, w int")
    assert sorted(tuple(r) for r in kv.add(store, new, "k").collect()) == [(1, "a", 1), (2, "b", 2)]


def test_replies_wait_for_their_type(spark):
    rows = [("a", 1, 1), ("a", 2, 1), ("a", 3, 3), ("a", 4, 2), ("a", 5, 3), ("b", 6, 2), (None, 7, 1), (None, 8, 2), ("a", 9, None)]
    got = routing.replies(spark.createDataFrame(rows, "k string, n long, t int"), "k", "n", "t").collect()
    assert sorted(map(tuple, got)) == [(1, 4), (2, 4), (4, 5), (7, 8)]


def test_shared_folder_of_a_cluster():
    assert [shared.is_local(m) for m in ("local", "local[4]", "local-cluster[2,1,1024]", "yarn", "spark://h:7077", "k8s://h")] == [True, True, False, False, False, False]


def test_replacer_is_leftmost_longest_and_single_pass(spark):
    r = textmatch.replacer(textmatch.replacements(spark.createDataFrame([("a", "b", 1), ("ab", "a", 1), ("c", "x", 1), ("c", None, 2)], "src string, repl string, seq int")))
    assert [x["y"] for x in spark.createDataFrame([("aabc",), (None,)], "t string").select(r("t").alias("y")).collect()] == ["ba", None]


def test_message_files(spark, tmp_path):
    from sparkkv.sources import messages

    def message(body, wrong=0):
        n = len(body)
        return bytes([1, 0]) + (7).to_bytes(2, "big") + (9).to_bytes(4, "big") + n.to_bytes(4, "big") + (1 + 7 + 9 + n + wrong & 0xFFFF).to_bytes(2, "big") + body

    for name, data in {"good.log": message(b"a") + message(b"") * 2, "bad.log": message(b"a") + message(b"b", 1), "cut.log": message(b"abc")[:-1], "head.log": b"\1", "none.log": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = messages.message_log(spark, str(tmp_path), "*.log").selectExpr("element_at(split(path, '/'), -1) AS f", "position", "body", "error").collect()
    assert sorted((r["f"], r["position"], r["error"]) for r in got) == [("bad.log", 0, None), ("bad.log", 15, "checksum"), ("cut.log", 0, "short body"), ("good.log", 0, None), ("good.log", 15, None), ("good.log", 29, None), ("head.log", 0, "short head")]
    assert messages.message_log(spark, str(tmp_path), "good.log", most=0).first()["error"] == "length"


def test_gaps_and_rotation(spark):
    rows = of(spark, [("s", 1), ("s", 2), ("s", 5), ("t", 9)], "stream string, seq long")
    assert [tuple(r) for r in log.gaps(rows, "stream").collect()] == [("s", 2, 2)]
    sized = of(spark, [("s", i, 40) for i in range(5)], "stream string, sid long, size int")
    assert [r["file_no"] for r in log.rotate(sized, F.col("size"), 100, "stream", span=2).orderBy("sid").collect()] == [0, 0, 0, 1, 1]


def test_as_of_join_takes_the_latest_at_or_before(spark):
    left = of(spark, [(1, 5), (1, 1), (2, 5)], "k long, t long")
    right = of(spark, [(1, 2, "a"), (1, 5, "b"), (1, 6, "c")], "k long, u long, v string")
    assert {tuple(r) for r in as_of_join(left, right, "k", "t", "u", ["v"]).collect()} == {(1, 5, "b"), (1, 1, None), (2, 5, None)}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x\n" + "y" * 5000 + "\n")
    assert files.lines(spark, str(tmp_path / "in")).count() == 2
    assert files.whole_texts(spark, str(tmp_path / "in")).count() == 1
    assert files.listing(spark, str(tmp_path / "in"), "*.txt").first()["length"] == 5003
    assert files.settings("[a]\nb = 1\n") == {"a": {"b": "1"}}
    (tmp_path / "x.xml").write_text("<r><row><k>1</k></row><row><k>2</k></row></r>")
    assert files.xml_rows(spark, str(tmp_path / "x.xml"), "row", "k long").count() == 2
    rows = of(spark, [(1, 0), (2, 1), (3, 0)], "k long, grp int")
    assert files.store(rows, "grouped", str(tmp_path / "g"), "grp").where("grp = 0").count() == 2
    assert files.store(rows, "columnar", str(tmp_path / "c")).count() == 3
    assert files.store(rows, "memory").count() == 3
    assert files.store(rows, "null") is None
    assert [r["k"] for r in files.export_range(rows, "k", 2, 4, str(tmp_path / "e")).orderBy("k").collect()] == [2, 3]


def test_stream_resumes_where_it_stopped(spark, sf, tmp_path):
    from sparkkv.streaming import replication as r

    folder = tmp_path / "log"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.where("event_id < 500").coalesce(1).write.parquet(str(folder))
    first = r.delivered(r.dispatched(spark, str(folder), "*.parquet").select("sid", "k"), "x", str(tmp_path / "at"))
    n = first.count()
    events.where("event_id >= 500").coalesce(1).write.mode("append").parquet(str(folder))
    again = r.delivered(r.dispatched(spark, str(folder), "*.parquet").select("sid", "k"), "x", str(tmp_path / "at"))
    assert again.count() == events.count() > n
    assert again.distinct().count() == events.count()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_message_logs_of_a_busy_key_are_bounded_files(spark, tmp_path, monkeypatch):
    from sparkkv.plans import audit_queries

    rows = [(i, 7, "view" if i % 3 else "purchase") for i in range(12_000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    sizes, decoded = [], audit_queries.messages.decoded

    def seen(logs):
        sizes.extend(r[0] for r in logs.selectExpr("length(content)").collect())
        return decoded(logs)

    monkeypatch.setattr(audit_queries.messages, "decoded", seen)
    got = audit_queries.message_log(spark, str(tmp_path)).collect()
    assert sorted((r["task"], r["kind"], r["body"], r["error"]) for r in got) == [(i, len(t), t, None) for i, _, t in rows]
    assert len(sizes) > 2 and max(sizes) <= 65536 + 100
