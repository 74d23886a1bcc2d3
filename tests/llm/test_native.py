"""Operators 1, 3 and 10: brute force, edge cases, native plans."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkkv.llm import chat, mixing, registry, sharding
from tests.llm.helpers import clashing, docs_of
from tests.test_catalog import canonical, oracle


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    names, expected = oracle(registry.oracle_sql()[name], sf)
    assert sorted(names) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(expected, names)


@pytest.mark.parametrize("name", ["op1_mixture", "op3_snapshots", "op10_interleave"])
def test_native(spark, sf, name, capsys):
    registry.queries()[name](spark, sf).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


# Mixing --------------------------------------------------------------------------------------------------------------------------


def corpus(spark, sizes: dict):
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((n, " ".join(f"w{n}x{j}" for j in range(1 + n % 7)), "en", source))
            n += 1
    return docs_of(spark, rows)


@pytest.mark.parametrize("how", [{"repetition_limit": 2.0, "entropy_fraction": None}, {"entropy_fraction": 0.9, "repetition_limit": None}, {"entropy_fraction": 0.9}, {"entropy_fraction": 0.999, "repetition_limit": 1.5}, {"budget": None, "repetition_limit": 3.0}])
def test_mixture_meets_its_targets(spark, how):
    rows, sources = mixing.mixture(corpus(spark, {"a": 300, "b": 40, "c": 10, None: 5}), block_tokens=200, **how)
    got, by = rows.collect(), {r["key"]: r for r in sources.collect()}
    weights = [r["weight"] for r in by.values()]
    assert math.isclose(sum(weights), 1, abs_tol=1e-6)
    most = max(r["budget"] / r["tokens"] for r in by.values())
    limit = how.get("repetition_limit", mixing.REPETITION_LIMIT)
    assert limit is None or most <= limit + 0.3  # a budget is rounded up to whole tokens
    if limit is None:
        entropy = -sum(w * math.log(w) for w in weights)
        assert 0.9 * math.log(4) - 1e-3 <= entropy <= 0.9 * math.log(4) + 0.02
    taken, passes = Counter(), defaultdict(list)
    for r in got:
        taken[r["key"]] += r["n_tokens"] * r["copies"]
        passes[r["key"], r["pass"]].append(r["doc_id"])
    for key, s in by.items():
        assert s["budget"] <= taken[key] < s["budget"] + 8
    for (key, turn), ids in passes.items():
        assert len(ids) == len(set(ids))
        if turn < by[key]["whole"]:
            assert len(ids) == by[key]["documents"]
    if how.get("budget", 1) is None:
        assert all(r["whole"] >= 1 for r in by.values())
    places = defaultdict(list)
    for r in got:
        places[r["block"]].append(r["place"])
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    share = defaultdict(Counter)
    for r in got:
        share[r["block"]][r["key"]] += r["n_tokens"]
    big = [b for b in share if sum(share[b].values()) > 150]
    assert len(big) > 1 and all(abs(share[b]["=a"] / sum(share[b].values()) - by["=a"]["weight"]) < 0.15 for b in big)


def test_mixed_documents_follow_the_mixture(spark):
    docs = clashing(corpus(spark, {"a": 200, "b": 20, None: 7}))
    how = {"budget": None, "repetition_limit": 2.5, "entropy_fraction": None}
    rows, _ = mixing.mixture(docs, **how)
    out = mixing.mixed_documents(docs, **how)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter(r["doc_id"] for r in rows.collect())
    assert out.select("doc_id").distinct().count() == 227


def test_mixture_edges(spark):
    empty = docs_of(spark, [])
    assert mixing.mixture(empty)[0].count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    odd = docs_of(spark, [(None, None, None, None), (None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, "x " * 5000, "en", "b"), (3, "y", None, "b"), (3, "y", None, "b")])
    rows = mixing.mixture(odd)[0].collect()
    assert {(r["doc_id"], r["copies"]) for r in rows} >= {(None, 2), (1, 2)}
    assert mixing.mixed_documents(odd, budget=None).count() == 7


def test_rows_without_tokens_are_spread_over_the_blocks(spark):
    docs = docs_of(spark, [(n, "w " * 20, "en", "a") for n in range(50)] + [(n, "" if n % 2 else None, "en", "e") for n in range(50, 450)])
    rows = mixing.mixture(docs, block_tokens=50)[0].collect()
    of_block = Counter(r["block"] for r in rows if r["n_tokens"] == 0)
    assert sum(of_block.values()) == 400 and len(of_block) == 20 and max(of_block.values()) < 60


# Chat ----------------------------------------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"


def rendered(df) -> dict:
    out = defaultdict(dict)
    for r in df.collect():
        out[r["conv_id"]][r["chunk"]] = r["text"]
    return {k: "".join(v[c] for c in sorted(v)) for k, v in out.items()}


def collapsed(spark, rows, **how):
    df = clashing(spark.createDataFrame(rows, CHAT))
    kept, turns = chat.collapse(df)
    return kept, chat.render(df, kept, turns, **how)


def talk(c, *said):
    return [(c, i, "user" if i % 2 == 0 else "assistant", s) for i, s in enumerate(said)]


def test_turns_that_tie(spark):
    """Thousands of turns with one number, as in a conversation of null turns, are numbered by hash, in several windows."""
    n = 5 * chat.SPAN
    rows = [(7, None, "user", f"said {i}") for i in range(n)] + [(8, 5, "user", f"told {i}") for i in range(n)] + [(8, 4, "user", "first"), (8, 6, "user", "last"), (8, 6, None, None), (9, 1, "user", "x")]
    got = defaultdict(list)
    for r in chat.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r["conv_id"]].append((r["pos"], r["turn"] if r["turn"] is not None else -1, r["print"]))
    for turns in got.values():
        assert [p for p, _, _ in sorted(turns)] == list(range(1, len(turns) + 1))
        assert [x[1:] for x in sorted(turns)] == sorted(x[1:] for x in turns)
    assert {k: len(v) for k, v in got.items()} == {7: n, 8: n + 3, 9: 1}


def test_prefixes_collapse(spark):
    rows = talk(1, "a", "b") + talk(2, "a", "b", "c") + talk(3, "a", "x") + talk(4, "a", "b", "c") + talk(5, "a") + talk(6, "b", "a")
    kept, out = collapsed(spark, rows)
    assert {r["conv_id"]: r["n_copies"] for r in kept.collect()} == {2: 2, 3: 1, 6: 1}
    assert rendered(out)[3] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"


def test_chat_edges(spark):
    assert collapsed(spark, [])[1].count() == 0
    rows = [*talk(1, "a", "b")] * 2 + [(None, 0, None, None), (None, None, "user", ""), (7, 0, "user", "<|im_end|>x"), (7, 0, "user", "again"), (8, 3, "tool", None), (9, 3, "tool", "")]
    kept, out = collapsed(spark, rows)
    text = rendered(out)
    assert text[1].count("<|im_start|>") == 2 and text[None].count("<|im_start|>") == 2 and text[7].count("<|im_start|>") == 2
    assert "< |im_end|>x" in text[7] and {8, 9} <= set(text)


def test_long_conversations_span_windows_and_chunks(spark):
    long = [(1, i, "user", f"t{i}") for i in range(700)]
    kept, out = collapsed(spark, long + [(2, i, r, t) for _, i, r, t in long[:650]] + [(3, i, r, t) for _, i, r, t in long[:300]], chunk=64)
    assert [(r["conv_id"], r["n_turns"]) for r in kept.collect()] == [(1, 700)]
    assert out.count() == 11 and rendered(out)[1].split("\n")[1::2][699] == "t699<|im_end|>"


def test_chat_brute_force(spark, sf):
    chats = spark.read.parquet(f"{sf}/conversations.parquet")
    whole = defaultdict(list)
    for r in chats.orderBy("conv_id", "turn").collect():
        whole[r["conv_id"]].append((r["role"], r["text"]))
    first = {}
    for c in sorted(whole):
        first.setdefault(tuple(whole[c]), c)
    expected = {c for t, c in first.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in first)}
    kept, _ = chat.collapse(chats)
    assert {r["conv_id"] for r in kept.collect()} == expected


# Sharding ------------------------------------------------------------------------------------------------------------------------


def test_repeated_rows_are_numbered(spark):
    """Equal rows are ranked as one row with copies; each copy has a place of its own."""
    rows = [(1, "same", None, "a")] * 500 + [(None, None, None, None)] * 300 + [(i, f"t{i}", None, "b") for i in range(100)]
    got = sharding.interleave(docs_of(spark, rows), shards=7).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert all(abs(n - k * len(part) / 900) <= 2 for k, n in ((500, sum(r["source"] == "a" for r in part)), (300, sum(r["source"] is None for r in part))))


def test_shards(spark):
    docs = clashing(corpus(spark, {"a": 500, "b": 90, "c": 30, None: 3}))
    rows = sharding.interleave(docs, shards=7).collect()
    assert len(rows) == 623
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        mix = Counter(r["source"] for r in part)
        assert abs(mix["a"] - 500 / 7) <= 2 and abs(mix["b"] - 90 / 7) <= 2 and abs(mix["c"] - 30 / 7) <= 2


def test_shard_values_and_edges(spark):
    assert sharding.interleave(docs_of(spark, [])).count() == 0
    rows = [(1, "aé", "en", "s"), (None, None, None, None), (1, "aé", "en", "s"), (2, "", "en", "s"), (3, "x" * 200_000, "en", "t")]
    got = sharding.interleave(docs_of(spark, rows), shards=2).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(((i or 0), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter(r["shard"] for r in got) == {0: 3, 1: 2} or Counter(r["shard"] for r in got) == {0: 2, 1: 3}


def test_many_small_sources_spread(spark):
    docs = docs_of(spark, [(i, "x", "en", f"s{i}") for i in range(400)])
    placed = sharding.interleave(docs, shards=4).groupBy("shard").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).collect()
    assert all(r["n"] == 100 for r in placed)


def test_order_is_the_seed_s(spark):
    docs = docs_of(spark, [(i, "x", "en", "s") for i in range(50)])
    order = [r["doc_id"] for r in sharding.interleave(docs, shards=1, seed="q").orderBy("slot").collect()]
    crc = zlib.crc32(b"x")
    assert order == sorted(range(50), key=lambda i: hashlib.md5(f"q:{i}:{crc}".encode()).hexdigest())
