"""Operators 5 and 8, components and the pipeline: brute force and edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkkv.llm import graph, jaccard, neighbours
from tests.llm.helpers import clashing, docs_of
from tests.llm.test_texts import UPPER, check_packed, real


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    u = Union({x for p in links for x in p})
    for a, b in links:
        u.join(a, b)
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: u.find(x) for p in links if p[0] != p[1] for x in p}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Jaccard -------------------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def documents_by_hand(rows):
    """Sorted [(doc_id, n, component)] for rows (doc_id, text) whose ids may repeat."""
    sets = [shingles(t) for _, t in rows]
    u = Union({i for i, _ in rows})
    for k, (a, _) in enumerate(rows):
        for m in range(k):
            both = len(sets[k] & sets[m])
            if both and 100 * both >= 75 * (len(sets[k]) + len(sets[m]) - both):
                u.join(a, rows[m][0])
    return sorted((i, len(s), u.find(i)) for (i, _), s in zip(rows, sets, strict=True))


def jaccard_by_hand(rows):
    """{doc_id: (n, component)} for unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    u, ids = Union(sets), [i for i in sets if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                u.join(a, b)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def made(seed, n=260):
    """Texts with a shared passage, exact copies, near copies around the threshold, and one large group."""
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(4000)}"
    passage = [word() for _ in range(30)]
    texts = [[word() for _ in range(rng.randrange(0, 60))] for _ in range(n // 3)]
    while len(texts) < n:
        t = list(rng.choice(texts[: n // 3]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if t:
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], [word()], [t[k], word()]])
        texts.append(passage + t if rng.random() < 0.3 else t)
    big = [word() for _ in range(90)]
    for _ in range(70):
        t = list(big)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    ids = rng.sample(range(10_000), len(texts))
    return [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_by_brute_force(spark, seed):
    rows = made(seed)
    got = jaccard.near_components(docs_of(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard_by_hand(rows)


def documents(spark, rows):
    got = jaccard.near_components(docs_of(spark, [(i, t, None, None) for i, t in rows])).collect()
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


_W = [f"x{i}" for i in range(60)]
_A, _B, _C, _D = (" ".join(_W[a:b]) for a, b in ((0, 20), (20, 40), (40, 60), (40, 59)))


def test_an_id_with_several_texts(spark):
    cases = [
        [(3, _A), (5, _A), (5, _B), (7, _B), (4, _B)],
        [(3, _A), (5, _A), (5, _B), (7, _B)],
        [(3, _A), (5, _A), (5, _C), (7, _D)],
        [(5, _A), (5, _A), (5, ""), (2, ""), (9, _A.upper()), (5, None), (2, None), (8, _C), (8, _C.upper()), (9, _D)],
        [(1, _B), (2, _B), (2, _A), (2, _A), (3, _C), (3, ""), (4, "x0"), (4, "x1"), (6, "x1")],
    ]
    # In one run: each case with ids and words of its own.
    rows = [(100 * k + i, t and t.replace("x", f"c{k}x").replace("X", f"C{k}X")) for k, case in enumerate(cases) for i, t in case]
    assert documents(spark, rows) == documents_by_hand(rows)


def test_repeated_ids_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(150), t) for _, t in made(4, 200)]
    assert documents(spark, rows) == documents_by_hand(rows)


def test_set_ids_that_collide_are_made_anew(spark, monkeypatch):
    real_id = jaccard.node_id
    monkeypatch.setattr(jaccard, "node_id", lambda seed: real_id(seed) if seed else F.col("n"))
    rows = [(1, _A), (2, _B), (3, _A), (4, _C), (5, _D)]
    assert documents(spark, rows) == documents_by_hand(rows)


@pytest.mark.parametrize("long", [4, 10**9])
def test_jaccard_without_leaders(spark, monkeypatch, long):
    """The index alone finds every link, with lists that are compared block by block, in one task or split."""
    monkeypatch.setattr(jaccard, "LONG_LIST", long)
    monkeypatch.setattr(jaccard, "band_pairs", lambda keys, *a: keys.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(jaccard, "SHORT_LIST", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = made(9, 120)
    got = jaccard.near_components(docs_of(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard_by_hand(rows)


@pytest.mark.parametrize("long", [16, 10**9])
def test_jaccard_pairs_of_a_large_group(spark, monkeypatch, long):
    """The pairs left to the index grow with the group, not with its square, though a third of its sets is just too far from its middle to link."""
    rng, made_, real_saved = random.Random(6), {}, jaccard.saved

    def counted(df, name="table"):
        out = real_saved(df, name)
        made_[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "saved", counted)
    monkeypatch.setattr(jaccard, "LONG_LIST", long)
    middle = [f"m{i}" for i in range(150)]
    rows = []
    for i in range(160):
        t = list(middle)
        for k in rng.sample(range(2, 148), rng.randrange(8)):
            t[k] = f"e{i}x{k}"
        rows.append((i, " ".join(t)))
    assert documents(spark, rows) == documents_by_hand(rows)
    assert made_["list-pairs"] <= 10 * len(rows)


def test_jaccard_on_the_fixture(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in real(spark, sf).collect()]
    got = jaccard.near_components(real(spark, sf)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard_by_hand(rows)


def test_jaccard_threshold_is_exact(spark):
    w = [f"x{i}" for i in range(30)]
    rows = [(1, " ".join(w[:11])), (2, " ".join(w[:12] + ["q"])), (3, " ".join(["p", "p"] + w[:12] + ["p"])), (4, "A b"), (9, "a  B"), (5, "a b c"), (6, None), (7, ""), (8, " \n")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(clashing(docs_of(spark, [(i, t, None, None) for i, t in rows]))).collect()}
    assert got == jaccard_by_hand(rows) and got[9] == (1, 4) and got[6] == (0, 6)


def test_jaccard_edges(spark):
    assert jaccard.near_components(docs_of(spark, [])).count() == 0
    assert jaccard.near_components(docs_of(spark, [(1, None, None, None)])).collect()[0][1:] == (0, 1)
    t = "one two three four five six"
    got = jaccard.near_components(docs_of(spark, [(None, t, None, None), (3, t, None, None), (3, t, None, None), (2, t, None, None), (None, None, None, None), (5, "x " * 50_000, None, None)])).collect()
    assert sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in got if r["doc_id"]) == [(2, 2, 2), (3, 2, 2), (3, 2, 2), (5, 1, 5)]
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None) == [(0, None), (2, None)]


# Embeddings ----------------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors_by_hand(rows):
    unit = {}
    for i, e, label in rows:
        if e is not None and label is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e):
            x = np.array(e, np.float32).astype(float)
            unit[i] = x / np.linalg.norm(x), label
    n, u = defaultdict(int), Union([r[0] for r in rows])
    ids = list(unit)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (x, p), (y, q) = unit[a], unit[b]
            if p == q and len(x) == len(y) and x @ y >= 0.93:
                n[a] += 1
                n[b] += 1
                u.join(a, b)
    return {i: (n[i], u.find(i), u.find(i) == i) for i, _, _ in rows}


def answers(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def groups(seed, n):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.standard_normal((12, 16))
    for i in rng.permutation(n).tolist():
        x = rng.standard_normal(16) if rng.random() < 0.4 else centres[rng.integers(12)] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.25])
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_vectors_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours.link_counts, "__defaults__", (block,))
    rows = groups(block, 400)
    assert answers(neighbours.near_vectors(clashing(spark.createDataFrame(rows, VECTORS)))) == vectors_by_hand(rows)


def test_a_large_tight_group(spark):
    rng = np.random.default_rng(4)
    c = rng.standard_normal(16)
    rows = [(i, [float(v) for v in (c + rng.standard_normal(16) * 0.02)], 1) for i in range(1300)]
    got = answers(neighbours.near_vectors(spark.createDataFrame(rows, VECTORS)))
    assert set(got.values()) == {(1299, 0, True), (1299, 0, False)} and got[0][2]


def unaudited(monkeypatch):
    """The audit has no query nodes, so it can't mend what the descent misses."""
    real_audit = neighbours.audit
    monkeypatch.setattr(neighbours, "audit", lambda nodes, *a, **k: real_audit(nodes.where("first < 0"), *a, **k))


@pytest.mark.parametrize("noise", [0.001, 0.03])
def test_linked_clumps_are_one_component(spark, monkeypatch, noise):
    """All lists are full of links inside a clump; the links between the clumps are in none."""
    unaudited(monkeypatch)
    rng = np.random.default_rng(7)
    a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
    rows = [(i, [float(v) for v in (a if i % 2 else 0.94 * a + (1 - 0.94**2) ** 0.5 * b) + rng.standard_normal(16) * noise], 1) for i in range(300)]
    assert answers(neighbours.near_vectors(spark.createDataFrame(rows, VECTORS))) == vectors_by_hand(rows)


def test_descent_goes_on_while_lists_change(spark, monkeypatch):
    """The number of entries is flat early; the last round is one that changed no entry."""
    unaudited(monkeypatch)
    real_descend, rounds = neighbours.descend, []

    def descend(*a):
        out = jaccard.saved(real_descend(*a))
        rounds.append({(r["src"], r["dst"]) for r in out.collect()})
        return out

    monkeypatch.setattr(neighbours, "descend", descend)
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in 1 + rng.standard_normal(24) * 0.3], 1) for i in range(600)]
    neighbours.near_vectors(spark.createDataFrame(rows, VECTORS))
    full = {s for s, n in Counter(s for s, _ in rounds[-1]).items() if n >= neighbours.LONGEST}
    assert {e for e in rounds[-1] if e[0] not in full} == {e for e in rounds[-2] if e[0] not in full}


def test_lost_pairs_count_as_much_as_a_large_group(spark, monkeypatch):
    """The first forest finds nothing but the large group; the pairs weigh enough for a second one."""
    real_forest = neighbours.forest
    monkeypatch.setattr(neighbours, "forest", lambda nodes, levels, seed, *a: real_forest(nodes.where("first < 600") if seed == 0 else nodes, levels, seed, *a))
    rng = np.random.default_rng(11)
    c, pairs = rng.standard_normal(16), rng.standard_normal((100, 16))
    large = [(i, [float(v) for v in c + rng.standard_normal(16) * 0.02], 1) for i in range(600)]
    small = [(600 + i, [float(v) for v in pairs[i // 2] + rng.standard_normal(16) * 0.02], 2) for i in range(200)]
    assert answers(neighbours.near_vectors(spark.createDataFrame(large + small, VECTORS))) == vectors_by_hand(large + small)


def test_recall_that_is_not_reached_raises(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FORESTS", 1)
    monkeypatch.setattr(neighbours, "forest", lambda nodes, *a: nodes.sparkSession.createDataFrame([], neighbours.EDGES))
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.near_vectors(spark.createDataFrame([(i, [1.0, i / 1000], 1) for i in range(20)], VECTORS))


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [None, 1.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [1e-30, 0.0], 1)]
    assert answers(neighbours.near_vectors(spark.createDataFrame(rows, VECTORS))) == vectors_by_hand(rows)
    assert neighbours.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    got = neighbours.near_vectors(spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1)], VECTORS)).collect()
    assert sorted(((r["vec_id"] or 0), r["n_links"]) for r in got) == [(0, 0), (1, 1), (1, 1)]


def test_an_id_with_several_vectors(spark):
    """Cases with labels of their own, in one run: a row's links are its own vector's, its component that of all vectors of its id."""
    a, b, c, near = [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [-1.0, 0.1]
    cases = [
        [(1, a), (1, b), (2, b)],
        [(3, a), (5, a), (5, b), (7, b), (4, b)],
        [(3, a), (5, a), (5, c), (7, near)],
        [(5, a), (5, None), (5, [0.0, 0.0]), (5, a), (2, a), (8, None), (8, None), (9, [0.0, 0.0]), (9, [-0.0, 1.0]), (9, b)],
    ]
    rows = [(100 * k + i, v, k) for k, case in enumerate(cases) for i, v in case]
    u, n = Union({i for i, _, _ in rows}), [0] * len(rows)
    for x, (i, v, k) in enumerate(rows):
        for y, (j, w, m) in enumerate(rows):
            if x != y and k == m and v and w and any(v) and any(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                n[x] += 1
                u.join(i, j)
    got = neighbours.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted((i, x, u.find(i), u.find(i) == i) for (i, _, _), x in zip(rows, n, strict=True))


def test_audit_finds_the_links_of_its_queries(spark, sf):
    rows = groups(5, 120)
    nodes, _ = neighbours.nodes_of(neighbours.vectors(spark.createDataFrame(rows, VECTORS)))
    n = nodes.count()
    truth = {(r["a"], r["b"]) for r in neighbours.audit(nodes, n, 0.93, bound=n).collect()}
    unit = {r["node"]: (np.frombuffer(bytes(r["vec"])), r["key"]) for r in nodes.collect()}
    assert truth == {(a, b) for a in unit for b in unit if a != b and unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= 0.93}


# Pipeline ------------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    docs, out = clashing(real(spark, sf)), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(jaccard.saved(stage(spark, out[-1] if out else docs, sf)))
    assert all(x.columns == docs.columns for x in out[:-1])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    assert {r["doc_id"] for r in out[0].collect()} == known
    by_hand = jaccard_by_hand([(i, texts[i]) for i in known])
    assert sorted(r["doc_id"] for r in out[1].collect()) == sorted(i for i in known if by_hand[i][1] == i)
    mixed = [r["doc_id"] for r in out[2].collect()]
    assert set(mixed) == {r["doc_id"] for r in out[1].collect()}
    packed, times = out[3].collect(), max(mixed.count(i) for i in set(mixed))
    assert times <= corpus_pipeline.REPEATS + 1
    if times == 1:
        check_packed(packed, {i: texts[i] for i in set(mixed)}, 2048)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_pipeline_edges(spark):
    rows = [(None, "les en de", "fr", None), (1, None, "en", "a"), (2, "123", "en", "a"), (3, "the and of", "en", "a"), (3, "the and of", "en", "a"), (4, "the and of", "en", "b"), (None, "les en de", "fr", None)]
    docs = clashing(docs_of(spark, rows))
    for name, stage in corpus_pipeline.STAGES:
        docs = jaccard.saved(stage(spark, docs, ""))
        if name == "near_duplicates":
            assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 0, 3]
    assert docs.where("doc_id = 3").count() >= 1
    empty = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0 and "sequence_id" in empty.columns


def test_language_stage_without_usable_labels(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 == 2)
    for lang in (None, "en"):
        docs = docs_of(spark, [(held, "the and of", lang, "a"), (held, "123", None, "a"), (held, None, None, "a")])
        assert [r["text"] for r in corpus_pipeline.language(spark, docs, "").collect()] == ["the and of"]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rows = [(5, "one two three", "en", "a"), (5, "quite another text", "en", "a"), (5, "quite another text", "en", "a"), (2, "one two three", "en", "b"), (None, "one two three", "en", "b"), (9, "a third one", "en", "b")]
    got = corpus_pipeline.near_duplicates(spark, clashing(docs_of(spark, rows)), "").collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in got) == [(0, "one two three"), (2, "one two three"), (5, "quite another text"), (9, "a third one")]


def test_vectors_of_the_fixture(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table.collect()]
    assert answers(neighbours.near_vectors(table)) == vectors_by_hand(rows)
    assert table.where(F.col("label").isNull()).count() == 0
