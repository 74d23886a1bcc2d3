"""Operator 8, embedding near-dedup: NN-descent.

1. Equal vectors of a label are one node with a count; its id is a hash of label and vector, checked to be its own. Vectors are normalised in double
   precision.
2. A forest of random hyperplane trees gives first neighbour lists: all pairs inside a leaf (in windows along a projection, so that
   a leaf of any size is worked off in bounded memory).
3. Descent: the neighbours of a node, forward and reverse, are compared with each other, and each keeps the best; again until the lists stop
   changing (by a checksum of their entries). Lists hold ``LIST`` neighbours; where all of them are links the list is saturated and doubles in
   every round, up to ``LONGEST``. A list full of ``LONGEST`` links isn't waited for: its component is bridged and counted exactly. Edges
   wider than twice a link's angle are dropped: no two links span more.
4. Audit: a hashed set of query nodes, which grows with the root of their number, is compared with all nodes. The share of a query's links whose
   ends are connected, as the mean over the queries that have links, is the recall: a query of a pair weighs as much as one of a large group. Below
   ``RECALL`` another forest with other planes and further rounds follow; if ``FORESTS`` don't reach it, the operator fails. The recall is logged.
5. Threshold edges give components. Those of more than ``LONGEST`` nodes, whose lists may be full, are compared with each other block by block, and
   joined where any two of their nodes are linked. Last, saturated lists are enlarged to their whole component: its members, in blocks of ``BLOCK``,
   are compared block by block, so that every vector's number of links is counted without a row for a pair. Block pairs whose centres and radii
   decide all their pairs at once (all links, or none) are counted without being compared.

Pairs of blocks are made by number (block i with each later j), so they are spread over tasks however large a component is. A component that isn't tight
still costs the square of its size in arithmetic.

Rows are never dropped or capped. The driver sees counts, the audit's vectors (``AUDITED``, or twice the root of the nodes), no links.

Defined results: a vector that is null, empty, zero, or has null or non-finite components, or whose label or vec_id is null, is linked with
nothing (n_links 0; its component is its vec_id); vectors of different length are never linked; repeated rows are vectors of
their own and linked with each other; rows that share a vec_id have their own n_links and one component, that of all their vectors, and the result has as
many rows as the input; an empty table gives an empty result; only vec_id, embedding and label are read.
"""

from __future__ import annotations

import itertools
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkv.llm.common import bucket_of, map_arrow, prefix_sums, root_buckets, saved, table
from sparkkv.llm.graph import components, empty_rows, repeated_ids, same_id_links, smallest_ids

THRESHOLD = 0.93
LIST, LONGEST = 8, 64
TREES, LEAF = 8, 24
WINDOW, OVERLAP = 512, 128
FORESTS = 8
AUDITED, RECALL = 256, 0.995
BLOCK = 512

log = logging.getLogger(__name__)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equal length from binary values."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def vectors(embeddings: DataFrame) -> DataFrame:
    """(id, key, vec) of every row; key holds label and length, and is null, like vec, where the vector can't be linked."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(v == 0, 0.0).otherwise(v))  # one zero
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    size = F.aggregate(x, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & (size > 0)
    key = F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string"))
    return embeddings.select(F.col("vec_id").cast("long").alias("id"), F.when(good, key).alias("key"), F.when(good, x).alias("vec"))


def node_id(seed: int) -> Column:
    """A node's id, from label and vector."""
    return F.xxhash64(F.lit(seed), "key", "vec")


def nodes_of(rows: DataFrame) -> tuple[DataFrame, int]:
    """(node, key, copies, first, vec): equal vectors of ``rows`` once, normalised (little-endian doubles); the seed under which every id is its own."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(4):
                x = np.asarray(v.values, np.float64)
                x = x / np.abs(x).max()
                out.append((x / np.linalg.norm(x)).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], ["node", "key", "copies", "first", "vec"])

    grouped = rows.where("key IS NOT NULL").groupBy("key", "vec").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    for seed in itertools.count():
        numbered = grouped.select(node_id(seed).alias("node"), "key", "copies", "first", "vec")
        nodes = saved(map_arrow(numbered, unit, "node long, key string, copies long, first long, vec binary"), "nodes")
        if not nodes.groupBy("node").count().where("count > 1").limit(1).count():
            return nodes, seed


def _best(sims: np.ndarray, ids: np.ndarray, most: int, floor: float, out: list) -> None:
    """Add (src, dst, sim) of each row's ``most`` best others that reach ``floor``."""
    np.fill_diagonal(sims, -2)
    if len(ids) - 1 > most:
        top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    else:
        top = np.broadcast_to(np.arange(len(ids)), sims.shape)
    found = np.take_along_axis(sims, top, axis=1)
    src, k = np.nonzero(found >= floor)
    out.append((ids[src], ids[top[src, k]], found[src, k]))


def _edges(out: list) -> Iterator[pa.RecordBatch]:
    if out and sum(len(x[0]) for x in out):
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["src", "dst", "sim"])


EDGES = "src long, dst long, sim double"


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(group, ids, vectors) in pieces of at most WINDOW rows from batches sorted by their first ``width`` columns; then id and float32 vector.

    A group longer than WINDOW comes in windows that overlap.
    """
    group, ids, rows = None, [], []
    for batch in batches:
        keys = list(zip(*[batch.column(k).to_pylist() for k in range(width)], strict=True))
        for g, i, v in zip(keys, batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
            if g != group or len(ids) == WINDOW:
                if len(ids) > 1:
                    yield group, np.array(ids), np.frombuffer(b"".join(rows), np.float32).reshape(len(ids), -1).astype(np.float64)
                ids, rows = ([], []) if g != group else (ids[-OVERLAP:], rows[-OVERLAP:])
                group = g
            ids.append(i)
            rows.append(v)
    if len(ids) > 1:
        yield group, np.array(ids), np.frombuffer(b"".join(rows), np.float32).reshape(len(ids), -1).astype(np.float64)


def forest(nodes: DataFrame, levels: int, seed: int, most: int = LIST, floor: float = 0.0, trees: int = TREES) -> DataFrame:
    """(src, dst, sim): neighbours within the leaves of ``trees`` random hyperplane trees."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column(2).to_pylist()], np.int64)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                part = batch.take(pa.array(at))
                x = _matrix(part.column(2), "<f8")
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, int(n)]).standard_normal((n, trees * (levels + 1)))
                side = x @ planes[n]
                bits = (side[:, : trees * levels] > 0).reshape(len(x), trees, levels)
                codes = (bits * (1 << np.arange(levels, dtype=np.int64))).sum(axis=2)
                short = [v.tobytes() for v in x.astype(np.float32)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * trees), pa.array(c.reshape(-1))) for c in (codes, side[:, trees * levels :])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists, pa.array(short, pa.binary())], ["node", "key", "leaf", "along", "vec"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, ids, x in _grouped(batches, 3):
            _best(x @ x.T, ids, most, floor, out)
            if len(out) > 500:
                yield from _edges(out)
                out = []
        yield from _edges(out)

    rows = map_arrow(nodes.select("node", "key", "vec"), leaves, "node long, key string, leaf array<long>, along array<double>, vec binary")
    rows = rows.select("node", "key", "vec", F.posexplode(F.arrays_zip("leaf", "along")).alias("tree", "at")).select("tree", "key", "at.leaf", "node", "vec", "at.along")
    rows = rows.repartition("tree", "key", "leaf").sortWithinPartitions("tree", "key", "leaf", "along")
    return map_arrow(rows.select("tree", "key", "leaf", "node", "vec"), pairs, EDGES)


def best_lists(edges: DataFrame, most: int, threshold: float) -> DataFrame:
    """Each node's ``LIST`` best edges, and up to ``most`` where they are links (a saturated list)."""
    edges = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= most).where((F.col("rank") <= LIST) | (F.col("sim") >= threshold)).drop("rank")


def descend(edges: DataFrame, nodes: DataFrame, most: int, threshold: float, floor: float) -> DataFrame:
    """The lists after one round of comparing the neighbours of each node with each other."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")).distinct()
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    around = both.withColumn("rank", rank).where(F.col("rank") <= 2 * most).select("src", F.col("dst").alias("node"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [np.frombuffer(v, "<f8").astype(np.float32).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(vec, pa.binary())], ["src", "node", "vec"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, ids, x in _grouped(batches, 1):
            _best(x @ x.T, ids, most, floor, out)
            if len(out) > 500:
                yield from _edges(out)
                out = []
        yield from _edges(out)

    rows = map_arrow(around.join(nodes.select("node", "vec"), "node").select("src", "node", "vec"), short, "src long, node long, vec binary")
    found = map_arrow(rows.repartition("src").sortWithinPartitions("src", "node"), pairs, EDGES)
    return best_lists(edges.union(found), most, threshold)


def exact_links(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the ``edges`` whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = [float(np.frombuffer(u, "<f8") @ np.frombuffer(v, "<f8")) >= threshold for u, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    pairs = edges.where(F.col("sim") >= threshold - 1e-5).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("vec").alias("va")), "a").join(nodes.select(F.col("node").alias("b"), F.col("vec").alias("vb")), "b")
    return map_arrow(pairs.select("a", "b", "va", "vb"), run, "a long, b long")


def audit(nodes: DataFrame, total: int, threshold: float, bound: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(a, b): the links of a hashed set of about ``bound`` query nodes, by comparing each with all nodes.

    With ``roots`` (id, root) instead (a, own, root, n): the number of its links in each component; ``own`` is the query's. Links are counted
    batch by batch, so that a query in a large group doesn't make a row for each.
    """
    bound = bound or max(AUDITED, 2 * math.isqrt(total))
    every = max(1, math.ceil(total / bound))
    placed = nodes.select("node", "key", "vec", F.col("node").alias("root"))
    if roots is not None:
        placed = nodes.join(roots, nodes["node"] == roots["id"], "left").select("node", "key", "vec", F.coalesce("root", "node").alias("root"))
    queries = placed.where(F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(every)) == 0).collect()
    by_key: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for key in {q["key"] for q in queries}:
        own = [q for q in queries if q["key"] == key]
        by_key[key] = np.array([q["node"] for q in own]), np.array([q["root"] for q in own]), np.frombuffer(b"".join(bytes(q["vec"]) for q in own), "<f8").reshape(len(own), -1)
    counted = roots is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column(1).to_pylist(), object)
            for key in set(keys) & set(by_key):
                at = np.flatnonzero(keys == key)
                ids, x = np.asarray(batch.column(0), np.int64)[at], _matrix(batch.column(2).take(pa.array(at)), "<f8")
                groups, group = np.unique(np.asarray(batch.column(3), np.int64)[at], return_inverse=True)
                for k in range(0, len(by_key[key][0]), 1024):
                    q, r, v = (c[k : k + 1024] for c in by_key[key])
                    i, j = np.nonzero((v @ x.T >= threshold) & (q[:, None] != ids[None]))
                    if len(i) and counted:
                        pairs, n = np.unique(i * len(groups) + group[j], return_counts=True)
                        i, g = np.divmod(pairs, len(groups))
                        yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(r[i]), pa.array(groups[g]), pa.array(n)], ["a", "own", "root", "n"])
                    elif len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(ids[j])], ["a", "b"])

    return map_arrow(placed, run, "a long, own long, root long, n long" if counted else "a long, b long")


def recall_of(asked: DataFrame) -> tuple[float, int]:
    """The mean share of a query's links that are in its component, over the queries of ``asked`` (audit with roots) that have links; their number."""
    shares = asked.groupBy("a").agg((F.sum(F.when(F.col("root") == F.col("own"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    share, n = shares.agg(F.avg("share"), F.count("*")).first()
    return (1.0 if share is None else share), n


def blocks_of(members: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The members (root, node, copies, vec) with their block, and the blocks of at most ``size`` members of a component."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            for r in zip(*rows, strict=True):
                if r[:2] != group:
                    if held:
                        yield block(group, held)
                    group, held = r[:2], []
                held.append(r[2:])
        if held:
            yield block(group, held)

    def block(group: tuple, held: list) -> pa.RecordBatch:
        ids, copies = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        x = np.frombuffer(b"".join(h[2] for h in held), "<f8").reshape(len(held), -1)
        centre = x.sum(axis=0)
        centre = centre / (np.linalg.norm(centre) or 1.0)
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        values = [group[0], group[1], ids.tobytes(), copies.tobytes(), x.tobytes(), centre.tobytes(), radius, int(copies.sum())]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["root", "block", "ids", "copies", "mat", "centre", "radius", "total"])

    members = members.withColumns({"mix": F.md5(F.col("node").cast("string")), "one": F.lit(1).cast("long")})
    slim = members.select("root", "node", "mix", "one").withColumn("part", bucket_of(F.col("mix"), root_buckets(members.count())))
    placed = prefix_sums(slim, ["root"], "part", ["mix", "node"], {"rank": "one"}).select("node", F.expr(f"rank div {size}").alias("block"))
    rows = members.select("root", "node", "copies", "vec").join(placed, "node").select("root", "block", "node", "copies", "vec")
    blocks = map_arrow(rows.repartition("root", "block").sortWithinPartitions("root", "block"), fill, "root long, block long, ids binary, copies binary, mat binary, centre binary, radius double, total long")
    blocks = saved(blocks, "blocks")
    return rows, blocks


def verdicts(pairs: DataFrame, threshold: float, keys: str) -> DataFrame:
    """The three ``keys`` of block ``pairs`` (keys, centre, d, radius, s), and ``says``: 1 if all their pairs are links, -1 if none is, 0 if that is open."""
    wide, names = math.acos(threshold), [x.split()[0] for x in keys.split(", ")]

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c, d = _matrix(batch.column(3), "<f8"), _matrix(batch.column(4), "<f8")
                angle = np.arccos(np.clip((c * d).sum(axis=1), -1, 1))
                r = np.asarray(batch.column(5)) + np.asarray(batch.column(6))
                says = np.where(angle + r <= wide - 1e-9, 1, np.where(angle - r > wide + 1e-9, -1, 0))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(says)], [*names, "says"])

    return map_arrow(pairs, verdict, f"{keys}, says long")


def link_counts(members: DataFrame, threshold: float, size: int = BLOCK) -> DataFrame:
    """(node, n): for every member (root, node, copies, vec) of a component the vectors of the component linked with it, its own copies included."""
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, copies, mat in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                ids, copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
                x = np.frombuffer(mat, "<f8").reshape(len(ids), -1)
                near = x @ x.T >= threshold
                np.fill_diagonal(near, True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ copies)], ["node", "n"])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, ca, xa, b, cb, xb in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b, ca, cb = (np.frombuffer(v, np.int64) for v in (a, b, ca, cb))
                near = np.frombuffer(xa, "<f8").reshape(len(a), -1) @ np.frombuffer(xb, "<f8").reshape(len(b), -1).T >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[a, b]), pa.array(np.r_[near @ cb, ca @ near])], ["node", "n"])

    rows, blocks = blocks_of(members, size)
    counts = map_arrow(blocks.select("ids", "copies", "mat"), own, "node long, n long")
    if blocks.where("block > 0").limit(1).count():
        last = blocks.groupBy("root").agg(F.max("block").alias("last")).where("last > 0")
        a = blocks.join(last, "root").where("block < last").select("root", F.col("block").alias("i"), "centre", "radius", F.explode(F.expr("sequence(block + 1, last)")).alias("j"))
        b = blocks.select("root", F.col("block").alias("j"), F.col("centre").alias("d"), F.col("radius").alias("s"))
        said = a.join(b, ["root", "j"]).select("root", "i", "j", "centre", "d", "radius", "s")
        said = saved(verdicts(said, threshold, "root long, i long, j long"), "verdicts")
        content = blocks.select("root", "block", "ids", "copies", "mat", "total")
        one = content.select("root", F.col("block").alias("i"), F.col("ids").alias("ia"), F.col("copies").alias("ca"), F.col("mat").alias("ma"))
        two = content.select("root", F.col("block").alias("j"), F.col("ids").alias("ib"), F.col("copies").alias("cb"), F.col("mat").alias("mb"))
        open_ = said.where("says = 0").join(one, ["root", "i"]).join(two, ["root", "j"])
        counts = counts.union(map_arrow(open_.select("ia", "ca", "ma", "ib", "cb", "mb"), cross, "node long, n long"))
        total = content.select("root", F.col("block").alias("other"), "total")
        ways = said.where("says = 1").select("root", F.col("i").alias("block"), F.col("j").alias("other")).union(said.where("says = 1").select("root", F.col("j").alias("block"), F.col("i").alias("other")))
        whole = ways.join(total, ["root", "other"]).groupBy("root", "block").agg(F.sum("total").alias("n"))
        counts = counts.union(rows.select("root", "block", "node").join(whole, ["root", "block"]).select("node", "n"))
    return counts.groupBy("node").agg(F.sum("n").alias("n"))


def bridges(members: DataFrame, keys: DataFrame, threshold: float, size: int = BLOCK) -> DataFrame:
    """(a, b): roots of different components (members: root, node, copies, vec) of one key (keys: root, key) that have a link between them."""

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, xa, b, xb, width in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                near = np.frombuffer(xa, "<f8").reshape(-1, width) @ np.frombuffer(xb, "<f8").reshape(-1, width).T >= threshold
                if near.any():
                    yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([b], pa.int64())], ["a", "b"])

    _, blocks = blocks_of(members, size)
    blocks = saved(blocks.join(keys, "root"), "bridge-blocks")
    # Blocks are numbered by key, in the order of their roots; roots are hashes, so their leading bits cut a key evenly.
    bits = root_buckets(blocks.count()).bit_length()
    slim = blocks.select("key", "root", "block", F.lit(1).cast("long").alias("one"), F.shiftright("root", 64 - bits).alias("part"))
    numbers = prefix_sums(slim, ["key"], "part", ["root", "block"], {"number": "one"}).select("root", "block", "number")
    blocks = saved(blocks.join(numbers, ["root", "block"]), "numbered-blocks")
    last = blocks.groupBy("key").agg(F.max("number").alias("last"))
    one = blocks.join(last, "key").where("number < last").select("key", F.col("root").alias("a"), F.col("number").alias("i"), "centre", "radius", F.explode(F.expr("sequence(number + 1, last)")).alias("j"))
    two = blocks.select("key", F.col("root").alias("b"), F.col("number").alias("j"), F.col("centre").alias("d"), F.col("radius").alias("s"))
    pairs = one.join(two, ["key", "j"]).where("a != b").select("key", "i", "j", "centre", "d", "radius", "s")
    said = verdicts(pairs, threshold, "key string, i long, j long").where("says >= 0")
    roots = blocks.select("key", "number", "root")
    said = said.join(roots.select("key", F.col("number").alias("i"), F.col("root").alias("a")), ["key", "i"]).join(roots.select("key", F.col("number").alias("j"), F.col("root").alias("b")), ["key", "j"])
    said = saved(said.select("key", "a", "b", "i", "j", "says"), "bridge-verdicts")
    sure = said.where("says = 1").select("a", "b").distinct()
    content = blocks.select("key", "number", "mat", (F.octet_length("centre") / 8).cast("int").alias("width"))
    left, right = content.select("key", F.col("number").alias("i"), F.col("mat").alias("ma"), "width"), content.select("key", F.col("number").alias("j"), F.col("mat").alias("mb"))
    open_ = said.where("says = 0").join(sure, ["a", "b"], "left_anti").join(left, ["key", "i"]).join(right, ["key", "j"])
    return sure.union(map_arrow(open_.select("a", "ma", "b", "mb", "width"), cross, "a long, b long")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of the entries of all lists but those that are full of ``LONGEST`` links."""
    lists = edges.groupBy("src").agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 32))).alias("h")).where(F.col("n") < LONGEST)
    return tuple(lists.agg(F.sum("n"), F.sum(F.pmod("h", F.lit(1 << 40)))).first())


def joined(links: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, root): the components of ``links``, the large ones bridged."""
    roots = saved(components(links), "components")
    large = roots.groupBy("root").count().where(F.col("count") > LONGEST).select("root")
    large = large.join(nodes.select(F.col("node").alias("root"), "key"), "root")
    large = saved(large.join(large.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi").select("root", "key"), "large")
    if not large.limit(1).count():
        return roots
    members = roots.join(large.select("root"), "root", "left_semi").join(nodes, F.col("id") == F.col("node")).select("root", "node", "copies", "vec")
    found = saved(bridges(members, large, threshold), "bridges")
    return saved(components(links.union(found)), "components") if found.limit(1).count() else roots


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings``."""
    rows = saved(vectors(embeddings), "vectors")
    nodes, seed = nodes_of(rows)
    sizes = nodes.groupBy("key").count().agg(F.sum("count"), F.max("count")).first()
    total, largest = (sizes[0] or 0), (sizes[1] or 0)
    floor = 2 * threshold * threshold - 1
    levels = max(1, math.ceil(math.log2(max(2, largest / LEAF))))
    edges = None
    for attempt in range(FORESTS):
        found = forest(nodes, levels, attempt, LIST, floor)
        edges = saved(best_lists(edges.union(found) if attempt else found, LIST, threshold), "lists")
        before, mark, most = None, _mark(edges), LIST
        while mark[0] and mark != before:
            most = min(LONGEST, 2 * most)
            edges = saved(descend(edges, nodes, most, threshold, floor), "lists")
            before, mark = mark, _mark(edges)
        links = saved(exact_links(edges, nodes, threshold), "links")
        roots = joined(links, nodes, threshold)
        asked = saved(audit(nodes, total, threshold, roots=roots), "audit")
        recall, queries = recall_of(asked)
        log.warning("op8: recall %.4f, the mean of %d queries with links, after %d forests", recall, queries, attempt + 1)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"recall {recall:.4f} of {queries} queries after {FORESTS} forests; {RECALL} is asked for")
    # What the audit found counts too, where it connects anything.
    missed = asked.where("root != own").select("a", F.col("root").alias("b")).distinct()
    if missed.limit(1).count():
        roots = joined(links.union(missed), nodes, threshold)
    named = rows.select("id", F.when(F.col("key").isNotNull(), node_id(seed)).alias("node"))
    repeated = repeated_ids(named)
    again = repeated.limit(1).count() > 0
    if again:  # rows that share an id are in one component
        roots = saved(components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(same_id_links(named, repeated))), "components")
    alone = nodes.where("copies > 1").join(roots, nodes["node"] == roots["id"], "left_anti").select("node", (F.col("copies") - 1).alias("n"))
    members = nodes.join(roots, nodes["node"] == roots["id"]).select("root", "node", "copies", "vec")
    counts = link_counts(members, threshold).select("node", (F.col("n") - 1).alias("n")).union(alone)
    answer = smallest_ids(nodes, roots)
    found = named.where("node IS NOT NULL").join(answer.join(counts, "node", "left"), "node", "left").select("id", "n", "component_id")
    rest = named.where("node IS NULL").select("id", F.lit(None).cast("long").alias("n"))
    rest = empty_rows(rest, repeated, answer) if again else rest.withColumn("component_id", F.lit(None).cast("long"))
    out = found.union(rest).select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)))


def op8_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings' links and components at cosine 0.93 within labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


_ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM embeddings)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""

QUERIES = {"op8_descent": op8_descent}
ORACLES = {"op8_descent": _ORACLE}
