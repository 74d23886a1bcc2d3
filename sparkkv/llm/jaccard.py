"""Operator 5, n-gram Jaccard join: exact, by set relations (index-level and answer-level skipping).

Texts become sets of hashed word shingles (64 bits; hashes stand for the shingles). Equal sets are one node from then on, whatever their
doc_ids: a node's id is a hash of the set's digest, checked to be its own. Then:

1. Leaders. Of the sets that share a MinHash band, one of each component is compared with one of the band's largest component (a star, not all
   pairs). At first every set is its own component, and the band's most central set leads; up to ``STARS`` rounds follow one another. Verified links put
   most near copies into components at a cost that grows with the rows, not with the squares of the groups.
2. Index. Every set enters a prefix of its shingles, rarest first, into an inverted index: sets with similarity of at least t share a
   shingle in their prefixes, whatever the order. The order comes from a frequency sketch over all documents, so shared passages and
   common phrases go last. Sets of one component have their answers already; a list whose sets are all in one component is
   skipped as a whole, and its shingle counts as one that no set outside shares: a set with too many of those has no link left to find, so the near copies
   that are just too far from a large group's are not paired with its sets (``_allowed``). Lists are ordered by size and position, and cut into blocks: a pair of blocks is skipped if its extreme sizes and
   positions rule every pair out. A list of more than ``LONG_LIST`` sets is no task's: its blocks are rows, ordered by component, and so are the
   pairs of blocks that the sizes, positions and components don't rule out.
3. Answers. What is left is pairs of sets from different components. A set is first compared with the *leader* of the other's
   component. By the triangle inequality of the Jaccard distance, the answers for the leader's verified members follow: some are
   links, some can't be, and only the rest are compared.

Step 1 may miss any number of links without changing the result: steps 2 and 3 are complete for pairs in different components, and
inside a component every set is reachable already. Last, sets of one doc_id are linked, and a component reports its smallest doc_id. No list, bucket or group is capped. Nothing but counts, checksums and the
sketch (of fixed size) reaches the driver.

Defined results: a null or empty text, or one without words, has an empty set, size 0, and is linked with nothing; fewer words than a
shingle form one; rows with the same doc_id are one document, linked with whatever any of its texts is linked with (each row reports its own size and
the same component, and the result has as many rows as the input); a null doc_id is linked with nothing and has a null component; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkv.llm.common import map_arrow, prefix_sums, root_buckets, saved, table
from sparkkv.llm.graph import components, empty_rows, repeated_ids, same_id_links, smallest_ids
from sparkkv.llm.pieces import slices, split_words

WORDS = 5
#: Similarity 3 / 4, in integers.
UP, DOWN = 3, 4
BANDS, ROWS = 8, 2
#: Most rounds of stars; a later round that links fewer than a hundredth of the sets in components is the last, and its links are left to the index.
STARS = 3
#: Slots of the frequency sketch (2 ** 23 bytes when sent to the workers).
SKETCH_BITS = 23
#: Ids up to which a list of ids is broadcast (8 bytes each); longer lists are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Lists up to this length are compared lag by lag; longer ones block by block.
SHORT_LIST, BLOCK = 48, 256
#: Longer lists than this are split over tasks.
LONG_LIST = 1024

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    offsets, codes, known = split_words(texts)
    # bytes.lower() changes A-Z only.
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass").lower()) for w in known), np.uint64, len(known))
    if "" in known:
        there = codes != known.index("")
        offsets = np.concatenate([[0], np.cumsum(there)])[offsets]
        codes = codes[there]
    flat = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
        for k in range(words):
            rolled = rolled * _M + flat[k : k + len(rolled)]
        rolled = _mix(rolled)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for x in flat[a:b]:
                    h = h * _M + x
                out.append(_mix(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and 128-bit digest (n, low, high) of every set."""
    with np.errstate(over="ignore"):
        low = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
        high = np.array([(_mix(s * _M)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return [pa.array(np.array([len(s) for s in sets], np.int64)), _long(low), _long(high)]


def node_id(seed: int) -> Column:
    """A set's id, from its digest."""
    return F.xxhash64(F.lit(seed), "n", "low", "high")


def digests(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """Rows (doc_id, n, low, high): size and 128-bit digest of every set; and rows (slot, counts) with parts of a task's frequency sketch."""
    block = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(0, np.uint8), [], 0

        def fold() -> np.ndarray:
            slots, new = np.unique(np.concatenate(held), return_counts=True)
            total = counts if len(counts) else np.zeros(1 << bits, np.uint8)
            total[slots] = np.minimum(total[slots] + new, 255)  # a task's count stops at 255
            return total

        names = ["doc_id", "n", "low", "high", "slot", "counts"]
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                sets = shingle_sets(texts)
                held.append((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(held[-1])
                if size > 1 << 20:
                    counts, held, size = fold(), [], 0
                ids = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *_digests(sets), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())], names)
        if held or len(counts):
            counts = fold() if held else counts
            for i in range(0, len(counts), block):
                part = counts[i : i + block]
                if part.any():
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([i // block], pa.int64()), pa.array([part.tobytes()], pa.binary())], names)

    return map_arrow(docs, run, "doc_id long, n long, low long, high long, slot long, counts binary")


def frequency_classes(parts: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """uint8 for each slot: four times the logarithm (base 2) of how often the slot's shingles occur in all documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, total = None, None
        for batch in batches:  # sorted by slot: one running sum at a time
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(c.as_py(), np.uint8)
                if s != slot:
                    if slot is not None:
                        yield done(slot, total)
                    slot, total = s, np.zeros(len(part), np.float64)
                total += part
        if slot is not None:
            yield done(slot, total)

    def done(slot: int, total: np.ndarray) -> pa.RecordBatch:
        classes = np.round(4 * np.log2(1 + total)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([classes.tobytes()], pa.binary())], ["slot", "classes"])

    out, block = np.zeros(1 << bits, np.uint8), 1 << 16
    # Slots are of a fixed number, so partitions are too.
    dealt = parts.select("slot", "counts").repartition(max(1, len(out) // block // 4), "slot").sortWithinPartitions("slot")
    for row in map_arrow(dealt, add, "slot long, classes binary").collect():  # 2 ** bits bytes in all
        out[row["slot"] * block : row["slot"] * block + len(row["classes"])] = np.frombuffer(row["classes"], np.uint8)
    return out


def prefixes(texts: DataFrame, classes: np.ndarray, seed: int, bits: int = SKETCH_BITS) -> DataFrame:
    """Of every set that isn't empty (node, n, central, last, bands, prefix): MinHash band keys and the index prefix, rarest shingles first.

    ``central`` is high for sets whose shingles are frequent; ``last`` is the place of the prefix's last shingle in the order (frequency class and leading bits of the hash).
    """
    sent = texts.sparkSession.sparkContext.broadcast(classes)  # 2 ** bits bytes
    rng = np.random.default_rng(5)
    factors = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for batch in batches:
            for _, part in slices(batch.column(1)):
                sets = [s for s in shingle_sets(part) if len(s)]
                bands, heads, central, last = [], [], [], []
                for s in sets:
                    n = len(s)
                    with np.errstate(over="ignore"):
                        least = np.array([(s * f).min() for f in factors], np.uint64)
                        keys = np.arange(BANDS, dtype=np.uint64)
                        for r in range(ROWS):
                            keys = _mix(keys * _M + least[r * BANDS : (r + 1) * BANDS])
                    found = rank[(s >> np.uint64(64 - bits)).astype(np.int64)]
                    order = np.argsort(found, kind="stable")[: n - (UP * n + DOWN - 1) // DOWN + 1]
                    bands.append(keys)
                    heads.append(s[order])
                    central.append(int(found.sum(dtype=np.int64)) * 1000 // n)
                    last.append((int(found[order[-1]]) << 55) + (int(s[order[-1]]) >> 9))
                if sets:
                    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in c])]).astype(np.int32)), _long(np.concatenate(c))) for c in (bands, heads)]
                    yield pa.RecordBatch.from_arrays([*_digests(sets), pa.array(central, pa.int64()), pa.array(last, pa.int64()), *lists], ["n", "low", "high", "central", "last", "bands", "prefix"])

    found = map_arrow(texts, run, "n long, low long, high long, central long, last long, bands array<long>, prefix array<long>")
    return found.select(node_id(seed).alias("node"), "n", "central", "last", "bands", "prefix")


def among(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with distinct ``ids``: broadcast if there are few, else a shuffle."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", how)


def stored_sets(texts: DataFrame, ids: DataFrame, seed: int) -> DataFrame:
    """(node, set): the shingle hashes of the texts of the documents ``ids`` (doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch.column(1)):
                sets = [s for s in shingle_sets(part) if len(s)]
                yield pa.RecordBatch.from_arrays([*_digests(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["n", "low", "high", "set"])

    found = map_arrow(among(texts, ids, "left_semi"), run, "n long, low long, high long, set binary")
    return found.select(node_id(seed).alias("node"), "set")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with both sizes and the size of the intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                s, t = (s, t) if len(s) <= len(t) else (t, s)
                at = np.minimum(np.searchsorted(t, s), max(0, len(t) - 1))
                out.append((len(x.as_buffer()) // 8, len(y.as_buffer()) // 8, int((t[at] == s).sum()) if len(t) else 0))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]], ["a", "b", "na", "nb", "both"])

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
    return map_arrow(rows, run, "a long, b long, na long, nb long, both long")


#: Of the rows of ``compared``.
IS_LINK = f"both * {DOWN} >= (na + nb - both) * {UP}"
DISTANCE = "1 - both / (na + nb - both)"


def band_pairs(keys: DataFrame, grouped: DataFrame | None = None, turn: int = 0) -> DataFrame:
    """(a, b) of ``keys`` (node, n, central, key): of each band, a set of its largest component (by ``grouped``: id, root) with one of each other, if their sizes allow a link.

    At first the most central set of the band leads: in a group of near copies, that with the fewest changes of its own, which links with more of the
    others than any other does. Later, which sets stand for their components changes with ``turn``. A band has a row for each component in the second aggregate, so a hot one is small there.
    """
    if grouped is None:
        cells = keys.select("key", F.struct(F.lit(-1).cast("long").alias("m"), (-F.col("central")).alias("h"), "node", "n").alias("it"))
    else:
        own = keys.join(grouped.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("component", F.coalesce("root", "node"))
        cells = own.groupBy("key", "component").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n")).alias("r"))
        cells = cells.select("key", F.struct((-F.col("m")).alias("m"), "r.h", "r.node", "r.n").alias("it"))
    leaders = cells.groupBy("key").agg(F.min("it").alias("first"), F.count("*").alias("cells")).where("cells > 1")
    rows = cells.select("key", "it.node", "it.n").join(leaders.select("key", F.col("first.node").alias("a"), F.col("first.n").alias("na")), "key")
    return rows.where(f"node != a AND least(n, na) * {DOWN} >= greatest(n, na) * {UP}").select("a", F.col("node").alias("b")).distinct()


def _allowed(n1: np.ndarray, n2: np.ndarray, p1: np.ndarray, p2: np.ndarray, g1: np.ndarray, g2: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """Whether sizes and positions allow a link.

    If this is the first shingle that the sets share, those before it (p) aren't shared. Of the set whose prefix ends first (w), no shingle that is listed
    for one component only is shared either, as the other's prefix would have it (g counts both).
    """
    p1, p2 = np.where(w1 <= w2, g1, p1), np.where(w2 <= w1, g2, p2)
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    need = -(-UP * (n1 + n2) // (UP + DOWN))
    return (small * DOWN >= large * UP) & (np.minimum(n1 - p1, n2 - p2) >= need)


def _packed(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    if found:
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _between(one: tuple, two: tuple, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of two blocks (id, n, pos, component, gone, last) of a list, or of one and ``same``."""
    (i, n, p, c, g, w), (j, m, q, d, h, v) = one, two
    ok = _allowed(n[:, None], m[None], p[:, None], q[None], g[:, None], h[None], w[:, None], v[None]) & (c[:, None] != d[None]) & (i[:, None] != j[None])
    x, y = np.nonzero(np.triu(ok, 1) if same else ok)
    return i[x], j[y]


def listed_pairs(entries: DataFrame) -> DataFrame:
    """(a, b) from index ``entries`` (token, node, n, pos, component, gone, last) that can be links: different components, sizes and positions allow it.

    A task holds one list at a time; longer lists than ``LONG_LIST`` are left to ``split_pairs``.
    """

    def lagged(t, i, n, p, c, g, w) -> Iterator[tuple]:
        for lag in range(1, SHORT_LIST):
            same = t[:-lag] == t[lag:] if lag < len(t) else np.zeros(0, bool)
            if not same.any():
                return
            at = np.flatnonzero(same)
            x, y = at, at + lag
            keep = (c[x] != c[y]) & (i[x] != i[y]) & _allowed(n[x], n[y], p[x], p[y], g[x], g[y], w[x], w[y])
            yield i[x[keep]], i[y[keep]]

    def blocked(i, n, p, c, g, w) -> Iterator[tuple]:
        """One list, ordered by size and position."""
        cut = [slice(s, s + BLOCK) for s in range(0, len(i), BLOCK)]
        low, high = np.array([n[s].min() for s in cut]), np.array([n[s].max() for s in cut])
        rest = np.array([(n[s] - p[s]).max() for s in cut])
        one, whole = np.array([c[s][0] for s in cut]), np.array([(c[s] == c[s][0]).all() for s in cut])
        for u in range(len(cut)):
            for v in range(u, len(cut)):
                if low[v] * UP > high[u] * DOWN:
                    break  # later blocks hold larger sets still
                if min(rest[u], rest[v]) < -(-UP * (low[u] + low[v]) // (UP + DOWN)) or (whole[u] and whole[v] and one[u] == one[v]):
                    continue
                yield _between(*[(i[s], n[s], p[s], c[s], g[s], w[s]) for s in (cut[u], cut[v])], u == v)

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, *rest = columns
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        sizes = np.diff(np.r_[first, len(t)])
        long = np.repeat(sizes > SHORT_LIST, sizes)
        found = [*lagged(*[x[~long] for x in columns])]
        for s, m in zip(first[sizes > SHORT_LIST], sizes[sizes > SHORT_LIST], strict=True):
            found += blocked(*[x[s : s + m] for x in rest])
            if sum(len(x) for x, _ in found) > 1 << 20:
                yield from _packed(found)
                found = []
        yield from _packed(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([np.asarray(x, np.int64) for x in batch.columns])
            t = held[-1][0]
            if sum(len(h[0]) for h in held) >= 1 << 16 and t[0] != t[-1]:
                cut = int(np.flatnonzero(t != t[-1])[-1]) + 1  # the last list may go on in the next batch
                tail = [x[cut:] for x in held[-1]]
                held[-1] = [x[:cut] for x in held[-1]]
                yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)])
                held = [tail]
        if held:
            yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)])

    entries = entries.select("token", "node", "n", "pos", "component", "gone", "last").repartition("token").sortWithinPartitions("token", "n", "pos")
    return map_arrow(entries, run, "a long, b long")


def split_pairs(entries: DataFrame) -> DataFrame:
    """As ``listed_pairs``, for lists of any length: blocks, and pairs of blocks, are rows.

    Blocks follow the components' order, so that those inside a large component pair with the others only. A large component's entries are dealt to
    its blocks by hash; a block holds about ``BLOCK`` to three times as many entries.
    """
    cells = entries.groupBy("token", "component").agg(F.count("*").alias("m"))
    # Components are hashes, so their leading bits cut a list evenly.
    bits = root_buckets(entries.count()).bit_length()
    cells = cells.withColumn("part", F.shiftright("component", 64 - bits))
    cells = prefix_sums(cells, ["token"], "part", ["component"], {"start": "m"}).select("token", "component", "m", "start")
    rows = entries.join(cells, ["token", "component"])
    block = F.floor(F.col("start") / BLOCK) + F.when(F.col("m") > BLOCK, F.pmod(F.xxhash64(F.lit("block"), "node"), F.ceil(F.col("m") / BLOCK))).otherwise(0)
    rows = rows.withColumn("block", block.cast("long"))
    names = ["node", "n", "pos", "component", "gone", "last"]
    blocks = rows.groupBy("token", "block").agg(
        F.collect_list(F.struct("node", "n", F.col("pos").cast("long").alias("pos"), "component", "gone", "last")).alias("it"),
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("component").alias("c0"), F.max("component").alias("c1"),
    )
    blocks = saved(blocks.select("token", "block", "low", "high", "rest", "c0", "c1", *[F.col(f"it.{c}").alias(c) for c in names]), "list-blocks")
    stats = blocks.select("token", "block", "low", "high", "rest", "c0", "c1")
    one, two = stats.alias("x"), stats.select(*[F.col(c) if c == "token" else F.col(c).alias(f"{c}_") for c in stats.columns])
    pairs = one.join(two, "token").where("block <= block_")
    pairs = pairs.where(f"low_ * {UP} <= high * {DOWN} AND low * {UP} <= high_ * {DOWN} AND least(rest, rest_) * {UP + DOWN} >= (low + low_) * {UP} AND NOT (c0 = c1 AND c0_ = c1_ AND c0 = c0_)")
    pairs = saved(pairs.select("token", "block", "block_"), "block-pairs")
    content = blocks.select("token", "block", *names)
    wide = pairs.join(content, ["token", "block"]).join(content.select("token", F.col("block").alias("block_"), *[F.col(c).alias(f"{c}_") for c in names]), ["token", "block_"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = [np.asarray(batch.column(c)[k].values, np.int64) for c in range(1, 13)]
                yield from _packed([_between(tuple(x[:6]), tuple(x[6:]), batch.column(0)[k].as_py())])

    wide = wide.select((F.col("block") == F.col("block_")).alias("same"), *names, *[f"{c}_" for c in names])
    return map_arrow(wide, run, "a long, b long")


def sets_of(rows: DataFrame) -> tuple[DataFrame, int]:
    """(node, n, first, copies) of the distinct sets of ``rows`` (doc_id, n, low, high), with the seed under which every set's id is its own."""
    for seed in itertools.count():
        made = rows.groupBy(node_id(seed).alias("node")).agg(
            F.min("doc_id").alias("first"), F.count("*").alias("copies"), *[f(c).alias(f"{c}{k}") for c in ("n", "low", "high") for k, f in enumerate((F.min, F.max))]
        )
        groups = saved(made, "groups")
        if not groups.where("n0 != n1 OR low0 != low1 OR high0 != high1").limit(1).count():
            return groups.select("node", "first", "copies"), seed


def joined(found: DataFrame, grouped: DataFrame | None) -> DataFrame:
    """(a, b): the links ``found``, with what is known already as one link from each node to its root, so that later rounds start from stars."""
    links = found.select("a", "b")
    return links if grouped is None else links.union(grouped.select(F.col("id").alias("a"), F.col("root").alias("b")))


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    texts = _texts(docs)
    passed = saved(digests(texts), "digests")
    classes = frequency_classes(passed.where("slot IS NOT NULL"))
    whole = passed.where("slot IS NULL").select("doc_id", "n", "low", "high")
    groups, seed = sets_of(whole.where("n > 0 AND doc_id IS NOT NULL"))
    rows = whole.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", node_id(seed).alias("node"))
    # Ids with several rows: usually none.
    named = whole.select(F.col("doc_id").alias("id"), F.when(F.col("n") > 0, node_id(seed)).alias("node"))
    repeated = repeated_ids(named)
    again = repeated.limit(1).count() > 0

    # A document all of whose sets are another's is left out of all that follows.
    skipped = rows.join(groups.where("copies > 1"), "node").where("doc_id != first").select("doc_id").distinct()
    if again:
        skipped = skipped.join(groups.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_anti")
    texts = among(texts.where("doc_id IS NOT NULL"), saved(skipped, "skipped"), "left_anti")
    once = lambda df: df
    if again:
        ids = repeated.select(F.col("id").alias("doc_id"))
        texts = among(texts, ids, "left_anti").union(saved(among(texts, ids, "left_semi").distinct(), "repeated-texts"))
        once = lambda df: df.dropDuplicates(["node"])
    index = saved(once(prefixes(texts, classes, seed)), "index")

    def sets_for(nodes: DataFrame) -> DataFrame:
        ids = saved(nodes.distinct().join(groups, "node").select(F.col("first").alias("doc_id")).distinct(), "asked-ids")
        return saved(once(stored_sets(texts, ids, seed)), "sets")

    keys = saved(index.select("node", "n", "central", F.explode("bands").alias("key")), "bands")
    stars = grouped = sets = None
    for turn in range(STARS):
        pairs = saved(band_pairs(keys, grouped, turn), "band-pairs")
        if stars is None:
            sets = sets_for(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
        # Later rounds take the sets that the first one had stored; what they leave out is left to the index.
        found = saved(compared(pairs, sets).where(IS_LINK).withColumn("far", F.expr(DISTANCE)), "star-links")
        new = found.count()
        if stars is not None and new * 100 < grouped_rows:
            break
        stars = found if stars is None else stars.union(found)
        grouped = saved(components(joined(found, grouped)), "star-components")
        grouped_rows = grouped.count()
        if not new:
            break

    known = grouped_rows <= BROADCAST_IDS
    entries = index.select("node", "n", "last", "prefix").join((F.broadcast if known else (lambda x: x))(grouped.withColumnRenamed("id", "node")), "node", "left")
    entries = entries.select("node", "n", "last", F.size("prefix").alias("head"), F.coalesce("root", "node").alias("component"), F.posexplode("prefix").alias("pos", "token"))
    # Lists whose sets are all in one component, most of them of one set, are skipped before anything is compared.
    mixed = entries.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("m")).where("c0 != c1").select("token", "m")
    mixed = saved(mixed, "mixed-tokens")
    few, some_long = mixed.agg(F.count("*") <= BROADCAST_IDS, F.coalesce(F.max("m") > LONG_LIST, F.lit(False))).first()
    entries = entries.join(F.broadcast(mixed) if few else mixed, "token")
    # Shingles of the prefix that another component can't share if this is the first that it does: all but the mixed ones from here on.
    entries = entries.withColumn("gone", F.col("head") - F.count("*").over(Window.partitionBy("node").orderBy(F.desc("pos"))))
    entries = entries.select("token", "node", "n", "pos", "component", "gone", "last", "m")
    found = listed_pairs(entries.where(f"m <= {LONG_LIST}"))
    if some_long:
        found = found.union(split_pairs(saved(entries.where(f"m > {LONG_LIST}").drop("m"), "long-lists")))
    pairs = saved(found.distinct(), "list-pairs")

    links = grouped.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if pairs.limit(1).count():
        # A set's leader is the one that it was verified against first: the smallest; its own for one without.
        leader = stars.select("a", "b", "far").union(stars.select("a", F.col("a").alias("b"), F.lit(0.0)))
        leader = saved(leader.groupBy("b").agg(F.min(F.struct("a", "far")).alias("l")).select(F.col("b").alias("id"), "l.a", "l.far"), "leaders")
        lead = F.coalesce(F.col("l.a"), F.col("b")).alias("x")
        asked = pairs.join(leader.alias("l"), pairs["b"] == F.col("l.id"), "left").select(pairs["a"], pairs["b"], lead, F.coalesce("l.far", F.lit(0.0)).alias("far"))
        asked = saved(asked, "asked")
        sets = sets_for(asked.select(F.explode(F.array("a", "b", "x")).alias("node")))
        answers = compared(asked.select("a", F.col("x").alias("b")).distinct(), sets)
        answers = saved(answers.select("a", F.col("b").alias("x"), F.expr(IS_LINK).alias("is_link"), F.expr(DISTANCE).alias("to_leader")), "answers")
        links = links.union(answers.where("is_link").select("a", F.col("x").alias("b")))
        # Derived answers: |far - to_leader| <= distance <= far + to_leader; a link has a distance of at most 1 / 4.
        open_ = asked.where("x != b").join(answers.where("NOT is_link"), ["a", "x"]).where(f"abs(far - to_leader) <= {1 - UP / DOWN} + 1e-9")
        links = links.union(compared(open_.select("a", "b"), sets).where(IS_LINK).select("a", "b"))
    if again:
        links = links.union(same_id_links(named, repeated))
    answer = smallest_ids(groups, components(links))
    out = rows.join(answer, "node", "left").select("doc_id", "n", "component_id")
    rest = whole.where("n = 0 OR doc_id IS NULL").select(F.col("doc_id").alias("id"), "n")
    rest = empty_rows(rest, repeated, answer) if again else rest.withColumn("component_id", F.lit(None).cast("long"))
    return out.union(rest.select("id", "n", "component_id")).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' components under Jaccard similarity of at least 0.75 of 5-word shingles."""
    return near_components(table(spark, sf_dir, "documents"))


_ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = n.doc_id), n.doc_id)) AS component_id FROM n
"""

QUERIES = {"op5_relations": op5_relations}
ORACLES = {"op5_relations": _ORACLE}
