"""Operator 7, best-fit packing: minimum bin slack.

Texts are tokenised, ended by id 0, cut where longer than a sequence, and packed into as few sequences as possible. Bins are filled
one after another: the longest piece left opens a bin, and a subset-sum dynamic programme over the available lengths (a bitset of
reachable fills in one Python integer) finds the combination that leaves the least slack; it is then removed.

What a bin holds depends on lengths only, so the programme works on the number of pieces of each length: at most ``capacity`` numbers,
whatever the corpus. A combination stays the fullest while its lengths last, so it is removed as often as they do at once; each
removal uses a length up (or leaves less of it than one combination takes), which bounds the combinations by the capacity too. Pieces
then get their rank among those of their length (``common.prefix_sums``: no task holds a length) and read their bin and
offset off the plan, a table bounded by the capacity. Only slim rows are shuffled, never ids or texts.

Defined results: a null or empty text is one piece with the single id 0; equal rows are separate pieces; the text of a special
token is that token, as in the tokenizer's plain call; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkv.llm.common import bucket_of, map_arrow, prefix_sums, root_buckets, saved, table

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"


class Encoder:
    """ids (uint32) of texts under the public byte-level BPE of ``tokenizers``, as its plain call gives them: added tokens in a text are single ids.

    tiktoken reads the same vocabulary as ranks and gives the same ids (tests hold them against each other) about four times as fast; what
    it can't take goes to ``tokenizers``.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        self.slow, self.path = None, public_tokenizers.path(f"{vocabulary}.json")
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(self.path, encoding="utf-8") as f:
            tokens = json.load(f)["added_tokens"]
        added = {t["content"]: t["id"] for t in tokens}
        #: Tokens that also take the white space around them, or stand as words only, are left to ``tokenizers``.
        self.odd = [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.odd):
            return self.exact(text)
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except BaseException as e:  # a panic of its pattern engine on extreme runs isn't an Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return self.exact(text)

    def exact(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def encoder_of(vocabulary: str) -> Encoder:
    """One encoder for a process, whatever the number of its tasks."""
    return Encoder(vocabulary)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity where it is cut."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all texts."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(vocabulary), np.array([END], np.uint32)
        for batch in batches:
            rows, held, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encoder.ids(text.as_py()), end])
                for i, (start, length) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((doc, i, start, length, zlib.crc32(own.astype("<u4").tobytes())))
                    if with_ids:
                        held.append(own.astype(np.int32))
                        size += length
                if size > 1 << 22:
                    yield packed(rows, held)
                    rows, held, size = [], [], 0
            if rows:
                yield packed(rows, held)

    def packed(rows: list[tuple], held: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held))))
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), run, schema)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of available lengths whose sum is the largest up to ``room``; long lengths first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(combination, bins that hold it)]; a combination is [(length, times)], the opening piece first."""
    counts = {x: n for x, n in counts.items() if n}
    plan = []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        content = dict(fullest(rest, capacity - longest))
        content[longest] = content.get(longest, 0) + 1
        bins = min(counts[x] // k for x, k in content.items())
        plan.append((sorted(content.items(), reverse=True), bins))
        for x, k in content.items():
            counts[x] -= k * bins
            if not counts[x]:
                del counts[x]
    return plan


def plan_table(plan: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, first bin, times in a bin, offset), sorted: where the pieces of a length go, by rank."""
    rows, used, first = [], {}, 0
    for content, bins in plan:
        offset = 0
        for length, times in content:
            rows.append((length, used.get(length, 0), first, times, offset))
            used[length] = used.get(length, 0) + times * bins
            offset += length * times
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ..) with sequence_id and offset; ``pieces`` must be a stored table."""
    sizes = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    where = plan_table(minimum_bin_slack({r["length"]: r["count"] for r in sizes}, capacity))
    total = sum(r["count"] for r in sizes)
    ways = pieces.sparkSession.sparkContext.broadcast(where)  # bounded by the capacity
    mix = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string"), F.col("ids_crc32").cast("string")))
    rows = pieces.withColumns({"_mix": mix, "_one": F.lit(1).cast("long"), "_part": bucket_of(mix, root_buckets(total))})
    ranked = prefix_sums(rows, ["length"], "_part", ["_mix", "start"], {"_rank": "_one"}).select(*pieces.columns, "_rank")
    place, rank = pieces.columns.index("length"), len(pieces.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = ways.value
        keys = (plan[:, 0] << 40) + plan[:, 1]
        for batch in batches:
            length, r = np.asarray(batch.column(place), np.int64), np.asarray(batch.column(rank), np.int64)
            way = plan[np.searchsorted(keys, (length << 40) + r, side="right") - 1]
            r = r - way[:, 1]
            sequence, offset = way[:, 2] + r // way[:, 3], way[:, 4] + r % way[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:rank], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:rank], "sequence_id", "offset"])

    out = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return map_arrow(ranked, run, out)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids): the packed ids of pieces that carry them; a group holds at most one sequence."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.size("p").alias("n_pieces"), F.flatten(F.col("p.ids")).alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise once into the shared folder, then pack."""
    return pack(saved(tokenized_pieces(docs, capacity, with_ids), "pieces"), capacity)


def op7_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_slack": op7_slack}
ORACLES: dict[str, str] = {}
