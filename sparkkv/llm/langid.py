"""Operator 6, language identification: segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A text's probability under a language is the sum over *all* its
segmentations into pieces, by a forward algorithm; pieces don't cross words, so it is the product over its words. The
language with the greatest posterior is predicted.

Training is expectation maximisation: the expected counts of pieces over all segmentations (forward-backward), from the words of
labelled texts. It uses a bounded, stratified sample: about ``per_language`` texts of each language, chosen by a hash of the id (all of
them where a language has fewer); the prior counts all labelled rows. The model is languages x 32,000 numbers.

Forward and backward run over arrays of distinct words of equal length, all languages at once; a task remembers a bounded number of
words' scores. Prediction is a map over Arrow batches: no shuffle.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing is labelled; ties go to the language that sorts
first; equal texts get equal predictions whatever their other columns; characters outside the vocabulary count alike in all
languages; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkv.llm.common import map_arrow, saved, table
from sparkkv.llm.pieces import MARK, Memory, load_pieces, slices, split_words, sums

PER_LANGUAGE = 2000
ROUNDS = 2
SMOOTHING = 0.05
#: Least probability of a piece, and of a character outside the vocabulary; LONG characters of it still fit a double.
LEAST, UNKNOWN = 1e-11, 1e-12
#: Longer words are scored on their own, with scaling.
LONG = 24
UND = "und"
#: Unicode letters: digits in superscript, fractions and Roman numerals are none.
_LETTER = regex.compile(r"\p{L}")


@functools.cache
def index_of(vocabulary: str | None) -> "PieceIndex":
    """One index for a process, whatever the number of its tasks."""
    return PieceIndex(load_pieces(vocabulary)[0])


class PieceIndex:
    """Look-up of many substrings at once, by a rolling hash of their characters."""

    BASE, BITS = 0x9E3779B97F4A7C15, 20

    def __init__(self, pieces: list[str]) -> None:
        with np.errstate(over="ignore"):
            hashes = np.zeros(len(pieces), np.uint64)
            for i, p in enumerate(pieces):
                h = 0
                for c in p:
                    h = (h * self.BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                hashes[i] = h
            slot = self._slot(hashes)
        order = np.argsort(slot, kind="stable")
        self.hashes, self.ids = hashes[order], order.astype(np.int64)
        self.first = np.searchsorted(slot[order], np.arange((1 << self.BITS) + 1)).astype(np.int64)
        self.deep = int(np.diff(self.first).max(initial=0))
        self.longest = max(map(len, pieces), default=1)
        self.size = len(pieces)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, ``size`` for what is no piece."""
        slot = self._slot(h).astype(np.int64)
        at, out = self.first[slot], np.full(len(h), self.size, np.int64)
        room = self.first[slot + 1] - at
        for k in range(self.deep):
            hit = (room > k) & (self.hashes[np.minimum(at + k, self.size - 1)] == h)
            out[hit] = self.ids[at[hit] + k]
        return out

    def of_words(self, codes: np.ndarray) -> list[list[np.ndarray]]:
        """ids[i][k]: the piece at characters i .. i+k of each word; ``codes`` is (words, length)."""
        n = codes.shape[1]
        out = []
        with np.errstate(over="ignore"):
            chars = codes.astype(np.uint64) + np.uint64(1)
            for i in range(n):
                h, row = np.zeros(len(codes), np.uint64), []
                for k in range(min(self.longest, n - i)):
                    h = h * np.uint64(self.BASE) + chars[:, i + k]
                    row.append(self.find(h))
                out.append(row)
        return out


@dataclass
class Model:
    """Piece probabilities (pieces + 2, languages): the last rows are for no piece (0) and an unknown character."""

    languages: list[str]
    table: np.ndarray
    prior: np.ndarray


def _alone(ids: np.ndarray, size: int) -> np.ndarray:
    """Single characters that are no piece take the unknown row."""
    return np.where(ids == size, size + 1, ids)


def _groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, codes) of the words of each length up to LONG."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        if 0 < n <= LONG:
            which = np.flatnonzero(sizes == n)
            for part in np.array_split(which, -(-len(which) // 50_000)):
                text = "".join([words[i] for i in part])
                yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)


def word_logs(words: list[str], index: PieceIndex, table: np.ndarray) -> np.ndarray:
    """(words, languages): log of the probability summed over all segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    for which, codes in _groups(words):
        n = codes.shape[1]
        ids = index.of_words(codes)
        alpha = [np.ones((len(which), table.shape[1]))] + [np.zeros((len(which), table.shape[1])) for _ in range(n)]
        for i in range(n):
            for k, found in enumerate(ids[i]):
                alpha[i + k + 1] += alpha[i] * table[_alone(found, index.size) if k == 0 else found]
        out[which] = np.log(alpha[n])
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = _long_log(w, index, table)
    return out


def _long_log(word: str, index: PieceIndex, table: np.ndarray) -> np.ndarray:
    """As word_logs, for a word of any length: only the last positions are held, scaled at each step."""
    width, size = index.longest, index.size
    last, scale = [np.ones(table.shape[1])], np.zeros(table.shape[1])
    chunk = 1 << 14
    for start in range(0, len(word), chunk):
        # Pieces that end in this chunk; they start up to width - 1 characters earlier.
        lead = min(start, width - 1)
        part = word[start - lead : start + chunk]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        hashes = []
        with np.errstate(over="ignore"):
            h = np.zeros(len(codes), np.uint64)
            for k in range(width):
                h = h[: len(codes) - k] * np.uint64(index.BASE) + codes[k:] if k < len(codes) else h[:0]
                hashes.append(index.find(h) if len(h) else np.zeros(0, np.int64))
        for j in range(lead, len(part)):
            total = np.zeros(table.shape[1])
            for k in range(min(width, len(last), j + 1)):
                found = hashes[k][j - k]
                if k == 0 and found == size:
                    found = size + 1
                if found != size:
                    total += last[-1 - k] * table[found]
            # Each language has its own scale: a text may be impossible, next to another, in one of them.
            last = [x / total for x in last[-(width - 1) :]] + [np.ones_like(total)]
            scale += np.log(total)
    return scale


def expected_counts(words: list[str], times: np.ndarray, index: PieceIndex, table: np.ndarray) -> np.ndarray:
    """(pieces, languages): expected uses of each piece in ``words``, ``times`` (words, languages) over."""
    out = np.zeros((index.size + 2, table.shape[1]))
    for which, codes in _groups(words):
        n, shape = codes.shape[1], (len(which), table.shape[1])
        ids = index.of_words(codes)
        for row in ids:
            row[0] = _alone(row[0], index.size)
        alpha, beta = [np.ones(shape)] + [np.zeros(shape) for _ in range(n)], [np.zeros(shape) for _ in range(n)] + [np.ones(shape)]
        for i in range(n):
            for k, found in enumerate(ids[i]):
                alpha[i + k + 1] += alpha[i] * table[found]
        share = times[which] / alpha[n]
        for i in range(n - 1, -1, -1):
            for k, found in enumerate(ids[i]):
                way = table[found] * beta[i + k + 1]
                beta[i] += way
                way *= alpha[i] * share
                for c in range(shape[1]):
                    out[:, c] += np.bincount(found, way[:, c], len(out))
    for i, w in enumerate(words):
        if len(w) > LONG:
            _long_counts(w, times[i], index, table, out)
    return out[:-2]


def _long_counts(word: str, times: np.ndarray, index: PieceIndex, table: np.ndarray, out: np.ndarray, chunk: int = 1 << 12) -> None:
    """Add the expected counts of a word of any length to ``out``.

    Only ratios of forward values are used, each language with its own: a piece from i to e is used, given that e is a boundary, with
    probability p * alpha[i] / alpha[e]; from the end backwards this gives every boundary's probability.
    """
    width, n, languages = index.longest, len(word), table.shape[1]
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)

    def pieces(start: int, end: int) -> np.ndarray:
        """ids[i, k]: the piece at characters start+i .. start+i+k."""
        part = codes[start : end + width - 1]
        ids, h = np.full((end - start, width), index.size, np.int64), np.zeros(len(part), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(width, len(part))):
                h = h[: len(part) - k] * np.uint64(index.BASE) + part[k:]
                found = index.find(h[: end - start])
                ids[: len(found), k] = _alone(found, index.size) if k == 0 else found
        return ids

    # logs[j]: log of alpha[j]; last[k]: alpha[j-1-k] / alpha[j-1].
    logs, last = np.zeros((n + 1, languages)), np.zeros((width, languages))
    last[0] = 1
    back = np.arange(width)
    for start in range(0, n, chunk):
        end, lead = min(n, start + chunk), min(start, width - 1)
        ids = pieces(start - lead, end)
        for j in range(start, end):
            k = back[: min(width, j + 1)]
            total = (table[ids[j - k - start + lead, k]] * last[: len(k)]).sum(axis=0)
            logs[j + 1] = logs[j] + np.log(total)
            last[1:] = last[:-1] / total
            last[0] = 1
    bound = np.zeros((n + width + 1, languages))
    bound[n] = 1
    for start in reversed(range(0, n, chunk)):
        end = min(n, start + chunk)
        ids = pieces(start, end)
        ends = np.minimum(np.arange(start, end)[:, None] + back + 1, n)
        ways = table[ids]
        ways *= np.exp(np.where(ways > 0, logs[start:end, None] - logs[ends], 0))
        for i in range(end - 1, start - 1, -1):
            ways[i - start] *= bound[i + 1 : i + 1 + width]
            bound[i] = ways[i - start].sum(axis=0)
        for c in range(languages):
            out[:, c] += times[c] * np.bincount(ids.reshape(-1), ways[:, :, c].reshape(-1), len(out))


def trainable(id_col: Column) -> Column:
    """Rows that a model may learn from; the others are held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, model: str | None = None, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model | None:
    """Learn from text and lang of ``docs``; None if nothing is labelled."""
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").count()
    found = {r["lang"]: r["count"] for r in sizes.collect()}  # a row for each language
    if not found:
        return None
    languages = sorted(found)
    prior = np.log(np.array([found[x] for x in languages]) / sum(found.values()))
    share = F.lit(float(per_language)) / F.col("count")
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = labelled.join(F.broadcast(sizes), "lang").where(draw < share).select("lang", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                offsets, codes, found = split_words(texts)
                if not found:
                    continue
                lang = np.array([number[x] for x in batch.column(0).slice(start, len(texts)).to_pylist()], np.int64)
                pairs, n = np.unique(np.repeat(lang, np.diff(offsets)) * len(found) + codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs // len(found)), pa.array([found[i] for i in pairs % len(found)], pa.string()), pa.array(n)], ["lang", "word", "n"])

    counted = map_arrow(sample, words, "lang long, word string, n long").where("word != ''").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    wide = saved(counted.groupBy("word").agg(*[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(languages))]), "langid-words")

    pieces, _, _ = load_pieces(model)
    size = len(pieces)
    probabilities = np.full((size, len(languages)), 1.0 / size)

    def tabled(p: np.ndarray) -> np.ndarray:
        return np.vstack([np.maximum(p, LEAST), np.zeros((1, p.shape[1])), np.full((1, p.shape[1]), UNKNOWN)])

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(tabled(probabilities))  # languages x vocabulary

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, total, held, size = index_of(model), 0.0, [], 0

            def add() -> np.ndarray:
                times = np.stack([np.concatenate([np.asarray(b.column(c), np.float64) for b in held]) for c in range(1, held[0].num_columns)], axis=1)
                return total + expected_counts([MARK + w for b in held for w in b.column(0).to_pylist()], times, index, sent.value)

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    size += batch.num_rows
                if size > 20_000:  # words of equal length are worked on together
                    total, held, size = add(), [], 0
            total = add() if held else total
            if not isinstance(total, float):
                at = np.flatnonzero(total.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, c]) for c in range(total.shape[1])]], ["piece", *[f"c{c}" for c in range(total.shape[1])]])

        schema = "piece long, " + ", ".join(f"c{c} double" for c in range(len(languages)))
        counts = map_arrow(wide, count, schema).groupBy("piece").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(len(languages))]).toPandas()
        weights = np.full((size, len(languages)), SMOOTHING)
        weights[counts["piece"].to_numpy(np.int64)] += counts.drop(columns="piece").to_numpy(np.float64)
        probabilities = weights / weights.sum(axis=0)
    return Model(languages, tabled(probabilities), prior)


def predict(docs: DataFrame, fitted: Model | None, text_col: str = "text", vocabulary: str | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns, called ``names``; columns of ``docs`` with these names are replaced, all others kept."""
    kept = [c for c in docs.columns if c not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    if fitted is None:
        return docs.withColumns({names[0]: F.lit(UND), names[1]: F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(fitted)  # languages x vocabulary
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        index = index_of(vocabulary)
        memory = Memory(lambda words: word_logs([MARK + w for w in words], index, m.table), len(m.languages))
        for batch in batches:
            for start, texts in slices(batch.column(place)):
                offsets, codes, words = split_words(texts)
                if words:
                    values = memory.values(words)
                    values[[not w for w in words]] = 0
                    logs = sums(values[codes], offsets) + m.prior
                else:
                    logs = np.zeros((len(texts), len(m.languages)))
                best = logs.argmax(axis=1)
                score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                letters = [x is not None and bool(_LETTER.search(x)) for x in texts.to_pylist()]
                lang = [m.languages[b] if ok else UND for b, ok in zip(best, letters, strict=True)]
                rows = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0))], [*rows.schema.names, *names])

    out = docs.withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema
    return map_arrow(docs, run, out)


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([x is not None and bool(_LETTER.search(x)) for x in batch.column(place).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    fitted = fit(docs.where(trainable(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text", (~trainable(F.col("doc_id"))).alias("held_out")), fitted)
    return out.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_langid": op6_langid}
ORACLES: dict[str, str] = {}
