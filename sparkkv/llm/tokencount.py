"""Operator 4, token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a word, and a dynamic programme carries the best score and its
piece count only: no lattice, no back pointers, no pieces. Only the last positions that a piece can start from are held, so a word of any length
takes the same memory. The tie rules are the exact tokenizer's: positions are
visited from left to right, pieces from short to long, and a later path replaces one only if its score is greater, so of equal paths
the one whose last piece starts first wins; a character that is no piece of its own takes the unknown score (10 below the
smallest). With byte fallback such a character counts as its UTF-8 bytes.

The vocabulary is a public one, read from its file with the scores it has there (path is a parameter; nothing is trained). No public unigram
vocabulary is installed: the file is that of a BPE model, whose scores order its merges and are no log-probabilities. They are read as
unigram scores, so counts differ from those of the file's own tokenizer; they equal those of a unigram tokenizer built from it. White space
is handled as the tokenizers do: a space becomes the mark, one is put in front, and pieces don't cross a mark. So distinct words
are segmented once in a batch (Arrow's dictionary) and remembered, in bounded number. Rows are independent: no shuffle.

Defined results: a null or empty text has 0 pieces and score 0; equal rows give equal results; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkv.llm.common import map_arrow, table
from sparkkv.llm.pieces import MARK, Memory, load_pieces, slices, split_words, sums

UNKNOWN_PENALTY = 10.0


class Viterbi:
    """(pieces, score) of words under a unigram vocabulary; a word may hold anything."""

    def __init__(self, pieces: list[str], scores: list[float], byte_fallback: bool = True) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.room = 1 + max(map(len, pieces), default=1)
        for piece, score in zip(pieces, scores, strict=True):
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.whole_line = any("\n" in p for p in pieces)

    def count(self, word: str) -> tuple[int, float]:
        room = self.room
        # Position j has slot j % room; a piece is shorter than that.
        best, pieces, fused = [0.0] * room, [0] * room, [False] * room
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())
        end, match = next(matches, (-1, None))
        here, before = 0, 0
        for j in range(len(word)):
            here = (j + 1) % room
            found, alone = None, False
            # At a place the automaton gives long pieces first: the longest starts first, and paths from earlier starts are tried first.
            while end == j:
                size, score = match
                alone |= size == 1
                at = here - size
                s = best[at] + score
                if found is None or s > found:
                    found, many = s, pieces[at] + 1
                end, match = next(matches, (-1, None))
            mixed = False
            if not alone and (found is None or best[before] + self.unknown > found):
                found, mixed = best[before] + self.unknown, True
                # Without byte fallback neighbouring unknown characters are one piece.
                many = pieces[before] + (len(word[j].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not fused[before]))
            best[here], pieces[here], fused[here] = found, many, mixed
            before = here
        return pieces[here], best[here]

    def many(self, words: list[str]) -> np.ndarray:
        return np.array([self.count(w) for w in words], np.float64).reshape(-1, 2)

    def words(self, texts: pa.Array) -> pa.Array:
        """``texts`` with a space between the words that are segmented on their own; marks are in front of words."""
        texts = pc.replace_substring(texts.cast(pa.large_string()), MARK, " ")
        lead = pc.if_else(pc.or_(pc.starts_with(texts, " "), pc.equal(pc.binary_length(texts), 0)), "", " ")
        texts = pc.replace_substring(pc.binary_join_element_wise(lead.cast(pa.large_string()), texts, pa.scalar("", pa.large_string())), " ", f" {MARK}")
        # No piece holds a line break, so it stands alone in every segmentation.
        return texts if self.whole_line else pc.replace_substring(texts, "\n", " \n ")


@functools.cache
def viterbi_of(model: str | None, byte_fallback: bool) -> Viterbi:
    """One automaton for a process, whatever the number of its tasks."""
    pieces, scores, _ = load_pieces(model)
    return Viterbi(pieces, scores, byte_fallback)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_tokens, score): pieces of the best segmentation of every text, and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = viterbi_of(model, byte_fallback)
        memory = Memory(viterbi.many, 2)
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                offsets, codes, words = split_words(viterbi.words(texts), " ")
                values = memory.values(words)[codes] if words else np.zeros((0, 2))
                total = sums(values, offsets)
                ids = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(total[:, 0].astype(np.int64)), pa.array(total[:, 1])], ["doc_id", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, run, "doc_id long, n_tokens long, score double")


def op4_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op4_viterbi": op4_viterbi}
ORACLES: dict[str, str] = {}
