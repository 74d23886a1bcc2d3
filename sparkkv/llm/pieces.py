"""A public piece vocabulary, and the splitting of text batches into words and their distinct values.

Pieces of the vocabulary hold white space (as ``MARK``) only in front, so a text's segmentations are those of its words put together:
dynamic programmes run once for each distinct word, and a task remembers a bounded number of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
#: Bytes of text that are split at once, whatever the Arrow batch holds; longer texts make a slice of their own.
SLICE_BYTES = 4 << 20


def default_model() -> str:
    """Path of the public vocabulary, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str | None = None) -> tuple[list[str], list[float], list[int]]:
    """(pieces, scores, ids) of the ordinary pieces; without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    keep = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in keep], [sp.get_score(i) for i in keep], keep


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(start, part) of ``texts`` with at most ``most`` bytes each, or a single text.

    Parts are copies: kernels of Arrow's misread arrays that begin inside a buffer.
    """
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held + n > most and i > start:
            yield start, texts.take(pa.array(np.arange(start, i)))
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, texts.take(pa.array(np.arange(start, len(texts))))


def split_words(texts: pa.Array, separator: str | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets, codes, words): text i has the distinct words ``words[codes[offsets[i]:offsets[i + 1]]]``, in order.

    Splits at ASCII white space, or at ``separator``. Empty words are kept. A null text has none.
    """
    texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts) if separator is None else pc.split_pattern(texts, separator)
    lists = pa.array([], pa.large_list(pa.large_string())) if not len(lists) else lists
    flat = pc.list_flatten(lists)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    coded = flat.dictionary_encode()
    return np.concatenate([[0], np.cumsum(sizes)]), np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (n, ...) over [offsets[i], offsets[i + 1]); 0 where that is empty. Equal ranges have equal sums, whatever stands around them."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    filled = offsets[1:] > offsets[:-1]
    if filled.any():
        out[filled] = np.add.reduceat(values, offsets[:-1][filled], axis=0)
    return out


class Memory:
    """Values of words, at most ``most`` of them; forgets all when full."""

    def __init__(self, compute, width: int, most: int = 400_000) -> None:
        self.compute, self.most, self.known = compute, most, {}
        self.rows = np.zeros((0, width))

    def values(self, words: list[str]) -> np.ndarray:
        """(len(words), width) values; ``compute(new)`` gives those that aren't known."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, self.rows = {}, self.rows[:0]
            new = words
        if new:
            found = self.compute(new)
            if len(new) > self.most:
                return found
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            if first + len(new) > len(self.rows):
                grown = np.zeros((min(self.most, max(2 * len(self.rows), first + len(new), 1024)), self.rows.shape[1]))
                grown[:first] = self.rows[:first]
                self.rows = grown
            self.rows[first : first + len(new)] = found
        return self.rows[np.fromiter((self.known[w] for w in words), np.int64, len(words))]
