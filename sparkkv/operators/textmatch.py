"""Multi-pattern text operators: keyword levels and dictionary replacement.

Dictionaries are small tables given by the caller; their size is checked before they go to the tasks. A task builds one Aho-Corasick automaton and
passes over each text once, whatever the number of terms. Without case, A-Z equal a-z; no other character is folded, so places never shift.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms up to which a dictionary is sent to every task.
MOST_TERMS = 1_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dictionary(terms: DataFrame) -> DataFrame:
    """(term, level): repeated terms join their level bits."""
    return terms.groupBy("term").agg(F.bit_or("level").alias("level"))


def replacements(rows: DataFrame) -> DataFrame:
    """(src, repl): the last entry of each text counts; a null replacement deletes."""
    return rows.groupBy("src").agg(F.max(F.struct("seq", "repl")).alias("last")).select("src", F.coalesce("last.repl", F.lit("")).alias("repl"))


def top_bit(level: Column) -> Column:
    """The highest bit of an 8-bit mask; 0 for 0."""
    return F.when(level > 0, F.pow(F.lit(2.0), F.floor(F.log2(level.cast("double")))).cast("int")).otherwise(0)


def level(text: Column, terms: list[tuple[str, int]], case: bool = True) -> Column:
    """The highest level bit of the terms that ``text`` contains (built-in functions; no stop words)."""
    t = text if case else F.upper(text)
    hits = [F.when(F.contains(t, F.lit(w if case else w.upper())), F.lit(1 << (n.bit_length() - 1))).otherwise(0) for w, n in terms if n]
    return F.greatest(*hits) if len(hits) > 1 else hits[0] if hits else F.lit(0)


def _checked(rows: DataFrame) -> list:
    n = rows.count()
    if n > MOST_TERMS:
        raise ValueError(f"a dictionary of {n} terms is too large to be sent to the tasks; join with it instead")
    return rows.collect()


def _automaton(values: dict[str, object]):
    found = ahocorasick.Automaton()
    for term, value in values.items():
        found.add_word(term, (len(term), value))
    if values:
        found.make_automaton()
    return found


def matcher(terms: DataFrame, stop_words: list[str] = (), case: bool = True):
    """UDF text -> struct<level, start, length>: the match with the highest level, leftmost, then shortest; null without one.

    Places and lengths count characters of the text as it is. Stop words may stand between the characters of a match and count to its length, but
    not in front of it.
    """
    fold = (lambda s: s) if case else (lambda s: s.translate(_LOWER))
    levels: dict[str, int] = {}
    for r in _checked(terms):
        if r["term"] and r["level"]:
            levels[fold(r["term"])] = levels.get(fold(r["term"]), 0) | r["level"]
    tops = {t: 1 << (n.bit_length() - 1) for t, n in levels.items()}
    stop = "|".join(re.escape(fold(s)) for s in sorted(stop_words, key=len, reverse=True) if s)

    @F.pandas_udf("level int, start int, length int")
    def match(texts: pd.Series) -> pd.DataFrame:
        automaton, skip = _automaton(tops), re.compile(stop) if stop else None

        def one(s):
            if s is None or not len(automaton):
                return None, None, None
            s, places = fold(s), None
            if skip:  # the text without stop words, and where its characters stand
                cuts = [m.span() for m in skip.finditer(s)]
                if cuts:
                    kept = [(a, b) for (_, a), (b, _) in zip([(0, 0), *cuts], [*cuts, (len(s), 0)], strict=True) if a < b]
                    places = [i for a, b in kept for i in range(a, b)]
                    s = "".join(s[a:b] for a, b in kept)
            best = None
            for end, (size, top) in automaton.iter(s):
                found = (-top, end - size + 1, size)
                if best is None or found < best:
                    best = found
            if best is None:
                return None, None, None
            first, last = best[1], best[1] + best[2] - 1
            first, last = (places[first], places[last]) if places else (first, last)
            return -best[0], first, last - first + 1

        return pd.DataFrame([one(s) for s in texts], columns=["level", "start", "length"]).astype("Int32")

    return match


def replacer(rows: DataFrame, case: bool = True):
    """UDF text -> text: leftmost, longest terms of (src, repl) are replaced in one pass; replacements aren't searched again."""
    fold = (lambda s: s) if case else (lambda s: s.translate(_LOWER))
    table = {fold(r["src"]): r["repl"] for r in _checked(rows) if r["src"]}

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        automaton = _automaton(table)

        def one(s):
            longest = {}
            for end, (size, repl) in automaton.iter(fold(s)) if len(automaton) else ():
                if size > longest.get(end - size + 1, (0, None))[0]:
                    longest[end - size + 1] = size, repl
            out, at = [], 0
            for start in sorted(longest):
                if start >= at:
                    size, repl = longest[start]
                    out += [s[at:start], repl]
                    at = start + size
            return "".join([*out, s[at:]])

        return texts.map(one, na_action="ignore")

    return replace
