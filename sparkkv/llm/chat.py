"""Operator 3, chat formatting: cumulative-snapshot collapse (native: DataFrame and SQL functions only).

Chat services log a conversation again after every exchange, so a log holds many conversations that are prefixes of
longer ones. Here every turn gets a rolling prefix hash: four 32-bit lanes of md5(position, role, text), summed over the turns up to and
including it. As each summand holds its position, equal sums mean equal turn sequences (128 bits), and unlike a chained
hash the sum can be taken in parallel (``common.prefix_sums``), so a conversation of any length is spread over tasks. A
conversation whose whole hash is a proper prefix hash of another is dropped by an anti join of distinct hashes; of
equal conversations the one with the smallest conv_id stays. What is left is rendered in ChatML, ``CHUNK`` turns to a row.

Defined results: turns are ordered by (turn, null first; then the hash of role and text); rows equal in all four columns are
one turn; a null conv_id is one conversation; a null role renders as ``unknown`` and a null text as empty, and both differ
from the literal; control markers inside a text are broken by a space; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkv.llm.common import prefix_sums, saved, table

CHUNK = 64
#: Turns of one conversation whose running sums are taken in one window.
SPAN = 256
LANES = [f"lane{i}" for i in range(4)]


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("null"))


def turn_print(role: Column, text: Column) -> Column:
    """Fingerprint of a turn; null and the empty string differ."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("r"), role), F.lit("n")), F.lit("\n"), F.coalesce(F.concat(F.lit("t"), text), F.lit("n"))))


def numbered(chats: DataFrame) -> DataFrame:
    """(key, conv_id, turn, print, pos): the distinct turns with their position from 1."""
    slim = chats.select(_key(F.col("conv_id")).alias("key"), "conv_id", "turn", turn_print(F.col("role"), F.col("text")).alias("print")).distinct()
    at = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)))
    slim = saved(slim.withColumns({"at": at, "span": F.floor(at / F.lit(SPAN)), "one": F.lit(1).cast("long")}), "chat-slim")
    # Where many turns of a conversation have one number, as when all are null, spans are cut by number and then by hash.
    tied = slim.groupBy("key", "span", "at").count().groupBy("key", "span").agg(F.max("count").alias("most")).where(F.col("most") > 4 * SPAN)
    slim = slim.join(tied, ["key", "span"], "left")
    lead = F.conv(F.substring("print", 1, 7), 16, 10).cast("long")
    part = F.expr(f"shiftright(_lead, CAST(28 - least(28, ceil(log2(most / {SPAN}))) AS INT))")
    slim = slim.withColumn("_lead", lead).withColumn("bucket", F.struct("span", *[F.when(F.col("most").isNotNull(), x).otherwise(0).alias(c) for c, x in (("at", F.col("at")), ("part", part))]))
    out = prefix_sums(slim, ["key"], "bucket", ["at", "print"], {"earlier": "one"})
    return out.select("key", "conv_id", "turn", "print", (F.col("earlier") + 1).alias("pos"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``turns`` of ``numbered`` with the lanes of the hash of all turns up to and including each."""
    own = F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("print")))
    lanes = {f"own{i}": F.conv(F.substring(own, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)}
    rows = turns.withColumns(lanes).withColumn("span", F.floor((F.col("pos") - 1) / F.lit(SPAN)))
    rows = prefix_sums(rows, ["key"], "span", ["pos"], {f"sum{i}": f"own{i}" for i in range(4)})
    return rows.select("key", "conv_id", "turn", "print", "pos", *[(F.col(f"sum{i}") + F.col(f"own{i}")).alias(LANES[i]) for i in range(4)])


def maximal(turns: DataFrame) -> DataFrame:
    """(key, conv_id, n_turns, n_copies) of the conversations that are no prefix of a longer one, equal ones once."""
    last = turns.groupBy("key", "conv_id").agg(F.max(F.struct("pos", *LANES)).alias("last"))
    whole = last.select("key", "conv_id", "last.*")
    # The smallest conv_id (null last) stands for equal conversations; partial sums leave a row per task of a hot one.
    kept = whole.groupBy("pos", *LANES).agg(F.min(F.struct(F.col("conv_id").isNull(), F.col("conv_id"), F.col("key"))).alias("it"), F.count("*").alias("n_copies"))
    proper = turns.join(whole.select("key", F.col("pos").alias("n_turns")), "key").where("pos < n_turns").select("pos", *LANES).distinct()
    kept = kept.join(proper, ["pos", *LANES], "left_anti")
    return kept.select("it.key", "it.conv_id", F.col("pos").alias("n_turns"), "n_copies")


def collapse(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, turns): the maximal conversations, and all turns with positions and prefix hashes."""
    turns = saved(prefix_hashes(numbered(chats)), "chat-turns")
    return saved(maximal(turns), "chat-kept"), turns


def render(chats: DataFrame, kept: DataFrame, turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, n_turns, n_copies, chunk_turns, text): ChatML of the kept conversations, ``chunk`` turns to a row."""
    places = turns.join(kept.select("key", "n_turns", "n_copies"), "key").select("key", "print", "turn", "pos", "n_turns", "n_copies")
    body = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1|>")
    said = F.concat(F.lit("<|im_start|>"), F.coalesce(F.col("role"), F.lit("unknown")), F.lit("\n"), body, F.lit("<|im_end|>\n"))
    rows = chats.select(_key(F.col("conv_id")).alias("key"), "conv_id", F.col("turn").alias("t"), turn_print(F.col("role"), F.col("text")).alias("print"), said.alias("said"))
    rows = rows.join(places, (rows["key"] == places["key"]) & (rows["print"] == places["print"]) & F.col("t").eqNullSafe(F.col("turn")))
    rows = rows.select("conv_id", "pos", "n_turns", "n_copies", "said", F.floor((F.col("pos") - 1) / F.lit(chunk)).alias("chunk"))
    out = rows.groupBy("conv_id", "chunk", "n_turns", "n_copies").agg(F.array_sort(F.collect_set(F.struct("pos", "said"))).alias("turns"))
    return out.select("conv_id", "chunk", "n_turns", "n_copies", F.size("turns").cast("long").alias("chunk_turns"), F.array_join(F.col("turns.said"), "").alias("text"))


def op3_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations of the whole log, rendered."""
    chats = table(spark, sf_dir, "conversations")
    kept, turns = collapse(chats)
    return render(chats, kept, turns)


_ORACLE = f"""
WITH slim AS (
  SELECT DISTINCT conv_id, turn, role, text, md5(coalesce('r' || role, 'n') || chr(10) || coalesce('t' || text, 'n')) AS print FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, print) AS pos FROM slim
), marked AS (
  SELECT *, string_agg(print, ',') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM numbered
), proper AS (SELECT DISTINCT prefix FROM marked WHERE pos < n_turns),
kept AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n_turns) AS n_turns FROM marked WHERE pos = n_turns AND prefix NOT IN (SELECT prefix FROM proper) GROUP BY prefix
)
SELECT k.conv_id, ((m.pos - 1) // {CHUNK})::BIGINT AS chunk, k.n_turns, k.n_copies, count(*) AS chunk_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || regexp_replace(coalesce(text, ''), '<\\|(im_start|im_end)\\|>', '< |\\1|>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY m.pos) AS text
FROM kept k JOIN marked m ON k.conv_id IS NOT DISTINCT FROM m.conv_id
GROUP BY 1, 2, 3, 4
"""

QUERIES = {"op3_snapshots": op3_snapshots}
ORACLES = {"op3_snapshots": _ORACLE}
