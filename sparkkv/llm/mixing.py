"""Operator 1, mixing sources to target weights: temperature mixing (native: DataFrame and SQL functions only).

A source's weight is its token share to the power ``p`` (p = 1 / temperature, 0 <= p <= 1), normalised. Lower powers flatten
the mixture: its entropy rises, and rare sources repeat more often. The power is bisected on a dyadic grid to meet

- ``entropy_fraction``: the largest p whose entropy is at least that fraction of ln(sources), and
- ``repetition_limit``: the smallest p at which no source is passed more than so many times; it wins where both bind.

The weights are then realised: a source with weight w gets w * budget tokens as whole passes and one cut pass. Every
pass is its own seeded permutation of the source's documents. The mixture is divided into blocks of ``block_tokens``:
a row's block follows from how much of its source's budget precedes it, so each block meets the weights to
within a document of each source. Rows without tokens are dealt to the blocks by their hash. Inside a block rows are permuted again, across
sources: ``place`` counts them from 0. Blocks are as many as both tokens and rows need, so one task can rank a block.

The tables that grow with the corpus stay distributed: running sums use ``common.prefix_sums`` (no task holds a source), and
each bisection pass is an aggregate over the per-source totals that returns one row.

Defined results: tokens are runs of other than white space; a null or empty text has none, and is in a cut pass if its place
comes before the cut; a null source is a source; rows equal in (source, doc_id, tokens) are mixed together and carry their
number in ``copies``; a source without tokens gets one pass; an empty table gives an empty result; other columns,
also with clashing names, are only passed through by ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkv.llm.common import bucket_of, prefix_sums, root_buckets, saved, table

SEED = "mix-1"
ENTROPY_FRACTION = 0.97
REPETITION_LIMIT = 4.0
BLOCK_TOKENS = 1 << 20
#: Bisection steps taken in one pass over the sources, and passes.
STEPS, PASSES = 4, 6


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def source_totals(rows: DataFrame) -> DataFrame:
    """(key, tokens, documents) of ``rows`` (key, n_tokens, copies)."""
    return saved(rows.groupBy("key").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents")), "mix-totals")


def find_power(totals: DataFrame, budget: float | None, entropy_fraction: float | None, repetition_limit: float | None) -> float:
    """Bisect the exponent over [0, 1]; each pass evaluates the 2**STEPS - 1 dyadic points of the bracket at once.

    ``budget`` None stands for the smallest budget that passes every source at least once.
    """
    live = totals.where("tokens > 0")
    n, all_tokens = live.agg(F.count("*"), F.sum("tokens")).first()
    if not n or n == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(all_tokens))

    def bisect(holds_low: bool, holds) -> float:
        """The edge between powers where ``holds`` is true and false; it is true at the low end if holds_low."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = [low + (high - low) * k / (1 << STEPS) for k in range(1, 1 << STEPS)]
            sums = []
            for p in points:
                w = F.pow(share, F.lit(p))
                sums += [F.sum(w), F.sum(w * F.ln(share)), F.max(w / share), F.min(w / share)]
            row = live.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
            flags = [holds(p, *row[4 * i : 4 * i + 4]) for i, p in enumerate(points)]
            k = sum(f == holds_low for f in flags)  # monotone: the first k points are on the low side
            low, high = (points[k - 1] if k else low), (points[k] if k < len(points) else high)
        return low if holds_low else high

    def entropy(p, z, zl, most, least):
        return math.log(z) - p * zl / z

    def repetition(p, z, zl, most, least):
        return most / least if budget is None else most / z * budget / all_tokens

    power = 1.0
    if entropy_fraction is not None:
        target = entropy_fraction * math.log(n)
        at_one = live.agg(F.sum(share * F.ln(share))).first()[0]
        if -at_one < target:
            power = bisect(True, lambda *x: entropy(*x) >= target)
    if repetition_limit is not None:
        most, least = live.agg(F.max(F.lit(1.0) / share), F.min(F.lit(1.0) / share)).first()
        at_zero = repetition(0.0, float(n), 0.0, most, least)
        if at_zero > repetition_limit:
            power = max(power, bisect(False, lambda *x: repetition(*x) <= repetition_limit))
    return power


def source_budgets(totals: DataFrame, power: float, budget: float | None) -> DataFrame:
    """totals with weight, budget (tokens), whole (passes) and cut (tokens of the last pass); a row per source."""
    live = totals.where("tokens > 0")
    all_tokens = live.agg(F.sum("tokens")).first()[0] or 1
    raw = F.pow(F.col("tokens") / F.lit(float(all_tokens)), F.lit(power))
    z, widest = live.agg(F.sum(raw), F.max(F.col("tokens") / raw)).first()
    z = z or 1.0
    whole_budget = budget if budget is not None else (widest or 0.0) * z
    # To 1e-9 of a token: what differs in the last places of a floating-point sum has no effect.
    own = F.round(raw / F.lit(z) * F.lit(float(whole_budget)), 9)
    own = F.when(F.col("tokens") > 0, F.ceil(own - F.lit(1e-6)).cast("long")).otherwise(F.lit(0).cast("long"))
    out = totals.withColumns({"weight": F.when(F.col("tokens") > 0, F.round(raw / F.lit(z), 9)).otherwise(F.lit(0.0)), "budget": own})
    return out.withColumns(
        {
            "whole": F.when(F.col("tokens") > 0, F.expr("budget div greatest(tokens, 1)")).otherwise(F.lit(1).cast("long")),
            "cut": F.when(F.col("tokens") > 0, F.expr("budget % greatest(tokens, 1)")).otherwise(F.lit(0).cast("long")),
        }
    )


def shuffle_hash(seed: str, turn: Column) -> Column:
    """A row's place in its source's permutation number ``turn``."""
    return F.md5(F.concat_ws(":", F.lit(seed), turn.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("n_tokens").cast("string")))


def block_hash(mix: Column) -> Column:
    """A row's place in its block's permutation."""
    return F.md5(F.concat(mix, F.lit(":block")))


def mixture(
    docs: DataFrame,
    budget: float | str | None = "corpus",
    entropy_fraction: float | None = ENTROPY_FRACTION,
    repetition_limit: float | None = REPETITION_LIMIT,
    block_tokens: int = BLOCK_TOKENS,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(rows, sources) of the mixture of ``docs`` (doc_id, text, source).

    rows: source, doc_id, n_tokens, copies, pass (from 0), before (tokens of the source's earlier rows, over all passes), budget,
    weight, block, place. sources: a row per source with its totals, weight, passes and cut. ``budget`` is a number of tokens,
    "corpus" for as many as ``docs`` has, or None for the least that passes every source at least once.
    """
    rows = docs.select("source", "doc_id", token_count(F.col("text")).alias("n_tokens"))
    rows = rows.groupBy("source", "doc_id", "n_tokens").agg(F.count("*").alias("copies")).withColumn("key", source_key(F.col("source")))
    rows = saved(rows, "mix-rows")  # one scan of the texts
    totals = source_totals(rows)
    corpus, n_rows = totals.agg(F.sum("tokens"), F.sum("documents")).first()
    corpus = float(corpus or 0)
    tokens = corpus if budget == "corpus" else budget
    power = find_power(totals, tokens, entropy_fraction, repetition_limit)
    sources = saved(source_budgets(totals, power, tokens), "mix-sources")
    spent = float(sources.agg(F.sum("budget")).first()[0] or 0)
    blocks = max(1, math.ceil(max(spent, n_rows or 0) / block_tokens))

    of_source = sources.select("key", "weight", "budget", "tokens", "whole", "cut")
    passes = rows.join(of_source, "key").withColumn("pass", F.explode(F.expr("sequence(0L, whole - IF(cut = 0, 1L, 0L))")))
    passes = passes.withColumns({"mix": shuffle_hash(seed, F.col("pass")), "weighed": F.col("n_tokens") * F.col("copies")})
    passes = passes.withColumn("part", bucket_of(F.col("mix"), root_buckets(n_rows or 0)))
    passes = prefix_sums(passes, ["key", "pass"], "part", ["mix"], {"before": "weighed"})
    passes = passes.where("pass < whole OR before < cut").withColumn("before", F.col("before") + F.col("pass") * F.col("tokens"))
    block = F.least(F.lit(blocks - 1), F.floor(F.col("before") * F.lit(blocks) / F.greatest(F.col("budget"), F.lit(1))))
    block = F.when(F.col("n_tokens") > 0, block).otherwise(bucket_of(F.col("mix"), blocks))
    passes = passes.select("source", "key", "doc_id", "n_tokens", "copies", "pass", "before", "budget", "weight", "mix", block.cast("long").alias("block"))
    return passes.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(block_hash(F.col("mix")), "key")).cast("long") - 1), sources


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row as often as the mixture has it; the columns are those of ``docs``.

    Whole passes need only the source's number of passes. The cut pass is read as a bound on the permutation's hash for each
    source, so no join by document is made and the texts aren't shuffled.
    """
    seed = how.get("seed", SEED)
    rows, sources = mixture(docs, **how)
    last = rows.groupBy("key").agg(F.max(F.struct("pass", "mix")).alias("last"))
    bounds = saved(sources.select("key", "whole").join(last, "key", "left").select("key", "whole", F.when(F.col("last.pass") >= F.col("whole"), F.col("last.mix")).alias("bound")), "mix-bounds")
    names = docs.columns
    it = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        source_key(F.col("source")).alias("key"),
        "doc_id",
        token_count(F.col("text")).alias("n_tokens"),
    ).join(bounds, "key")
    it = it.withColumn("times", F.col("whole") + F.when(shuffle_hash(seed, F.col("whole")) <= F.col("bound"), 1).otherwise(0))
    return it.withColumn("time", F.explode(F.expr("sequence(1L, times)"))).where("times > 0").select("row.*")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents at the corpus's own size: a row for each document and pass."""
    rows, _ = mixture(table(spark, sf_dir, "documents"))
    return rows.select("source", "doc_id", "n_tokens", "copies", F.col("pass").alias("pass_no"), "before", "block", "place", F.col("budget").alias("source_budget"), "weight")


def _oracle() -> str:
    steps = STEPS * PASSES
    return f"""
WITH RECURSIVE docs AS (
  SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+'))::BIGINT AS n_tokens FROM documents
), rows_ AS (
  SELECT source, coalesce('=' || source, 'null') AS key, doc_id, n_tokens, count(*) AS copies FROM docs GROUP BY ALL
), totals AS (
  SELECT key, sum(n_tokens * copies)::BIGINT AS tokens FROM rows_ GROUP BY key
), corpus AS (
  SELECT sum(tokens)::DOUBLE AS c, count(*) AS n FROM totals WHERE tokens > 0
), shares AS (
  SELECT tokens / (SELECT c FROM corpus) AS share FROM totals WHERE tokens > 0
), by_entropy AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT step, low, high, (low + high) / 2 AS mid,
      (SELECT ln(sum(pow(share, (b.low + b.high) / 2))) - (b.low + b.high) / 2 * sum(pow(share, (b.low + b.high) / 2) * ln(share)) / sum(pow(share, (b.low + b.high) / 2)) FROM shares)
        >= {ENTROPY_FRACTION} * ln((SELECT n FROM corpus)) AS ok
    FROM by_entropy b WHERE step < {steps})
), by_repetition AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END FROM (
    SELECT step, low, high, (low + high) / 2 AS mid,
      (SELECT max(pow(share, (b.low + b.high) / 2) / share) / sum(pow(share, (b.low + b.high) / 2)) FROM shares) <= {REPETITION_LIMIT} AS ok
    FROM by_repetition b WHERE step < {steps})
), power AS (
  SELECT greatest(
    CASE WHEN (SELECT -sum(share * ln(share)) FROM shares) < {ENTROPY_FRACTION} * ln((SELECT n FROM corpus)) THEN (SELECT low FROM by_entropy WHERE step = {steps}) ELSE 1.0 END,
    CASE WHEN (SELECT max(1 / share) / count(*) FROM shares) > {REPETITION_LIMIT} THEN (SELECT high FROM by_repetition WHERE step = {steps}) ELSE 0.0 END) AS p
), weighed AS (
  SELECT key, tokens, pow(tokens / (SELECT c FROM corpus), (SELECT p FROM power)) / (SELECT sum(pow(share, (SELECT p FROM power))) FROM shares) AS w FROM totals
), sources AS (
  SELECT key, tokens, CASE WHEN tokens > 0 THEN round(w, 9) ELSE 0.0 END AS weight,
    CASE WHEN tokens > 0 THEN ceil(round(w * (SELECT c FROM corpus), 9) - 1e-6)::BIGINT ELSE 0 END AS budget FROM weighed
), passes AS (
  SELECT r.source, r.key, r.doc_id, r.n_tokens, r.copies, s.weight, s.budget, s.tokens,
    CASE WHEN s.tokens > 0 THEN s.budget // greatest(s.tokens, 1) ELSE 1 END AS whole,
    CASE WHEN s.tokens > 0 THEN s.budget % greatest(s.tokens, 1) ELSE 0 END AS cut,
    unnest(range(0, CASE WHEN s.tokens > 0 THEN s.budget // greatest(s.tokens, 1) + (s.budget % greatest(s.tokens, 1) > 0)::BIGINT ELSE 1 END)) AS pass_no
  FROM rows_ r JOIN sources s USING (key)
), placed AS (
  SELECT *, coalesce(sum(n_tokens * copies) OVER (PARTITION BY key, pass_no ORDER BY mix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM (SELECT *, md5('{SEED}:' || pass_no || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || n_tokens) AS mix FROM passes)
), blocks AS (SELECT greatest(1, ceil(greatest(sum(budget), (SELECT sum(copies) FROM rows_)) / {float(BLOCK_TOKENS)}))::BIGINT AS n FROM sources)
, rows_out AS (
  SELECT *, CASE WHEN n_tokens > 0 THEN least((SELECT n FROM blocks) - 1, floor((b + pass_no * tokens) * (SELECT n FROM blocks) / greatest(budget, 1)))::BIGINT
    ELSE floor(('0x' || substr(mix, 1, 7))::BIGINT * (SELECT n FROM blocks) / {float(1 << 28)})::BIGINT END AS block FROM placed WHERE pass_no < whole OR b < cut
)
SELECT source, doc_id, n_tokens, copies, pass_no, (b + pass_no * tokens)::BIGINT AS before, block,
  row_number() OVER (PARTITION BY block ORDER BY md5(mix || ':block'), key) - 1 AS place, budget AS source_budget, weight
FROM rows_out
"""


QUERIES = {"op1_mixture": op1_mixture}
ORACLES = {"op1_mixture": _oracle()}
