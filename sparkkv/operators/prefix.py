"""Running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running sums without a task that holds a whole group.

    ``df`` is split by (group, bucket), where ``bucket`` must follow ``order``. Rows are summed inside their
    bucket; the buckets' totals (a row for each) are summed along the group and added. ``sums`` maps an output column
    to the summed input column; each output is the sum of all *earlier* rows of the group. Group columns must not be null.
    """
    key = [*group, bucket]
    totals = df.groupBy(*key).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums])
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({f"_i_{o}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in sums.items()})
    out = rows.join(totals, key)
    return out.withColumns({o: F.col(f"_i_{o}") + F.col(f"_b_{o}") for o in sums}).drop(*[f"_i_{o}" for o in sums], *[f"_b_{o}" for o in sums])
