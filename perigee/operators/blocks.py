"""Windows over a key's whole history, in blocks: no task holds more than a share of the rows, whatever one key has.

Rows are dealt by (key, order) into ranges of even size, so a key with most rows lies in many
blocks, and rows of one key and place in one.  A window is then three steps: a summary of each
(key, block), which is an aggregate; a window over these summaries, of which a key has no more
than there are blocks; and a window within (key, block) that begins with what was carried there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.operators.rounds import materialised

BLOCK = "__block"


def blocked(rows: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """``rows`` with a number of the block each lies in, written: ranges are drawn from a sample, and a second drawing might differ."""
    n = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialised(rows.repartitionByRange(n, *keys, *order).withColumn(BLOCK, F.spark_partition_id()))


def carried(rows: DataFrame, keys: list[str], order: list[str], last: dict[str, Column] | None = None, first: dict[str, Column] | None = None, total: dict[str, Column] | None = None, peers: bool = False, own: bool = True) -> DataFrame:
    """``rows`` of :func:`blocked` with more columns, each over all rows of its key in ``order``.

    ``last``: the last value that isn't null up to a row (with ``own``, else up to the one before);
    ``first``: the first from a row on (or from the next); ``total``: the sum up to a row, itself
    included.  ``peers``: rows of equal order count as one place.  Null keys form a group.
    """
    last, first, total = last or {}, first or {}, total or {}
    place = F.struct(*order)
    part = [*keys, BLOCK]
    some = lambda c: F.when(c.isNotNull(), place)
    summary = rows.groupBy(*part).agg(
        *[F.max_by(c, some(c)).alias(f"__l_{n}") for n, c in last.items()],
        *[F.min_by(c, some(c)).alias(f"__f_{n}") for n, c in first.items()],
        *[F.sum(c).alias(f"__t_{n}") for n, c in total.items()],
    )
    w = Window.partitionBy(*keys).orderBy(BLOCK)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    told = summary.select(
        *[F.col(k).alias(f"__k_{k}") for k in part],
        *[F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__l_{n}") for n in last],
        *[F.first(f"__f_{n}", ignorenulls=True).over(after).alias(f"__f_{n}") for n in first],
        *[F.sum(f"__t_{n}").over(before).alias(f"__t_{n}") for n in total],
    )
    same = F.lit(True)
    for k in part:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = rows.join(told, same)
    local = Window.partitionBy(*part).orderBy(*order)
    if peers and own:
        back, on = local.rangeBetween(Window.unboundedPreceding, Window.currentRow), local.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    else:
        back, on = local.rowsBetween(Window.unboundedPreceding, 0 if own else -1), local.rowsBetween(0 if own else 1, Window.unboundedFollowing)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.select(
        *rows.columns,
        *[F.coalesce(F.last(c, ignorenulls=True).over(back), F.col(f"__l_{n}")).alias(n) for n, c in last.items()],
        *[F.coalesce(F.first(c, ignorenulls=True).over(on), F.col(f"__f_{n}")).alias(n) for n, c in first.items()],
        *[(F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.coalesce(F.col(f"__t_{n}"), F.lit(0))).alias(n) for n, c in total.items()],
    )
