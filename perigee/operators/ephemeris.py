"""Tabulated states: two-sided as-of brackets with linear interpolation, and gaps in tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.operators import blocks


def bracket(samples: DataFrame, probes: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """Probes with the sample at or before and at or after each: t0, t1 and <value>0, <value>1.

    Samples and probes share one order per key; the nearest sample on either side is carried
    along it, from block to block, so a key with most rows takes many tasks.  Times outside a
    key's samples have a null side; of samples at one time the least values count.
    """
    one = samples.groupBy(key, time).agg(*[F.min(v).alias(v) for v in values])
    s = one.select(key, F.col(time).alias("__t"), F.struct(F.col(time).alias("t"), *values).alias("__s"), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("__p"))
    p = probes.select(key, F.col(time).alias("__t"), F.lit(None).cast(s.schema["__s"].dataType).alias("__s"), F.struct(*probes.columns).alias("__p"))
    both = blocks.carried(blocks.blocked(s.unionByName(p), [key], ["__t"]), [key], ["__t"], last={"__l": F.col("__s")}, first={"__r": F.col("__s")}, peers=True)
    out = both.where("__p is not null")
    sides = [F.col(f"__{x}.{v}").alias(f"{v}{i}") for i, x in enumerate("lr") for v in ["t", *values]]
    return out.select("__p.*", *sides)


def interpolate(bracketed: DataFrame, time: str, values: list[str], max_gap_s: float | None = 3600.0) -> DataFrame:
    """Linear values at the probes' times; exact hits are taken as they are; nothing is extrapolated.

    ``status`` is ok, out_of_range, or gap where the bracket is wider than allowed.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).cast("double")
    span = ms("t1") - ms("t0")
    f = F.when(span > 0, F.try_divide(ms(time) - ms("t0"), span)).otherwise(0.0)
    status = F.when(F.col("t0").isNull() | F.col("t1").isNull(), "out_of_range")
    if max_gap_s is not None:
        status = status.when(span > max_gap_s * 1000, "gap")
    out = bracketed.withColumn("status", status.otherwise("ok")).withColumn("__f", f)
    for v in values:
        out = out.withColumn(v, F.when(F.col("status") == "ok", F.col(f"{v}0") + (F.col(f"{v}1") - F.col(f"{v}0")) * F.col("__f")))
    return out.drop("__f", "t0", "t1", *[f"{v}{i}" for v in values for i in (0, 1)])


def segments(track: DataFrame, key: str, order: str, usable) -> DataFrame:
    """Points of usable stretches of a track with their segment's number, from 1; single points are dropped.

    A usable point begins a segment when the one before isn't usable and the next one is, so a
    point's number is a running sum; it goes on from block to block.
    """
    rows = blocks.blocked(track.withColumn("__ok", F.coalesce(usable, F.lit(False))), [key], [order])
    beside = blocks.carried(rows, [key], [order], last={"__before": F.col("__ok")}, first={"__after": F.col("__ok")}, own=False)
    no = F.lit(False)
    joined = F.coalesce(F.col("__before"), no) | F.coalesce(F.col("__after"), no)
    kept = beside.withColumn("__in", F.col("__ok") & joined).withColumn("__new", (F.col("__in") & ~F.coalesce(F.col("__before"), no)).cast("int"))
    numbered = blocks.carried(kept, [key], [order], total={"segment": F.col("__new")})
    return numbered.where("__in").drop("__ok", "__before", "__after", "__in", "__new", blocks.BLOCK)


def first_crossing(grid: DataFrame, key: str, time: str, crossed) -> DataFrame:
    return grid.where(crossed).groupBy(key).agg(F.min(time).alias("crossing"))
