"""Tabulated bodies: one time axis for all, states of six numbers between samples, and bodies seen from one another.

A table has a row a body and instant: body, ts and :data:`STATE`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.operators import ephemeris

STATE = ["x", "y", "z", "vx", "vy", "vz"]


def _broken() -> F.Column:
    bad = F.col("ts").isNull()
    for c in STATE:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return bad


def axis_check(samples: DataFrame) -> DataFrame:
    """(body, samples, first, last, issues): what keeps a body out of a common table.

    AXIS_MISMATCH where it lacks an instant that another body has, DUPLICATE_INSTANT,
    TOO_FEW_INSTANTS under two, VECTOR_INVALID for a number that is null or not finite.  Instants
    are counted by aggregates; neither a body's nor an instant's rows are gathered.  Rows without
    a body are left out; no rows give none.
    """
    rows = samples.where("body is not null")
    once = rows.where("ts is not null").groupBy("body", "ts").agg(F.count("*").alias("times"))
    instants = once.agg(F.count_distinct("ts").alias("instants"))  # one row
    own = once.groupBy("body").agg(F.count("*").alias("own"), F.max("times").alias("most"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    whole = rows.groupBy("body").agg(F.count("*").alias("samples"), F.count_if(_broken()).alias("broken"))
    told = whole.join(own, "body", "left").crossJoin(F.broadcast(instants))
    issues = F.array_compact(F.array(
        F.when(F.coalesce("own", F.lit(0)) < F.col("instants"), "AXIS_MISMATCH"), F.when(F.col("most") > 1, "DUPLICATE_INSTANT"), F.when(F.coalesce("own", F.lit(0)) < 2, "TOO_FEW_INSTANTS"), F.when(F.col("broken") > 0, "VECTOR_INVALID"),
    ))
    return told.select("body", "samples", "first", "last", issues.alias("issues"))


def table(samples: DataFrame) -> DataFrame:
    """(ts, bodies): a row an instant with every usable body's state by name; bodies with an issue are left out whole.

    An instant gathers one row a body.
    """
    good = axis_check(samples).where(F.size("issues") == 0).select("body")
    kept = samples.join(good, "body", "left_semi")
    return kept.groupBy("ts").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("body", F.array(*STATE).alias("state"))))).alias("bodies"))


def states_at(samples: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (body, ts, other columns) with :data:`STATE` and ``status``, all six numbers linear between the samples beside each time.

    Status is ok, out_of_range before the first and after the last sample, unavailable for a body
    without samples, or invalid_date for a null time; the state is null unless ok.
    """
    usable = samples.where(~_broken()).select("body", "ts", *STATE)
    at = ephemeris.interpolate(ephemeris.bracket(usable, probes.drop(*STATE, "status"), "body", "ts", STATE), "ts", STATE, None)
    known = usable.select("body").distinct().withColumn("__known", F.lit(True))
    out = at.join(known, "body", "left")
    status = F.when(F.col("__known").isNull(), "unavailable").when(F.col("ts").isNull(), "invalid_date").otherwise(F.col("status"))
    out = out.withColumn("status", status).drop("__known")
    return out.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in STATE})


def seen_from(states: DataFrame, origin: str) -> DataFrame:
    """``states`` of :func:`states_at` with each body's state less the origin's at the same time.

    Status is the body's own, or the origin's where only that isn't ok; the origin itself is left
    out.  Times at which the origin wasn't asked for are unavailable.
    """
    centre = states.where(F.col("body") == origin).select("ts", F.col("status").alias("__status"), *[F.col(c).alias(f"__{c}") for c in STATE]).dropDuplicates(["ts"])
    both = states.where(F.col("body") != origin).join(centre, "ts", "left")
    there = F.coalesce("__status", F.lit("unavailable"))
    status = F.when(F.col("status") != "ok", F.col("status")).otherwise(there)
    out = both.withColumns({c: F.when((F.col("status") == "ok") & (there == "ok"), F.col(c) - F.col(f"__{c}")) for c in STATE})
    return out.withColumn("status", status).drop("__status", *[f"__{c}" for c in STATE])
