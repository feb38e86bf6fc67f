"""What a sphere hides: segments cut where they enter and leave it, and the visible stretches of a path seen from a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.functions import geometry as G
from perigee.operators import ephemeris


def outside(p: G.Vector, q: G.Vector, radius: float) -> Column:
    """The parts of the segment from p to q outside a sphere at the origin, as an array of (begin, end) in shares of its length.

    None where all of it is inside, one where the sphere is missed, touched or met at one end,
    two where it goes through.  A segment without length is whole or hidden as its point is.
    """
    d = G.sub(q, p)
    a, b, c = G.dot(d, d), 2 * G.dot(p, d), G.dot(p, p) - radius * radius
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    enter, leave = F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)
    part = lambda lo, hi: F.struct(lo.alias("begin"), hi.alias("end"))
    whole = F.array(part(F.lit(0.0), F.lit(1.0)))
    cut = F.array_compact(F.array(F.when(enter > 0, part(F.lit(0.0), enter)), F.when(leave < 1, part(leave, F.lit(1.0)))))
    missed = (disc <= 0) | (enter >= 1) | (leave <= 0)
    return F.when(a > 0, F.when(missed, whole).otherwise(cut)).when(c >= 0, whole).otherwise(F.slice(whole, 1, 0))


def clip_segments(segments: DataFrame, p: G.Vector, q: G.Vector, radius: float) -> DataFrame:
    """``segments`` with piece (from 0), begin and end of each part outside the sphere, and its ends x0..z1.

    Rows whose points have a null give none; rows that repeat are cut alike.
    """
    out = segments.withColumn("__parts", outside(p, q, radius)).select("*", F.posexplode("__parts").alias("piece", "__part"))
    ends = {f"{n}{i}": G.along(p, G.sub(q, p), F.col(f"__part.{side}"))[k] for i, side in enumerate(("begin", "end")) for k, n in enumerate("xyz")}
    return out.withColumns({"begin": F.col("__part.begin"), "end": F.col("__part.end"), **ends}).drop("__parts", "__part")


def visible_runs(track: DataFrame, key: str, order: str, point: G.Vector, eye: G.Vector, radius: float) -> DataFrame:
    """Points of a path that a sphere doesn't hide from the eye, with the number of their stretch from 1; single points are dropped.

    Points with a null are as good as hidden.  A path of any length is walked in blocks.
    """
    there = point[0].isNotNull() & point[1].isNotNull() & point[2].isNotNull()
    return ephemeris.segments(track, key, order, there & ~G.occluded(point, eye, radius))
