"""Propagation of element sets over times, and the tracks that follow from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.functions import catalog as C
from perigee.functions import constants as K
from perigee.functions import geometry as G
from perigee.functions import sgp4

ELEMENTS = ("inclination_deg", "node_deg", "eccentricity", "perigee_deg", "anomaly_deg", "motion_rev_day", "bstar")


def elements_of(tles: DataFrame, line1: str = "line1", line2: str = "line2") -> DataFrame:
    """``tles`` with ``epoch`` and the seven elements read from fixed columns; unreadable fields are null."""
    at = lambda start, size: F.trim(F.substring(line2, start, size)).try_cast("double")
    fields = {
        "epoch": C.tle_epoch(line1),
        "bstar": C.exponent_field(F.substring(line1, 54, 8)),
        "inclination_deg": at(9, 8),
        "node_deg": at(18, 8),
        "eccentricity": C.implied_eccentricity(F.substring(line2, 27, 7)),
        "perigee_deg": at(35, 8),
        "anomaly_deg": at(44, 8),
        "motion_rev_day": at(53, 11),
    }
    return tles.withColumns(fields)


def propagate(states: DataFrame, minutes: str = "minutes", minimum_radius_km: float | None = K.EARTH_RADIUS_KM, epoch: str = "epoch") -> DataFrame:
    """``states`` (the :data:`ELEMENTS` and minutes since epoch) with x, y, z, vx, vy, vz (km, km/s, TEME) and ``code``.

    Periods of 225 minutes and more need the column ``epoch`` (a timestamp); without it or
    where it is null they give ``deep_space``.

    Rows are vectorised batch by batch and never shuffled.  Null elements give ``not_finite``;
    positions inside the Earth (``minimum_radius_km``) give ``decayed``; rows with a code other
    than ``ok`` have null states.
    """
    out = ["x", "y", "z", "vx", "vy", "vz"]
    base = states.drop(*out, "code")
    dated = epoch in base.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *(f"{c} double" for c in out), "code string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (*ELEMENTS, minutes)]
            jd = None
            if dated:
                at = batch.column("__epoch_ms").cast(pa.float64()).to_numpy(zero_copy_only=False)
                jd = at / K.MS_DAY + K.UNIX_EPOCH_JD
            position, velocity, code = sgp4.propagate(*args, jd)
            if minimum_radius_km is not None:
                low = (code == 0) & (np.sqrt((position**2).sum(1)) < minimum_radius_km)
                code[low] = sgp4.CODES.index("decayed")
            bad = code != 0
            values = [pa.array(v, pa.float64(), mask=bad) for v in (*position.T, *velocity.T)]
            names = pa.array(np.array(sgp4.CODES)[code], pa.string())
            kept = [n for n in batch.schema.names if n != "__epoch_ms"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *values, names], [*kept, *out, "code"])

    return (base.withColumn("__epoch_ms", F.unix_micros(F.col(epoch).cast("timestamp")) / 1000.0) if dated else base).mapInArrow(run, schema)


def on_grid(objects: DataFrame, start_min: float, end_min: float, step_min: float) -> DataFrame:
    """Objects times a grid of minutes since epoch: start, every step before the end, and the end."""
    inner = F.transform(F.sequence(F.lit(0), F.lit(int((end_min - start_min) // step_min))), lambda i: F.lit(float(start_min)) + i * F.lit(float(step_min)))
    grid = F.when(F.element_at(inner, -1) < end_min, F.concat(inner, F.array(F.lit(float(end_min))))).otherwise(inner)
    return objects.withColumn("minutes", F.explode(grid))


def ground_track(states: DataFrame, gmst) -> DataFrame:
    """lat_deg, lon_deg, alt_km under each state; null where there is none."""
    fixed = G.eci_to_ecef((F.col("x"), F.col("y"), F.col("z")), gmst)
    return states.withColumns(G.ecef_to_geodetic(fixed))
