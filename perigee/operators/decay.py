"""Decay estimates: confirmed records first, then a search back from now, then one ahead.

Each object is one row.  Its grid of times (two hours apart for 60 days back, half an hour apart
for 180 days ahead) is searched in blocks, coarse to fine: the whole grid and then each block is
passed over where a bound on the model's radius, which takes no state, lies above the threshold,
and a block is walked point by point otherwise.  Deep-space orbits have no such bound: there a
block is passed over where the perigees at both of its ends are well above the threshold.
Objects that have been found leave the search.  The result is that of the whole walk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.functions import constants as K
from perigee.functions import sgp4
from perigee.operators.propagation import ELEMENTS

#: Points of a block, and how far above the threshold bounds, or both perigees in deep space, must be for it to be passed over.
BLOCK, BOUND_KM, CLEAR_KM = 48, 1.0, 100.0
#: Objects that one evaluation of a block may take: its arrays stay in a core's cache.
AT_ONCE = 100
_FLATTENING = 1 / 298.257223563


@dataclass(frozen=True)
class Decay:
    reentry_km: float = 120.0
    coarse_km: float = 2000.0
    back_days: float = 60.0
    ahead_days: float = 180.0
    step_min: float = 30.0
    back_step_min: float = 120.0


def altitude(position: np.ndarray) -> np.ndarray:
    """Height (km) over the ellipsoid of positions (n, 3); turning about the axis doesn't change it."""
    e2 = _FLATTENING * (2 - _FLATTENING)
    r, z = np.hypot(position[:, 0], position[:, 1]), position[:, 2]
    lat = np.arctan2(z, r * (1 - e2))
    for _ in range(6):
        n = K.EARTH_RADIUS_KM / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + n * e2 * np.sin(lat), r)
    return r * np.cos(lat) + z * np.sin(lat) - K.EARTH_RADIUS_KM * np.sqrt(1 - e2 * np.sin(lat) ** 2)


def perigee(position: np.ndarray, velocity: np.ndarray) -> np.ndarray:
    """Height (km) of the perigee of the orbit that a state is on just then; NaN for an open one."""
    r = np.sqrt((position**2).sum(1))
    energy = (velocity**2).sum(1) / 2 - sgp4.MU / r
    with np.errstate(all="ignore"):
        a = np.where(energy < 0, -sgp4.MU / (2 * energy), np.nan)
        h2 = (np.cross(position, velocity) ** 2).sum(1)
        return a * (1 - np.sqrt(np.maximum(0, 1 - h2 / (sgp4.MU * a)))) - K.EARTH_RADIUS_KM


class _Sky:
    """Objects of a batch: elements by column, and the states they have at given times."""

    def __init__(self, epoch_ms: np.ndarray, elements: list[np.ndarray]):
        self.epoch, self.elements, self.jd = epoch_ms, elements, epoch_ms / K.MS_DAY + K.UNIX_EPOCH_JD
        self.mean = sgp4.mean_orbits(*elements, self.jd)

    def clear(self, i: np.ndarray, start_ms: int, end_ms: int, km: float) -> np.ndarray:
        """Whether objects ``i`` surely have a state above that altitude at all times from start to end."""
        return sgp4.least_radius(self.mean, i, (start_ms - self.epoch[i]) / 60000.0, (end_ms - self.epoch[i]) / 60000.0) > K.EARTH_RADIUS_KM + km + BOUND_KM

    def at(self, i: np.ndarray, t_ms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(altitude, perigee) of objects ``i``; NaN where there is no state."""
        p, v, code = sgp4.propagate(*(x[i] for x in self.elements), (t_ms - self.epoch[i]) / 60000.0, self.jd[i])
        return np.where(code == 0, altitude(p), np.nan), np.where(code == 0, perigee(p, v), np.nan)


def first_crossing(sky: _Sky, which: np.ndarray, start_ms: int, end_ms: int, step_ms: int, cfg: Decay) -> tuple[np.ndarray, np.ndarray]:
    """(time, failed) for objects ``which``: the first grid time, both ends included, without a state or at or under the threshold; -1 for none."""
    n = int((end_ms - start_ms) // step_ms) + 1
    at, failed = np.full(len(which), -1, np.int64), np.zeros(len(which), bool)
    open_ = np.flatnonzero(~sky.clear(which, start_ms, start_ms + (n - 1) * step_ms, cfg.reentry_km)) if n > 0 else np.zeros(0, np.int64)
    perigees = lambda j, t_ms: sky.at(which[j], np.full(len(j), t_ms))[1]
    deep = sky.mean.deep[which]
    low = np.full(len(which), np.nan)
    if len(far := open_[deep[open_]]):
        low[far] = perigees(far, start_ms)
    for k in range(0, n, BLOCK):
        if not len(open_):
            break
        to = min(k + BLOCK, n)
        near = ~sky.clear(which[open_], start_ms + k * step_ms, start_ms + (to - 1) * step_ms, cfg.reentry_km)
        if len(far := open_[deep[open_]]):
            last = perigees(far, start_ms + min(to, n - 1) * step_ms)
            near[deep[open_]] = ~(np.minimum(low[far], last) > cfg.reentry_km + CLEAR_KM)  # a missing state isn't clear
            low[far] = last
        found = np.zeros(len(open_), bool)
        walk = np.flatnonzero(near)
        for j in range(0, len(walk), AT_ONCE):
            some = walk[j : j + AT_ONCE]
            times = start_ms + np.arange(k, to) * step_ms
            height = sky.at(np.repeat(which[open_[some]], len(times)), np.tile(times, len(some)))[0].reshape(len(some), -1)
            hit = ~(height > cfg.reentry_km)
            first = hit.argmax(1)
            some_found = hit.any(1)
            got = open_[some[some_found]]
            at[got] = times[first[some_found]]
            failed[got] = np.isnan(height[some_found, first[some_found]])
            found[some[some_found]] = True
        open_ = open_[~found]
    return at, failed


def latest_confirmed(records: DataFrame, key: str, date: str) -> DataFrame:
    """One record of each key, the latest by ``date``; rows without either are dropped."""
    rest = [c for c in records.columns if c != key]
    usable = records.where(F.col(key).isNotNull() & F.col(date).isNotNull())
    return usable.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(date, *rest)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


_FOUND = "decay_status string, decay_reason string, decay_ms long, window_start_ms long, window_end_ms long, confidence double, altitude_km double"


def estimates(objects: DataFrame, now_ms: int, confirmed: DataFrame | None = None, key: str = "object_id", cfg: Decay = Decay()) -> DataFrame:
    """``objects`` (a key, ``epoch`` and the seven elements) with decay_status, decay_reason, decay_ms, window_start_ms, window_end_ms, confidence and altitude_km.

    ``confirmed`` (key, decay_ms) overrides any search.  Null elements or epochs give UNKNOWN; a
    state that can't be computed now, or a crossing back in time, CONFIRMED; one ahead, PREDICTED
    with a window; objects above ``coarse_km`` aren't searched.  Rows that repeat are judged
    alike; an empty table gives no rows; other columns of the result's names are replaced.
    """
    names = [x.split()[0] for x in _FOUND.split(", ")]
    base = objects.drop(*names, "__epoch_ms", "__confirmed").withColumn("__epoch_ms", F.unix_micros(F.col("epoch").cast("timestamp")) / 1000.0)
    if confirmed is None:
        base = base.withColumn("__confirmed", F.lit(None).cast("long"))
    else:
        base = base.join(latest_confirmed(confirmed.select(key, F.col("decay_ms").cast("long").alias("__confirmed")), key, "__confirmed"), key, "left")
    kept = [c for c in base.columns if not c.startswith("__")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in kept), _FOUND])
    step, back_step = int(cfg.step_min * 60_000), int(cfg.back_step_min * 60_000)
    back, ahead = now_ms - int(cfg.back_days * K.MS_DAY), now_ms + int(cfg.ahead_days * K.MS_DAY)
    pad = int(max(1, min(10, math.ceil(cfg.step_min / 60))) * K.MS_DAY / 2)

    def judge(epoch: np.ndarray, elements: list[np.ndarray], known: list) -> list[tuple]:
        n = len(known)
        out: list[tuple | None] = [("CONFIRMED", "Confirmed decay record", x, None, None, None, None) if x is not None else None for x in known]
        whole = np.isfinite(epoch + sum(elements))
        for i in range(n):
            if out[i] is None and not whole[i]:
                out[i] = ("UNKNOWN", "Missing elements; cannot propagate", None, None, None, None, None)
        sky = _Sky(epoch, elements)
        live = np.array([i for i in range(n) if out[i] is None], np.int64)
        height = sky.at(live, np.full(len(live), now_ms))[0] if len(live) else np.zeros(0)
        for i, h in zip(live.tolist(), height.tolist(), strict=True):
            if math.isnan(h):
                out[i] = ("CONFIRMED", "Propagation invalid near current epoch", now_ms, None, None, None, None)
            elif h > cfg.coarse_km:
                out[i] = ("UNKNOWN", f"Altitude {math.floor(h + 0.5)} km exceeds coarse decay search limit", None, None, None, None, h)
        rest = np.array([out[i] is None for i in live.tolist()], bool)
        live, height = live[rest], height[rest]
        why = lambda bad: "Propagation failed" if bad else f"Altitude dropped below {cfg.reentry_km:g} km"
        past, failed = first_crossing(sky, live, back, now_ms, back_step, cfg)
        for i, h, t, bad in zip(live.tolist(), height.tolist(), past.tolist(), failed.tolist(), strict=True):
            if t >= 0:
                out[i] = ("CONFIRMED", why(bad), t, None, None, None, h)
            elif h <= cfg.reentry_km:
                out[i] = ("CONFIRMED", f"Current altitude {h:.1f} km below {cfg.reentry_km:g} km threshold", now_ms, None, None, None, h)
        rest = np.array([out[i] is None for i in live.tolist()], bool)
        live, height = live[rest], height[rest]
        future, failed = first_crossing(sky, live, now_ms, ahead, step, cfg)
        for i, h, t, bad in zip(live.tolist(), height.tolist(), future.tolist(), failed.tolist(), strict=True):
            if t < 0:
                out[i] = ("UNKNOWN", "Propagation stays above threshold within horizon", None, None, None, None, h)
                continue
            near = max(0.0, min(1.0, (cfg.ahead_days - (t - now_ms) / K.MS_DAY) / cfg.ahead_days))
            drag = min(0.3, abs(float(elements[6][i])) * 1e5)
            out[i] = ("PREDICTED", why(bad), None, t - pad, t + pad, max(0.1, min(1.0, 0.35 + drag + 0.5 * near)), h)
        return out

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = lambda c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            found = judge(numbers("__epoch_ms"), [numbers(c) for c in ELEMENTS], batch.column("__confirmed").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([r[i] for r in found], k) for i, k in enumerate(kinds))], [*kept, *names])

    # an object costs up to thousands of propagations: tasks follow the setting and not the table's bytes
    dealt = base.repartition(int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return dealt.mapInArrow(run, schema)
