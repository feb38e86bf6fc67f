"""Footprints by enumeration against the full grid: poles, the date line, steps that don't divide, satellites out of place."""

import math
import random

import pytest
from pyspark.sql import functions as F

from perigee.operators import coverage

BUDGET = {"ghz": 12.0, "bandwidth_hz": 36e6, "tx_dbw": 13.0, "tx_gain": 30.0, "rx_gain": 35.0, "temperature_k": 290.0}


@pytest.fixture(scope="module")
def satellites(spark):
    r = random.Random(2)
    rows = []
    for i, (lat, lon, up) in enumerate(
        [(90, 0, 800), (-90, 0, 500), (89.5, 10, 35786), (0, 180, 700), (0, -180, 35786), (45, 179.99, 400), (-60, -179.5, 1500), (80, 0, 300), (-85, 90, 900), (0, 0, 0.01), (0, 0, -500), (0, 0, 1e6)]
        + [(r.uniform(-90, 90), r.uniform(-180, 180), r.choice([250, 700, 1400, 20000, 40000])) for _ in range(40)]
    ):
        a, o, d = math.radians(lat), math.radians(lon), 6378.137 + up
        rows.append((i, d * math.cos(a) * math.cos(o), d * math.cos(a) * math.sin(o), d * math.sin(a)))
    return spark.createDataFrame([*rows, (99, None, 1.0, 1.0), (98, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")


@pytest.mark.parametrize("lat_step,lon_step,elevation", [(10, 10, 20.0), (7, 11, 0.0), (3, 25, 5.0), (40, 7, -5.0), (10, 10, 75.0)])
def test_footprints_hold_all_that_is_visible(satellites, lat_step, lon_step, elevation):
    sat = tuple(F.col(c) for c in "xyz")
    full = coverage.coverage_grid(satellites, sat, lat_step, lon_step, elevation, **BUDGET)
    some = coverage.visible_cells(satellites, sat, lat_step, lon_step, elevation, **BUDGET)
    pick = ["id", "lat_min", "lon_min", "range_km", "margin_db", "status", "lat_max", "lon_max"]
    want = {tuple(r) for r in full.where("visible").select(*pick).collect()}
    got = [tuple(r) for r in some.select(*pick).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    cells = coverage.footprint_cells(satellites, sat, lat_step, lon_step, elevation)
    formed, whole = cells.groupBy("id").count().count(), full.count()
    assert cells.count() == cells.distinct().count() and cells.count() < 0.6 * whole and formed <= 54
    assert coverage.grid_size(lat_step, lon_step) * 54 == whole


def test_best_by_cell(satellites):
    sat = tuple(F.col(c) for c in "xyz")
    twice = satellites.unionByName(satellites.withColumn("id", F.col("id") + 1000))  # equal margins: the least id
    got = {(r.lat_min, r.lon_min): r for r in coverage.best_by_cell(coverage.visible_cells(twice, sat, **BUDGET), "id").collect()}
    cells = {}
    for r in coverage.coverage_grid(twice, sat, **BUDGET).where("visible").collect():
        cells.setdefault((r.lat_min, r.lon_min), []).append((-r.margin_db, r.id))
    assert set(got) == set(cells)
    for k, x in cells.items():
        assert (got[k].satellites, got[k].passing, got[k].best_margin_db, got[k].best) == (len(x), sum(m <= 0 for m, _ in x), -min(x)[0], min(x)[1]) and got[k].best < 1000


def test_summary_of_visible_cells_equals_that_of_the_grid(satellites):
    sat = tuple(F.col(c) for c in "xyz")
    full = {r.id: r for r in coverage.coverage_summary(coverage.coverage_grid(satellites, sat, **BUDGET), ["id"]).where("visible > 0").collect()}
    some = {r.id: r for r in coverage.coverage_summary(coverage.visible_cells(satellites, sat, **BUDGET), ["id"], coverage.grid_size()).collect()}
    assert full == some and len(some) > 30
