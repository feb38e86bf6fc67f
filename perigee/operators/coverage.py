"""Coverage grids over a satellite's view with a link budget per cell, and footprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions import constants as K
from perigee.functions import geometry as G
from perigee.functions import rf


def _budgeted(cells: DataFrame, sat: G.Vector, lat_step: int, lon_step: int, min_elevation: float, beam: tuple[Column, Column, float] | None, budget: dict) -> DataFrame:
    """``cells`` (lat_min, lon_min) with look geometry and link budget at the cells' middles."""
    cells = cells.withColumn("lat_deg", F.col("lat_min") + lat_step / 2).withColumn("lon_deg", F.col("lon_min") + lon_step / 2)
    cells = cells.withColumns(G.look(sat, F.col("lat_deg"), F.col("lon_deg")))
    visible = F.col("line_of_sight") & (F.col("elevation_deg") >= min_elevation)
    loss = F.lit(0.0)
    if beam is not None:
        loss = G.beam_loss_db(G.surface_separation(beam[0], beam[1], F.col("lat_deg"), F.col("lon_deg")), beam[2])
    b = rf.link_budget(F.col("range_km"), **{**budget, "more": loss + budget.get("more", 0.0)})
    return (
        cells.withColumn("visible", visible)
        .withColumn("beam_loss_db", loss)
        .withColumn("delay_ms", rf.delay_ms(F.greatest(F.col("range_km"), F.lit(1e-6))))
        .withColumn("margin_db", F.when(visible, b["margin_db"]).otherwise(-math.inf))
        .withColumn("required_tx_dbw", F.when(visible, b["required_tx_dbw"]).otherwise(math.inf))
        .withColumn("status", F.when(visible, b["status"]).otherwise("blocked"))
        .withColumn("lat_max", F.least(F.lit(85), F.col("lat_min") + lat_step))
        .withColumn("lon_max", F.least(F.lit(180), F.col("lon_min") + lon_step))
    )


def _steps(lat_step: int, lon_step: int) -> tuple[int, int]:
    return max(1, abs(lat_step)), max(1, abs(lon_step))


def grid_size(lat_step: int = 10, lon_step: int = 10) -> int:
    """Cells from 80 degrees south to 80 north and all around."""
    a, o = _steps(lat_step, lon_step)
    return (160 // a + 1) * -(-360 // o)


def coverage_grid(satellites: DataFrame, sat: G.Vector, lat_step: int = 10, lon_step: int = 10, min_elevation: float = 20.0, beam: tuple[Column, Column, float] | None = None, **budget) -> DataFrame:
    """One row per satellite and cell.  Blocked cells carry -inf margin and +inf required power."""
    a, o = _steps(lat_step, lon_step)
    lat = F.explode(F.sequence(F.lit(-80), F.lit(80), F.lit(a)))
    lon = F.explode(F.sequence(F.lit(-180), F.lit(179), F.lit(o)))
    return _budgeted(satellites.withColumn("lat_min", lat).withColumn("lon_min", lon), sat, a, o, min_elevation, beam, budget)


#: Degrees by which a footprint is widened: heights and verticals of the ellipsoid differ from the sphere's by less.
FOOTPRINT_PAD = 0.6


def footprint_cells(satellites: DataFrame, sat: G.Vector, lat_step: int = 10, lon_step: int = 10, min_elevation: float = 20.0) -> DataFrame:
    """``satellites`` with lat_min and lon_min of the cells whose middles may lie in view; no others are formed.

    A footprint is a cap around the point below.  Rows of cells are bounded by the cap's reach in
    latitude, and in each row by the half width in longitude where the row's circle meets the
    cap: the whole row when the cap holds that circle (it may hold a pole), and on both sides
    of the date line otherwise.  Satellites under ground or without a position have no cells.
    """
    a, o = _steps(lat_step, lon_step)
    rows, columns = 160 // a + 1, -(-360 // o)
    distance = G.norm(sat)
    elevation = math.radians(max(0.0, min_elevation) - 0.25)
    low = F.least(F.lit(1.0), F.lit(K.WGS84_B_KM * math.cos(elevation)) / distance)
    reach = F.acos(low) - elevation + math.radians(FOOTPRINT_PAD)
    below_lat, below_lon = F.asin(sat[2] / distance), F.degrees(F.atan2(sat[1], sat[0]))
    out = satellites.withColumns({"__reach": reach, "__lat": below_lat, "__lon": below_lon}).where((distance > K.WGS84_B_KM) & (F.col("__reach") > 0))
    index = lambda degrees, step, start, edge: edge((degrees - start - step / 2) / step).cast("int")
    first = F.greatest(F.lit(0), index(F.degrees(F.col("__lat") - F.col("__reach")), a, -80, F.ceil))
    last = F.least(F.lit(rows - 1), index(F.degrees(F.col("__lat") + F.col("__reach")), a, -80, F.floor))
    last = F.when(F.lit(-80 + (rows - 1) * a + a / 2 > 90), rows - 1).otherwise(last)  # with a wide step the last row's middle lies beyond the pole
    out = out.where(first <= last).withColumn("__i", F.explode(F.sequence(first, last)))
    middle = F.lit(-80 + a / 2) + F.col("__i") * a
    phi = F.radians(middle)
    ratio = F.try_divide(F.cos(F.col("__reach")) - F.sin(F.col("__lat")) * F.sin(phi), F.cos(F.col("__lat")) * F.cos(phi))
    # rows by the poles or caps over them: every longitude; at the cap's rim the ratio may pass 1 by rounding
    half = F.when(ratio.isNull() | (ratio <= -1) | (middle > 90), 180.0).otherwise(F.degrees(F.acos(F.least(ratio, F.lit(1.0)))) + FOOTPRINT_PAD / F.greatest(F.cos(phi), F.lit(0.01)))
    out = out.withColumn("__half", half)
    sides = []
    for turn in (-360.0, 0.0, 360.0):
        begin = F.greatest(F.lit(0), index(F.col("__lon") + turn - F.col("__half"), o, -180, F.ceil))
        end = F.least(F.lit(columns - 1), index(F.col("__lon") + turn + F.col("__half"), o, -180, F.floor))
        sides.append(F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<int>")))
    every = F.sequence(F.lit(0), F.lit(columns - 1))
    cells = F.when(F.col("__half") >= 180.0, every).otherwise(F.array_distinct(F.concat(*sides)))
    out = out.withColumn("__j", F.explode(cells))
    return out.select(*satellites.columns, (F.lit(-80) + F.col("__i") * a).alias("lat_min"), (F.lit(-180) + F.col("__j") * o).alias("lon_min"))


def visible_cells(satellites: DataFrame, sat: G.Vector, lat_step: int = 10, lon_step: int = 10, min_elevation: float = 20.0, beam: tuple[Column, Column, float] | None = None, **budget) -> DataFrame:
    """The visible rows of :func:`coverage_grid`, from the cells of each footprint alone."""
    a, o = _steps(lat_step, lon_step)
    return _budgeted(footprint_cells(satellites, sat, a, o, min_elevation), sat, a, o, min_elevation, beam, budget).where("visible")


def best_by_cell(visible: DataFrame, ident: str, decimals: int = 9) -> DataFrame:
    """(lat_min, lon_min, satellites, passing, best_margin_db, best): what is in view of each cell that any satellite sees.

    The best has the greatest margin, of those equal to ``decimals`` places the least id.  One aggregate with partial sums in each task.
    """
    best = F.min_by(ident, F.struct(-F.round("margin_db", decimals), F.col(ident)))
    return visible.groupBy("lat_min", "lon_min").agg(F.count("*").alias("satellites"), F.count_if(F.col("margin_db") >= 0).alias("passing"), F.max("margin_db").alias("best_margin_db"), best.alias("best"))


def coverage_summary(cells: DataFrame, by: list[str], total: int | None = None) -> DataFrame:
    """Counts and margins by group; ``total`` where ``cells`` are the visible ones of a grid of so many."""
    finite = F.when(F.abs("margin_db") != math.inf, F.col("margin_db"))
    return cells.groupBy(*by).agg(
        (F.count("*") if total is None else F.lit(total).cast("long")).alias("total"),
        F.count_if("visible").alias("visible"),
        F.count_if(F.col("margin_db") >= 0).alias("passing"),
        F.coalesce(F.max(finite), F.lit(-math.inf)).alias("best_margin_db"),
        F.coalesce(F.min(F.when(F.col("margin_db") >= 0, F.col("margin_db"))), F.lit(math.inf)).alias("worst_passing_margin_db"),
    )


def footprint_ring(points: DataFrame, lat: str, lon: str, distance_km: str, n: int = 128) -> DataFrame:
    """The n + 1 points of the visible circle's border."""
    out = points.withColumn("radius", G.footprint_radius(F.col(distance_km))).where("radius is not null")
    out = out.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    a, o = G.great_circle_point(F.col(lat), F.col(lon), F.col("radius"), F.col("i") * (2 * math.pi / n))
    return out.withColumn("ring_lat", a).withColumn("ring_lon", o)


def contour(pattern: DataFrame, phi: str, theta: str, value: str, level: float) -> DataFrame:
    """Grid points at or over ``level`` of the pattern's peak with a neighbour under it, or at the grid's edge.

    The peak is one aggregated row; neighbours are found along each line of the grid.
    """
    peak = pattern.agg(F.max(value).alias("__peak"))
    up = pattern.join(F.broadcast(peak)).withColumn("__up", F.round(F.col(value) / F.col("__peak"), 6) >= level)
    lines = (Window.partitionBy(theta).orderBy(phi), Window.partitionBy(phi).orderBy(theta))
    inside = F.lit(True)
    for w in lines:
        inside = inside & F.coalesce(F.lag("__up").over(w), F.lit(False)) & F.coalesce(F.lead("__up").over(w), F.lit(False))
    return up.withColumn("__in", inside).where(F.col("__up") & ~F.col("__in")).drop("__peak", "__up", "__in")
