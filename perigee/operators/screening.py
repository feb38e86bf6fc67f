"""Close approaches within a catalog: a spatially hashed self-join and its refinement.

Per slab of the time grid each object has a start and an end state.  Its swept box, widened by
half of the pair's curvature and radius allowance, is exploded into grid cells; objects meet in
equi-joins on (slab, level, cell), and a pair counts only in its owner cell, the greatest of the
two boxes' least cells by axis, so no ``distinct`` is needed.  Cost follows local density and not
the square of the catalog.

Cells form a tree of edges that double.  An object whose box covers too many cells takes a coarser
level, until it doesn't; where a cell's population, counted first, is high, its objects take cells
of about their own size.  Two objects meet at the coarser level of both, so none is left out, and a
dense cell's objects meet one another only where their boxes are near.  Where boxes are so wide and many
that cells would form about as many meetings as there are pairs, estimated first,
the slab's pairs are tested in blocks (:mod:`perigee.operators.crowded`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from perigee.functions import catalog as C
from perigee.functions import geometry as G
from perigee.operators import blocks, crowded
from perigee.operators.rounds import materialised

#: Numeric slack added to every box.
EPSILON_KM = 1e-9
AXES = ("x", "y", "z")
#: Doublings of the cell's edge, at most; then a box covers two cells by axis at most.
LEVELS = 62


@dataclass(frozen=True)
class Screening:
    radius_km: float = 10.0
    padding_km: float = 0.0
    cell_km: float = 1000.0
    max_acceleration_km_s2: float = 0.0
    max_cells_per_object: int = 512
    max_memberships_per_slab: int = 2_000_000
    max_candidates: int = 250_000
    max_results: int = 1000
    #: Objects in a cell above which its smaller boxes take finer cells, and members of a coarse cell that meet in one part.
    dense_cell: int = 64
    meeting_rows: int = 4096
    #: Pairs of a slab above which it may be tested in blocks, and how many pairs in a block cost as much as one meeting in a cell.
    crowd_pairs: int = 262_144
    meeting_cost: int = 8
    #: Objects of a slab that the share of overlapping boxes is estimated from, about.
    probed: int = 256
    max_pair_checks_per_slab: int = 5_000_000

    def curvature_km(self, seconds: Column, acceleration: float | None = None) -> Column:
        a = self.max_acceleration_km_s2 if acceleration is None else acceleration
        return a * seconds * seconds / 8

    def threshold_km(self, seconds: Column) -> Column:
        return self.radius_km + self.padding_km + self.curvature_km(seconds)


def time_grid(start_ms: Column, end_ms: Column, step_s: Column | float) -> Column:
    """Start, every step before the end, and the end itself."""
    step = (F.lit(step_s) if not isinstance(step_s, Column) else step_s) * 1000
    inner = F.sequence(start_ms, end_ms, step.cast("long"))
    return F.when(F.element_at(inner, -1) == end_ms, inner).otherwise(F.concat(inner, F.array(end_ms)))


def position(prefix: str) -> G.Vector:
    return tuple(F.col(f"{prefix}{a}") for a in AXES)


def sane(df: DataFrame, acceleration: float) -> DataFrame:
    """Slab states that forward and backward motion and speed change allow: columns p0*, v0*, p1*, v1*, seconds."""
    s = F.col("seconds")
    p0, v0, p1, v1 = (position(x) for x in ("p0", "v0", "p1", "v1"))
    forward = tuple(b - a - v * s for a, b, v in zip(p0, p1, v0, strict=True))
    back = tuple(a - b + v * s for a, b, v in zip(p0, p1, v1, strict=True))
    far, fast = acceleration * s * s / 2 + 1e-6, acceleration * s + 1e-9
    return df.where((G.norm(forward) <= far) & (G.norm(back) <= far) & (G.norm(G.sub(v1, v0)) <= fast))


_PATH = [f"{n}{a}" for n in ("p0", "p1") for a in AXES]


def growth_km(seconds: Column, cfg: Screening) -> Column:
    """How far a box goes beyond the two ends of a straight path: half of the pair's allowance."""
    return cfg.curvature_km(seconds, cfg.max_acceleration_km_s2 / 2) + (cfg.radius_km + cfg.padding_km) / 2 + EPSILON_KM


def _ends(state: str, grow: Column, axis: str) -> tuple[Column, Column]:
    p0, p1 = F.col(f"{state}p0{axis}"), F.col(f"{state}p1{axis}")
    return F.least(p0, p1) - grow, F.greatest(p0, p1) + grow


def _edge(level: Column, cfg: Screening) -> Column:
    return F.lit(cfg.cell_km) * F.pow(F.lit(2.0), level)


def _copies(states: DataFrame) -> list[str]:
    return ["copies"] if "copies" in states.columns else []


def _objects(states: DataFrame, column: str = "copies") -> Column:
    """How many objects the rows of a group stand for."""
    return F.sum(column) if _copies(states) else F.count("*")


def swept_boxes(states: DataFrame, cfg: Screening) -> DataFrame:
    """(slab, seconds, id, own, p0*, p1*, cells) of ``states`` (slab, id, seconds, p0*, p1*): ``own`` is the box's level.

    The box itself is not carried: the two ends of the path and the slab's growth say it in as
    many numbers.  ``cells`` is how many cells of the first level it covers.  The level is 0, or
    the first coarser one at which the box covers no more than ``max_cells_per_object``.  Where
    the cell of a box's middle holds more than ``dense_cell`` objects, a box that is smaller than
    the cell goes down to cells of about its own size.  A column ``copies``, where there is one,
    says how many objects with this path a row stands for; it is passed on and counts as so many.
    """
    grow = growth_km(F.col("seconds"), cfg)
    ends = [_ends("", grow, a) for a in AXES]
    cells = [(F.floor(lo / cfg.cell_km), F.floor(hi / cfg.cell_km)) for lo, hi in ends]
    number = F.lit(1)
    for c0, c1 in cells:
        number = number * (c1 - c0 + 1)
    at = lambda c, level: F.call_function("shiftright", c, level)
    covered = lambda level: math.prod(at(c1, level).cast("double") - at(c0, level) + 1 for c0, c1 in cells)
    coarser = F.try_element_at(F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda level: covered(level) <= cfg.max_cells_per_object), F.lit(1))
    level = F.when(number <= cfg.max_cells_per_object, 0).otherwise(F.coalesce(coarser, F.lit(LEVELS)))
    widest = F.greatest(*[hi - lo for lo, hi in ends])
    finer = F.greatest(F.lit(-LEVELS), F.ceil(F.log2(widest / cfg.cell_km))).cast("int")
    middle = [F.floor((lo + hi) / (2 * cfg.cell_km)).alias(f"m{a}") for a, (lo, hi) in zip(AXES, ends, strict=True)]
    copies = _copies(states)
    sized = states.select("slab", "seconds", "id", *copies, *_PATH, number.alias("cells"), level.cast("int").alias("level"), F.when(finer < 0, finer).alias("finer"), *middle)
    where = ["slab", *[f"m{a}" for a in AXES]]
    # a cell's population is counted with the objects that could go down, before any pair is formed
    dense = sized.where("finer is not null and level = 0").groupBy(*where).agg(_objects(states).alias("population")).where(F.col("population") > cfg.dense_cell)
    placed = sized.join(dense, where, "left")
    own = F.when((F.col("level") == 0) & F.col("population").isNotNull() & F.col("finer").isNotNull(), F.col("finer")).otherwise(F.col("level"))
    return placed.select("slab", "seconds", "id", *copies, own.alias("own"), *_PATH, "cells")


_CELL = ["slab", "level", "cx", "cy", "cz"]


def memberships(boxes: DataFrame, level: Column, cfg: Screening) -> DataFrame:
    """(slab, level, cx, cy, cz, seconds, s, first): cells of each box at ``level``.

    ``s`` holds id, copies if there are any, own and the path: as columns of their own, the join's many conditions times
    the many renamed columns would keep the optimizer busy inferring constraints.  ``first`` has a
    bit for each axis on which the cell is the box's first one.
    """
    held = ["id", *_copies(boxes), "own", *_PATH]
    out = boxes.select("slab", "seconds", *held, level.alias("level"))
    grow, edge = growth_km(F.col("seconds"), cfg), _edge(F.col("level"), cfg)
    borders = {}
    for a in AXES:
        lo, hi = _ends("", grow, a)
        borders |= {f"c0{a}": F.floor(lo / edge), f"c1{a}": F.floor(hi / edge)}
    out = out.withColumns(borders)
    first = F.lit(0)
    for i, a in enumerate(AXES):
        out = out.withColumn(f"c{a}", F.explode(F.sequence(f"c0{a}", f"c1{a}")))
        first = first + F.when(F.col(f"c{a}") == F.col(f"c0{a}"), 1 << i).otherwise(0)
    return out.select(*_CELL, "seconds", F.struct(*held).alias("s"), first.alias("first"))


def _coarser_planes() -> Column:
    """Levels above a box's own up to the greatest of its slab, for boxes with a column ``most``."""
    return F.explode(F.when(F.col("most") > F.col("own"), F.sequence(F.col("own") + 1, F.col("most"))))


def meetings(boxes: DataFrame, cfg: Screening) -> DataFrame:
    """(slab, seconds, a, b, owner): two boxes in one cell; ``owner`` tells the one cell in which the pair counts.

    Boxes of one level meet in cells of that level, others at the coarser level of both.  Of the
    cells that two boxes share, the owner is the first by every axis for one of the two, so no
    ``distinct`` is needed.  Finer boxes that fill a coarse cell are dealt to several tasks by id,
    and the few boxes of that level go to each: the number of parts follows the cell's population.
    """
    own = memberships(boxes, F.col("own"), cfg)
    most = boxes.groupBy("slab").agg(F.max("own").alias("most"))
    below = memberships(boxes.join(most, "slab"), _coarser_planes(), cfg)
    side = lambda rows, n, *more: rows.select(*_CELL, *more, F.col("s").alias(n), F.col("first").alias(f"first_{n}"))
    same = side(own, "a", "seconds").join(side(own, "b"), _CELL).where(F.col("a.id") < F.col("b.id"))
    full = below.groupBy(*_CELL).agg(F.ceil(F.count("*") / cfg.meeting_rows).alias("parts")).where("parts > 1")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    few = own.join(full, _CELL, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    many = below.join(full, _CELL, "left").withColumn("part", F.pmod(F.xxhash64("s.id"), parts))
    across = side(few, "a", "seconds", "part").join(side(many, "b", "part"), [*_CELL, "part"])
    turned = F.col("a.id") > F.col("b.id")
    across = across.select(*_CELL, "seconds", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), "first_a", "first_b")
    met = same.select(*_CELL, "seconds", "a", "b", "first_a", "first_b").unionByName(across)
    return met.select("slab", "seconds", "a", "b", (F.col("first_a").bitwiseOR(F.col("first_b")) == 7).alias("owner"))


def overlapping(cfg: Screening) -> Column:
    grow = growth_km(F.col("seconds"), cfg)
    out = F.lit(True)
    for x in AXES:
        (alo, ahi), (blo, bhi) = _ends("a.", grow, x), _ends("b.", grow, x)
        out = out & (alo <= bhi) & (blo <= ahi)
    return out


def _cell_pairs(states: DataFrame, cfg: Screening, counted: Observation | None = None) -> DataFrame:
    """:func:`box_pairs` by cells alone; a and b hold what :func:`swept_boxes` gives."""
    met = meetings(swept_boxes(states, cfg), cfg)
    if counted is not None:
        pairs = F.col("a.copies") * F.col("b.copies") if _copies(states) else F.lit(1).cast("long")
        total = lambda c: F.coalesce(F.sum(F.when(c, pairs)), F.lit(0).cast("long"))
        met = met.withColumn("over", overlapping(cfg)).observe(counted, total(F.col("owner")).alias("canonical_pair_checks"), total(F.col("owner") & F.col("over")).alias("aabb_candidates"))
        return met.where("owner and over").select("slab", "seconds", "a", "b")
    return met.where(F.col("owner") & overlapping(cfg)).select("slab", "seconds", "a", "b")


def crowds(states: DataFrame, cfg: Screening) -> DataFrame:
    """(slab, blocks) of slabs whose meetings in cells would cost more than all pairs tested in blocks.

    A pair whose boxes overlap meets in cells at least once; the share of such pairs is estimated from some ``probed``
    objects of a slab, chosen by hash.  It decides on the way alone: either gives the same pairs.
    Slabs of a few pairs gain nothing, and slabs with a coordinate that isn't finite keep to cells.
    """
    odd = F.lit(False)
    for c in _PATH:
        odd = odd | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    size = states.groupBy("slab").agg(F.count("*").alias("n"), F.max(odd).alias("odd")).where(~F.col("odd") & (F.expr("n * (n - 1) / 2") > cfg.crowd_pairs)).select("slab", "n")
    some = states.join(size, "slab").where(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / cfg.probed)) == 0)
    side = lambda n, *more: some.select("slab", *more, F.struct("id", *_PATH).alias(n))
    met = side("a", "seconds", "n").join(side("b"), "slab").where(F.col("a.id") < F.col("b.id"))
    tasks = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = met.groupBy("slab", "n").agg(F.count("*").alias("met"), F.count_if(overlapping(cfg)).alias("over"))
    return share.where(F.col("over") * cfg.meeting_cost >= F.col("met")).select("slab", crowded.blocks_of(F.col("n"), tasks).alias("blocks"))


def _parted(states: DataFrame, cfg: Screening, by_cell: Callable[[DataFrame], DataFrame], in_blocks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs of crowded slabs from blocks and of all others from cells; a way that no slab takes is no part of the plan."""
    full = materialised(crowds(states, cfg))
    if not full.limit(1).count():
        return by_cell(states)
    rest = states.join(full.select("slab"), "slab", "left_anti")
    found = in_blocks(full)
    return by_cell(rest).unionByName(found) if rest.limit(1).count() else found


def box_pairs(states: DataFrame, cfg: Screening, counted: Observation | None = None, paths: bool = True) -> DataFrame:
    """(slab, seconds, a, b) of pairs a.id < b.id whose swept boxes overlap; a and b hold the id and, where ``paths`` says so, the path.

    ``counted`` gets canonical_pair_checks and aabb_candidates of the cells in the same pass, so then all slabs use them.
    """
    if counted is not None or _copies(states):
        return _cell_pairs(states, cfg, counted)
    held = lambda n: F.struct(*[F.col(f"{n}.{c}").alias(c) for c in ("id", *(_PATH if paths else []))]).alias(n)
    by_cell = lambda rows: _cell_pairs(rows, cfg).select("slab", "seconds", held("a"), held("b"))
    return _parted(states, cfg, by_cell, lambda full: crowded.pairs(states, full, _PATH, lambda s: growth_km(s, cfg), paths=paths))


def near_pairs(states: DataFrame, cfg: Screening, counted: Observation | None = None, paths: bool = False, even: bool = False) -> DataFrame:
    """(slab, seconds, a, b, fraction, distance_km) of pairs whose straight paths come within the radius and its allowances.

    ``a`` and ``b`` hold the id, the copies if there are any and, where ``paths`` says so, the path.  Such a pair's boxes overlap.
    Where ``even`` says so, for what costs much a pair, pairs from cells are dealt out anew; blocks deal theirs evenly as they are, and
    these, which grow with the square of a slab, stay in their tasks.
    """
    limit = lambda s: cfg.threshold_km(s) + EPSILON_KM
    names = ["id", *_copies(states), *(_PATH if paths else [])]
    held = lambda n: F.struct(*[F.col(f"{n}.{c}").alias(c) for c in names]).alias(n)
    n = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(n, "a.id", "b.id") if even else rows
    by_cell = lambda rows: dealt(chord(_cell_pairs(rows, cfg, counted)).where(F.col("distance_km") <= limit(F.col("seconds"))).select("slab", "seconds", held("a"), held("b"), "fraction", "distance_km"))
    if counted is not None or _copies(states):
        return by_cell(states)
    return _parted(states, cfg, by_cell, lambda full: crowded.pairs(states, full, _PATH, lambda s: growth_km(s, cfg), limit, paths))


def slab_load(states: DataFrame, cfg: Screening) -> DataFrame:
    """(slab, objects, memberships, spatial_cells, spatial_pair_checks): what the join of each slab would cost, counted without it.

    Cells are those in which boxes of one level meet; meetings across levels add a cell's boxes
    of that level times the finer ones in it.
    """
    boxes = swept_boxes(states, cfg)
    per = boxes.groupBy("slab").agg(_objects(states).alias("objects"))
    own = memberships(boxes, F.col("own"), cfg).groupBy(*_CELL).agg(_objects(states, "s.copies").alias("n"))
    most = boxes.groupBy("slab").agg(F.max("own").alias("most"))
    finer = memberships(boxes.join(most, "slab"), _coarser_planes(), cfg).groupBy(*_CELL).agg(_objects(states, "s.copies").alias("m"))
    n, m = F.col("n"), F.coalesce(F.col("m"), F.lit(0))
    cells = own.join(finer, _CELL, "left").groupBy("slab").agg(F.sum("n").alias("memberships"), F.count("*").alias("spatial_cells"), F.sum(F.expr("n * (n - 1) div 2") + n * m).alias("spatial_pair_checks"))
    return per.join(cells, "slab")


def chord(pairs: DataFrame) -> DataFrame:
    """The closest point of straight relative motion: fraction of the slab and distance.

    Steps are generated rows: a plain projection would let the optimizer push conditions on the
    distance into the cell join and evaluate them for every meeting of two boxes.
    """
    r0 = G.sub(position("b.p0"), position("a.p0"))
    r1 = G.sub(position("b.p1"), position("a.p1"))
    moved = pairs.select("*", F.inline(F.array(F.struct(*[c.alias(f"r{a}") for a, c in zip(AXES, r0, strict=True)], *[c.alias(f"d{a}") for a, c in zip(AXES, G.sub(r1, r0), strict=True)]))))
    r, d = position("r"), position("d")
    length = G.dot(d, d)
    at = F.when(length > 0, F.least(F.greatest(F.try_divide(-G.dot(r, d), length), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    placed = moved.select("*", F.inline(F.array(F.struct(at.alias("fraction")))))
    return placed.select("*", F.inline(F.array(F.struct(G.norm(G.along(r, d, F.col("fraction"))).alias("distance_km")))))


def candidates(states: DataFrame, cfg: Screening, counted: Observation | None = None) -> DataFrame:
    """(slab, a, b, fraction, distance_km): pairs that may come within the radius, each once per slab.

    Of states with ``copies`` a row stands for ``pairs`` pairs of objects, and those within one row are
    a row of their own, whose ``a`` and ``b`` are alike.
    """
    near = near_pairs(states, cfg, counted)
    many = _copies(states)
    out = near.select("slab", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "seconds", "fraction", "distance_km", *[(F.col("a.copies") * F.col("b.copies")).alias("pairs") for _ in many])
    if not many:
        return out
    within = states.where("copies > 1").select("slab", F.col("id").alias("a"), F.col("id").alias("b"), "seconds", F.lit(0.0).alias("fraction"), F.lit(0.0).alias("distance_km"), F.expr("copies * (copies - 1) div 2").alias("pairs"))
    return out.unionByName(within)


def admitted(found: DataFrame, cfg: Screening) -> DataFrame:
    """Slabs before the first that exceeds the running limit of candidates; the reference limits work this way."""
    per = found.groupBy("slab").agg(F.count("*").alias("n"))
    running = per.withColumn("total", F.sum("n").over(Window.orderBy("slab")))  # one row per slab
    return found.join(running.where(F.col("total") <= cfg.max_candidates).select("slab"), "slab", "left_semi")


def linear_events(found: DataFrame, slabs: DataFrame, cfg: Screening) -> DataFrame:
    """Closest approaches under straight motion within the radius, at whole milliseconds.

    ``slabs`` has (slab, start_ms).  A minimum at a slab's end belongs to the next slab, unless
    it is the last; so a shared border counts once.
    """
    last = slabs.agg(F.max("slab").alias("last_slab"))
    near = found.where(F.col("distance_km") <= cfg.radius_km).join(slabs, "slab").join(F.broadcast(last))
    owned = near.where((F.col("fraction") < 1) | (F.col("slab") == F.col("last_slab")))
    tca = F.floor(F.col("start_ms") + F.col("fraction") * F.col("seconds") * 1000 + 0.5).cast("long")
    return owned.select("slab", "a", "b", C.pair_key(F.col("a").cast("string"), F.col("b").cast("string")).alias("pair_key"), tca.alias("tca_ms"), F.col("distance_km").alias("miss_km"))


def dedup_events(events: DataFrame, tolerance_s: float, pair: str = "pair_key", tca: str = "tca_ms", miss: str = "miss_km", ident: str = "event_id", lo: str = "lo_ms", hi: str = "hi_ms") -> DataFrame:
    """Folds events of a pair that refine to one minimum: overlapping brackets, close times.

    Each event is compared with the last *kept* one, which a closer miss replaces, so this is a
    fold and no ``lag``.  Rows are dealt by pair, sorted by time and walked; the state is the one
    event that may still be replaced, however many events a pair has.
    """
    gap = max(1.0, tolerance_s * 1000)
    names = [pair, tca, miss, ident, lo, hi]

    def closer(a: float | None, b: float | None) -> bool:
        return a is not None and b is not None and (a < b or (b != b and a == a))  # NaN comes last, as in Spark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, types = None, None
        for batch in batches:
            types, out = batch.schema.types, []
            for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = last is not None and last[0] == e[0] and None not in (last[1], last[4], last[5], e[1], e[4], e[5])
                if whole and last[5] >= e[4] and e[5] >= last[4] and e[1] - last[1] <= gap:
                    last = e if closer(e[2], last[2]) else last
                    continue
                if last is not None:
                    out.append(last)
                last = e
            yield rows(out, types)
        if last is not None:
            yield rows([last], types)

    def rows(out: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    chosen = events.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema)
    return chosen.repartition(pair).sortWithinPartitions(*names).mapInArrow(run, schema)


def ranked(events: DataFrame, cfg: Screening) -> DataFrame:
    return events.orderBy("tca_ms", "pair_key").limit(cfg.max_results)


def statistics(states: DataFrame, found: DataFrame, cfg: Screening) -> DataFrame:
    """One row: objects, slabs, cell memberships, possible pair intervals, candidates."""
    boxes = swept_boxes(states, cfg)
    per_slab = boxes.groupBy("slab").agg(F.count("*").alias("n"), F.sum("cells").alias("m"))
    left = per_slab.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("possible_pairs"), F.sum("m").alias("memberships"), F.count("*").alias("slabs"), F.max("n").alias("objects"))
    return left.crossJoin(F.broadcast(found.agg(F.count("*").alias("candidates"))))


def local_minima(samples: DataFrame, partition: list[str], time: str, value: str) -> DataFrame:
    """Plateaus of ``value`` over ``time`` that are no higher than both sides and lower than one.

    Equal means within a relative 1e-12.  The first and the last plateau count when they are not
    higher (first) or lower (last) than their only neighbour.  What stands before and after a
    plateau is carried from block to block of a series, so a long one takes many tasks.
    """
    rows = blocks.blocked(samples, partition, [time])
    rows = blocks.carried(rows, partition, [time], last={"__at": F.struct(F.col(value).alias("v"), F.col(time).alias("t"))}, own=False)
    before = F.col("__at.v")
    new = F.col("__at").isNull() | (F.abs(F.col(value) - before) > F.greatest(F.lit(1.0), F.abs(value), F.abs(before)) * 1e-12)
    rows = rows.withColumn("__first", F.when(new, F.struct(F.col(value).alias("v"), F.col("__at.t").alias("ended"))))
    rows = blocks.carried(rows, partition, [time], last={"__left": F.col("__first")}, first={"__right": F.col("__first")}, own=False)
    ends = samples.groupBy(*partition).agg(F.max(time).alias("__last"))
    same = F.lit(True)
    for k in partition:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    flat = rows.where("__first is not null").join(ends.select(*[F.col(k).alias(f"__k_{k}") for k in partition], "__last"), same)
    left, right, v = F.col("__left.v"), F.col("__right.v"), F.col(value)
    inner = (left > v) & (right > v)
    first, last = left.isNull() & (right.isNull() | (right >= v)), right.isNull() & (left > v)
    lowest = F.coalesce(inner, F.lit(False)) | F.coalesce(first, F.lit(False)) | F.coalesce(last, F.lit(False))
    return flat.where(lowest).select(*partition, F.col(time).alias("start"), F.coalesce("__right.ended", "__last").alias("end"), v.alias("value"))
