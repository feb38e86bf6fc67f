"""Screening of a whole catalog, or of one object against it, from element sets to events and counters.

Objects times the grid's borders are propagated in Arrow batches; neighbouring borders form
slabs; slabs whose states obey the motion bound meet in the spatial hash of
:mod:`perigee.operators.screening`, its chord filter leaves candidates, and these are refined with
SGP4 itself.  Nothing is limited silently: counters say what was lost or cut at every step.

Objects with the same epoch and elements move alike, so they are one row from propagation to the
last event, with ``copies`` saying for how many it stands: the work follows the different
orbits and not the square of their copies.  Counters count objects and pairs of objects, and
events are dealt out to every pair of objects at the end.

What a slab's join would cost is counted before it runs.  A run with limits stops at the first
slab that exceeds one; slabs before it are whole, its envelope says PARTIAL with the reason, and
its pairs and those of later slabs count as unscreened.  Counters of the join itself are observed
in the pass that writes the candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from perigee.functions import catalog as C
from perigee.functions import constants as K
from perigee.functions import geometry as G
from perigee.functions import identity as I
from perigee.operators import catalog as OC
from perigee.operators import propagation, refinement, screening
from perigee.operators.rounds import discard, materialised

#: Difference of two accelerations on circular orbits at the Earth's surface: no pair in orbit exceeds it.
LARGEST_ACCELERATION = 2 * K.SCREENING_MU_KM3_S2 / K.EARTH_RADIUS_KM**2
_STATE = ("x", "y", "z", "vx", "vy", "vz")


@dataclass(frozen=True)
class Run:
    """Window and limits of one screening run; times in milliseconds."""

    start_ms: int
    end_ms: int
    step_s: float = 60.0
    radius_km: float = 10.0
    cell_km: float = 100.0
    tolerance_s: float = 0.001
    max_results: int = 1000
    max_errors: int = 100
    request_id: str = ""
    #: Of a pair; one object may use half of it.
    max_acceleration_km_s2: float = LARGEST_ACCELERATION
    #: What a slab may cost; None for no limit.  The usual limits of one process are 2,000,000, 5,000,000, 250,000 and 10,000.
    max_memberships_per_slab: int | None = None
    max_pair_checks_per_slab: int | None = None
    max_candidates: int | None = None
    max_events: int | None = None

    def limits(self) -> screening.Screening:
        return screening.Screening(radius_km=self.radius_km, cell_km=self.cell_km, max_acceleration_km_s2=self.max_acceleration_km_s2, max_results=self.max_results)

    def borders(self) -> list[int]:
        inner = range(self.start_ms, self.end_ms, int(self.step_s * 1000))
        return [*inner, self.end_ms]


def unique_objects(catalog: DataFrame) -> DataFrame:
    """One element set of each object, the newest; ``skipped`` counts the others."""
    return OC.preferred(catalog, "object_id", "epoch", "element_set_id")


_MOTION = ("epoch", *propagation.ELEMENTS)
#: Objects of one array of alike ones.
_TOGETHER = 1024


def kinds(objects: DataFrame, primary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kinds, members) of unique objects: one row for all that move alike, and who they are.

    Kinds: object_id (the least), epoch, the elements, ``copies`` and the sum of ``skipped``; ``primary`` is
    a kind of its own.  Members: kind, part, ids; a kind of many objects has several parts of bounded size.
    """
    alone = (F.col("object_id") == F.lit(primary)) if primary is not None else F.lit(False)
    told = objects.withColumn("__alone", alone)
    same = [*_MOTION, "__alone"]
    kind = materialised(told.groupBy(*same).agg(F.min("object_id").alias("object_id"), F.count("*").alias("copies"), F.sum("skipped").alias("skipped")))
    at = kind.select(*[F.col(c).alias(f"k_{c}") for c in same], F.col("object_id").alias("kind"), "copies")
    alike = F.lit(True)
    for c in same:
        alike = alike & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    part = F.pmod(F.xxhash64("object_id"), F.ceil(F.col("copies") / _TOGETHER))
    members = told.join(at, alike).groupBy("kind", part.alias("part")).agg(F.collect_list("object_id").alias("ids"))
    return kind.drop("__alone"), materialised(members)


def expanded(rows: DataFrame, members: DataFrame | None, *more: str) -> DataFrame:
    """``rows`` of pairs of kinds (a, b) for every pair of their objects, a the lesser; ``more`` columns tell rows of one pair apart.

    Pairs are generated in the task that holds both arrays: tasks follow the setting, as few rows give many.
    """
    if members is None:
        return rows
    out = rows.withColumnsRenamed({"a": "__ka", "b": "__kb"})
    for n in "ab":
        out = out.join(members.select(F.col("kind").alias(f"__k{n}"), F.col("part").alias(f"__p{n}"), F.col("ids").alias(f"__i{n}")), f"__k{n}")
    out = out.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__ka", "__kb", "__pa", "__pb", *more)
    out = out.withColumn("__x", F.explode("__ia")).withColumn("__y", F.explode("__ib")).where("__ka <> __kb or __x < __y")
    return out.select(*[F.least("__x", "__y").alias(c) if c == "a" else F.greatest("__x", "__y").alias(c) if c == "b" else F.col(c) for c in rows.columns])


def _weighed(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """``rows`` of pairs of kinds with ``pairs``, the number of pairs of objects that each stands for."""
    out = rows
    for n in "ab":
        out = out.join(objects.select(F.col("object_id").alias(n), F.col("copies").alias(f"__{n}")), n)
    return out.withColumn("pairs", F.when(F.col("a") == F.col("b"), F.expr("__a * (__a - 1) div 2")).otherwise(F.col("__a") * F.col("__b"))).drop("__a", "__b")


def states(objects: DataFrame, run: Run) -> DataFrame:
    """(object_id, k, t_ms, x..vz, code): each object at every border of the grid; ``copies`` is passed on."""
    copies = ["copies"] if "copies" in objects.columns else []
    times = run.borders()
    grid = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).cast("long").alias("t_ms")) for k, t in enumerate(times)]) if len(times) <= 64 else _long_grid(run)
    e = objects.select("object_id", "epoch", *copies, *propagation.ELEMENTS, F.explode(grid).alias("g")).select("*", "g.k", "g.t_ms").drop("g")
    e = e.withColumn("minutes", (F.col("t_ms") - F.unix_millis(F.col("epoch").cast("timestamp"))) / 60000.0)
    return propagation.propagate(e).select("object_id", *copies, "k", "t_ms", *_STATE, "code")


def grid_states(tabulated: DataFrame, run: Run) -> DataFrame:
    """States of tabulated objects (object_id, ts, x..vz, code) at the grid's borders, in the form of :func:`states`."""
    spark = tabulated.sparkSession
    grid = spark.createDataFrame(list(enumerate(run.borders())), "k long, t_ms long")
    return tabulated.withColumn("t_ms", F.unix_millis(F.col("ts").cast("timestamp"))).join(F.broadcast(grid), "t_ms").select("object_id", "k", "t_ms", *_STATE, "code")


def _long_grid(run: Run) -> Column:
    t = screening.time_grid(F.lit(run.start_ms).cast("long"), F.lit(run.end_ms).cast("long"), run.step_s)
    return F.transform(t, lambda x, i: F.struct(i.cast("long").alias("k"), x.alias("t_ms")))


def slabs(found: DataFrame) -> DataFrame:
    """(slab, id, start_ms, end_ms, seconds, p0*, v0*, p1*, v1*) of objects with a state at both borders; ``copies`` is passed on."""
    copies = ["copies"] if "copies" in found.columns else []
    w = Window.partitionBy("object_id").orderBy("k")
    good = found.where("code = 'ok'")
    nxt = F.lead(F.struct("k", "t_ms", *_STATE)).over(w)
    both = good.withColumn("n", nxt).where("n.k = k + 1")
    ends = [F.col(f"{v}{a}" if v else a).alias(f"{n}0{a}") for n, v in (("p", ""), ("v", "v")) for a in "xyz"]
    later = [F.col(f"n.{v}{a}").alias(f"{n}1{a}") for n, v in (("p", ""), ("v", "v")) for a in "xyz"]
    return both.select(F.col("k").alias("slab"), F.col("object_id").alias("id"), *copies, F.col("t_ms").alias("start_ms"), F.col("n.t_ms").alias("end_ms"), ((F.col("n.t_ms") - F.col("t_ms")) / 1000.0).alias("seconds"), *ends, *later)


def _refined(candidates: DataFrame, objects: DataFrame, run: Run) -> DataFrame:
    """Candidates (slab, a, b, start_ms, end_ms) refined with SGP4; rows with a null tca_ms are incomplete."""
    e = objects.select("object_id", F.struct(F.col("object_id").alias("id"), F.unix_millis(F.col("epoch").cast("timestamp")).cast("double").alias("epoch_ms"), *propagation.ELEMENTS).alias("e"))
    paired = candidates.join(e.select(F.col("object_id").alias("a"), F.col("e").alias("ea")), "a").join(e.select(F.col("object_id").alias("b"), F.col("e").alias("eb")), "b")
    # a candidate costs dozens of propagations and hardly a byte: tasks follow the setting, not the table's size
    paired = paired.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), "slab", "a", "b")
    asked = paired.select("slab", "start_ms", "end_ms", F.lit(run.start_ms).cast("long").alias("screen_start_ms"), F.lit(run.end_ms).cast("long").alias("screen_end_ms"), (F.col("end_ms") == run.end_ms).alias("last"), F.col("ea").alias("a"), F.col("eb").alias("b"))
    return refinement.refine(asked, refinement.Refinement(radius_km=run.radius_km, tolerance_s=run.tolerance_s), refinement.elements)


def _close(refined: DataFrame, run: Run) -> DataFrame:
    """One row per close approach of two kinds (a, b): tca_ms, miss_km, the bracket, converged, boundary and ``pairs``."""
    found = refined.where("tca_ms is not null").withColumn("pair_key", C.pair_key("a", "b"))
    found = found.withColumn("event_id", F.concat_ws("|", "pair_key", "tca_ms"))
    once = screening.dedup_events(found, run.tolerance_s)
    flags = found.groupBy("event_id").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.max("converged").alias("converged"), F.max("boundary").alias("boundary"), F.max("pairs").alias("pairs"))
    return once.join(flags, "event_id").drop("event_id", "pair_key")


def _events(close: DataFrame, members: DataFrame | None, run: Run) -> DataFrame:
    """One row per close approach of two objects: pair_key, event_id, tca_ms, miss_km, the bracket, converged and boundary."""
    each = expanded(close.drop("pairs"), members, "tca_ms").withColumn("pair_key", C.pair_key("a", "b"))
    return each.withColumn("event_id", I.event_id("a", "b", F.date_format(F.timestamp_millis("tca_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(run.request_id)))


_STOPS = (("memberships", "max_memberships_per_slab", "MAX_CELL_MEMBERSHIPS_PER_SLAB_EXCEEDED"), ("spatial_pair_checks", "max_pair_checks_per_slab", "MAX_SPATIAL_PAIR_CHECKS_PER_SLAB_EXCEEDED"))


def slab_envelopes(load: DataFrame, run: Run) -> DataFrame:
    """``load`` (a row a slab, :func:`screening.slab_load`) up to the first slab over a limit, with ``reason``."""
    reason = F.lit(None).cast("string")
    for column, limit, name in reversed(_STOPS):
        if (most := getattr(run, limit)) is not None:
            reason = F.when(F.col(column) > most, name).otherwise(reason)
    told = load.withColumn("reason", reason)
    stop = told.where("reason is not null").agg(F.min("slab").alias("stop"))  # one row
    return told.crossJoin(F.broadcast(stop)).where("stop is null or slab <= stop").drop("stop")


def _running_stop(rows: DataFrame, most: int | None, slab: str = "slab") -> int | None:
    """The first slab with which the running number of pairs in ``rows`` exceeds ``most``; the window sees one row a slab."""
    if most is None:
        return None
    total = F.sum("count").over(Window.orderBy(slab).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.groupBy(slab).agg(F.sum("pairs").alias("count")).withColumn("total", total).where(F.col("total") > most).agg(F.min(slab)).first()[0]


def broad_phase(sane: DataFrame, run: Run) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(candidates, envelopes, counted) of slab states: what :func:`screening.candidates` finds in the slabs that the limits admit.

    Candidates: slab, a, b, fraction, distance_km, pairs, start_ms, end_ms.  Envelopes: a row a slab up
    to the one that the run stops at, with its load, ``reason`` and ``candidates``.  Counted:
    canonical_pair_checks and aabb_candidates of the admitted slabs.  No states give no rows.
    """
    cfg = run.limits()
    envelopes = materialised(slab_envelopes(screening.slab_load(sane, cfg), run))
    admitted = envelopes.where("reason is null").select("slab")
    seen = Observation()
    bounds = sane.select("slab", "start_ms", "end_ms").distinct()
    some = admitted.limit(1).count() > 0  # an empty plan is never run, and nothing would be observed
    near = screening.candidates(sane.join(admitted, "slab", "left_semi"), cfg, seen if some else None)
    found = materialised(near)
    # alike objects are one box: they meet in its one owner cell and overlap
    alike = sane.join(admitted, "slab", "left_semi").agg(F.coalesce(F.sum(F.expr("copies * (copies - 1) div 2")), F.lit(0))).first()[0] if some else 0
    counted = {k: v + alike for k, v in (dict(seen.get) if some else {"canonical_pair_checks": 0, "aabb_candidates": 0}).items()}
    stop = _running_stop(found, run.max_candidates)
    per = found.groupBy("slab").agg(F.sum("pairs").alias("candidates"))
    told = envelopes.join(per, "slab", "left").fillna(0, ["candidates"])
    if stop is not None:
        told = told.where(F.col("slab") <= stop).withColumn("reason", F.when(F.col("slab") == stop, "MAX_CANDIDATE_INTERVALS_EXCEEDED").otherwise(F.col("reason")))
        found = found.where(F.col("slab") < stop)
    return materialised(found.join(bounds, "slab").select("slab", "a", "b", "fraction", "distance_km", "pairs", "start_ms", "end_ms")), materialised(told), counted


def _finish(objects: DataFrame, found: DataFrame, moving: DataFrame, sane: DataFrame, envelopes: DataFrame | None, counted: dict[str, int], candidates: DataFrame, refined: DataFrame, run: Run, pairs: Column, members: DataFrame | None) -> dict[str, DataFrame]:
    whole = envelopes is not None
    event_stop = _running_stop(refined.where("tca_ms is not null"), run.max_events) if whole else None
    usable = refined if event_stop is None else refined.where(F.col("slab") < event_stop)
    close = materialised(_close(usable, run))
    failed = found.where("code <> 'ok'").select("object_id", "t_ms", "code")
    n_slabs = len(run.borders()) - 1
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    number = lambda c, when=F.lit(True): zero(F.sum(F.when(when, F.col(c))))
    one = lambda df, **c: df.agg(*[v.alias(k) for k, v in c.items()])
    parts = [
        one(objects, catalog_records=zero(F.sum(F.col("skipped") + F.col("copies"))), catalog_objects=number("copies"), duplicate_catalog_objects_skipped=zero(F.sum("skipped"))),
        one(found, object_state_attempts=number("copies"), propagation_failures=number("copies", F.col("code") != "ok")),
        one(moving.groupBy("slab").agg(F.sum("copies").alias("count")), slabs_with_states=zero(F.sum("count")), pair_intervals_with_valid_endpoints=zero(F.sum(F.expr("count * (count - 1) div 2") if whole else F.col("count") - 1))),
        one(candidates, coarse_candidates=number("pairs")),
        one(usable, incomplete_refinements=number("pairs", F.col("tca_ms").isNull()), events_refined=number("pairs", F.col("tca_ms").isNotNull())),
        one(close, events_detected=number("pairs"), not_converged=number("pairs", ~F.col("converged"))),
    ]
    eligible = sane.groupBy("slab").agg(F.sum("copies").alias("n"))
    if whole:
        broken = usable.where("tca_ms is null").groupBy("slab").agg(F.sum("pairs").alias("incomplete"))
        n_objects = objects.agg(number("copies").alias("catalog_objects"))
        told = envelopes.join(broken, "slab", "left").crossJoin(F.broadcast(n_objects))  # one row
        reason = F.coalesce(
            "reason",
            F.when(F.col("slab") == F.lit(event_stop).cast("long"), "MAX_DETECTED_EVENTS_EXCEEDED"),
            F.when(F.col("objects") < F.col("catalog_objects"), "INCOMPLETE_ENDPOINT_COVERAGE"),
            F.when(F.col("incomplete") > 0, "INCOMPLETE_REFINEMENT_COVERAGE"),
        )
        ran = F.col("resource_limit").isNull() | (F.col("resource_limit") == "MAX_DETECTED_EVENTS_EXCEEDED")
        told = told.withColumn("reason", reason).withColumn("resource_limit", F.when(F.col("reason").startswith("MAX_"), F.col("reason")))
        told = told.where((F.col("slab") <= F.lit(event_stop).cast("long")) if event_stop is not None else F.lit(True))
        between = F.expr("objects * (objects - 1) div 2")
        partitions = materialised(told.select(
            F.format_string("%s:slab:%06d", F.lit(run.request_id), "slab").alias("partition_id"), "slab",
            F.lit(run.start_ms).cast("long").alias("screen_start_ms"), F.when(F.col("reason").isNull(), "COMPLETED").otherwise("PARTIAL").alias("status"), "reason", "resource_limit",
            "objects", "memberships", "spatial_cells",
            (F.when(F.col("resource_limit") == _STOPS[1][2], F.lit(run.max_pair_checks_per_slab)).when(F.col("resource_limit") == _STOPS[0][2], 0).otherwise(F.col("spatial_pair_checks"))).cast("long").alias("spatial_pair_checks"),
            F.when(ran, F.col("candidates")).otherwise(0).cast("long").alias("candidates"),
            F.when(ran, between).otherwise(0).cast("long").alias("pair_intervals_screened"),
            (F.expr("catalog_objects * (catalog_objects - 1) div 2") - F.when(ran, between).otherwise(0)).cast("long").alias("pair_intervals_unscreened"),
        ))
        counted_cells = F.coalesce(F.col("resource_limit"), F.lit("")) != _STOPS[0][2]
        parts.append(one(
            partitions, slabs_screened=zero(F.sum("objects")), broad_phase_slabs_completed=F.count_if(F.col("resource_limit").isNull() | (F.col("resource_limit") == "MAX_DETECTED_EVENTS_EXCEEDED")),
            candidate_partitions_completed=F.count_if(F.col("status") == "COMPLETED"), candidate_partitions_partial=F.count_if(F.col("status") == "PARTIAL"),
            spatial_cells=zero(F.sum(F.when(counted_cells, F.col("spatial_cells")))), spatial_cell_memberships=zero(F.sum(F.when(counted_cells, F.col("memberships")))),
            spatial_pair_checks=zero(F.sum("spatial_pair_checks")), candidates_persisted=zero(F.sum("candidates")), pair_intervals_screened=zero(F.sum("pair_intervals_screened")),
            resource_limit_reason=F.max("resource_limit"), endpoints_partial=F.count_if(F.col("reason") == "INCOMPLETE_ENDPOINT_COVERAGE"),
        ))
    else:
        parts.append(one(eligible, slabs_screened=zero(F.sum("n")), pair_intervals_screened=zero(F.sum(pairs)), resource_limit_reason=F.lit(None).cast("string")))
    parts.append(one(eligible, slabs_sane=zero(F.sum("n"))))
    st = parts[0]
    for p in parts[1:]:  # one row each
        st = st.crossJoin(p)
    st = st.withColumns({k: F.lit(v).cast("long") for k, v in counted.items()})
    possible = F.expr("catalog_objects * (catalog_objects - 1) div 2") if whole else F.greatest(F.col("catalog_objects") - 1, F.lit(0).cast("long"))
    st = st.withColumn("catalog_pairs", possible).withColumn("time_slabs", F.lit(n_slabs)).withColumn("pair_intervals_total", possible * n_slabs)
    st = st.withColumn("pair_intervals_unscreened", F.greatest(F.lit(0).cast("long"), F.col("pair_intervals_total") - F.col("pair_intervals_screened")))
    st = st.withColumn("motion_bound_violations", F.col("slabs_with_states") - F.col("slabs_sane")).drop("slabs_sane")
    st = st.withColumn("events_reported", F.least("events_detected", F.lit(run.max_results))).withColumn("events_truncated", F.col("events_detected") - F.col("events_reported"))
    st = st.withColumn("truncated_error_count", F.greatest(F.col("propagation_failures") + F.col("motion_bound_violations") - run.max_errors, F.lit(0)))
    limited = F.col("resource_limit_reason").isNotNull()
    st = st.withColumn("quality_flags", C.flag_set(
        ACCELERATION_BOUND_COARSE_SCREEN=F.lit(True), COLLISION_PROBABILITY_UNAVAILABLE=F.lit(True), TLE_SGP4_SCREENING_ONLY=F.lit(True), FULL_CATALOG_SNAPSHOT_SCREEN=F.lit(whole), PERSISTABLE_CANDIDATE_PARTITIONS=F.lit(whole),
        INCOMPLETE_PROPAGATION_COVERAGE=F.col("propagation_failures") > 0, RESULT_LIMIT_APPLIED=F.col("events_truncated") > 0, REFINEMENT_NOT_CONVERGED=F.col("not_converged") > 0,
        INCOMPLETE_REFINEMENT_COVERAGE=(F.col("incomplete_refinements") > 0) | (F.col("resource_limit_reason") == "MAX_DETECTED_EVENTS_EXCEEDED"), DUPLICATE_CATALOG_OBJECTS_SKIPPED=F.col("duplicate_catalog_objects_skipped") > 0,
        KINEMATIC_BOUND_VIOLATION=F.col("motion_bound_violations") > 0, INCOMPLETE_PAIR_INTERVAL_COVERAGE=F.col("pair_intervals_unscreened") > 0, RESOURCE_LIMIT_APPLIED=limited,
        INCOMPLETE_BROAD_PHASE_COVERAGE=limited & (F.col("resource_limit_reason") != "MAX_DETECTED_EVENTS_EXCEEDED"),
    ))
    partial = (F.col("propagation_failures") > 0) | (F.col("incomplete_refinements") > 0) | (F.col("pair_intervals_unscreened") > 0) | limited
    st = materialised(st.withColumn("status", F.when(partial, "PARTIAL").otherwise("COMPLETED")))
    order = ["tca_ms", "pair_key", "event_id"]
    events = _events(close, members, run)
    out = {"events": events, "reported": events.orderBy(*order).limit(run.max_results), "errors": materialised(_errors(failed, moving, sane, run, members)), "statistics": st}
    return out | ({"partitions": partitions} if whole else {})


# What counts as one place and one motion.
COLOCATED_KM, COLOCATED_KM_S = 0.001, 0.000001


def described(events: DataFrame, objects: DataFrame, run: Run, more: tuple[str, ...] = ()) -> DataFrame:
    """``events`` with both objects' element sets and ages, their states at the closest approach, relative motion and quality flags.

    ``objects`` is one row an object: object_id, element_set_id, epoch, the seven elements and, if
    there, orbit_class, name and quality_flags.  An event whose object isn't there is left out; a
    null epoch has age 0 and a flag; states that can't be computed are null.  ``more`` flags go on all.
    """
    extra = {"orbit_class": F.lit("UNKNOWN"), "name": F.lit(None).cast("string"), "quality_flags": F.array().cast("array<string>")}
    o = objects.withColumns({c: v for c, v in extra.items() if c not in objects.columns})
    fields = ["element_set_id", "epoch", "orbit_class", "name", "quality_flags", *propagation.ELEMENTS]
    out = events
    for side in ("a", "b"):
        out = out.join(o.select(F.col("object_id").alias(side), F.struct(*fields).alias(f"__{side}")), side)
    for side in ("a", "b"):
        s = lambda c: F.col(f"__{side}.{c}")  # noqa: B023, E731
        asked = out.withColumns({c: s(c) for c in (*propagation.ELEMENTS, "epoch")}).withColumn("minutes", (F.col("tca_ms") - F.unix_millis(s("epoch").cast("timestamp"))) / 60000.0)
        found = propagation.propagate(asked)
        out = found.withColumn(f"{side}_state", F.struct(*_STATE)).drop(*propagation.ELEMENTS, "epoch", "minutes", "code", *_STATE)
    difference = lambda names: tuple(F.col(f"b_state.{c}") - F.col(f"a_state.{c}") for c in names)
    position, velocity = difference(_STATE[:3]), difference(_STATE[3:])
    out = out.withColumns({"relative_position_km": F.array(*position), "relative_velocity_km_s": F.array(*velocity), "relative_speed_km_s": G.norm(velocity)})
    at = F.timestamp_millis("tca_ms")
    flags = {"ACCELERATION_BOUND_COARSE_SCREEN": F.lit(True), "COLLISION_PROBABILITY_UNAVAILABLE": F.lit(True), "SAME_TIME_TEME_STATES": F.lit(True), "SUBDIVIDED_LOCAL_MINIMUM_SEARCH": F.lit(True), "TLE_SGP4_SCREENING_ONLY": F.lit(True), "REFINEMENT_NOT_CONVERGED": ~F.col("converged")}
    common = F.lit(True)
    for c in ("epoch", *propagation.ELEMENTS):
        common = common & (F.col(f"__a.{c}") == F.col(f"__b.{c}"))
    near = (F.col("miss_km") <= COLOCATED_KM) & (F.col("relative_speed_km_s") <= COLOCATED_KM_S)
    flags["COLOCATED_OR_COMMON_TLE_GEOMETRY"] = F.coalesce(common, F.lit(False)) | F.coalesce(near, F.lit(False))
    held = []
    for side, name in (("a", "PRIMARY"), ("b", "SECONDARY")):
        fresh = C.freshness(f"__{side}.epoch", f"__{side}.orbit_class", at)
        out = out.withColumns({f"{side}_age_days": F.coalesce(fresh["age_days"], F.lit(0.0)), f"__{side}_status": fresh["status"], f"{side}_element_set_id": F.col(f"__{side}.element_set_id"), f"{side}_name": F.col(f"__{side}.name")})
        status = F.col(f"__{side}_status")
        flags |= {f"{name}_TLE_STALE_AT_TCA": status == "STALE", f"{name}_TLE_EPOCH_AFTER_TCA": status == "FUTURE", f"{name}_TLE_EPOCH_UNAVAILABLE": status == "UNUSABLE"}
        held.append(F.transform(F.coalesce(F.col(f"__{side}.quality_flags"), F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{name}_"), x)))  # noqa: B023
    given = F.array(*[F.lit(x) for x in more]).cast("array<string>")
    out = out.withColumn("quality_flags", F.array_sort(F.array_distinct(F.concat(C.flag_set(**flags), *held, given))))
    return out.drop("__a", "__b", "__a_status", "__b_status")


def _errors(failed: DataFrame, moving: DataFrame, sane: DataFrame, run: Run, members: DataFrame | None) -> DataFrame:
    """The first errors by object, time and code: states that failed, and intervals that break the motion bound."""
    broken = moving.join(sane.select("slab", "id"), ["slab", "id"], "left_anti").select(F.col("id").alias("object_id"), F.col("end_ms").alias("t_ms"), F.lit("KINEMATIC_BOUND_VIOLATION").alias("code"))
    every = failed.unionByName(broken)
    if members is not None:
        every = every.join(members.select(F.col("kind").alias("object_id"), "ids"), "object_id").select(F.explode("ids").alias("object_id"), "t_ms", "code")
    return every.orderBy("object_id", "t_ms", "code").limit(run.max_errors)


def screen_catalog(catalog: DataFrame, run: Run) -> dict[str, DataFrame]:
    """events (all), reported (the first by time), errors (the first), partitions (a row a slab) and statistics (one row) of every pair of a catalog.

    ``catalog``: object_id (text), element_set_id, epoch and the seven elements.  Fewer than two
    objects give no events; null elements and failed propagations are errors and make the run PARTIAL.
    """
    objects = materialised(unique_objects(catalog))
    kind, members = kinds(objects)
    found = materialised(states(kind, run))
    out = screen_states(kind, found, run, lambda candidates: _refined(candidates, kind, run), members)
    discard(objects, found)
    return out


def screen_states(objects: DataFrame, found: DataFrame, run: Run, refined: Callable[[DataFrame], DataFrame], members: DataFrame | None = None) -> dict[str, DataFrame]:
    """:func:`screen_catalog` from states at the grid's borders (``found``, as :func:`states` gives it) and any motion between them.

    ``objects`` has a row an object with ``skipped``; ``refined`` takes candidates (slab, a, b,
    start_ms, end_ms) to what :func:`refinement.refine` gives, with ``slab`` passed on.  With
    ``members`` objects and states are those of :func:`kinds`, and the rows returned those of their objects.
    """
    if "copies" not in objects.columns:
        objects, found = (t.withColumn("copies", F.lit(1).cast("long")) for t in (objects, found))
    moving = slabs(found)
    sane = materialised(screening.sane(moving, run.max_acceleration_km_s2 / 2))
    candidates, envelopes, counted = broad_phase(sane, run)
    close = materialised(_weighed(refined(candidates), objects))
    out = _finish(objects, found, moving, sane, envelopes, counted, candidates, close, run, F.expr("n * (n - 1) div 2"), members)
    discard(sane, close, envelopes)
    return out | {"candidates": expanded(candidates.drop("pairs"), members, "slab")}


def against_primary(sane: DataFrame, primary: str, cfg: screening.Screening) -> DataFrame:
    """(slab, a, b, fraction, distance_km): every interval of one object with each other one, without cells.

    The primary has one row a slab, which meets all others in an equi-join on the slab; objects
    never pair with themselves.
    """
    side = lambda rows, n: rows.select("slab", "seconds", F.struct("id", *[f"{p}{a}" for p in ("p0", "p1") for a in "xyz"]).alias(n))
    one, rest = sane.where(F.col("id") == F.lit(primary)), sane.where(F.col("id") != F.lit(primary))
    met = side(rest, "b").join(side(one, "a").drop("seconds"), "slab")
    near = screening.chord(met).where(F.col("distance_km") <= cfg.threshold_km(F.col("seconds")))
    return near.select("slab", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "seconds", "fraction", "distance_km")


def screen_object(catalog: DataFrame, primary: str, run: Run) -> dict[str, DataFrame]:
    """The same for the pairs of one object; statistics count its pairs alone."""
    cfg = run.limits()
    objects = materialised(unique_objects(catalog))
    kind, members = kinds(objects, primary)
    found = materialised(states(kind, run))
    moving = slabs(found)
    sane = materialised(screening.sane(moving, run.max_acceleration_km_s2 / 2))
    bounds = sane.select("slab", "start_ms", "end_ms").distinct()
    near = against_primary(sane, primary, cfg).join(bounds, "slab").select("slab", "a", "b", "start_ms", "end_ms")
    candidates = materialised(_weighed(near, kind))
    refined = materialised(_weighed(_refined(candidates, kind, run), kind))
    out = _finish(kind, found, moving, sane, None, {}, candidates, refined, run, F.col("n") - 1, members)
    discard(objects, found, sane, refined)
    return out
