"""The revisioned store as tables: observations, jobs, events, their filters, listings and rules.

Every state is an append-only table; what is current is a query over it.  Filters are plain
predicates, so they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions import catalog as C
from perigee.functions import constants as K
from perigee.operators.rounds import materialised

# Observation states of an object in a revision.
OBSERVATIONS = ("NEW", "REAPPEARED", "CHANGED", "OBSERVED", "ABSENT")


def observations(records: DataFrame, previous: DataFrame, complete: bool) -> DataFrame:
    """(object_id, norad_id, name, object_type, lifecycle_status, observation_status, element_set_id) of a revision.

    ``records`` (norad_id, name, object_type, lifecycle_status, line1, line2); those without a
    number or a line are left out.  ``previous`` (object_id, norad_id, name, object_type,
    lifecycle_status, observation_status, element_set_id) is the current state.  Objects that a
    complete source no longer has are ABSENT; of an incomplete one nothing is said.
    """
    norad = F.upper(F.trim(F.col("norad_id").cast("string")))
    lines = [F.trim(F.coalesce(c, F.lit(""))) for c in ("line1", "line2")]
    usable = (F.length(F.coalesce(norad, F.lit(""))) > 0) & (F.length(lines[0]) > 0) & (F.length(lines[1]) > 0)
    life = F.upper(F.trim(F.coalesce("lifecycle_status", F.lit("UNKNOWN"))))
    now = records.where(usable).select(
        F.concat(F.lit(K.NORAD_SCHEME), norad).alias("object_id"),
        norad.alias("norad_id"),
        F.coalesce("name", F.concat(F.lit("NORAD "), norad)).alias("name"),
        C.object_type("object_type").alias("object_type"),
        F.when(life.isin(*K.LIFECYCLES), life).otherwise("UNKNOWN").alias("lifecycle_status"),
        F.concat(F.lit("elset:sha256:"), F.substring(F.sha2(F.concat_ws("\n", *lines), 256), 1, 32)).alias("element_set_id"),
    )
    before = previous.select("object_id", F.struct("norad_id", "name", "object_type", "lifecycle_status", "observation_status", "element_set_id").alias("p"))
    both = now.select("object_id", F.struct("norad_id", "name", "object_type", "lifecycle_status", "element_set_id").alias("n")).join(before, "object_id", "full_outer" if complete else "left")
    same = F.lit(True)
    for c, other in (("name", ""), ("object_type", "UNKNOWN"), ("lifecycle_status", "UNKNOWN"), ("element_set_id", "")):
        same = same & (F.coalesce(f"p.{c}", F.lit(other)) == F.col(f"n.{c}"))
    status = F.when(F.col("n").isNull(), "ABSENT").when(F.col("p").isNull(), "NEW").when(F.upper(F.coalesce("p.observation_status", F.lit(""))) == "ABSENT", "REAPPEARED").when(same, "OBSERVED").otherwise("CHANGED")
    pick = lambda c, other=None: F.when(F.col("n").isNull(), F.coalesce(f"p.{c}", other) if other is not None else F.col(f"p.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select("object_id", pick("norad_id"), pick("name", F.col("object_id")), pick("object_type", F.lit("UNKNOWN")), pick("lifecycle_status", F.lit("UNKNOWN")), status.alias("observation_status"), F.col("n.element_set_id").alias("element_set_id"))


def current_objects(objects: DataFrame, seen: DataFrame, lifecycle: str | None = None) -> DataFrame:
    """Objects with their current observation (``is_current``), of one lifecycle state if asked for."""
    now = seen.where("is_current")
    return objects.join(now if lifecycle is None else now.where(F.col("lifecycle_status") == lifecycle), "object_id")


def current_events(events: DataFrame, pointers: DataFrame) -> DataFrame:
    """The revisions that the current pointers name."""
    return events.join(pointers.select("event_revision_id"), "event_revision_id", "left_semi")


def promote(pointers: DataFrame, revisions: DataFrame, key: str, order: str) -> DataFrame:
    """``revisions`` with ``is_current``: the one that the newest pointer of its key names, others demoted."""
    newest = pointers.groupBy(key).agg(F.max_by("revision", order).alias("__r"))
    return revisions.join(newest, key, "left").withColumn("is_current", F.coalesce(F.col("revision") == F.col("__r"), F.lit(False))).drop("__r")


# filters ----------------------------------------------------------------------


def _all(rows: DataFrame, *clauses: Column | None) -> DataFrame:
    for c in clauses:
        rows = rows if c is None else rows.where(c)
    return rows


def _is(name: str, value) -> Column | None:
    return None if value is None else F.col(name) == value


def events_where(events: DataFrame, job=None, obj=None, pair=None, tca_from=None, tca_to=None, least_km=None, most_km=None) -> DataFrame:
    """Events of a job, of an object on either side, of a pair, in a range of times (ends included) and of misses."""
    either = None if obj is None else (F.col("object_a_id") == obj) | (F.col("object_b_id") == obj)
    since, until = None if tca_from is None else F.col("tca_utc") >= tca_from, None if tca_to is None else F.col("tca_utc") <= tca_to
    near, far = None if least_km is None else F.col("miss_distance_km") >= least_km, None if most_km is None else F.col("miss_distance_km") <= most_km
    return _all(events, _is("job_id", job), either, _is("pair_key", pair), since, until, near, far)


def jobs_where(jobs: DataFrame, owner=None, states: tuple | None = None, revision=None) -> DataFrame:
    return _all(jobs, _is("owner_id", owner), None if states is None else F.col("state").isin(*states), _is("catalog_revision_id", revision))


def revisions_where(revisions: DataFrame, source=None, status=None, current_only: bool = False) -> DataFrame:
    return _all(revisions, _is("source_id", source), _is("source_status", status), F.col("is_current") if current_only else None)


def catalog_scope(records: DataFrame, object_ids: DataFrame | None = None, types: tuple = K.OBJECT_TYPES, lifecycles: tuple = ("ACTIVE", "INACTIVE", "UNKNOWN")) -> tuple[DataFrame, DataFrame]:
    """Records in a scope, and its one row (n, code): why the scope can't be screened, or null.

    ``object_ids`` is a table (object_id), met in a semi-join.  A scope needs two objects and
    the TEME frame in every one.
    """
    chosen = _all(records, F.col("object_type").isin(*types), F.col("lifecycle_status").isin(*lifecycles))
    if object_ids is not None:
        chosen = chosen.join(object_ids.select("object_id").distinct(), "object_id", "left_semi")
    other = F.count_if(F.upper(F.coalesce("native_frame", F.lit(""))) != "TEME")
    code = F.when(F.count("*") < 2, "CATALOG_SCOPE_INSUFFICIENT").when(other > 0, "CATALOG_FRAME_UNSUPPORTED")
    return chosen, chosen.agg(F.count("*").alias("n"), code.alias("code"))


def reentries_of(events: DataFrame, mode: str = "ALL") -> DataFrame:
    return events if mode == "ALL" else events.where(F.col("type") == mode)


def events_with_text(events: DataFrame, text: str, label: str, ident: str) -> DataFrame:
    """Events whose label or id contains the text, whatever its case; a blank one passes all."""
    q = text.strip().lower()
    return events.where(F.contains(F.lower(label), F.lit(q)) | F.contains(F.lower(ident), F.lit(q))) if q else events


# Orders of the event panel; missing values come last.
PANEL_ORDERS = {"tca": ("tca_ms", False), "miss-distance": ("miss_km", False), "relative-speed": ("speed_km_s", True), "object": ("label", False)}


def panel(events: DataFrame, mode: str, position: str) -> DataFrame:
    """Events in a panel's order; an unknown order is that of time, and ties keep their position."""
    name, down = PANEL_ORDERS.get(mode, PANEL_ORDERS["tca"])
    return events.orderBy(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last(), position)


def panel_places(events: DataFrame, mode: str, position: str) -> DataFrame:
    """All events with their ``place`` in the panel's order, from 1.

    Ranges of the order are numbered each on its own and moved on by the sizes of those before,
    so no task has more than a range.
    """
    name, down = PANEL_ORDERS.get(mode, PANEL_ORDERS["tca"])
    order = [F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last(), F.col(position)]
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialised(events.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    sizes = ranges.groupBy("__range").count()  # a row a range
    before = sizes.select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn("place", F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")


def lookup(satellites: DataFrame, norad: str | None, name: str | None, position: str) -> DataFrame:
    """The satellite of the number, else of the name, else the first one marked as selected; one row or none."""
    rank = F.when(F.col("norad_id").cast("string") == F.lit(norad), 1) if norad else F.when(F.lit(False), 1)
    rank = rank.when(F.col("name") == F.lit(name), 2) if name and name != "None" else rank
    rank = rank.when(F.col("is_selected"), 3)
    return satellites.withColumn("__rank", rank).where("__rank is not null").orderBy("__rank", position).limit(1).drop("__rank")


# listings and counts ------------------------------------------------------------


def queue_head(jobs: DataFrame) -> DataFrame:
    """The oldest queued job."""
    return jobs.where("state = 'QUEUED'").orderBy("created_at", "job_id").limit(1)


def progress_after(progress: DataFrame, job, sequence: int, limit: int = 100) -> DataFrame:
    return progress.where((F.col("job_id") == job) & (F.col("sequence") > sequence)).orderBy("sequence").limit(limit)


def of_job(rows: DataFrame, job, *order: str) -> DataFrame:
    """All candidates, errors or attempts of a job in their listing's order."""
    return rows.where(F.col("job_id") == job).orderBy(*order)


def capped(rows: DataFrame, order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows, and one row (total, kept, truncated, limit_applied)."""
    total = rows.agg(F.count("*").alias("total"))
    kept = F.least(F.col("total"), F.lit(limit))
    return rows.orderBy(*order).limit(limit), total.select("total", kept.alias("kept"), (F.col("total") - kept).alias("truncated"), (F.col("total") > limit).alias("limit_applied"))


def jobs_by_state(jobs: DataFrame, /, **tables: DataFrame) -> DataFrame:
    """(kind, name, n): jobs by state, and rows of tables."""
    out = jobs.groupBy(F.lit("state").alias("kind"), F.col("state").alias("name")).agg(F.count("*").alias("n"))
    for name, t in tables.items():
        out = out.unionByName(t.agg(F.count("*").alias("n")).select(F.lit("table").alias("kind"), F.lit(name).alias("name"), "n"))
    return out


def newest_decays(decays: DataFrame, key: str, date: str, position: str) -> DataFrame:
    """Of each object the newest decay; of equal dates the first that came."""
    best = F.struct(F.col(date).alias("d"), (-F.col(position)).alias("p"))
    return decays.where(F.col(date).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*decays.columns), best).alias("r")).select("r.*")


def confirmed_decays(satellites: DataFrame, newest: DataFrame, key: str) -> DataFrame:
    """Satellites with their confirmed decay, which overrides a predicted one."""
    c = newest.select(key, F.col("decay_date").alias("__date"))
    out = satellites.join(c, key, "left")
    there = F.col("__date").isNotNull()
    return out.withColumn("decay_status", F.when(there, "CONFIRMED").otherwise(F.col("decay_status"))).withColumn("decay_date", F.coalesce("__date", "decay_date")).drop("__date")


def launch_ranges(rows: DataFrame, time: str, context_ms: float = 45.0 * K.MS_DAY) -> DataFrame:
    """Detail and overview range (ms) around the last launch; the overview has at least a year and a half."""
    year = 365.25 * K.MS_DAY
    e = rows.agg(F.min(time).cast("double").alias("a"), F.max(time).cast("double").alias("z"))
    pad = F.greatest(F.lit(year), (F.col("z") - F.col("a")) * 0.05)
    short = F.col("z") - F.col("a") + 2 * pad < 1.5 * year
    start, end = F.when(short, F.col("z") - 0.75 * year).otherwise(F.col("a") - pad), F.when(short, F.col("z") + 0.75 * year).otherwise(F.col("z") + pad)
    return e.where("z is not null").select((F.col("z") - context_ms).alias("detail_start"), (F.col("z") + context_ms).alias("detail_end"), start.alias("overview_start"), end.alias("overview_end"))


def reentry_detail(event: DataFrame, context_ms: float = 120.0 * K.MS_DAY) -> DataFrame:
    """Detail range of events (start, end, type): around the middle of a predicted one, the start of others."""
    at = F.when(F.col("type") == "PREDICTED", (F.col("start") + F.col("end")) / 2).otherwise(F.col("start").cast("double"))
    return event.withColumn("detail_start", at - context_ms).withColumn("detail_end", at + context_ms)


def deletable(jobs: DataFrame, events: DataFrame, outbox: DataFrame, before: Column, discard_outbox: bool = False) -> DataFrame:
    """``jobs`` with why each can't be deleted yet, or null."""
    owned = events.groupBy("job_id").agg(F.count("*").alias("__e"))
    waiting = outbox.groupBy("job_id").agg(F.count("*").alias("__o"))
    out = jobs.join(owned, "job_id", "left").join(waiting, "job_id", "left")
    reason = F.when(~F.col("state").isin(*K.TERMINAL_STATES) | F.col("completed_at").isNull(), "NOT_COMPLETED").when(F.col("completed_at") >= before, "TOO_NEW").when(F.col("__e") > 0, "OWNS_EVENTS")
    if not discard_outbox:
        reason = reason.when(F.col("__o") > 0, "OUTBOX_PENDING")
    return out.withColumn("refused", reason).drop("__e", "__o")


def track_extent(track: DataFrame, key: str, lat: str, lon: str, least: float = 0.01) -> DataFrame:
    """Extent of each track in degrees, and whether it is a point (a geostationary object's)."""
    e = track.groupBy(key).agg((F.max(lat) - F.min(lat)).alias("lat_extent"), (F.max(lon) - F.min(lon)).alias("lon_extent"))
    return e.withColumn("stationary", (F.col("lat_extent") < least) & (F.col("lon_extent") < least))


# rules ------------------------------------------------------------------------


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs with ``new_state`` and ``attempt_state`` after a crash; jobs that weren't active have neither."""
    running, asked = F.col("state") == "RUNNING", F.col("state") == "CANCEL_REQUESTED"
    new = F.when(asked, "CANCELLED").when(running & (F.col("attempt_count") < F.col("max_attempts")), "QUEUED").when(running, "FAILED")
    attempt = F.when(F.col("attempt_count") > 0, F.when(asked, "CANCELLED").when(running, "INTERRUPTED"))
    return jobs.withColumn("new_state", new).withColumn("attempt_state", attempt)


def created(requests: DataFrame, position: str) -> DataFrame:
    """Requests with ``outcome``: created, the first of its (owner_id, idempotency_key); existing, with the same hash; else conflict.

    The first hash of a key is an aggregate joined back; no key's requests are gathered.
    """
    first = requests.groupBy("owner_id", "idempotency_key").agg(F.min_by("request_hash", position).alias("__h"), F.min(position).alias("__p"))
    outcome = F.when(F.col(position) == F.col("__p"), "created").when(F.col("request_hash").eqNullSafe(F.col("__h")), "existing").otherwise("conflict")
    return requests.join(first, ["owner_id", "idempotency_key"]).withColumn("outcome", outcome).drop("__h", "__p")


def supersession_order(events: DataFrame, ident: str = "event_revision_id", parent: str = "supersedes") -> DataFrame:
    """``events`` with ``issue`` and the fields ``sort_id``, ``depth`` whose order is that of import.

    Revisions come after what they supersede, and otherwise by id: an event's place is that of the
    greatest id on the way to it, then its depth, so sorting by both merges all chains.
    A revision superseded twice is BRANCH, one on a circle CYCLE.  Ways are doubled in each round,
    so a chain of n revisions takes log n joins; a parent outside the table counts as none.
    """
    ids = events.select(F.col(ident).alias("id"), F.col(parent).alias("up"))
    known = materialised(ids.join(ids.select(F.col("id").alias("up")).distinct(), "up", "left_semi").select("id", F.col("up").alias("at")).distinct())
    many = known.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select(F.col("at").alias("id"), F.lit(True).alias("branch"))
    depth = F.when(F.col("at").isNotNull(), 1).otherwise(0).cast("long")
    way = materialised(ids.select("id").distinct().join(known, "id", "left").select("id", "at", F.col("id").alias("most"), depth.alias("depth")))
    total, rounds = way.count(), 0
    while 2**rounds <= total and not way.where("at is not null").isEmpty():
        ahead = way.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("most").alias("m"), F.col("depth").alias("d"))
        # rows at their root have no key to join by, and together they would go to one task
        done, rest = way.where("at is null"), way.where("at is not null")
        step = rest.join(ahead, "at", "left").select("id", F.col("next").alias("at"), F.greatest("most", F.coalesce("m", "most")).alias("most"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")).unionByName(done)
        way, rounds = materialised(step), rounds + 1
    named = way.select(F.col("id").alias(ident), F.col("at").isNotNull().alias("__cycle"), F.col("most").alias("sort_id"), "depth")
    out = events.join(named, ident).join(many.withColumnRenamed("id", ident), ident, "left")
    return out.withColumn("issue", F.when(F.col("branch"), "BRANCH").when(F.col("__cycle"), "CYCLE")).drop("branch", "__cycle")


def event_issues(events: DataFrame) -> Column:
    """Codes of the rules that event rows break: ids, pair order, times and numbers."""
    number = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) == float("inf"))
    return C.flag_set(
        EVENT_ID_MISSING=F.length(F.trim(F.coalesce("event_id", F.lit("")))) == 0,
        PAIR_NOT_DISTINCT=F.coalesce(F.col("object_a_id") == F.col("object_b_id"), F.lit(True)),
        PAIR_KEY_INVALID=~F.coalesce(F.col("pair_key") == C.pair_key("object_a_id", "object_b_id"), F.lit(False)),
        TCA_MISSING=F.col("tca_utc").isNull(),
        MISS_DISTANCE_INVALID=number("miss_distance_km"),
        RELATIVE_SPEED_INVALID=number("relative_speed_km_s"),
    )


def last_write_wins(launches: DataFrame, position: str) -> DataFrame:
    """(norad_id, name, launch_date): what is left when each row in turn takes its number and its name from earlier rows.

    A row stays if no later row has its number or its name.
    """
    by_id = launches.groupBy("norad_id").agg(F.max(position).alias("__i"))
    by_name = launches.groupBy("name").agg(F.max(position).alias("__n"))
    out = launches.join(by_id, "norad_id").join(by_name, "name")
    return out.where((F.col(position) == F.col("__i")) & (F.col(position) == F.col("__n"))).drop("__i", "__n")


def element_sets(rows: DataFrame, by: str, ident: str) -> DataFrame:
    """Sorted distinct element sets of each run, for its provenance."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(ident)).alias("element_sets"))


def ratios(checks: Column, intervals: Column) -> dict[str, Column]:
    """Checks an interval, and the share of intervals that needed none."""
    return {"checks_per_interval": F.try_divide(checks.cast("double"), intervals), "reduction": 1 - F.try_divide(checks.cast("double"), intervals)}
