"""Catalog merges: upserts, preferred element sets, enrichment, lifecycles, validation and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions import catalog as C
from perigee.functions import constants as K


def preferred(rows: DataFrame, key: str, epoch: str, *ties: str) -> DataFrame:
    """The newest row of each key, null epochs last, ties to the least of the joined fields."""
    tie = F.concat_ws("\n", *[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in ties])
    best = F.struct(F.col(epoch).isNull().alias("n"), (-F.unix_micros(F.col(epoch).cast("timestamp"))).alias("e"), tie.alias("t"))
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), best).alias("r"), (F.count("*") - 1).alias("skipped")).select("r.*", "skipped")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, epoch: str, order: str, mode: str = "incremental", tags: tuple[str, ...] = ()) -> DataFrame:
    """Existing and incoming rows as one per key, with ``outcome`` added, updated or retained.

    Mode ``all`` keeps what came first.  Mode ``incremental`` takes the newest epoch, where a row
    without one never replaces and is always replaced; of equal epochs the first stays.
    ``tags`` of the first row that has them are carried over.  Aggregates only: no key's rows
    are gathered.
    """
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    arrival = F.struct("__new", order)
    newest = F.struct(F.col(epoch).isNull(), -F.unix_micros(F.col(epoch).cast("timestamp")), F.col("__new"), F.col(order))
    columns = [c for c in both.columns if c != "__new"]
    first = F.min_by(F.struct(*columns, "__new"), arrival)
    chosen = first if mode == "all" else F.min_by(F.struct(*columns, "__new"), newest)
    kept = [F.min_by(t, F.struct(F.col(t).isNull() | (F.col(t) == K.NO_DATA), "__new", order)).alias(f"__tag_{t}") for t in tags]
    out = both.groupBy(key).agg(chosen.alias("r"), first.alias("f"), *kept)
    outcome = F.when(F.col("f.__new") == 1, "added").when(F.col("r.__new") == 1, "updated").otherwise("retained")
    return out.select(*[F.col(f"__tag_{c}").alias(c) if c in tags else F.col(f"r.{c}").alias(c) for c in columns], outcome.alias("outcome"))


def outcome_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "updated", "retained")], F.count("*").alias("total"))


def enrich(records: DataFrame, catalog: DataFrame, record_id: str, keys: dict[str, str]) -> DataFrame:
    """Records with the catalog row that any of their keys names, as a struct ``match``, and an ``error``.

    ``keys`` maps a record's key column to the catalog's.  Alternative keys are exploded into
    one equi-join, never an OR: a key that two catalog rows share, and keys that name two
    different rows, are errors.
    """
    cat = catalog.withColumn("__row", F.struct(*catalog.columns))
    named = None
    for i, c in enumerate(keys.values()):
        part = cat.where(F.col(c).isNotNull()).select(F.lit(i).alias("kind"), F.col(c).cast("string").alias("value"), "__row")
        named = part if named is None else named.unionByName(part)
    index = named.groupBy("kind", "value").agg(F.min("__row").alias("__row"), F.count("*").alias("dup"))
    parts = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).cast("string").alias("value")) for i, c in enumerate(keys)])
    asked = records.select(record_id, F.explode(parts).alias("k")).select(record_id, "k.*").where("value is not null")
    hit = asked.join(index, ["kind", "value"]).groupBy(record_id).agg(F.min("__row").alias("match"), F.max("__row").alias("__other"), F.max("dup").alias("dup"))
    error = F.when(F.col("dup") > 1, "DUPLICATE_KEY").when(F.col("match") != F.col("__other"), "CONFLICTING_KEYS")
    return records.join(hit.select(record_id, F.when(error.isNull(), F.col("match")).alias("match"), error.alias("error")), record_id, "left")


def reconcile(previous: DataFrame, current: DataFrame, key: str, fingerprint: str, lifecycle: str, present: str) -> DataFrame:
    """(key, transition) of a full outer join of two revisions.

    Decayed and retired states override; an object that a previous revision had lost reappears.
    """
    p = previous.select(F.col(key), F.col(fingerprint).alias("__pf"), F.col(present).alias("__pp"), F.lit(True).alias("__p"))
    c = current.select(F.col(key), F.col(fingerprint).alias("__cf"), F.col(lifecycle).alias("__life"), F.lit(True).alias("__c"))
    state = (
        F.when(F.col("__c").isNull(), "ABSENT")
        .when(F.col("__life").isin("DECAYED", "RETIRED"), F.col("__life"))
        .when(F.col("__p").isNull(), "NEW")
        .when(~F.coalesce(F.col("__pp"), F.lit(False)), "REAPPEARED")
        .when(F.col("__pf").eqNullSafe(F.col("__cf")), "UNCHANGED")
        .otherwise("UPDATED")
    )
    return p.join(c, key, "full_outer").select(key, state.alias("transition"))


def transition_counts(observations: DataFrame) -> DataFrame:
    return observations.agg(*[F.count_if(F.col("transition") == t).alias(t.lower()) for t in K.TRANSITIONS])


# The columns (from 0) of line 1 that are blank.
_LINE1_BLANKS = (8, 17, 32, 43, 52, 61, 63)


def line_issues(line1: str = "tle_line1", line2: str = "tle_line2") -> Column:
    """Codes of all strict rules that a two-line set breaks, as a sorted array."""
    one, two = F.col(line1), F.col(line2)
    cut = lambda c, a, b: F.substring(c, a + 1, b - a)
    number = lambda a, b: F.trim(cut(two, a, b)).try_cast("double")
    off = lambda value, lo, hi, closed=True: value.isNull() | (value < lo) | ((value > hi) if closed else (value >= hi))
    rules = {
        "TLE_LINE1_LENGTH_INVALID": F.length(one) != 69,
        "TLE_LINE2_LENGTH_INVALID": F.length(two) != 69,
        "TLE_LINE1_NUMBER_INVALID": ~one.startswith("1"),
        "TLE_LINE2_NUMBER_INVALID": ~two.startswith("2"),
        "TLE_LINE1_CHECKSUM_INVALID": C.tle_checksum(one) != F.substring(one, 69, 1).try_cast("int"),
        "TLE_LINE2_CHECKSUM_INVALID": C.tle_checksum(two) != F.substring(two, 69, 1).try_cast("int"),
        "TLE_LINE1_SEPARATOR_INVALID": F.concat(*[cut(one, i, i + 1) for i in _LINE1_BLANKS]) != " " * len(_LINE1_BLANKS),
        "TLE_MEAN_MOTION_FIRST_DERIVATIVE_INVALID": ~cut(one, 33, 43).rlike(r"^[ +\-]\.\d{8}$"),
        "TLE_MEAN_MOTION_SECOND_DERIVATIVE_INVALID": C.exponent_field(cut(one, 44, 52)).isNull(),
        "TLE_BSTAR_INVALID": C.exponent_field(cut(one, 53, 61)).isNull(),
        "TLE_EPHEMERIS_TYPE_INVALID": ~cut(one, 62, 63).rlike(r"^\d$"),
        "TLE_EPHEMERIS_TYPE_UNSUPPORTED": cut(one, 62, 63).rlike(r"^[1-9]$"),
        "TLE_ELEMENT_SET_NUMBER_INVALID": ~cut(one, 64, 68).rlike(r"^ *\d+$"),
        "TLE_CATALOG_ID_INVALID": C.norad_id(cut(one, 2, 7)).isNull() | C.norad_id(cut(two, 2, 7)).isNull(),
        "TLE_CATALOG_ID_MISMATCH": C.norad_id(cut(one, 2, 7)) != C.norad_id(cut(two, 2, 7)),
        "TLE_EPOCH_INVALID": C.strict_epoch(cut(one, 18, 32)).isNull(),
        "TLE_INCLINATION_INVALID": off(number(8, 16), 0, 180),
        "TLE_RAAN_INVALID": off(number(17, 25), 0, 360, False),
        "TLE_ECCENTRICITY_INVALID": ~cut(two, 26, 33).rlike(r"^\d{7}$"),
        "TLE_ARGUMENT_OF_PERIGEE_INVALID": off(number(34, 42), 0, 360, False),
        "TLE_MEAN_ANOMALY_INVALID": off(number(43, 51), 0, 360, False),
        "TLE_MEAN_MOTION_INVALID": off(number(52, 63), 1e-9, 20),
    }
    return C.flag_set(**{k: F.coalesce(v, F.lit(True)) for k, v in rules.items()})


def legacy_records(sets: DataFrame, launches: DataFrame | None = None) -> DataFrame:
    """Element sets (company, name, line1, line2) as flat records of the older form, with launch dates (norad_id, launch_date) looked up.

    Texts that are missing say so (:data:`K.NO_DATA`), metrics that can't be read are null; of
    several dates of a number the latest counts; rows that repeat are written each.
    """
    told = lambda c: F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0, F.trim(F.col(c))).otherwise(K.NO_DATA)
    out = sets.withColumns({"norad_id": C.tle_norad("line1"), **C.orbit_metrics("line2")})
    if launches is not None:
        dates = launches.where("norad_id is not null and launch_date is not null").groupBy("norad_id").agg(F.max("launch_date").alias("__date"))
        out = out.join(dates, "norad_id", "left")
    else:
        out = out.withColumn("__date", F.lit(None).cast("string"))
    kind = C.orbit_class_ingest(F.col("mean_motion_rev_per_day"), F.col("eccentricity"), F.col("perigee_km"), F.col("apogee_km"))
    metrics = ["inclination_deg", "eccentricity", "mean_motion_rev_per_day", "period_min", "semi_major_axis_km", "perigee_km", "apogee_km", "estimated_altitude_km"]
    return out.select(
        told("company").alias("company"), told("name").alias("satellite_name"), "norad_id", F.coalesce("__date", F.lit(K.NO_DATA)).alias("launch_date"), kind.alias("type"), kind.alias("orbit_class"),
        *metrics, told("line1").alias("tle_line1"), told("line2").alias("tle_line2"),
    )


def quarantine(records: DataFrame, key: str, issues: Column) -> DataFrame:
    """``records`` with sorted reason codes and ``accepted``; every row of a repeated identity is refused.

    Counts per key are joined back, so a key with very many rows doesn't meet in one task.
    """
    many = records.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1")
    marked = records.join(many, key, "left")
    codes = F.array_sort(F.array_distinct(F.concat(issues, F.array_compact(F.array(F.when(F.col("__n") > 1, F.lit("DUPLICATE_OBJECT_ID")))))))
    return marked.withColumn("reasons", codes).withColumn("accepted", F.size("reasons") == 0).drop("__n")


def quality_summary(rows: DataFrame, by: list[str], age: str) -> DataFrame:
    """Counts of each value of each column in ``by``, and least, median and greatest age, in one pass of grouping sets."""
    one = rows.select(age, F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in by])).alias("x"))
    counts = one.groupBy(F.col("x.k").alias("dimension"), F.col("x.v").alias("value")).agg(F.count("*").alias("n"))
    ages = rows.agg(F.min(age).alias("min_age"), F.median(age).alias("median_age"), F.max(age).alias("max_age"))
    return counts.crossJoin(F.broadcast(ages))


def current(history: DataFrame, key: str, *latest: str) -> DataFrame:
    """The last row of each key of an append-only history."""
    return history.groupBy(key).agg(F.max_by(F.struct(*history.columns), F.struct(*latest)).alias("r")).select("r.*")


def keyset_page(rows: DataFrame, order: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:
    """Up to ``limit`` rows after a cursor, in an order of (column, descending); 1 to 200 rows.

    The predicate is the lexicographic comparison spelled out, so it reaches the scan.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie between 1 and 200")
    if after is not None:
        clause, equal = F.lit(False), F.lit(True)
        for (name, desc), value in zip(order, after, strict=True):
            c = F.col(name)
            clause = clause | (equal & ((c < F.lit(value)) if desc else (c > F.lit(value))))
            equal = equal & (c == F.lit(value))
        rows = rows.where(clause)
    return rows.orderBy(*[F.col(n).desc() if d else F.col(n).asc() for n, d in order]).limit(limit)


def transition_audit(log: DataFrame, key: str, order: str, state: str, legal: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each step of an event log with the state before it and whether the table of transitions allows it."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(order))
    ok = F.col("previous").isNull()
    for a, b in legal.items():
        ok = ok | ((F.col("previous") == a) & F.col(state).isin(*b))
    return log.withColumn("previous", before).withColumn("legal", ok)
