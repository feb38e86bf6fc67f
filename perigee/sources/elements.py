"""Element sets and ephemerides from text files: TLE blocks, CCSDS OMM and OEM in key-value notation, SATCAT and Horizons tables.

Files are rows (path, text); Spark lists, reads and deals them.  Malformed files are rows with an
``issue`` and without values, never exceptions, so that one of them does not stop a job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigee.functions import catalog as C
from perigee.operators.rounds import settled

OMM_NUMBERS = ("MEAN_MOTION", "ECCENTRICITY", "INCLINATION", "RA_OF_ASC_NODE", "ARG_OF_PERICENTER", "MEAN_ANOMALY", "BSTAR", "MEAN_MOTION_DOT", "MEAN_MOTION_DDOT")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def tle_blocks(texts: DataFrame) -> DataFrame:
    """(path, block, name, line1, line2): three-line blocks; what doesn't pair moves the window on by one line.

    Whether a line begins a block depends on all before it, so a task walks each file's lines.
    Null and empty texts have no blocks.
    """
    # pairs are tested in columns; the walk only chooses among them
    lines = _lines(F.coalesce(F.col("text"), F.lit("")))
    cut = texts.select("path", lines.alias("lines")).where(F.size("lines") >= 3)
    ok = F.transform(F.sequence(F.lit(0), F.size("lines") - 3), lambda i: C.loose_pair(F.get("lines", i + 1), F.get("lines", i + 2)))
    tested = cut.withColumn("ok", ok)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, lines, ok in zip(*(batch.column(c).to_pylist() for c in ("path", "lines", "ok")), strict=True):
                at = block = 0
                while at < len(ok):
                    if ok[at]:
                        out.append((path, block, lines[at], lines[at + 1], lines[at + 2]))
                        block += 1
                    at += 3 if ok[at] else 1
            names = ["path", "block", "name", "line1", "line2"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    walked = tested.mapInArrow(run, "path string, block long, name string, line1 string, line2 string")
    return walked.withColumn("name", F.trim(F.regexp_replace("name", "^0 ", "")))


def _pairs(lines: Column) -> Column:
    """KEY = value lines as structs; comments are skipped."""
    said = F.filter(lines, lambda x: ~x.startswith("COMMENT"))
    return F.transform(said, lambda x: F.struct(F.upper(F.trim(F.substring_index(x, "=", 1))).alias("key"), F.when(x.contains("="), F.trim(F.regexp_replace(x, "^[^=]*=", ""))).alias("value")))


def _pair_issue(pairs: Column) -> Column:
    bad = F.exists(pairs, lambda p: F.coalesce(p["value"], F.lit("")).eqNullSafe("") | ~p["key"].rlike("^[A-Z][A-Z0-9_]*$"))
    keys = F.transform(pairs, lambda p: p["key"])
    return F.when(bad, "KVN_MALFORMED").when(F.size(keys) != F.size(F.array_distinct(keys)), "DUPLICATE_FIELD")


def utc(value: Column) -> Column:
    """A CCSDS time as a timestamp; without an offset it is UTC."""
    v = F.trim(value)
    zoned = F.when(v.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$"), v).otherwise(F.concat(v, F.lit("Z")))
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), zoned.try_cast("timestamp"))


def omm_kvn(texts: DataFrame) -> DataFrame:
    """One row per file: path, object_name, norad_id, cospar, epoch, the nine numbers, and issue (null when usable)."""
    pairs = _pairs(_lines(F.coalesce(F.col("text"), F.lit(""))))
    found = texts.select("path", pairs.alias("pairs")).withColumn("issue", _pair_issue(F.col("pairs")))
    return omm_checked(found.withColumn("m", F.when(F.col("issue").isNull(), F.map_from_entries("pairs")).otherwise(F.create_map().cast("map<string,string>"))))


def omm_checked(found: DataFrame, *kept: str) -> DataFrame:
    """The same of fields already in a map ``m`` beside the issue they have so far; columns in ``kept`` are passed on."""
    v = lambda k: F.try_element_at("m", F.lit(k))
    is_ = lambda k, x: F.coalesce(F.upper(v(k)) == x, F.lit(False))
    number = {k: v(k).try_cast("double") for k in OMM_NUMBERS}
    need = F.lit(True)
    for k in OMM_NUMBERS[:7]:
        need = need & number[k].isNotNull()
    ranges = (number["MEAN_MOTION"] > 0) & (number["ECCENTRICITY"] >= 0) & (number["ECCENTRICITY"] < 1) & number["INCLINATION"].between(0, 180)
    issue = (
        F.when(F.col("issue").isNotNull(), F.col("issue"))
        .when(~F.coalesce(v("CCSDS_OMM_VERS").rlike(r"^2(\.\d+)?$"), F.lit(False)), "VERSION_UNSUPPORTED")
        .when(~is_("CENTER_NAME", "EARTH"), "CENTER_UNSUPPORTED")
        .when(~is_("REF_FRAME", "TEME"), "FRAME_UNSUPPORTED")
        .when(~is_("TIME_SYSTEM", "UTC"), "TIME_SYSTEM_UNSUPPORTED")
        .when(~is_("MEAN_ELEMENT_THEORY", "SGP4"), "THEORY_UNSUPPORTED")
        .when(F.coalesce(v("EPHEMERIS_TYPE"), F.lit("0")) != "0", "EPHEMERIS_TYPE_UNSUPPORTED")
        .when(utc(v("EPOCH")).isNull(), "EPOCH_INVALID")
        .when(~need | ~F.coalesce(ranges, F.lit(False)), "NUMBER_INVALID")
    )
    told = {"object_name": v("OBJECT_NAME"), "norad_id": C.norad_id(v("NORAD_CAT_ID")), "cospar": C.designator(v("OBJECT_ID")), "epoch": utc(v("EPOCH")), **{k.lower(): c for k, c in number.items()}, "issue": issue}
    return settled(found, **told).select("path", *kept, *told)


def oem_states(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, states) of OEM files with one metadata segment.

    ``files``: path, object_name, cospar, frame, n_states, issue.  ``states`` of the files
    without an issue: path, i, ts, x, y, z, vx, vy, vz.  Covariance blocks, state lines of other
    than seven tokens, unordered times and bounds that differ from the samples are issues.
    """
    upper = lambda x: F.upper(x)
    lines = F.filter(_lines(F.coalesce(F.col("text"), F.lit(""))), lambda x: ~x.startswith("COMMENT") & ~upper(x).isin("DATA_START", "DATA_STOP"))
    cut = texts.select("path", lines.alias("lines")).withColumn("marks", F.transform("lines", F.upper))
    start, stop = F.array_position("marks", F.lit("META_START")), F.array_position("marks", F.lit("META_STOP"))
    cut = cut.withColumn("a", start).withColumn("b", stop)
    framed = (F.size(F.filter("marks", lambda x: x == "META_START")) == 1) & (F.size(F.filter("marks", lambda x: x == "META_STOP")) == 1) & (F.col("a") > 0) & (F.col("b") > F.col("a"))
    cut = cut.withColumn("framed", framed)
    part = lambda first, last: F.when(F.col("framed"), F.slice("lines", first.cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<string>"))
    cut = cut.withColumn("head", _pairs(part(F.lit(1), F.col("a")))).withColumn("meta", _pairs(part(F.col("a") + 1, F.col("b")))).withColumn("body", part(F.col("b") + 1, F.size("lines") + 1))
    tokens = F.transform(F.filter("body", lambda x: ~x.contains("=")), lambda x: F.split(x, r"\s+"))
    state = F.transform(tokens, lambda t: F.struct(utc(F.get(t, F.lit(0))).alias("ts"), *[F.get(t, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "vx", "vy", "vz"))], F.size(t).alias("tokens")))
    cut = cut.withColumn("states", state).withColumn("early", F.coalesce(_pair_issue(F.col("head")), _pair_issue(F.col("meta"))))
    safe = F.col("early").isNull() & F.col("framed")
    m = F.when(safe, F.map_from_entries(F.concat("head", "meta"))).otherwise(F.create_map().cast("map<string,string>"))
    read = cut.withColumn("m", m)
    v = lambda k: F.try_element_at("m", F.lit(k))
    broken = F.exists("states", lambda s: (s["tokens"] != 7) | s["ts"].isNull() | (s["x"] + s["y"] + s["z"] + s["vx"] + s["vy"] + s["vz"]).isNull())
    times = F.transform("states", lambda s: s["ts"])
    unordered = F.exists(F.arrays_zip(F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))).alias("p"), F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0))).alias("n")), lambda z: z["p"] >= z["n"])
    issue = (
        F.when(F.exists("marks", lambda x: x.contains("COVARIANCE_START")), "COVARIANCE_UNSUPPORTED")
        .when(~F.col("framed"), "KVN_MALFORMED")
        .when(F.col("early").isNotNull(), F.col("early"))
        .when(~F.coalesce(v("CCSDS_OEM_VERS").rlike(r"^2(\.\d+)?$"), F.lit(False)), "VERSION_UNSUPPORTED")
        .when(~F.coalesce(F.upper(v("CENTER_NAME")) == "EARTH", F.lit(False)), "CENTER_UNSUPPORTED")
        .when(~F.coalesce(F.upper(v("TIME_SYSTEM")) == "UTC", F.lit(False)), "TIME_SYSTEM_UNSUPPORTED")
        .when((F.size("states") < 2) | broken, "SAMPLE_INVALID")
        .when(F.coalesce(unordered, F.lit(False)), "SAMPLE_ORDER_INVALID")
        .when(F.coalesce(utc(v("START_TIME")) != F.element_at(times, 1), F.lit(False)) | F.coalesce(utc(v("STOP_TIME")) != F.element_at(times, -1), F.lit(False)), "SAMPLE_INVALID")
    )
    read = read.withColumn("issue", issue)
    described = read.select("path", v("OBJECT_NAME").alias("object_name"), C.designator(v("OBJECT_ID")).alias("cospar"), F.upper(v("REF_FRAME")).alias("frame"), F.size("states").alias("n_states"), "issue")
    states = read.where("issue is null").select("path", F.posexplode("states").alias("i", "s")).select("path", "i", "s.ts", "s.x", "s.y", "s.z", "s.vx", "s.vy", "s.vz")
    return described, states


def satcat_decayed(spark: SparkSession, path: str) -> DataFrame:
    """Payloads with a decay date of a SATCAT table (CSV with a header)."""
    t = spark.read.csv(path, header=True)
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    return t.where(~blank("DECAY_DATE") & (F.upper(F.trim("OBJECT_TYPE")) == "PAY"))


def horizons_rows(texts: DataFrame) -> DataFrame:
    """(path, i, ts, x, y, z, vx, vy, vz) between the start and end marks, rounded to six digits; rows of fewer than eight columns are dropped."""
    lines = texts.select("path", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), r"\r?\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy("path").orderBy("i")
    inside = F.sum(F.when(F.col("line") == "$$SOE", 1).when(F.col("line") == "$$EOE", -1).otherwise(0)).over(w)
    rows = lines.withColumn("inside", inside).where((F.col("inside") > 0) & (F.col("line") != "$$SOE"))
    return horizons_columns(rows, ["path", "i"])


def horizons_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ts, x, y, z, vx, vy, vz of comma-separated lines; :func:`perigee.sources.scan.horizons` reads files of any size."""
    rows = rows.withColumn("c", F.split("line", r"\s*,\s*")).where(F.size("c") >= 8)
    at = F.try_to_timestamp(F.regexp_replace(F.get("c", F.lit(1)), r"^A\.D\.\s*", ""), F.lit("yyyy-MMM-dd HH:mm:ss.SSSS"))
    return rows.select(*keys, at.alias("ts"), *[F.round(F.get("c", F.lit(k + 2)).try_cast("double"), 6).alias(n) for k, n in enumerate(("x", "y", "z", "vx", "vy", "vz"))])


PROVIDER_JSON = (
    "provider string, object_id string, norad_id string, frame string, time_scale string, interpolation string, units struct<position:string,velocity:string>, "
    "states array<struct<timestamp:string,position:array<double>,velocity:array<double>>>"
)


def provider_states(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, states) of provider ephemerides in JSON, one object per row of (path, text).

    Frame, UTC and kilometre units must be said; only linear interpolation is taken.  ``files``:
    path, identity, frame, n_states, issue; ``states`` as in :func:`oem_states`, for files without an issue.
    """
    j = F.from_json(F.coalesce(F.col("text"), F.lit("")), PROVIDER_JSON, {"mode": "PERMISSIVE"})
    read = texts.select("path", j.alias("j")).select("path", "j.*")
    said = lambda c, x: F.coalesce(F.upper(F.col(c)) == x, F.lit(False))
    rows = F.transform("states", lambda s: F.struct(utc(s["timestamp"]).alias("ts"), s["position"].alias("p"), s["velocity"].alias("v")))
    read = read.withColumn("rows", rows)
    whole = lambda x: (F.size(x) == 3) & ~F.exists(x, lambda y: y.isNull() | F.isnan(y))
    broken = F.exists("rows", lambda s: s["ts"].isNull() | ~F.coalesce(whole(s["p"]) & whole(s["v"]), F.lit(False)))
    n = F.size("rows")
    unordered = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get("rows", i - 1)["ts"] >= F.get("rows", i)["ts"])
    issue = (
        F.when(F.col("states").isNull(), "RECORD_MALFORMED")
        .when(F.col("frame").isNull(), "FRAME_UNSUPPORTED")
        .when(~said("time_scale", "UTC"), "TIME_SYSTEM_UNSUPPORTED")
        .when(~(said("units.position", "KM") & said("units.velocity", "KM/S")), "UNITS_UNSUPPORTED")
        .when(F.coalesce(F.upper("interpolation") != "LINEAR", F.lit(False)), "INTERPOLATION_UNSUPPORTED")
        .when((n < 2) | F.coalesce(broken, F.lit(True)), "SAMPLE_INVALID")
        .when(F.coalesce(unordered, F.lit(False)), "SAMPLE_ORDER_INVALID")
    )
    read = read.withColumn("issue", issue)
    none = F.lit(None).cast("string")
    identity = C.object_id(none, F.col("norad_id"), none, F.col("provider"), F.col("object_id"))
    described = read.select("path", identity.alias("identity"), F.upper("frame").alias("frame"), n.alias("n_states"), "issue")
    states = read.where("issue is null").select("path", F.posexplode("rows").alias("i", "s"))
    return described, states.select("path", "i", "s.ts", *[F.get(F.col(f"s.{c}"), F.lit(k)).alias(n) for c, names in (("p", ("x", "y", "z")), ("v", ("vx", "vy", "vz"))) for k, n in enumerate(names)])
