"""Star catalogs: brightness limit, right ascension from degrees or hours, tiles by right ascension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.functions import geometry as G


def read_stars(spark: SparkSession, path: str, limit: float = 6.5) -> DataFrame:
    """Rows of a headed CSV with name, raDeg or raHours, decDeg, mag and bv; those without a declination or too faint are dropped."""
    raw = spark.read.csv(path, header=True)
    number = lambda c: (F.col(c) if c in raw.columns else F.lit(None)).try_cast("double")
    ra = G.right_ascension(number("raDeg"), number("raHours"))
    stars = raw.select("name", ra.alias("ra_deg"), number("decDeg").alias("dec_deg"), number("mag").alias("mag"), number("bv").alias("bv"))
    return stars.where(F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull() & (F.col("mag") < limit))


def tiles(stars: DataFrame, limit: float, width_deg: float = 30.0) -> DataFrame:
    """Stars under the limit with their tile's number; written by ``partitionBy('tile_id')``."""
    return stars.where(F.col("mag") < limit).withColumn("tile_id", F.floor(F.col("ra_deg") / width_deg))
