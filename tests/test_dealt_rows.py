"""Queries whose rows cost far more than their bytes give them to as many tasks as the setting says, however small the table's file."""

import pytest

from perigee.plans import QUERIES


@pytest.mark.parametrize("name", ["omm_records", "tle_records", "record_issues", "element_rules"])
def test_rows_are_dealt(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    n = spark.conf.get("spark.sql.shuffle.partitions")
    scans = plan.split("Scan parquet")[:-1]
    assert scans and all("hashpartitioning(p_partkey" in x and f", {n}), REPARTITION_BY_NUM" in x for x in scans)
