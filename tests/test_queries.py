"""Registered queries next to their SQL on the smallest data, plus properties of those without SQL."""

import os

import pytest

from compare import differences, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def registry():
    import __spark_entry__ as entry

    return entry.queries(), entry.oracle_sql()


def of_library(names):
    """Queries of the library itself; those of the training-data package are tested with it."""
    return [n for n in names if n != "pipeline" and not n.startswith("op")]


# long site selection and the full registry run in the comparison script instead
SLOW = {"monitoring_sites", "registry_build"}


@pytest.mark.parametrize("name", of_library(registry()[1]))
def test_query_equals_sql(spark, con, name):
    calls, sqls = registry()
    assert differences(calls[name](spark, SF), con, sqls[name]) is None


@pytest.mark.parametrize("name", of_library(sorted(set(registry()[0]) - set(registry()[1]) - SLOW)))
def test_query_without_sql_runs(spark, name):
    rows = registry()[0][name](spark, SF)
    assert len(rows.columns) > 0 and len(rows.collect()) > 0


def test_isolation_scores(spark):
    """Scores lie in (0, 1], repeat with the same seed, and a planted block of extremes lies at the top."""
    from pyspark.sql import functions as F

    from assetpulse.operators.forest import with_forest_scores
    from assetpulse.params import Params

    df = spark.range(4000).select(
        F.concat(F.lit("s"), F.floor(F.col("id") / 200).cast("string")).alias("sensor_id"), (F.col("id") % 200).alias("cell"),
        F.lit("pressure").alias("sensor_type"),
        F.when(F.col("id").between(1000, 1009), 15.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(1009)) / 500.0 - 1).alias("z"),
    )
    got = {(r.sensor_id, r.cell): r.forest_score for r in with_forest_scores(df, Params(forest_trees=40)).collect()}
    again = {(r.sensor_id, r.cell): r.forest_score for r in with_forest_scores(df.repartition(5), Params(forest_trees=40)).collect()}
    assert got == again and len(got) == 4000 and all(0 < v <= 1 for v in got.values())
    ranked = sorted(got.values())
    assert min(got[("s5", c)] for c in range(10)) > ranked[int(len(ranked) * 0.99) - 1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert "anomaly_id" in entry.entry(spark).columns
