"""Exact percentiles by selection, and numbering of many ids of one beginning."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions.numbering import dense_numbers, id_bounds, range_of
from trajspark.functions.quantiles import exact_percentiles, most_frequent
from trajspark.operators import trips

SHARES = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]


@pytest.mark.parametrize("kind", ["normal", "skewed", "few", "wide", "tiny", "one"])
@pytest.mark.parametrize(("bins", "few"), [(2048, 20_000), (4, 3)])
def test_percentiles_are_sparks(spark, kind, bins, few):
    r = np.random.default_rng(1)
    values = {
        "normal": r.normal(size=1500), "skewed": np.append(np.exp(r.normal(0, 6, 800)), [-1e9]), "few": r.integers(0, 3, 700).astype(float),
        "wide": np.append(r.normal(size=50), [1.7e308, -1.7e308]), "tiny": np.array([3.0, 1.0]), "one": np.array([2.5]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    expected = df.agg(F.percentile("v", SHARES)).first()[0]
    odd = df.unionByName(spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double"))
    assert exact_percentiles(odd, "v", SHARES, bins, few) == pytest.approx(expected, rel=1e-12)


def test_percentiles_without_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert exact_percentiles(df, "v", [0.5, 0.95]) == [None, None]
    assert most_frequent(df.limit(0), "v").count() == 0


def test_most_frequent(spark):
    df = spark.createDataFrame([(x,) for x in [3.0, 1.0, 1.0, 2.0, 2.0, None, None, None]], "v double")
    assert tuple(most_frequent(df, "v").first()) == (1.0, 2)


def test_numbers_of_many_ids_of_one_beginning(spark):
    """100,000 ids that begin alike: ranks are dense and in order, and no range of ids holds more than its share."""
    n, per = 100_000, 5_000
    ids = spark.range(n).select(F.concat(F.lit("flow_"), F.col("id").cast("string")).alias("vehicle_id"), F.explode(F.sequence(F.lit(1), 1 + F.col("id") % 2)).alias("segment"))
    got = trips.number_trips(ids, per).toPandas().sort_values(["vehicle_id", "segment"])
    assert got.trip_id.tolist() == list(range(1, len(got) + 1))
    keys = ids.select("vehicle_id").distinct()
    bounds = id_bounds(keys, "vehicle_id", per)
    sizes = keys.groupBy(range_of(F.col("vehicle_id"), bounds).alias("r")).count().toPandas()["count"]
    assert len(sizes) == n // per and sizes.max() <= 2 * per


def test_numbers_of_few_ids(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("a", 2), ("é", 1)], "vehicle_id string, segment long")
    for per in (1, 2, 100):
        got = {(r.vehicle_id, r.segment, r.trip_id) for r in trips.number_trips(df, per).collect()}
        assert got == {("a", 1, 1), ("a", 2, 2), ("b", 1, 3), ("é", 1, 4)}
    assert trips.number_trips(df.limit(0)).count() == 0


def test_dense_numbers(spark):
    values = [f"x{k}" for k in np.random.default_rng(0).integers(0, 500, 900)]
    got = dense_numbers(spark.createDataFrame([(v,) for v in values], "v string"), "v", 50).collect()
    assert {(r.v, r.number) for r in got} == {(v, k) for k, v in enumerate(sorted(set(values)), 1)} and len(got) == len(set(values))
