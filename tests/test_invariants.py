
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stationclim.operators import climatology as clim
from stationclim.sources import testviews as tv


@pytest.fixture(scope="module")
def obs(spark):
    return tv.t_obs(spark, SF_SMALL)


def test_row_bounds_per_station(obs):
    d = clim.daily_output(obs).groupBy("ID").count().agg(F.max("count")).collect()[0][0]
    m = clim.monthly_output(obs).groupBy("ID").count().agg(F.max("count")).collect()[0][0]
    assert d <= 366 and m <= 12


def test_entry_counts_sum_to_raw_counts(obs):
    h = clim.raw_counts_from_history(clim.history_output(obs))
    r = clim.raw_counts(obs)
    assert sorted(map(tuple, h.collect())) == sorted(map(tuple, r.collect()))


def test_quantile_order_within_element(obs):
    for long in (clim.daily_climatology_long(clim.year_day_summary(clim.day_histogram(obs))),
                 clim.monthly_climatology_long(clim.year_month_summary(clim.month_histogram(obs)))):
        bad = long.where((F.col("MIN") > F.col("P10")) | (F.col("P10") > F.col("P90")) | (F.col("P90") > F.col("MAX")))
        assert bad.count() == 0


def test_day_index_is_dense(obs):
    d = clim.daily_output(obs).groupBy("ID").agg(F.max("DAY").alias("mx"), F.count("*").alias("n"))
    assert d.where(F.col("mx") != F.col("n")).count() == 0


def test_month_roll_up_equals_direct_month_histogram(obs):
    a = clim.year_month_summary(clim.month_histogram_from_days(clim.day_histogram(obs)))
    b = clim.year_month_summary(clim.month_histogram(obs))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_presence_flag_equals_output_flag(spark, obs):
    from stationclim.operators import stations as st

    o = obs.where(~F.col("ID").endswith("7"))
    ids = obs.select("ID").distinct().union(spark.createDataFrame([("NOPE0000000",)], "ID string"))
    a = st.flag_missing(ids, clim.daily_output(o), clim.monthly_output(o))
    b = st.flag_missing_from_presence(ids, clim.output_presence(o))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert b.where("ID = 'NOPE0000000'").first().MISSING
