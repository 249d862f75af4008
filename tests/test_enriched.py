"""Order-book minutes and as-of enrichment by several series."""

from pyspark.sql import functions as F

from tidemark.operators import asof, book


def test_book_minutes_leave_null_statistics_out(spark):
    level = "array<struct<price:double,qty:double>>"
    rows = [("spot", 1000, 1, [(99.0, 1.0)], [(101.0, 3.0)]), ("spot", 2000, 2, [(99.0, 2.0)], []), ("perp", 61_000, 3, [(9.0, 1.0)], [(11.0, 1.0)])]
    df = spark.createDataFrame(rows, f"market string, ts_ms long, event_id long, bids {level}, asks {level}")
    samples = df.select("market", "ts_ms", "event_id", *(c.alias(n) for n, c in book.sample_stats(F.col("bids"), F.col("asks")).items()))
    first, second = book.book_minutes(samples, {"spot": "spot_ob", "perp": "perp_ob"}).orderBy("minute_ms").collect()
    assert (first.spot_ob_samples, first.perp_ob_samples) == (2, None)
    assert first.spot_ob_spread_bps_mean == first.spot_ob_spread_bps_last == 200.0  # the second snapshot has no mid
    assert (first.spot_ob_imbalance_l50_min, first.spot_ob_imbalance_l50_max, first.spot_ob_imbalance_l50_last) == (-0.5, 1.0, 1.0)
    assert first.spot_ob_imbalance_5bps_mean is None  # nothing lies within the band
    assert (second.minute_ms, second.spot_ob_samples, second.perp_ob_samples) == (60_000, None, 1)
    assert book.book_minutes(samples.limit(0), {"spot": "spot_ob"}).count() == 0


def test_series_join_as_of_at_any_distance_and_equal_times(spark):
    day = 86_400_000
    left = spark.createDataFrame([(0, "a"), (5, "b"), (9 * day, "c")], "at long, name string")
    x = spark.createDataFrame([(5, 1.0), (6, None)], "t long, v double")
    y = spark.createDataFrame([(0, 2.0)], "t long, v double")
    out = asof.asof_joins(left, "at", {"x": (x, "t", ["v"]), "y": (y, "t", ["v"])})
    assert sorted(map(tuple, out.collect())) == [(0, "a", None, 2.0), (5, "b", 1.0, 2.0), (9 * day, "c", None, 2.0)]
    assert asof.asof_joins(left, "at", {"x": (x.limit(0), "t", ["v"])}).count() == 3


def test_zero_filling_goes_by_name(spark):
    df = spark.createDataFrame([(None, None, None, None)], "liq_count long, oi_volume double, spot_kline_volume double, perp_buy_volume double")
    assert tuple(asof.zero_filled(df).first()) == (0, None, None, 0.0)
