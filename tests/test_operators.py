"""Joins, aggregates, windows and reshaping on hand-made rows."""

import random
import statistics
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from epitide.functions import measures
from epitide.operators import aggregates, joins, reshape, windows
from epitide.plans import quality

S = ["location_code", "disease"]


def series(spark, values, start=date(2024, 1, 1), step=1, code="AAA"):
    rows = [(code, "X", start + timedelta(days=i * step), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "location_code string, disease string, date date, value double")


def ordered(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("date").collect()]


def test_lags_and_lead_direction(spark):
    df = series(spark, [float(i) for i in range(20)])
    out = windows.lead_target(windows.lags(df, S, "date", "value"), S, "date", "value", 7)
    rows = ordered(out, "value", "lag_1", "target")
    assert rows[8] == (8.0, 7.0, 15.0)
    assert rows[0][1] is None and rows[13][2] is None


def test_keep_latest_prefers_known_stamp_and_is_idempotent(spark):
    df = spark.createDataFrame([("A", 1, 10.0), ("A", 2, 12.0), ("A", None, 99.0)], "k string, at int, v double")
    once = windows.keep_latest(df, ["k"], [F.col("at").desc_nulls_last()])
    assert [r["v"] for r in once.collect()] == [12.0]
    assert windows.keep_latest(once, ["k"], [F.col("at").desc_nulls_last()]).count() == 1


def test_keep_latest_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = windows.keep_latest(df, ["k"], [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_annual_target_and_smoothing(spark):
    df = spark.createDataFrame(
        [("A", "X", date(y, 12, 31), "annual", v, None) for y, v in ((2019, 5.0), (2020, 10.0), (2021, 20.0), (2022, 30.0), (2024, 7.0))],
        "location_code string, disease string, date date, frequency string, value double, published_smoothed double",
    )
    rows = ordered(windows.frequency_features(df, S), "new_cases_smoothed", "target_t_plus_7", "horizon_steps")
    assert [r[1] for r in rows] == [10.0, 20.0, 30.0, None, None]
    assert rows[1][0] == 7.5 and rows[2][0] == pytest.approx(35 / 3)
    assert {r[2] for r in rows} == {1}


def test_annual_smoothing_golden(spark):
    df = spark.createDataFrame(
        [("A", "X", date(y, 12, 31), "annual", v, None) for y, v in ((2020, 10.0), (2021, 20.0), (2022, 30.0))],
        "location_code string, disease string, date date, frequency string, value double, published_smoothed double",
    )
    rows = ordered(windows.frequency_features(df, S), "new_cases_smoothed", "target_t_plus_7")
    assert rows[:2] == [(10.0, 20.0), (15.0, 30.0)]


def test_frequency_features_match_pandas(spark):
    rng = random.Random(3)
    rows = []
    for frequency, step, code in (("daily", 1, "AAA"), ("weekly", 7, "BBB")):
        day = date(2024, 1, 6)
        for _ in range(60):
            rows.append((code, "X", day, frequency, float(rng.randint(0, 50)), None))
            day += timedelta(days=step * rng.choice([1, 1, 1, 2]))
    df = spark.createDataFrame(rows, "location_code string, disease string, date date, frequency string, value double, published_smoothed double")
    got = windows.frequency_features(df, S).toPandas().sort_values(["location_code", "date"]).reset_index(drop=True)
    for code, n, growth, days in (("AAA", 7, 7, 7), ("BBB", 4, 1, 7)):
        g = got[got.location_code == code].reset_index(drop=True)
        value = g["value"]
        smooth = value.rolling(n, min_periods=1).mean()
        wide = max(2 * n, 3)
        prior = smooth.shift(growth)
        target = smooth if code == "AAA" else value
        by_date = dict(zip(g["date"], target))
        expected = {
            "rolling_mean_7": smooth, "rolling_mean_14": value.rolling(wide, min_periods=1).mean(), "rolling_std_7": value.rolling(n, min_periods=2).std(ddof=0),
            "lag_14": smooth.shift(14), "growth_rate_7": (smooth - prior) / prior.abs().clip(lower=1.0),
            "target_t_plus_7": pd.Series([by_date.get(d + timedelta(days=days)) for d in g["date"]], dtype="float64"),
        }
        for name, series_ in expected.items():
            pd.testing.assert_series_equal(g[name].astype("float64"), series_.astype("float64"), check_names=False, rtol=1e-9, atol=1e-9)


def test_exact_target_equals_self_join(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).where("value <> 3")
    a = ordered(windows.exact_target(df, S, "date", "value", horizon=2), "value", "target")
    b = ordered(joins.exact_target_by_join(df, S, "date", "value", 2), "value", "target")
    assert a == b == [(1.0, None), (2.0, 4.0), (4.0, None), (5.0, None)]


def test_features_do_not_see_the_future(spark):
    base = [float(i % 9) for i in range(40)]
    changed = base[:30] + [1000.0] * 10
    cols = [c for c in ("rolling_mean_3", "rolling_mean_7", "rolling_std_14", "lag_14", "growth_rate_7", "new_cases_smoothed")]

    def features(values):
        df = series(spark, values).withColumns({"frequency": F.lit("daily"), "published_smoothed": F.lit(None).cast("double")})
        return ordered(windows.frequency_features(df, S), *cols)[:30]

    assert features(base) == features(changed)


def test_cumulative_difference_sums_back(spark):
    totals = [3.0, 5.0, 4.0, 10.0]
    rows = ordered(windows.diff_cumulative(series(spark, totals), S, "date", {"value": "change"}), "change")
    assert [r[0] for r in rows] == [3.0, 2.0, -1.0, 6.0]
    assert sum(r[0] for r in rows) == totals[-1]
    first_null = ordered(windows.diff_cumulative(series(spark, totals), S, "date", {"value": "change"}, first="null"), "change")
    assert first_null[0][0] is None


def test_trailing_run(spark):
    def run(values):
        return windows.trailing_run(series(spark, values), S, "date", "value").first()

    row = run([0.0, 4.0, 0.0, 0.0])
    assert (row["trailing_zero_periods"], row["last_nonzero_value"], row["last_nonzero_date"]) == (2, 4.0, date(2024, 1, 2))
    assert run([5.0, None, 0.0])["trailing_zero_periods"] == 1
    assert run([0.0, 0.0])["trailing_zero_periods"] == 2 and run([0.0, 0.0])["last_nonzero_value"] is None
    assert run([0.0, 0.0, None])["trailing_zero_periods"] == 0
    assert run([1.0] + [0.0] * 28)["reporting_stale"] is True


@pytest.mark.parametrize("limit", [None, 1, 2])
def test_interpolation_equals_pandas(spark, limit):
    values = [None, 1.0, None, None, None, 5.0, None, 9.0, None]
    got = [r[0] for r in ordered(windows.interpolate(series(spark, values), S, F.unix_date("date"), "value", limit=limit, order="date"), "value")]
    kwargs = {"limit": limit} if limit else {}
    want = pd.Series(values, dtype=float).interpolate(method="linear", limit_area="inside", **kwargs)
    assert got == [None if pd.isna(x) else x for x in want]


def test_fill_is_forward_unless_asked(spark):
    df = series(spark, [None, 2.0, None])
    assert [r[0] for r in ordered(windows.fill(df, S, "date", ["value"]), "value")] == [None, 2.0, 2.0]
    assert [r[0] for r in ordered(windows.fill(df, S, "date", ["value"], "both"), "value")] == [2.0, 2.0, 2.0]


def test_minmax_constant_and_missing(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", None), ("b", 7.0), ("b", 7.0), (None, 1.0)], "g string, x double")
    got = sorted(((r["g"] or "-", r["x"], r["s"]) for r in windows.minmax(df, ["g"], {"x": "s"}).collect()), key=str)
    assert got == sorted([("a", 2.0, 0.5), ("a", 4.0, 1.0), ("a", None, 0.0), ("b", 7.0, 0.0), ("b", 7.0, 0.0), ("-", 1.0, 0.0)], key=str)


def test_window_arrays_skip_gaps(spark):
    df = series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]).withColumn("is_observed", F.col("value").isNotNull())
    rows = ordered(windows.window_arrays(df, S, "date", "value", 2, 1), "input_window", "target")
    assert rows == [([1.0, 2.0], None), ([4.0, 5.0], 6.0), ([5.0, 6.0], 7.0), ([6.0, 7.0], None)]


def test_asof_never_uses_a_later_year(spark):
    left = spark.createDataFrame([("A", y) for y in (1999, 2000, 2001, 2003)] + [("B", 2000)], "location_code string, year int")
    right = spark.createDataFrame([("A", 2000, 1.0), ("A", 2002, 2.0)], "location_code string, py int, population double")
    out = joins.asof_backward(left, right, ["location_code"], F.col("year"), "py", ["population"])
    got = {(r["location_code"], r["year"]): (r["population"], r["matched_py"]) for r in out.collect()}
    assert got == {("A", 1999): (None, None), ("A", 2000): (1.0, 2000), ("A", 2001): (1.0, 2000), ("A", 2003): (2.0, 2002), ("B", 2000): (None, None)}


def test_calendar_grid_weekly_inserts_one_row(spark):
    df = series(spark, [float(i) for i in range(10)], date(2023, 1, 7), 7).where("value <> 4")
    grid = joins.calendar_grid(df, S, "date", "weekly")
    assert grid.count() == 10 and grid.where("NOT is_observed").count() == 1


def test_many_to_one_rejects_duplicates(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    good = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in joins.many_to_one(left, good, "k", ["v"]).collect()) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="duplicate key"):
        joins.many_to_one(left, good.unionAll(good), "k", ["v"]).collect()


def test_precedence_later_source_wins(spark):
    a = spark.createDataFrame([("k1", 1.0), ("k2", 2.0)], "k string, v double")
    b = spark.createDataFrame([("k2", 9.0)], "k string, v double")
    assert {r["k"]: r["v"] for r in joins.merge_by_precedence([a, b], ["k"]).collect()} == {"k1": 1.0, "k2": 9.0}


def test_level_resolution(spark):
    rows = [
        ("N", None, 5.0), ("P", "p1", 2.0), ("P", "p2", 3.0), ("Both", None, 10.0), ("Both", "p1", 1.0), ("Same", None, 10.0), ("Same", "same", 4.0), ("United", None, 7.0), ("United", "UK", 6.0),
    ]
    df = spark.createDataFrame(rows, "country string, province string, cases double").withColumn("date", F.lit(date(2020, 1, 1)))
    out = aggregates.resolve_levels(aggregates.split_levels(df, ["country", "date"], "province", "country", ["cases"]), ["cases"])
    assert {r["country"]: (r["cases"], r["aggregation_conflict"]) for r in out.collect()} == {
        "N": (5.0, False), "P": (5.0, False), "Both": (11.0, True), "Same": (4.0, True), "United": (6.0, True),
    }
    wins = aggregates.province_wins(df, ["country", "date"], "province", ["country"], {"cases": "cases"})
    assert {r["country"]: r["cases"] for r in wins.collect()} == {"N": 5.0, "P": 5.0, "Both": 1.0, "Same": 4.0, "United": 6.0}


def test_regression_metrics_golden(spark):
    df = spark.createDataFrame([("m", 0.0, 0.0), ("m", 10.0, 12.0), ("m", 20.0, 18.0), ("m", None, 3.0), ("flat", 5.0, 6.0), ("flat", 5.0, 4.0)], "g string, a double, p double")
    rows = {r["g"]: r for r in aggregates.regression_metrics(df, "a", "p", ["g"]).collect()}
    assert rows["m"]["mae"] == 1.333333 and rows["m"]["mape"] == 0.15 and rows["m"]["rows"] == 3
    assert rows["m"]["smape"] == round((0 + 4 / 22 + 4 / 38) / 3, 6)
    assert rows["m"]["r2"] == round(1 - 8 / 200, 6) and rows["flat"]["r2"] == 0.0
    empty = aggregates.regression_metrics(df.where("a > 99"), "a", "p", []).first()
    assert (empty["mae"], empty["rmse"], empty["r2"], empty["mape"], empty["smape"]) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_best_model_ignores_nan(spark):
    df = spark.createDataFrame([("d", "a", float("nan")), ("d", "b", 2.0), ("d", "c", 1.0), ("e", "a", None)], "disease string, model string, mae double")
    rows = {r["disease"]: (r["best_model"], r["best_mae"]) for r in aggregates.best_model(df, ["disease"]).collect()}
    assert rows == {"d": ("c", 1.0), "e": ("moving_average", 0.0)}


def test_correlation_guards(spark):
    rows = [("flat", 1.0, float(i)) for i in range(5)] + [("two", 1.0, 2.0), ("two", 2.0, 3.0)] + [("ok", float(i), 2.0 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r["c"] for r in df.groupBy("g").agg(aggregates.safe_corr("x", "y").alias("c")).collect()}
    assert got == {"flat": None, "two": None, "ok": 1.0}


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_median_brute_force(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, 0.0, 1.0, rng.random()]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = aggregates.exact_medians(aggregates.value_counts(df, "v"), ["v"], "c").first()["median"]
    assert got == pytest.approx(statistics.median(values))


def test_ordered_bits_are_the_pattern_of_the_double(spark):
    import struct

    rng = random.Random(5)
    values = [0.0, 1.0, 2.0, 3.0, 0.1, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), 1 - 2**-53, 1 + 2**-52]
    values += [2.0**k for k in range(-1074, 1024, 7)] + [2.0**k * (1 - 2**-53) for k in range(-1000, 1000, 11)]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)]
    values = [abs(v) for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, up, down in df.select("v", measures.ordered_bits("v"), measures.ordered_bits(-F.col("v"))).collect():
        assert up == struct.unpack("<q", struct.pack("<d", v))[0] == -down


def test_exact_medians_of_several_columns(spark):
    """Nine tenths of the distinct values of a column lie within a ten-thousandth of its range."""
    rng = random.Random(9)
    n = 4001
    columns = {
        "hot": [0.5 + rng.random() * 1e-5 if i % 10 else rng.random() for i in range(n)],
        "wide": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(n)],
        "even": [float(rng.randint(-3, 3)) if i else None for i in range(n)],
        "nan": [float("nan") if i % 2 else float(i) for i in range(n)],
        "same": [7.25] * n, "empty": [None] * n, "negative": [-float(i) for i in range(n)],
    }
    schema = ", ".join(f"`{c}` double" for c in columns)
    df = spark.createDataFrame(list(zip(*columns.values())), schema)
    got = {r["column_name"]: r["median"] for r in aggregates.exact_medians(df, list(columns)).collect()}
    for c, values in columns.items():
        known = [v for v in values if v is not None and v == v]
        assert got[c] == (statistics.median(known) if known else None), c


def test_median_plan_ranks_no_values(spark):
    """Windows of a round run over counted buckets, behind the aggregate."""
    import inspect

    source = inspect.getsource(aggregates.exact_medians)
    assert source.count("Window.") == 1 and "orderBy(\"bucket\")" in source and "collect_list" not in source


def test_positions_over_several_ranges(spark):
    """600 000 wide rows: every row with its right position, whatever the number of ranges."""
    df = spark.range(600_000).select(
        F.format_string("k%06d", "id").alias("k"), ((F.col("id") * 7919) % 600_000).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, 5.0).alias("y"), F.repeat(F.lit("w"), 256).alias("wide"),
    )
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(setting, "4m")
    try:
        rows = reshape.rankings(df, {"x": "x", "y": "y"}, ["k"])
        assert rows.select("wide").inputFiles() and len(rows.inputFiles()) > 2
        right = F.when(F.col("ranking") == "x", F.lit(600_000) - F.col("x")).when(F.col("y") == 5.0, F.substring("k", 2, 6).cast("long") / 3 + 1).otherwise(
            200_001 + F.substring("k", 2, 6).cast("long") - F.ceil(F.substring("k", 2, 6).cast("long") / 3))
        got = rows.groupBy("ranking").agg(F.count("*"), F.min("position"), F.max("position"), F.count_distinct("position"), F.count_if(F.col("position") != right)).collect()
        assert sorted(tuple(r) for r in got) == [("x", 600_000, 1, 600_000, 600_000, 0), ("y", 600_000, 1, 600_000, 600_000, 0)]
    finally:
        spark.conf.unset(setting)


def test_provenance_forms_agree(spark):
    rows = [("k1", "f1", "t1", "s1", 1), ("k1", "f2", "t1", "s1", 3), ("k1", "f2", "t2", "s2", 2), ("k2", "f1", "t1", "s1", 5)]
    df = spark.createDataFrame(rows, "k string, f string, t string, s string, v int")
    a = {r["k"]: r.asDict() for r in aggregates.provenance(df, "k", "f", "t", "s").collect()}
    b = {r["k"]: r.asDict() for r in aggregates.latest_with_provenance(df, "k", "f", "t", "s", [F.col("v")], ["v"]).collect()}
    assert a["k1"] == {
        "k": "k1", "duplicate_source_count": 3, "duplicate_source_files": "f1 | f2", "duplicate_collector_topics": "t1 | t2",
        "duplicate_content_variant_count": 2, "duplicate_content_conflict": True,
    }
    assert {k: r.pop("v") for k, r in b.items()} == {"k1": 3, "k2": 5}
    assert a == b


def test_duplicate_rows_ignore_column_boundaries(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", "bc")], "x string, y string")
    row = aggregates.duplicate_rows(df).first()
    assert (row["total_rows"], row["duplicate_rows"]) == (3, 1)


def test_matrix_mean_ignores_missing(spark):
    df = spark.createDataFrame([(date(2020, 1, 1), 280.0, None), (date(2020, 1, 1), float("nan"), 290.0), (date(2020, 1, 2), None, None)], "d date, a double, b double")
    rows = aggregates.matrix_mean(df, F.col("d"), "p", ["a", "b"], "t", -273.15).collect()
    assert len(rows) == 1 and rows[0]["t_observations"] == 2 and rows[0]["t"] == pytest.approx(11.85)
    assert rows[0]["t_min"] == pytest.approx(6.85) and rows[0]["t_max"] == pytest.approx(16.85)


def test_column_types(spark):
    df = spark.createDataFrame([("1", "1.5", "2020-01-01", "x", " "), ("2", "2", "1/2/2020", "5", None)], "i string, f string, d string, s string, e string")
    got = {r["column_name"]: r["inferred_type"] for r in aggregates.column_types(df, ["d"]).collect()}
    assert got == {"i": "integer", "f": "float", "d": "date", "s": "string", "e": "all_missing"}


def test_positional_split_orders(spark):
    df = series(spark, [1.0] * 20)
    rows = ordered(windows.positional_split(df, "date"), "split")
    assert [r[0] for r in rows] == ["train"] * 14 + ["validation"] * 3 + ["test"] * 3


def test_set_overlap(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {r["k"]: r["side"] for r in reshape.key_overlap(a, b, ["k"]).collect()} == {1: "left_only", 2: "both", 3: "right_only"}


def test_reconciliation(spark):
    a = spark.createDataFrame([(i, float(100 + i)) for i in range(9)], "k int, v double")
    b = spark.createDataFrame([(i, 100.0) for i in range(20)], "k int, v double")
    row = quality.reconcile(a, b, ["k"], "v").first()
    assert row["overlap_rows"] == 9 and row["median_relative_difference"] == round(4 / 104, 6) and row["within_5_percent_share"] == round(6 / 9, 6)


def test_rankings_count_missing_as_zero(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, 2.0), ("c", 3.0, -1.0)], "k string, x double, y double")
    rows = reshape.rankings(df, {"x": "x", "y": "y"}, ["k"], 2).orderBy("ranking", "position").collect()
    assert [(r["ranking"], r["k"]) for r in rows] == [("x", "c"), ("x", "a"), ("y", "b"), ("y", "a")]


def test_pages_are_bounded_and_whole(spark):
    """A group of 50 000 keys comes in pages of 1 000, in key order, over several ranges."""
    df = spark.range(50_000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), F.format_string("k%06d", (F.col("id") * 7919) % 50_000).alias("k"), F.col("id").alias("v"))
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(setting, "64k")
    try:
        got = reshape.pages(df, ["g"], "k", ["v"], 1000).orderBy("g", "page").collect()
    finally:
        spark.conf.unset(setting)
    assert [(r["g"], r["page"], r["entry_count"]) for r in got] == [("a", i, 1000) for i in range(45)] + [("b", i, 1000) for i in range(5)]
    for g in "ab":
        keys = [e["k"] for r in got if r["g"] == g for e in r["entries"]]
        assert keys == sorted(keys) and len(set(keys)) == len(keys)
        assert all((r["first_k"], r["last_k"]) == (r["entries"][0]["k"], r["entries"][-1]["k"]) for r in got if r["g"] == g)


def test_dense_difference(spark):
    rows = [("A", date(2020, 1, d), v) for d, v in ((3, 10.0), (1, 4.0), (2, None), (5, 7.0), (3, 1.0))] + [("B", date(2020, 1, 9), 2.0), ("C", date(2020, 1, 1), None)]
    df = spark.createDataFrame(rows, "k string, date date, v double")
    got = sorted(tuple(r) for r in windows.dense_difference(df, ["k"], "date", "v").collect())
    assert got == [("A", date(2020, 1, 1), 4.0), ("A", date(2020, 1, 3), 7.0), ("A", date(2020, 1, 5), -4.0), ("B", date(2020, 1, 9), 2.0)]


def test_overlap_evidence(spark):
    """Dates beyond one bitmap, a weather location without population, a repeated report."""
    day = lambda i: date(2050, 1, 1) + timedelta(days=i)
    cases = spark.createDataFrame([(n, day(i), None) for n in ("a", "b", "c", "d") for i in range(0, 8000, 20)] + [("a", day(0), None), ("e", None, "p")], "name string, date date, province string")
    mapping = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "name string, mapped_code string")
    population = spark.createDataFrame([("A",), ("B",), ("C",), ("Z",)], "location_code string")
    weather = spark.createDataFrame([(c, day(i)) for c in "ABCX" for i in range(0, 8000, 5)] + [("B", day(1))], "location_code string, date date")
    row = quality.overlap_report(cases, population, weather, mapping, min_days=400).first()
    assert (row["common_locations"], row["max_common_days"], row["case_duplicate_keys"], row["date_parse_errors"]) == (3, 400, 1, 1)
    assert row["weather_population_mapped"] and row["reports_need_deduplication"] and not row["can_enter_cleaning"]
    lacking = quality.overlap_report(cases, population, weather.unionByName(spark.createDataFrame([("D", day(0))], "location_code string, date date")), mapping).first()
    assert not lacking["weather_population_mapped"] and lacking["weather_without_population"] == 1


def test_report_by_source_counts_duplicates(spark):
    rows = [("s", "daily", "A", "x", date(2020, 1, 1), True, True, 1.0, None)] * 2 + [("s", "daily", "B", "x", date(2020, 1, 2), None, False, None, 2.0)]
    df = spark.createDataFrame(rows, "source string, frequency string, location_code string, disease string, date date, is_negative_case_correction boolean, has_weather boolean, population double, target_t_plus_7 double")
    r = quality.serving_report_by(df, ["source", "frequency"]).first()
    assert (r["rows"], r["duplicate_count"], r["negative_correction_count"], r["weather_matched_count"], r["population_unmatched_count"], r["missing_target"]) == (3, 1, 2, 2, 1, 0.666667)


def test_winner_is_fetched_late_and_whole(spark):
    """The highest first term wins, ties go by the other terms, and a group of copies keeps one row."""
    rows = [("k", f"f{i % 3}", "t", f"s{i % 2}", i % 5, i) for i in range(1000)] + [("one", "f9", "u", "s", None, 7)] * 3
    df = spark.createDataFrame(rows, "k string, f string, t string, s string, at int, v int")
    got = {r["k"]: r for r in aggregates.latest_with_provenance(df, "k", "f", "t", "s", [F.col("at"), F.col("v")], ["at", "v", "f"]).collect()}
    assert (got["k"]["at"], got["k"]["v"], got["k"]["duplicate_source_count"], got["k"]["duplicate_source_files"], got["k"]["duplicate_content_variant_count"]) == (4, 999, 1000, "f0 | f1 | f2", 2)
    assert (got["one"]["duplicate_source_count"], got["one"]["duplicate_source_files"], got["one"]["duplicate_collector_topics"], got["one"]["duplicate_content_conflict"]) == (3, "f9", "u", False)


def test_provenance_fetches_whole_rows_by_number(spark):
    """Whole rows meet one exchange, by their number, and no sort; all their first terms may be missing."""
    df = spark.range(400).selectExpr("concat('k', id % 40) as k", "concat('f', id % 3) as f", "'t' as t", "concat('s', id % 7) as s", "cast(null as timestamp) as at", "cast(id as string) as payload")
    out = aggregates.latest_with_provenance(df, "k", "f", "t", "s", [F.col("at"), F.col("f"), F.col("s")], ["f", "s", "payload"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [_row" in plan
    under_sort = [line for line in plan.splitlines() if "payload" in line and ("Window" in line or "SortMergeJoin" in line or "Exchange" in line)]
    assert not under_sort and "Exchange hashpartitioning(_row" in plan
    got = {r["k"]: r for r in out.collect()}
    want = {}
    for i in range(400):
        want.setdefault(f"k{i % 40}", []).append((f"f{i % 3}", f"s{i % 7}", str(i)))
    assert len(got) == 40
    for k, rows in want.items():
        r = got[k]
        assert (r["f"], r["s"]) == max(rows)[:2] and (r["f"], r["s"], r["payload"]) in rows and r["duplicate_source_count"] == 10
        assert r["duplicate_source_files"] == " | ".join(sorted({f for f, _, _ in rows})) and r["duplicate_content_variant_count"] == len({s for _, s, _ in rows})
