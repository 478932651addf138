"""Every registered query against its SQL, plus the driver contract."""

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()
SLOW = {"mlt06_gradient_boosted_trees", "mlt07_model_evaluation", "snk07_model_persistence"}


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, bool) or x is None or not isinstance(x, (int, float)):
            return str(x)
        return f"{float(x):.4f}"

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_sql(spark, duck, tables, name):
    df = QUERIES[name](spark, tables)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = canonical(result.fetchall(), names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if x != y:
                # Sums of rounded doubles may differ in the last printed digit.
                assert float(x) == pytest.approx(float(y), abs=2e-4), (name, a, b)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n not in SLOW])
def test_rows_only_query_runs(spark, tables, name):
    assert QUERIES[name](spark, tables).count() > 0


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in ORACLES.values()) and set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["pip14_multi_frequency_features", "qlt05_dataset_overlap", "qlt08_source_reconciliation", "qlt09_serving_report", "qry01_overview", "sca33_topic_discovery", "joi12_calendar_grid", "mlt01_chronological_split"])
def test_plans_have_no_cross_join_and_no_python(spark, tables, name):
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert word not in plan


def test_feature_windows_share_one_sort(spark):
    from pyspark.sql import functions as F

    from epitide.operators import windows

    df = spark.range(100).select(
        F.lit("A").alias("location_code"), (F.col("id") % 3).cast("string").alias("disease"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        F.lit("daily").alias("frequency"), F.col("id").cast("double").alias("value"), F.lit(None).cast("double").alias("published_smoothed"),
    )
    plan = windows.frequency_features(df, ["location_code", "disease"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("- Sort [") + plan.count(" Sort [") <= 2
    assert plan.count("Window [") == 2


def test_filters_and_columns_reach_the_scan(spark, tables):
    from epitide.catalog.views import Views
    from epitide.plans import serving

    rows = serving.filter_series(Views(spark, tables).gold, "NAD", "COVID-19", "1997-01-01").select("date", "value")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(location_code,NAD)" in plan and "growth_rate_7" not in plan


def test_names_are_unique():
    from epitide.catalog import all_queries

    names = [q.name for q in all_queries()]
    assert len(names) == len(set(names))


def test_gradient_boosting_beats_nothing_but_runs(spark, tables):
    from epitide.catalog.modelling import trained
    from epitide.catalog.views import Views
    from epitide.plans import forecasting

    rows, model = trained(Views(spark, tables))
    scored = forecasting.gbt_predict(model, rows.where("split = 'test'"))
    metrics = {r["model"]: r for r in forecasting.evaluate(scored, {"gbt": "prediction_gbt", "moving_average": "rolling_mean_7"}, "moving_average").collect()}
    assert metrics["moving_average"]["beats_baseline"] is False and metrics["gbt"]["rows"] == scored.count()
    assert scored.where("prediction_gbt < 0").count() == 0


def test_pages_with_one_url_or_none_are_all_reported(spark, tmp_path):
    spark.sql("select id as page_id, case when id = 7 then null else concat('https://a.example.com/en/', id % 3, if(id % 4 = 0, '/', '')) end as url, '' as html from range(12)").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df = QUERIES["pip10_report_pages"](spark, str(tmp_path))
    result = con.execute(ORACLES["pip10_report_pages"])
    want = canonical(result.fetchall(), [c[0] for c in result.description])
    assert len(want) == 12 and canonical([tuple(r) for r in df.collect()], df.columns) == want


def test_catalog_files_are_written_by_many_tasks(spark, tables, tmp_path, monkeypatch):
    """Rows of one file come from every task that read them; none is held, sorted and written by one task."""
    from epitide.catalog import assembling
    from epitide.catalog.views import Views
    from epitide.sources import scratch

    folder, setting = tmp_path / "in", "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.read.parquet(f"{tables}/events.parquet").repartition(4).write.parquet(str(folder / "events.parquet"))
    for t in ("nation", "region", "customer", "orders", "supplier", "lineitem"):
        (folder / f"{t}.parquet").symlink_to(f"{tables}/{t}.parquet")
    numbers = iter(range(100))
    monkeypatch.setattr(scratch, "shared_dir", lambda s, name: f"{tmp_path}/{name}-{next(numbers)}")
    assert assembling.catalog(Views(spark, str(folder))).count() > 0
    folders = list(tmp_path.glob("indicator-files-*/file=*"))
    assert len(folders) == 18 and min(len(list(f.glob("*.csv"))) for f in folders) > 1
    assert spark.conf.get(setting) == before


def test_features_read_orders_and_line_items_once(spark, tables):
    """Every frequency starts from the kept daily tables; the plan of the features reads no raw orders or line items."""
    from epitide.catalog.views import Views

    read = Views(spark, tables).features.inputFiles()
    assert any("/events.parquet" in f for f in read)
    assert not any("/orders.parquet" in f or "/lineitem.parquet" in f for f in read)
