"""Chronological splits, baselines, gradient-boosted trees and sequence training data."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from epitide import schema
from epitide.functions import measures
from epitide.operators import aggregates, joins, windows

SERIES = ["location_code", "disease"]


def _split_label(date: str, lo: Column, hi: Column, train: float, valid: float) -> Column:
    days = F.greatest(F.datediff(hi, lo), F.lit(1))
    train_cut = F.date_add(lo, F.floor(days * F.lit(train)).cast("int"))
    valid_cut = F.date_add(lo, F.floor(days * F.lit(train + valid)).cast("int"))
    return (
        F.when(F.col(date) <= train_cut, "train").when(F.col(date) <= valid_cut, "validation").otherwise("test")
    )


def time_split(df: DataFrame, date: str = "date", train: float = 0.70, valid: float = 0.15, by: list[str] | None = None) -> DataFrame:
    """Label rows train / validation / test by the date span, never shuffled.

    Without groups the bounds are scalar subqueries; with groups they are aggregated and joined back.
    """
    if not by:
        rows = aggregates.attach(df, df.agg(F.min(date).alias("_lo"), F.max(date).alias("_hi")))
        return rows.withColumn("split", _split_label(date, F.col("_lo"), F.col("_hi"), train, valid)).drop("_lo", "_hi")
    bounds = df.groupBy(*by).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    return df.join(bounds, by).withColumn("split", _split_label(date, F.col("_lo"), F.col("_hi"), train, valid)).drop("_lo", "_hi")


def require_partitions(df: DataFrame, labels: tuple[str, ...] = ("train", "validation", "test")) -> None:
    """Fail when the time split left a part empty (one small aggregate on the driver)."""
    row = df.agg(*(F.count_if(F.col("split") == label).alias(label) for label in labels)).first()
    empty = [label for label in labels if row[label] == 0]
    if empty:
        raise ValueError(f"the time split produced empty partitions: {', '.join(empty)}")


def baselines(features: DataFrame) -> DataFrame:
    """Last-value and moving-average forecasts at the native frequency."""
    native = F.when(F.col("frequency") == "daily", F.col("new_cases_smoothed")).otherwise(F.col("value"))
    return features.withColumns({
        "prediction_naive_last_value": F.coalesce(native, F.lit(0.0)),
        "prediction_moving_average": F.coalesce("rolling_mean_7", native, F.lit(0.0)),
    })


def long_predictions(df: DataFrame, keep: list[str], models: list[str]) -> DataFrame:
    """One row per model from the prediction_<model> columns."""
    pairs = [F.struct(F.lit(m).alias("model"), F.col(f"prediction_{m}").alias("prediction")) for m in models]
    return df.select(*keep, F.inline(F.array(*pairs)))


def baseline_test_rows(features: DataFrame, by: str = "disease") -> DataFrame:
    """Rows after 85 % of the disease's date span; a disease with one date gives its last 15 % of rows."""
    scope = baselines(features).where("target_t_plus_7 IS NOT NULL")
    bounds = scope.groupBy(by).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"), F.count("*").alias("_n"))
    days = F.greatest(F.datediff("_hi", "_lo"), F.lit(1))
    cut = F.date_add("_lo", F.floor(days * F.lit(0.85)).cast("int"))
    spans = scope.join(bounds.where("_hi > _lo"), by).where(F.col("date") > cut)
    # Only diseases with one date are ranked, at most one row per location; the branch is empty where there is none.
    last = Window.partitionBy(by, "date").orderBy(F.desc("location_code"))
    tail = F.greatest(F.ceil(F.col("_n") * F.lit(0.15)), F.lit(1))
    single = scope.join(bounds.where("_hi = _lo"), by).withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= tail)
    return spans.unionByName(single.drop("_rn")).drop("_lo", "_hi", "_n")


def baseline_comparison(features: DataFrame, by: str = "disease") -> DataFrame:
    """Metrics of both baselines per disease on its test rows."""
    test = baseline_test_rows(features, by)
    long = long_predictions(test, [by, "target_t_plus_7"], ["naive_last_value", "moving_average"])
    return aggregates.regression_metrics(long, "target_t_plus_7", "prediction", [by, "model"])


def select_best(features: DataFrame, metrics: DataFrame, models: list[str]) -> DataFrame:
    """Winning prediction column per disease, moving average where it has no value."""
    best = aggregates.best_model(metrics, ["disease"]).select("disease", "best_model")
    rows = features.join(best, "disease", "left")
    picked = F.coalesce(*(F.when(F.col("best_model") == m, F.col(f"prediction_{m}")) for m in models))
    return rows.withColumn("prediction_t_plus_7", F.coalesce(picked, F.col("prediction_moving_average")))


def train_medians(train: DataFrame, numeric: list[str]) -> dict[str, float]:
    """Exact median of each column over the train rows; one number per column."""
    return {r["column_name"]: r["median"] for r in aggregates.exact_medians(train, numeric).collect()}


def feature_stages(medians: dict[str, float]) -> list:
    """Index and encode the location, put the train medians in place of missing values, assemble."""
    filled = ", ".join(f"coalesce(nanvl({c}, null), {m!r}D) AS {c}_imp" for c, m in medians.items())
    return [
        StringIndexer(inputCol="location_code", outputCol="location_idx", handleInvalid="keep"),
        OneHotEncoder(inputCols=["location_idx"], outputCols=["location_vec"], handleInvalid="keep"),
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[*(f"{c}_imp" for c in medians), "location_vec"], outputCol="features"),
    ]


def as_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def usable_numeric(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least one value; a median of nothing cannot be imputed."""
    row = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] > 0]


def fit_gbt(train: DataFrame, numeric: list[str], trees: int = 60, depth: int = 5, seed: int = 2026) -> PipelineModel:
    """Gradient-boosted trees on the log target.

    The tree ensemble keeps its lineage short through the checkpoint folder of the session.
    """
    gbt = GBTRegressor(
        featuresCol="features", labelCol="target_log", predictionCol="prediction_log",
        maxIter=trees, maxDepth=depth, seed=seed,
    )
    return Pipeline(stages=[*feature_stages(train_medians(train, numeric)), gbt]).fit(train)


def gbt_predict(model: PipelineModel, df: DataFrame, out: str = "prediction_gbt") -> DataFrame:
    scored = model.transform(df).withColumn(out, measures.inverse_log_target("prediction_log"))
    return scored.drop("features", "location_vec", "location_idx", "prediction_log")


def tree_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a saved ensemble as rows: tree, weight, node, feature, threshold or categories, left, right, value.

    A leaf has no children (-1). A node goes left on a value up to its threshold, or on one of its categories.
    """
    stage = f"{path}/stages/*GBTRegressor*"
    # Saved without column names: tree, description, weight; and tree, node.
    weights = spark.read.parquet(f"{stage}/treesMetadata").toDF("tree", "_about", "weight").drop("_about")
    split = F.col("nodeData.split")
    nodes = spark.read.parquet(f"{stage}/data").toDF("tree", "nodeData").select(
        "tree", F.col("nodeData.id").alias("node"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.prediction").alias("value"), split.featureIndex.alias("feature"),
        F.when(split.numCategories < 0, F.get(split.leftCategoriesOrThreshold, F.lit(0))).alias("threshold"),
        F.when(split.numCategories >= 0, split.leftCategoriesOrThreshold).alias("categories"),
    )
    return nodes.join(weights, "tree")


def predict_with_nodes(assembled: DataFrame, nodes: DataFrame, depth: int = 5, out: str = "prediction_nodes") -> DataFrame:
    """The forecast of each row (with its assembled `features`) by walking the node relation with column expressions.

    The relation has at most 2 ** (depth + 1) nodes per tree, whatever the data, and comes to the rows as one value.
    """
    fields = ("feature", "threshold", "categories", "left", "right", "value")
    trees = nodes.groupBy("tree", "weight").agg(F.array_sort(F.collect_list(F.struct("node", *fields))).alias("nodes"))
    whole = trees.agg(F.array_sort(F.collect_list(F.struct("tree", "weight", "nodes"))).alias("_trees"))
    rows = aggregates.attach(assembled.withColumn("_x", vector_to_array("features")), whole)

    def step(tree: Column, at: Column) -> Column:
        node = tree["nodes"][at]
        x = F.get("_x", node["feature"])
        goes_left = F.when(node["categories"].isNull(), x <= node["threshold"]).otherwise(F.array_contains(node["categories"], x))
        return F.when(node["left"] < 0, at).when(goes_left, node["left"]).otherwise(node["right"])

    def leaf(tree: Column) -> Column:
        at = F.lit(0)
        return tree["nodes"][F.aggregate(F.sequence(F.lit(1), F.lit(depth)), at, lambda a, _: step(tree, a))]["value"]

    total = F.aggregate("_trees", F.lit(0.0), lambda a, t: a + t["weight"] * leaf(t))
    return rows.withColumn(out, measures.inverse_log_target(total)).drop("_trees", "_x")


def evaluate(scored: DataFrame, models: dict[str, str], baseline: str) -> DataFrame:
    """Metrics per model and whether each beats the baseline."""
    pairs = [F.struct(F.lit(name).alias("model"), F.col(c).alias("prediction")) for name, c in models.items()]
    long = scored.select("target_t_plus_7", F.inline(F.array(*pairs)))
    metrics = aggregates.regression_metrics(long, "target_t_plus_7", "prediction", ["model"])
    base = metrics.where(F.col("model") == baseline).select("mae").scalar()
    return metrics.withColumn("baseline_mae", base).withColumn("beats_baseline", F.col("mae") < F.col("baseline_mae"))


def sequence_set(
    features: DataFrame, length: int, frequency: str = "daily", horizon: int | None = None, max_gap: int | None = None,
    value: str | None = None,
) -> DataFrame:
    """Look-back windows with observed-only targets and a chronological split.

    Series are put on a regular calendar, short gaps are interpolated for inputs only, and a target is
    never an imputed value.
    """
    if length < 2:
        raise ValueError("a window needs at least two periods")
    value = value or ("new_cases_smoothed" if frequency == "daily" else "value")
    horizon = horizon or schema.HORIZON_STEPS[frequency]
    regular = regular_series(features, frequency, value, max_gap)
    rows = windows.window_arrays(regular, SERIES, "date", "series_value", length, horizon, average=schema.ROLLING_WINDOW[frequency])
    known = rows.where("target IS NOT NULL")
    bounds = known.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    split = F.when(F.col("target").isNull(), "forecast_only").otherwise(
        _split_label("date", F.col("_lo"), F.col("_hi"), 0.70, 0.15)
    )
    return aggregates.attach(rows, bounds).withColumn("split", split).drop("_lo", "_hi", "series_value")


def regular_series(features: DataFrame, frequency: str, value: str, max_gap: int | None = None) -> DataFrame:
    """Series on their calendar with values clipped at zero and short gaps filled."""
    max_gap = schema.MAX_GAP[frequency] if max_gap is None else max_gap
    scope = features.where((F.col("frequency") == frequency) & F.col(value).isNotNull())
    scope = scope.select(*SERIES, "date", measures.clip_zero(F.col(value).cast("double")).alias("series_value"))
    grid = joins.calendar_grid(scope, SERIES, "date", frequency)
    return windows.interpolate(grid, SERIES, F.unix_date("date"), "series_value", limit=max_gap, order="date", flag="is_imputed")


def sequence_counters(features: DataFrame, length: int, frequency: str, value: str, max_gap: int | None = None) -> DataFrame:
    """Calendar rows inserted, values imputed, windows skipped because of a gap."""
    regular = regular_series(features, frequency, value, max_gap)
    w = Window.partitionBy(*SERIES).orderBy("date")
    known = F.count("series_value").over(w.rowsBetween(1 - length, 0))
    skipped = F.col("is_observed") & (F.col("_pos") >= length) & (F.col("_known") < length)
    return regular.withColumns({"_pos": F.row_number().over(w), "_known": known}).agg(
        F.count_if(~F.col("is_observed")).alias("calendar_rows_inserted"),
        F.count_if("is_imputed").alias("input_values_imputed"),
        F.count_if(skipped).alias("windows_skipped"),
    )


def log_scaler(sequences: DataFrame) -> DataFrame:
    """Mean and deviation of log1p over the train windows; a value counts once per window holding it.

    Each window is summed inside its row, so nothing is exploded.
    """
    logs = F.transform("input_window", F.log1p)
    sums = sequences.where("split = 'train'").select(
        F.aggregate(logs, F.lit(0.0), lambda a, v: a + v).alias("s"),
        F.aggregate(logs, F.lit(0.0), lambda a, v: a + v * v).alias("q"),
        F.size("input_window").alias("n"),
    )
    mean = F.sum("s") / F.sum("n")
    return sums.agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))).alias("std"))


def standardise(sequences: DataFrame) -> DataFrame:
    """Windows and targets on the log scale, standardised with train statistics."""
    scaler = log_scaler(sequences).select(F.col("mean").alias("_m"), F.coalesce(F.nullif("std", F.lit(0.0)), F.lit(1.0)).alias("_s"))
    rows = aggregates.attach(sequences, scaler)
    return rows.withColumns({
        "input_scaled": F.transform("input_window", lambda v: (F.log1p(v) - F.col("_m")) / F.col("_s")),
        "target_scaled": (F.log1p(measures.clip_zero("target")) - F.col("_m")) / F.col("_s"),
    }).drop("_m", "_s")


def prediction_rows(sequences: DataFrame, prediction: Column, model: str) -> DataFrame:
    """Prediction table with split label and error."""
    return sequences.select(
        F.lit(model).alias("model"), *SERIES, "date", F.col("target").alias("actual_t_plus_7"),
        F.col("current_value").alias("naive_last_value"), "moving_average", prediction.alias("prediction"), "split",
    ).withColumn("error", measures.error("prediction", "actual_t_plus_7"))


def prediction_export(features: DataFrame, models: list[str], n: int | None) -> DataFrame:
    """Rows with a known target, all or the last n per series, one column per model."""
    rows = features.where("target_t_plus_7 IS NOT NULL")
    rows = windows.last_n(rows, SERIES, [F.desc("date")], n) if n is not None else rows
    return rows.select(
        "date", *SERIES, F.col("target_t_plus_7").alias("actual_t_plus_7"), F.col("prediction_t_plus_7").alias("prediction"),
        measures.error("prediction_t_plus_7", "target_t_plus_7").alias("error"), *(f"prediction_{m}" for m in models),
    )
