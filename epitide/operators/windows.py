"""Window operators over series.

A series is one (location, disease) at one row per date, so its length is bounded by the calendar
however many raw rows were aggregated into it. Operators that see raw rows (keep_latest, last_n)
filter on row_number, which Spark prunes with a partial group limit before the shuffle: a hot key
sends at most n rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from epitide import schema
from epitide.functions import measures


def series_window(by: list[str], order: str | Column) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given total order (nulls last, tie-breakers included)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The n first rows per key in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def diff_cumulative(
    df: DataFrame, by: list[str], date: str, cols: dict[str, str], first: str = "own"
) -> DataFrame:
    """Running totals to per-period values; the first one is its own total, or null."""
    w = series_window(by, date)

    def change(total: str) -> Column:
        step = F.col(total) - F.lag(total).over(w)
        if first == "null":
            return step
        return F.when(F.lag(total).over(w).isNull(), F.col(total)).otherwise(step)

    return df.withColumns({out: change(total) for total, out in cols.items()})


def dense_difference(df: DataFrame, by: list[str], date: str, value: str, out: str = "change") -> DataFrame:
    """Running totals of a date matrix to per-date values: rows of one date are summed, the first date keeps its total.

    A group's totals become one array ordered by date, bounded by the calendar; the array is set against itself shifted
    by one and exploded once. The dates are data and never columns, so the plan does not grow with the calendar.
    """
    totals = df.where(F.col(value).isNotNull()).groupBy(*by, date).agg(F.sum(value).alias("_total"))
    series = totals.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(date, "_total"))).alias("_t"))
    before = F.concat(F.array(F.lit(0).cast("double")), F.transform("_t", lambda x: x["_total"].cast("double")))
    step = F.zip_with("_t", F.slice(before, 1, F.size("_t")), lambda x, p: F.struct(x[date].alias(date), (x["_total"] - p).alias(out)))
    return series.select(*by, F.inline(step))


def published_or_difference(df: DataFrame, by: list[str], date: str, published: str, total: str, out: str) -> DataFrame:
    """Published value where there is one, else the difference of the running total."""
    w = series_window(by, date)
    return df.withColumn(out, F.coalesce(F.col(published), F.col(total) - F.lag(total).over(w)))


def lags(df: DataFrame, by: list[str], date: str, col: str, ns: tuple[int, ...] = (1, 3, 7, 14)) -> DataFrame:
    w = series_window(by, date)
    return df.withColumns({f"lag_{n}": F.lag(col, n).over(w) for n in ns})


def rolling_mean(df: DataFrame, by: list[str], date: str, col: str, windows: tuple[int, ...] = (3, 7, 14)) -> DataFrame:
    """Mean of the last n rows, available from the first row on."""
    w = series_window(by, date)
    return df.withColumns({f"rolling_mean_{n}": F.avg(col).over(w.rowsBetween(1 - n, 0)) for n in windows})


def _std(col: str, w: WindowSpec, n: int) -> Column:
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(col).over(frame) >= 2, F.stddev_pop(col).over(frame))


def rolling_std(df: DataFrame, by: list[str], date: str, col: str, windows: tuple[int, ...] = (7, 14)) -> DataFrame:
    """Population deviation of the last n rows, null below two values."""
    w = series_window(by, date)
    return df.withColumns({f"rolling_std_{n}": _std(col, w, n) for n in windows})


def by_frequency(frequency: str, make) -> Column:
    """Choose between the daily, weekly and annual form of an expression."""
    f = F.col(frequency)
    return F.when(f == "daily", make("daily")).when(f == "weekly", make("weekly")).otherwise(make("annual"))


def frequency_features(
    df: DataFrame, by: list[str], date: str = "date", value: str = "value",
    frequency: str = "frequency", published: str | None = "published_smoothed",
) -> DataFrame:
    """Rolling, lag, growth and target columns at the native frequency of each series.

    All frames share one partitioning and one order, so the whole block costs one shuffle.
    """
    # One integer day column orders every row and range frame, so the block has a single sort.
    w = series_window(by, "_day")

    def narrow(kind: str) -> int:
        return schema.ROLLING_WINDOW[kind]

    def wide(kind: str) -> int:
        return max(2 * schema.ROLLING_WINDOW[kind], 3)

    def mean(n: int) -> Column:
        return F.avg(value).over(w.rowsBetween(1 - n, 0))

    out = df.withColumn("_day", F.unix_date(F.col(date))).withColumns({
        "rolling_mean_3": mean(3),
        "rolling_mean_7": by_frequency(frequency, lambda k: mean(narrow(k))),
        "rolling_mean_14": by_frequency(frequency, lambda k: mean(wide(k))),
        "rolling_std_7": by_frequency(frequency, lambda k: _std(value, w, narrow(k))),
        "rolling_std_14": by_frequency(frequency, lambda k: _std(value, w, wide(k))),
        "horizon_steps": by_frequency(frequency, lambda k: F.lit(schema.HORIZON_STEPS[k])),
    })
    smoothed = F.col("rolling_mean_7")
    if published:
        smoothed = F.coalesce(F.col(published), smoothed)
    out = out.withColumn("new_cases_smoothed", smoothed).withColumn(
        "_ahead", F.when(F.col(frequency) == "daily", F.col("new_cases_smoothed")).otherwise(F.col(value))
    )
    steps = schema.HORIZON_STEPS
    out = out.withColumns({
        **{f"lag_{n}": F.lag("new_cases_smoothed", n).over(w) for n in (1, 3, 7, 14)},
        "target_t_plus_7": by_frequency(frequency, lambda k: _ahead(w, date, "_ahead", k, steps[k])),
    })
    # The growth horizon is one of the lags: seven days, one week or one year.
    prior = by_frequency(frequency, lambda k: F.col(f"lag_{schema.GROWTH_STEPS[k]}"))
    return out.withColumns({
        "growth_rate_1": measures.growth("new_cases_smoothed", "lag_1"),
        "growth_rate_7": measures.growth("new_cases_smoothed", prior),
    }).drop("_day", "_ahead")


def lead_target(df: DataFrame, by: list[str], date: str, value: str, h: int, out: str = "target") -> DataFrame:
    """Value h rows later."""
    return df.withColumn(out, F.lead(value, h).over(series_window(by, date)))


def _ahead(w: WindowSpec, date: str, value: str, frequency: str, steps: int) -> Column:
    """Value at exactly `steps` periods later; the window must be ordered by a day number."""
    if frequency != "annual":
        days = steps * (7 if frequency == "weekly" else 1)
        return F.max(value).over(w.rangeBetween(days, days))
    # n calendar years are 365 n days plus the leap days in between; the exact date is checked.
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(date).alias("d"), F.col(value).alias("v")))
    found = F.max(point).over(w.rangeBetween(365 * steps, 365 * steps + steps // 4 + 1))
    return F.when(found["d"] == F.add_months(F.col(date), 12 * steps), found["v"])


def exact_target(
    df: DataFrame, by: list[str], date: str, value: str, out: str = "target", horizon: int | None = None, frequency: str = "daily"
) -> DataFrame:
    """Value at exactly date + horizon, null when that date is missing.

    A one-point range frame over the day number finds it inside the partitioning the other features
    use; a self join would shuffle both sides again.
    """
    w = series_window(by, "_day")
    found = _ahead(w, date, value, frequency, horizon or schema.HORIZON_STEPS[frequency])
    return df.withColumn("_day", F.unix_date(F.col(date))).withColumn(out, found).drop("_day")


def trailing_run(
    df: DataFrame, by: list[str], date: str, value: str, frequency: str | None = None,
    stale_after: dict[str, int] | None = None,
) -> DataFrame:
    """Per series: last non-zero date and value, length of the zero run at the end, stale flag.

    A missing value ends the run, as a non-zero value does.
    """
    zero = F.abs(F.col(value)) <= 1e-12
    w = Window.partitionBy(*by)
    ends_run = F.when(F.coalesce(zero, F.lit(False)), None).otherwise(F.col(date))
    marked = df.withColumn("_break", F.max(ends_run).over(w))
    nonzero = F.when(F.abs(F.col(value)) > 1e-12, F.struct(F.col(date).alias("d"), F.col(value).alias("v")))
    aggs = [
        F.max(date).alias("latest_date"),
        F.max(nonzero).alias("_nz"),
        F.count_if(F.col("_break").isNull() | (F.col(date) > F.col("_break"))).alias("trailing_zero_periods"),
    ]
    if frequency:
        aggs.append(F.max(frequency).alias("frequency"))
    out = marked.groupBy(*by).agg(*aggs)
    out = out.withColumns({"last_nonzero_date": F.col("_nz.d"), "last_nonzero_value": F.col("_nz.v")}).drop("_nz")
    limits = stale_after or schema.STALE_AFTER
    if frequency:
        table = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
        limit = F.coalesce(F.try_element_at(table, F.col("frequency")), F.lit(schema.STALE_DEFAULT))
    else:
        limit = F.lit(limits["daily"])
    return out.withColumn("reporting_stale", F.col("trailing_zero_periods") >= limit)


def _sides(by: list[str], axis: Column) -> tuple[WindowSpec, WindowSpec]:
    """Rows up to this one, and rows from this one on.

    Looking ahead is a running frame in descending order: a frame that ends at the last row would be
    evaluated anew for every row.
    """
    head = (Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(axis.desc())
    return series_window(by, axis).rowsBetween(*head), ahead.rowsBetween(*head)


def interpolate(
    df: DataFrame, by: list[str], x: str | Column, y: str, out: str | None = None,
    flag: str = "is_interpolated", limit: int | None = None, order: str | None = None,
) -> DataFrame:
    """Linear interpolation strictly between known points.

    With a limit only the first `limit` rows of a gap are filled.
    """
    out = out or y
    x = F.col(x) if isinstance(x, str) else x
    axis = F.col(order) if order else x
    before, after = _sides(by, axis)
    here = F.struct(x.cast("double").alias("x"), F.col(y).alias("y"), F.col("_at").alias("at"))
    known = F.when(F.col(y).isNotNull(), here)
    staged = df.withColumn("_at", F.row_number().over(series_window(by, axis))).withColumns({
        "_here": here,
        "_left": F.last(known, ignorenulls=True).over(before),
        "_right": F.last(known, ignorenulls=True).over(after),
    })
    share = F.try_divide(F.col("_here.x") - F.col("_left.x"), F.col("_right.x") - F.col("_left.x"))
    line = F.col("_left.y") + (F.col("_right.y") - F.col("_left.y")) * share
    inside = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    if limit is not None:
        inside = inside & (F.col("_at") - F.col("_left.at") <= limit)
    filled = F.when(F.col("_here.y").isNotNull(), F.col("_here.y")).when(inside, line)
    return staged.withColumns({out: filled, flag: F.col("_here.y").isNull() & filled.isNotNull()}).drop(
        "_at", "_here", "_left", "_right"
    )


def fill(df: DataFrame, by: list[str], x: str, cols: list[str], direction: str = "forward") -> DataFrame:
    """Carry the last known value forward; 'both' also fills the head backwards.

    Backward filling uses later values, so it is never a default.
    """
    before, after = _sides(by, F.col(x))

    def filled(c: str) -> Column:
        value = F.last(c, ignorenulls=True).over(before)
        if direction == "both":
            value = F.coalesce(value, F.last(c, ignorenulls=True).over(after))
        return value

    return df.withColumns({c: filled(c) for c in cols})


def minmax(df: DataFrame, by: list[str], cols: dict[str, str]) -> DataFrame:
    """Min-max scaling per group; a constant group and missing values give 0.

    Bounds come from a partial aggregate joined back, so a group that holds a third of all rows
    is never gathered in one task.
    """
    present = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    bounds = df.groupBy(*by).agg(
        *(F.min(v).alias(f"_lo_{c}") for c, v in present.items()),
        *(F.max(v).alias(f"_hi_{c}") for c, v in present.items()),
    )
    keyed = df.join(bounds.withColumnsRenamed({k: f"_by_{k}" for k in by}),
                    [df[k].eqNullSafe(F.col(f"_by_{k}")) for k in by], "left")

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        close = F.abs(hi - lo) <= F.lit(1e-9) * F.greatest(F.abs(hi), F.abs(lo))
        return F.when(close, F.lit(0.0)).otherwise(
            F.try_divide(present[c] - lo, hi - lo)
        )

    return keyed.withColumns({out: scaled(c) for c, out in cols.items()}).drop(
        *(f"_lo_{c}" for c in cols), *(f"_hi_{c}" for c in cols), *(f"_by_{k}" for k in by)
    )


def window_arrays(
    df: DataFrame, by: list[str], date: str, value: str, length: int, horizon: int,
    observed: str = "is_observed", average: int = 7,
) -> DataFrame:
    """Fixed-length look-back arrays on a regular calendar.

    Kept are observed rows whose whole window is known; the target is only taken from an observed
    row exactly `horizon` positions ahead. The current value and a moving average ride along.
    """
    w = series_window(by, date)
    frame = w.rowsBetween(1 - length, 0)
    ahead = F.lead(F.when(F.col(observed), F.col(value)), horizon).over(w)
    return (
        df.withColumns({
            "input_window": F.collect_list(value).over(frame),
            "target": ahead,
            "current_value": F.col(value),
            "moving_average": F.avg(value).over(w.rowsBetween(1 - average, 0)),
        })
        # collect_list leaves nulls out, so a short array is a window with a gap.
        .where(F.col(observed) & (F.size("input_window") == length))
    )


def running_total(df: DataFrame, by: list[str], date: str, col: str, out: str) -> DataFrame:
    w = series_window(by, date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(col).over(w))


def positional_split(df: DataFrame, date: str, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """Split by the position of a date among the distinct dates.

    The ranking runs over distinct dates only (calendar-bounded), never over the rows.
    """
    dates = df.select(date).distinct().withColumn("_pos", F.row_number().over(Window.orderBy(date)) - 1)
    total = df.agg(F.count_distinct(F.col(date))).scalar()
    n = F.col("_n")
    last_train = F.greatest(F.lit(0), F.least(n - 1, F.floor(n * train).cast("int") - 1))
    last_valid = F.greatest(last_train + 1, F.least(n - 1, F.floor(n * (train + valid)).cast("int") - 1))
    cut = dates.withColumn("_n", total).select(
        date,
        F.when(F.col("_pos") <= last_train, "train")
        .when(F.col("_pos") <= last_valid, "validation")
        .otherwise("test")
        .alias("split"),
    )
    return df.join(cut, date)
