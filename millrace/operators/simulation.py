"""Path statistics of simulated or observed series: long tables (path, session, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import quantile_nearest
from millrace.sources.shared import stored


def path_window(path: str, session: str) -> Window:
    return Window.partitionBy(path).orderBy(session)


def returns(df: DataFrame, path: str, session: str, value: str) -> DataFrame:
    """Log returns in each path; the first session has none."""
    before = F.lag(value).over(path_window(path, session))
    return df.withColumn("log_return", F.ln(F.try_divide(F.col(value), before))).where(F.col("log_return").isNotNull())


def drawdowns(df: DataFrame, path: str, session: str, value: str) -> DataFrame:
    peak = F.max(value).over(path_window(path, session).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("peak", peak).withColumn("drawdown", 1 - F.try_divide(F.col(value), F.col("peak")))


def depth_shares(df: DataFrame, path: str, session: str, value: str, percents: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """For each path the share of sessions deeper than so many percent below the peak so far."""
    d = drawdowns(df, path, session, value)
    return d.groupBy(path).agg(*[F.avg((F.col("drawdown") > p / 100).cast("double")).alias(f"below_{p}") for p in percents])


def episodes(df: DataFrame, path: str, session: str, value: str, least_percent: float) -> DataFrame:
    """Peak to recovery islands of at least a depth: path, start, end, depth, sessions, recovered (false: cut off by the path's end)."""
    d = drawdowns(df, path, session, value)
    w = path_window(path, session)
    island = d.withColumn("island", F.sum((F.col(value) >= F.col("peak")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(session).over(Window.partitionBy(path))
    under = island.withColumn("__last", last).where("drawdown > 0").groupBy(path, "island").agg(F.min(session).alias("start"), F.max(session).alias("end"), F.max("drawdown").alias("depth"), F.count(F.lit(1)).alias("sessions"), F.max("__last").alias("__last"))
    return under.where(F.col("depth") * 100 >= least_percent).select(path, "start", "end", "depth", "sessions", (F.col("end") < F.col("__last")).alias("recovered"))


def depth_at_exhaustion(df: DataFrame, path: str, session: str, value: str, buffer: int) -> DataFrame:
    """path, peak_at and depth of each stretch below a peak: the worst depth from `buffer` sessions after the peak on, NULL where the stretch ends before."""
    d = drawdowns(df, path, session, value)
    w = path_window(path, session)
    island = d.withColumn("__island", F.sum((F.col(value) >= F.col("peak")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = island.withColumn("__place", F.row_number().over(Window.partitionBy(path, "__island").orderBy(session)) - 1)  # the peak is at 0
    late = F.max(F.when((F.col("__place") >= buffer) & (F.col("__place") > 0), F.col("drawdown")))
    return place.groupBy(path, "__island").agg(F.min(session).alias("peak_at"), late.alias("depth"), F.max("__place").alias("__n")).where("__n > 0").select(path, "peak_at", "depth")


def trend_exposure(df: DataFrame, path: str, session: str, value: str, sessions: int, floor: float) -> DataFrame:
    """path, session, value and exposure: 1 where the value is at or above the mean of its last `sessions` (the first ones: of what there is), else the floor."""
    mean = F.avg(value).over(path_window(path, session).rowsBetween(1 - sessions, 0))
    return df.select(path, session, value, F.when(F.col(value) >= mean, 1.0).otherwise(float(floor)).alias("exposure"))


def drawdown_exposure(df: DataFrame, path: str, session: str, value: str, percent: float, floor: float) -> DataFrame:
    """path, session, value and exposure: the floor where the value is more than so many percent below its peak so far, else 1."""
    return drawdowns(df, path, session, value).select(path, session, value, F.when(F.col("drawdown") * 100 > percent, float(floor)).otherwise(1.0).alias("exposure"))


def grading(df: DataFrame, path: str, session: str, value: str, per_year: int = 252) -> DataFrame:
    """For each path: sessions, total return, yearly Sharpe ratio, worst drawdown, Calmar ratio and Ulcer index."""
    w = path_window(path, session)
    rows = drawdowns(df, path, session, value).withColumn("r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1)
    out = rows.groupBy(path).agg(F.count(F.lit(1)).alias("sessions"), F.min_by(value, session).alias("first"), F.max_by(value, session).alias("final"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.max("drawdown").alias("max_drawdown"), F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer"))
    total = F.try_divide(F.col("final"), F.col("first")) - 1
    yearly = F.pow(1 + total, F.try_divide(F.lit(float(per_year)), F.col("sessions") - 1)) - 1
    return out.select(path, "sessions", total.alias("total_return"), (F.try_divide(F.col("m"), F.col("s")) * per_year**0.5).alias("sharpe"), "max_drawdown", F.try_divide(yearly, F.col("max_drawdown")).alias("calmar"), "ulcer")


def combined_exposure(df: DataFrame, path: str, session: str, rules: list[DataFrame], how: str = "product") -> DataFrame:
    """path, session and exposure of several rules' exposures (tables with these columns): their product, or the least of them (least)."""
    out = df.select(path, session)
    for k, rule in enumerate(rules):
        out = out.join(rule.select(path, session, F.col("exposure").alias(f"__{k}")), [path, session])
    each = [F.col(f"__{k}") for k in range(len(rules))]
    total = F.aggregate(F.array(*each), F.lit(1.0), lambda a, b: a * b) if how == "product" else F.array_min(F.array(*each))
    return out.select(path, session, total.alias("exposure"))


def arm_path(df: DataFrame, path: str, session: str, price: str, exposure: str, cost: float = 0.0, safe: str | None = None, liquidity: str | None = None, prices: str | None = None) -> DataFrame:
    """What an exposure earns: path, session, exposure, step and log_equity, and with a column of consumer prices real_log_equity.

    A session's step is the exposure before it times the log return of the price, what is not
    exposed times the log return of `safe` (a column of prices; None: nothing), less the
    change of exposure times the cost and the session's liquidity. The first session has 0.
    """
    w = path_window(path, session)
    growth = lambda c: F.coalesce(F.ln(F.try_divide(F.col(c).cast("double"), F.lag(F.col(c).cast("double")).over(w))), F.lit(0.0))
    before = F.lag(exposure).over(w)
    change = F.abs(F.col(exposure) - before) * cost * (F.col(liquidity) if liquidity else F.lit(1.0))
    step = F.coalesce(before * growth(price) + (1 - before) * (growth(safe) if safe else F.lit(0.0)) - change, F.lit(0.0))
    rows = df.select(path, session, F.col(exposure).alias("exposure"), step.alias("step"), F.abs(F.col(exposure) - before).alias("turned"), *([F.ln(F.try_divide(F.col(prices).cast("double"), F.first(prices).over(w.rowsBetween(Window.unboundedPreceding, 0)))).alias("__dear")] if prices else []))
    equity = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("log_equity", equity)
    return out.withColumn("real_log_equity", F.col("log_equity") - F.col("__dear")).drop("__dear") if prices else out


def arm_totals(arm: DataFrame, path: str, session: str, years: float) -> DataFrame:
    """For each path of arm_path(): mean exposure, turnover a year, log growth a year in percent and the worst drawdown of the equity in percent."""
    w = path_window(path, session).rowsBetween(Window.unboundedPreceding, 0)
    rows = arm.withColumn("__below", 1 - F.exp(F.col("log_equity") - F.max("log_equity").over(w)))
    return rows.groupBy(path).agg(F.avg("exposure").alias("mean_exposure"), (F.coalesce(F.sum("turned"), F.lit(0.0)) / years).alias("churn"), (F.max_by("log_equity", session) / years * 100).alias("growth"), (F.max("__below") * 100).alias("max_drawdown"))


def withdrawal_rates(df: DataFrame, path: str, session: str, log_equity: str, every: int = 21, window: int = 360) -> DataFrame:
    """For each path the constant withdrawals, in percent of the start and per year of twelve, that its log equity sustains: path, starts, median_rate and worst_rate.

    Every `every`-th session is a month; from each month on which `window` more follow, the
    rate is 1200 / sum of exp(C at the start - C) over those. The median is the upper one.
    Paths that are too short have no row.
    """
    w = path_window(path, session)
    months = df.withColumn("__n", F.row_number().over(w) - 1).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(path)))
    months = months.where((F.col("__n") % every == 0) & (F.col("__n") < F.floor(F.col("__all") / every) * every))
    c = months.withColumn("__c", F.col(log_equity) - F.first(log_equity).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = w.rowsBetween(1, window)
    rates = c.withColumns({"__s": F.sum(F.exp(-F.col("__c"))).over(ahead), "__k": F.count(F.lit(1)).over(ahead)}).where(F.col("__k") == window)
    rates = rates.select(path, (1200 / (F.exp("__c") * F.col("__s"))).alias("rate"))
    return rates.groupBy(path).agg(F.count(F.lit(1)).alias("starts"), upper_median("rate").alias("median_rate"), F.min("rate").alias("worst_rate"))


def upper_median(c: str):
    """The value at place n / 2 of the sorted ones of one path; NULL and NaN are left out."""
    kept = F.array_sort(F.collect_list(F.when(~F.isnan(c), F.col(c))))
    return F.get(kept, F.floor(F.size(kept) / 2).cast("int"))


def measure(df: DataFrame, path: str, session: str, value: str, years: float, least_percent: float = 15.0, per_year: int = 252) -> DataFrame:
    """One row for all paths: medians over the paths of yearly volatility, kurtosis, autocorrelations of absolute returns at lags 1 and 20, log growth
    a year in percent and the shares of sessions below the peak; and of the drawdowns of least_percent or more their number, number a path,
    median and worst depth and how many the path's end cuts off."""
    w = path_window(path, session)
    rows = returns(df, path, session, value).withColumn("__a", F.abs("log_return"))
    rows = rows.withColumns({"__1": F.lag("__a", 1).over(w), "__20": F.lag("__a", 20).over(w)})
    each = rows.groupBy(path).agg(F.sqrt(F.avg(F.col("log_return") * F.col("log_return")) * per_year).alias("vol"), (F.kurtosis("log_return") + 3).alias("kurtosis"), F.corr("__a", "__1").alias("ac1"), F.corr("__a", "__20").alias("ac20"))
    whole = df.groupBy(path).agg((F.ln(F.try_divide(F.max_by(value, session), F.min_by(value, session))) / years * 100).alias("growth"))
    shares = depth_shares(df, path, session, value)
    paths = stored(whole.join(each, path, "left").join(shares, path, "left"), "paths")
    found = stored(episodes(df, path, session, value, least_percent), "episodes")

    def middle(rows: DataFrame, c: str, name: str) -> DataFrame:
        """One row: the upper median of a column, of NULL where it has no value."""
        good = rows.select(F.col(c).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
        if good.isEmpty():
            return df.sparkSession.range(1).select(F.lit(None).cast("double").alias(name))
        return quantile_nearest(good, "v", 0.5).select(F.col("value").alias(name)).limit(1)

    out = found.agg(F.count(F.lit(1)).alias("episodes"), F.max("depth").alias("worst_depth"), F.count_if(~F.col("recovered")).alias("censored"))
    parts = [paths.agg(F.count(F.lit(1)).alias("paths")), *[middle(paths, c, c) for c in ("vol", "kurtosis", "ac1", "ac20", "growth", "below_5", "below_10", "below_20")], middle(found, "depth", "median_depth")]
    for part in parts:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out.withColumn("episodes_a_path", F.try_divide("episodes", "paths"))
