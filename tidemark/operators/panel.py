"""Time series by ticker: forward targets, event windows, charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event windows in trading days from the event's day.
EVENT_WINDOWS = {"pre_10d": (-10, -1), "pre_5d": (-5, -1), "event_day": (0, 0), "post_1d": (0, 1), "post_3d": (0, 3), "post_5d": (0, 5), "post_10d": (0, 10), "post_21d": (0, 21)}


def ahead(key: str, order: str, h: int) -> Window:
    """The next h rows of the key."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(1, h)


def complete(value: Column, ret: Column, w: Window, h: int) -> Column:
    """Null unless all h rows ahead have a return."""
    return F.when(F.count(ret).over(w) == h, value)


def forward_return(ret: str, key: str, order: str, h: int) -> Column:
    w = ahead(key, order, h)
    return complete(F.expm1(F.sum(F.log1p(F.greatest(F.col(ret), F.lit(-0.999999)))).over(w)), F.col(ret), w, h)


def forward_volatility(ret: str, key: str, order: str, h: int) -> Column:
    """Population deviation of the next h returns, a year of 252 days."""
    w = ahead(key, order, h)
    return complete(F.stddev_pop(ret).over(w) * F.sqrt(F.lit(252.0)), F.col(ret), w, h)


def forward_drawdown(ret: str, key: str, order: str, h: int) -> Column:
    """The deepest fall of wealth below its high so far, over the next h returns, from a wealth of 1."""
    w = ahead(key, order, h)
    start = F.struct(F.lit(1.0).alias("wealth"), F.lit(1.0).alias("high"), F.lit(0.0).alias("fall"))

    def step(s: Column, r: Column) -> Column:
        wealth = s["wealth"] * (1 + r)
        high = F.greatest(s["high"], wealth)
        return F.struct(wealth.alias("wealth"), high.alias("high"), F.least(s["fall"], wealth / high - 1).alias("fall"))

    return complete(F.aggregate(F.collect_list(ret).over(w), start, step, lambda s: s["fall"]), F.col(ret), w, h)


def train_flag(value: Column, threshold: Column, above: bool = True) -> Column:
    """1 beyond a threshold, 0 else, missing values included."""
    return F.coalesce((value >= threshold if above else value <= threshold).cast("int"), F.lit(0))


def calendar(days: DataFrame, key: str = "tic", day: str = "date") -> DataFrame:
    """A row for each calendar day (on_day) of each key up to its last trading day: the trading day on or after it, with its columns.

    A trading day stands for the days since the one before, so there are as many rows as calendar days, and any event finds its
    trading day by equality of key and day. Days before a key's first trading day are not listed; first_day says which it is.
    """
    w = Window.partitionBy(key).orderBy(day)
    since = F.coalesce(F.date_add(F.lag(day).over(w), 1), F.col(day))
    return days.withColumns({"first_day": F.first(day).over(w), "since": since}).withColumn("on_day", F.explode(F.sequence("since", F.col(day)))).drop("since")


def on_trading_days(events: DataFrame, days: DataFrame, key: str = "tic", when: str = "event_date", day: str = "date") -> DataFrame:
    """events with the columns of the first trading day on or after each; events after the last day drop out."""
    listed = calendar(days, key, day)
    first = listed.groupBy(key).agg(F.min("first_day").alias("from_day"))
    asked = events.join(first, key).withColumn("on_day", F.greatest(F.col(when), F.col("from_day"))).drop("from_day")
    return asked.join(listed.drop("first_day"), [key, "on_day"]).drop("on_day")


def first_day_on_or_after(events: DataFrame, days: DataFrame, key: str = "tic", when: str = "event_date", day: str = "date") -> DataFrame:
    """Adds trading_date, null after the last day, and for a key without days."""
    listed = calendar(days.select(key, day).distinct(), key, day)
    first = listed.groupBy(key).agg(F.min("first_day").alias("from_day"))
    asked = events.join(first, key, "left").withColumn("on_day", F.greatest(F.col(when), F.col("from_day"))).drop("from_day")
    return asked.join(listed.select(key, "on_day", F.col(day).alias("trading_date")), [key, "on_day"], "left").drop("on_day")


def compounded(rows: DataFrame, key: str, order: str, ret: str) -> DataFrame:
    """Adds log_to, the sum of log returns up to each row: any window's return is a difference of two."""
    return rows.withColumn("log_to", F.sum(F.log1p(ret)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def window_returns(panel: DataFrame, windows: dict[str, tuple[int, int]], key: str = "tic", order: str = "day_no") -> DataFrame:
    """Adds the return over each window, days start + 1 to end from each row; null where the panel doesn't reach. panel has log_to."""
    w = Window.partitionBy(key).orderBy(order)
    at = lambda o: F.lead("log_to", o).over(w) if o >= 0 else F.lag("log_to", -o).over(w)
    return panel.withColumns({name: F.expm1(at(b) - at(a if a != b else a - 1)) for name, (a, b) in windows.items()})


def market(panel: DataFrame) -> DataFrame:
    """Equal-weight return of each date."""
    return panel.groupBy("date").agg(F.avg("ret").alias("market_ret"), F.count("ret").alias("n"))


def merge_panel(base: DataFrame, stock: DataFrame, portfolio: DataFrame, numbers: list[str]) -> DataFrame:
    """The base panel with features by date and ticker and by date; numbers default to 0, and flags say which side was there."""
    out = base.join(stock.withColumn("has_stock_text", F.lit(1)), ["date", "tic"], "left").join(portfolio.withColumn("has_portfolio_text", F.lit(1)), "date", "left")
    return out.fillna(0, [*numbers, "has_stock_text", "has_portfolio_text"])


def rolling(value: str, key: str, order: str, n: int, mean: bool) -> Column:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
    return (F.avg if mean else F.sum)(value).over(w)


def change_points(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before, and each key's last row."""
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumns({"changed": ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1), "is_last": F.lead(F.lit(1)).over(w).isNull()})
    return rows.filter("changed OR is_last")


def downsample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Every so manieth row of each key, `most` at most, and the last."""
    w = Window.partitionBy(key)
    rows = rows.withColumns({"slot": F.row_number().over(w.orderBy(order)) - 1, "size": F.count("*").over(w)})
    return rows.filter((F.col("slot") % F.ceil(F.col("size") / most) == 0) | (F.col("slot") == F.col("size") - 1)).drop("size")


def robust_scale(rows: DataFrame, key: str, value: str) -> DataFrame:
    """y in 0..1 between the 3rd and 97th percentile of the key, whether it was clipped; 0.5 for a flat key."""
    ends = rows.groupBy(key).agg(F.percentile(value, [0.03, 0.97]).alias("ends"))
    low, high = F.get("ends", F.lit(0)), F.get("ends", F.lit(1))
    y = F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - low) / (high - low)))).otherwise(0.5)
    return rows.join(ends, key).withColumns({"y": y, "clipped": (F.col(value) < low) | (F.col(value) > high)}).drop("ends")


def monthly(rows: DataFrame, key: str, date: str, value: str) -> DataFrame:
    return rows.groupBy(key, F.date_format(date, "yyyy-MM").alias("month")).agg(F.max(date).alias("date"), F.avg(value).alias("value"))


def trend(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return rows.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def max_drawdown(rows: DataFrame, key: str, order: str, ret: str) -> DataFrame:
    """The deepest fall of each key's wealth below its high so far, the first return included."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    wealth = rows.withColumn("log_", F.sum(F.log1p(F.coalesce(F.col(ret), F.lit(0.0)))).over(upto))
    return wealth.withColumn("fall", F.exp(F.col("log_") - F.max("log_").over(upto)) - 1).groupBy(key).agg(F.min("fall").alias("max_drawdown"))


def performance(rows: DataFrame, key: str, ret: str) -> DataFrame:
    """Annual Sharpe ratio by the sample deviation, null without spread, and the compounded return."""
    sd = F.stddev_samp(ret)
    return rows.groupBy(key).agg(F.when(sd > 0, F.avg(ret) / sd * F.sqrt(F.lit(252.0))).alias("sharpe"), (F.exp(F.sum(F.log1p(F.coalesce(F.col(ret), F.lit(0.0))))) - 1).alias("cumulative"))
