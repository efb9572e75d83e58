"""Metric aggregations: ratios, rates, percentiles, histograms, slopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram, in seconds.
BOUNDS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.5)


def windowed_ratio(log: DataFrame, ts: str, bad: Column, minutes: int = 5, most: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """``(window_start, *by, bad, total, ratio, firing)`` of tumbling windows."""
    rows = log.groupBy(F.window(F.col(ts), f"{minutes} minutes").alias("_w"), *by).agg(F.sum(bad.cast("int")).cast("long").alias("bad"), F.count("*").alias("total"))
    return rows.select(F.col("_w.start").alias("window_start"), *by, "bad", "total", (F.col("bad") / F.col("total")).alias("ratio"), (F.col("bad") / F.col("total") > most).alias("firing"))


def ranked_values(log: DataFrame, value: str, picks: dict[str, tuple[float, Callable[[Column], Column]]], by: tuple[str, ...] = (), accuracy: int = 10_000) -> DataFrame:
    """``(*by, n, *picks)``: exact values at ranks of each group's sorted values.

    A pick is a share of the values near its rank and the rank from 0 as a
    function of n.  A sketch brackets each rank first; what is below a bracket
    is only counted, so a group shuffles the distinct values of its brackets, a
    few in ``accuracy``, and no task holds a group's values.  Nulls don't count.
    """
    base = log.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    slack = 2 / accuracy
    ends = [x for p, _ in picks.values() for x in (max(0.0, p - slack), min(1.0, p + slack))]
    stats = base.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", ends, accuracy).alias("_e"))
    # the sketch of a group that is smaller than its steps isn't needed
    tests = F.array(*(F.struct(F.lit(i).alias("k"), F.when(F.col("n") > accuracy, F.col("_e")[2 * i]).alias("lo"), F.when(F.col("n") > accuracy, F.col("_e")[2 * i + 1]).alias("hi"), rank(F.col("n")).cast("long").alias("rank")) for i, (_, rank) in enumerate(picks.values())))
    stats = stats.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), "n", F.explode(tests).alias("_t"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    rows = base.join(stats, same).where(F.col("_t.hi").isNull() | (F.col("_v") <= F.col("_t.hi")))
    counts = rows.groupBy(*by, "n", "_t", F.when(F.col("_t.lo").isNull() | (F.col("_v") >= F.col("_t.lo")), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*by, "_t").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    found = counts.withColumn("_end", F.sum("_c").over(order)).where(F.col("_end") > F.col("_t.rank"))
    return found.groupBy(*by, "n").agg(*(F.min(F.when(F.col("_t.k") == i, F.col("_v"))).alias(name) for i, name in enumerate(picks)))


def exact_percentile(log: DataFrame, value: str, p: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, value)``: the smallest value with a share ``p`` at or below it."""
    name = f"p{round(p * 100)}"
    return ranked_values(log, value, {name: (p, lambda n: F.greatest(F.ceil(n * p) - 1, F.lit(0)))}, by).select(*by, name)


def sketch_percentile(log: DataFrame, value: str, p: float, by: tuple[str, ...] = (), accuracy: int = 10_000) -> DataFrame:
    """An approximation whose rank error is 1/accuracy; partial sketches are
    merged, so values aren't shuffled."""
    return log.groupBy(*by).agg(F.percentile_approx(value, p, accuracy).alias(f"p{round(p * 100)}"))


def indexed_percentiles(log: DataFrame, value: str, ps: tuple[float, ...], by: tuple[str, ...]) -> DataFrame:
    """``(*by, n, ...)``: ``sorted[min(floor(n*p), n-1)]`` of each group."""

    def rank(p: float) -> Callable[[Column], Column]:
        return lambda n: F.least(F.floor(n * p), n - 1)

    return ranked_values(log, value, {f"p{round(p * 100)}": (p, rank(p)) for p in ps}, by)


def bucket_counts(log: DataFrame, value: str, bounds: tuple[float, ...] = BOUNDS, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, le, count)`` cumulative; +Inf is null.  One row a group is
    shuffled, whatever the number of bounds."""
    sums = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).cast("long").alias(f"_b{i}") for i, b in enumerate(bounds)]
    rows = log.groupBy(*by).agg(*sums, F.count(value).alias("_all"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("count")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("count")))
    return rows.select(*by, F.explode(F.array(*pairs)).alias("_p")).select(*by, "_p.le", "_p.count")


def slopes(log: DataFrame, ts: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, slope)``: least-squares change of the value in a second."""
    x = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - 1_700_000_000.0
    return log.groupBy(*by).agg(F.regr_slope(F.col(value), x).alias("slope"))


def request_rates(log: DataFrame, ts: str, minutes: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """``(window_start, *by, per_second)``."""
    rows = log.groupBy(F.window(F.col(ts), f"{minutes} minutes").alias("_w"), *by).agg(F.count("*").alias("_n"))
    return rows.select(F.col("_w.start").alias("window_start"), *by, (F.col("_n") / (60 * minutes)).alias("per_second"))


def share(df: DataFrame, condition: Column, most: float) -> DataFrame:
    """``(share, firing)`` of the rows that meet a condition."""
    got = df.agg(F.avg(condition.cast("int")).alias("share"))
    return got.select("share", (F.col("share") > most).alias("firing"))


def load_summary(log: DataFrame, ts: str, value: str, failed: Column) -> DataFrame:
    """``(requests, failures, error_rate, seconds, per_second, slope_per_minute)``:
    the slope is last minus first value over the minutes between."""
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = log.agg(
        F.count("*").alias("requests"), F.sum(failed.cast("int")).cast("long").alias("failures"), (F.max(at) - F.min(at)).alias("seconds"),
        F.min_by(value, F.struct(ts, value)).alias("_first"), F.max_by(value, F.struct(ts, value)).alias("_last"),
    )
    good = F.col("requests") - F.col("failures")
    over = lambda a: F.when(F.col("seconds") > 0, a / F.col("seconds")).otherwise(0.0)
    return rows.select("requests", "failures", F.when(F.col("requests") > 0, F.col("failures") / F.col("requests")).otherwise(0.0).alias("error_rate"), "seconds", over(good).alias("per_second"), over((F.col("_last") - F.col("_first")) * 60).alias("slope_per_minute"))


def pressure(log: DataFrame, ts: str, used: str, size: float, most: float = 0.85, minutes: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """``(window_start, *by, share, firing)``: what is used of ``size`` in all,
    in each window."""
    rows = log.groupBy(F.window(F.col(ts), f"{minutes} minutes").alias("_w"), *by).agg((F.sum(used) / F.lit(float(size))).alias("share"))
    return rows.select(F.col("_w.start").alias("window_start"), *by, "share", (F.col("share") > most).alias("firing"))


def growing(log: DataFrame, ts: str, size: str, most: float = 50, minutes: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """``(window_start, *by, size, slope, firing)``: a queue alarms if it holds
    more than ``most`` and its size's slope is upwards, in each window."""
    x = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - 1_700_000_000.0
    rows = log.groupBy(F.window(F.col(ts), f"{minutes} minutes").alias("_w"), *by).agg(F.sum(size).alias("size"), F.regr_slope(F.col(size), x).alias("slope"))
    return rows.select(F.col("_w.start").alias("window_start"), *by, "size", "slope", F.coalesce((F.col("size") > most) & (F.col("slope") > 0), F.lit(False)).alias("firing"))
