"""Weighted histograms, percentile fallbacks and candidate selection on any table of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals that the search for a place cuts values into at once.
CUTS = 64


def geometric_bins(low: float, high: float, base: float = 3.0, eps: float = 1e-12) -> list[tuple[int, float, float]]:
    """(bin, lower, upper) from low by factors of base until high lies inside; none if high <= low."""
    out, lower = [], low
    while high > low > 0 and (not out or lower <= high * (1 - eps)):
        out.append((len(out), lower, lower * base))
        lower *= base
    return out


def log_histogram(rows: DataFrame, value: str, weight: str, low: float | None = None, base: float = 3.0) -> DataFrame:
    """(bin, lower, upper, total): summed weight of values in [lower, upper), the last bin closed; low is the least value if not given.

    Bins are few and known after one pass for the range; rows find theirs by comparison, sums are made before the shuffle.
    """
    spark = rows.sparkSession
    least, most = rows.agg(F.min(value), F.max(value)).first()
    low = low if low is not None else least
    bins = geometric_bins(low, most, base) if low is not None and most is not None else []
    table = spark.createDataFrame([(b, float(x), float(y)) for b, x, y in bins], "bin int, lower double, upper double")
    if not bins:
        return table.withColumn("total", F.lit(0.0))
    at = F.lit(bins[-1][0])
    for b, _, upper in reversed(bins[:-1]):
        at = F.when(F.col(value) < F.lit(upper), b).otherwise(at)
    sums = rows.where(F.col(value) >= F.lit(low)).groupBy(at.cast("int").alias("bin")).agg(F.sum(F.col(weight).cast("double")).alias("total"))
    return table.join(sums, "bin", "left").select("bin", "lower", "upper", F.coalesce("total", F.lit(0.0)).alias("total"))


def cumulative(bins: DataFrame) -> DataFrame:
    """Adds cum, the share of the total up to each bin (0 where there is no weight)."""
    w = Window.orderBy("bin")  # a row for each bin
    share = F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bins.withColumn("cum", F.coalesce(share, F.lit(0.0)))


def adjusted_minimum(bins: DataFrame, raw: float, target: float = 1e-4) -> DataFrame:
    """(adjusted): the lower edge of the first bin at which the share reaches target; the last bin's if none does, raw without weight."""
    c = cumulative(bins).agg(F.sum("total").alias("all"), F.min_by("lower", F.when(F.col("cum") >= target, F.col("bin"))).alias("hit"), F.max_by("lower", "bin").alias("last"))
    return c.select(F.when(F.coalesce("all", F.lit(0.0)) <= 0, F.lit(float(raw))).otherwise(F.coalesce("hit", "last")).alias("adjusted"))


def min_max_bins(bins: DataFrame, least_share: float = 1e-3, cap: float = 0.66, most_span: int = 3) -> DataFrame:
    """(min_bin, max_bin): the first bin that reaches least_share, and the last of a span from it.

    The span holds the next bin in any case and grows until the share covered reaches cap or it is most_span bins long.
    """
    w = Window.orderBy("bin")
    share = F.col("total") / F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = cumulative(bins).withColumn("share", F.coalesce(share, F.lit(0.0)))
    start = F.min(F.when(F.col("cum") >= least_share, F.col("bin"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("lo", start)
    covered = F.sum(F.when(F.col("bin") >= F.col("lo"), F.col("share")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    stop = (F.col("bin") >= F.col("lo") + 1) & ((covered >= cap) | (F.col("bin") - F.col("lo") >= most_span))
    out = rows.withColumn("stop", stop).agg(F.sum("total").alias("all"), F.max("lo").alias("lo"), F.min(F.when(F.col("stop"), F.col("bin"))).alias("hi"), F.max("bin").alias("last"))
    empty = F.coalesce("all", F.lit(0.0)) <= 0
    return out.select(F.when(empty, 0).otherwise(F.col("lo")).alias("min_bin"), F.when(empty, 0).otherwise(F.coalesce("hi", "last")).alias("max_bin"))


def bucket_counts(rows: DataFrame, bucket: Column, mask: Column | None = None, buckets: int = 4) -> DataFrame:
    """(bucket, n, pct) for 0..buckets-1: rows of other buckets count in the denominator only."""
    kept = rows.where(mask) if mask is not None else rows
    every = kept.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = kept.groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(1))))  # a row for each bucket
    most = F.max(F.col("all")).over(Window.partitionBy(F.lit(1)))
    out = every.join(counts, "bucket", "full").withColumn("all", most).where(F.col("bucket").between(0, buckets - 1))
    return out.select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("all", F.lit(1)))).alias("pct"))


def bucket_weights(rows: DataFrame, bucket: Column, weight: Column, buckets: int = 4) -> DataFrame:
    """(bucket, total, pct): summed weight, negative weight as 0, and percent of the weight in 0..buckets-1."""
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    sums = rows.groupBy(bucket.cast("int").alias("bucket")).agg(F.sum(F.greatest(weight.cast("double"), F.lit(0.0))).alias("total"))
    out = every.join(sums, "bucket", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    all_ = F.sum("total").over(Window.partitionBy(F.lit(1)))
    return out.select("bucket", "total", F.when(all_ > 0, 100.0 * F.col("total") / all_).otherwise(0.0).alias("pct"))


def argmin_with_fallback(rows: DataFrame, score: str, value: str, keys: list[str], threshold: float = 0.95, percentile: float = 0.10) -> DataFrame:
    """The row of least value, ties to the least key, among those with score above the threshold.

    If there is none, the cutoff is the score at place min(ceil(percentile * n), n - 1) of the scores in descending order, found
    by `nth_value`; if none is above that either, the row with the least key.
    """
    pick = F.min(F.struct(value, *keys, score))

    def best(found: DataFrame) -> DataFrame:
        return found.agg(pick.alias("r")).where("r IS NOT NULL").select("r.*")

    out = best(rows.where(F.col(score) > threshold))
    if not out.isEmpty():
        return out
    scored = rows.where(F.col(score).isNotNull())
    n = rows.count()
    if not n:
        return out
    cutoff = nth_value(scored, score, min(-int(-(percentile * n) // 1), n - 1), descending=True)
    out = best(rows.where(F.col(score) > F.lit(cutoff)))
    return out if not out.isEmpty() else rows.agg(F.min(F.struct(*keys, value, score)).alias("r")).select(f"r.{value}", *[f"r.{k}" for k in keys], f"r.{score}")


def fill_with_maximum(rows: DataFrame, value: str) -> DataFrame:
    """rows with missing values replaced by the largest one, by 0 if all are missing."""
    most = rows.agg(F.max(value)).first()[0]
    return rows.withColumn(value, F.coalesce(value, F.lit(0.0 if most is None else most)))


def nth_value(rows: DataFrame, value: str, place: int, descending: bool = False) -> float | None:
    """The value at a place (from 0) of the sorted values, NaN being the greatest; None if there are fewer.

    Values are counted between bounds that approximate quantiles give, and the interval that holds the place is cut again, until it
    holds one value: sums of a few counts each time, whatever the number of different values.
    """
    rows = rows.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    number = ~F.isnan("v")
    sign = F.lit(-1.0 if descending else 1.0)
    low, high, n, strange = rows.agg(F.min(F.when(number, sign * F.col("v"))), F.max(F.when(number, sign * F.col("v"))), F.count_if(number), F.count_if(~number)).first()
    place -= strange if descending else 0
    if not 0 <= place < n:
        return float("nan") if (-strange <= place < 0 if descending else n <= place < n + strange) else None
    rows = rows.where(number).select((sign * F.col("v")).alias("v"))
    before = 0
    while low < high:
        inside = rows.where(F.col("v").between(low, high))
        bounds = sorted({*inside.select(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], 100 * CUTS)).first()[0], low, high})
        # how many lie below each bound, and at it
        counts = inside.agg(*[x for b in bounds for x in (F.count_if(F.col("v") < b), F.count_if(F.col("v") == b))]).first()
        low_, high_ = None, high
        for i, b in enumerate(bounds):
            below, at = before + counts[2 * i], counts[2 * i + 1]
            if below <= place < below + at:
                return -b if descending else b
            if below + at <= place:
                low_, passed = b, below + at
            else:
                high_ = b
                break
        if low_ is None or place >= before + inside.count():
            return None
        # strictly between two neighbouring bounds
        edge = rows.where((F.col("v") > low_) & (F.col("v") < high_)).agg(F.min("v"), F.max("v")).first()
        if edge[0] is None:
            return None
        (low, high), before = edge, passed
    return (-low if descending else low) if place >= before else None


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """(median): the value at place n / 2, rounded down, of the sorted values."""
    n = rows.where(F.col(value).isNotNull()).count()
    kind = rows.schema[value].dataType.simpleString()
    median = nth_value(rows, value, n // 2) if n else None
    return rows.sparkSession.createDataFrame([(median,)], "median double").select(F.col("median").cast(kind))


def histogram_table(bins: DataFrame) -> DataFrame:
    """(line): the histogram as lines of text."""
    rows = cumulative(bins)
    return rows.select("bin", F.format_string("%3d  [%14.6f, %14.6f)  %16.6f  %9.6f", "bin", "lower", "upper", "total", "cum").alias("line"))
