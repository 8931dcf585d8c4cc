"""Queries of the statistics operators over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import histogram as H
from meshloom.operators import refine as R
from meshloom.plans.mesh import rounded, table


def line_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.log_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity")


def raw_minimum(spark: SparkSession, sf_dir: str) -> float:
    return table(spark, sf_dir, "lineitem").agg(F.min("l_extendedprice")).first()[0]


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals of large items; orders without one get the largest."""
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("value"))
    return H.fill_with_maximum(table(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left"), "value")


def argmin(threshold: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").select("l_discount", "l_extendedprice", "l_orderkey", "l_linenumber")
        return H.argmin_with_fallback(rows, "l_discount", "l_extendedprice", ["l_orderkey", "l_linenumber"], threshold)

    return run


def patterns(spark: SparkSession) -> DataFrame:
    return spark.range(256).select(F.lpad(F.bin("id"), 8, "0").alias("pattern"))


def part_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.lpad(F.bin(F.pmod(F.col("p_partkey") * 7 + F.col("p_size"), F.lit(256))), 8, "0")
    return table(spark, sf_dir, "part").select(bits.alias("pattern"))


KNOWN = ["00000000", "11110000", "11111111", "11000000", "10100000", "11100000"]


def bucket() -> Column:
    return F.pmod("l_linenumber", F.lit(5))



QUERIES = {
    "log_histogram": lambda s, d: rounded(line_histogram(s, d), "lower", "upper", "total"),
    "hist_adjusted_min": lambda s, d: rounded(H.adjusted_minimum(line_histogram(s, d), raw_minimum(s, d), 0.05), "adjusted"),
    "hist_min_max_bins": lambda s, d: H.min_max_bins(line_histogram(s, d)),
    "hist_cumulative": lambda s, d: rounded(H.cumulative(line_histogram(s, d)).select("bin", "cum"), "cum"),
    "hist_table": lambda s, d: H.histogram_table(line_histogram(s, d)),
    "bucket_counts": lambda s, d: rounded(H.bucket_counts(table(s, d, "lineitem"), bucket()), "pct"),
    "bucket_counts_masked": lambda s, d: rounded(H.bucket_counts(table(s, d, "lineitem"), bucket(), F.col("l_returnflag") == "R"), "pct"),
    "bucket_weighted": lambda s, d: rounded(H.bucket_weights(table(s, d, "lineitem"), bucket(), F.col("l_quantity") - 5), "total", "pct"),
    "argmin_with_fallback": argmin(0.95),
    "argmin_threshold_hit": argmin(0.05),
    "fill_missing_with_max": fill,
    "median_upper": lambda s, d: H.upper_median(table(s, d, "events"), "value"),
    "pattern_canonical": lambda s, d: R.canonical_patterns(patterns(s)).select("pattern", "canonical"),
    "template_usage": lambda s, d: R.template_usage(part_patterns(s, d), KNOWN),
}

_HIST = """
m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b(bin, lower, upper) AS (SELECT 0, lo, lo * 3 FROM m WHERE hi > lo UNION ALL SELECT bin + 1, upper, upper * 3 FROM b, m WHERE upper <= hi * (1 - 1e-12)),
last AS (SELECT max(bin) AS k FROM b),
h AS (SELECT bin, lower, upper, coalesce(sum(l_quantity), 0.0)::DOUBLE AS total FROM b CROSS JOIN last LEFT JOIN lineitem ON l_extendedprice >= lower AND (l_extendedprice < upper OR bin = k) GROUP BY ALL),
c AS (SELECT *, coalesce(sum(total) OVER (ORDER BY bin) / sum(total) OVER (), 0) AS cum, coalesce(total / sum(total) OVER (), 0) AS share FROM h)
"""


def _hist(sql: str) -> str:
    return f"WITH RECURSIVE {_HIST} {sql}"


def _argmin(threshold: float) -> str:
    return f"""WITH n AS (SELECT count(*) AS n FROM lineitem), d AS (SELECT l_discount, row_number() OVER (ORDER BY l_discount DESC) - 1 AS k FROM lineitem),
      t AS (SELECT CASE WHEN (SELECT count(*) FROM lineitem WHERE l_discount > {threshold}) > 0 THEN {threshold} ELSE (SELECT l_discount FROM d, n WHERE k = least(ceil(0.1 * n), n - 1)) END AS t)
      SELECT l_extendedprice, l_orderkey, l_linenumber, l_discount FROM lineitem, t WHERE l_discount > t ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 1"""


def _rotations_sql() -> str:
    rows = ", ".join("(" + ", ".join(str(x + 1) for x in p) + ")" for p in R.rotations())
    return f"r(p1, p2, p3, p4, p5, p6, p7, p8) AS (VALUES {rows})"


def _canonical_sql(source: str) -> str:
    turned = " || ".join(f"pattern[p{i}]" for i in range(1, 9))
    score = " + ".join(f"(t[{i}] = '1')::INTEGER * {i * i}" for i in range(1, 9))
    return f"""{_rotations_sql()}, s AS ({source}), u AS (SELECT s.id, s.pattern, {turned} AS t FROM s, r),
      k AS (SELECT id, pattern, first(t ORDER BY {score}, t DESC) AS canonical FROM u WHERE t[1] = '1' OR pattern = '00000000' GROUP BY id, pattern)"""


SQL = {
    "log_histogram": _hist("SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, round(total, 6) AS total FROM h"),
    "hist_adjusted_min": _hist("SELECT round(coalesce((SELECT lower FROM c WHERE cum >= 0.05 ORDER BY bin LIMIT 1), (SELECT lower FROM c ORDER BY bin DESC LIMIT 1)), 6) AS adjusted"),
    "hist_min_max_bins": _hist(
        """, lo AS (SELECT min(bin) AS lo FROM c WHERE cum >= 0.001), w AS (SELECT bin, lo, sum(CASE WHEN bin >= lo THEN share ELSE 0 END) OVER (ORDER BY bin) AS cov FROM c, lo)
        SELECT any_value(lo)::INTEGER AS min_bin, coalesce(min(bin) FILTER (WHERE bin >= lo + 1 AND (cov >= 0.66 OR bin - lo >= 3)), max(bin))::INTEGER AS max_bin FROM w"""
    ),
    "hist_cumulative": _hist("SELECT bin, round(cum, 6) AS cum FROM c"),
    "hist_table": _hist("SELECT bin, printf('%3d  [%14.6f, %14.6f)  %16.6f  %9.6f', bin, lower, upper, total, cum) AS line FROM c"),
    "bucket_counts": "SELECT b::INTEGER AS bucket, count(*) FILTER (WHERE l_linenumber % 5 = b) AS n, round(100.0 * count(*) FILTER (WHERE l_linenumber % 5 = b) / greatest(1, count(*)), 6)::DOUBLE AS pct FROM range(4) r(b), lineitem GROUP BY b",
    "bucket_counts_masked": "SELECT b::INTEGER AS bucket, count(*) FILTER (WHERE l_linenumber % 5 = b) AS n, round(100.0 * count(*) FILTER (WHERE l_linenumber % 5 = b) / greatest(1, count(*)), 6)::DOUBLE AS pct FROM range(4) r(b), lineitem WHERE l_returnflag = 'R' GROUP BY b",
    "bucket_weighted": "WITH s AS (SELECT b::INTEGER AS bucket, coalesce(sum(greatest(l_quantity - 5, 0)) FILTER (WHERE l_linenumber % 5 = b), 0)::DOUBLE AS total FROM range(4) r(b), lineitem GROUP BY b) SELECT bucket, round(total, 6) AS total, round(100 * total / sum(total) OVER (), 6) AS pct FROM s",
    "argmin_with_fallback": _argmin(0.95),
    "argmin_threshold_hit": _argmin(0.05),
    "fill_missing_with_max": "WITH i AS (SELECT l_orderkey, max(l_extendedprice) AS value FROM lineitem WHERE l_quantity > 40 GROUP BY 1), j AS (SELECT o_orderkey, value FROM orders LEFT JOIN i ON l_orderkey = o_orderkey) SELECT o_orderkey, coalesce(value, max(value) OVER ()) AS value FROM j",
    "median_upper": "SELECT value AS median FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) WHERE k = n // 2",
    "pattern_canonical": f"WITH {_canonical_sql('SELECT i AS id, lpad(bin(i), 8, $$0$$) AS pattern FROM range(256) t(i)')} SELECT pattern, canonical FROM k",
    "template_usage": f"WITH {_canonical_sql('SELECT p_partkey AS id, lpad(bin((p_partkey * 7 + p_size) % 256), 8, $$0$$) AS pattern FROM part')} SELECT CASE WHEN canonical IN ({', '.join(repr(x) for x in KNOWN)}) THEN canonical ELSE 'unknown' END AS template, count(*) AS n FROM k GROUP BY 1",
}
