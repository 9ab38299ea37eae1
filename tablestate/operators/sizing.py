"""F. Sizing: grade by size, estimate durations from measured throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of size, factors of the estimate, shortest timing that counts as a measurement.
BIG_ROWS, BIG_BYTES, SMALL_ROWS, SMALL_BYTES = 1_000_000, 1 << 30, 10_000, 8 << 20
LOW, HIGH, SHORTEST_US = 0.75, 2.0, 1000
#: Duration classes: 1 instant, 2 scan, 3 rewrite, 4 index build. Severities: 1 info, 2 warn, 3 error.


def throughput(probes: DataFrame) -> DataFrame:
    """(server, rewrite_bytes, rewrite_rows, index_bytes, index_rows, known): rates a second; 0 where the timing was too short."""
    rate = lambda n, t: F.when(F.col(t) < SHORTEST_US, 0.0).otherwise(F.col(n) / (F.col(t) / 1e6))
    rates = {"rewrite_bytes": rate("n_bytes", "rewrite_us"), "rewrite_rows": rate("n_rows", "rewrite_us"), "index_bytes": rate("n_bytes", "index_us"), "index_rows": rate("n_rows", "index_us")}
    out = probes.groupBy("server").agg(*[F.max(c).alias(k) for k, c in rates.items()])
    return out.withColumn("known", F.least(*rates) > 0)


def estimate(work: DataFrame, stats: DataFrame, rates: DataFrame) -> DataFrame:
    """(server, relation, low_s, high_s) for work (server, relation, duration): the larger of byte and row cost, as a range.

    Null when there is none to give: scans cost what rewrites do; instant work, unknown rates and empty relations have
    none; ranges that end below a second are suppressed.
    """
    duration = F.col("duration")
    build = duration == 4
    byte_rate, row_rate = F.when(build, F.col("index_bytes")).otherwise(F.col("rewrite_bytes")), F.when(build, F.col("index_rows")).otherwise(F.col("rewrite_rows"))
    per = lambda n, rate: F.when(rate > 0, F.col(n) / rate).otherwise(0.0)
    cost = F.greatest(per("n_bytes", byte_rate), per("n_rows", row_rate))
    there = F.coalesce("known", F.lit(False)) & (duration > 1) & (F.col("n_bytes") > 0) & (cost * HIGH >= 1)
    both = work.join(stats.select("relation", "n_rows", "n_bytes"), "relation", "left").join(rates, "server", "left")
    return both.select("server", "relation", F.when(there, cost * LOW).alias("low_s"), F.when(there, cost * HIGH).alias("high_s"))


def estimate_accuracy(estimates: DataFrame, measured: DataFrame) -> DataFrame:
    """(server, n, within_2): estimates whose middle is within a factor of two of the truth, either way."""
    mid, truth = (F.col("low_s") + F.col("high_s")) / 2, F.col("took_us") / 1e6
    joined = estimates.join(measured, ["server", "relation"]).where("low_s is not null and took_us > 0")
    return joined.groupBy("server").agg(F.count("*").alias("n"), F.count_if(F.greatest(truth / mid, mid / truth) <= 2).alias("within_2"))


def _limit(given: int, default: int) -> int:
    return given or default


def size_grade(exists: Column, n_rows: Column, n_bytes: Column, big_rows: int = 0, big_bytes: int = 0, small_rows: int = 0, small_bytes: int = 0) -> Column:
    """3 when either measure is big, 1 when both are small, else 2; 2 for an absent relation. A threshold of 0 is the default."""
    big = (n_rows >= _limit(big_rows, BIG_ROWS)) | (n_bytes >= _limit(big_bytes, BIG_BYTES))
    little = (n_rows < _limit(small_rows, SMALL_ROWS)) & (n_bytes < _limit(small_bytes, SMALL_BYTES))
    return F.when(~F.coalesce(exists, F.lit(False)), 2).when(big, 3).when(little, 1).otherwise(2)


def is_large(exists: Column, n_rows: Column, n_bytes: Column, big_rows: int = 0, big_bytes: int = 0) -> Column:
    """Known and over either big threshold; an unknown size is never large."""
    return F.coalesce(exists & ((n_rows >= _limit(big_rows, BIG_ROWS)) | (n_bytes >= _limit(big_bytes, BIG_BYTES))), F.lit(False))
