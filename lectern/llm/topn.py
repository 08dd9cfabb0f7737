"""Top N rows of every group by descending score bands.

The score axis is cut into bands at approximate quantiles that widen from the top. One pass over the table puts every
row into its band and keeps, of each group and band, the best rows only: first inside every task, before anything is
shuffled, then for every few hundred tasks (a salt), so that no task sees more than a few rows of a group for each of
these, however large the group. Counted from the highest band down, a group is filled where the bands above hold its
N rows; an anti-join takes it out of all further bands, and a last ranking with the tie rule settles the band where it
was completed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.common import materialize

#: Shares of all rows, from the top, at which the bands end.
BAND_SHARES = (0.01, 0.04, 0.16, 0.5)
#: Tasks whose rows of a group are merged by one task, and shares of a group that is done apart.
MERGED_TASKS, SALTS = 500, 32


def band_edges(df: DataFrame, score: str, shares=BAND_SHARES) -> list[float]:
    """Descending, distinct lower edges of all bands but the last. They steer cost only, never the result."""
    got = df.agg(F.percentile_approx(score, [1 - s for s in shares], 2000)).first()[0]
    return sorted(set(got or []), reverse=True)


def _band(score: Column, edges: list[float]) -> Column:
    """The number of a score's band, 0 for the highest."""
    return reduce(lambda out, e: out.when(score >= e[1], F.lit(e[0])), enumerate(edges), F).otherwise(F.lit(len(edges))) if edges else F.lit(0)


def _order(*within: str):
    return Window.partitionBy(*within).orderBy(F.desc("_s"), F.asc("_t"))


def _ranked(df: DataFrame, n: int, *within: str) -> DataFrame:
    """The rows with the ``n`` best pairs of score and tie in each partition, with their rank; equal rows share a rank."""
    return df.withColumn("_r", F.dense_rank().over(_order(*within))).where(F.col("_r") <= n)


def _best(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` different ties of each group, each with its highest score, of rows that are few for each group."""
    once = df.groupBy("_g", "_t").agg(F.max("_s").alias("_s"))
    return once.withColumn("_r", F.row_number().over(_order("_g"))).where(F.col("_r") <= n).drop("_r")


def top_n_per_group(df: DataFrame, group: str, score: str, tie: str, n: int = 5, shares=BAND_SHARES) -> DataFrame:
    """``group, tie, score`` of the ``n`` rows of each group with the highest score, equal scores by ascending ``tie``.

    Rows with a null group, a null or NaN score or a null tie take no part; infinite scores do. Rows that repeat a
    ``(group, tie)`` count once, with their highest score. Other columns of ``df`` are ignored, whatever their
    names. An empty input gives an empty result; a group with fewer than ``n`` rows comes out whole.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).alias("_g"), F.col(tie).alias("_t"), F.col(score).cast("double").alias("_s"))
    rows = rows.where(F.col("_g").isNotNull() & F.col("_t").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))
    edges = band_edges(rows, "_s", shares)
    banded = rows.withColumn("_b", _band(F.col("_s"), edges)).withColumn("_salt", F.floor(F.spark_partition_id() / MERGED_TASKS))
    # One rank more than wanted shows where rows were cut off.
    few = materialize(_ranked(banded, n + 1, "_g", "_b", "_salt"))
    left = few.where(F.col("_r") <= n).select("_g", "_t", "_s", "_b")
    # Places taken in every band, a tie in the band of its highest score; a group is filled where those above make n.
    places = left.groupBy("_g", "_t").agg(F.min("_b").alias("_b")).groupBy("_g", "_b").agg(F.count("*").alias("_n"))
    bands = places.select("_g").distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(len(edges)))))
    above = F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    filled = bands.join(places, ["_g", "_b"], "left").withColumn("_above", above).where(F.col("_above") >= n).select("_g", "_b")
    kept = left.join(filled, ["_g", "_b"], "left_anti").select("_g", "_t", "_s")
    # A tie stored with several scores takes several ranks; where that may have cut off others, the group is done apart.
    crowded = few.groupBy("_g", "_b", "_salt").agg(F.max("_r").alias("_m"), F.count_distinct(F.when(F.col("_r") <= n, F.col("_t"))).alias("_d"))
    crowded = crowded.where((F.col("_m") > n) & (F.col("_d") < n)).select("_g").distinct()
    if crowded.limit(1).count():
        crowded = materialize(crowded)
        apart = rows.join(crowded, "_g", "left_semi").groupBy("_g", "_t").agg(F.max("_s").alias("_s"))
        apart = _ranked(apart.withColumn("_salt", F.pmod(F.xxhash64("_t"), F.lit(SALTS))), n, "_g", "_salt").select("_g", "_t", "_s")
        kept = kept.join(crowded, "_g", "left_anti").unionByName(apart)
    return _best(kept, n).select(F.col("_g").alias(group), F.col("_t").alias(tie), F.col("_s").alias(score))
