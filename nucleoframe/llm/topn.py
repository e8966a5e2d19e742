"""Top N items within every group (problem 1): two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.common import bare_id, latest_rows


def top_n_per_group(df: DataFrame, group: str, item: str, n: int, order: list[Column], salts: int = 64) -> DataFrame:
    """The first ``n`` rows of every ``group`` in the given order, then by ``item``.

    Stage one hashes each group into ``salts`` subgroups by item, ranks and keeps
    ``n`` rows in each; stage two ranks the survivors of all subgroups.  Spark puts
    a group limit before either exchange, so of a group of millions of rows each
    map task sends at most ``n`` per subgroup and no task sorts a whole group twice.

    * a null group is no group: its rows are left out;
    * ties in ``order`` are broken by ``item`` (nulls last), repeated rows by nothing
      else, so of equal rows any one may stand for the others;
    * fewer than ``n`` rows come out whole; an empty table gives an empty result;
    * all columns of ``df`` are kept, plus ``rank``; a column of that name is replaced.
    """
    by = [*order, F.col(f"`{item}`").asc_nulls_last()]
    salted = df.where(F.col(f"`{group}`").isNotNull()).withColumn("_nf_salt", F.pmod(F.xxhash64(F.col(f"`{item}`")), F.lit(salts)))
    first = (
        salted.withColumn("_nf_rank", F.row_number().over(Window.partitionBy(F.col(f"`{group}`"), F.col("_nf_salt")).orderBy(*by)))
        .where(F.col("_nf_rank") <= n)
        .drop("_nf_rank", "_nf_salt")
    )
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.col(f"`{group}`")).orderBy(*by))).where(F.col("rank") <= n)


def best_padlocks(hits: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` padlock hits of every transcript with the best arm temperatures.

    Input: ``hit_id, name0, idx, report, loaded_at``; other columns don't matter.
    The latest row of a ``hit_id`` counts, rows without ``hit_id`` don't.  A null
    report, a null transcript and a temperature that is null, not above 0 or not
    finite exclude the hit.  Result: ``name0`` (bare), ``hit_id, score, rank``.
    """
    flat = hits.select(
        F.col("hit_id"), F.col("loaded_at"), F.col("name0"), F.col("idx"),
        F.col("report.tm_arm_min_l").alias("tm_l"), F.col("report.tm_arm_min_r").alias("tm_r"),
    )
    current = latest_rows(flat, ["hit_id"], "loaded_at", ["name0", "idx", "tm_l", "tm_r"])
    inf = F.lit(float("inf"))  # NaN is greater than infinity in Spark
    scored = current.where(
        F.col("name0").isNotNull() & (F.col("tm_l") > 0) & (F.col("tm_l") < inf) & (F.col("tm_r") > 0) & (F.col("tm_r") < inf)
    ).select(bare_id(F.col("name0")).alias("name0"), "hit_id", "idx", F.round(F.col("tm_l") + F.lit(0.9) * F.col("tm_r"), 4).alias("score"))
    top = top_n_per_group(scored, "name0", "hit_id", n, [F.col("score").desc(), F.col("idx").asc_nulls_last()])
    return top.select("name0", "hit_id", "score", "rank")
