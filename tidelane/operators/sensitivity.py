"""How rewards would go with outcomes if they had other components: all subsets from one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many components have 4,095 subsets.
MOST_COMPONENTS = 12


def subset_correlations(df: DataFrame, components: list[str], outcome: str, scored: str | None = None) -> DataFrame:
    """(rows, subset, n, successes, mean, deviation, correlation) for each non-empty subset of components (array of names in the given order): of the sum of its components
    over the rows, its mean and population deviation, and its Pearson correlation with outcome (null where either doesn't vary).

    rows is `recorded`, all rows, and, if a boolean column `scored` is named, also `scored`, those where it holds: a report on
    sensitivity, not another outcome. Null components count as 0; rows without an outcome are left out; no rows give n 0 and nulls.

    Rows are aggregated once to the components' means and pairwise covariances; a subset's variance is the sum of its
    components' covariances, so that subsets cost no pass over the rows and no copy of them.
    """
    if not 0 < len(components) <= MOST_COMPONENTS or len(set(components)) < len(components):
        raise ValueError(f"give 1 to {MOST_COMPONENTS} different components")
    k = len(components)
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in components]
    y = F.col(outcome).cast("double")
    kinds = F.array(F.lit("recorded"), F.when(F.coalesce(F.col(scored), F.lit(False)), F.lit("scored"))) if scored else F.array(F.lit("recorded"))
    given = df.filter(y.isNotNull()).select(F.explode(F.array_compact(kinds)).alias("rows"), F.array(*x).alias("x"), y.alias("y"))
    at = lambda i: F.col("x")[i]
    moments = given.groupBy("rows").agg(
        F.count("*").alias("n"), F.sum("y").alias("successes"), F.array(*(F.avg(at(i)) for i in range(k))).alias("means"), F.array(*(F.covar_pop(at(i), F.col("y")) for i in range(k))).alias("with_y"),
        F.array(*(F.array(*(F.covar_pop(at(i), at(j)) for j in range(k))) for i in range(k))).alias("among"), F.var_pop("y").alias("var_y"),
    )
    asked = df.sparkSession.createDataFrame([(r,) for r in (["recorded", "scored"] if scored else ["recorded"])], "rows string").join(moments, "rows", "left")
    one = asked.withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit(2**k - 1))))
    own = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.getbit(F.col("mask"), i) == 1)
    total = lambda array: F.aggregate("own", F.lit(0.0), lambda s, i: s + F.get(array, i))
    variance: Column = F.aggregate("own", F.lit(0.0), lambda s, i: s + F.aggregate("own", F.lit(0.0), lambda t, j: t + F.get(F.get(F.col("among"), i), j)))
    told = one.withColumn("own", own).withColumn("var", F.greatest(variance, F.lit(0.0)))
    varies = (F.col("var") > 1e-18) & (F.col("var_y") > 0)
    return told.select(
        "rows", F.transform("own", lambda i: F.get(F.array(*map(F.lit, components)), i)).alias("subset"), F.coalesce("n", F.lit(0)).alias("n"), "successes", total(F.col("means")).alias("mean"), F.sqrt("var").alias("deviation"),
        F.when(varies, total(F.col("with_y")) / F.sqrt(F.col("var") * F.col("var_y"))).alias("correlation"),
    )
