"""Exact percentiles by selection.

Spark's exact percentile keeps every different value of a group in one task.  Here a first pass
brackets each percentile by approximate ones, and a second counts the values below the bracket
and each value within it, some thousandth of the rows, partially aggregated; the ranks wanted lie
there.  Only the different values of a bracket are sorted, and that sort spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: How far the bracket reaches beyond the percentile; more than the error of an approximate one.
MARGIN = 2 / ACCURACY


def exact_percentiles(rows: DataFrame, group: str | None, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """(group, a column for each name), as Spark's ``percentile`` has it, interpolated between the two closest values.

    wanted: values as doubles, null where a row doesn't count, and the share below.  Without
    ``group`` all rows are one, and there is a row even without input.
    """
    keys = [] if group is None else [group]
    values = rows.select(*keys, *(v.alias(f"v{k}") for k, (v, _) in enumerate(wanted.values())))
    brackets = values.groupBy(*(F.col(g).alias("__of") for g in keys)).agg(
        *(F.percentile_approx(f"v{k}", [max(0.0, p - MARGIN), min(1.0, p + MARGIN)], ACCURACY).alias(f"b{k}") for k, (_, p) in enumerate(wanted.values()))
    )
    # as many rows as groups, which are days
    joined = values.join(F.broadcast(brackets), F.col(group).eqNullSafe(F.col("__of")) if keys else F.lit(True))

    def clipped(k: int) -> Column:
        v, low, high = F.col(f"v{k}"), F.col(f"b{k}")[0], F.col(f"b{k}")[1]
        return F.struct(F.lit(k).alias("which"), F.when(v < low, 0).when(v > high, 2).otherwise(1).alias("side"), F.when(v.between(low, high), v).alias("inside"), v.alias("v"))

    counted = (
        joined.select(*keys, F.inline(F.array(*map(clipped, range(len(wanted))))))
        .where("v is not null")
        .groupBy(*keys, "which", "side", "inside")
        # the values beyond the bracket are one on each side; of them only the closest can be wanted, as ranks are rounded
        .agg(F.count(F.lit(1)).alias("n"), F.when(F.col("side") == 0, F.max("v")).otherwise(F.min("v")).alias("value"))
    )
    own = Window.partitionBy(*keys, "which")
    ranked = (
        counted.withColumn("upto", F.sum("n").over(own.orderBy("side", "value")))
        .withColumn("all", F.sum("n").over(own))
        .withColumn("p", F.element_at(F.array(*(F.lit(float(p)) for _, p in wanted.values())), F.col("which") + 1))
        .withColumn("position", F.col("p") * (F.col("all") - 1))
    )
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.struct("side", "value")))["value"]
    low, high = F.floor("position"), F.ceil("position")
    found = ranked.groupBy(*keys, "which").agg(at(low).alias("low"), at(high).alias("high"), F.max(F.col("position") - low).alias("part"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("which") == k, value)).alias(name) for k, name in enumerate(wanted)))
