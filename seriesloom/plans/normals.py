"""Climate normals that grow with the days: a state per entity and day of the year that is added up, not made anew.

The state holds a count, a mean, the sum of squares around it, and a KLL sketch of the daily maximum. States of different days
merge by adding counts, by Chan's formula for means and squares, and by merging sketches; all three partially before
any shuffle. Mean and spread are exact. The sketch gives a percentile whose rank is off by at most ``RANK_ERROR`` of the count
(with its 200 points per level, at 99 % confidence); up to 200 days it holds every value, so a normal of 30 years is exact.

A state can take days in, not out: where a day that has been counted changes, the state of its entity and day of the year is made
again from the facts (``renewed``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import folded_day, in_years
from seriesloom.params import BaselineParams
from seriesloom.plans.climate import DAY, ENTITY

KEY = (ENTITY, "day_of_year")
RANK_ERROR = 0.0133
STATE = ("days", "mean_c", "squares", "tmax_sketch")


def normal_state(fact: DataFrame, params: BaselineParams = BaselineParams()) -> DataFrame:
    """The state of the reference years' days in ``fact``."""
    mean = F.col("temperature_mean_c")
    return (
        fact.where(in_years(F.col(DAY), params.first_year, params.last_year))
        .groupBy(ENTITY, folded_day(F.col(DAY)).alias("day_of_year"))
        .agg(
            F.count(mean).alias("days"), F.avg(mean).alias("mean_c"),
            (F.var_pop(mean) * F.count(mean)).alias("squares"),
            F.expr("kll_sketch_agg_double(temperature_max_c)").alias("tmax_sketch"),
        )
    )


def merged(*states: DataFrame) -> DataFrame:
    """One state of several over different days."""
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    centre = F.sum(F.col("days") * F.col("mean_c")) / F.sum("days")
    middle = rows.groupBy(*KEY).agg(centre.alias("_centre"))
    apart = F.col("days") * (F.col("mean_c") - F.col("_centre")) * (F.col("mean_c") - F.col("_centre"))
    return rows.join(middle, list(KEY)).groupBy(*KEY).agg(
        F.sum("days").alias("days"), F.max("_centre").alias("mean_c"),
        F.sum(F.coalesce("squares", F.lit(0.0)) + F.coalesce(apart, F.lit(0.0))).alias("squares"),
        F.expr("kll_merge_agg_double(tmax_sketch)").alias("tmax_sketch"),
    )


def renewed(state: DataFrame, fact: DataFrame, changed: DataFrame, params: BaselineParams = BaselineParams()) -> DataFrame:
    """The state after some of the days it has counted changed: ``changed`` holds their entity and day.

    ``fact`` has the new values; only the rows with an entity and day of the year of a changed day are read again.
    """
    keys = changed.select(ENTITY, folded_day(F.col(DAY)).alias("day_of_year")).distinct()
    again = fact.withColumn("day_of_year", folded_day(F.col(DAY))).join(keys, list(KEY), "left_semi").drop("day_of_year")
    return state.join(keys, list(KEY), "left_anti").select(*KEY, *STATE).unionByName(normal_state(again, params).select(*KEY, *STATE))


def reference_days(state: DataFrame, params: BaselineParams = BaselineParams()) -> DataFrame:
    """Mean, spread and hot threshold per entity and day of the year, as ``climate.reference_days`` has them."""
    counted = F.col("days")
    filled = F.expr("kll_sketch_get_n_double(tmax_sketch) > 0")
    quantile = F.expr(f"kll_sketch_get_quantile_double(tmax_sketch, {params.hot_percentile}D)")
    return state.select(
        *KEY, "mean_c", F.when(counted > 1, F.sqrt(F.greatest(F.col("squares"), F.lit(0.0)) / (counted - 1))).alias("std_c"),
        F.when(filled, quantile).alias("tmax_p90_c"))
