"""What to request next, and which candidate a requested place means."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.params import PlanningParams
from seriesloom.plans.climate import DAY, ENTITY

POSITION = "list_position"


class Unresolved(LookupError):
    """Some requested places have no candidate in their country."""


def entities_with_history(weather: DataFrame, params: PlanningParams = PlanningParams()) -> DataFrame:
    """Entities whose stored days reach back to the start of the history."""
    reached = F.date_add(F.lit(datetime.date.fromisoformat(params.history_start)), params.history_slack_days)
    first_days = weather.groupBy(ENTITY).agg(F.min(DAY).alias("first_day"))
    return first_days.where(F.col("first_day") <= reached).select(ENTITY)


def backfill_plan(
    entities: DataFrame, weather: DataFrame | None, today: datetime.date, params: PlanningParams = PlanningParams()
) -> DataFrame:
    """The date range to request for each entity in this run.

    Entities with history get the recent days. The first few others, in list order, get everything.
    ``weather`` is None when nothing has been stored yet; then every entity is new.
    """
    end = today - datetime.timedelta(days=params.archive_lag_days)
    refresh_from = end - datetime.timedelta(days=params.lookback_days)
    whole_from = datetime.date.fromisoformat(params.history_start)
    listed = entities.select(ENTITY, POSITION)
    if weather is None:
        known, new = listed.limit(0), listed
    else:
        history = entities_with_history(weather, params)
        known = listed.join(history, ENTITY, "left_semi")
        new = listed.join(history, ENTITY, "left_anti")

    def request(rows: DataFrame, kind: str, start: datetime.date) -> DataFrame:
        return rows.select(
            ENTITY, F.lit(kind).alias("request"), F.lit(start).alias("start_date"), F.lit(end).alias("end_date")
        )

    first_new = new.orderBy(POSITION, ENTITY).limit(params.max_backfills)
    return request(known, "refresh", refresh_from).unionByName(request(first_new, "backfill", whole_from))


def best_candidates(candidates: DataFrame) -> DataFrame:
    """The most populous candidate of each requested place within its country.

    An unknown population counts as none; on a tie the earlier candidate wins. Each task keeps one
    candidate per place, so a place with very many candidates is never gathered in one task.
    """
    request = ["requested_city", "requested_country_code"]
    rest = [c for c in candidates.columns if c not in (*request, "reply_position")]
    rank = F.struct(F.coalesce("population", F.lit(0)).alias("people"), (-F.col("reply_position")).alias("earlier"))
    best = (
        candidates.where(F.col("country_code") == F.col("requested_country_code"))
        .groupBy(*request)
        .agg(F.max_by(F.struct(*rest), rank).alias("match"))
    )
    return best.select(*request, "match.*")


def resolve_locations(requested: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each requested place with its best candidate; the match is NULL when there is none."""
    wanted = requested.select(
        F.col("city").alias("requested_city"), F.col("country_code").alias("requested_country_code")
    )
    return wanted.join(best_candidates(candidates), ["requested_city", "requested_country_code"], "left")


def require_resolved(resolved: DataFrame, shown: int = 20) -> DataFrame:
    """Return the rows, or raise with the places that have no candidate."""
    missing = resolved.where(F.col("id").isNull()).select("requested_city", "requested_country_code")
    examples = missing.limit(shown).collect()
    if examples:
        names = ", ".join(f"{r.requested_city} ({r.requested_country_code})" for r in examples)
        raise Unresolved(f"no candidate for {names}")
    return resolved
