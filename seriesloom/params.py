"""Parameters of the models, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Model inputs, horizons and quantile levels.
FEATURE_COLUMNS = (
    "anomaly_lag0", "anomaly_lag1", "anomaly_lag2", "anomaly_lag3", "anomaly_lag7",
    "anomaly_mean_7d", "anomaly_mean_30d", "anomaly_std_7d", "precipitation_sum_7d",
    "wind_gust_max_kmh", "temperature_range_c", "doy_sin", "doy_cos",
    "latitude", "elevation_m", "horizon",
)
HORIZONS = (1, 2, 3, 4, 5, 6, 7)
QUANTILES = {"low": 0.1, "mid": 0.5, "high": 0.9}
# Rows without these have too little history behind them to be used.
REQUIRED_FEATURES = ("anomaly_lag7", "anomaly_std_7d")


@dataclass(frozen=True)
class BaselineParams:
    """Reference period and smoothing of the climate normal."""

    first_year: int = 1961
    last_year: int = 1990
    smooth_rows: int = 7
    hot_percentile: float = 0.9


@dataclass(frozen=True)
class RunParams:
    """When a run of flagged days counts as a wave."""

    wave_days: int = 3


@dataclass(frozen=True)
class BacktestParams:
    train_start_year: int = 1980
    test_years: tuple[int, ...] = (2023, 2024, 2025)


@dataclass(frozen=True)
class BoostParams:
    """Boosted quantile trees; a depth of 5 gives at most 32 leaves."""

    rounds: int = 200
    depth: int = 5
    learning_rate: float = 0.05
    min_leaf: int = 200
    row_share: float = 0.8
    column_share: float = 0.8
    max_bins: int = 64
    checkpoint_every: int = 10
    seed: int = 17


@dataclass(frozen=True)
class PlanningParams:
    """Window sizes of the extraction plan."""

    history_start: str = "1940-01-01"
    history_slack_days: int = 31
    lookback_days: int = 14
    archive_lag_days: int = 6
    max_backfills: int = 4


@dataclass(frozen=True)
class ServingParams:
    recent_days: int = 90
    short_days: int = 30
    long_days: int = 3653
    wave_days: int = 365
    complete_year_days: int = 360
    tables: tuple[str, ...] = field(
        default=("city_summary", "city_yearly", "city_recent_daily", "forecast_latest", "model_skill")
    )
