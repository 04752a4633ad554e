"""One runnable query per operator, each with the same result in plain SQL where SQL can say it."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle as o
from checks import proxy
from seriesloom import schemas
from seriesloom.functions import calendar
from seriesloom.functions.numeric import clamp_scale, nan_to_null, round_half_up
from seriesloom.functions.wording import describe_anomaly, describe_vs_average
from seriesloom.ml import training
from seriesloom.ml.quantile_boost import pinball
from seriesloom.ml.registry import Registry
from seriesloom.operators import latest, nested, quality, runs, series
from seriesloom.params import BoostParams, RunParams, ServingParams
from seriesloom.plans import backtest, climate, dims, features, forecast, normals, planning, publish, reads, serving
from seriesloom.session import configure, store, work_dir
from seriesloom.sources import landing, tables
from seriesloom.streaming import bronze, silver

KEY = ("location_id", "weather_date")
SERVING = ServingParams(complete_year_days=60)
LONG_VIEW = {"needed": 5, "recent": 3, "warmest": 3, "since": 1999}
EXPORTED_AT = datetime.datetime(2001, 11, 10, 6, 30, tzinfo=datetime.UTC)


class Check(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


CHECKS: dict[str, Check] = {}


def check(covers: str, sql: str | None = None):
    """Register a query under its function's name; ``covers`` names the survey's operators."""
    def add(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(configure(spark), folder)

        run.__name__ = function.__name__
        run.__doc__ = function.__doc__
        CHECKS[function.__name__] = Check(run, o.sql(sql) if sql else None, covers)
        return function

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Round the floating-point columns to six places, so that engines that add in another order agree.

    The limit lies just below one half, so that a tie blurred by the order of adding still goes up.
    """
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[
        (F.floor(F.col(c) * 1e6 + 0.5001) / 1e6).alias(c) if c in doubles else F.col(c) for c in df.columns
    ])


def bucketed(df: DataFrame, name: str) -> DataFrame:
    """Store a layer bucketed by place, as many buckets as the session has shuffle partitions."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tables.write_bucketed(df, path.rsplit("/", 1)[1].replace("-", "_"), path, "location_id", buckets, KEY)


class Gold:
    """The modelled layers of one folder. The facts are stored once, as several models read them.

    Bucketed by place, the models above need no further shuffle. The split forms of the models take
    plain files instead, so that a long series is not tied to one bucket.
    """

    def __init__(self, spark: SparkSession, folder: str, split: bool = False):
        facts = proxy.fact(spark, folder)
        self.fact = store(facts, "fact") if split else bucketed(facts, "fact")
        self.locations = proxy.dim_location(spark, folder)
        self.baseline = climate.climate_baseline(self.fact, proxy.BASELINE)
        self.anomaly = climate.climate_anomaly(self.fact, self.baseline)

    @property
    def features(self) -> DataFrame:
        return features.temperature_features(self.anomaly, self.fact, self.locations)


def scored_at():
    return F.lit(proxy.SCORED_AT).cast("timestamp")


def stamped(df: DataFrame) -> DataFrame:
    """The scoring time as text, the same in every engine."""
    return df.withColumn("scored_at", calendar.stamp(F.col("scored_at")))


# -- sources, raw and silver


def _land_versions(spark: SparkSession, folder: str) -> str:
    """Land every extraction run as replies of one place and year, with parallel arrays per measure."""
    target = work_dir(spark, "landing")
    # A reply holds at most the days of one year. They meet as rows: lists begun before the shuffle would hold a day or two each.
    reply = ("location_id", "extracted_at", "year")
    rows = proxy.weather_versions(spark, folder).withColumn("year", F.year("weather_date")).repartition(*reply)
    fields = [F.col("weather_date").cast("string").alias("time"), *[F.col(m) for m in schemas.MEASURES]]
    replies = rows.groupBy(*reply).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("days"),
        F.min("weather_date").alias("first"), F.max("weather_date").alias("last"),
    )
    names = {
        "time": "time", "temperature_max_c": "temperature_2m_max", "temperature_min_c": "temperature_2m_min",
        "temperature_mean_c": "temperature_2m_mean", "precipitation_mm": "precipitation_sum",
        "wind_gust_max_kmh": "wind_gusts_10m_max",
    }
    daily = F.struct(*[F.col(f"days.{ours}").alias(theirs) for ours, theirs in names.items()])
    payload = F.struct(daily.alias("daily"))
    landing.land(
        replies.select(*landing.envelope(
            F.col("location_id"), F.col("first"), F.col("last"), F.col("extracted_at"), payload
        )),
        target,
    )
    return target


@check(
    "S1 S2 S3 S4 S7 P1 P2 P3 P4 P5 ST1 ST2 ST3 ST5 ST6 ST7 M1 W11",
    f"select location_id, weather_date, {o.six(*schemas.MEASURES)}, extracted_at from newest_versions",
)
def bronze_silver(spark, folder):
    """Landing files as a stream to raw rows, and raw rows as a stream to the latest row per place and day."""
    base = work_dir(spark, "lakehouse")
    source = _land_versions(spark, folder)
    bronze.load_raw(spark, source, f"{base}/raw", f"{base}/raw_checkpoint").awaitTermination()
    silver.refresh_weather(spark, f"{base}/raw", f"{base}/weather", f"{base}/weather_checkpoint").awaitTermination()
    return rounded(silver.weather_table(spark, f"{base}/weather").read().drop(silver.SOURCE))


@check(
    "ST7",
    """select metric, cast(amount as bigint) as amount from (
        select count(*) as row_count, sum(case when weather_date is null then 1 else 0 end) as dropped_valid_key,
               sum(case when temperature_mean_c is null then 1 else 0 end) as dropped_complete_day,
               sum(case when temperature_max_c > 60 or temperature_max_c < -90 then 1 else 0 end) as plausible_temperature,
               sum(case when temperature_min_c > temperature_max_c then 1 else 0 end) as min_not_above_max,
               sum(case when precipitation_mm < 0 then 1 else 0 end) as non_negative_precipitation,
               count(distinct (location_id, extracted_at, year(weather_date))) as replies,
               0 as replies_without_rows from versions)
       unpivot (amount for metric in (row_count, dropped_valid_key, dropped_complete_day, plausible_temperature,
                                      min_not_above_max, non_negative_precipitation, replies, replies_without_rows))""",
)
def expectation_counts(spark, folder):
    """What the daily flow counts: rows dropped, rows warned about, replies without rows."""
    base = work_dir(spark, "counted")
    source = _land_versions(spark, folder)
    bronze.load_raw(spark, source, f"{base}/raw", f"{base}/raw_checkpoint").awaitTermination()
    keep = silver.metrics_sink(spark, f"{base}/expectations", "weather_daily")
    silver.refresh_weather(
        spark, f"{base}/raw", f"{base}/weather", f"{base}/weather_checkpoint", on_metrics=keep, max_files_per_trigger=50,
    ).awaitTermination()
    return silver.read_metrics(spark, f"{base}/expectations").groupBy("metric").agg(F.sum("amount").alias("amount"))


@check(
    "S3 P1 ST4 ST6 M2",
    "select location_id, city, country_code, country, region, latitude, longitude, elevation_m, timezone, population"
    " from locations",
)
def locations_silver(spark, folder):
    """Two landings of location replies; the later file wins."""
    base = work_dir(spark, "places")
    names = {"location_id": "id", "city": "name", "region": "admin1", "elevation_m": "elevation"}
    replies = proxy.locations(spark, folder).drop("_file_modified_at").withColumnsRenamed(names)
    old = replies.withColumns({"population": F.lit(1).cast("bigint"), "latitude": F.lit(0.0)})
    for number, rows in enumerate((old, replies)):
        landing.land(rows, f"{base}/landing/{number}")
        bronze.load_raw(spark, f"{base}/landing", f"{base}/raw", f"{base}/raw_checkpoint").awaitTermination()
        silver.refresh_locations(spark, f"{base}/raw", f"{base}/silver", f"{base}/checkpoint").awaitTermination()
    return silver.location_table(spark, f"{base}/silver").read().drop("_file_modified_at", silver.SOURCE)


@check(
    "S1 S2 S7 P1",
    "select location_id, extracted_at, count(distinct year(weather_date)) as replies from versions"
    " group by location_id, extracted_at",
)
def raw_landing(spark, folder):
    """Replies as VARIANT values with their source file, counted per place and run."""
    raw = landing.read_landing(spark, _land_versions(spark, folder)).where(
        F.col("_source_file").isNotNull() & F.col("_file_modified_at").isNotNull() & F.col("_ingested_at").isNotNull()
    )
    fields = nested.variant_fields({
        "location_id": ("$.location_id", "bigint"), "extracted_at": ("$.extracted_at", "string"),
    })
    return raw.select(*fields).groupBy("location_id", "extracted_at").agg(F.count(F.lit(1)).alias("replies"))


@check(
    "P1 P2 P3 P4",
    f"select location_id, weather_date, {o.six(*schemas.MEASURES)} from weather",
)
def variant_arrays(spark, folder):
    """Parallel arrays inside VARIANT values back to rows, without files."""
    rows = proxy.weather(spark, folder)
    fields = [F.col("weather_date").cast("string").alias("date_str"), *[F.col(m) for m in schemas.MEASURES]]
    replies = rows.groupBy("location_id", F.year("weather_date").alias("year")).agg(
        F.collect_list(F.struct(*fields)).alias("days")
    )
    body = F.struct("location_id", *[F.col(f"days.{c}").alias(c) for c in silver.ARRAYS])
    raw = replies.select(F.parse_json(F.to_json(body)).alias("raw"))
    paths = {"location_id": ("$.location_id", "bigint"), "date_str": ("$.date_str", "array<string>")}
    paths |= {m: (f"$.{m}", "array<double>") for m in schemas.MEASURES}
    exploded = nested.explode_parallel(raw.select(*nested.variant_fields(paths)), silver.ARRAYS, ["location_id"])
    day = F.to_date("date_str", "yyyy-MM-dd").alias("weather_date")
    return rounded(exploded.select("location_id", day, *schemas.MEASURES))


@check(
    "P1",
    "select event_type, cast(sum(cast(props->>'$.k' as bigint)) as bigint) as k_sum, count(*) as event_count"
    " from events group by event_type",
)
def json_scalars(spark, folder):
    """A scalar inside a JSON text, through VARIANT."""
    raw = proxy.table(spark, folder, "events").select("event_type", F.parse_json("props").alias("raw"))
    values = raw.select("event_type", *nested.variant_fields({"k": ("$.k", "bigint")}, tolerant=True))
    return values.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count(F.lit(1)).alias("event_count"))


@check("S5", "select city, country_code from locations")
def entity_list(spark, folder):
    """The list of requested places as CSV with a header."""
    path = work_dir(spark, "list")
    proxy.locations(spark, folder).select("city", "country_code").write.csv(path, header=True)
    return landing.read_entity_list(spark, path)


@check("S6 S7", "select location_id, city, country_code from locations")
def newest_snapshot(spark, folder):
    """Of two snapshots of the places, the one with the later stamp."""
    base = work_dir(spark, "snapshots")
    columns = ("location_id", "city", "country_code")
    places = proxy.locations(spark, folder).select(*columns)
    landing.land_snapshot(places.withColumn("city", F.lit("old")), base, "20010101T000000Z")
    landing.land_snapshot(places, base, "20011110T060000Z")
    return landing.newest_snapshot(spark, base, schemas.LOCATIONS).select(*columns)


_LATEST_EVENT = """
    select user_id, day, event_id, event_type, {value} as value from (
        select *, cast(ts as date) as day,
               row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) as rn
        from events)
    where rn = 1"""


@check("W11 ST5", _LATEST_EVENT.format(value=o.six_of("value")))
def latest_event(spark, folder):
    """The latest of many versions per key, as an aggregate."""
    events = proxy.table(spark, folder, "events").withColumn("day", F.col("ts").cast("date"))
    rows = events.select("user_id", "day", "event_id", "event_type", "value", "ts")
    return rounded(latest.keep_latest(rows, ("user_id", "day"), ("ts", "event_id")).drop("ts"))


_WARNINGS = """
    select count(*) as row_count,
        cast(count(*) filter (where not coalesce({0}, false)) as bigint) as plausible_temperature,
        cast(count(*) filter (where not coalesce({1}, false)) as bigint) as min_not_above_max,
        cast(count(*) filter (where not coalesce({2}, false)) as bigint) as non_negative_precipitation
    from weather""".format(
    "temperature_max_c is null or temperature_max_c between -90 and 40",
    "temperature_min_c is null or temperature_max_c is null or temperature_min_c <= temperature_max_c - 1",
    "precipitation_mm is null or precipitation_mm >= 1",
)


@check("ST7", _WARNINGS)
def expectations_warn(spark, folder):
    """Violations are counted, rows are kept; the limits are tightened so that there are some."""
    limits = {
        "plausible_temperature": "temperature_max_c is null or temperature_max_c between -90 and 40",
        "min_not_above_max": "temperature_min_c is null or temperature_max_c is null"
                             " or temperature_min_c <= temperature_max_c - 1",
        "non_negative_precipitation": "precipitation_mm is null or precipitation_mm >= 1",
    }
    return quality.count_violations(proxy.weather(spark, folder), limits)


@check(
    "ST6",
    "select location_id, city from locations where location_id is not null and latitude between -60 and 60"
    " and population is not null",
)
def expectations_drop(spark, folder):
    """Rows that fail an expectation are dropped; NULL counts as failing."""
    limits = {"valid_location": "location_id is not null and latitude between -60 and 60", "settled": "population >= 0"}
    return quality.drop_violations(proxy.locations(spark, folder), limits).select("location_id", "city")


# -- dimensions and facts


@check("M3 P8", "select * from dim_location")
def dim_location(spark, folder):
    return proxy.dim_location(spark, folder)


_LATITUDE = "((o_custkey * 37) % 181) - 90"


@check(
    "P8",
    f"""select hemisphere, latitude_band, count(*) as order_count from (
        select case when lat >= 0 then 'Northern' else 'Southern' end as hemisphere,
               case when abs(lat) < 23.5 then 'Tropical' when abs(lat) < 66.5 then 'Temperate' else 'Polar' end
                   as latitude_band
        from (select {_LATITUDE} as lat from orders)) group by hemisphere, latitude_band""",
)
def latitude_band(spark, folder):
    """Bands of a latitude."""
    from seriesloom.functions.geography import hemisphere
    from seriesloom.functions.geography import latitude_band as band

    latitude = (F.col("o_custkey") * 37) % 181 - 90
    banded = proxy.table(spark, folder, "orders").select(
        hemisphere(latitude).alias("hemisphere"), band(latitude).alias("latitude_band")
    )
    return banded.groupBy("hemisphere", "latitude_band").agg(F.count(F.lit(1)).alias("order_count"))


@check(
    "M4 P9 P10",
    """select d.*, coalesce(n, 0) as shipments from dim_date d left join (
        select cast(l_shipdate as date) as day, count(*) as n from lineitem group by 1) s on s.day = d.date_day""",
)
def dim_date(spark, folder):
    """Every calendar day with its attributes, and the shipments of that day."""
    shipped = proxy.table(spark, folder, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date_day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = proxy.dim_date(spark, folder).join(shipped, "date_day", "left")
    return joined.select(*schemas.DIM_DATE.fieldNames(), F.coalesce("n", F.lit(0)).alias("shipments"))


@check("M5 P5 P6 P7", f"select * exclude (temperature_mean_c), {o.six('temperature_mean_c')} from fact")
def fact_daily(spark, folder):
    return rounded(proxy.fact(spark, folder))


@check("S8 S13 S14 M5", f"select * exclude (temperature_mean_c), {o.six('temperature_mean_c')} from fact")
def clustered_fact(spark, folder):
    """The facts written as a layer, clustered by place and day, and read back."""
    path = tables.layer_path(work_dir(spark, "layers"), "gold", "fact_weather_daily")
    tables.clustered(proxy.fact(spark, folder), *KEY).write.parquet(path)
    return rounded(schemas.check_schema(spark.read.parquet(path), schemas.FACT_DAILY))


_FACT_OF_VERSIONS = f"""
    select location_id, cast(strftime(weather_date, '%Y%m%d') as integer) as date_key, weather_date,
           {o.six('temperature_mean_c')}, temperature_max_c - temperature_min_c as temperature_range_c, extracted_at
    from """
_FACT_COLUMNS = ("location_id", "date_key", "weather_date", "temperature_mean_c", "temperature_range_c", "extracted_at")


def _fact_table(spark: SparkSession) -> tables.VersionedTable:
    return tables.VersionedTable(
        spark, work_dir(spark, "fact"), schemas.FACT_DAILY, tables.place_year(4), ("extracted_at",))


@check("S12 F2 S10 U1", _FACT_OF_VERSIONS + "newest_versions")
def incremental_fact(spark, folder):
    """Two loads: the first run's rows, then only what is newer than the target, latest per key."""
    source = store(climate.fact_daily(proxy.weather_versions(spark, folder)), "versions")
    target = _fact_table(spark)
    first_run = source.where("extracted_at < '20020102'")
    for rows in (first_run, source):
        new = tables.newer_than_target(rows, target, "extracted_at")
        target.upsert_latest(new, KEY, ("extracted_at",))
    return rounded(target.read().select(*_FACT_COLUMNS))


@check("S11 U1", _FACT_OF_VERSIONS + "newest_versions")
def upsert(spark, folder):
    """All runs merged one after the other: equal keys are replaced, others added."""
    source = store(climate.fact_daily(proxy.weather_versions(spark, folder)), "versions")
    target = _fact_table(spark)
    for run in ("20020101T053000Z", "20020102T053000Z", "20020103T053000Z"):
        target.upsert(source.where(F.col("extracted_at") == run), KEY)
    return rounded(target.read().select(*_FACT_COLUMNS))


@check("S9", "select * from dim_location")
def overwrite_table(spark, folder):
    """A table replaced as a whole by one with other columns."""
    places = proxy.locations(spark, folder)
    target = tables.VersionedTable(spark, work_dir(spark, "dims"), schemas.LOCATIONS, F.lit("all"))
    target.overwrite(places)
    target.overwrite(dims.dim_location(places))
    return target.read()


@check(
    "S10",
    f"""select location_id, weather_date, {o.six('temperature_mean_c')}, cast(0 as bigint) as rows_before from weather""",
)
def empty_target(spark, folder):
    """A target created empty with a source's columns, counted, then loaded."""
    source = proxy.weather(spark, folder).select(*KEY, "temperature_mean_c")
    target = tables.VersionedTable(spark, work_dir(spark, "empty"), source.schema, tables.place_year(4))
    target.overwrite(tables.empty_like(source))
    before = target.read().count()
    target.upsert(source, KEY)
    return rounded(target.read()).withColumn("rows_before", F.lit(before).cast("bigint"))


# -- climate


@check("A1 A2 F1", f"select location_id, day_of_year, {o.six('mean_c', 'std_c', 'tmax_p90_c')} from reference")
def reference_days(spark, folder):
    return rounded(climate.reference_days(proxy.fact(spark, folder), proxy.BASELINE))


@check("A1 A2 M6", f"select location_id, day_of_year, {o.six('mean_c', 'std_c', 'tmax_p90_c')} from reference")
def merged_normals(spark, folder):
    """The reference days from states that arrived year by year, the first year in two halves."""
    facts = store(proxy.fact(spark, folder), "fact")
    parts = [F.quarter("weather_date") <= 2, F.quarter("weather_date") > 2]
    arrivals = [facts.where((F.year("weather_date") == 1995) & part) for part in parts]
    arrivals += [facts.where(F.year("weather_date") == year) for year in (1996, 1997, 1998)]
    state = normals.normal_state(arrivals[0], proxy.BASELINE)
    for more in arrivals[1:]:
        state = store(normals.merged(state, normals.normal_state(more, proxy.BASELINE)), "normal_state")
    return rounded(normals.reference_days(state, proxy.BASELINE))


@check(
    "M6 F1 A1 A2 W1",
    f"select location_id, day_of_year, {o.six('baseline_mean_c', 'baseline_std_c', 'baseline_tmax_p90_c')}"
    " from baseline",
)
def baseline(spark, folder):
    return rounded(proxy.baseline(spark, folder))


_ANOMALY = (
    "select * exclude (temperature_mean_c, baseline_mean_c), "
    + o.six("temperature_mean_c", "baseline_mean_c") + " from anomaly"
)


@check("M7 J2 W2 W3 W4", _ANOMALY)
def anomaly(spark, folder):
    return rounded(Gold(spark, folder).anomaly)


@check("M7 W2 W3 W4", _ANOMALY)
def anomaly_split(spark, folder):
    """As ``anomaly``, with no task ever holding more than a year of one place."""
    gold = Gold(spark, folder, split=True)
    stored = store(climate.deviations(gold.fact, gold.baseline), "deviations")
    return rounded(climate.flag_waves(series.run_lengths_split(stored, *KEY, "is_hot_day"), RunParams()))


@check(
    "W2 W3 W4",
    """select location_id, min(weather_date) as first_day, max(weather_date) as last_day,
              min(run_length_days) as run_length_days
       from (select *, count(*) over (partition by location_id, is_hot_day, island) as run_length_days from islands)
       where is_hot_day and run_length_days >= 2 group by location_id, island""",
)
def hot_runs(spark, folder):
    """Runs of at least two hot days, one row each."""
    hot = Gold(spark, folder).anomaly.where(F.col("hot_run_length_days") >= 2)
    first = F.date_sub("weather_date", F.row_number().over(series.by_day(*KEY)))
    return hot.withColumn("_run", first).groupBy("location_id", "_run").agg(
        F.min("weather_date").alias("first_day"), F.max("weather_date").alias("last_day"),
        F.min("hot_run_length_days").alias("run_length_days"),
    ).drop("_run")


@check(
    "W2 W3 W4 M7",
    """select location_id, is_hot_day, min(weather_date) as first_day, max(weather_date) as last_day
       from islands group by location_id, is_hot_day, island""",
)
def resumed_runs(spark, folder):
    """All runs of hot and other days, from days that arrived in three portions: every other month first, then the newest year, then the rest."""
    gold = Gold(spark, folder)
    days = store(gold.anomaly.select("location_id", "weather_date", "is_hot_day"), "days")
    newest, odd = F.year("weather_date") >= 2001, F.month("weather_date") % 2 == 1
    key = (*KEY, "is_hot_day")
    state = store(runs.runs_of(days.where(~newest & odd), *key), "runs")
    for part in (newest, ~newest & ~odd):
        state = store(runs.advanced(state, days.where(part), *key), "runs")
    return state


@check(
    "J1",
    f"""select season_code, {o.six_of('avg(temperature_mean_c)')} as mean_c, count(*) as days
        from fact join dim_date using (date_key) group by season_code""",
)
def season_means(spark, folder):
    """Facts with the calendar dimension; the calendar is bounded, so it may be broadcast."""
    joined = proxy.fact(spark, folder).join(F.broadcast(proxy.dim_date(spark, folder)), "date_key")
    return rounded(joined.groupBy("season_code").agg(
        F.avg("temperature_mean_c").alias("mean_c"), F.count(F.lit(1)).alias("days")
    ))


# -- features


_LAGS = ["anomaly_lag0", "anomaly_lag1", "anomaly_lag2", "anomaly_lag3", "anomaly_lag7"]
_INPUTS = [
    *_LAGS, "anomaly_mean_7d", "anomaly_mean_30d", "anomaly_std_7d", "precipitation_sum_7d", "wind_gust_max_kmh",
    "temperature_range_c", "doy_sin", "doy_cos", "latitude", "elevation_m",
]
_TARGETS = [f"target_h{h}" for h in range(1, 8)]
_FEATURES = f"select location_id, weather_date, {o.six(*_INPUTS, *_TARGETS)} from features"


@check("M8 J3 J4 W5 W6 W7 W8 W9 P11", _FEATURES)
def feature_table(spark, folder):
    return rounded(Gold(spark, folder).features)


@check("M8 W5 W6 W7 W8 W9", _FEATURES)
def feature_table_split(spark, folder):
    """As ``feature_table``, with each place's days cut into blocks that overlap by the frames' reach."""
    gold = Gold(spark, folder, split=True)
    days = store(climate.deviations(gold.fact, gold.baseline), "deviations")
    return rounded(features.temperature_features(days, gold.fact, gold.locations, split=True))


@check(
    "P11",
    f"""select event_type, {o.six_of('sum(sin(2 * pi() * dayofyear(ts) / 365.25))')} as sine,
               {o.six_of('sum(cos(2 * pi() * dayofyear(ts) / 365.25))')} as cosine
        from events group by event_type""",
)
def cyclical(spark, folder):
    """Position in the year as sine and cosine."""
    sine, cosine = calendar.cycle(F.dayofyear("ts"))
    return rounded(proxy.table(spark, folder, "events").groupBy("event_type").agg(
        F.sum(sine).alias("sine"), F.sum(cosine).alias("cosine")
    ))


@check(
    "P12 U2 F4",
    f"select location_id, weather_date, {o.six(*_INPUTS)}, horizon, {o.six('target')}, target_date from long_targets",
)
def targets_long(spark, folder):
    return rounded(features.long_targets(Gold(spark, folder).features))


@check(
    "W10 F4",
    f"select location_id, weather_date, {o.six(*_INPUTS)} from newest_usable",
)
def newest_row(spark, folder):
    """The newest usable feature row of each place."""
    usable = Gold(spark, folder).features.na.drop(subset=["anomaly_lag7", "anomaly_std_7d"]).drop(*_TARGETS)
    return rounded(series.newest_row(usable, *KEY))


@check(
    "F5 F6",
    """select y.test_year, count(*) filter (where weather_date >= date '1996-01-01'
                  and target_date < make_date(y.test_year, 1, 1)) as train_rows,
              count(*) filter (where weather_date >= make_date(y.test_year, 1, 1)
                  and target_date <= make_date(y.test_year, 12, 31)) as test_rows
       from long_targets cross join (select cast(n as integer) as test_year from range(1999, 2002) t(n)) y
       group by y.test_year""",
)
def time_split(spark, folder):
    """Sizes of the training and test sets of each test year, without a leak."""
    long = store(features.long_targets(Gold(spark, folder).features).select("weather_date", "target_date"), "long")
    # Training rows begin in 1996, so both conditions go into one aggregate over all rows.
    known = F.year("weather_date") >= 1996
    sizes = long.agg(*[
        F.count_if(c).alias(f"{kind}_{y}") for y in proxy.BACKTEST.test_years
        for kind, c in (("train_rows", known & backtest.is_train(y)), ("test_rows", backtest.is_test(y)))
    ])
    years = F.array(*[
        F.struct(F.lit(y).alias("test_year"), F.col(f"train_rows_{y}").alias("train_rows"), F.col(f"test_rows_{y}").alias("test_rows"))
        for y in proxy.BACKTEST.test_years
    ])
    return sizes.select(F.inline(years))


# -- backtest and skill


def _closed_form_metrics(spark: SparkSession, folder: str) -> DataFrame:
    long = features.long_targets(Gold(spark, folder).features)
    rows = backtest.test_rows(long, proxy.BACKTEST.test_years[0], proxy.BACKTEST.test_years[-1])
    return backtest.score(backtest.damped_persistence(rows))


_METRICS = ("mae_model", "mae_persistence", "mae_climatology", "mae_recent_normal", "skill_vs_climatology",
            "skill_vs_persistence", "skill_vs_recent_normal", "coverage_80")


@check("A8 A9 A10 F6 M15", f"select test_year, horizon, test_rows, {o.six(*_METRICS)} from metrics")
def backtest_metrics(spark, folder):
    """A closed-form forecast against three simple ones, per test year and horizon."""
    return rounded(_closed_form_metrics(spark, folder))


@check(
    "A11",
    "select horizon, " + ", ".join(f"{o.six_of(f'avg({m})')} as {m}" for m in _METRICS) + " from metrics group by horizon",
)
def mean_metrics(spark, folder):
    return rounded(backtest.mean_metrics(_closed_form_metrics(spark, folder)))


@check("A7 M13", "select * from skill_summary")
def model_skill(spark, folder):
    return backtest.model_skill(_closed_form_metrics(spark, folder))


@check(
    "A15",
    """select cast(floor(avg(coverage_80) * 100 + 0.5) as integer) as coverage_percent from skill_summary""",
)
def coverage_percent(spark, folder):
    return reads.coverage_percent(backtest.model_skill(_closed_form_metrics(spark, folder)))


@check(
    "A15",
    "select horizon_days, cast(floor(skill_vs_recent_normal * 100 + 0.5) as integer) as skill_percent"
    " from skill_summary",
)
def skill_percent(spark, folder):
    return reads.skill_percent(backtest.model_skill(_closed_form_metrics(spark, folder)))


# -- forecast


def _closed_form(gold: Gold) -> DataFrame:
    return forecast.make_forecast(
        gold.features, gold.baseline, backtest.damped_persistence, "damped_persistence", 1, scored_at()
    )


def _hindcast(gold: Gold) -> DataFrame:
    """A forecast from every usable day, not only the newest: a long forecast history."""
    usable = gold.features.na.drop(subset=["anomaly_lag7", "anomaly_std_7d"])
    scored = backtest.damped_persistence(features.with_horizons(usable))
    return forecast.forecast_rows(scored, gold.baseline, "damped_persistence", 1, scored_at())


_FORECAST_VALUES = (
    "anomaly_low_c", "anomaly_mid_c", "anomaly_high_c", "baseline_mean_c",
    "temperature_low_c", "temperature_mid_c", "temperature_high_c",
)
_FORECAST = (
    f"select location_id, date_key, target_date, forecast_made_date, horizon_days, {o.six(*_FORECAST_VALUES)},"
    " model_name, model_version, scored_at from "
)


@check("M14 P13 P14 P15 J7 T7 W10", _FORECAST + "forecast")
def forecast_rows(spark, folder):
    """Forecasts for the newest day of each place, from a closed-form predictor."""
    return rounded(stamped(_closed_form(Gold(spark, folder))))


@check("M14 S10 S11", _FORECAST + "forecast")
def forecast_upsert(spark, folder):
    """The same day scored twice leaves one set of rows."""
    target = forecast.forecast_table(spark, work_dir(spark, "forecast"))
    rows = store(_closed_form(Gold(spark, folder)), "scored")
    forecast.store_forecast(target, rows.withColumn("anomaly_mid_c", F.lit(0.0)))
    forecast.store_forecast(target, rows)
    return rounded(stamped(target.read()))


@check("M12 J9", "select * from forecast_latest")
def forecast_latest(spark, folder):
    """All horizons of each place's newest forecast, out of the whole history."""
    return stamped(serving.forecast_latest(_hindcast(Gold(spark, folder))))


@check(
    "A17",
    """select location_id, target_date, horizon_days, week_low_c, week_high_c,
              """ + ", ".join(
        f"{o.six_of(f'(temperature_{q}_c - week_low_c) / (case when week_high_c = week_low_c then 1 else week_high_c - week_low_c end) * 100')}"
        f" as {q}_position" for q in ("low", "mid", "high")
    ) + """
       from (select *, min(temperature_low_c) over (partition by location_id) as week_low_c,
                    max(temperature_high_c) over (partition by location_id) as week_high_c from forecast_latest)""",
)
def forecast_week(spark, folder):
    return rounded(reads.forecast_week(serving.forecast_latest(_closed_form(Gold(spark, folder)))))


@check(
    "T7",
    f"""select event_id, {o.six_of('x[1]')} as low, {o.six_of('x[2]')} as mid, {o.six_of('x[3]')} as high from (
        select event_id, list_sort([value, 100 - value, 50.0]) as x from events)""",
)
def ordered_quantiles(spark, folder):
    """Three values per row put in order."""
    rows = proxy.table(spark, folder, "events").select(
        "event_id", F.col("value").alias("low"), (100 - F.col("value")).alias("mid"), F.lit(50.0).alias("high")
    )
    return rounded(backtest.order_quantiles(rows))


# -- serving


@check("M9 A3 A4 A5 F3 J5 J6", "select * from city_summary")
def city_summary(spark, folder):
    gold = Gold(spark, folder)
    return serving.city_summary(gold.locations, gold.anomaly, SERVING)


@check("M10 A6 J1 J3", "select * from city_yearly")
def city_yearly(spark, folder):
    gold = Gold(spark, folder)
    return serving.city_yearly(gold.anomaly, gold.fact, SERVING)


@check("M11 F3 J3 J5", f"select * exclude (temperature_mean_c), {o.six('temperature_mean_c')} from city_recent")
def city_recent_daily(spark, folder):
    gold = Gold(spark, folder)
    return rounded(serving.city_recent_daily(gold.anomaly, gold.fact, SERVING))


@check("A3", "select location_id, first_date, latest_date, days_loaded from history")
def series_bounds(spark, folder):
    history = serving.series_history(Gold(spark, folder).anomaly, SERVING)
    return history.select("location_id", "first_date", "latest_date", "days_loaded")


@check("A12", "select max(latest_date) as data_through from city_summary")
def data_through(spark, folder):
    return Gold(spark, folder).anomaly.agg(F.max("weather_date").alias("data_through"))


# -- reads over the serving tables


def _summary(spark, folder):
    gold = Gold(spark, folder)
    return serving.city_summary(gold.locations, gold.anomaly, SERVING)


def _yearly(spark, folder):
    gold = Gold(spark, folder)
    return serving.city_yearly(gold.anomaly, gold.fact, SERVING)


@check("M18 T1 P16", "select * from city_summary")
def read_cities(spark, folder):
    return reads.read_all(_summary(spark, folder), "city")


@check("M18 F8 T1", "select * from city_yearly where location_id = 7")
def read_yearly(spark, folder):
    """One place's years."""
    return reads.read_entity(_yearly(spark, folder), 7, "year")


@check(
    "M18 F8 T1",
    f"select * exclude (temperature_mean_c), {o.six('temperature_mean_c')} from city_recent where location_id = 7",
)
def read_recent(spark, folder):
    gold = Gold(spark, folder)
    return rounded(reads.read_entity(serving.city_recent_daily(gold.anomaly, gold.fact, SERVING), 7, "weather_date"))


@check("M18 F8 T1", "select * from forecast_latest where location_id = 7")
def read_forecast(spark, folder):
    return stamped(reads.read_entity(serving.forecast_latest(_closed_form(Gold(spark, folder))), 7, "horizon_days"))


@check("M18 T1", "select * from skill_summary")
def read_skill(spark, folder):
    return reads.read_all(backtest.model_skill(_closed_form_metrics(spark, folder)), "horizon_days")


@check(
    "T3 P17 P18",
    f"""select location_id, city, anomaly_30d_c, {o.words_day('anomaly_30d_c')} as in_words,
               greatest(-1.0, least(1.0, anomaly_30d_c / 4.0)) as scale
        from city_summary where has_history and anomaly_30d_c is not null
        order by abs(anomaly_30d_c) desc, city, location_id limit 3""",
)
def standouts(spark, folder):
    return reads.standouts(_summary(spark, folder))


@check(
    "T4",
    """select location_id, city from city_summary where has_history
       order by abs(anomaly_30d_c) desc nulls last, city, location_id limit 1""",
)
def default_entity(spark, folder):
    return reads.default_entity(_summary(spark, folder))


@check("T6", "select location_id, city, has_history from city_summary")
def entity_menu(spark, folder):
    return reads.entity_menu(_summary(spark, folder))


@check(
    "A18",
    """select count(*) as total, count(*) filter (where has_history) as ready, max(latest_date) as data_through,
              cast(floor(count(*) filter (where has_history) * (max(latest_date) - date '1995-01-02' + 1) / 1000 + 0.5)
                   * 1000 as bigint) as records
       from city_summary""",
)
def load_progress(spark, folder):
    return reads.load_progress(_summary(spark, folder), datetime.date(1995, 1, 2))


@check(
    "P17 P18",
    f"""select location_id, year, anomaly_c, greatest(-1.0, least(1.0, anomaly_c / 2.5)) as scale,
               {o.words_year('anomaly_c')} as in_words
        from city_yearly where is_complete_year""",
)
def year_scale(spark, folder):
    return reads.year_scale(_yearly(spark, folder))


@check(
    "W12",
    f"""select location_id, year, anomaly_c, {o.six_of('''case when row_number() over (partition by location_id
            order by year) >= 3 then avg(anomaly_c) over (partition by location_id order by year
            rows between 2 preceding and current row) end''')} as moving_mean from city_yearly where is_complete_year""",
)
def moving_average(spark, folder):
    """The trailing mean over years, here of three because the tables cover seven."""
    return rounded(reads.moving_average(_yearly(spark, folder), 3))


@check(
    "T5",
    """select location_id, year, anomaly_c, warm_rank from (
        select location_id, year, anomaly_c, cast(row_number() over (
            partition by location_id order by anomaly_c desc, year) as integer) as warm_rank from city_yearly
            where is_complete_year)
       where warm_rank <= 3""",
)
def warmest_years(spark, folder):
    return reads.warmest_years(_yearly(spark, folder), 3)


_LONG_VIEW = f"""
    select location_id, cast(min(year) as integer) as first_year,
           min(case when newest <= 3 then year end) as recent_from, max(year) as recent_to,
           avg(case when newest <= 3 then anomaly_c end) as recent_mean_c,
           count(*) filter (where warmest <= 3 and year >= 1999) as recent_records
    from (select *, count(*) over (partition by location_id) as years,
                 row_number() over (partition by location_id order by year desc) as newest,
                 row_number() over (partition by location_id order by anomaly_c desc, year) as warmest
          from city_yearly where is_complete_year)
    where years >= 5 group by location_id"""


@check(
    "A16 F9 T5 P17",
    f"""select * exclude (recent_mean_c), {o.r('recent_mean_c', 4)} as recent_mean_c,
               {o.words_year(o.r('recent_mean_c', 4))} as in_words from ({_LONG_VIEW})""",
)
def long_view(spark, folder):
    rows = reads.long_view(_yearly(spark, folder), **LONG_VIEW)
    mean = round_half_up(F.col("recent_mean_c"), 4)
    return rows.withColumn("recent_mean_c", mean).withColumn("in_words", describe_vs_average(F.col("recent_mean_c")))


@check(
    "U3 W13 P19",
    f"""select location_id, day, kind, {o.six('value', 'usual', 'low', 'high')} from (
        select location_id, weather_date as day, 'measured' as kind, temperature_mean_c as value,
               baseline_mean_c as usual, null as low, null as high
        from (select *, row_number() over (partition by location_id order by weather_date desc) as rn from city_recent)
        where rn <= 21
        union all
        select location_id, target_date, 'forecast', temperature_mid_c, temperature_mid_c - anomaly_mid_c,
               temperature_low_c, temperature_high_c
        from forecast_latest)""",
)
def timeline(spark, folder):
    gold = Gold(spark, folder)
    gold.anomaly = bucketed(gold.anomaly, "anomaly")
    recent = serving.city_recent_daily(gold.anomaly, gold.fact, SERVING)
    return rounded(reads.timeline(recent, serving.forecast_latest(_closed_form(gold))))


@check(
    "P17 P18",
    f"""select in_words, vs_average, scale, count(*) as line_count from (
        select {o.words_day('x')} as in_words, {o.words_year('x')} as vs_average,
               greatest(-1.0, least(1.0, x / 4.0)) as scale
        from (select round(l_quantity - 25) / 8 as x from lineitem)) group by in_words, vs_average, scale""",
)
def wording(spark, folder):
    """Differences in words and on a clamped scale; eighths are exact, so that text agrees."""
    x = F.round(F.col("l_quantity") - 25) / 8
    rows = proxy.table(spark, folder, "lineitem").select(
        describe_anomaly(x).alias("in_words"), describe_vs_average(x).alias("vs_average"),
        clamp_scale(x, 4.0).alias("scale"),
    )
    return rows.groupBy("in_words", "vs_average", "scale").agg(F.count(F.lit(1)).alias("line_count"))


@check(
    "P16",
    f"select event_id, case when value > 0 then {o.six_of('sqrt(value)')} end as root from events",
)
def nan_cleaned(spark, folder):
    """NaN becomes NULL on the way out."""
    root = F.sqrt(F.when(F.col("value") > 0, F.col("value")).otherwise(F.lit(-1.0)))
    return rounded(reads.clean(proxy.table(spark, folder, "events").select("event_id", nan_to_null(root).alias("root"))))


# -- planning


@check(
    "M17 J11 A13",
    """select requested_city, requested_country_code, id, population from (
        select c_mktsegment as requested_city,
               'N' || lpad(cast(asked.n_nationkey as varchar), 2, '0') as requested_country_code,
               c_custkey as id, case when c_acctbal >= 0 then cast(round(c_acctbal * 100) as bigint) end as population,
               row_number() over (partition by c_mktsegment, asked.n_nationkey
                   order by coalesce(case when c_acctbal >= 0 then cast(round(c_acctbal * 100) as bigint) end, 0) desc,
                            c_custkey) as rn
        from customer join nation home on c_nationkey = home.n_nationkey
        join nation asked on asked.n_regionkey = home.n_regionkey
        where home.n_nationkey = asked.n_nationkey)
       where rn = 1""",
)
def resolve_locations(spark, folder):
    """The best candidate in the requested country, out of candidates from all over its region."""
    customer, nation = proxy.table(spark, folder, "customer"), proxy.table(spark, folder, "nation")
    code = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey", code.alias("country_code"))
    asked = nation.select("n_regionkey", code.alias("requested_country_code"))
    candidates = customer.join(home, "c_nationkey").join(asked, "n_regionkey").select(
        F.col("c_mktsegment").alias("requested_city"), "requested_country_code", "country_code",
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("population"),
        F.col("c_custkey").alias("reply_position"),
    )
    requested = customer.join(home, "c_nationkey").select(F.col("c_mktsegment").alias("city"), "country_code").distinct()
    resolved = planning.resolve_locations(requested, candidates)
    return resolved.select("requested_city", "requested_country_code", "id", "population")


@check(
    "M16 F7 J8 T2",
    """select location_id, 'refresh' as request, date '2001-10-21' as start_date, date '2001-11-04' as end_date
       from locations where location_id in (select location_id from known)
       union all
       select * from (
           select location_id, 'backfill', date '1995-01-02', date '2001-11-04' from locations
           where location_id not in (select location_id from known) order by location_id limit 4)""",
)
def backfill_plan(spark, folder):
    entities = proxy.locations(spark, folder).select("location_id", F.col("location_id").alias("list_position"))
    return planning.backfill_plan(entities, proxy.weather(spark, folder), proxy.TODAY, proxy.PLANNING)


# -- quality


@check(
    "J10 Q3",
    "select doc_id, count(*) as orphan_rows from documents where doc_id is not null"
    " and not exists (select 1 from labels where labels.doc_id = documents.doc_id) group by doc_id",
)
def orphans(spark, folder):
    """Documents without a label."""
    return quality.orphans(proxy.table(spark, folder, "documents"), "doc_id", proxy.table(spark, folder, "labels"))


@check(
    "F7 Q4",
    "select l_orderkey, l_linenumber, count(*) as copies from lineitem group by all having count(*) > 1",
)
def duplicate_keys(spark, folder):
    """Line numbers that an order uses more than once."""
    return quality.duplicate_keys(proxy.table(spark, folder, "lineitem"), ("l_orderkey", "l_linenumber"))


@check(
    "A14",
    "select count(*) as row_count, count(distinct location_id) as places from weather",
)
def count_rows(spark, folder):
    return proxy.weather(spark, folder).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("location_id").alias("places")
    )


_QUALITY = """
    select 'fact_weather_daily' as table_name, 'not_null' as check_name, 'location_id' as column_names,
           count(*) filter (where location_id is null) as violations from fact
    union all select 'fact_weather_daily', 'not_null', 'date_key', count(*) filter (where date_key is null) from fact
    union all select 'fact_weather_daily', 'unique', 'location_id,date_key',
        (select count(*) from (select 1 from fact group by location_id, date_key having count(*) > 1))
    union all select 'fact_weather_daily', 'relationship', 'location_id',
        (select count(*) from fact where location_id not in (select location_id from dim_location))
    union all select 'fact_weather_daily', 'relationship', 'date_key',
        (select count(*) from fact where date_key not in (select date_key from dim_date))
    union all select 'dim_location', 'not_null', 'location_id',
        (select count(*) from dim_location where location_id is null)
    union all select 'dim_location', 'unique', 'location_id',
        (select count(*) from (select 1 from dim_location group by location_id having count(*) > 1))
    union all select 'dim_location', 'unique', 'country_code',
        (select count(*) from (select 1 from dim_location group by country_code having count(*) > 1))
    union all select 'dim_location', 'not_null', 'population',
        (select count(*) from dim_location where population is null)"""


@check("Q1 Q2 Q3 Q4 Q5", _QUALITY)
def quality_report(spark, folder):
    """Table tests as one table; two of them are meant to fail, to show that they can."""
    fact = store(proxy.fact(spark, folder), "fact")
    places, calendar_days = proxy.dim_location(spark, folder), proxy.dim_date(spark, folder)
    name = "fact_weather_daily"
    return quality.report([
        quality.not_null(name, fact, ("location_id", "date_key")),
        quality.unique(name, fact, ("location_id", "date_key")),
        quality.relationship(name, fact, "location_id", places),
        quality.relationship(name, fact, "date_key", calendar_days),
        quality.not_null("dim_location", places, ("location_id", "population")),
        quality.unique("dim_location", places, ("location_id",)),
        quality.unique("dim_location", places, ("country_code",)),
    ])


@check(
    "Q6",
    """select event_type, max(ts) < timestamp '2024-01-30 18:00:00' - interval 30 hour
                 or max(ts) is null as is_stale
       from events group by event_type""",
)
def staleness(spark, folder):
    """Whether the newest event of each kind is more than 30 hours old."""
    now = F.lit("2024-01-30 18:00:00").cast("timestamp")
    newest = proxy.table(spark, folder, "events").groupBy("event_type").agg(F.max("ts").cast("timestamp").alias("newest"))
    return newest.select("event_type", quality.stale(F.col("newest"), now).alias("is_stale"))


# -- publishing


def _serving_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    gold = Gold(spark, folder)
    gold.anomaly = bucketed(gold.anomaly, "anomaly")
    long = features.long_targets(gold.features)
    rows = backtest.test_rows(long, proxy.BACKTEST.test_years[0], proxy.BACKTEST.test_years[-1])
    return {
        "city_summary": serving.city_summary(gold.locations, gold.anomaly, SERVING),
        "city_yearly": serving.city_yearly(gold.anomaly, gold.fact, SERVING),
        "city_recent_daily": serving.city_recent_daily(gold.anomaly, gold.fact, SERVING),
        "forecast_latest": serving.forecast_latest(_closed_form(gold)),
        "model_skill": backtest.model_skill(backtest.score(backtest.damped_persistence(rows))),
    }


@check(
    "S15 S16 S17 U4 A12 M18",
    """select *, (select max(latest_date) from city_summary) as data_through, 'ok' as status from (
        select 'city_summary' as table_name, count(*) as row_count from city_summary
        union all select 'city_yearly', count(*) from city_yearly
        union all select 'city_recent_daily', count(*) from city_recent
        union all select 'forecast_latest', count(*) from forecast_latest
        union all select 'model_skill', count(*) from skill_summary)""",
)
def publish_health(spark, folder):
    """Export all serving tables, check them against the manifest, publish, and read the status."""
    base = work_dir(spark, "export")
    publish.export_tables(spark, _serving_tables(spark, folder), f"{base}/staging", EXPORTED_AT)
    publish.publish(spark, f"{base}/staging", f"{base}/live", SERVING.tables)
    return publish.health(spark, f"{base}/live").select("table_name", "row_count", "data_through", "status")


@check(
    "U4 S17",
    """select table_name, problem, stated_rows, found_rows from (
        select 'supplier' as table_name, 'wrong row count' as problem, (select count(*) + 1 from supplier) as stated_rows,
               (select count(*) from supplier) as found_rows
        union all select 'part', 'not in the manifest', null, (select count(*) from part)
        union all select 'events', 'unexpected table', (select count(*) from events), null
        union all select 'orders', 'not staged', (select count(*) from orders), null)""",
)
def manifest_differences(spark, folder):
    """Everything that is wrong with an export: a wrong count, and missing or unexpected tables."""
    def sizes(*names: str) -> DataFrame:
        return publish.table_sizes({n: proxy.table(spark, folder, n) for n in names})

    stated = sizes("supplier", "events", "orders", "customer").withColumn(
        "row_count", F.col("row_count") + F.when(F.col("table_name") == "supplier", 1).otherwise(0)
    )
    expected = spark.createDataFrame([("supplier",), ("part",), ("orders",), ("customer",)], "table_name STRING")
    return publish.manifest_differences(stated, expected, sizes("supplier", "part", "customer"))


# -- learning: what a model says is not SQL, what its rows are and what must hold for them is

BOOST = BoostParams()


def _beats_constants(model, rows: DataFrame) -> bool:
    """Whether each quantile loses less on the rows it learnt from than the best constant."""
    levels = {name: (m.level, m.start) for name, m in model.models.items()}
    losses = model.predict(rows).agg(*[
        (F.avg(pinball(F.col("target"), F.col(name), level)) < F.avg(pinball(F.col("target"), F.lit(start), level))).alias(name)
        for name, (level, start) in levels.items()
    ]).first()
    return all(losses)


@check(
    "ML1 ML3 ML4 ML5 ML6 M14",
    f"""select location_id, date_key, target_date, forecast_made_date, horizon_days, {o.six('baseline_mean_c')},
               'temperature' as model_name, model_version, scored_at, true as is_ordered, true as is_shifted, true as beats_constants
        from forecast""",
)
def boosted_forecast(spark, folder):
    """Train 200 rounds, register, load the champion and score the newest day of every place.

    ``is_ordered``: low <= mid <= high; ``is_shifted``: temperatures are the normal plus the deviations, NULL without one.
    """
    gold = Gold(spark, folder)
    table = bucketed(gold.features, "features")
    registry = Registry(spark, work_dir(spark, "registry"))
    training.train(table, registry, "temperature", proxy.BACKTEST.train_start_year, BOOST)
    model, _ = registry.load("temperature")
    better = _beats_constants(model, training.training_rows(table, proxy.BACKTEST.train_start_year))
    rows = stamped(training.score_champion(table, gold.baseline, registry, "temperature", scored_at()))
    quantiles = ("low", "mid", "high")
    shifted = [F.abs(F.col(f"temperature_{q}_c") - F.col("baseline_mean_c") - F.col(f"anomaly_{q}_c")) < 1e-9 for q in quantiles]
    without = [F.col(f"temperature_{q}_c").isNull() for q in quantiles]
    return rounded(rows.select(
        "location_id", "date_key", "target_date", "forecast_made_date", "horizon_days", "baseline_mean_c", "model_name", "model_version",
        "scored_at", F.expr("anomaly_low_c <= anomaly_mid_c and anomaly_mid_c <= anomaly_high_c").alias("is_ordered"),
        F.when(F.col("baseline_mean_c").isNull(), reduce(and_, without)).otherwise(reduce(and_, shifted)).alias("is_shifted"),
        F.lit(better).alias("beats_constants"),
    ))


@check(
    "ML1 ML2 ML5 A8 A9 A10 M15",
    f"""select test_year, horizon, test_rows, {o.six('mae_persistence', 'mae_climatology', 'mae_recent_normal')},
               true as skills_fit, true as is_useful from metrics""",
)
def boosted_backtest(spark, folder):
    """One fit of 200 rounds per test year on what was known before it, all in the same passes.

    ``skills_fit``: skills follow from the errors; ``is_useful``: some of the range is covered, and the middle is not much worse
    than no deviation at all, which is the best forecast where the table is noise.
    """
    table = bucketed(Gold(spark, folder).features, "features")
    metrics = training.backtest(table, proxy.BACKTEST, BOOST)
    fits = [F.abs(F.col(f"skill_vs_{n}") - (1 - F.col("mae_model") / F.col(f"mae_{n}"))) < 1e-9 for n in ("climatology", "persistence", "recent_normal")]
    return rounded(metrics.select(
        "test_year", "horizon", "test_rows", "mae_persistence", "mae_climatology", "mae_recent_normal",
        reduce(and_, fits).alias("skills_fit"),
        F.expr("mae_model < 1.15 * mae_climatology and coverage_80 between 0.5 and 0.95").alias("is_useful"),
    ))


SHORT = BoostParams(rounds=2, depth=2)


@check(
    "ML3 ML4",
    """select 'temperature' as model_name, v.version, v.version = 2 as is_champion, 2 as rounds, (select count(*) from long_targets) as train_rows
       from (select 1 as version union all select 2) v""",
)
def model_versions(spark, folder):
    """Two short trainings: both versions are kept, the newer one is the champion and loads with its rounds."""
    table = bucketed(Gold(spark, folder).features, "features")
    registry = Registry(spark, work_dir(spark, "registry"))
    for _ in range(2):
        training.train(table, registry, "temperature", proxy.BACKTEST.train_start_year, SHORT)
    model, champion = registry.load("temperature")
    rounds = {len(m.steps) for m in model.models.values()}
    counted = registry.run_log().where("name = 'train_rows'").agg(F.max(F.col("text_value").cast("bigint"))).first()[0]
    return registry.versions("temperature").select(
        "model_name", "version", (F.col("version") == champion).alias("is_champion"), F.lit(max(rounds)).alias("rounds"),
        F.lit(counted).cast("bigint").alias("train_rows"),
    )


@check(
    "ML6",
    """select 'train_final' as run_name, 'param' as kind, 'train_rows' as name, cast((select count(*) from long_targets) as varchar) as text_value
       union all select 'train_final', 'param', 'train_start_year', '1995'
       union all select 'train_final', 'param', 'train_end_date', cast((select max(weather_date) from features) as varchar)
       union all select 'train_final', 'param', 'features', '16'
       union all select 'backtest', 'param', 'features', '16'
       union all select 'backtest', 'param', 'test_years', '[1999, 2000, 2001]'
       union all select 'backtest', 'param', 'train_start_year', '1995'
       union all select 'backtest', 'param', 'quantiles', '[0.1, 0.5, 0.9]'
       union all select distinct 'backtest', 'metric', 'mae_climatology_h' || horizon, null from metrics""",
)
def run_log(spark, folder):
    """What a short training and a short backtest leave in the run log: their parameters, and the metrics' names per horizon."""
    table = bucketed(Gold(spark, folder).features, "features")
    registry = Registry(spark, work_dir(spark, "registry"))
    training.train(table, registry, "temperature", proxy.BACKTEST.train_start_year, SHORT)
    training.backtest(table, proxy.BACKTEST, SHORT, registry)
    logged = registry.run_log().where("kind = 'param' or name like 'mae\\_climatology\\_h%'")
    return logged.select("run_name", "kind", "name", "text_value")
