"""Every operator bound to the test tables: name -> (spark, folder) -> DataFrame.

Each query reads whole tables. Computed doubles are rounded here, and only here, so that two engines
that add in a different order agree; library results keep full precision. Time spans fit the tables:
events of one type come minutes apart, events of one user hours apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucospan.functions import clinical, text
from glucospan.operators import asof, boosting, events, export, joins, metrics, quality, selection, slices, windows
from glucospan.operators.windows import Trailing
from glucospan.plans import features, per_series, training
from glucospan.schema import ForecastTable
from glucospan.sources import series_csv, sinks
from glucospan.storage import fresh_folder, stored

QUERIES = {}
DAY_MINUTES = 1440


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Zone-less times are counted in microseconds, which must not follow a local clock.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_k(df: DataFrame) -> DataFrame:
    """Events with the number inside ``props`` as ``k``."""
    return df.withColumn("k", text.numeric_clean(F.col("props")))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    # Adding zero turns a rounded -0.0 into 0.0.
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def doubles(df: DataFrame) -> list[str]:
    return [n for n, kind in df.dtypes if kind == "double"]


def rounded_all(df: DataFrame, digits: int = 8) -> DataFrame:
    return rounded(df, digits, *doubles(df))


# Row-level expressions


@query
def numeric_clean(spark, folder):
    return with_k(table(spark, folder, "events")).select("event_id", F.col("k").alias("number"))


@query
def numeric_clean_mixed(spark, folder):
    part = table(spark, folder, "part").select(F.lit("part").alias("kind"), F.col("p_brand").alias("raw"))
    orders = table(spark, folder, "orders").select(
        F.lit("orders"), F.concat(F.lit("<"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" USD"))
    )
    customer = table(spark, folder, "customer").select(F.lit("customer"), "c_name")
    whole = part.union(orders).union(customer)
    return whole.select("kind", "raw", text.numeric_clean(F.col("raw")).alias("number"))


@query
def nullable_numeric(spark, folder):
    rows = with_k(table(spark, folder, "events"))
    raw = (
        F.when(F.col("k") >= 80, "")
        .when(F.col("k") < 20, F.lit("n/a"))
        .otherwise(F.concat(F.lit(" "), F.col("k").cast("int").cast("string")))
    )
    return rows.select("event_id", text.numeric_or_null(raw).alias("number"))


@query
def parse_timestamps(spark, folder):
    # One text format per event type; errors get text that is no time at all.
    formats = {
        "click": "MM/dd/yyyy HH:mm",
        "view": "yyyy-MM-dd HH:mm:ss",
        "purchase": "M/d/yyyy h:mm a",
        "signup": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    }
    raw = F.lit("not a time")
    for kind, fmt in formats.items():
        raw = F.when(F.col("event_type") == kind, F.date_format(F.col("ts").cast("timestamp"), fmt)).otherwise(raw)
    rows = table(spark, folder, "events")
    return rows.select("event_id", text.parse_timestamp(raw).alias("parsed"))


@query
def pad_id(spark, folder):
    return table(spark, folder, "events").select("event_id", text.pad_id(F.col("user_id")).alias("series_id"))


@query
def time_cyclical(spark, folder):
    hour = clinical.hour_of_day(F.col("ts"))
    sin_time, cos_time = clinical.cyclical(hour)
    rows = table(spark, folder, "events").select(
        "event_id", hour.alias("hour"), sin_time.alias("sin_time"), cos_time.alias("cos_time")
    )
    return rounded_all(rows)


@query
def event_filter(spark, folder):
    rows = with_k(table(spark, folder, "events"))
    kind = F.when(F.col("event_type") == "purchase", "Lunch").when(F.col("event_type") == "view", "  ")
    amount = F.when(F.col("k") >= 90, F.col("value"))
    return rows.where(text.is_event(kind, amount)).select("event_id", "event_type")


@query
def band_classify(spark, folder):
    level = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal") / 1000)
    return table(spark, folder, "customer").select("c_custkey", clinical.diagnosis_band(level).alias("diagnosis"))


@query
def prediction_band(spark, folder):
    rows = with_k(table(spark, folder, "events"))
    lower, upper = clinical.prediction_band(F.col("value"), F.col("k") / 4)
    return rounded_all(rows.select("event_id", lower.alias("lower"), upper.alias("upper")))


@query
def clamp_round(spark, folder):
    value = F.bround(clinical.clamp(F.col("value") * 4 / 3), 2)
    return table(spark, folder, "events").select("event_id", value.alias("value"))


@query
def label_format(spark, folder):
    raw = F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_"))
    return table(spark, folder, "orders").select("o_orderkey", text.label(raw).alias("label"))


@query
def valid_rows(spark, folder):
    rows = with_k(table(spark, folder, "events"))
    k, kind = F.col("k"), F.col("event_type")
    raw = rows.select(
        "event_id",
        F.when((kind == "view") & (k >= 90), " ").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when((kind == "error") & (k >= 90), "").when((kind == "click") & (k < 5), "soon")
        .otherwise(F.col("ts").cast("string")).alias("ts"),
        F.when((kind == "signup") & (k < 5), "n/a").otherwise(F.col("value").cast("string")).alias("value"),
    )
    return series_csv.valid_rows(raw, "user_id", "ts", "value")


# Two column orders and spellings of one kind of file.
HEADERS = [
    'Timestamp,Libre GL,Dexcom GL,HR,METs,Mets,Meal Type,Carbs',
    'Carbs, Mets ,"Meal Type",HR,Dexcom GL,Timestamp,Notes',
]


def event_lines(spark, folder) -> DataFrame:
    """Events as lines of text files, one file per type, whose headers differ in order and spelling."""
    kinds = ["click", "view", "purchase", "signup", "error"]
    rows = with_k(table(spark, folder, "events"))
    number = F.array_position(F.array(*[F.lit(x) for x in kinds]), F.col("event_type"))
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    amount = F.when(F.col("k") >= 90, F.concat(F.lit('"'), F.col("k").cast("int"), F.lit(' g, about"'))).otherwise("")
    value, k = F.col("value").cast("string"), F.col("k").cast("int").cast("string")
    first = F.concat_ws(",", at, k, value, k, k, F.lit("99"), F.lit(""), amount)
    second = F.concat_ws(",", amount, k, F.when(F.col("k") < 5, '"Tea, late"').otherwise("None"), k, value, at, F.lit("x"))
    file = F.concat(F.lit("data/Person-"), F.lpad(number.cast("string"), 3, "0"), F.lit(".csv"))
    odd = number % 2 == 1
    lines = rows.select(
        file.alias("_file"), F.lit(0).alias("_block"), (F.col("event_id") + 1).alias("_row"),
        F.when(odd, first).otherwise(second).alias("value"),
    )
    heads = rows.select(
        file.alias("_file"), F.lit(0).alias("_block"), F.lit(0).cast("bigint").alias("_row"),
        F.when(odd, HEADERS[0]).otherwise(HEADERS[1]).alias("value"),
    ).distinct()
    return heads.unionByName(lines)


@query
def ingest_lines(spark, folder):
    """Headers, first present column, id from the file name and typed rows, by the parser of the files."""
    rows = series_csv.typed_series(series_csv.series_text(event_lines(spark, folder)))
    return rows.select(
        (F.col("_row") - 1).alias("event_id"), "participant_id", "timestamp", "dexcom", "libre", "heart_rate", "mets",
        "activity_calories", "carbs", "is_event",
    )


@query
def ingest_quoted(spark, folder):
    """The same files where some quoted cells hold line breaks and doubled quotes, cut at every line break."""
    rows = event_lines(spark, folder)
    marked = F.regexp_replace("value", '"Tea, late"', '"Tea\n\nwith ""milk"", late\n"')
    spread = rows.select("_file", "_row", F.posexplode(F.split(F.regexp_replace(marked, " g, about", "\n g, about"), "\n")).alias("n", "value"))
    # Splits of a file end anywhere, also within a record.
    at = F.col("_row") * 16 + F.col("n")
    lines = spread.select("_file", F.floor(at / 700).alias("_block"), at.alias("_row"), "value")
    typed = series_csv.typed_series(series_csv.series_text(series_csv.whole_records(lines)))
    return typed.select(
        (F.col("_row") / 16 - 1).cast("bigint").alias("event_id"), "participant_id", "timestamp", "dexcom", "libre", "heart_rate",
        "mets", "activity_calories", "carbs", "is_event",
    )


@query
def drop_incomplete(spark, folder):
    rows = with_k(table(spark, folder, "events"))
    return rows.select(
        "event_id",
        F.when(F.col("k") >= 10, F.col("k")).alias("k"),
        F.when(F.col("value") < 200, F.col("value")).alias("value"),
    ).dropna()


@query
def bounds_validate(spark, folder):
    # Limits for three lineitem columns, one with an open end.
    bounds = [
        quality.Bound("l_quantity", 2, 40),
        quality.Bound("l_discount", 0, 0.08, open_high=True),
        quality.Bound("l_tax", 0.01, 0.06),
    ]
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
    )
    checked = quality.validate(rows, bounds)
    return checked.withColumn("reasons", F.concat_ws("; ", "reasons"))


@query
def sort_nested_events(spark, folder):
    lines = table(spark, folder, "lineitem")
    meals = F.array(*[
        F.struct((F.col(column) % 24).cast("double").alias("hour"), F.lit(column).alias("label"))
        for column in ["l_quantity", "l_partkey", "l_suppkey"]
    ])
    ordered = quality.sort_nested(meals, "hour")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.array_join(F.transform(ordered, lambda e: e["label"]), ",").alias("labels"),
    )


# Aggregates per series


@query
def range_metrics(spark, folder):
    return rounded_all(metrics.range_metrics(table(spark, folder, "events"), ["user_id"], "value"))


@query
def range_metrics_by_type(spark, folder):
    rows = table(spark, folder, "events")
    return rounded_all(metrics.range_metrics(rows, ["event_type"], "value"), 7)


@query
def range_bands(spark, folder):
    found = metrics.range_metrics(table(spark, folder, "events"), ["user_id"], "value")
    return rounded_all(metrics.range_bands(found, ["user_id"]))


@query
def distinct_series(spark, folder):
    return metrics.distinct_series(table(spark, folder, "events"), "user_id")


@query
def series_header(spark, folder):
    return metrics.series_header(table(spark, folder, "events"), "user_id", "ts", "event_type", "value")


@query
def series_filter(spark, folder):
    rows = table(spark, folder, "events")
    return selection.one_series(rows, "user_id", "7").select("event_id", "user_id", "ts", "value")


@query
def min_size_gate(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return selection.large_enough(rows, ["user_id"], "ts", 66).select("event_id", "user_id")


def two_signals(spark, folder) -> DataFrame:
    """Per user: the first signal only from large errors, the second from everything else."""
    rows = table(spark, folder, "events")
    first = F.when((F.col("event_type") == "error") & (F.col("value") > 120), F.col("value"))
    second = F.when(F.col("event_type") != "error", F.col("value"))
    return rows.select("event_id", "user_id", "ts", first.alias("dexcom"), second.alias("libre"))


@query
def signal_fallback(spark, folder):
    rows = two_signals(spark, folder)
    names = features.SIGNALS["auto"]
    usable = rows.groupBy("user_id").agg(*[F.count(n).alias(n) for n in names])
    picked = features.pick_signal(rows, "user_id", names, usable=usable)
    return picked.join(usable, "user_id").select("user_id", "source", "dexcom", "libre")


@query
def signal_label(spark, folder):
    picked = features.pick_signal(two_signals(spark, folder), "user_id", features.SIGNALS["auto"])
    label = features.source_label(picked)
    return picked.agg(F.lit(label).alias("glucose_source"), F.count(F.lit(1)).alias("series"))


@query
def paired_compare(spark, folder):
    rows = table(spark, folder, "events").withColumn("slot", F.to_date("ts"))
    daily = rows.groupBy("user_id", "slot", "event_type").agg(F.avg("value").alias("value"))
    current = daily.where("event_type = 'click'")
    reference = daily.where("event_type = 'view'")
    return rounded_all(metrics.paired_compare(current, reference, ["user_id"], "slot", "value"), 6)


# Windows


@query
def gap_minutes(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return windows.gaps(rows, ["user_id"], "ts").select(
        "event_id", "gap_us", (F.col("gap_us") / slices.MINUTE_US).alias("gap_minutes")
    )


@query
def cadence_median(spark, folder):
    return windows.cadence(table(spark, folder, "events"), ["event_type"], "ts")


@query
def dedup_first(spark, folder):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = table(spark, folder, "lineitem").select("l_suppkey", "l_shipdate", *order)
    return windows.first_per_time(rows, ["l_suppkey"], "l_shipdate", order)


@query
def event_sum_window(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")
    spent = F.when(F.col("event_type") == "purchase", F.col("value"))
    spec = Trailing("event_sum", spent, 3 * DAY_MINUTES, default=0.0)
    summed = windows.trailing(rows, ["user_id"], "ts", [spec])
    return rounded(summed.select("event_id", "event_sum"), 4, "event_sum")


@query
def event_sum_product(spark, folder):
    rows = with_k(table(spark, folder, "events")).select("event_id", "user_id", "ts", "event_type", "value", "k")
    effort = F.when(F.col("event_type") == "purchase", F.col("value") * F.col("k"))
    spec = Trailing("event_sum", effort, 3 * DAY_MINUTES, default=0.0)
    summed = windows.trailing(rows, ["user_id"], "ts", [spec])
    return rounded(summed.select("event_id", "event_sum"), 4, "event_sum")


@query
def rolling_mean_time(spark, folder):
    rows = with_k(table(spark, folder, "events")).select("event_id", "event_type", "ts", "value", "k")
    specs = [
        Trailing("mean_30m", F.col("value"), 30, "mean", "right"),
        Trailing("masked_mean_60m", F.when(F.col("k") >= 50, F.col("value")), 60, "mean", "right"),
    ]
    rolled = windows.trailing(rows, ["event_type"], "ts", specs)
    return rounded_all(rolled.select("event_id", "mean_30m", "masked_mean_60m"))


@query
def rolling_sum_time(spark, folder):
    rows = with_k(table(spark, folder, "events")).select("event_id", "event_type", "ts", "value", "k")
    spec = Trailing("sum_60m", F.when(F.col("k") >= 50, F.col("value")), 60, "sum", "right")
    rolled = windows.trailing(rows, ["event_type"], "ts", [spec])
    return rounded(rolled.select("event_id", "sum_60m"), 4, "sum_60m")


@query
def lag_lead_timed(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    shifted = windows.timed_shifts(rows, ["event_type"], "ts", "value", lag_name="lag_{}m", target_time="target_ts")
    delta = F.col("value") - F.col("lag_15m")
    out = shifted.select("event_id", "lag_15m", "lag_30m", delta.alias("delta_15m"), "target_30m", "target_ts")
    return rounded(out, 4, "delta_15m")


@query
def lag_within_day(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", "event_type", F.to_date("ts").alias("day"), "ts", "value"
    )
    shifts = {"lag_3": ("value", 3), "lag_6": ("value", 6), "lead_6": ("value", -6)}
    return windows.shift_rows(rows, ["event_type", "day"], "ts", shifts).select("event_id", *shifts)


# Joins


@query
def static_join(spark, folder):
    static = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("user_id"), "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    last = joins.last_per_key(static, "user_id", ["o_orderkey"])
    rows = table(spark, folder, "events").select("event_id", "user_id")
    return joins.attach_static(rows, last, "user_id")


@query
def static_id_key(spark, folder):
    raw = F.concat(F.lit("P-"), F.col("c_custkey"), F.lit("/x"))
    return table(spark, folder, "customer").select("c_custkey", joins.id_key(raw).alias("series_id"))


@query
def positional_join(spark, folder):
    ids = table(spark, folder, "events").select("user_id")
    static = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return joins.attach_by_position(ids, static, "user_id", ["s_suppkey"])


@query
def asof_nearest(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type", "ts")
    matched = asof.future_matches(rows, ["event_type"], "ts")
    return matched.select("event_id", F.col("matched_timestamp").alias("matched_ts"), "hit")


@query
def asof_pair(spark, folder):
    rows = table(spark, folder, "events")
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = rows.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value")
    matched = asof.asof_nearest(left, right, ["user_id"], "ts", "seen", tolerance_minutes=DAY_MINUTES)
    return matched.select("event_id", "matched_seen", "matched_value")


def samples_and_events(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = with_k(table(spark, folder, "events"))
    samples = rows.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return samples, rows.where("event_type = 'purchase'").select("user_id", "ts", "value", "k")


@query
def event_sum_join(spark, folder):
    samples, happened = samples_and_events(spark, folder)
    out = events.event_sum(samples, happened, ["user_id"], "ts", "ts", "value", window_minutes=3 * DAY_MINUTES)
    return rounded(out.select("event_id", "event_sum"), 4, "event_sum")


@query
def kernel_gamma(spark, folder):
    samples, happened = samples_and_events(spark, folder)
    out = events.gamma_response(
        samples, happened, ["user_id"], "ts", "ts", "value",
        peak_minutes=720, cutoff_minutes=4 * DAY_MINUTES, out="response",
    )
    return rounded(out.select("event_id", "response"), 6, "response")


@query
def kernel_onset_decay(spark, folder):
    samples, happened = samples_and_events(spark, folder)
    active = happened.select("user_id", "ts", (F.col("k") * 10).alias("lasts"), (F.col("value") / 100).alias("intensity"))
    out = events.onset_decay_response(
        samples, active, ["user_id"], "ts", "ts", "lasts", "intensity",
        onset_minutes=240, decay_minutes=1440, full_duration_minutes=450,
        cutoff_minutes=4 * DAY_MINUTES, out="response",
    )
    return rounded(out.select("event_id", "response"), 6, "response")


@query
def union_sources(spark, folder):
    measured = table(spark, folder, "events").select(F.col("user_id").alias("series_id"), "ts", "value")
    ordered = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("series_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amount")
    )
    return measured.unionByName(ordered, allowMissingColumns=True)


# Selection and diagnostics


@query
def stride_downsample(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return selection.every_kth(rows, ["user_id"], "ts", max_points=20)


@query
def stride_fixed(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type", "ts")
    return selection.every_kth(rows, ["event_type"], "ts", stride=3)


@query
def tail_n(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return selection.last_rows(rows, ["user_id"], "ts", 48)


@query
def tail_many(spark, folder):
    """More rows than a map task would cut to before a shuffle."""
    rows = table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    return selection.last_rows(rows, ["event_type"], "ts", 1500)


def grouped_series(spark, folder) -> DataFrame:
    """Events with a diagnosis-like group per user, taken from the customer's balance."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts")
    group = clinical.diagnosis_band(F.col("c_acctbal") / 1000)
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), group.alias("diagnosis"))
    return rows.join(people, "user_id")


@query
def subset_first_window(spark, folder):
    chosen, _ = selection.first_windows(
        grouped_series(spark, folder), "diagnosis", "user_id", "ts", hours=240, at_least=20
    )
    return chosen.select("event_id", "user_id", "diagnosis", "ts")


@query
def subset_metadata(spark, folder):
    _, best = selection.first_windows(
        grouped_series(spark, folder), "diagnosis", "user_id", "ts", hours=240, at_least=20
    )
    return best


def diagnosed(spark, folder) -> DataFrame:
    rows = with_k(table(spark, folder, "events")).select(
        "event_type",
        F.when(F.col("k") >= 3, F.col("ts")).alias("ts"),
        F.col("value").alias("a"),
        F.when(F.col("k") >= 50, F.col("value")).alias("b"),
    )
    sensors = [quality.Sensor("a", "a", 7.5), quality.Sensor("b", "b", 20.0)]
    return quality.sensor_diagnostics(rows, "event_type", "ts", sensors)


@query
def sensor_diagnostics(spark, folder):
    return diagnosed(spark, folder)


@query
def diagnostics_totals(spark, folder):
    return quality.diagnostics_totals(diagnosed(spark, folder), "event_type")


# Splits, imputation, evaluation


@query
def group_split(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id")
    return selection.group_split(rows, "user_id")


@query
def chrono_split(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return selection.chronological_split(rows, ["user_id"], "ts").select("event_id", "is_test")


@query
def day_split(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.dayofyear("ts").alias("day"))
    return selection.day_split(rows, "day")


@query
def median_impute(spark, folder):
    rows = with_k(table(spark, folder, "events")).select(
        "event_id",
        F.dayofyear("ts").alias("day"),
        F.when(F.col("k") < 80, F.col("value")).alias("level"),
        F.when(F.col("value") < 60, F.col("k")).alias("rate"),
        F.lit(None).cast("double").alias("unseen"),
    )
    split = selection.day_split(rows, "day")
    filled = training.impute(split, split.where("not is_test"), ["level", "rate", "unseen"])
    return rounded_all(filled.select("event_id", "level", "rate", "unseen"))


def simple_forecast(spark, folder) -> DataFrame:
    """Per user: the next value as target, the mean of the last three days as prediction."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", "value")
    width_us = slices.measured_width(rows, ["user_id"], "ts")
    ahead = windows.shift_rows(rows, ["user_id"], "ts", {"target": ("value", -1)}, width_us=width_us)
    spec = Trailing("prediction", F.col("value"), 3 * DAY_MINUTES, "mean", "right")
    return windows.trailing(ahead.where("target is not null"), ["user_id"], "ts", [spec], width_us=width_us)


def forecast_errors(rows: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.error_metrics(
        rows, keys, prediction="prediction", target="target", current="value", series="user_id", digits=None
    )


@query
def persistence_eval(spark, folder):
    return rounded_all(forecast_errors(simple_forecast(spark, folder), ["event_type"]), 6)


@query
def benchmark_summary(spark, folder):
    per_user = forecast_errors(simple_forecast(spark, folder), ["user_id"])
    return rounded_all(metrics.benchmark_summary(per_user, digits=None), 6)


@query
def rank_models(spark, folder):
    rows = simple_forecast(spark, folder)
    mean = forecast_errors(rows, []).select(F.lit("trailing_mean").alias("model_name"), "mae_mg_dl", "rmse_mg_dl")
    still = forecast_errors(rows.withColumn("prediction", F.col("value")), []).select(
        F.lit("persistence").alias("model_name"), "mae_mg_dl", "rmse_mg_dl"
    )
    return training.rank_models(rounded_all(mean.unionByName(still), 6))


# The forecasting table and what follows from it


def raw_series(spark, folder) -> DataFrame:
    """Events as raw series, one per event type, with two sensors and recorded events."""
    rows = with_k(table(spark, folder, "events"))
    value, k = F.col("value"), F.col("k")
    logged = k >= 90
    return rows.select(
        F.col("event_type").alias("participant_id"),
        F.col("ts").alias("timestamp"),
        F.when((F.col("event_type") != "view") & (k >= 5), value + 1.5).alias("dexcom"),
        F.when(k >= 2, value).alias("libre"),
        k.alias("heart_rate"),
        F.when(k < 70, value / 10).alias("mets"),
        (value / 20).alias("activity_calories"),
        F.when(logged, value / 4).alias("carbs"),
        F.when(logged, k).alias("protein"),
        F.when(value > 100, value / 5).alias("fat"),
        F.when(logged, k / 10).alias("fiber"),
        logged.alias("is_event"),
        F.lit(0).alias("_block"),
        F.col("event_id").alias("_row"),
    )


def static_rows(spark, folder, ids: DataFrame) -> DataFrame:
    balance = F.avg("c_acctbal")
    segments = table(spark, folder, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).cast("double").alias("age"),
        (balance / 200).alias("bmi"),
        (balance / 700).alias("hba1c"),
        F.max("c_acctbal").alias("fasting_glucose"),
        F.lit(None).cast("double").alias("fasting_insulin"),
    )
    return joins.attach_by_position(ids, segments, "participant_id", ["c_mktsegment"]).drop("c_mktsegment")


def forecast_frame(spark, folder) -> DataFrame:
    raw = raw_series(spark, folder)
    width_us = slices.measured_width(raw, ["participant_id"], "timestamp")
    facts = features.series_facts(raw, "dexcom", width_us=width_us)
    static = static_rows(spark, folder, raw.select("participant_id"))
    return features.forecast_rows(raw, static, facts, width_us=width_us)


@query
def feature_table(spark, folder):
    return rounded_all(forecast_frame(spark, folder), 6)


@query
def saved_table(spark, folder):
    """The forecasting table written as gzip CSV and read back by its descriptor."""
    path = fresh_folder(spark)
    sinks.save_forecast_table(ForecastTable(rounded_all(forecast_frame(spark, folder), 6), "dexcom"), path, fmt="csv")
    return sinks.load_forecast_table(spark, path).frame


@query
def saved_summary(spark, folder):
    """The written summary of a run, once for each of the written ids."""
    path, whole = fresh_folder(spark), user_table(spark, folder)
    sinks.save_summary(whole, path, {"license": "test"})
    summary = spark.read.json(f"{path}/summary").select(
        "rows", "participants", "glucose_source", "horizon_minutes", F.size("features").alias("features"), "license"
    )
    return spark.read.schema("participant_id string").json(f"{path}/participants").join(summary, F.lit(True))


def user_forecast(spark, folder) -> DataFrame:
    """A wide table per user for the models: the value, its past, and the next value as target."""
    rows = with_k(table(spark, folder, "events")).select(
        F.col("user_id").cast("string").alias("participant_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("glucose_mg_dl"),
        F.when(F.col("k") >= 10, F.col("k")).alias("heart_rate"),
        "event_type",
    )
    sin_time, cos_time = clinical.cyclical(clinical.hour_of_day(F.col("timestamp")))
    shifts = {"lag_1": ("glucose_mg_dl", 1), "lag_2": ("glucose_mg_dl", 2), "target_30m": ("glucose_mg_dl", -1)}
    keys = ["participant_id"]
    width_us = slices.measured_width(rows, keys, "timestamp")
    ahead = windows.shift_rows(rows, keys, "timestamp", shifts, width_us=width_us)
    spec = Trailing("mean_3d", F.col("glucose_mg_dl"), 3 * DAY_MINUTES, "mean", "right")
    ahead = ahead.where("target_30m is not null")
    # A forecasting table is written once and read by every model, here as in a real run.
    return stored(windows.trailing(ahead, keys, "timestamp", [spec], width_us=width_us)).withColumns(
        {"sin_time": sin_time, "cos_time": cos_time}
    )


USER_FEATURES = ["glucose_mg_dl", "lag_1", "lag_2", "heart_rate", "mean_3d", "sin_time", "cos_time"]


def user_table(spark, folder) -> ForecastTable:
    return ForecastTable(user_forecast(spark, folder), "dexcom", feature_columns=list(USER_FEATURES))


@query
def rf_predict(spark, folder):
    """Whole series held out. What a forest predicts is a mean of training targets, so each prediction
    must lie between their extremes; the rows and everything but the prediction are known beforehand."""
    prepared = training.prepare_grouped(user_table(spark, folder))
    trained = training.train_prepared(prepared, model_name="random_forest")
    known = prepared.rows.where("not is_test").agg(F.min("target_30m").alias("least"), F.max("target_30m").alias("most"))
    plausible = F.col("prediction_30m").between(known.select("least").scalar(), known.select("most").scalar())
    return trained.predictions.withColumn("plausible", plausible).drop("prediction_30m")


@query
def compare_models(spark, folder):
    """Both models at full size. Errors of fitted trees have no twin in SQL; what holds for any of them has."""
    rows = training.compare_models(user_table(spark, folder))
    return rounded_all(
        rows.select(
            "model_name", "split_strategy", "persistence_mae_mg_dl", "train_samples", "test_samples",
            "train_participants", "test_participants",
            (F.col("rmse_mg_dl") >= F.col("mae_mg_dl")).alias("rmse_not_below_mae"),
        ),
        2,
    )


@query
def per_series_eval(spark, folder):
    rows = user_forecast(spark, folder)
    found = per_series.evaluate_each(rows, group="event_type", features=USER_FEATURES, digits=None)
    return rounded_all(found, 6)


def rounded_users(spark, folder) -> DataFrame:
    """The wide table with what is not exact rounded, so that equal values are in one bin everywhere."""
    rows = user_forecast(spark, folder)
    return rows.withColumns({n: F.round(n, 6) for n in ["mean_3d", "sin_time", "cos_time"]})


@query
def boosted_grouped(spark, folder):
    """What a few rounds of leaf-wise trees, fitted on the other users, predict for the users held out."""
    whole = ForecastTable(rounded_users(spark, folder), "dexcom", feature_columns=list(USER_FEATURES))
    small = {"maxIter": 5, "maxLeaves": 6, "maxBins": 64, "stepSize": 0.2}
    return rounded_all(training.train_grouped(whole, model_name="hgb", **small).predictions, 6)


@query
def boosted_saved(spark, folder):
    """The same after the model was saved and loaded: the held-out users' rows scored all at once."""
    whole = ForecastTable(rounded_users(spark, folder), "dexcom", feature_columns=list(USER_FEATURES))
    prepared = training.prepare_grouped(whole)
    small = {"maxIter": 5, "maxLeaves": 6, "maxBins": 64, "stepSize": 0.2}
    path = training.save_model(training.train_prepared(prepared, model_name="hgb", **small), fresh_folder(spark))
    model, _ = training.load_model(spark, path)
    scored = training.score(model, prepared.rows.where("is_test"))
    return rounded_all(scored.select("participant_id", "timestamp", "glucose_mg_dl", "target_30m", "prediction_30m"), 6)


FEW_ROUNDS = boosting.Settings(rounds=4, leaves=4, least=5, bins=16, step=0.3)


@query
def boosted_per_series(spark, folder):
    """What a few rounds of each user's own leaf-wise trees predict for the user's later rows."""
    rows = rounded_users(spark, folder)
    found = per_series.predict_each(rows, features=USER_FEATURES, model="hgb", settings=FEW_ROUNDS)
    return rounded_all(found, 6)


@query
def boosted_per_series_eval(spark, folder):
    rows = rounded_users(spark, folder)
    found = per_series.evaluate_each(
        rows, group="event_type", features=USER_FEATURES, model="hgb", settings=FEW_ROUNDS, digits=None
    )
    return rounded_all(found, 6)


@query
def per_series_summary(spark, folder):
    found = per_series.evaluate_each(user_forecast(spark, folder), features=USER_FEATURES)
    return metrics.benchmark_summary(found)


# Export


@query
def fhir_observation(spark, folder):
    rows = table(spark, folder, "events")
    subject = F.concat(F.lit("Patient/"), F.col("user_id"))
    return export.observations(rows, "event_id", "ts", "value", subject=subject).select("event_id", "resource")


@query
def fhir_bundle(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "ts", "value")
    subject = F.concat(F.lit("Patient/"), F.col("user_id"))
    return export.bundles(rows, "user_id", "ts", "value", entries_per_bundle=50, subject=subject)
