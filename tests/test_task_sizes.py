from datetime import datetime, timedelta

from pyspark.sql import functions as F

from glucospan.operators import slices, sums, windows
from glucospan.operators.windows import Trailing
from glucospan.plans import features
from glucospan.schema import ForecastTable
from glucospan.sources import sinks


def events(spark, series=3, each=400):
    start = datetime(2024, 1, 1)
    rows = [
        (f"{s:03d}", start + timedelta(minutes=5 * i), 100.0 + (i * 7 + s) % 40, float(i % 11), i)
        for s in range(series) for i in range(each)
    ]
    return spark.createDataFrame(rows, "participant_id string, timestamp timestamp_ntz, v double, w double, n int")


def test_tasks_follow_the_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert slices.tasks_for(spark, 0) == slices.tasks_for(spark, 10) == cores
    assert slices.tasks_for(spark, 36_000_000) == 360
    monkeypatch.setattr(slices, "ROWS_PER_TASK", 100)
    assert slices.tasks_for(spark, 12_001) == 121


def test_windows_are_dealt_over_as_many_tasks_as_asked(spark):
    df = events(spark)
    specs = [Trailing("near", F.col("v"), 30, "mean", "right"), Trailing("far", F.col("w"), 120, default=0.0)]
    usual = windows.trailing(df, ["participant_id"], "timestamp", specs)
    dealt = windows.trailing(
        df, ["participant_id"], "timestamp", specs, keep=["participant_id", "timestamp", "v"], where=F.col("n") % 3 == 0, tasks=37
    )
    assert dealt.columns == ["participant_id", "timestamp", "v", "near", "far"]
    assert dealt.rdd.getNumPartitions() == 37  # not merged, however few bytes they have
    want = usual.where("n % 3 = 0").select(dealt.columns)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, want.collect()))


def test_gaps_and_shifts_keep_their_results_in_any_number_of_tasks(spark):
    df, keys = events(spark), ["participant_id"]
    for call in (
        lambda tasks: windows.gaps(df, keys, "timestamp", tasks=tasks),
        lambda tasks: windows.cadence(df, keys, "timestamp", tasks=tasks),
        lambda tasks: windows.timed_shifts(df, keys, "timestamp", "v", tasks=tasks),
    ):
        one, other = (sorted(map(str, call(tasks).collect())) for tasks in (None, 23))
        assert one == other and one
    assert windows.gaps(df, keys, "timestamp", tasks=23).rdd.getNumPartitions() == 23


def raw(spark):
    none = F.lit(None).cast("double")
    return events(spark).select(
        "participant_id", "timestamp", F.col("v").alias("dexcom"), F.col("v").alias("libre"), F.col("w").alias("heart_rate"),
        F.col("w").alias("mets"), F.col("w").alias("activity_calories"), F.col("w").alias("carbs"), none.alias("protein"),
        none.alias("fat"), none.alias("fiber"), (F.col("n") % 5 == 0).alias("is_event"), F.lit(0).alias("_block"), F.col("n").alias("_row"),
    )


def test_a_table_is_worked_out_once_when_it_is_saved(spark, tmp_path):
    """The sort by range reads its rows twice; the second time from the stored table."""
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for batch in parts:
            seen.add(batch.num_rows)
            yield batch

    df = events(spark).select("participant_id", "timestamp", "v")
    frame = df.mapInArrow(counted, df.schema)
    sinks.save_forecast_table(ForecastTable(frame, "dexcom", feature_columns=["v"]), str(tmp_path / "t"), fmt="csv")
    assert seen.value == 1200
    assert sinks.load_forecast_table(spark, str(tmp_path / "t")).frame.count() == 1200


def test_the_forecasting_table_does_not_depend_on_tasks(spark, monkeypatch):
    none = F.lit(None).cast("double")
    rows = raw(spark)
    static = rows.select("participant_id").distinct().select(
        "participant_id", *[none.alias(n) for n in ["age", "bmi", "hba1c", "fasting_glucose", "fasting_insulin"]]
    )
    found = []
    for most in (100_000, 50):
        monkeypatch.setattr(slices, "ROWS_PER_TASK", most)
        facts = features.series_facts(rows)
        found.append(sorted(map(str, features.forecast_rows(rows, static, facts).collect())))
    assert found[0] == found[1] and len(found[0]) == 3 * (400 - 12)


def test_windows_of_one_length_share_the_rows_of_a_slice(spark, monkeypatch):
    """What stands over whole slices takes a fixed number of rows for each length, not for each window."""
    df, counted = events(spark), []
    inner = sums._standing

    def spied(placed, series, lengths, width_us, *more):
        out = inner(placed, series, lengths, width_us, *more)
        text = out._jdf.queryExecution().optimizedPlan().toString()
        counted.append(text[text.index("inline("):].split("\n")[0].count("_order"))
        return out

    monkeypatch.setattr(sums, "_standing", spied)
    one = [Trailing("a0", F.col("v"), 120)]
    four = [Trailing(f"a{i}", F.col("v") * (i + 1), 120) for i in range(4)]
    keys = ["participant_id"]
    width = slices.minutes(30)
    want = {(r[0], r[1]): r["a0"] for r in windows.trailing(df, keys, "timestamp", one, width_us=width).collect()}
    for r in windows.trailing(df, keys, "timestamp", four, width_us=width).collect():
        assert [r[f"a{i}"] for i in range(4)] == [want[r[0], r[1]] * (i + 1) for i in range(4)]
    assert counted[0] == counted[1] > 0


def test_cadence_is_measured_on_the_signal_in_use(spark, monkeypatch):
    rows = raw(spark).withColumn("dexcom", F.when(F.col("_row") % 2 == 0, F.col("dexcom")))
    rows = rows.withColumn("dexcom", F.when(F.col("participant_id") != "002", F.col("dexcom")))
    seen, inner = [], features.cadence

    def spied(df, *args, **options):
        seen.append({(r[0], r[1]): r[2] for r in df.groupBy("participant_id", "source").count().collect()})
        return inner(df, *args, **options)

    monkeypatch.setattr(features, "cadence", spied)
    found = {r["participant_id"]: (r["source"], r["rows"], r["cadence_minutes"]) for r in features.series_facts(rows).collect()}
    assert found == {"000": ("dexcom", 200, 10.0), "001": ("dexcom", 200, 10.0), "002": ("libre", 400, 5.0)}
    assert seen == [{("000", "dexcom"): 200, ("001", "dexcom"): 200, ("002", "libre"): 400}]
