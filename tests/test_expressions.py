import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from glucospan.functions import clinical, text
from glucospan.operators import export, joins, metrics, quality, selection


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_numeric_clean(spark):
    got = column(spark, ["<5.7", "1,234", "None", "5-6", "", None, "1e2 mg", " -3.5 ", "NaN", "5.", "e5"], text.numeric_clean)
    assert got == [5.7, 1234.0, None, None, None, None, 100.0, -3.5, None, 5.0, None]


def test_numeric_or_null(spark):
    assert column(spark, ["", " 6.1 ", "x", None, "nan"], text.numeric_or_null) == [None, 6.1, None, None, None]


def test_parse_timestamp(spark):
    t = datetime(2025, 1, 2, 6, 5)
    values = [
        "01/02/2025 06:05", "1/2/2025 6:05", "2025-01-02 06:05:00", "2025-01-02T06:05:00", "2025-01-02 06:05",
        "1/2/2025 6:05:00 AM", "1/2/25 6:05", "2025/01/02 06:05", "2-Jan-2025 06:05",
    ]
    assert column(spark, values, text.parse_timestamp) == [t] * len(values)
    named = [
        "Jan 2, 2025 06:05", "January 2 2025 6:05 am", "2 jan 2025 06:05", "02-JAN-2025 6:05:00", "20250102T060500",
        "20250102 6:05", "01-02-2025 6:05:00", "Jan. 2, 2025, 6:05:00 AM", "1/2/2025  6:05",
    ]
    assert column(spark, named, text.parse_timestamp) == [t] * len(named)
    days = ["20250102", "Jan 2, 2025", "2025/1/2", "1-2-2025", "2 January 2025"]
    assert column(spark, days, text.parse_timestamp) == [datetime(2025, 1, 2)] * len(days)
    parts = ["1/2/2025 6:05:07.5", "2025/1/2 6:05:07.500000", "Jan 2 2025 6:05:07.500 AM"]
    assert column(spark, parts, text.parse_timestamp) == [datetime(2025, 1, 2, 6, 5, 7, 500000)] * len(parts)
    bad = ["", None, "soon", "Foo 2, 2025", "99991399", "2025-13-45 00:00", "12", "06:05", "31/31/2025 06:05"]
    assert column(spark, bad, text.parse_timestamp) == [None] * len(bad)
    assert column(spark, ["2025-01-02", "2025-01-02 06:05:01.25"], text.parse_timestamp) == [
        datetime(2025, 1, 2), datetime(2025, 1, 2, 6, 5, 1, 250000)
    ]


def test_timestamps_are_those_of_pandas(spark):
    import pandas as pd

    values = [
        "13/01/2025 10:00", "2025-01-01 3:04 PM", "Sunday, January 5, 2025", "Sun Jan 5 2025 10:00", "1st Feb 2025", "1/2/2025 12:05 AM",
        "1/2/2025 12:05 PM", "1/2/2025 13:05 PM", "2024-02-30", "02/29/2024", "1.2.2025 6:05", "5-Jan-2025 10:00:01.5 pm", "2025-06-07T08:09:10.123456",
        "31/12/1999", "12/31/1999 23:59:59", "2025/13/01", "Feb 30, 2025", "2025-1-2 3:4", "June 7, 2025 8:09 pm", "0/1/2025", "1/2/2025 25:00",
    ]
    want = [None if pd.isna(t := pd.to_datetime(v, errors="coerce")) else t.to_pydatetime() for v in values]
    assert column(spark, values, text.parse_timestamp) == want


def test_ids_and_labels(spark):
    ids = ["7", "42", "123", "1234", "", "-7"]
    assert column(spark, ids, text.pad_id) == [i.zfill(3) for i in ids]
    names = ["type2_diabetes", "pre_diabetes", "4-NOT SPECIFIED", "a1c b"]
    assert column(spark, names, text.label) == [n.replace("_", " ").title() for n in names]
    assert column(spark, ["P-7", "id 1234", "none"], joins.id_key) == ["007", "123", None]


def test_events_need_a_kind_or_an_amount(spark):
    rows = [("Lunch", None), (" \t", None), (None, None), (None, 0.0), ("", 5.0)]
    df = spark.createDataFrame(rows, "kind string, amount double")
    got = [r[0] for r in df.select(text.is_event(F.col("kind"), F.col("amount"))).collect()]
    assert got == [True, False, False, True, True]


def test_bands_and_bounds(spark):
    values = [None, float("nan"), 5.69, 5.7, 6.4, 6.41]
    assert column(spark, values, clinical.diagnosis_band, "double") == [
        "unknown", "unknown", "healthy", "prediabetes", "prediabetes", "type2_diabetes"
    ]
    assert column(spark, [None, 1.0, 100.0, 900.0], clinical.clamp, "double") == [None, 45.0, 100.0, 400.0]
    low = lambda x: clinical.prediction_band(x, F.lit(10.0))[0]
    high = lambda x: clinical.prediction_band(x, F.lit(1.0))[1]
    assert column(spark, [None, 50.0, 100.0], low, "double") == [None, 40.0, 83.6]
    assert column(spark, [100.0, 399.0], high, "double") == [105.0, 400.0]


def test_range_metrics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [50, 60, 80, 100, 170, 190, 260]], "s string, v double")
    extra = spark.createDataFrame([("a", None), ("a", float("nan")), ("zero", 0.0), ("none", None)], "s string, v double")
    got = {r["s"]: r for r in metrics.range_metrics(df.union(extra), ["s"], "v", digits=1).collect()}
    row = got["a"]
    assert (row["time_in_range_pct"], row["time_below_range_pct"], row["time_above_range_pct"]) == (42.9, 28.6, 28.6)
    assert (row["time_very_low_pct"], row["time_very_high_pct"]) == (14.3, 14.3)
    assert (row["mean_glucose"], row["min_glucose"], row["max_glucose"]) == (130.0, 50.0, 260.0)
    assert got["zero"]["coefficient_of_variation_pct"] == 0.0
    assert "none" not in got
    bands = metrics.range_bands(metrics.range_metrics(df, ["s"], "v"), ["s"]).first()
    assert sum(bands[1:]) == pytest.approx(100.0)


def test_benchmark_summary_counts_ties_after_rounding(spark):
    rows = [("a", 12.1, 15.0, 12.4), ("b", 0.3, 1.0, 0.3), ("c", 5.0, 6.0, 4.5)]
    df = spark.createDataFrame(rows, "participant_id string, mae_mg_dl double, rmse_mg_dl double, persistence_mae_mg_dl double")
    row = metrics.benchmark_summary(df).first()
    assert (row["participants"], row["participants_beating_persistence"], row["participants_tying_persistence"]) == (3, 1, 1)
    assert row["median_mae_mg_dl"] == 5.0
    assert row["median_mae_improvement_vs_persistence"] == 0.0
    assert row["mean_mae_improvement_vs_persistence"] == -0.07


def test_validation(spark):
    schema = """age int, phenotype string, baseline_glucose double, carb_sensitivity double, activity_sensitivity double,
        stress_sensitivity double, circadian_amplitude double, meals array<struct<hour:double,carbs_g:double>>,
        exercise array<struct<hour:double,duration_min:int,intensity:double>>"""
    good = (45, "balanced", 112.0, 0.72, 18.0, 16.0, 7.0, [(8.0, 45.0)], [])
    bad = (17, "other", 112.0, None, 18.0, 16.0, 7.0, [(24.0, 45.0)], [(1.0, 30, 1.5)])
    df = spark.createDataFrame([good, bad], schema)
    valid, rejected = quality.split_valid(df, quality.PROFILE_BOUNDS + quality.NESTED_BOUNDS)
    assert [r["age"] for r in valid.collect()] == [45]
    assert rejected.first()["reasons"] == [
        "phenotype not one of balanced, insulin_resistant, active",
        "age outside [18, 90]",
        "carb_sensitivity outside [0.2, 1.8]",
        "meals: hour outside [0, 24)",
        "exercise: intensity outside [0, 1]",
    ]


def test_sort_nested_is_stable(spark):
    df = spark.createDataFrame([([(9.0, "z"), (8.0, "b"), (9.0, "a"), (1.0, "x")],)], "e array<struct<hour:double,label:string>>")
    assert [e["label"] for e in df.select(quality.sort_nested(F.col("e"))).first()[0]] == ["x", "b", "z", "a"]


def test_one_series(spark):
    df = spark.createDataFrame([("7", 1), ("008", 2)], "s string, v int")
    assert [r["v"] for r in selection.one_series(df, "s", "007").collect()] == [1]
    assert [r["v"] for r in selection.one_series(df, "s", "8").collect()] == [2]
    assert sorted(r["s"] for r in selection.known_series(df, "s").collect()) == ["007", "008"]
    with pytest.raises(selection.UnknownSeriesError, match="'009'"):
        selection.require_series(selection.one_series(df, "s", "9"), "9")
    numbers = spark.createDataFrame([(7, 1), (1234, 2)], "s bigint, v int")
    assert [r["v"] for r in selection.one_series(numbers, "s", "007").collect()] == [1]
    assert [r["v"] for r in selection.one_series(numbers, "s", "1234").collect()] == [2]
    assert selection.one_series(numbers, "s", "x").count() == 0


def test_group_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(f"s{i % 10}", i) for i in range(100)], "s string, v int")
    for fraction, wanted in [(0.2, 2), (0.25, 3), (0.01, 1)]:
        out = selection.group_split(df, "s", test_fraction=fraction, seed=3)
        flags = {}
        for r in out.collect():
            flags.setdefault(r["s"], set()).add(r["is_test"])
        assert all(len(f) == 1 for f in flags.values())
        assert sum(True in f for f in flags.values()) == wanted
    with pytest.raises(ValueError, match="at least 3"):
        selection.group_split(df.where("s in ('s1', 's2')"), "s")


def test_first_windows_take_the_lowest_sufficient_id(spark):
    t = "timestamp_ntz'2024-01-01'"
    df = spark.sql(
        f"""select g, s, {t} + make_dt_interval(0, 0, n) as ts from values ('x', '001', 3), ('x', '002', 20),
            ('x', '003', 30), ('y', '000', 25) as v(g, s, m) lateral view explode(sequence(0, m)) as n"""
    )
    rows, best = selection.first_windows(df, "g", "s", "ts", hours=0.25, at_least=15)
    assert {r["g"]: (r["s"], r["rows"]) for r in best.collect()} == {"x": ("002", 15), "y": ("000", 15)}
    assert rows.count() == 30
    with pytest.raises(ValueError, match="no sufficiently long series for: z"):
        selection.first_windows(df, "g", "s", "ts", hours=0.25, at_least=15, groups=["x", "z"])


def test_static_rows_last_duplicate_and_position(spark):
    static = spark.createDataFrame([("001", 1.0, 0), ("001", 2.0, 1), (None, 9.0, 2)], "k string, age double, at int")
    last = joins.last_per_key(static, "k", ["at"])
    assert [(r["k"], r["age"]) for r in last.collect()] == [("001", 2.0)]
    ids = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string")
    placed = joins.attach_by_position(ids, static.select("age", "at").limit(2), "k", ["at"])
    assert {r["k"]: r["age"] for r in placed.collect()} == {"a": 1.0, "b": 2.0, "c": None}


def test_observations_and_bundles(spark):
    df = spark.sql("select 's' as s, timestamp_ntz'2025-01-01' + make_dt_interval(0, 0, 5 * id) as ts, 100.25 + id as v from range(7)")
    one = json.loads(export.observations(df, "s", "ts", "v").orderBy("ts").first()["resource"])
    assert one["effectiveDateTime"] == "2025-01-01T00:00:00+00:00"
    assert one["valueQuantity"] == {
        "value": 100.2, "unit": "mg/dL", "system": "http://unitsofmeasure.org", "code": "mg/dL"
    }
    assert one["category"][0]["coding"][0]["code"] == "laboratory"
    pages = export.bundles(df, "s", "ts", "v", entries_per_bundle=3).orderBy("page").collect()
    assert [p["entries"] for p in pages] == [3, 3, 1]
    entries = [e["resource"] for p in pages for e in json.loads(p["bundle"])["entry"]]
    assert [e["effectiveDateTime"][14:16] for e in entries] == ["00", "05", "10", "15", "20", "25", "30"]
    told = [json.loads(p["bundle"]) for p in pages]
    assert [b["total"] for b in told] == [7, 7, 7]
    assert [x["url"] for x in told[0]["link"]] == ["page=0", "page=1"]
    assert [x["relation"] for x in told[2]["link"]] == ["self"]
    (whole,) = export.bundles(df, "s", "ts", "v", entries_per_bundle=100).collect()
    assert json.loads(whole["bundle"])["type"] == "collection"
    start = F.lit("2025-01-01").cast("timestamp_ntz")
    assert spark.range(1).select(export.sample_time(start, F.lit(90))).first()[0] == datetime(2025, 1, 1, 1, 30)
