from datetime import datetime, timedelta

import brute
import pytest
from conftest import RECORDINGS, SERIES_HEADER, series_rows, write_series, write_static
from pyspark.sql import functions as F

from glucospan.operators import slices
from glucospan.plans.features import (
    SeriesError,
    forecast_rows,
    load_series_dataset,
    series_facts,
    series_status,
)
from glucospan.schema import ForecastTable
from glucospan.sources.series_csv import (
    first_readable,
    read_series,
    read_series_text,
    read_static,
    series_files,
    timestamp_examples,
    valid_rows,
)
from glucospan.sources.sinks import load_forecast_table, run_summary, save_forecast_table, save_summary


def expected(person, sensor="Dexcom GL"):
    """Forecast rows of one person worked out from the file by definition: time -> features."""
    rows = series_rows(person)
    at = [datetime.strptime(r["Timestamp"], "%m/%d/%Y %H:%M") for r in rows]

    def cells(column, keep=lambda r: True):
        return [("s", t, float(r[column]) if r[column] and keep(r) else None, i) for i, (t, r) in enumerate(zip(at, rows, strict=True))]

    def sampled(row):
        return row[sensor] != ""

    samples = [c for c in cells(sensor) if c[2] is not None]
    means = {
        "heart_rate_mean_30m": brute.trailing(cells("HR", sampled), 30, "mean", "right"),
        "mets_mean_60m": brute.trailing(cells("Mets", sampled), 60, "mean", "right"),
        "activity_calories_60m": brute.trailing(cells("Calories (Activity)", sampled), 60, "sum", "right"),
    }
    eaten = {f"{n.lower()}_last_120m": brute.trailing(cells(n), 120, "sum", "both", 0.0) for n in ("Carbs", "Protein", "Fat", "Fiber")}
    value = {c[3]: c[2] for c in samples}
    return {
        at[i]: {
            "glucose_mg_dl": value[i], "glucose_lag_15m": a, "glucose_lag_30m": b, "target_30m": c, "target_timestamp": t,
            **{n: found[i] for n, found in (means | eaten).items()},
        }
        for i, (a, b, c, t) in brute.shifted(samples).items()
    }


def test_folder_to_forecast_table(spark, series_root):
    """Every person and feature against its definition, then some values worked out by hand."""
    table = load_series_dataset(spark, str(series_root), glucose_source="dexcom")
    frame = table.frame.cache()
    assert table.glucose_source == "dexcom"
    assert [r[0] for r in table.participants().collect()] == ["001", "002", "003", "004"]
    for person in RECORDINGS.keys() - {5}:
        want = expected(person)
        mine = frame.where(F.col("participant_id") == f"{person:03d}")
        got = {r["timestamp"]: {n: r[n] for n in next(iter(want.values()))} for r in mine.collect()}
        assert got.keys() == want.keys()
        for t in want:
            assert got[t].pop("target_timestamp") == want[t].pop("target_timestamp")
            assert got[t] == pytest.approx(want[t], abs=1e-9), (person, t)
    # The first two meals of person 2 are 36 minutes apart, the third follows 39 minutes later.
    assert frame.where("participant_id = '002'").agg(F.max("carbs_last_120m")).first()[0] == 12 + 70 + 18
    # A third of person 3's day is a pause: nothing is predicted across it.
    pause = datetime(2024, 2, 28, 19) + timedelta(minutes=6 * 49)
    assert frame.where(f"participant_id = '003' and timestamp <= timestamp_ntz'{pause}' and target_timestamp > timestamp_ntz'{pause}'").count() == 0
    diagnoses = dict(frame.select("participant_id", "diagnosis").distinct().collect())
    assert diagnoses == {"001": "healthy", "002": "prediabetes", "003": "type2_diabetes", "004": "prediabetes"}
    static = frame.where("participant_id = '004'").select("age", "bmi", "hba1c", "fasting_glucose", "fasting_insulin")
    assert [tuple(r) for r in static.distinct().collect()] == [(39.0, 24.2, 5.7, 99.0, 7.0)]


def test_round_trip_keeps_ids_and_descriptor(spark, series_root, tmp_path):
    table = load_series_dataset(
        spark, str(series_root), glucose_source="libre", staging=str(tmp_path / "staging")
    )
    for fmt in ["csv", "parquet"]:
        path = save_forecast_table(table, str(tmp_path / fmt), fmt=fmt)
        again = load_forecast_table(spark, path)
        assert again.glucose_source == "libre"
        assert again.frame.schema.simpleString() == table.frame.schema.simpleString()
        key = ["participant_id", "timestamp"]
        assert again.frame.orderBy(*key).collect() == table.frame.orderBy(*key).collect()
    row = run_summary(again, {"license": "test"}).first()
    rows = sum(len(expected(p, "Libre GL")) for p in range(1, 5))
    assert (row["rows"], row["participants"], row["license"]) == (rows, 4, "test")
    own = ForecastTable(again.frame.withColumn("steps", F.lit(3)), "libre", feature_columns=["steps"])
    path = save_forecast_table(own, str(tmp_path / "own"))
    assert load_forecast_table(spark, path).frame.schema["steps"].dataType.simpleString() == "int"


def by_time(frame, person, *columns):
    rows = frame.where(F.col("participant_id") == person).orderBy("timestamp").select(*columns).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in rows]


def test_narrow_and_wide_slices_agree(spark, series_root):
    raw = read_series(spark, str(series_root)).cache()
    facts = series_facts(raw)
    static = read_static(spark, str(series_root), raw)
    key = ["participant_id", "timestamp"]
    tables = [
        forecast_rows(raw, static, facts, width_us=w).select(
            *[F.round(c, 9).alias(c) if k == "double" else c for c, k in forecast_rows(raw, static, facts).dtypes]
        ).orderBy(*key).collect()
        for w in (slices.minutes(1), slices.DAY_US)
    ]
    assert tables[0] == tables[1]


def test_messy_folder(spark, tmp_path):
    """Columns in another order, a BOM, both spellings of METs, repeated times, series to leave out."""
    write_series(tmp_path, 1, series_rows(1))
    reordered = ["Timestamp", "METs", *reversed(SERIES_HEADER[1:])]
    rows = series_rows(2)
    for r in rows:
        r["METs"] = "3.5"
        r["Dexcom GL"] = "n/a"
    twin = rows[40] | {"Libre GL": "350", "Meal Type": "Tea", "Carbs": "<9 g"}
    lost = dict.fromkeys(reordered, "") | {"Timestamp": "yesterday", "Libre GL": "88"}
    write_series(tmp_path, 2, [*rows[:41], twin, *rows[41:], lost], reordered)
    path = tmp_path / "Person-002" / "Person-002.csv"
    path.write_bytes(b"\xef\xbb\xbf" + path.read_bytes())
    write_series(tmp_path, 3, series_rows(5, 62)[:62])  # 62 rows, five of them without a value
    write_series(tmp_path, 4, [r | {"Dexcom GL": "None", "Libre GL": ""} for r in series_rows(4)])
    daily = [
        r | {"Timestamp": f"{datetime(2024, 1, 1) + timedelta(days=i):%Y-%m-%d %H:%M:%S}", "Dexcom GL": "101"}
        for i, r in enumerate(series_rows(5))
    ]
    write_series(tmp_path, 5, daily)
    (tmp_path / "Person-notes.csv").write_text("a,b\n1,2\n")
    write_static(tmp_path, 3, id_column=True)
    with open(tmp_path / "bio.csv", "a") as handle:
        handle.write("P-2,77,M,,nan,<100,1\n")

    assert [r["participant_id"] for r in series_files(spark, str(tmp_path)).collect()] == ["001", "002", "003", "004", "005"]
    raw = read_series(spark, str(tmp_path)).cache()
    assert raw.where("participant_id = '002' and timestamp is null").count() == 1
    facts = series_facts(raw, "auto").cache()
    status = {r["participant_id"]: (r["status"], r["source"]) for r in series_status(raw, facts).collect()}
    assert status == {
        "001": ("ok", "dexcom"), "002": ("ok", "libre"), "003": ("too_few_rows", "dexcom"),
        "004": ("no_signal", None), "005": ("no_cadence", "dexcom"),
    }
    table = load_series_dataset(spark, str(tmp_path))
    frame = table.frame.cache()
    assert table.glucose_source == "mixed"
    assert {r[0] for r in table.participants().collect()} == {"001", "002"}
    # The repeated row is no second sample, but its meal counts: 70 and 18 were logged within two hours before.
    assert set(by_time(frame, "002", "mets")) == {3.5}
    assert max(by_time(frame, "002", "glucose_mg_dl")) < 350
    at = datetime(2023, 11, 4, 22, 15) + timedelta(minutes=3 * 40)
    assert dict(by_time(frame, "002", "timestamp", "carbs_last_120m"))[at] == 12 + 70 + 18 + 9
    assert set(by_time(frame, "002", "age", "bmi", "hba1c", "fasting_glucose", "diagnosis")) == {
        (77.0, None, None, 100.0, "unknown")
    }
    with pytest.raises(SeriesError, match="'no_signal': 1"):
        load_series_dataset(spark, str(tmp_path), strict=True)
    assert timestamp_examples(read_series_text(spark, str(tmp_path))).count() == 8


def test_missing_inputs(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        load_series_dataset(spark, str(tmp_path / "empty"))
    write_series(tmp_path, 1, series_rows(1), ["HR", "Dexcom GL"])
    with pytest.raises(ValueError, match="no Timestamp column"):
        read_series_text(spark, str(tmp_path))
    write_series(tmp_path, 2, series_rows(2))
    with pytest.warns(UserWarning, match="Person-001"):
        assert read_series_text(spark, str(tmp_path), strict=False).count() == 160
    with pytest.raises(ValueError, match="glucose_source"):
        series_facts(read_series(spark, str(tmp_path), strict=False), "other")


def test_valid_rows_and_fallback(spark, tmp_path):
    rows = [
        ("7", "2025-01-01 00:00:00", "100"), ("", "2025-01-01 00:00:00", "100"), ("8", " ", "100"),
        ("8", "soon", "100"), ("8", "2025-01-01T00:05:00", "n/a"), ("8", "2025-01-01T00:05:00", "99.5"), ("9", "2025-01-01", "nan"),
    ]
    df = spark.createDataFrame(rows, "participant_id string, timestamp string, glucose_mg_dl string")
    kept = valid_rows(df, "participant_id", "timestamp", "glucose_mg_dl").orderBy("participant_id").collect()
    assert [(r[0], r[2]) for r in kept] == [("007", 100.0), ("008", 99.5)]
    places = [("full", str(tmp_path / "full")), ("demo", str(tmp_path / "demo.csv"))]
    assert first_readable(spark, places) is None
    df.write.option("header", True).csv(places[1][1])
    assert first_readable(spark, places).select("data_mode").distinct().first()[0] == "demo"
    df.write.parquet(places[0][1])
    assert first_readable(spark, places).select("data_mode").distinct().first()[0] == "full"


def test_summary_and_ids(spark, series_root, tmp_path):
    table = load_series_dataset(spark, str(series_root))
    path = save_summary(table, str(tmp_path / "run"), {"license": "test"})
    row = spark.read.json(f"{path}/summary").first()
    assert (row["participants"], row["license"]) == (4, "test")
    assert [r[0] for r in spark.read.schema("participant_id string").json(f"{path}/participants").collect()] == ["001", "002", "003", "004"]


def test_quoted_line_breaks(spark, tmp_path):
    """Records as the standard library reads them, whatever lies in their quotes."""
    import csv

    header = ["Timestamp", "Dexcom GL", "Libre GL", "Meal Type", "Carbs"]
    rows = [
        ["01/01/2025 06:00", "100", "90", "Tea\nlate", "5"], ["01/01/2025 06:05", "101", "91", "", ""],
        ["01/01/2025 06:10", "102", "92", 'A "big"\n\nmeal, hot\n', "7"], ["01/01/2025 06:15", "103", "93", "x", "8"],
    ]
    for person in (1, 2):
        folder = tmp_path / f"Person-{person:03d}"
        folder.mkdir()
        with open(folder / f"Person-{person:03d}.csv", "w", newline="", encoding="utf-8") as handle:
            csv.writer(handle).writerows([header, *(rows if person == 1 else rows[1:2])])
    got = read_series_text(spark, str(tmp_path)).where("participant_id = '001'").orderBy("timestamp_text").collect()
    assert [(r.timestamp_text, r.dexcom, r.libre, r.meal_type or "", r.carbs or "") for r in got] == [tuple(r) for r in rows]
    typed = read_series(spark, str(tmp_path)).where("participant_id = '001'").orderBy("timestamp").collect()
    assert [r.carbs for r in typed] == [5.0, None, 7.0, 8.0] and all(r.timestamp for r in typed)
    assert read_series(spark, str(tmp_path)).count() == 5


def test_unclosed_quotes_are_told(spark, tmp_path):
    (tmp_path / "Person-001").mkdir()
    (tmp_path / "Person-001" / "Person-001.csv").write_text('Timestamp,Libre GL\n01/01/2025 06:00,"9\n01/01/2025 06:05,91\n')
    with pytest.warns(UserWarning, match="unclosed quotes in 1 files"):
        assert read_series(spark, str(tmp_path)).count() == 2
