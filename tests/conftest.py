import os
import sys
from datetime import datetime, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SERIES_HEADER = [
    "Timestamp", "Libre GL", "Dexcom GL", "HR", "Calories (Activity)", "Mets", "Meal Type",
    "Calories", "Carbs", "Protein", "Fat", "Fiber", "Amount Consumed", "Image Path",
]


# Per person: minutes between samples, number of samples, first sample, and a pause in minutes before sample 50.
RECORDINGS = {
    1: (5, 100, datetime(2023, 11, 4, 21, 30), 0),
    2: (3, 160, datetime(2023, 11, 4, 22, 15), 0),
    3: (6, 110, datetime(2024, 2, 28, 19, 0), 95),
    4: (10, 90, datetime(2024, 12, 31, 20, 40), 0),
    5: (5, 80, datetime(2024, 6, 1, 3, 0), 0),
}
# Sample at which a meal was logged: kind, carbs, protein, fat, fiber. One entry names no kind.
MEALS = {
    8: ("Snack", "12", "3", "2", "1"),
    20: ("Dinner", "70", "31", "22.5", "9"),
    33: ("", "18", "0", "", ""),
    71: ("Late snack", "41", "12", "9", "6"),
}


def series_rows(person: int, count: int | None = None):
    """Sawtooth sensors with missing cells; the second sensor runs four below the first."""
    every, samples, start, pause = RECORDINGS[person]
    rows = []
    for i in range(count or samples):
        at = start + timedelta(minutes=every * i + (pause if i >= 50 else 0))
        level = 74 + (17 * i + 29 * person) % 61
        kind, carbs, protein, fat, fiber = MEALS.get(i, ("",) * 5)
        cells = [
            at.strftime("%m/%d/%Y %H:%M"), str(level - 4), "" if i % 13 == 5 else str(level),
            "" if i % 9 == 4 else str(60 + (i * i + person) % 23), str(0.5 * (i % 5)), str(10 + i % 7),
            kind, "", carbs, protein, fat, fiber, "", "",
        ]
        rows.append(dict(zip(SERIES_HEADER, cells, strict=True)))
    return rows


def write_series(root, person, rows, header=None):
    import csv

    header = header or SERIES_HEADER
    folder = root / f"Person-{person:03d}"
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / f"Person-{person:03d}.csv", "w", newline="", encoding="utf-8") as handle:
        writer = csv.DictWriter(handle, header, extrasaction="ignore")
        writer.writeheader()
        writer.writerows(rows)


STATIC_HEADER = ["Age", "Gender", "BMI", "A1c PDL (Lab)", "Fasting GLU - PDL (Lab)", "Insulin "]


# One line per person: age, gender, BMI, HbA1c, fasting glucose, fasting insulin.
PERSONS = [
    ("61", "F", "31.4", "5.1", "84", "4.5"),
    ("24", "M", "20.9", "6.1", "118", "12"),
    ("47", "F", "27.75", "7.4", "151", "19.5"),
    ("39", "M", "24.2", "5.7", "99", "<7"),
]


def write_static(root, people: int, id_column: bool = False):
    lines = [",".join((["Participant ID"] if id_column else []) + STATIC_HEADER)]
    for number, cells in enumerate(PERSONS[:people], 1):
        lines.append(",".join(([f"P-{number}"] if id_column else []) + list(cells)))
    (root / "bio.csv").write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="session")
def series_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("series")
    for person in (4, 2, 1, 3):
        write_series(root, person, series_rows(person))
    write_static(root, 4)
    return root
