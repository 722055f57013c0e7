"""Ordered operators against brute force, at slice widths far below and far above the windows."""

from datetime import datetime, timedelta

import brute
import pytest
from pyspark.sql import functions as F

from glucospan.operators import asof, events, export, selection, slices, windows
from glucospan.operators.windows import Trailing

# Seven minutes is shorter than every window here, two days longer than every window.
WIDTHS = [slices.minutes(7), slices.minutes(95), 2 * slices.DAY_US, None]


@pytest.fixture(scope="module")
def rows():
    return brute.random_series(1, hot="b")


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3).cache()


def close(a, b):
    return (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-8))


@pytest.mark.parametrize("width", WIDTHS)
def test_trailing(frame, rows, width):
    cases = [(120, "sum", "both", 0.0), (30, "mean", "right", None), (60, "sum", "right", None)]
    specs = [Trailing(f"x{i}", F.col("v"), m, agg, closed, default) for i, (m, agg, closed, default) in enumerate(cases)]
    got = {r["row"]: r for r in windows.trailing(frame, ["s"], "ts", specs, width_us=width).collect()}
    assert len(got) == len(rows)
    for i, case in enumerate(cases):
        want = brute.trailing(rows, *case)
        assert all(close(got[row][f"x{i}"], want[row]) for row in want)


def test_window_ends(spark):
    """A value exactly 30 minutes old is outside a half-open window; 120 minutes old is inside a closed one."""
    t = datetime(2024, 1, 1, 0, 10)
    times = [t, t + timedelta(minutes=30), t + timedelta(minutes=120), t + timedelta(minutes=120, microseconds=1)]
    df = spark.createDataFrame([("a", x, 1.0, i) for i, x in enumerate(times)], brute.SCHEMA)
    specs = [Trailing("half", F.col("v"), 30, "sum", "right"), Trailing("closed", F.col("v"), 120)]
    for width in [slices.minutes(3), slices.DAY_US]:
        out = {r["row"]: (r["half"], r["closed"]) for r in windows.trailing(df, ["s"], "ts", specs, width_us=width).collect()}
        assert out == {0: (1, 1), 1: (1, 2), 2: (1, 3), 3: (2, 3)}


def at(minute: float) -> datetime:
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


@pytest.mark.parametrize("width", WIDTHS)
def test_spike_and_nan_stay_in_their_windows(spark, width):
    """One large value, a NaN and an infinity change no window that does not hold them."""
    spike = [(1e9 / 3), (1e9 / 3), (1e9 / 3), 0.1, 0.1, 0.1]
    df = spark.createDataFrame([("a", at(10 * i), v, i) for i, v in enumerate(spike)], brute.SCHEMA)
    spec = [Trailing("x", F.col("v"), 20, "sum", "right")]
    got = {r["row"]: r["x"] for r in windows.trailing(df, ["s"], "ts", spec, width_us=width).collect()}
    assert got[4] == got[5] == 0.2
    odd = [float("nan"), 1.0, 2.0, float("inf"), 4.0, 5.0, 6.0]
    df = spark.createDataFrame([("a", at(10 * i), v, i) for i, v in enumerate(odd)], brute.SCHEMA)
    spec = [Trailing("x", F.col("v"), 20, "mean", "right")]
    got = {r["row"]: r["x"] for r in windows.trailing(df, ["s"], "ts", spec, width_us=width).collect()}
    assert got == {0: None, 1: 1.0, 2: 1.5, 3: float("inf"), 4: float("inf"), 5: 4.5, 6: 5.5}


def test_rows_without_id_and_repeated_times(spark):
    """Rows without an id are a series of their own; a tie-break decides the order of equal times."""
    rows = [(None, at(5 * i), float(i), i) for i in range(20)] + [("a", at(5 * (i // 2)), float(i), 100 + i) for i in range(40)]
    df = spark.createDataFrame(rows, brute.SCHEMA).repartition(3)
    for width in [slices.minutes(7), None]:
        assert windows.gaps(df, ["s"], "ts", width_us=width).where("s is null and gap_us = 300000000").count() == 19
        assert selection.every_kth(df, ["s"], "ts", stride=5, tiebreak=["row"]).where("s is null").count() == 4
        assert selection.large_enough(df, ["s"], "ts", 20).where("s is null").count() == 20
        out = windows.timed_shifts(df, ["s"], "ts", "v", tiebreak=["row"], width_us=width).collect()
        alone = {r["row"]: (r["glucose_lag_15m"], r["glucose_lag_30m"], r["target_30m"]) for r in out if r["s"] is None}
        assert alone[10] == (7.0, 4.0, 16.0)
        ahead = asof.future_matches(df, ["s"], "ts", ahead_minutes=10, tolerance_minutes=1, width_us=width)
        assert ahead.where("s is null and hit").count() == 18
        near = windows.timed_shifts(df, ["s"], "ts", "v", lags=[15], horizon=15, tiebreak=["row"], width_us=width)
        # Three rows of a series with two rows per time.
        assert {r["row"]: (r["glucose_lag_15m"], r["target_30m"]) for r in near.collect() if r["s"] == "a"}[120] == (17.0, 23.0)


def test_times_do_not_follow_the_session_zone(spark):
    """On the night the clocks go forward in New York two zone-less hours stay two hours."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = [datetime(2024, 3, 10, 1, 30), datetime(2024, 3, 10, 3, 30), datetime(1969, 12, 31, 23, 59, 59, 250000)]
        df = spark.createDataFrame([("a", t, 1.0, i) for i, t in enumerate(times)], brute.SCHEMA)
        gap = {r["row"]: r["gap_us"] for r in windows.gaps(df, ["s"], "ts").collect()}
        assert gap[1] == 7_200_000_000
        assert {r["row"]: r["us"] for r in df.select("row", slices.micros("ts").alias("us")).collect()}[2] == -750_000
        told = df.select("row", export.utc_text(F.col("ts")).alias("t")).where("row = 1").first()["t"]
        assert told == "2024-03-10T03:30:00+00:00"
        zoned = spark.sql("select timestamp'2024-03-10 03:30:00' as t")
        assert zoned.select(slices.micros("t")).first()[0] == 1710055800 * 10**6
        assert zoned.select(export.utc_text(F.col("t"))).first()[0] == "2024-03-10T07:30:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_one_series_of_nearly_all_rows(spark):
    """A hot series is cut into many slices, none of which holds more than a few rows."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("s"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts"),
        (F.col("id") % 7).cast("double").alias("v"), F.col("id").cast("int").alias("row"),
    )
    width = slices.measured_width(df, ["s"], "ts", rows_per_slice=50)
    assert width < slices.minutes(1)
    spec = [Trailing("x", F.col("v"), 5, "sum", "right")]
    got = {r["row"]: r["x"] for r in windows.trailing(df, ["s"], "ts", spec, width_us=width).collect()}
    for row in (1, 299, 301, 2500, 4999):
        mine = [i for i in range(max(0, row - 299), row + 1) if (i % 10 == 0) == (row % 10 == 0)]
        assert got[row] == sum(i % 7 for i in mine)


@pytest.mark.parametrize("width", [slices.minutes(7), None])
def test_kernels_without_cutoff(spark, width):
    """Events of a month act on every later sample, across blocks and with the clock re-based."""
    happened = [("a", at(m), v, 0) for m, v in [(0, 50.0), (7 * 1440, 20.0), (9 * 1440 + 3, 80.0), (33 * 1440, 5.0)]]
    times = [0, 30, 600, 7 * 1440 + 50, 9 * 1440 + 60, 12 * 1440, 33 * 1440 + 20, 40 * 1440]
    samples = spark.createDataFrame([("a", at(m), None, i) for i, m in enumerate(times)], brute.SCHEMA)
    effects = spark.createDataFrame(happened, brute.SCHEMA).select("s", "ts", "v", F.lit(90.0).alias("lasts"))
    gamma = events.gamma_response(samples, effects, ["s"], "ts", "ts", "v", peak_minutes=300, width_us=width)
    decay = events.onset_decay_response(samples, effects, ["s"], "ts", "ts", "lasts", "v", onset_minutes=20, decay_minutes=3000, width_us=width)
    got = {r["row"]: r["gamma_response"] for r in gamma.collect()}
    late = {r["row"]: r["onset_decay_response"] for r in decay.collect()}
    for i, m in enumerate(times):
        ages = [(m - (t - at(0)) / timedelta(minutes=1), v) for _, t, v, _ in happened if t <= at(m)]
        assert got[i] == pytest.approx(sum(v * brute.gamma(d, 300) for d, v in ages), abs=1e-8)
        assert late[i] == pytest.approx(sum(v * 1.6 * brute.onset_decay(d, 90, 20, 3000) for d, v in ages), abs=1e-6)


@pytest.mark.parametrize("width", [slices.minutes(1) // 6, slices.minutes(7), slices.DAY_US, None])
def test_ended_effects_leave_nothing_behind(spark, width):
    """A huge effect that has ended, beside a small one: the small one is exact."""
    effects = spark.createDataFrame([("a", at(0), 1e12, 0), ("a", at(100), 0.1, 1)], brute.SCHEMA).withColumn("lasts", F.lit(30.0))
    samples = spark.createDataFrame([("a", at(m), None, m) for m in (0, 100, 120, 121, 150, 220, 221)], brute.SCHEMA)
    gamma = events.gamma_response(samples, effects, ["s"], "ts", "ts", "v", cutoff_minutes=120, width_us=width)
    decay = events.onset_decay_response(samples, effects, ["s"], "ts", "ts", "lasts", "v", cutoff_minutes=120, width_us=width)
    got = {r["row"]: r["gamma_response"] for r in gamma.collect()}
    late = {r["row"]: r["onset_decay_response"] for r in decay.collect()}
    assert got[150] == pytest.approx(0.1, rel=1e-12) and got[0] == late[0] == got[221] == late[221] == 0
    for m in (121, 150, 220):
        assert got[m] == pytest.approx(0.1 * brute.gamma(m - 100, 50), rel=1e-9)
        assert late[m] == pytest.approx(0.1 * 30 / 45 * brute.onset_decay(m - 100, 30, 20, 120), rel=1e-9)
    assert got[120] == pytest.approx(1e12 * brute.gamma(120, 50) + 0.1 * brute.gamma(20, 50), rel=1e-12)


def test_runs_of_slices(spark):
    """Every stretch of slices is made up of aligned runs, each slice once."""
    import random

    draw = random.Random(5)
    ends = [(a, a + draw.randint(-3, 90)) for a in (draw.randint(-200, 10**8) for _ in range(200))] + [(0, 0), (-1, 0), (7, 6), (0, 4095)]
    found = spark.createDataFrame(ends, "a long, b long").select("a", "b", events._runs(F.col("a"), F.col("b")).alias("runs"))
    for r in found.collect():
        assert sorted(i for x in r.runs for i in range(x.run << x.level, (x.run + 1) << x.level)) == list(range(r.a, r.b + 1))
        assert len(r.runs) <= 14


def test_windows_of_many_slices(spark):
    """Windows of up to some hundred slices, among them gaps of empty ones."""
    import random

    draw = random.Random(8)
    rows = [("a" if i % 3 else "b", at(draw.choice((0, 5000)) + draw.randint(0, 900)), float(draw.randint(-5, 9)), i) for i in range(150)]
    frame = spark.createDataFrame(rows, brute.SCHEMA).repartition(3).cache()
    cases = [(700, "sum", "both", 0.0), (33, "sum", "right", None), (121, "mean", "right", None), (3, "sum", "both", 0.0)]
    specs = [Trailing(f"x{i}", F.col("v"), m, agg, closed, default) for i, (m, agg, closed, default) in enumerate(cases)]
    for width in (slices.minutes(1), slices.minutes(2), slices.minutes(5)):
        got = {r["row"]: r for r in windows.trailing(frame, ["s"], "ts", specs, width_us=width).collect()}
        for i, case in enumerate(cases):
            want = brute.trailing(rows, *case)
            assert all(close(got[row][f"x{i}"], want[row]) for row in want), (width, case)


def test_repeated_times_all_count(spark):
    t = datetime(1969, 12, 31, 23, 59)
    df = spark.createDataFrame([("a", t, 1.0, 0), ("a", t, 2.0, 1), ("a", t + timedelta(minutes=2), 4.0, 2)], brute.SCHEMA)
    for width in [slices.minutes(1), slices.DAY_US]:
        out = windows.trailing(df, ["s"], "ts", [Trailing("x", F.col("v"), 120)], width_us=width)
        assert {r["row"]: r["x"] for r in out.collect()} == {0: 3.0, 1: 3.0, 2: 7.0}


@pytest.mark.parametrize("width", WIDTHS)
def test_gaps_and_rank(frame, rows, width):
    got = {r["row"]: r["gap_us"] for r in windows.gaps(frame, ["s"], "ts", width_us=width).collect()}
    rank = {
        r["row"]: (r["rn"], r["series_rows"])
        for r in slices.ranked(frame, ["s"], "ts", tiebreak=["row"], width_us=width).collect()
    }
    for s in "ab":
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[3]))
        before = None
        for i, (_, t, _, row) in enumerate(mine):
            assert got[row] == (None if before is None else brute.us(t) - brute.us(before))
            assert rank[row] == (i + 1, len(mine))
            before = t


@pytest.mark.parametrize("width", WIDTHS)
def test_cadence(frame, rows, width):
    got = {r["s"]: r["cadence_minutes"] for r in windows.cadence(frame, ["s"], "ts", width_us=width).collect()}
    assert got == {s: brute.cadence([r[1] for r in rows if r[0] == s]) for s in "ab"}


@pytest.mark.parametrize("width", WIDTHS)
def test_timed_shifts(spark, width):
    rows = brute.random_series(3, hot="b", count=200, gaps=brute.REGULAR_GAPS)
    want = brute.shifted(rows)
    assert 50 < len(want) < len(rows) - 50
    frame = spark.createDataFrame(rows, brute.SCHEMA)
    out = windows.timed_shifts(frame, ["s"], "ts", "v", width_us=width).collect()
    got = {
        r["row"]: (r["glucose_lag_15m"], r["glucose_lag_30m"], r["target_30m"], r["target_timestamp"])
        for r in out
    }
    assert got == want


def test_steps_round_half_to_even(spark):
    df = spark.createDataFrame([(2.0,), (6.0,), (12.0,), (90.0,)], "c double")
    got = [r[0] for r in df.select(windows.steps(15, F.col("c"))).collect()]
    assert got == [max(1, round(15 / c)) for c in (2.0, 6.0, 12.0, 90.0)]


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_shift_rows(frame, rows, block):
    shifts = {"lag": ("v", 2), "lead": ("v", -3)}
    out = windows.shift_rows(
        frame, ["s"], "ts", shifts, tiebreak=["row"], width_us=slices.minutes(50), rows_per_block=block
    )
    got = {r["row"]: (r["lag"], r["lead"]) for r in out.collect()}
    for s in "ab":
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[3]))
        for i, r in enumerate(mine):
            lag = mine[i - 2][2] if i >= 2 else None
            lead = mine[i + 3][2] if i + 3 < len(mine) else None
            assert got[r[3]] == (lag, lead)


@pytest.mark.parametrize("width", WIDTHS)
def test_asof(spark, frame, rows, width):
    matched = asof.future_matches(frame, ["s"], "ts", tolerance_minutes=7.5, width_us=width)
    got = {r["row"]: (r["matched_timestamp"], r["hit"]) for r in matched.collect()}
    for s, t, _, row in rows:
        best = brute.nearest(t + timedelta(minutes=30), [r[1] for r in rows if r[0] == s], 7.5)
        assert got[row] == (best, best is not None and best > t)


def test_asof_ties_tolerance_and_empty_sides(spark):
    t = datetime(2024, 1, 1, 12)
    right = spark.createDataFrame(
        [("a", t - timedelta(minutes=5), 1.0), ("a", t + timedelta(minutes=5), 2.0)], "s string, seen timestamp_ntz, v double"
    )
    left = spark.createDataFrame(
        [("a", t, 0), ("a", t + timedelta(minutes=15), 1), ("a", t + timedelta(minutes=15, microseconds=1), 2), ("z", t, 3)],
        "s string, ts timestamp_ntz, row int",
    )
    for width in [slices.minutes(1), slices.DAY_US]:
        out = asof.asof_nearest(left, right, ["s"], "ts", "seen", tolerance_minutes=10, width_us=width)
        assert {r["row"]: r["matched_v"] for r in out.collect()} == {0: 1.0, 1: 2.0, 2: None, 3: None}


@pytest.fixture(scope="module")
def happened():
    return [
        (s, t, v, row % 50 + 0.5, row)
        for s, t, v, row in brute.random_series(2, series=("a", "b", "c"), count=40)
    ]


@pytest.fixture(scope="module")
def event_frame(spark, happened):
    return spark.createDataFrame(happened, "s string, at timestamp_ntz, v double, lasts double, n int").cache()


def ages(rows, happened, cutoff):
    for s, t, _, row in rows:
        yield row, [
            ((brute.us(t) - brute.us(at)) / 6e7, v, lasts)
            for s2, at, v, lasts, _ in happened
            if s2 == s and v is not None and 0 <= brute.us(t) - brute.us(at) <= cutoff * 60_000_000
        ]


@pytest.mark.parametrize("width", WIDTHS)
def test_event_sum(frame, rows, event_frame, happened, width):
    out = events.event_sum(frame, event_frame, ["s"], "ts", "at", "v", window_minutes=120, width_us=width)
    got = {r["row"]: r["event_sum"] for r in out.collect()}
    for row, active in ages(rows, happened, 120):
        assert got[row] == pytest.approx(sum(v for _, v, _ in active), abs=1e-8)
        if not active:
            assert got[row] == 0.0


@pytest.mark.parametrize("width", WIDTHS)
def test_gamma_response(frame, rows, event_frame, happened, width):
    out = events.gamma_response(frame, event_frame, ["s"], "ts", "at", "v", cutoff_minutes=600, width_us=width)
    got = {r["row"]: r["gamma_response"] for r in out.collect()}
    for row, active in ages(rows, happened, 600):
        assert got[row] == pytest.approx(sum(v * brute.gamma(d, 50) for d, v, _ in active), rel=1e-9, abs=1e-7)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("cutoff", [30, 600])
def test_onset_decay_response(frame, rows, event_frame, happened, width, cutoff):
    """With the short cutoff some activities outlast it."""
    out = events.onset_decay_response(
        frame, event_frame, ["s"], "ts", "at", "lasts", "v", cutoff_minutes=cutoff, width_us=width
    )
    got = {r["row"]: r["onset_decay_response"] for r in out.collect()}
    for row, active in ages(rows, happened, cutoff):
        want = sum(v * min(n / 45, 1.6) * brute.onset_decay(d, n, 20, 120) for d, v, n in active)
        assert got[row] == pytest.approx(want, rel=1e-9, abs=1e-7)


def test_width_follows_the_densest_hour(spark):
    t = datetime(2024, 1, 1)
    dense = [("hot", t + timedelta(seconds=i), 1.0, i) for i in range(3600)]
    sparse = [("cold", t + timedelta(days=i), 1.0, i) for i in range(5)]
    df = spark.createDataFrame(dense + sparse, brute.SCHEMA)
    assert slices.measured_width(df, ["s"], "ts", rows_per_slice=600) == slices.minutes(10)
    assert slices.measured_width(df.where("s = 'cold'"), ["s"], "ts") == 28 * slices.DAY_US


@pytest.mark.parametrize("width", WIDTHS)
def test_selection_by_rank(frame, rows, width):
    n = {s: sum(r[0] == s for r in rows) for s in "ab"}
    thinned = selection.every_kth(frame, ["s"], "ts", max_points=50, tiebreak=["row"], width_us=width)
    kept = {r["row"] for r in thinned.collect()}
    split = selection.chronological_split(frame, ["s"], "ts", tiebreak=["row"], width_us=width)
    test = {r["row"]: r["is_test"] for r in split.collect()}
    for s in "ab":
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[3]))
        step = max(1, n[s] // 50)
        assert [r[3] for r in mine if r[3] in kept] == [r[3] for r in mine[::step]]
        cut = min(max(int(n[s] * 0.7), 30), n[s] - 20)
        assert [test[r[3]] for r in mine] == [i >= cut for i in range(n[s])]


def test_size_gate_and_tail(spark, frame, rows):
    few = spark.createDataFrame(brute.random_series(5, series=("tiny",), count=59), brute.SCHEMA)
    whole = frame.union(few)
    assert {r["s"] for r in selection.large_enough(whole, ["s"], "ts").select("s").distinct().collect()} == {"a", "b"}
    tail = {r["row"] for r in selection.last_rows(frame, ["s"], "ts", 48, ["row"]).collect()}
    for s in "ab":
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[3]))
        assert {r[3] for r in mine} & tail == {r[3] for r in mine[-48:]}


@pytest.mark.parametrize("count", [3, 60, 1500])
@pytest.mark.parametrize("width", [slices.minutes(95), None])
def test_tails_of_any_length(spark, frame, rows, count, width):
    tail = {r["row"] for r in selection.last_rows(frame, ["s"], "ts", count, ["row"], width_us=width).collect()}
    for s in "ab":
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[3]))
        assert {r[3] for r in mine} & tail == {r[3] for r in mine[-count:]}


def test_bursts_are_cut(spark):
    """600,000 rows, one microsecond apart, beside a sparse series."""
    burst = spark.range(600_000).select(
        F.lit("a").alias("s"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") / 1e6)).alias("ts")
    )
    sparse = spark.createDataFrame([("b", at(m)) for m in range(0, 5000, 300)], "s string, ts timestamp_ntz")
    both = burst.unionByName(sparse)
    width = slices.measured_width(both, ["s"], "ts", rows_per_slice=50_000)
    found = slices.sliced(both, "ts", width).groupBy("s", slices.SLICE).count()
    assert found.agg(F.max("count")).first()[0] <= 50_000
    same = burst.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert slices.measured_width(same, ["s"], "ts", rows_per_slice=50_000) > 0
    assert slices.measured_width(sparse, ["s"], "ts") == 28 * slices.DAY_US
    assert slices.measured_width(sparse.limit(0), ["s"], "ts") == 28 * slices.DAY_US


def test_static_rows_reach_hot_and_unnamed_series(spark):
    from glucospan.operators import joins

    rows = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 50), ("c", 51)], "s string, `n x` long").withColumn("_part", F.lit(9))
    static = spark.createDataFrame([("a", 1.5), (None, 2.0), ("d", 3.0)], "s string, age double")
    out = joins.attach_static(rows, static, "s")
    assert out.columns == ["s", "n x", "_part", "age"]
    assert sorted((r["n x"], r["_part"], r["age"]) for r in out.collect()) == [(i, 9, 1.5) for i in range(50)] + [(50, 9, None), (51, 9, None)]


def test_groups_of_arrow_batches():
    import random

    import pyarrow as pa

    from glucospan.operators.arrow import whole_groups

    draw = random.Random(4)
    for _ in range(60):
        keys = sorted((draw.choice("abcd"), draw.randint(0, 2)) for _ in range(draw.randint(0, 40)))
        names = [None if a == "a" else a for a, _ in keys]
        rows = pa.record_batch({"s": pa.array(names, pa.string()), "n": pa.array([b for _, b in keys], pa.int64()), "i": pa.array(range(len(keys)), pa.int64())})
        cuts = sorted({0, len(keys), *(draw.randint(0, len(keys)) for _ in range(6))})
        parts = [rows.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]
        seen, found = [], {}
        for k, (batch, group) in enumerate(whole_groups(iter(parts), ["s", "n"])):
            seen += batch.column(2).to_pylist()
            for i, g in zip(batch.column(2).to_pylist(), group.tolist()):
                found.setdefault((k, g), set()).add(i)
        assert seen == list(range(len(keys)))
        want = {}
        for i, key in enumerate(keys):
            want.setdefault(key, set()).add(i)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
