"""Definitions worked out row by row in plain Python, and small random series to try them on."""

import math
import random
from datetime import datetime, timedelta

EPOCH = datetime(1970, 1, 1)


def us(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


GAPS = [60] * 6 + [300, 420.5, 1800, 5 * 3600]
REGULAR_GAPS = [60] * 200 + [61.5, 61.5, 100, 240, 5 * 3600]


def random_series(seed, series=("a", "b"), count=120, hot=None, gaps=GAPS, start=datetime(2024, 3, 1, 22)):
    """Rows (series, time, value, row) with repeated gaps, long pauses and missing values."""
    rng = random.Random(seed)
    rows = []
    for name in series:
        t = start
        for _ in range(count * (4 if name == hot else 1)):
            t += timedelta(seconds=rng.choice(gaps))
            value = None if rng.random() < 0.15 else round(rng.uniform(40, 300), 2)
            rows.append((name, t, value, len(rows)))
    rng.shuffle(rows)
    return rows


SCHEMA = "s string, ts timestamp_ntz, v double, row int"


def trailing(rows, minutes, agg, closed, default=None):
    span = round(minutes * 60_000_000)
    out = {}
    for s, t, _, row in rows:
        inside = [
            v
            for s2, t2, v, _ in rows
            if s2 == s and v is not None and us(t2) <= us(t)
            and (us(t2) >= us(t) - span if closed == "both" else us(t2) > us(t) - span)
        ]
        total = math.fsum(inside) if inside else default
        out[row] = total / len(inside) if inside and agg == "mean" else total
    return out


def median(values):
    values = sorted(values)
    n = len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2


def cadence(times, limit=30):
    times = sorted(times)
    gaps = [us(b) - us(a) for a, b in zip(times, times[1:], strict=False)]
    gaps = [g for g in gaps if 0 < g <= limit * 60_000_000]
    return median(gaps) / 60_000_000 if gaps else None


def shifted(rows, lags=(15, 30), horizon=30):
    """row -> (lag 15, lag 30, target, target time) for rows whose elapsed times fit."""
    out = {}
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        pace = cadence([r[1] for r in mine])
        if pace is None:
            continue
        tolerance = max(2.0, 2 * pace)
        back = [max(1, round(lag / pace)) for lag in lags]
        ahead = max(1, round(horizon / pace))
        for i, (_, t, _, row) in enumerate(mine):
            if any(i - b < 0 for b in back) or i + ahead >= len(mine):
                continue
            past = [mine[i - b] for b in back]
            future = mine[i + ahead]
            fits = all(
                abs((us(t) - us(p[1])) / 6e7 - lag) <= tolerance for p, lag in zip(past, lags, strict=True)
            ) and abs((us(future[1]) - us(t)) / 6e7 - horizon) <= tolerance
            if fits:
                out[row] = (past[0][2], past[1][2], future[2], future[1])
    return out


def nearest(t, candidates, tolerance_minutes):
    best = None
    for c in sorted(candidates):
        if best is None or abs(us(c) - us(t)) < abs(us(best) - us(t)):
            best = c
    if best is None or abs(us(best) - us(t)) > tolerance_minutes * 60_000_000:
        return None
    return best


def gamma(d, peak):
    return d / peak * math.exp(1 - d / peak)


def onset_decay(d, duration, onset, decay):
    return (1 - math.exp(-d / onset)) * math.exp(-max(d - max(duration, 1), 0) / decay)
