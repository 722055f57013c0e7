"""Effects of events on samples: trailing sums and decaying responses, by addition alone.

Nothing here pairs events with samples, and nothing is taken away again when an effect ends: a difference
would leave the rounding error of a large effect in every later value. An effect is in force over stretches
of time (``Phase``), and its share of the response at any later time follows from two numbers by a rule
that only adds (``Fade``). Effects of one stretch add up as soon as they are brought to one time.

* The slices that a stretch covers from end to end are split into aligned runs of 1, 2, 4, ... slices, a
  segment tree over the time axis: the effects of a run add up map-side, and a slice reads its few runs.
* In the slices where it begins or ends it meets the samples in one task, in a segment tree over them.

So an effect costs the logarithm of the slices it lasts for, a sample the logarithm of its slice's samples.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucospan.functions.text import nan_to_null
from glucospan.operators.arrow import whole_groups
from glucospan.operators.slices import (
    MINUTE_US,
    SLICE,
    US,
    measured_width,
    micros,
    minutes,
    slice_of,
    sliced,
)
from glucospan.operators.sums import window_sums


@dataclass(frozen=True)
class Fade:
    """What becomes of an effect (u, v) as it ages: v is its response.

    u decays at the rate ``decay`` a minute and feeds v, which decays as well: by the age in minutes if
    ``onset`` is None, else towards u at the rate ``onset``.
    """

    decay: float
    onset: float | None = None

    def columns(self, u: Column, v: Column, age: Column) -> tuple[Column, Column]:
        keep = F.exp(-age * self.decay)
        if self.onset is None:
            return u * keep, (v + u * age) * keep
        return u * keep, (v * F.exp(-age * self.onset) - u * F.expm1(-age * self.onset)) * keep

    def arrays(self, u: np.ndarray, v: np.ndarray, age: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.exp(-age * self.decay)
        if self.onset is None:
            return u * keep, (v + u * age) * keep
        return u * keep, (v * np.exp(-age * self.onset) - u * np.expm1(-age * self.onset)) * keep


@dataclass(frozen=True)
class Phase:
    """An effect is (``u``, ``v``) at ``begin_us`` past its event and in force until just before ``end_us``, or
    for good if that is None."""

    begin_us: Column
    end_us: Column | None
    u: Column
    v: Column
    fade: Fade


def in_force(
    samples: DataFrame,
    events: DataFrame,
    series: Sequence[str],
    sample_time: str,
    event_time: str,
    *,
    phases: Sequence[Phase],
    longest_us: int | None,
    width_us: int,
    out: str,
) -> DataFrame:
    """Add to each sample with a time the sum ``out`` of the responses in force at it.

    ``longest_us``: no phase is longer; None if they have no end.
    """
    stretches = F.array(*[
        F.struct(
            F.lit(number).alias("_phase"),
            (F.col("_event_us") + phase.begin_us).cast("bigint").alias("_from"),
            (F.lit(None) if phase.end_us is None else F.col("_event_us") + phase.end_us).cast("bigint").alias("_to"),
            phase.u.cast("double").alias("_u"),
            phase.v.cast("double").alias("_v"),
        )
        for number, phase in enumerate(phases)
    ])
    fades = [phase.fade for phase in phases]
    probes = sliced(samples, sample_time, width_us)
    probes = probes.select(*series, SLICE, US, F.struct(*samples.columns).alias("_sample"))
    # What has no end lasts until the last sample.
    last = samples.agg(F.max(micros(sample_time))).first()[0]
    if longest_us is None:
        began = events.agg(F.min(micros(event_time))).first()[0]
        longest_us = 0 if last is None or began is None else max(0, last - began)
    levels = (longest_us // width_us + 1).bit_length()
    effects = (
        events.where(F.col(event_time).isNotNull())
        .withColumn("_event_us", micros(event_time))
        .select(*series, F.inline(stretches))
        .withColumn("_to", F.least(F.coalesce("_to", F.lit(2**62)), F.lit(None if last is None else last + 1).cast("bigint")))
        .where(F.col("_to") > F.col("_from"))
        .withColumn("_first", slice_of(F.col("_from"), width_us))
        .withColumn("_last", slice_of(F.col("_to") - 1, width_us))
    )
    begins = effects.withColumn(SLICE, F.col("_first"))
    ends = effects.where(F.col("_last") > F.col("_first")).withColumn(SLICE, F.col("_last"))
    start = F.col(SLICE) * F.lit(width_us)
    ends = _aged(ends, fades, start).withColumn("_from", start)
    columns = [*series, SLICE, "_phase", "_from", "_to", "_u", "_v"]
    standing = _standing(effects, probes, series, fades, width_us, levels).select(*columns)
    local = begins.select(*columns).unionByName(ends.select(*columns)).unionByName(standing)
    rows = probes.withColumn("_from", F.col(US)).unionByName(local, allowMissingColumns=True).drop(US)
    placed = rows.repartition(*series, SLICE).sortWithinPartitions(*series, SLICE, "_from")
    schema = T.StructType([placed.schema["_sample"], T.StructField(out, T.DoubleType())])
    return placed.mapInArrow(_responses([*series, SLICE], fades, out), schema).select("_sample.*", out)


def _aged(effects: DataFrame, fades: Sequence[Fade], until: Column) -> DataFrame:
    """The effects at a time after ``_from``."""
    age = (until - F.col("_from")) / F.lit(MINUTE_US)
    u, v = F.lit(None).cast("double"), F.lit(None).cast("double")
    for number, fade in enumerate(fades):
        mine = F.col("_phase") == number
        later = fade.columns(F.col("_u"), F.col("_v"), age)
        u, v = F.when(mine, later[0]).otherwise(u), F.when(mine, later[1]).otherwise(v)
    return effects.withColumns({"_u": u, "_v": v})


def _runs(first: Column, last: Column) -> Column:
    """The aligned runs (level, number) that make up the slices from ``first`` to ``last``; none if there are none.

    From below, a run is taken where the stretch begins with a right half or ends with a left half.
    """
    nothing = F.array().cast("array<struct<level:int,run:bigint>>")
    state = F.struct(first.alias("low"), (last + 1).alias("high"), nothing.alias("runs"))  # high is not in

    def run(level: Column, number: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), number.alias("run"))

    def step(state: Column, level: Column) -> Column:
        low, high = state["low"], state["high"]
        left = (low < high) & (F.pmod(low, F.lit(2)) == 1)
        low = F.when(left, low + 1).otherwise(low)
        right = (low < high) & (F.pmod(high, F.lit(2)) == 1)
        high = F.when(right, high - 1).otherwise(high)
        found = F.concat(
            state["runs"],
            F.when(left, F.array(run(level, low - 1))).otherwise(nothing),
            F.when(right, F.array(run(level, high))).otherwise(nothing),
        )
        return F.struct(F.shiftright(low, 1).alias("low"), F.shiftright(high, 1).alias("high"), found.alias("runs"))

    levels = F.sequence(F.lit(0), F.length(F.bin(F.greatest(last - first, F.lit(0)))))
    return F.aggregate(levels, state, step, lambda state: state["runs"])


def _standing(effects: DataFrame, probes: DataFrame, series: Sequence[str], fades: Sequence[Fade], width_us: int, levels: int) -> DataFrame:
    """At the start of each slice with samples, the sums of the effects that cover it from end to end."""
    start = F.expr("shiftleft(_run, _level)") * F.lit(width_us)
    inner = effects.where(F.col("_last") - F.col("_first") > 1)
    spread = inner.select(
        *series, "_phase", "_from", "_u", "_v", F.inline(_runs(F.col("_first") + 1, F.col("_last") - 1)).alias("_level", "_run")
    )
    spread = spread.withColumn("_run", F.col("_run").cast("bigint"))
    runs = _aged(spread, fades, start).groupBy(*series, "_phase", "_level", "_run").agg(F.sum("_u").alias("_u"), F.sum("_v").alias("_v"))
    runs = runs.withColumn("_from", start)
    key = F.struct(*series).alias("_series")
    slices = probes.groupBy(key, SLICE).agg(F.lit(1).alias("_one")).drop("_one")
    # Runs of more slices than the longest stretch has do not come up.
    slices = slices.select("_series", SLICE, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level"))
    slices = slices.withColumn("_run", F.expr(f"shiftright({SLICE}, _level)"))
    read = slices.join(runs.select(key, "_phase", "_level", "_run", "_from", "_u", "_v"), ["_series", "_level", "_run"])
    read = _aged(read, fades, F.col(SLICE) * F.lit(width_us))
    summed = read.groupBy("_series", SLICE, "_phase").agg(F.sum("_u").alias("_u"), F.sum("_v").alias("_v"))
    summed = summed.withColumn("_from", F.col(SLICE) * F.lit(width_us))
    return summed.select("_series.*", SLICE, "_phase", "_from", (F.col("_from") + F.lit(width_us)).alias("_to"), "_u", "_v")


def responses(at: np.ndarray, begin: np.ndarray, end: np.ndarray, u: np.ndarray, v: np.ndarray, fade: Fade) -> np.ndarray:
    """The sum of the responses at rising times ``at`` of effects that are (u, v) at ``begin`` and in force before ``end``.

    A segment tree over the times: an effect adds itself to the nodes that make up its times, brought to a node's
    first time; a time adds up its nodes.
    """
    n = len(at)
    low, high = np.searchsorted(at, begin), np.searchsorted(at, end)
    size = 1 << max(0, (n - 1).bit_length())
    first = np.zeros(2 * size, np.int64)
    first[size : size + n] = at
    first[size + n :] = at[-1]
    width = size
    while width > 1:
        first[width // 2 : width] = first[width : 2 * width : 2]
        width //= 2
    sums = np.zeros((2, 2 * size))
    low, high, live = low + size, high + size, np.flatnonzero(low < high)

    def add(effect: np.ndarray, node: np.ndarray) -> None:
        later = fade.arrays(u[effect], v[effect], (first[node] - begin[effect]) / MINUTE_US)
        for total, part in zip(sums, later):
            total += np.bincount(node, part, 2 * size)

    while len(live):
        left = live[low[live] & 1 == 1]
        add(left, low[left])
        low[left] += 1
        right = live[high[live] & 1 == 1]
        right = right[low[right] < high[right]]
        high[right] -= 1
        add(right, high[right])
        low[live] >>= 1
        high[live] >>= 1
        live = live[low[live] < high[live]]
    total, node = np.zeros(n), np.arange(size, size + n)
    while node[0]:
        total += fade.arrays(sums[0][node], sums[1][node], (at - first[node]) / MINUTE_US)[1]
        node >>= 1
    return total


def _responses(keys: list[str], fades: Sequence[Fade], out: str):
    """Batches of (keys..., _from, _to, _phase, _u, _v, _sample), sorted, to (_sample, out)."""

    def finished(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        probe = column["_phase"].is_null().to_numpy(zero_copy_only=False)
        if not probe.any():
            return
        whole = {n: column[n].fill_null(0).to_numpy(zero_copy_only=False) for n in ("_from", "_to", "_phase", "_u", "_v")}
        at, total = whole["_from"][probe], np.zeros(int(probe.sum()))
        for number, fade in enumerate(fades):
            mine = ~probe & (whole["_phase"] == number)
            if mine.any():
                total += responses(at, *(whole[n][mine] for n in ("_from", "_to", "_u", "_v")), fade)
        yield pa.RecordBatch.from_arrays([column["_sample"].filter(pa.array(probe)), pa.array(total)], names=["_sample", out])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(parts, keys):
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), rows.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                yield from finished(rows.slice(a, b - a))

    return batches


def shared_width(
    samples: DataFrame, events: DataFrame, series: Sequence[str], sample_time: str, event_time: str
) -> int:
    """Slice width that suits the denser of the two tables."""
    return min(
        measured_width(samples, series, sample_time), measured_width(events, series, event_time)
    )


def event_sum(
    samples: DataFrame,
    events: DataFrame,
    series: Sequence[str],
    sample_time: str,
    event_time: str,
    amount: str,
    *,
    window_minutes: float = 120,
    out: str = "event_sum",
    width_us: int | None = None,
) -> DataFrame:
    """Sum of the amounts of events aged 0 to ``window_minutes`` (both ends count); 0.0 if none."""
    width_us = width_us or shared_width(samples, events, series, sample_time, event_time)
    probes = samples.select(
        *series, F.col(sample_time).alias("_time"), F.struct(*samples.columns).alias("_sample")
    )
    amounts = events.select(
        *series, F.col(event_time).alias("_time"), nan_to_null(F.col(amount).cast("double")).alias("_sum")
    ).where(F.col("_sum").isNotNull())
    rows = probes.unionByName(amounts, allowMissingColumns=True)
    found = window_sums(rows, series, "_time", "_sample", {"_sum": minutes(window_minutes) + 1}, width_us)
    return found.select("_sample.*", F.coalesce("_sum", F.lit(0.0)).alias(out))


def _end(cutoff_minutes: float | None) -> Column | None:
    return None if cutoff_minutes is None else F.lit(minutes(cutoff_minutes) + 1)


def gamma_response(
    samples: DataFrame,
    events: DataFrame,
    series: Sequence[str],
    sample_time: str,
    event_time: str,
    amount: str,
    *,
    peak_minutes: float = 50.0,
    cutoff_minutes: float | None = None,
    out: str = "gamma_response",
    width_us: int | None = None,
) -> DataFrame:
    """Sum of amount * (d/peak) * exp(1 - d/peak) over events of age d >= 0, up to the cutoff if given."""
    width_us = width_us or shared_width(samples, events, series, sample_time, event_time)
    value = nan_to_null(F.col(amount).cast("double"))
    return in_force(
        samples,
        events.where(value.isNotNull()),
        series,
        sample_time,
        event_time,
        phases=[Phase(F.lit(0), _end(cutoff_minutes), value * (np.e / peak_minutes), F.lit(0.0), Fade(1.0 / peak_minutes))],
        longest_us=None if cutoff_minutes is None else minutes(cutoff_minutes) + 1,
        width_us=width_us,
        out=out,
    )


# Scaling of an activity by its duration (minutes at factor one, and the largest factor).
FULL_DURATION_MINUTES, MAX_DURATION_FACTOR = 45.0, 1.6


def onset_decay_response(
    samples: DataFrame,
    events: DataFrame,
    series: Sequence[str],
    sample_time: str,
    event_time: str,
    duration_minutes: str,
    intensity: str,
    *,
    onset_minutes: float = 20.0,
    decay_minutes: float = 120.0,
    full_duration_minutes: float = FULL_DURATION_MINUTES,
    cutoff_minutes: float | None = None,
    out: str = "onset_decay_response",
    width_us: int | None = None,
) -> DataFrame:
    """Sum of scale * (1 - exp(-d/onset)) * decay over events of age d >= 0, up to the cutoff if given.

    ``scale`` is intensity * min(duration / full duration, 1.6); decay is 1 while the activity lasts
    and exp(-(d - duration)/decay) afterwards: two phases.
    """
    width_us = width_us or shared_width(samples, events, series, sample_time, event_time)
    reach = _end(cutoff_minutes)
    duration, strength = [nan_to_null(F.col(n).cast("double")) for n in (duration_minutes, intensity)]
    lasts = F.greatest(duration, F.lit(1.0))
    switch = F.round(lasts * MINUTE_US).cast("bigint")
    if reach is not None:
        switch = F.least(switch, reach)
    scale = strength * F.least(duration / full_duration_minutes, F.lit(MAX_DURATION_FACTOR))
    ended = switch / MINUTE_US
    over = scale * F.exp((lasts - ended) / decay_minutes)
    return in_force(
        samples,
        events.where(duration.isNotNull() & strength.isNotNull()),
        series,
        sample_time,
        event_time,
        phases=[
            Phase(F.lit(0), switch, scale, F.lit(0.0), Fade(0.0, 1.0 / onset_minutes)),
            Phase(switch, reach, over, -over * F.expm1(-ended / onset_minutes), Fade(1.0 / decay_minutes, 1.0 / onset_minutes)),
        ],
        longest_us=None if cutoff_minutes is None else minutes(cutoff_minutes) + 1,
        width_us=width_us,
        out=out,
    )
