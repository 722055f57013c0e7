"""Choosing rows: down-sampling, tails, first windows, filters and splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucospan.functions.text import pad_id
from glucospan.operators.slices import (
    SERIES_KEY,
    SLICE,
    US,
    measured_width,
    ranked,
    sliced,
    with_slice_facts,
)
from glucospan.storage import stored


class UnknownSeriesError(ValueError):
    pass


def every_kth(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    *,
    max_points: int | None = None,
    stride: int | None = None,
    tiebreak: Sequence[str] = (),
    width_us: int | None = None,
) -> DataFrame:
    """Every k-th row by time, starting with the first; k is ``stride`` or rows // ``max_points``.

    The integer division means the result can hold up to twice ``max_points`` rows.
    """
    if (max_points is None) == (stride is None):
        raise ValueError("give either max_points or stride")
    rows = ranked(df, series, time, tiebreak=tiebreak, width_us=width_us, rank="_rn")
    if stride is None:
        step = F.greatest(F.lit(1), F.floor(F.col("series_rows") / F.lit(max_points)))
    else:
        step = F.lit(stride)
    return rows.where(F.pmod(F.col("_rn") - 1, step) == 0).drop("_rn", "series_rows")


def last_rows(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    count: int = 48,
    tiebreak: Sequence[str] = (),
    width_us: int | None = None,
) -> DataFrame:
    """Last ``count`` rows of each series, whatever the count.

    The rows of each (series, slice) are counted map-side; the counts of later slices tell which slices can
    hold one of the last rows. Only their rows are ranked, slice by slice, so a hot series is never in one task.
    """
    width_us = width_us or measured_width(df, series, time)
    rows = sliced(df, time, width_us).withColumn(SERIES_KEY, F.struct(*series))
    later = Window.partitionBy(SERIES_KEY).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(SERIES_KEY, SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    slices = slices.withColumn("_later", F.coalesce(F.sum("_rows").over(later), F.lit(0)))
    near = slices.where(F.col("_later") < count).select(SERIES_KEY, SLICE, "_later")
    order = Window.partitionBy(SERIES_KEY, SLICE).orderBy(
        F.col(US).desc(), *[F.col(name).desc() for name in tiebreak]
    )
    ranked_rows = rows.join(near, [SERIES_KEY, SLICE]).withColumn("_rn", F.row_number().over(order) + F.col("_later"))
    return ranked_rows.where(F.col("_rn") <= count).select(*(F.col(f"`{n}`") for n in df.columns))


def one_series(df: DataFrame, series: str, wanted: str) -> DataFrame:
    """Rows of one series, ids compared after padding; none for an unknown id.

    A plain comparison with the raw id stands beside the padded one, since only that reaches the scan
    and, in a table sorted by id, skips its files and row groups.
    """
    key = str(wanted).strip().zfill(3)
    raw = F.col(series)
    if isinstance(df.schema[series].dataType, T.StringType):
        sign, digits = (key[0], key[1:]) if key[0] in "+-" else ("", key)
        bare = digits.lstrip("0")
        spellings = {sign + bare.zfill(n) for n in range(len(bare), len(digits) + 1)}
        plain = raw.isin(sorted(spellings - {""}))
    else:
        try:
            plain = raw == F.lit(int(key))
        except ValueError:
            plain = F.lit(False)
    return df.where(plain & (pad_id(raw) == key))


def known_series(df: DataFrame, series: str) -> DataFrame:
    """All ids as ``one_series`` compares them."""
    return df.select(pad_id(F.col(series)).alias(series)).distinct()


def require_series(rows: DataFrame, wanted: str) -> DataFrame:
    """``rows`` as they are, or an error if there are none."""
    if rows.isEmpty():
        raise UnknownSeriesError(f"unknown series {str(wanted).strip().zfill(3)!r}; see known_series")
    return rows


def large_enough(df: DataFrame, series: Sequence[str], time: str, at_least: int = 60, *, width_us: int | None = None) -> DataFrame:
    """Rows of series with at least ``at_least`` rows; smaller series drop out without an error."""
    width_us = width_us or measured_width(df, series, time)
    rows = with_slice_facts(sliced(df, time, width_us), series, ["series_rows"])
    return rows.where(F.col("series_rows") >= at_least).drop(US, SLICE, SERIES_KEY, "series_rows")


def first_windows(
    df: DataFrame,
    group: str,
    series: str,
    time: str,
    *,
    hours: float = 48,
    at_least: int = 600,
    groups: Sequence[str] | None = None,
    width_us: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Per group, the lowest series id whose first ``hours`` (end excluded) hold enough rows.

    Returns the chosen rows and one metadata row (rows, start, end) per group. With ``groups`` a
    group without a choice is an error, checked on the metadata, which has one row per group.
    """
    keys = [group, series]
    width_us = width_us or measured_width(df, keys, time)
    rows = with_slice_facts(sliced(df, time, width_us), keys, ["series_start_us"])
    span_us = int(hours * 3_600_000_000)
    early = rows.where(F.col(US) < F.col("series_start_us") + span_us)
    sizes = early.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("start"), F.max(time).alias("end")
    )
    best = (
        sizes.where(F.col("rows") >= at_least)
        .groupBy(group)
        .agg(F.min_by(F.struct(series, "rows", "start", "end"), F.col(series)).alias("_best"))
        .select(group, "_best.*")
    )
    if groups is not None:
        found = {r[0] for r in best.where(F.col(group).isin(list(groups))).select(group).collect()}
        missing = [name for name in groups if name not in found]
        if missing:
            raise ValueError(f"no sufficiently long series for: {', '.join(missing)}")
        best = best.where(F.col(group).isin(list(groups)))
    chosen = early.join(best.select(*keys), keys, "left_semi")
    return chosen.drop(US, SLICE, SERIES_KEY, "series_start_us"), best


def group_split(
    df: DataFrame,
    series: str,
    *,
    test_fraction: float = 0.2,
    seed: int = 42,
    at_least: int | None = 3,
    flag: str = "is_test",
) -> DataFrame:
    """Mark whole series as test: ceil(fraction * series) of them, chosen by a seeded hash.

    Only ids are looked at: the digest of the last test id is found by counting ids per digest prefix
    and sorting the one prefix that holds it. Rows are marked by comparing their own hash with the last test hash, so
    they are neither joined nor shuffled.
    """
    digest = F.md5(F.concat_ws(":", F.col(series).cast("string"), F.lit(str(seed))))
    digests = stored(df.select(series).where(F.col(series).isNotNull()).distinct().select(digest.alias("_digest")))
    # Ids by the first three digits of their digest: at most 4096 rows, whatever the number of ids.
    prefix = F.substring("_digest", 1, 3)
    sizes = digests.groupBy(prefix.alias("p")).count().orderBy("p").collect()
    count = sum(r["count"] for r in sizes)
    if at_least is not None and count < at_least:
        raise ValueError(f"a split by series needs at least {at_least} series, got {count}")
    # Guard against 0.2 * 5 coming out a hair above 1 before rounding up.
    left = math.ceil(round(test_fraction * count, 9))
    last = None
    for r in sizes if left > 0 else []:
        if left <= r["count"]:
            share = digests.where(prefix == r["p"]).orderBy("_digest").limit(left)
            last = share.agg(F.max("_digest")).first()[0]
            break
        left -= r["count"]
    return df.withColumn(flag, digest <= F.lit(last) if last else F.lit(False))


def chronological_cut(rows: Column, train_fraction: float = 0.7) -> Column:
    """Training rows of a series: at least 30, and at least 20 left for the test."""
    return F.least(F.greatest(F.floor(rows * train_fraction), F.lit(30)), rows - 20)


def chronological_split(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    *,
    train_fraction: float = 0.7,
    at_least: int = 60,
    tiebreak: Sequence[str] = (),
    width_us: int | None = None,
    flag: str = "is_test",
) -> DataFrame:
    """Mark the later part of every series as test; series below ``at_least`` rows drop out."""
    rows = ranked(df, series, time, tiebreak=tiebreak, width_us=width_us, rank="_rn")
    return (
        rows.where(F.col("series_rows") >= at_least)
        .withColumn(flag, F.col("_rn") > chronological_cut(F.col("series_rows"), train_fraction))
        .drop("_rn", "series_rows")
    )


def day_split(df: DataFrame, day: str, *, train_fraction: float = 0.78, flag: str = "is_test") -> DataFrame:
    """Mark rows after day max(1, int(fraction * last day)); the last day is a scalar subquery."""
    last = df.agg(F.max(day).alias("_last"))
    cut = last.select(F.greatest(F.lit(1), F.floor(F.col("_last") * train_fraction))).scalar()
    return df.withColumn(flag, F.col(day) > cut)
