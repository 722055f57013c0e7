"""Static attributes per series, by id or by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucospan.functions.text import pad_id
from glucospan.operators.slices import global_rank


def id_key(text: Column) -> Column:
    """First run of one to three digits, zero-padded; NULL when there is none."""
    digits = F.regexp_extract(text.cast("string"), r"(\d{1,3})", 1)
    return F.when(digits != "", pad_id(digits))


def last_per_key(static: DataFrame, key: str, position: Sequence[str | Column]) -> DataFrame:
    """Keep the last row of each key by position, combined map-side."""
    rest = [name for name in static.columns if name != key]
    return (
        static.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*position)).alias("_last"))
        .select(key, "_last.*")
    )


def attach_static(rows: DataFrame, static: DataFrame, key: str, spread: int = 16) -> DataFrame:
    """Left join; unmatched series keep NULL attributes.

    The rows of a series are dealt over ``spread`` parts by a hash of their other columns, and each static
    row stands in all of them, so neither a hot series nor rows without an id meet in one task. No broadcast
    is forced: Spark broadcasts the static side when its size allows.
    """
    rest = [F.col(f"`{f.name}`") for f in rows.schema if f.name != key and not isinstance(f.dataType, T.MapType)]
    part = F.pmod(F.xxhash64(*rest) if rest else F.monotonically_increasing_id(), F.lit(spread)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    names = [*rows.columns, *[n for n in static.columns if n != key]]
    joined = rows.withColumn("_spread_part", part).join(static.withColumn("_spread_part", parts), [key, "_spread_part"], "left")
    return joined.select(*(F.col(f"`{n}`") for n in names))


def attach_by_position(
    ids: DataFrame,
    static: DataFrame,
    key: str,
    position: Sequence[str | Column],
) -> DataFrame:
    """The n-th id in sorted order gets the n-th static row; surplus rows on either side are unused
    (ids without a row keep NULL attributes)."""
    left = global_rank(ids.select(key).distinct(), [key], "_position")
    right = global_rank(static, position, "_position")
    return left.join(right, "_position", "left").drop("_position")
