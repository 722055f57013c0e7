"""Nested health-record resources as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucospan.operators.slices import ranked

# Code systems, codes and units of a glucose observation. The code names an amount of
# substance while the unit is a mass; both are parameters because data may call for another pair.
CATEGORY_SYSTEM = "http://terminology.hl7.org/CodeSystem/observation-category"
CODE_SYSTEM = "http://loinc.org"
CODE, CODE_DISPLAY = "15074-8", "Glucose [Moles/volume] in Blood"
UNIT_SYSTEM, UNIT = "http://unitsofmeasure.org", "mg/dL"


def observation(
    time: Column,
    value: Column,
    *,
    subject: Column | str = "Patient/virtual-patient",
    text: str = "Simulated glucose",
    note: str = "Synthetic observation; not a clinical measurement.",
    code: str = CODE,
    display: str = CODE_DISPLAY,
    unit: str = UNIT,
) -> Column:
    """An Observation struct; the value is rounded half-even to one place, the time is UTC."""

    def named(**fields) -> Column:
        return F.struct(*[
            (c if isinstance(c, Column) else F.lit(c)).alias(name) for name, c in fields.items()
        ])

    category = named(system=CATEGORY_SYSTEM, code="laboratory", display="Laboratory")
    coding = named(system=CODE_SYSTEM, code=code, display=display)
    return named(
        resourceType="Observation",
        status="final",
        category=F.array(named(coding=F.array(category))),
        code=named(coding=F.array(coding), text=text),
        subject=named(reference=subject),
        effectiveDateTime=utc_text(time),
        valueQuantity=named(value=F.bround(value, 1), unit=unit, system=UNIT_SYSTEM, code=unit),
        note=F.array(named(text=note)),
    )


def utc_text(time: Column) -> Column:
    """``2025-01-01T00:00:00+00:00``; a zone-less time counts as UTC, whatever the session's zone."""
    zoned = F.to_utc_timestamp(time.cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    clock = F.when(F.typeof(time) == "timestamp", zoned).otherwise(time.cast("timestamp_ntz")).cast("string")
    return F.concat(F.replace(F.substring(clock, 1, 19), F.lit(" "), F.lit("T")), F.lit("+00:00"))


def observations(df: DataFrame, series: str, time: str, value: str, **options) -> DataFrame:
    """One JSON resource per sample, built row by row without a shuffle."""
    resource = F.to_json(observation(F.col(time), F.col(value), **options))
    return df.select(series, time, resource.alias("resource"))


def sample_time(start: Column, minute: Column) -> Column:
    """Time of a sample given as whole minutes since ``start``."""
    return start + F.make_dt_interval(mins=minute.cast("int"))


def bundles(
    df: DataFrame,
    series: str,
    time: str,
    value: str,
    *,
    entries_per_bundle: int,
    width_us: int | None = None,
    tag: str = "Synthetic educational data",
    **options,
) -> DataFrame:
    """Collection bundles of a series in time order, as many as it needs.

    A bundle is one row, so its size has to be bounded by the caller: a longer series continues in the
    next ``page``, and no observation is left out. Each page tells the ``total`` of the series and
    links to itself and to the next page.
    """
    placed = ranked(df, [series], time, width_us=width_us, rank="_rn")
    page = F.floor((F.col("_rn") - 1) / entries_per_bundle).alias("page")
    entry = F.struct(
        F.col("_rn").alias("at"), F.struct(observation(F.col(time), F.col(value), **options).alias("resource")).alias("e")
    )
    collected = placed.select(series, page, "series_rows", entry.alias("_entry")).groupBy(series, "page").agg(
        F.array_sort(F.collect_list("_entry")).alias("_entries"), F.max("series_rows").alias("_total")
    )

    def link(relation: str, number: Column) -> Column:
        return F.struct(F.lit(relation).alias("relation"), F.concat(F.lit("page="), number).alias("url"))

    more = (F.col("page") + 1) * entries_per_bundle < F.col("_total")
    links = F.array(link("self", F.col("page")), F.when(more, link("next", F.col("page") + 1)))
    bundle = F.struct(
        F.lit("Bundle").alias("resourceType"),
        F.lit("collection").alias("type"),
        F.col("_total").alias("total"),
        F.array_compact(links).alias("link"),
        F.transform("_entries", lambda x: x["e"]).alias("entry"),
        F.struct(F.array(F.struct(F.lit(tag).alias("display"))).alias("tag")).alias("meta"),
    )
    return collected.select(
        series, "page", F.size("_entries").alias("entries"), F.to_json(bundle).alias("bundle")
    )
