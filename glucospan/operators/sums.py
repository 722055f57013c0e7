"""Sums over trailing windows, by addition alone and at any density.

A difference of running sums leaves the rounding error of a large value in every later window, and
one NaN or infinity never goes away. Here a window (t - length, t] is put together from parts that
are only added. Time is cut into slices no longer than the shortest window; for a sample in slice s

* values of s up to the sample: a running sum;
* values of the slice in which the window begins, from there on: each value is sent ahead by the
  window length, where it marks its own end, and a running sum over descending time adds up what
  has not ended yet;
* values whose stay covers s from before its start to after its end: sums per slice, added up from both
  ends of blocks of slices.

Each row is sent once per different window length, whatever number of rows a window holds. The slice
width only moves work between tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucospan.operators.slices import SLICE, US, slice_of, sliced


def window_sums(
    rows: DataFrame,
    series: Sequence[str],
    time: str,
    sample: str,
    lengths: dict[str, int],
    width_us: int,
    tasks: int | None = None,
) -> DataFrame:
    """Every row whose ``sample`` struct is present, with two columns per name in ``lengths``.

    ``lengths`` maps a double column of ``rows`` to its window length in microseconds. The column is
    replaced by the sum of its values in (t - length, t], NULL without values, and ``<name>_n`` counts
    them. Values come from all rows, also from those without ``sample``. Rows without a time drop out.
    ``tasks`` is the number of partitions that rows are dealt over, or Spark's own choice.
    """
    width_us = min(width_us, *lengths.values())
    placed = sliced(rows, time, width_us).select(*series, SLICE, US, sample, *lengths)

    def counted(value: Column) -> Column:
        return value.isNotNull().cast("long")

    moved = placed.drop(SLICE).withColumn(
        "_ahead", F.explode(F.array(*[F.lit(x).cast("bigint") for x in [0, *sorted(set(lengths.values()))]]))
    )
    home = F.col("_ahead") == 0
    carried = {n: F.when(home | (F.col("_ahead") == lengths[n]), F.col(n)) for n in lengths}
    moved = (
        moved.withColumns(carried)
        .where(home | F.coalesce(*lengths).isNotNull())
        .select(
            *series,
            slice_of(F.col(US) + F.col("_ahead"), width_us).alias(SLICE),
            (F.col(US) + F.col("_ahead")).alias(US),
            home.alias("_home_row"),
            F.when(home, F.col(sample)).alias(sample),
            *lengths,
            *[counted(F.col(n)).alias(f"{n}_n") for n in lengths],
        )
    )
    both = moved.unionByName(_standing(placed, series, lengths, width_us, tasks), allowMissingColumns=True)
    if tasks:
        both = both.repartition(tasks, *series, SLICE)
    place = Window.partitionBy(*series, SLICE)
    begun = place.orderBy(US).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    lasting = place.orderBy(F.col(US).desc()).rangeBetween(Window.unboundedPreceding, -1)
    totals = {}
    for name in [*lengths, *[f"{n}_n" for n in lengths]]:
        inside = F.sum(F.when(F.col("_home_row"), F.col(name))).over(begun)
        sent = F.sum(F.when(~F.col("_home_row"), F.col(name))).over(lasting)
        totals[name] = F.coalesce(inside, F.lit(0)) + F.coalesce(sent, F.lit(0))
    done = both.withColumns({f"_total_{n}": c for n, c in totals.items()}).where(F.col(sample).isNotNull())
    return done.select(
        sample,
        *[F.when(F.col(f"_total_{n}_n") > 0, F.col(f"_total_{n}")).alias(n) for n in lengths],
        *[F.col(f"_total_{n}_n").alias(f"{n}_n") for n in lengths],
    )


def _standing(placed: DataFrame, series: Sequence[str], lengths: dict[str, int], width_us: int, tasks: int | None = None) -> DataFrame:
    """Per slice, at its start: sums of the values that began before it and end after it.

    A value of slice a ends in slice a + k or a + k + 1, where k is the number of whole slices in its
    window; it stands throughout the slices between. The k - 1 slices before a slice lie in at most two blocks of
    k - 1 slices: the end of one and the beginning of the next, running sums within a block from either side.
    So a slice costs the same whatever k is, and no task sees more of a series than a block.
    """
    columns = {c: n for n in lengths for c in (n, f"{n}_n")}
    counted = {c: F.col(n) if c == n else F.col(n).isNotNull().cast("long") for c, n in columns.items()}
    late = {n: slice_of(F.col(US) + length, width_us) > F.col(SLICE) + length // width_us for n, length in lengths.items()}
    table = placed.groupBy(*series, SLICE).agg(
        *[F.sum(v).alias(c) for c, v in counted.items()],
        *[F.sum(F.when(late[columns[c]], v)).alias(f"_late_{c}") for c, v in counted.items()],
    )

    def row(at: Column, block: Column | None, kind: int, values: dict[str, Column], target: bool) -> Column:
        """At ``at``, in running order (backwards for ends of blocks), some columns' values."""
        return F.struct(
            F.lit(kind).alias("_kind"),
            F.coalesce(block if block is not None else F.lit(None), at).cast("long").alias("_block"),
            (-at if kind % 3 == 2 else at).cast("long").alias("_order"),
            F.lit(target).alias("_target"),
            *[values.get(c, F.lit(None)).cast("long" if c != n else "double").alias(c) for c, n in columns.items()],
        )

    rows, s = [row(F.col(SLICE), None, 0, {}, True)], F.col(SLICE)
    for number, length in enumerate(sorted(set(lengths.values()))):
        k, own = length // width_us, [c for c, n in columns.items() if lengths[n] == length]
        rows.append(row(s + k, None, 0, {c: F.col(f"_late_{c}") for c in own}, False))
        if k > 1:
            size, sums = k - 1, {c: F.col(c) for c in own}
            begins, ends = 3 * number + 1, 3 * number + 2
            rows += [
                row(s + 1, slice_of(s, size), begins, sums, False),
                row(s, slice_of(s - 1, size), begins, {}, True),
                row(s + size, slice_of(s, size), ends, sums, False),
                # Where the slices before are exactly a block, its beginning is all of it.
                F.when(F.pmod(s, F.lit(size)) != 0, row(s, slice_of(s - size, size), ends, {}, True)),
            ]
    spread = table.select(*series, F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))
    if tasks:
        spread = spread.repartition(tasks, *series, "_kind", "_block")
    upto = Window.partitionBy(*series, "_kind", "_block").orderBy("_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = spread.withColumns({c: F.sum(c).over(upto) for c in columns}).where("_target")
    found = found.withColumn(SLICE, F.when(F.col("_kind") % 3 == 2, -F.col("_order")).otherwise(F.col("_order")))
    zero = {c: F.lit(0.0) if c == n else F.lit(0).cast("long") for c, n in columns.items()}
    summed = found.groupBy(*series, SLICE).agg(*[F.coalesce(F.sum(c), zero[c]).alias(c) for c in columns])
    return summed.select(
        *series,
        SLICE,
        (F.col(SLICE) * F.lit(width_us)).alias(US),
        F.lit(True).alias("_home_row"),
        *columns,
    )
