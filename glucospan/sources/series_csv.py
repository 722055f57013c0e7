"""Per-person CSV series and the static attribute file, as text and then as typed rows."""

from __future__ import annotations

import csv
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glucospan.functions.text import is_event, numeric_clean, pad_id, parse_timestamp
from glucospan.operators.joins import attach_by_position, id_key, last_per_key
from glucospan.schema import SERIES, TIME
from glucospan.storage import stored

# A name, a dash and a three-digit id, in any letter case.
SERIES_FILE = r"(?i)[a-z]+-(\d{3})\.csv$"

# Logical columns and the header spellings that carry them, first present wins.
SERIES_COLUMNS = {
    "timestamp_text": ["Timestamp"],
    "dexcom": ["Dexcom GL"],
    "libre": ["Libre GL"],
    "heart_rate": ["HR"],
    "mets": ["METs", "Mets"],
    "activity_calories": ["Calories (Activity)"],
    "meal_type": ["Meal Type"],
    "carbs": ["Carbs"],
    "protein": ["Protein"],
    "fat": ["Fat"],
    "fiber": ["Fiber"],
}
STATIC_ID_COLUMNS = ["Participant", "Participant ID", "Subject", "Subject ID", "ID", "sub"]
STATIC_COLUMNS = {
    "age": ["Age"],
    "bmi": ["BMI"],
    "hba1c": ["A1c PDL (Lab)", "A1c"],
    "fasting_glucose": ["Fasting GLU - PDL (Lab)", "Fasting BG"],
    "fasting_insulin": ["Insulin"],
}
# Cell texts that mean "missing".
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

POSITION = ["_block", "_row"]


@dataclass(frozen=True)
class Layout:
    """A header line, its column names, how many files share it, and one of them."""

    line: str
    names: list[str]
    files: int
    example: str


def series_files(spark: SparkSession, root: str, pattern: str = SERIES_FILE) -> DataFrame:
    """Paths and ids of the series files below ``root``, ordered by id. Contents are not read."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        _files(spark, root, "*-*.csv")
        .withColumn(SERIES, F.regexp_extract(name, pattern, 1))
        .where(F.col(SERIES) != "")
        .orderBy(SERIES)
    )


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path")
    )


def text_lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Records below ``root`` with their file and their position in it, from a text scan. Spark opens
    the files, so any file system it knows will do."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
            "value",
        )
    )
    return whole_records(lines)


def whole_records(lines: DataFrame) -> DataFrame:
    """Lines (``_file``, ``_block``, ``_row``, ``value``) joined where a quoted cell holds line breaks; blank records go.

    A line begins a record if the quotes before it in its file are even in number. Parities add up: over the lines
    of a block, over the blocks of a file, so neither a file nor a record has to lie in one split. Only files with
    a line of odd parity are shuffled. A file whose quotes do not close cannot be joined: its lines stay as
    they are, with a warning.
    """
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2
    counted = lines.groupBy("_file").agg(F.max(odd).alias("most"), F.sum(odd).alias("sum")).where("most > 0")
    files = stored(counted.select("_file", (F.col("sum") % 2 == 0).alias("_closed")))
    broken = files.where("_closed").select("_file")
    for row in files.where("not _closed").agg(F.count(F.lit(1)).alias("n"), F.min("_file").alias("example")).collect():
        if row["n"]:
            warnings.warn(f"unclosed quotes in {row['n']} files like {row['example']}", stacklevel=2)
    nonblank = F.trim("value") != ""
    if broken.isEmpty():
        return lines.where(nonblank)
    plain = lines.join(broken, "_file", "left_anti")
    cut = lines.join(broken, "_file", "left_semi").withColumn("_odd", odd)
    before = Window.partitionBy("_file", "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_inside", F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2)
    # Per block: its parity, and how many lines begin a record if the quotes before the block are even or odd.
    blocks = cut.groupBy("_file", "_block").agg(
        F.sum("_odd").alias("odd"), F.sum(1 - F.col("_inside")).alias("even_starts"), F.sum("_inside").alias("odd_starts")
    )
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_turned", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("_turned") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    blocks = blocks.withColumn("_begun", F.coalesce(F.sum(starts).over(earlier), F.lit(0)))
    placed = cut.join(blocks.select("_file", "_block", "_turned", "_begun"), ["_file", "_block"])
    begins = F.when(F.col("_inside") == F.col("_turned"), 1).otherwise(0)
    upto = Window.partitionBy("_file", "_block").orderBy("_row")
    placed = placed.withColumn("_record", F.col("_begun") + F.sum(begins).over(upto))
    parts = F.sort_array(F.collect_list(F.struct("_block", "_row", "value")))  # the lines of one record
    joined = placed.groupBy("_file", "_record").agg(parts.alias("parts")).select(
        "_file", F.col("parts")[0]["_block"].alias("_block"), F.col("parts")[0]["_row"].alias("_row"),
        F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value"),
    )
    return plain.unionByName(joined).where(nonblank)


def file_headers(lines: DataFrame) -> DataFrame:
    """The first line of each file, stored: one row per file."""
    first = F.min_by("value", F.struct(*POSITION))
    return stored(lines.where(F.col("_block") == 0).groupBy("_file").agg(first.alias("_header")))


def layouts(headers: DataFrame) -> list[Layout]:
    """The different header lines. Only these reach the driver, not the files that use them."""
    shared = headers.groupBy("_header").agg(F.count(F.lit(1)).alias("files"), F.min("_file").alias("example"))
    found = []
    for row in shared.orderBy("_header").collect():
        names = next(csv.reader([row["_header"].lstrip("\ufeff")]))
        found.append(Layout(row["_header"], [n.strip() for n in names], row["files"], row["example"]))
    return found


def split_lines(
    lines: DataFrame, headers: DataFrame, found: Sequence[Layout], columns: dict[str, Sequence[str]]
) -> DataFrame:
    """Data lines cut into logical columns of text, by the header of their own file.

    Of the spellings of a column the first that a header has is used, by presence and not by content.
    Each file finds its layout by a join with the table of files; lines of other layouts drop out.
    """
    width = max(len(x.names) for x in found)
    known = F.lit(None).cast("int")
    for i, layout in enumerate(found):
        known = F.when(F.col("_header") == layout.line, i).otherwise(known)
    files = headers.select("_file", known.alias("_layout")).where("_layout is not null")
    schema = ", ".join(f"c{i} string" for i in range(width))
    is_header = F.lit(False)
    for i, layout in enumerate(found):
        is_header = F.when(F.col("_layout") == i, F.col("value") == layout.line).otherwise(is_header)
    cells = lines.join(files, "_file").where(~is_header).withColumn("_cells", F.from_csv("value", schema, {"escape": '"', "multiLine": "true"}))

    def column(spellings: Sequence[str]) -> Column:
        chosen = F.lit(None).cast("string")
        for i, layout in enumerate(found):
            at = next((layout.names.index(n) for n in spellings if n in layout.names), None)
            if at is not None:
                chosen = F.when(F.col("_layout") == i, F.col("_cells")[f"c{at}"]).otherwise(chosen)
        return F.when(~chosen.isin(MISSING_TEXTS), chosen)

    return cells.select("_file", *POSITION, *[column(s).alias(n) for n, s in columns.items()])


def series_text(lines: DataFrame, pattern: str = SERIES_FILE, *, strict: bool = True) -> DataFrame:
    """Lines of series files (``_file``, ``_block``, ``_row``, ``value``) as text in logical columns.

    A file without a timestamp column is an error, or left out when not ``strict``.
    """
    name = F.regexp_extract("_file", pattern, 1)
    lines = lines.where(name != "")
    headers = file_headers(lines)
    found = layouts(headers)
    if not found:
        raise FileNotFoundError("no series files")
    untimed = [x for x in found if SERIES_COLUMNS["timestamp_text"][0] not in x.names]
    for layout in untimed:
        told = f"no Timestamp column in {layout.files} files like {layout.example}"
        if strict:
            raise ValueError(told)
        warnings.warn(f"left out: {told}", stacklevel=2)
    usable = [x for x in found if x not in untimed]
    if not usable:
        raise ValueError("no series file has a Timestamp column")
    return split_lines(lines, headers, usable, SERIES_COLUMNS).select(
        name.alias(SERIES), *SERIES_COLUMNS, *POSITION
    )


def read_series_text(
    spark: SparkSession, root: str, pattern: str = SERIES_FILE, *, strict: bool = True
) -> DataFrame:
    """All series files below ``root`` as text in logical columns, one frame."""
    return series_text(text_lines(spark, root, "*-*.csv"), pattern, strict=strict)


def typed_series(text: DataFrame) -> DataFrame:
    """Numbers cleaned, timestamps parsed, events marked; rows without a time stay (time NULL)."""
    numbers = [n for n in SERIES_COLUMNS if n not in ("timestamp_text", "meal_type")]
    return text.select(
        SERIES,
        parse_timestamp(F.col("timestamp_text")).alias(TIME),
        *[numeric_clean(F.col(n)).alias(n) for n in numbers],
        is_event(F.col("meal_type"), numeric_clean(F.col("carbs"))).alias("is_event"),
        *POSITION,
    )


def read_series(spark: SparkSession, root: str, pattern: str = SERIES_FILE, *, strict: bool = True) -> DataFrame:
    return typed_series(read_series_text(spark, root, pattern, strict=strict))


def read_static(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """One row of static attributes per id in ``ids``; NULL where the file has none.

    Rows are matched by an id column if there is one (the last row of an id wins), otherwise the
    n-th row belongs to the n-th id in sorted order.
    """
    ids = ids.select(SERIES).distinct()
    lines = text_lines(spark, root, "bio.csv")
    headers = file_headers(lines)
    found = sorted(layouts(headers), key=lambda x: x.example)[:1]
    if not found:
        return ids.select(SERIES, *[F.lit(None).cast("double").alias(n) for n in STATIC_COLUMNS])
    (layout,) = found
    id_name = next((n for n in STATIC_ID_COLUMNS if n in layout.names), None)
    columns = STATIC_COLUMNS | ({"_id": [id_name]} if id_name else {})
    # Of several such files the first by path counts.
    text = split_lines(lines.where(F.col("_file") == layout.example), headers, found, columns)
    values = [numeric_clean(F.col(n)).alias(n) for n in STATIC_COLUMNS]
    if id_name is None:
        placed = attach_by_position(ids, text.select(*values, *POSITION), SERIES, POSITION)
        return placed.drop(*POSITION)
    keyed = text.select(id_key(F.col("_id")).alias(SERIES), *values, *POSITION)
    return ids.join(last_per_key(keyed, SERIES, POSITION).drop(*POSITION), SERIES, "left")


def valid_rows(text: DataFrame, series: str, time: str, value: str) -> DataFrame:
    """Keep rows whose id, time and value are all usable; ids padded, times and values typed."""
    number = F.trim(F.col(value).cast("string")).try_cast("double")
    typed = text.withColumns(
        {
            series: pad_id(F.nullif(F.trim(F.col(series).cast("string")), F.lit(""))),
            time: F.trim(F.col(time).cast("string")).try_cast("timestamp_ntz"),
            value: F.when(~F.isnan(number), number),
        }
    )
    return typed.where(
        F.col(series).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull()
    )


def first_readable(spark: SparkSession, candidates: Sequence[tuple[str, str]], **options) -> DataFrame | None:
    """The first existing table of (mode, path) pairs with its mode as a column; None if none exists.

    Paths ending in csv or csv.gz are CSV with a header, everything else is Parquet.
    """
    from pyspark.errors import AnalysisException

    for mode, path in candidates:
        as_csv = path.endswith((".csv", ".csv.gz"))
        reader = spark.read.options(header=True, **options) if as_csv else spark.read.options(**options)
        try:
            table = reader.csv(path) if as_csv else reader.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        return table.withColumn("data_mode", F.lit(mode))
    return None


def timestamp_examples(text: DataFrame, count: int = 8) -> DataFrame:
    return text.select("timestamp_text").where(F.col("timestamp_text").isNotNull()).limit(count)
