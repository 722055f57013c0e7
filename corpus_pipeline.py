"""A corpus pipeline: toxic texts go, one of each group of near copies stays, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glucospan.llm import jaccard, packing, queries, secrets, toxicity
from glucospan.storage import stored


def others(docs: DataFrame) -> Column:
    """A row's columns but the text in one struct, out of the way of any name that a stage adds."""
    return F.struct(*(F.col(f"`{name}`") for name in docs.columns if name != "text")).alias("row")


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``row`` and ``text``."""
    return rows.select(*(F.col("text") if n == "text" else F.col("row").getField(n).alias(n) for n in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half.

    A null text counts as empty, and empty texts stay, as do rows without an id. Repeated rows are judged alike;
    extra columns come back as they were, whatever their names; an empty table stays empty.
    """
    labels = queries.taught(spark, sf_dir)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    rows = toxicity.scored(docs.select(others(docs), "text"), model)
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    return restored(rows.filter((F.col("score") < 0.5) | empty), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id, rows without id last.

    Texts with words are grouped by the n-gram join, rows without id too; equal texts without words, such as lines
    of signs, are copies of each other. Null, empty and blank texts stay. Extra columns come back as they were,
    whatever their names; an empty table stays empty.
    """
    wordless = ~F.col("text").rlike("[\\p{L}\\p{M}\\p{N}]") & (F.trim("text") != "")
    same = F.when(wordless, F.md5("text")).alias("same")
    rows = stored(docs.select(others(docs), "text", same, F.monotonically_increasing_id().alias("number")))
    groups = jaccard.similar(rows.select(F.col("number").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("number"), F.col("class_id").cast("string").alias("class"))
    placed = rows.select("number", "row.doc_id", "same").join(groups, "number")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("number")))
    kept = placed.groupBy(F.coalesce("same", "class").alias("class")).agg(first.alias("first")).select("first.number")
    return restored(rows.join(kept, "number", "left_semi"), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced.

    A column ``n_chars``, if there is one, follows the text where it changes. Null and empty texts stay as they are,
    repeated rows are masked alike; other columns come back as they were, whatever their names.
    """
    if "n_chars" not in docs.columns:
        return secrets.redacted(docs, *queries.learnt_secrets(spark, sf_dir, docs))
    # The mask is shorter or longer than what it replaces, so a change of length alone tells nothing: compare digests.
    rows = docs.select(others(docs), "text", F.xxhash64("text").alias("before"))
    rows = secrets.redacted(rows, *queries.learnt_secrets(spark, sf_dir, docs))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = F.xxhash64("text") != F.col("before")
    row = F.col("row").withField("n_chars", F.when(changed, length).otherwise(F.col("row.n_chars")))
    return restored(rows.withColumn("row", row), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 4096 tokens with their sequence and place in it.

    A null text counts as empty: one piece of the end id. Rows of one id are packed each for itself. Columns but the
    id and the text are left out; an empty table has no pieces.
    """
    pieces = packing.pieces(docs.select("doc_id", "text"), queries.WORD_BPE)
    pieces = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(pieces, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the learnt models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
