"""The training-data operators bound to the test tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucospan.llm import alignment, ann, bpe, jaccard, licenses, negatives, packing, records, secrets, sharding, topk
from glucospan.llm import toxicity, warc
from glucospan.storage import fresh_folder, stored

QUERIES = {}
#: DuckDB twins of the queries that SQL can express.
ORACLE: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def taught(spark: SparkSession, folder: str) -> DataFrame:
    """The labels (doc_id, toxic) to learn from: where the id's CRC-32 is not divisible by five."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


@query
def op1_histogram_sort(spark, folder):
    """All documents in 40 shards of equal bytes, equal texts beside each other."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    # Texts by digest, copies by id.
    key = F.concat(
        F.coalesce(F.md5("text"), F.lit("0" * 32)), F.lpad(F.lower(F.hex(F.coalesce("doc_id", F.lit(0)))), 16, "0")
    )
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    placed = sharding.shards(documents, key, 48, size, 40)
    return placed.select(
        "doc_id", "size", F.crc32("text").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def learnt_secrets(spark: SparkSession, folder: str, documents: DataFrame) -> tuple[str, list[str]]:
    """A forest from the documents' own findings, and the benchmark's words as dictionary."""
    known = secrets.dictionary(table(spark, folder, "benchmark"), "text")
    return secrets.learnt(documents, known), known


@query
def op3_forest_secrets(spark, folder):
    """Every candidate of every document with the forest's judgement."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    rows = secrets.judged(documents, *learnt_secrets(spark, folder, documents))
    each = rows.select("doc_id", F.explode("findings").alias("x"))
    return each.select(
        "doc_id",
        "x.word",
        F.length("x.value").alias("length"),
        F.sha2("x.value", 256).alias("value_sha256"),
        "x.score",
        (F.col("x.score") >= secrets.Settings().threshold).alias("is_secret"),
    )


@query
def op4_min_bin_slack(spark, folder):
    """Every document's pieces of at most 4096 tokens and their places in packed sequences."""
    pieces = packing.pieces(table(spark, folder, "documents"), WORD_BPE)
    pieces = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(pieces, ["doc_id", "piece"])


@query
def op7_byte_level_bpe(spark, folder):
    """Every document's ids and the bytes that they decode to, as digests."""
    encoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), BYTE_BPE)
    return bpe.digests(encoded.select("doc_id", "n_tokens", "ids"), BYTE_BPE).drop("ids")


@query
def op2_pivot_index(spark, folder):
    """The 20 greatest integer inner products of every twentieth vector, exactly."""
    return topk.greatest_products(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


@query
def op9_hilbert_curves(spark, folder):
    """The 10 nearest found for every hundredth vector."""
    return ann.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


@query
def op10_ftrl_toxicity(spark, folder):
    """The toxicity of every document, learnt without the held-out fifth."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    rows = toxicity.scored(documents, toxicity.fit(documents, taught(spark, folder)))
    return rows.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op5_bayes_jaccard(spark, folder):
    """Each document's group of near copies and number of links: Jaccard of five-word n-grams from 0.8."""
    return jaccard.similar(table(spark, folder, "documents").select("doc_id", "text"))


ORACLE["op5_bayes_jaccard"] = r"""
    WITH RECURSIVE word AS (
        SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
    ), gram AS (
        SELECT DISTINCT doc_id, hash(g) AS g FROM (
            SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [w]
                ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g
            FROM word WHERE len(w) > 0
        )
    ), size AS (
        SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id
    ), pair AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY ALL
    ), link AS (
        SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
        WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9
    ), reach AS (
        SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
    )
    SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id)) AS class_id,
        (SELECT count(*) FROM link WHERE a = d.doc_id) AS n_links
    FROM documents d
"""


@query
def op6_warc_derivatives(spark, folder):
    """Metadata and plain-text records of all pages."""
    found = warc.responses(table(spark, folder, "pages"), "2025-01-01T00:00:00Z")
    return warc.derivatives(found).withColumnRenamed("key", "page_id")


@query
def op8_winnowed_licenses(spark, folder):
    """The licence notices of all documents."""
    return licenses.scan(table(spark, folder, "documents"), "doc_id")


@query
def op11_record_files(spark, folder):
    """Every document's ids written to record files in order of the ids, read back through the offset index."""
    place = fresh_folder(spark)
    records.write(table(spark, folder, "documents"), place, WORD_BPE)
    rows = records.read(spark, place)
    return rows.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op12_galloping_alignment(spark, folder):
    """How the tokens of two tokenizers overlap in every document."""
    return alignment.linked(table(spark, folder, "documents"), BYTE_LEVEL, PIECES)


@query
def op13_lemp_negatives(spark, folder):
    """The hardest negatives of every hundredth vector and its five positives; every seventh label is moved on."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return negatives.hard_negatives(rows, "vec_id", "embedding", "label", F.col("id") % 100 == 0)


ORACLE["op13_lemp_negatives"] = """
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
        FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
    ), p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY rank <= 5
"""


def _duck_text(text: str) -> str:
    return text.replace("\\", "\\").replace("'", "''")


#: The twin's own patterns, for pages as the tables hold them: closed markup, double quotes, few references.
WARC_NAMED = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
WARC_LINK = '(?is)<a[ \\t\\r\\n][^>]*?href="([^"]*)"'
WARC_TITLE = "(?is)<title[^>]*>(.*?)</title>"
WARC_COMMENT = "(?s)<!--.*?-->"
WARC_QUIET = "(?is)" + "|".join(f"<{t}[ >].*?</{t}>" for t in warc.SILENT)
WARC_BREAK = f"(?i)</?(?:{warc.BLOCKS})(?:[ /\\t\\r\\n][^>]*)?>"
WARC_TAG = "</?[A-Za-z][^>]*>|<![^>]*>"


def _duck_characters(column: str) -> str:
    for name, char in WARC_NAMED:
        column = f"replace({column}, '{name}', '{_duck_text(char)}')"
    return column


def _duck_digest(column: str) -> str:
    h = f"sha1({column})"
    parts = " || ".join(f"to_base(('0x' || {h}[{a}:{a + 9}])::BIGINT, 32, 8)" for a in (1, 11, 21, 31))
    return f"'sha1:' || translate(upper({parts}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


def _duck_identifier(*parts: str) -> str:
    h = f"md5(concat_ws(chr(31), {', '.join(parts)}))"
    return f"'<urn:uuid:' || concat_ws('-', {h}[1:8], {h}[9:12], {h}[13:16], {h}[17:20], {h}[21:32]) || '>'"


def _duck_replace(column: str, pattern: str, by: str) -> str:
    return f"regexp_replace({column}, '{_duck_text(pattern)}', {by}, 'g')"


def _warc_sql() -> str:
    line = "chr(10)"
    end = "chr(13) || chr(10)"
    blank = "[ \\t\\r\\n\\f]+"
    text = _duck_replace(_duck_replace("payload", WARC_COMMENT, "' '"), WARC_QUIET, "' '")
    text = _duck_replace(_duck_replace(_duck_replace(text, blank, "' '"), WARC_BREAK, line), WARC_TAG, "''")
    chars = _duck_characters("stripped")
    plain = _duck_replace(_duck_replace("called", "[ \\t\\r\\f]+", "' '"), "[ \\n]*\\n[ \\n]*", line)
    plain = _duck_replace(plain, "^[ \\n]+|[ \\n]+$", "''")
    title = _duck_replace(_duck_characters(f"regexp_extract(payload, '{_duck_text(WARC_TITLE)}', 1)"), blank, "' '")
    link = _duck_replace(_duck_characters("x"), "[\\r\\n]+", "' '")
    return f"""
    WITH page AS (
        SELECT page_id, url, coalesce(html, '') AS payload FROM pages
    ), response AS (
        SELECT page_id, url AS target_uri, payload, {_duck_digest("payload")} AS source_digest,
            {_duck_identifier("'response'", "coalesce(page_id::VARCHAR, '')", "coalesce(url, '')", "md5(payload)")} AS refers_to,
            ['HTTP/1.1 200 OK', 'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(payload)] AS http,
            {text} AS stripped
        FROM page
    ), called AS (
        SELECT *, {chars} AS called, {title} AS title,
            regexp_extract_all(payload, '{_duck_text(WARC_LINK)}', 1) AS link
        FROM response
    ), made AS (
        SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
            array_to_string(list_transform(http, lambda x: 'source-http: ' || x), {end}) || {end}
            || 'source-payload-digest: ' || source_digest || {end} || 'title: ' || title || {end}
            || array_to_string(list_transform(link, lambda x: 'outlink: ' || {link} || ' L a/@href' || {end}), '') AS block
        FROM called
        UNION ALL
        SELECT *, 'conversion', 'text/plain', {plain} FROM called
    ), named AS (
        SELECT *, {_duck_identifier("warc_type", "refers_to")} AS record_id, strlen(block)::BIGINT AS content_length,
            {_duck_digest("block")} AS block_digest, '2025-01-01T00:00:00Z' AS date
        FROM made
    )
    SELECT page_id, warc_type, record_id, refers_to, target_uri, date, content_type, content_length, source_digest,
        block_digest, concat_ws({end}, 'WARC/1.0', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id,
        'WARC-Refers-To: ' || refers_to, 'WARC-Target-URI: ' || target_uri, 'WARC-Date: ' || date,
        'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || content_type,
        'Content-Length: ' || content_length) AS header, block
    FROM named
    """


ORACLE["op6_warc_derivatives"] = _warc_sql()
