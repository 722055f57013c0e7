"""Derivative WARC records: metadata and plain-text conversions that refer to their responses.

A page is cut at its markup once, by one pattern; its title, links and text come from the pieces. Records are
put together in built-in functions. A record's identifier follows from what it is made from, so a lost task makes
the same records again.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucospan.llm import chars

#: Elements whose tags end a line of text, and those without text of their own.
BLOCKS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|"
    "hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
)
SILENT = ("script", "style", "noscript", "template")
#: What follows a tag's name: a quoted value begins after an equals sign alone and may hold any sign.
_REST = r"""(?:[^>=]++|=[ \t\r\n\f]*+(?:"[^"]*+"|'[^']*+')?+)*+(?:>|\Z)"""
_EDGE = r"(?=[ \t\r\n\f/>]|\Z)"
#: One piece of markup. What is not closed reaches to the end of the page, so that a page is read once.
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)"
    rf"|<(?P<silent>{'|'.join(SILENT)}){_EDGE}{_REST}.*?(?:</(?P=silent){_EDGE}[^>]*+(?:>|\Z)|\Z)"
    rf"|<title{_EDGE}{_REST}(?P<title>.*?)(?:</title{_EDGE}[^>]*+(?:>|\Z)|\Z)"
    rf"|</?(?P<name>[A-Za-z][^ \t\r\n\f/>]*+)(?P<rest>{_REST})"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
BLOCK = re.compile(f"(?:{BLOCKS})", re.I)
ATTRIBUTE = re.compile(
    r"""([^ \t\r\n\f/>=]+)[ \t\r\n\f]*(?:=[ \t\r\n\f]*(?:"([^"]*)"|'([^']*)'|([^ \t\r\n\f>]*)))?"""
)
#: References in attributes: without their semicolon they end where no letter, digit or equals sign follows.
IN_VALUE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9])))")
SPACE = re.compile(r"[ \t\r\n\f]+")
END = "\r\n"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out a single time, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def base32(hexadecimal: Column) -> Column:
    """The base-32 spelling of 40 hexadecimal digits, as WARC digests have it."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), once(F.sha1(text.cast("binary")), base32))


def identifier(*parts: Column) -> Column:
    """A record identifier made from the parts."""
    places = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    whole = F.md5(F.concat_ws("\u001f", *parts))
    cut = once(whole, lambda h: F.concat_ws("-", *(F.substring(h, at, n) for at, n in places)))
    return F.concat(F.lit("<urn:uuid:"), cut, F.lit(">"))


def _link(rest: str) -> str | None:
    """The first href among a tag's attributes, as an address: no white space around it, no line breaks in it."""
    for name, double, single, bare in ATTRIBUTE.findall(rest):
        if name.lower() == "href":
            value = double or single or bare
            if "&" in value:
                value = IN_VALUE.sub(lambda m: html.unescape(m[0]), value)
            return re.sub("[\t\r\n]+", "", value.strip(" \t\r\n\f"))
    return None


def extract(page: str) -> tuple[str, list[str], str]:
    """The title, the links in their order and the visible text of a page.

    The text has a line for each block element, single spaces and no empty lines. Scripts, styles, templates and
    comments have no text, also where they are not closed. Character references are replaced once.
    """
    title, links, parts, at = None, [], [], 0

    def add(text: str) -> None:
        text = SPACE.sub(" ", text)
        parts.append(html.unescape(text) if "&" in text else text)

    for mark in MARKUP.finditer(page):
        if mark.start() > at:
            add(page[at : mark.start()])
        at = mark.end()
        if name := mark["name"]:
            if BLOCK.fullmatch(name):
                parts.append("\n")
            elif name in ("a", "A") and page[mark.start() + 1] != "/" and (link := _link(mark["rest"])) is not None:
                links.append(link)
        elif (own := mark["title"]) is not None:
            title = own if title is None else title
            parts.append("\n")
            add(own)
            parts.append("\n")
        else:
            parts.append(" ")
    add(page[at:])
    lines = (SPACE.sub(" ", line).strip(" ") for line in "".join(parts).split("\n"))
    title = SPACE.sub(" ", html.unescape(title or ""))
    return title, links, "\n".join(line for line in lines if line)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with (title, links, text) instead of their last column, the payload."""
    for batch in batches:
        made = [extract(page or "") for page in chars.values(batch.column(batch.num_columns - 1))]
        columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.list_(pa.string()), pa.string()))]
        names = [*batch.schema.names[:-1], "title", "links", "text"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records (key, record_id, target_uri, date, http, payload, payload_digest) of pages (page_id, url, html).

    A null page counts as an empty payload; a null address stays null. Repeated pages give the same record again.
    """
    html = F.coalesce("html", F.lit(""))
    length = F.octet_length(html).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), length, F.lit(END))
    return pages.select(
        F.col("page_id").alias("key"),
        identifier(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.md5(html)).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        http.alias("http"),
        html.alias("payload"),
        digest(html).alias("payload_digest"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response: its metadata and its plain text, both with ``refers_to`` its identifier.

    Columns key, warc_type, record_id, refers_to, target_uri, date, content_type, content_length, source_digest,
    block_digest, header, block. The metadata block keeps the response's header lines and digest, and adds title and
    links in their order; a conversion's block is the text. ``records``: as ``responses`` makes them; other columns
    are ignored, nulls count as empty, a null target leaves its header line out.
    """
    named = ["key", "record_id", "target_uri", "date", "http", "payload_digest"]
    r = records.select(*named, F.col("payload").cast("string"))
    schema = ", ".join(f"{n} {records.schema[n].dataType.simpleString()}" for n in named)
    r = r.mapInArrow(_extracted, f"{schema}, title string, links array<string>, text string")
    http = F.coalesce("http", F.lit(""))
    links = F.transform("links", lambda x: F.concat(F.lit("outlink: "), x, F.lit(f" L a/@href{END}")))
    kept = F.regexp_replace(F.regexp_replace(http, "(\\r\\n)+$", ""), "(^|\\r\\n)", "$1source-http: ")
    metadata = F.concat(
        kept, F.lit(f"{END}source-payload-digest: "), F.coalesce("payload_digest", F.lit("")),
        F.lit(f"{END}title: "), F.col("title"), F.lit(END), F.array_join(links, ""),
    )

    def record(kind: str, content: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), F.lit(content).alias("content_type"), block.alias("block"))

    made = F.array(
        record("metadata", "application/warc-fields", metadata),
        record("conversion", "text/plain", F.col("text")),
    )
    each = r.withColumn("_made", F.explode(made)).select("*", "_made.*").drop("_made")
    each = each.withColumns(
        {
            "refers_to": F.col("record_id"),
            "record_id": identifier(F.col("warc_type"), F.col("record_id")),
            "content_length": F.octet_length("block").cast("long"),
            "source_digest": F.col("payload_digest"),
            "block_digest": digest(F.col("block")),
        }
    )
    lines = [
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    ]
    header = F.concat_ws(END, F.lit("WARC/1.0"), *(F.concat(F.lit(f"{name}: "), value) for name, value in lines))
    return each.withColumn("header", header).select(
        "key", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length",
        "source_digest", "block_digest", "header", "block",
    )


def write(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC files, one for each partition."""
    whole = F.concat("header", F.lit(END * 2), "block").alias("value")
    records.select(whole).write.option("lineSep", END * 2).option("compression", "gzip").text(path)
