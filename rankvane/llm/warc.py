"""WARC derivative builder: metadata and conversion records from response records.

A row in and two rows out, without a shuffle.  The text of a page is made by a
small helper in Arrow batches; everything else is DataFrame functions.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: element names whose ends break a line
BREAKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
#: what goes from a page, and what stands for it; each is linear: what isn't closed goes to
#: the end of the page, and a tag ends before the next one begins
STEPS = (
    (r"(?s)<!--.*?(?:-->|\Z)", ""),
    (r"(?is)<script(?:[ \t\r\n/][^<>]*)?>.*?(?:</script[^<>]*>|\Z)", ""),
    (r"(?is)<style(?:[ \t\r\n/][^<>]*)?>.*?(?:</style[^<>]*>|\Z)", ""),
    (rf"(?i)</?(?:{BREAKS})(?:[ \t\r\n/][^<>]*)?>", "\n"),
    (r"<[A-Za-z/!][^<>]*>", ""),
)
_STEPS = [(re.compile(pattern), new) for pattern, new in STEPS]
#: runs that are more than one space, and lines that are empty or begin with a space
_SPACES, _LINES = re.compile(r"[\t\r\x0b\x0c][ \t\r\x0b\x0c]*| [ \t\r\x0b\x0c]+"), re.compile(r"\n[ \n]+")


def uuid_of(text: Column) -> Column:
    """A stable urn:uuid from the SHA-1 of a string."""
    h = F.sha1(text)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(text))


def text_of(page: str) -> str:
    """The text of a page: no comments, scripts, styles and tags; character references
    decoded; one line for each block element, spaces collapsed, empty lines left out."""
    for pattern, new in _STEPS:
        page = pattern.sub(new, page)
    page = html.unescape(page)
    return _LINES.sub("\n", _SPACES.sub(" ", page).replace(" \n", "\n")).strip(" \n")


def plain_text(payload: Column) -> Column:
    """text_of() each payload."""

    @F.arrow_udf("string")
    def apply(pages: pa.Array) -> pa.Array:
        return pa.array([text_of(page.as_py() or "") for page in pages], pa.string())

    return apply(payload)


def responses(pages: DataFrame) -> DataFrame:
    """Response records for fetched pages: page_id, record_id, target_uri, http_headers, payload.

    A null url is an empty one, a null page has an empty payload.  The record's id is
    made of page_id and url, so rows that repeat both share it.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return pages.select(
        "page_id",
        uuid_of(F.concat(F.lit("response "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), url)).alias("record_id"),
        url.alias("target_uri"),
        head.alias("http_headers"),
        body.alias("payload"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response record, linked to it by refers_to.

    record_type 'metadata' has the source's headers, payload digest, title and
    language as `name: value` lines; 'conversion' has the payload's plain text
    and refers to the response as well, with the source's digest kept.  Null
    headers and payloads count as empty; extra columns other than page_id are
    left out.  Repeated records give repeated results.
    """
    head = F.coalesce(F.col("http_headers"), F.lit(""))
    payload = F.coalesce(F.col("payload"), F.lit(""))
    base = records.select(
        "page_id",
        F.col("record_id").alias("refers_to"),
        "target_uri",
        head.alias("source_headers"),
        digest(payload).alias("source_digest"),
        F.btrim(F.regexp_replace(F.regexp_extract(payload, r"(?is)<title[^<>]*>([^<]*)", 1), r"[ \t\r\n]+", " "), F.lit(" ")).alias("__title"),
        F.lower(F.regexp_extract(payload, r"(?i)<html[^<>]* lang=[\"']?([A-Za-z-]+)", 1)).alias("__lang"),
        plain_text(payload).alias("__plain"),
    )
    fields = F.concat(
        F.lit("source-digest: "), F.col("source_digest"), F.lit("\r\nsource-headers: "),
        F.replace(F.col("source_headers"), F.lit("\r\n"), F.lit(" | ")), F.lit("\r\ntitle: "), F.col("__title"), F.lit("\r\nlanguage: "), F.col("__lang"), F.lit("\r\n"),
    )

    def record(kind: str, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), F.lit(content_type).alias("content_type"), block.alias("block"))

    both = F.array(record("conversion", "text/plain", F.col("__plain")), record("metadata", "application/warc-fields", fields))
    rows = base.select("page_id", "refers_to", "target_uri", "source_headers", "source_digest", F.explode(both).alias("r"))
    return rows.select(
        "page_id",
        "r.record_type",
        uuid_of(F.concat(F.col("r.record_type"), F.lit(" of "), F.col("refers_to"))).alias("record_id"),
        "refers_to",
        "target_uri",
        "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"),
        "source_headers",
        "source_digest",
        "r.block",
    )


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each row of pages, in the columns of derivatives()."""
    return derivatives(responses(table(spark, sf_dir, "pages")))


def _decoded(x: str) -> str:
    """SQL for what stands behind an ampersand: a reference is what the standard's table of
    names (html.entities) or its rules for numbers say; anything else stays."""

    def char(n: str) -> str:
        # as html.unescape: code points that no text may hold give nothing or U+FFFD; numbers 128 to 159 are those of windows-1252
        old = "MAP {" + ", ".join(f"{k}: {ord(v)}" for k, v in sorted((n, html.unescape(f"&#{n};")) for n in range(128, 160) if len(html.unescape(f"&#{n};")) == 1)) + "}"
        return f"""CASE WHEN {n} IS NULL OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 OR {n} = 0 THEN chr(65533)
          WHEN {old}[{n}] IS NOT NULL THEN chr({old}[{n}]::INT) WHEN {n} IN (13) THEN chr(13)
          WHEN {n} BETWEEN 1 AND 8 OR {n} BETWEEN 14 AND 31 OR {n} BETWEEN 127 AND 159 OR {n} BETWEEN 64976 AND 65007 OR {n} = 11 OR {n} & 65534 = 65534 THEN ''
          ELSE chr({n}::INT) END"""

    decimal = f"try_cast(regexp_extract({x}, '^#([0-9]+)', 1) AS BIGINT)"
    hexa = f"try_cast('0x' || regexp_extract({x}, '^#[xX]([0-9a-fA-F]{{1,8}})', 1) AS BIGINT)"
    whole = f"regexp_extract({x}, '^[^\\t\\n\\f <&#;]{{1,32}};?')"
    best = f"list_filter(list_transform(range(len({whole}), 0, -1), lambda k: left({whole}, k)), lambda p: names[p] IS NOT NULL)[1]"
    return f"""CASE WHEN regexp_matches({x}, '^#[0-9]') THEN {char(decimal)} || regexp_replace({x}, '^#[0-9]+;?', '')
        WHEN regexp_matches({x}, '^#[xX][0-9a-fA-F]') THEN {char(hexa)} || regexp_replace({x}, '^#[xX][0-9a-fA-F]+;?', '')
        WHEN {best} IS NOT NULL THEN names[{best}] || substr({x}, len({best}) + 1)
        ELSE '&' || {x} END"""


def _sql() -> str:
    def uuid(x):
        return f"'<urn:uuid:' || substr(sha1({x}), 1, 8) || '-' || substr(sha1({x}), 9, 4) || '-' || substr(sha1({x}), 13, 4) || '-' || substr(sha1({x}), 17, 4) || '-' || substr(sha1({x}), 21, 12) || '>'"

    plain = "body"
    for pattern, new in STEPS:
        flags = re.match(r"\(\?([a-z]+)\)", pattern)
        pattern = re.sub(r"^\(\?[a-z]+\)", "", pattern).replace(r"\Z", r"\z")
        plain = f"regexp_replace({plain}, '{pattern}', {'chr(10)' if new else repr('')}, 'g{flags[1] if flags else ''}')"
    plain = f"""list_aggregate(list_transform(regexp_split_to_array({plain}, '&'), lambda x, i: CASE WHEN i = 1 THEN x ELSE {_decoded("x")} END), 'string_agg', '')"""
    plain = f"regexp_replace({plain}, '[ \\t\\r\\x0b\\x0c]+', ' ', 'g')"
    plain = f"trim(regexp_replace({plain}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
    crlf = "chr(13) || chr(10)"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in sorted(html5.items())) + "}"
    return f"""
WITH known AS (SELECT {names} AS names), src AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS body FROM pages
), response AS (
  SELECT *, 'response ' || coalesce(page_id::VARCHAR, '') || ' ' || target_uri AS name,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(body) AS source_headers,
    'sha1:' || sha1(body) AS source_digest FROM src
), parts AS (
  SELECT *, {uuid("name")} AS refers_to, {plain} AS plain,
    trim(regexp_replace(regexp_extract(body, '<title[^<>]*>([^<]*)', 1, 'si'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS title,
    lower(regexp_extract(body, '<html[^<>]* lang=["'']?([A-Za-z-]+)', 1, 'i')) AS lang FROM response, known
), records AS (
  SELECT page_id, refers_to, target_uri, source_headers, source_digest, 'conversion' AS record_type, 'text/plain' AS content_type, plain AS block FROM parts
  UNION ALL
  SELECT page_id, refers_to, target_uri, source_headers, source_digest, 'metadata', 'application/warc-fields',
    'source-digest: ' || source_digest || {crlf} || 'source-headers: ' || replace(source_headers, {crlf}, ' | ') || {crlf} || 'title: ' || title
    || {crlf} || 'language: ' || lang || {crlf} FROM parts
), named AS (SELECT *, record_type || ' of ' || refers_to AS name FROM records)
SELECT page_id, record_type, {uuid("name")} AS record_id, refers_to, target_uri, content_type, strlen(block)::BIGINT AS content_length,
  'sha1:' || sha1(block) AS block_digest, source_headers, source_digest, block FROM named
"""


OP1_SQL = _sql()
