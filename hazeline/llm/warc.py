"""WARC derivatives: metadata and plain-text conversion records of response records.

Every response gives two records that refer to it: `metadata` (application/warc-fields: title, status, every header of
the source under its name after `source-`, lengths and links) and `conversion` (text/plain). Both carry the response's
record id in WARC-Refers-To, each other's in WARC-Concurrent-To, the response's target and date, and its payload digest
in WARC-Source-Payload-Digest; ids are derived from the source's, so a second run gives the same records. All
expressions are built-in functions on one row: nothing is shuffled.

Text: comments, scripts and styles go, block elements end a line, other tags go, entities are decoded once (the named
ones of HTML 4, decimal and hexadecimal ones), runs of blanks become one space and of line ends one. Payloads whose
Content-Type is given and isn't HTML or XML are text as they are, without title and links. Links are the href values of
anchors outside comments and scripts, in double quotes, single quotes or none.

Defined cases: null payload counts as empty (both records are still made, with empty text and title); null
target or date leave their header lines out; null http_headers name no status or header; a null record id is
derived from the other columns' digest; a non-null payload_digest of the source is carried over; source columns
named like an added one are replaced by it; repeated responses give repeated records; an empty table gives none;
payloads of any length are whole.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm.common import table, unused

CRLF = "\r\n"
#: Elements whose content isn't text (fixed values of the HTML standard).
HIDDEN = ("script", "style", "noscript", "template", "svg")
#: Comments and hidden elements, in one pass over the page.
_HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(rf"{name}(?:\s[^>]*)?>.*?(?:</{name}\s*>|\z)" for name in HIDDEN) + ")"
BLOCKS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|"
    "html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
_BLOCK, _TAG = rf"(?i)</?(?:{BLOCKS})(?:[\s/][^>]*)?>", r"<[!/?A-Za-z][^>]*>"
_TITLE = r"(?is)<title[^>]*>(.*?)</title"
#: An anchor's href value, with its quotes.
_HREF = r"""(?i)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
#: The named entities of HTML 4 and two of XML and HTML 5, from the standard library's table.
ENTITIES = {name: chr(point) for name, point in sorted(name2codepoint.items())} | {"apos": "'", "nbsp": " "}
_ENTITY = "&(?:#[xX][0-9A-Fa-f]{1,8}|#[0-9]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});"
ADDED = (
    "refers_to", "payload_digest", "warc_type", "content_type", "block", "derived_id", "block_digest", "content_length", "headers",
)


def _char(entity: Column, named: Column) -> Column:
    """The character of an entity; the entity itself where it names none."""
    hexadecimal = F.lower(F.substring(entity, 3, 1)) == "x"
    digits = F.regexp_extract(entity, "&#[xX]?([0-9A-Fa-f]+);", 1)
    point = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    real = point.between(1, 55295) | point.between(57344, 1114111)
    number = F.when(real, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    name = F.element_at(named, F.regexp_extract(entity, "&(.*);", 1))
    return F.coalesce(F.when(F.substring(entity, 2, 1) == "#", number).otherwise(name), entity)


def decoded(text: Column) -> Column:
    """text with each entity decoded once."""
    named = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    between = F.split(text, _ENTITY, -1)
    chars = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), lambda e: _char(e, named))
    both = F.zip_with(between, chars, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(both, "")).otherwise(text)


def without_hidden(html: Column) -> Column:
    """An HTML page without comments and hidden elements; empty for null."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, _BLOCK, "\n"), _TAG, "")


def squeezed(text: Column) -> Column:
    """text with runs of blanks as one space, no blank at line ends, and no empty line."""
    some = text.contains("  ")
    for blank in "\t\x0b\x0c\r":
        some = some | text.contains(blank)
    t = F.when(some, F.regexp_replace(text, r"[ \t\x0b\x0c\r]{2,}|[\t\x0b\x0c\r]", " ")).otherwise(text)
    return F.array_join(F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\x00-\x20]+", " "))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _sha1(c: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(c.cast("binary")))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (page_id, url, html): page_id, record_id, target_uri, date, http_headers, payload."""
    payload = F.coalesce("html", F.lit(""))
    digest = F.md5(payload.cast("binary"))
    length = F.octet_length(payload).cast("string")
    head = F.concat_ws(
        CRLF, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), length)
    )
    return pages.select(
        "page_id",
        _uuid(F.lit("response"), F.col("page_id").cast("string"), F.col("url"), digest).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        head.alias("http_headers"),
        F.col("html").alias("payload"),
    )


def _header_fields(head: Column) -> Column:
    """Every header line as a field of its own: source-, the name in lower case, and the value on one line."""
    lines = F.split(F.regexp_replace(head, r"\r?\n[ \t]+", " "), r"\r?\n", -1)
    lines = F.filter(lines, lambda x: x.rlike("^[^:\\s]+:"))
    name = lambda x: F.lower(F.substring_index(x, ":", 1))
    value = lambda x: _one_line(F.regexp_replace(x, "^[^:]*:", ""))
    return F.transform(lines, lambda x: F.concat(F.lit("source-"), name(x), F.lit(": "), value(x)))


def derivatives(source: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records (record_id, target_uri, date, http_headers, payload).

    Other columns stay. Added: the columns of ADDED.
    """
    tmp = {x: unused(source, x) for x in ("head", "page", "bare", "plain", "text", "title", "links", "record")}
    col = {x: F.col(name) for x, name in tmp.items()}
    payload = F.coalesce("payload", F.lit(""))
    own = _uuid(F.lit("source"), F.col("target_uri"), F.col("date"), F.md5(payload.cast("binary")))
    given = [F.col("payload_digest")] if "payload_digest" in source.columns else []
    keep = [c for c in source.columns if c not in ADDED]
    kind = F.regexp_extract(col["head"], r"(?im)^content-type:[ \t]*([^\r\n]*)", 1)
    marked = (kind == "") | kind.rlike("(?i)html|xml")
    df = source.withColumns(
        {
            "refers_to": F.coalesce("record_id", own),
            "payload_digest": F.coalesce(*given, _sha1(payload)),
            tmp["head"]: F.coalesce("http_headers", F.lit("")),
        }
    )
    # A column for each step, so that none is evaluated again by those that use it twice.
    df = df.withColumn(tmp["page"], F.when(marked, without_hidden(F.col("payload"))))
    df = df.withColumn(tmp["bare"], without_tags(col["page"]))
    df = df.withColumns(
        {
            tmp["plain"]: decoded(col["bare"]),
            tmp["title"]: F.coalesce(F.regexp_extract(col["page"], _TITLE, 1), F.lit("")),
            tmp["links"]: F.coalesce(F.regexp_extract_all(col["page"], F.lit(_HREF), F.lit(1)), F.array().cast("array<string>")),
        }
    )
    df = df.withColumn(tmp["text"], F.coalesce(squeezed(col["plain"]), payload))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    bare = lambda x: F.when(x.substr(1, 1).isin('"', "'"), F.substring(x, F.lit(2), F.char_length(x) - 2)).otherwise(x)
    fields = F.concat(
        F.array(
            line("title", _one_line(decoded(col["title"]))),
            line("source-status", F.regexp_extract(col["head"], r"^HTTP/[0-9.]+ ([0-9]+)", 1)),
        ),
        _header_fields(col["head"]),
        F.array(
            line("payload-length", F.octet_length(payload).cast("string")),
            line("text-length", F.char_length(col["text"]).cast("string")),
        ),
        F.transform(col["links"], lambda x: F.concat(F.lit("outlink: "), _one_line(decoded(bare(x))))),
    )
    metadata = F.concat(F.array_join(fields, CRLF), F.lit(CRLF))
    one = lambda t, c, b: F.struct(F.lit(t).alias("warc_type"), F.lit(c).alias("content_type"), b.alias("block"))
    both = F.array(one("metadata", "application/warc-fields", metadata), one("conversion", "text/plain; charset=utf-8", col["text"]))
    df = df.withColumn(tmp["record"], F.explode(both)).select(*keep, "refers_to", "payload_digest", f"{tmp['record']}.*")
    df = df.withColumns(
        {
            "derived_id": _uuid(F.col("warc_type"), F.col("refers_to")),
            "block_digest": _sha1(F.col("block")),
            "content_length": F.octet_length("block").cast("long"),
        }
    )
    other = F.when(F.col("warc_type") == "metadata", "conversion").otherwise("metadata")
    named = (
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("derived_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Concurrent-To", _uuid(other, F.col("refers_to"))), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")),
        ("WARC-Source-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length")),
    )
    lines = [F.concat(F.lit(f"{name}: "), c.cast("string")) for name, c in named]
    return df.withColumn("headers", F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF)))


def record_text(records: DataFrame) -> DataFrame:
    return records.select(F.concat("headers", F.lit(CRLF), "block").alias("value"))


def write_warc(records: DataFrame, folder: str) -> None:
    """Gzipped WARC files, one a partition, by Spark's text writer: the two line ends that close a record
    are its line separator."""
    record_text(records).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(folder)


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derivatives(responses(table(spark, sf_dir, "pages")))
    whole = F.md5(F.concat("headers", F.lit(CRLF), "block").cast("binary"))
    return records.select(
        "page_id", "warc_type", "derived_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_length",
        whole.alias("record_md5"),
    )


def _sql() -> str:
    def replaced(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', {to}, 'g')"

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(quoted(x) for x in xs) + "]"
    tagless = replaced(replaced("page", _BLOCK, "chr(10)"), _TAG, "''")

    def expanded(x: str) -> str:
        point = "cast(case when lower(e[3]) = 'x' then '0x' || e[4:-2] else e[3:-2] end as ubigint)"
        number = f"case when {point} between 1 and 55295 or {point} between 57344 and 1114111 then chr(cast({point} as int)) end"
        char = f"coalesce(case when e[2] = '#' then {number} else list_extract(chars, list_position(names, e[2:-2])) end, e)"
        chars = f"list_transform(regexp_extract_all({x}, '{_ENTITY}'), lambda e: {char})"
        both = f"list_zip(string_split_regex({x}, '{_ENTITY}'), {chars})"
        return f"array_to_string(list_transform({both}, lambda z: z[1] || coalesce(z[2], '')), '')"

    n = replaced(expanded("bare"), r"[ \t\x0b\x0c\r]+", "' '")
    n = f"trim({replaced(n, r' ?(?:\n ?)+', 'chr(10)')}, ' ' || chr(10))"
    one = lambda x: f"trim({replaced(x, '[\\x00-\\x20]+', chr(39) + ' ' + chr(39))})"
    crlf = "chr(13) || chr(10)"
    uuid = lambda x: replaced(f"md5({x})", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"'<urn:uuid:\1-\2-\3-\4-\5>'")
    href = "case when x[1] in (chr(34), chr(39)) then x[2:-2] else x end"
    return rf"""
with a as (
  select page_id, url, coalesce(html, '') as p, {listed(ENTITIES)} as names, {listed(ENTITIES.values())} as chars from pages
), b as (
  select *, {replaced("p", _HIDDEN, "''")} as page,
    {uuid("concat_ws('|', 'response', cast(page_id as varchar), url, md5(p))")} as refers_to
  from a
), c0 as (
  select *, {tagless} as bare, regexp_extract(page, '{_TITLE}', 1) as title0,
    list_transform(regexp_extract_all(page, {quoted(_HREF)}, 1), lambda x: {href}) as links0 from b
), c as (
  select *, {n} as body, {one(expanded("title0"))} as title,
    list_transform(links0, lambda x: 'outlink: ' || {one(expanded("x"))}) as links from c0
), d as (
  select *, 'metadata' as warc_type, 'conversion' as other, 'application/warc-fields' as content_type,
    array_to_string(list_concat(['title: ' || title, 'source-status: 200', 'source-content-type: text/html; charset=utf-8',
      'source-content-length: ' || strlen(p), 'payload-length: ' || strlen(p), 'text-length: ' || length(body)], links), {crlf})
      || {crlf} as block from c
  union all
  select *, 'conversion', 'metadata', 'text/plain; charset=utf-8', body from c
), f as (
  select *, {uuid("concat_ws('|', warc_type, refers_to)")} as derived_id, {uuid("concat_ws('|', other, refers_to)")} as other_id,
    'sha1:' || sha1(p) as payload_digest, 'sha1:' || sha1(block) as block_digest, cast(strlen(block) as bigint) as content_length from d
)
select page_id, warc_type, derived_id, refers_to, url as target_uri, payload_digest, block_digest, content_length,
  md5(concat_ws({crlf}, 'WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || derived_id, 'WARC-Refers-To: ' || refers_to,
    'WARC-Concurrent-To: ' || other_id, 'WARC-Target-URI: ' || url, 'WARC-Date: 1970-01-01T00:00:00Z',
    'WARC-Source-Payload-Digest: ' || payload_digest, 'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || content_type,
    'Content-Length: ' || content_length) || {crlf} || {crlf} || block) as record_md5
from f
"""


SQL = {"op2_warc_derivatives": _sql()}
