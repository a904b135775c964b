"""WARC derivatives: linked metadata and plain-text conversion records from responses, in DataFrame functions.

Every response gives two records that refer to it: a ``conversion`` record with the text of its HTML body and
a ``metadata`` record with facts about it (title, language, outlinks, length) and the source's HTTP headers, line
by line. Both keep the target URI and date of the source, and carry digests of their own block.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SOFTWARE = "strandbook derivative builder"
# The frequent named references and what they stand for; the ampersand comes last, so that nothing is resolved twice.
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("ndash", "–"), ("mdash", "—"), ("hellip", "…"), ("amp", "&"))
RARE = "&(?!(?:" + "|".join(name for name, _ in ENTITIES) + ");)(?:#|[A-Za-z][A-Za-z0-9]*+;)"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# Script and style end at their own end tag, whatever follows its name, or else with the page.
RAW = r"<(?<raw>script|style)(?=[\s/>]).*?(?:</\k<raw>(?=[\s/>])[^>]*+(?:>|\z)|\z)"
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul|title"


def digest(block: Column) -> Column:
    """``sha1:`` and the base 32 form that WARC files use."""
    hexed = F.sha1(block)
    fives = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*fives), HEX32, BASE32))


def record_id(*parts: Column) -> Column:
    """A record id that follows from its parts, so that a rerun gives the same."""
    h = F.md5(F.concat_ws("\n", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-3"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def resolved(text: Column) -> Column:
    """text with numeric and standard named character references resolved, once; others stay. No character: U+FFFD; a hard space: a space."""
    rare = sorted(set(name2codepoint) - {name for name, _ in ENTITIES})
    names = F.create_map(*(F.lit(x) for name in rare for x in (name, chr(name2codepoint[name]))))

    def char(match: Column) -> Column:
        body = F.substring(match, 2, F.length(match) - 2)
        digits = F.ltrim(F.substring(body, 2, F.length(body) - 1), F.lit("xX"))
        number = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
        point = F.when(number.cast("int").between(1, 0x10FFFF) & ~number.cast("int").between(0xD800, 0xDFFF), number.cast("int")).otherwise(0xFFFD)
        numeric = F.when(point == ord("&"), "&amp;").otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        return F.when(body.startswith("#"), numeric).otherwise(F.coalesce(F.try_element_at(names, body), match))

    def rare_ones(t: Column) -> Column:
        pieces, found = F.split(t, REFERENCE, -1), F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        joined = F.array_join(F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(char(m), F.lit("")))), "")
        return F.when(t.rlike(RARE), joined).otherwise(t)

    out = F.get(F.transform(F.array(text), rare_ones), F.lit(0))  # in an array, so that the text is made once
    for name, plain in ENTITIES:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(plain))
    return out


def plain_text(html: Column) -> Column:
    """Text of an HTML body: without comments, scripts, styles and tags; blocks end lines; references resolved once.

    What noscript and template hold is text. Only comments, scripts and styles that are not closed reach to the end.
    """
    t = F.regexp_replace(html, rf"(?is)({RAW})|<!--.*?(?:-->|\z)", "$1")  # a comment mark in a script is no comment
    t = F.regexp_replace(t, rf"(?is){RAW}", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCKS})\b[^>]*+>?", "\n")
    t = F.regexp_replace(t, r"<[!/?A-Za-z][^>]*+>?", "")
    t = resolved(t)
    t = F.regexp_replace(t, r"[ \t\r\f\x0B ]++", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?+\n[ \n]*+", "\n"), r"^[ \n]++|[ \n]++$", "")


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of crawled pages: record_id, target_uri, date, http_headers, content_type, body, and page_id."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    uri = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col(id_col).alias("page_id"),
        record_id(F.lit("response"), uri, F.lit(date), F.sha1(body)).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        head.alias("http_headers"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        body.alias("body"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response: page_id, type, record_id, refers_to, target_uri, date, payload_digest, block_digest,
    content_type, source_headers, n_bytes, block, record (the whole record as WARC/1.1 text).

    payload_digest is the digest of the response's body, block_digest that of the record's own block. Null
    columns count as empty. An empty body gives an empty conversion block and metadata without title.
    Repeated responses give repeated records with equal ids. Further columns are not read.
    """
    have = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("record_id", "target_uri", "date", "http_headers", "content_type", "body")}
    df = responses.select("page_id", *(e.alias(c) for c, e in have.items()))
    title = F.regexp_extract("body", r"(?is)<title[^>]*+>(.*?)</title", 1)
    language = F.regexp_extract("body", r"(?i)<html\b[^>]*?\blang=[\"']?([A-Za-z\-]++)", 1)
    links = F.size(F.regexp_extract_all("body", F.lit(r"(?i)<a\b[^>]*?\bhref="), F.lit(0)))
    sent = F.regexp_replace("http_headers", r"[\r\n]++\z", "")
    sent = F.when(sent != "", F.concat(F.lit("source-http: "), F.array_join(F.split(sent, r"\r\n|\r|\n"), "\r\nsource-http: "), F.lit("\r\n"))).otherwise("")
    facts = F.concat(
        F.lit("title: "), F.trim(F.regexp_replace(resolved(title), r"[\s ]++", " ")), F.lit("\r\nlanguage: "), language, F.lit("\r\noutlinks: "), links.cast("string"),
        F.lit("\r\nsource-content-type: "), F.col("content_type"), F.lit("\r\nsource-payload-bytes: "), F.octet_length("body").cast("string"), F.lit("\r\n"), sent,
    )
    made = df.select(
        "page_id", "record_id", "target_uri", "date", "http_headers", digest(F.col("body")).alias("payload_digest"),
        F.explode(F.array(
            F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), facts.alias("block")),
            F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("body")).alias("block")),
        )).alias("r"),
    )
    made = made.select(
        "page_id", F.col("r.type").alias("type"), record_id(F.col("r.type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date",
        "payload_digest", digest(F.col("r.block")).alias("block_digest"), F.col("r.content_type").alias("content_type"), F.col("http_headers").alias("source_headers"),
        F.octet_length("r.block").cast("long").alias("n_bytes"), F.col("r.block").alias("block"),
    )
    lines = [("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "n_bytes")]
    head = F.concat(F.lit("WARC/1.1\r\n"), *(x for name, c in lines for x in (F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))), F.lit(f"Software: {SOFTWARE}\r\n\r\n"))
    return made.withColumn("record", F.concat(head, "block", F.lit("\r\n\r\n")))
