"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives two records that refer to it: ``metadata``
(application/warc-fields: title, language, the source's HTTP headers, digests,
links and the conversion's id) and ``conversion`` (text/plain). Both carry
``WARC-Refers-To``, ``WARC-Refers-To-Target-URI`` and ``WARC-Refers-To-Date`` of
the source, its payload digest, and a digest of their own block. Record ids are
UUIDs made from the source's id and the record's kind, so a rerun or a task
that runs again makes the same records.

Records are rows; ``write_warc`` stores them as WARC files by Spark's text
writer (a record ends with two line breaks, which is its line separator) and
``read_warc`` reads such files again and checks every length.

Defined cases: null html is an empty payload; a null url leaves the URI
headers out; unclosed comments, scripts and tags end with the page; a head ends
at </head> or at what can't stand in one (a tag such as <body, or text), and an
unclosed noscript hides nothing but its tag; repeated
rows give equal records; line breaks in header values become spaces; an empty
table gives an empty result; only page_id, url and html (and headers and date,
if ``http_headers`` and ``date`` name them) are read.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gemstats.llm.common import small_batches

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
QUIET = ("script", "style", "noscript", "template", "head")
REST = r"""(?:[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|[^>]*(?:>|\Z))"""  # of a tag; > may stand in quotes


def _whole(*tags: str) -> re.Pattern:
    """Comments, and these elements with all they hold."""
    return re.compile(r"<!--.*?(?:-->|\Z)|" + "|".join(rf"<{t}\b.*?(?:</{t}\s*>|\Z)" for t in tags), re.I | re.S)


CODE = _whole("script", "style", "template")
OPEN = re.compile(rf"<!--|<({'|'.join(QUIET)})\b", re.I)
CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in QUIET} | {None: re.compile("-->")}
# what stands in a head as it is; other elements of QUIET and comments are looked at by themselves
IN_HEAD = re.compile(r"(?>\s+|<title\b.*?(?:</title\s*>|\Z)|<(?:base|basefont|bgsound|html|link|meta|noframes)\b" + REST
                     + r"|</(?!(?:head|body|html|br)\b)[a-z]" + REST + r"|<[!?](?!--)" + REST + ")*+(?P<end></head\\s*>)?", re.I | re.S)
START = re.compile(REST)


def _shown(page: str) -> str:
    """The page with a line break for each comment and element of QUIET."""
    out, at, head = [], 0, False
    unclosed: set[str | None] = set()  # kinds that are not closed again up to the end
    while True:
        m = OPEN.search(page, at)
        if head:
            inside = IN_HEAD.match(page, at)
            at = inside.end()
            if inside["end"] is None and (m := OPEN.match(page, at)):
                pass  # it stands in the head, too
            else:
                head = False
                out.append("\n")
                continue
        if m is None:
            return "".join([*out, page[at:]])
        out.append(page[at:m.start()] + "\n")
        kind = m[1] and m[1].lower()
        if kind == "head":
            at, head = START.match(page, m.end()).end(), True
            continue
        end = None if kind in unclosed else CLOSE[kind].search(page, m.end())
        if end:
            at = end.end()
        elif kind == "noscript":
            unclosed.add(kind)
            at = START.match(page, m.end()).end()
        else:
            return "".join(out)


BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|"
                   r"hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b" + REST, re.I)
TAG = re.compile("<[a-z/!?]" + REST, re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|\Z)", re.I | re.S)
LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.I)
LINK = re.compile(r"<a\b[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
GAPS = re.compile(r"[^\S\n]+")


def plain_text(page: str) -> str:
    """Lines of visible text, without markup, empty lines and double spaces."""
    text = html.unescape(TAG.sub("", BLOCK.sub("\n", _shown(page))))
    lines = (line.strip() for line in GAPS.sub(" ", text.replace("\r", "\n")).split("\n"))
    return "\n".join(line for line in lines if line)


def _one_line(value: str) -> str:
    return " ".join(html.unescape(value).split())


def page_fields(page: str, url: str) -> tuple[str, str, list[str]]:
    """Title, language and absolute link targets, each once, in order."""
    title, lang = TITLE.search(page), LANG.search(page)
    links = []
    for m in LINK.finditer(CODE.sub("", page)):
        target = _one_line(next(g for g in (*m.groups(), "") if g is not None))
        try:
            links.append(urljoin(url, target))
        except ValueError:  # not a URL
            links.append(target)
    return _one_line(title[1]) if title else "", lang[1] if lang else "", list(dict.fromkeys(x for x in links if x))


PARSED = "struct<text:string,title:string,lang:string,links:array<string>>"


def _parse(pages: pa.Array, urls: pa.Array) -> pa.Array:
    rows = [{"text": plain_text(p), **dict(zip(("title", "lang", "links"), page_fields(p, u), strict=True))}
            for p, u in zip(pages.to_pylist(), urls.to_pylist(), strict=True)]
    return pa.array(rows, pa.struct([("text", pa.string()), ("title", pa.string()), ("lang", pa.string()), ("links", pa.list_(pa.string()))]))


def _uuid(*parts: Column) -> Column:
    """An id of the kind <urn:uuid:...>, the same for the same parts."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-3"), cut[2], F.lit("-a"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def _header(name: str, value: Column) -> Column:
    """One header line; nothing for null."""
    return F.concat(F.lit(f"{name}: "), F.trim(F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")), F.lit(CRLF))


def _headers(*pairs: tuple[str, Column]) -> Column:
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(_header(k, v), F.lit("")) for k, v in pairs])


def responses(pages: DataFrame, date: Column | None = None, http_headers: Column | None = None) -> DataFrame:
    """page_id, record_id, target_uri, date, http_headers, payload,
    payload_digest, of pages(page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    stated = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                      F.octet_length(payload).cast("string"))
    return pages.select(
        "page_id", _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")),
                         F.coalesce("url", F.lit("-")), F.sha2(payload.cast("binary"), 256)).alias("record_id"),
        F.col("url").alias("target_uri"), F.coalesce(date, F.lit(DATE)).alias("date") if date is not None else F.lit(DATE).alias("date"),
        (stated if http_headers is None else F.coalesce(http_headers, stated)).alias("http_headers"),
        payload.alias("payload"), _digest(payload).alias("payload_digest"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for each row of ``responses``: page_id, record_type, record_id,
    refers_to, target_uri, source_digest, block_digest, content_type,
    content_length, headers, block."""
    small_batches(source.sparkSession)
    read = source.withColumn("p", F.arrow_udf(_parse, PARSED)("payload", F.coalesce("target_uri", F.lit(""))))
    meta_id, text_id = _uuid(F.lit("metadata"), F.col("record_id")), _uuid(F.lit("conversion"), F.col("record_id"))
    # the status line, then each header under its own name
    kept = F.concat_ws("", F.transform(F.filter(F.split("http_headers", r"\r?\n"), lambda x: x != ""),
                                       lambda x: F.concat(F.lit("http-"), F.when(x.startswith("HTTP/"), F.concat(F.lit("status: "), x)).otherwise(x), F.lit(CRLF))))
    fields = F.concat(
        _header("source-record", F.col("record_id")), _header("conversion-record", text_id),
        _header("source-payload-digest", F.col("payload_digest")), _header("text-digest", _digest(F.col("p.text"))),
        F.when(F.col("p.title") != "", _header("title", F.col("p.title"))).otherwise(""),
        F.when(F.col("p.lang") != "", _header("language", F.col("p.lang"))).otherwise(""), kept,
        F.concat_ws("", F.transform("p.links", lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF)))))
    kinds = F.array(F.struct(F.lit("metadata").alias("kind"), meta_id.alias("id"), F.lit("application/warc-fields").alias("type"), fields.alias("block")),
                    F.struct(F.lit("conversion").alias("kind"), text_id.alias("id"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("p.text").alias("block")))
    rows = read.withColumn("r", F.explode(kinds)).withColumn("block_digest", _digest(F.col("r.block")))
    head = _headers(("WARC-Type", F.col("r.kind")), ("WARC-Record-ID", F.col("r.id")), ("WARC-Date", F.col("date")),
                    ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To", F.col("record_id")),
                    ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("WARC-Refers-To-Date", F.col("date")),
                    ("WARC-Source-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", F.col("block_digest")),
                    ("Content-Type", F.col("r.type")), ("Content-Length", F.octet_length("r.block")))
    return rows.select("page_id", F.col("r.kind").alias("record_type"), F.col("r.id").alias("record_id"), F.col("record_id").alias("refers_to"),
                       "target_uri", F.col("payload_digest").alias("source_digest"), "block_digest", F.col("r.type").alias("content_type"),
                       F.octet_length("r.block").cast("long").alias("content_length"), head.alias("headers"), F.col("r.block").alias("block"))


def response_records(source: DataFrame) -> DataFrame:
    """headers and block of the response records themselves."""
    block = F.concat("http_headers", F.lit(CRLF * 2), "payload")
    head = _headers(("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")),
                    ("WARC-Target-URI", F.col("target_uri")), ("WARC-Payload-Digest", F.col("payload_digest")),
                    ("WARC-Block-Digest", _digest(block)), ("Content-Type", F.lit("application/http; msgtype=response")),
                    ("Content-Length", F.octet_length(block)))
    return source.select(head.alias("headers"), block.alias("block"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files of rows with headers and block, one file a task."""
    whole = records.select(F.concat("headers", F.lit(CRLF), "block").alias("value"))
    whole.write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers, block, fields (header names in lower case -> values) and whole
    (the length is the stated one; a block that holds a record's start line
    after an empty line is cut there and not whole)."""
    rows = spark.read.option("lineSep", f"{CRLF * 2}WARC/1.1{CRLF}").text(path)
    text = F.regexp_replace("value", r"^WARC/1\.1\r\n", "")
    cut = rows.filter(F.length("value") > 0).select(F.split(text, CRLF * 2, 2).alias("s"))
    lines = F.transform(F.split(F.col("s")[0], CRLF), lambda x: F.split(x, ": ", 2))
    fields = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.lower(x[0]), F.try_element_at(x, F.lit(2)))))
    # only a file's last record still has its two closing line breaks
    length = F.try_element_at(fields, F.lit("content-length")).cast("int")
    last = (F.octet_length(F.col("s")[1]) == length + 4) & F.col("s")[1].endswith(CRLF * 2)
    block = F.when(last, F.expr("left(s[1], length(s[1]) - 4)")).otherwise(F.col("s")[1])
    return cut.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), F.col("s")[0], F.lit(CRLF)).alias("headers"), block.alias("block"),
                      fields.alias("fields"), (F.octet_length(block) == length).alias("whole"))
