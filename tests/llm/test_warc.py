import hashlib
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from gemstats.llm import warc


class Reader(HTMLParser):
    """The same text by a parser that goes through the page tag by tag."""
    BLOCKS = set(re.search(r"\(\?:([a-z0-9|\[\]-]+)\)", warc.BLOCK.pattern)[1].replace("h[1-6]", "h1|h2|h3|h4|h5|h6").split("|"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.quiet = [], []

    def handle_starttag(self, tag, attrs):
        if tag in warc.QUIET:
            self.quiet.append(tag)
            self.out.append("\n")
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.quiet and tag == self.quiet[-1]:
            self.quiet.pop()
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_comment(self, data):
        self.out.append("\n")

    def handle_data(self, data):
        if not self.quiet:
            self.out.append(data)

    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def parsed(page):
    r = Reader()
    r.feed(page)
    r.close()
    return r.text()


PAGES = [
    (1, "http://a.example/x/", '<!DOCTYPE html><html lang="fr"><head><title>T &amp; é</title><style>p{}</style></head><body><!-- <p>no</p> --><p>One<br>two &lt;b&gt; '
     '<b>bold</b>&#233;&nbsp;x</p><script>var t="</p><a href=no>";</script><a href="../y?a=1&amp;b=2">l</a> <a href=\'/z\'>m</a><a href="/z">n</a></body></html>'),
    (2, None, None), (3, "", ""), (4, "http://b.example/", "plain & simple"), (5, "http://c.example/", '<p title="a>b">q</p><div>unclosed <!-- to the end <p>x'),
    (6, "http://d.example/\r\nX-Evil: 1", "<li>a<li>b\r\n\r\nWARC c"), (None, "http://e.example/", "<p>" + "long " * 50000),
    (7, "http://f.example/", "<h1>A</h1>B<script>never closed"), (4, "http://b.example/", "plain & simple"),
]


def frame(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, block string, headers string")


def test_text_matches_a_parser(spark):
    for _, _, page in PAGES:
        if "unclosed <!--" not in (page or ""):  # Python's parser shows such a comment
            assert warc.plain_text(page or "") == parsed(page or "")
    assert warc.plain_text(PAGES[4][2]) == "q\nunclosed"
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = sum(warc.plain_text(p) == parsed(p) for p in pages)
    assert same == len(pages)


def test_head_without_end_tag_hides_only_itself():
    page = "<html><head><title>T</title>%s<body><p>text<p>more"
    for inside in ("", "<meta charset=utf-8><link rel=x href='a>b'>", "<script>'<div><body>no'</script><style>p{}</style>", "<!-- <p>no -->\n",
                   "<noscript><img src=x>no</noscript>", "<template><p>no</template>", "<noscript>", "</p></head>"):
        assert warc.plain_text(page % inside) == "text\nmore", inside
        assert warc.page_fields(page % inside, "")[0] == "T"
    assert warc.plain_text("<head><title>T</title><div>a</div><script>no</script>b") == "a\nb"
    assert warc.plain_text("<head><title>T</title>a<p>b</head>c") == "a\nbc"
    assert warc.plain_text("<head><meta a=b></head><p>a</p><noscript>b<p>c") == "a\nb\nc"
    assert warc.plain_text("<header>a</header><head><title>b") == "a"
    assert warc.plain_text("a<noscript>" * 20000).count("a") == 20000


def test_records_refer_to_their_source(spark):
    source = warc.responses(frame(spark))
    rows = warc.derivatives(source).collect()
    assert len(rows) == 2 * len(PAGES)
    by_id = {r.record_id: r for r in rows}
    ids = {r.record_id: r for r in source.collect()}
    for r in rows:
        s = ids[r.refers_to]
        assert f"WARC-Refers-To: {s.record_id}\r\n" in r.headers and f"WARC-Source-Payload-Digest: {s.payload_digest}\r\n" in r.headers
        assert s.payload_digest == "sha256:" + hashlib.sha256(s.payload.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode())
        assert "X-Evil" not in re.findall(r"^[\w-]+", r.headers, re.M)
        if r.record_type == "metadata":
            other = by_id[re.search("conversion-record: (.*)\r\n", r.block)[1]]
            assert other.record_type == "conversion" and other.refers_to == r.refers_to
            assert f"text-digest: {other.block_digest}\r\n" in r.block
            assert "http-status: HTTP/1.1 200 OK\r\n" in r.block and "http-Content-Type: text/html; charset=utf-8\r\n" in r.block
    meta = next(r.block for r in rows if r.page_id == 1 and r.record_type == "metadata")
    assert re.findall("outlink: (.*)\r\n", meta) == ["http://a.example/y?a=1&b=2", "http://a.example/z"]
    assert "title: T & é\r\n" in meta and "language: fr\r\n" in meta
    assert len({r.record_id for r in rows}) == 2 * (len(PAGES) - 1)  # the repeated page makes the same records


def test_source_headers_are_kept(spark):
    df = frame(spark).withColumn("h", F.lit("HTTP/2 203 ok\r\nServer: é\nX: y: z\r\n"))
    block = warc.derivatives(warc.responses(df, F.lit("2024-05-06T07:08:09Z"), F.col("h"))).filter("record_type = 'metadata'").first()
    assert "http-status: HTTP/2 203 ok\r\nhttp-Server: é\r\nhttp-X: y: z\r\n" in block.block
    assert "WARC-Refers-To-Date: 2024-05-06T07:08:09Z\r\n" in block.headers


def test_files_round_trip(spark, scratch):
    source = warc.responses(frame(spark))
    records = warc.response_records(source).unionByName(warc.derivatives(source).select("headers", "block"))
    for compression in ("gzip", "none"):
        path = f"{scratch}/{compression}"
        warc.write_warc(records.repartition(3), path, compression)
        back = warc.read_warc(spark, path)
        assert back.filter("not whole").count() == 0
        key = lambda r: (r.headers, r.block)
        assert sorted(map(key, back.collect())) == sorted(map(key, records.collect()))
        kinds = {r.fields["warc-type"] for r in back.collect()}
        assert kinds == {"response", "metadata", "conversion"}


def test_empty_table(spark):
    assert warc.derivatives(warc.responses(frame(spark).limit(0))).collect() == []
