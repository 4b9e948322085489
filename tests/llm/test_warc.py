"""WARC derivatives against a parser of its own kind, and the files' round trip."""

import base64
import gzip
import hashlib
import io
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, warc
from tessera.llm.common import scratch


class Text(HTMLParser):
    """Brute force: text outside hidden elements, with line breaks around block elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], None

    def handle_starttag(self, tag, attrs):
        if self.hidden is None and tag in warc.HIDDEN.split("|"):
            self.hidden = tag
        self.out.append("\n" if tag in warc.BLOCKS or tag in warc.HIDDEN.split("|") else "")

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_data(self, data):
        if self.hidden is None:
            self.out.append(data)

    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def brute(markup):
    p = Text()
    p.feed(markup)
    p.close()
    return p.text()


def pages():
    r = random.Random(1)
    parts = ["<p>", "</p>", "<b class='x>y'>", "</b>", "text", " a &amp; b ", "&lt;i&gt;", "<br/>", "<!-- c <p> -->", "<script>var t='</p>';</script>", "<td title=\"a>b\">", "é", "\n", "<style>p{}</style>", "<a href='x'>", "</a>", "<DIV>", "</Div>"]
    out = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(200)]
    return [*out, "<html lang='de'><head><title>A &amp;\n b</title></head><body>Hi</body></html>"]


def test_plain_text():
    for m in pages():
        assert warc.plain_text(m) == brute(m), m
    assert warc.plain_text("a<script>b") == "a" and warc.plain_text("a<!-- b") == "a" and warc.plain_text("1 < 2 <") == "1 < 2 <"


def test_derivatives_and_files(spark):
    rows = [(i, f"http://a.b/{i}", m, "clash") for i, m in enumerate(pages())] + [(None, None, None, "x"), (3, "http://a.b/3", pages()[3], "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, block string").repartition(3)
    source = warc.responses(table)
    path = scratch(spark, "test-warc")
    files = warc.write_records(source.union(warc.derivatives(source)), path, 20_000)
    assert files.count() > 3
    back = warc.read_records(files, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, source.union(warc.derivatives(source)).collect()))
    found = back.withColumn("page_id", warc.field("X-Page-Id")).collect()
    assert len(found) == 3 * len(rows)
    first = {r.record_id: r for r in found if r.record_type == "response"}
    for r in found:
        named = {f.name: f.value for f in r.fields}
        assert named["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r.block).hexdigest()
        if r.record_type != "response":
            of = first[r.refers_to]
            assert (of.target_uri, of.page_id) == (r.target_uri, r.page_id)
            payload = bytes(of.block).split(b"\r\n\r\n", 1)[1]
            assert named["WARC-Source-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
            if r.record_type == "conversion":
                assert bytes(r.block).decode() == brute(payload.decode())
            else:
                assert b"http-content-type: text/html; charset=utf-8\r\n" in r.block
    about = [r for r in found if r.record_type == "metadata" and r.page_id == "200"][0]
    assert b"title: A & b\r\nlanguage: de\r\n" in about.block


def test_parse_plain_and_folded():
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nX-Note: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for stream in (io.BytesIO(raw + raw), gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(raw) + gzip.compress(raw)))):
        got = list(warc.parse(stream))
        assert [g[5] for g in got] == [b"abc", b"abc"] and got[0][4] == [{"name": "X-Note", "value": "a b"}]


def test_query(spark, tmp_path):
    table = spark.createDataFrame([(1, "http://x/", "<p>a")], "page_id long, url string, html string")
    table.write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.QUERIES["op10_warc"](spark, str(tmp_path)).collect()
    assert sorted(r.record_type for r in rows) == ["conversion", "metadata"] and {r.page_id for r in rows} == {1}
    table.limit(0).write.parquet(f"{tmp_path}/e/pages.parquet")
    assert queries.QUERIES["op10_warc"](spark, f"{tmp_path}/e").where(F.lit(True)).count() == 0


@pytest.mark.parametrize("part", ["<html ", "<a ", "<a href ", "<title ", "<!", "<!-", "<script ", "</", "<a '", '<a "', "<b x='\"", "&#", "&#1", "&#x", "&#0", "<?", "<html lang", "lang= ", "</title ", "< "])
def test_long_pages_take_linear_time(part):
    """A megabyte of any opening takes little time, and does not end the job."""
    page = part * (1_000_000 // len(part))
    row = ("response", "<urn:x>", None, None, [], b"HTTP/1.1 200 OK\r\n\r\n" + page.encode())
    start = time.process_time()
    assert len(list(warc._derived(row))) == 2
    assert time.process_time() - start < 2


def test_references_with_many_digits():
    assert warc.plain_text("&#" + "0" * 9000 + "65; &#" + "1" * 9000 + "; &#x" + "0" * 9000 + "41;") == "A \ufffd A"


def test_wrong_digest_ends_the_job(spark):
    path = scratch(spark, "warc-test")
    rows = [("resource", "<urn:a>", None, None, [{"name": "WARC-Block-Digest", "value": d}], b"block") for d in (warc.digest(b"block"), "sha1:" + base64.b32encode(hashlib.sha1(b"block").digest()).decode(), "md5:x")]
    good = spark.createDataFrame(rows, warc.RECORD)
    assert warc.read_records(warc.write_records(good, path), path).count() == 3
    bad = spark.createDataFrame([(*rows[0][:5], b"other")], warc.RECORD)
    files = warc.write_records(bad, path)
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(files, path).count()
    assert warc.read_records(files, path, verify=False).count() == 1


def test_fused_writing_gives_the_same_records(spark):
    table = spark.createDataFrame([(k, f"http://h/{k}" if k % 3 else None, p) for k, p in enumerate([*pages()[:40], None, ""])], "page_id long, url string, html string")
    apart, fused = scratch(spark, "warc-a"), scratch(spark, "warc-b")
    a = warc.read_records(warc.write_records(warc.derivatives(warc.responses(table)), apart), apart)
    b = warc.read_records(warc.write_derivatives(table, fused), fused)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
