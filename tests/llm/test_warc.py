import re

from pyspark.sql import functions as F

from martloom.llm import queries, warc
from tests.oracle import compare, connect

HTML = ("<!DOCTYPE html><html lang='de'><head><title>A &amp; B\n</title><script>if (a<b) {'</p>'}</script><style>p{}</style></head>"
        "<body><!-- no <p>text</p> --><h1>Head&nbsp;ing</h1><p>one<b>two</b> &#233;&#x1F600;&#55296;&unknown; 1 < 2 &copy; &lt;b&gt;<br>next <a href=\"/x?a=1&amp;b=2\">link</a></p></body></html>")


def test_records_equal_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), "op1_warc", queries.QUERIES["op1_warc"], queries.ORACLE["op1_warc"], sf_dir) == ""


def derived(spark, pages):
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string, block string, header string")
    return {(r["page_id"], r["warc_type"]): r for r in warc.derive(warc.responses_of_pages(frame)).collect()}


def test_text_links_and_references(spark):
    got = derived(spark, [(1, "http://a/", HTML, "x", "y")])
    text, meta = got[1, "conversion"], got[1, "metadata"]
    assert text["block"] == "Head ing\nonetwo é😀�&unknown; 1 < 2 © <b>\nnext link"
    assert "title: A & B\r\n" in meta["block"] and "language: de\r\n" in meta["block"] and "outlink: /x?a=1&b=2\r\n" in meta["block"]
    assert f"source-digest: {text['source_digest']}\r\n" in meta["block"] and "source-header: Content-Type: text/html" in meta["block"]
    assert text["refers_to"] == meta["refers_to"] != text["record_id"] != meta["record_id"]
    assert f"WARC-Refers-To: {text['refers_to']}\r\n" in text["header"] and text["header"].endswith("\r\n\r\n")
    assert f"Content-Length: {len(text['block'].encode())}\r\n" in text["header"]


def test_hard_pages(spark):
    pages = [(1, None, None, "", ""), (2, "u", "", "", ""), (3, "u", "<script>never closed", "", ""), (4, "u", "x" * 50000 + "<p" * 2000, "", ""),
             (5, "u", "&" * 300 + "&#0;&#x110000;", "", ""), (None, "u", "a", "", "")]
    got = derived(spark, pages)
    assert len(got) == 12 and got[1, "conversion"]["block"] == "" and got[3, "conversion"]["block"] == ""
    assert "WARC-Target-URI" not in got[1, "metadata"]["header"]
    assert got[5, "conversion"]["block"] == "&" * 300 + "��"
    assert derived(spark, []) == {}
    again = derived(spark, [pages[1], pages[1]])
    assert again[2, "metadata"]["record_id"] == got[2, "metadata"]["record_id"]


def test_files_hold_whole_records(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"http://a/{i}", HTML) for i in range(20)], "page_id bigint, url string, html string")
    warc.write_records(warc.derive(warc.responses_of_pages(frame)), str(tmp_path / "out"), codec="none")
    text = "".join(p.read_text(newline="") for p in (tmp_path / "out").glob("part-*"))
    heads = re.findall(r"WARC/1\.1\r\nWARC-Type: (\w+)", text)
    assert len(heads) == 40 and heads.count("metadata") == 20
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).where(F.col("value").endswith("\r\n\r\n")).count() >= 1
