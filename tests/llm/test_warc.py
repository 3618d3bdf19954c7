import hashlib
import html
import time

import duckdb

from rankvane.llm import warc

ODD = [
    None, "", "plain", "<p>one</p><p>two", "a<!-- gone -->b<!-- open <p>lost", "<script>var x = '<p>';</script>after", "<SCRIPT type='x'>lost",
    "<style>p {}</style >x", "1 < 2 and 3 > 2", "<br/>a<br>b<hr>", "&amp;lt; &copy;2020 &middot; &notit; &not; &#65;&#x42;&#128;&#0;&#x110000;&#xD800;&#1; &nosuch; & &;", "tail <b", "<title>A &amp; B</title>",
    "x\u00a0y &nbsp;&hellip;&Aacute; &ampamp", "<html lang=en><title\n>t\n u</title>",
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_text_of_odd_pages():
    assert warc.text_of("a<!-- gone -->b<!-- open <p>lost") == "ab"
    assert warc.text_of("<script>var x = '<p>';</script>after") == "after"
    assert warc.text_of("<p>one</p><p>two") == "one\ntwo"
    assert warc.text_of("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    for text in ("&copy; &#65; &#x42 &notit; &amp;lt; &nosuch;", "&#128; &#0; &hellip;"):
        assert warc.text_of(text) == html.unescape(text)


def test_records_are_linked_and_digested(spark):
    rows = pages(spark, [(i, f"http://x/{i}", t) for i, t in enumerate(ODD)] + [(None, None, None), (3, "http://x/3", ODD[3])])
    responses = {r["record_id"]: r for r in warc.responses(rows).collect()}
    got = warc.derivatives(warc.responses(rows)).collect()
    assert len(got) == 2 * (len(ODD) + 2)
    for r in got:
        source = responses[r["refers_to"]]
        assert r["source_digest"] == "sha1:" + hashlib.sha1(source["payload"].encode()).hexdigest()
        assert r["source_headers"] == source["http_headers"] and r["target_uri"] == source["target_uri"]
        assert r["block_digest"] == "sha1:" + hashlib.sha1(r["block"].encode()).hexdigest()
        assert r["content_length"] == len(r["block"].encode())
        if r["record_type"] == "conversion":
            assert r["block"] == warc.text_of(source["payload"])
        else:
            assert f"source-digest: {r['source_digest']}\r\n" in r["block"]
    ids = [r["record_id"] for r in got if r["page_id"] not in (3,)]
    assert len(ids) == len(set(ids))


def test_sql_on_odd_pages(spark):
    rows = [(i, f"http://x/{i}", t) for i, t in enumerate(ODD)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted(con.execute(f"SELECT page_id, record_type, record_id, block FROM ({warc.OP1_SQL})").fetchall())
    got = warc.derivatives(warc.responses(pages(spark, rows))).select("page_id", "record_type", "record_id", "block").collect()
    assert sorted(map(tuple, got)) == want


def test_broken_pages_of_10_mb_take_seconds():
    for part in ("<!--", "<script", "<style ", "<title", "<a ", "&amp", "</script", "<p>x<!-- y -->"):
        page = part * (10_000_000 // len(part))
        began = time.time()
        warc.text_of(page)
        assert time.time() - began < 30, part
