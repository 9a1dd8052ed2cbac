"""Whole runs on small inputs, and the driver contract."""

from __future__ import annotations

import __spark_entry__
from gossamer import server
from gossamer.plans import runs
from gossamer.sources import fetch, files

FOLDER = "/root/testdata/sf0.001"


def test_update_and_search(spark, tmp_path):
    pages = [(1, "http://a.b/1", "One", '<a href="2">walrus</a> bread ' + "x y z " * 20), (2, "http://a.b/2", None, "walrus bread " + "p q r " * 20)]
    snapshot = spark.createDataFrame(pages, "page_id long, abs_url string, title string, content string")
    target = str(tmp_path / "index")
    assert {r.action for r in runs.crawl_and_index("http://a.b/1", "walrus", snapshot, target).collect()} == {"insert"}
    assert {r.action for r in runs.crawl_and_index("http://a.b/1", "walrus", snapshot, target).collect()} == {"skip"}
    docs = runs.documents_of(spark, target)
    assert docs.count() == 2
    assert {r.action for r in runs.crawl_and_index(None, "walrus", snapshot, target).collect()} == {"skip"}  # from the last good page
    graph = snapshot.selectExpr("page_id AS node", "abs_url AS url", "content")
    links = spark.createDataFrame([(1, 0, "http://a.b/2", "walrus")], "node long, pos int, href string, anchor string")
    scores = runs.link_scores(graph, links)
    ranks = docs.join(graph.selectExpr("node", "url AS abs_url"), "abs_url").join(scores, "node").selectExpr("index_id AS doc_id", "score AS rank")
    page = runs.ranked_results(docs, runs.open_index(spark, target), ranks, "bread").collect()
    assert len(page) == 2 and all("<b>bread</b>" in r.snippet for r in page)


def test_folder_and_inspections(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_text("<title>T</title>x")
    assert runs.index_folder(spark, str(tmp_path / "d"), str(tmp_path / "index")) == 1
    row = ["7", *["x"] * 7, "1/5/2015", *["x"] * 9]
    (tmp_path / "i.csv").write_text(",".join(files.INSPECTION) + "\n" + ",".join(row) + "\n")
    runs.inspection_dates(spark, str(tmp_path / "i.csv"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "7,01/05/2015,01/05/2015"


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    for name in ("tfidf_top", "robots_rules", "p7_report", "last_good"):
        assert queries[name](spark, FOLDER).count() > 0


def test_commands(spark, tmp_path):
    from gossamer.__main__ import run

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_text('<TITLE>A page</TITLE>walrus words <A href="b.html">the <b>other</b></A>')
    (tmp_path / "d" / "b.html").write_text('<TITLE>B</TITLE>other words <A href="a.html">back</A>')
    (tmp_path / "d" / "c.html").write_text('words that lead nowhere <A href="gone.html">x</A>')
    assert run(spark, ["index", str(tmp_path / "d"), str(tmp_path / "index")]) == "3 documents"
    found = run(spark, ["search", str(tmp_path / "index"), "walrus"])
    assert found.startswith("1: A page\nURL: ") and "<b>walrus</b>" in found
    assert run(spark, ["search", str(tmp_path / "index"), "nothing"]) == "No results were found"
    ranks = dict(x.split() for x in run(spark, ["ranks", str(tmp_path / "d")]).splitlines())
    assert set(ranks) == {"a.html", "b.html", "c.html"} and abs(sum(map(float, ranks.values())) - 1) < 0.01
    snapshot = spark.createDataFrame([(1, "http://a.b/1", "One", "x y z words here")], "page_id long, abs_url string, title string, content string")
    snapshot.write.parquet(str(tmp_path / "pages"))
    assert run(spark, ["crawl", "-u", "http://a.b/1", "-q", "x", "--pages", str(tmp_path / "pages"), "--target", str(tmp_path / "t")]) == "insert 1"
    assert run(spark, ["update", "-q", "x", "-u", "http://a.b/1", "--pages", str(tmp_path / "pages"), "--target", str(tmp_path / "t")]) == "skip 1"


def test_server(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_text("<title>A & B</title>walrus words")
    runs.index_folder(spark, str(tmp_path / "d"), str(tmp_path / "index"))
    answering = server.server(spark, str(tmp_path / "index"), 0)
    threading.Thread(target=answering.serve_forever, daemon=True).start()
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{answering.server_address[1]}{path}").read().decode()
    assert "<b>walrus</b>" in get("/?q=walrus") and "A &amp; B" in get("/?q=walrus")
    assert get("/text?q=gone") == "No results were found" and "Results" not in get("/")
    try:
        get("/other")
        raise AssertionError("a page that isn't there was answered")
    except urllib.error.HTTPError as e:
        assert e.code == 404
    answering.shutdown()


def test_fetched_pages(spark, tmp_path):
    import functools
    import http.server
    import threading

    (tmp_path / "a.html").write_text("<p>walrus</p>")
    (tmp_path / "b.html").write_text('<meta http-equiv="refresh" content="0; url=a.html">')
    (tmp_path / "c.bin").write_bytes(b"\0\1")

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *_):
            pass

    site = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=site.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{site.server_address[1]}"
    urls = [f"{root}/{x}" for x in ("a.html", "b.html", "c.bin", "gone.html")] + ["no url"]
    fetch.register(spark)
    one = {r.url: r for r in spark.read.format("pages").option("urls", "\n".join(urls)).option("block", 2).load().collect()}
    two = {r.url: r for r in fetch.fetched(spark.createDataFrame([(u,) for u in [*urls, urls[0], None]], "url string")).collect()}
    assert one == two and len(one) == 5
    assert one[urls[0]].content == "<p>walrus</p>" == one[urls[1]].content and one[urls[1]].final_url == urls[0]
    assert one[urls[2]].content is None and one[urls[3]].status == 404 and one["no url"].error
    site.shutdown()
