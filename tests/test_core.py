"""Operators of the core against values worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gossamer.functions import html, text, urls
from gossamer.operators import crawl, index, links, orphans, pagerank, records, robots, search, snippets
from gossamer.plans import runs
from gossamer.sources import files, sinks, versions
from gossamer.streaming import ingest


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


def test_urls(spark):
    norm = lambda u: one(spark, urls.normalized(F.col("u")), u=u)
    assert norm("HTTP://A.Example:80/x/../y/./z?q=1#f") == "http://a.example/y/zq=1"
    assert norm("http://a.example/x/") == "http://a.example/x/"
    assert norm("nothing") is None
    assert one(spark, urls.unique(F.col("u")), u="https://A.b/c") == "a.b/c"
    assert one(spark, urls.unique(F.col("u")), u="nothing") == "nothing"
    assert one(spark, urls.base(F.col("u")), u="https://a.b/c/d.html") == "http://a.b/c/"
    assert one(spark, urls.base(F.col("u")), u="https://a.b") == "http://a.b"
    assert one(spark, urls.file_name(F.col("u")), u="http://a.b/c") == "http__a.b_c".replace("http__", "http__")
    for href, want in (("x.html", "http://a.b/c/x.html"), ("/x", "http://a.b/x"), ("//h/x", "http://h/x"), ("http://h", "http://h"), ("#s", "http://a.b/c/d#s"), ("?q", "http://a.b/c/d?q")):
        assert one(spark, urls.resolved(F.col("h"), F.col("u")), h=href, u="http://a.b/c/d") == want
    assert not one(spark, urls.valid(F.col("u")), u="http://a.b/?q")


def test_html(spark):
    page = "<html><head><TITLE> A &amp; B </TITLE><style>x</style></head><body><!-- no --><p>Some\n <b>text</b></p><a class='x' href=\"l.html\">the <i>link</i></a></body></html>"
    assert one(spark, html.title(F.col("h")), h=page) == "A & B"
    assert one(spark, html.text(F.col("h")), h=page) == "A & B Some text the link"
    assert one(spark, html.body_text(F.col("h")), h=page) == "Some text the link"
    assert [tuple(x) for x in one(spark, html.links(F.col("h")), h=page)] == [("l.html", "the link")]
    assert one(spark, html.title(F.col("h")), h="<p>none") is None
    hrefs = """<a href='/x'>a</a><a class=k href=/y>b</a><A HREF="/z">c</A><a data-href="/no">d</a><a href='it"s'>e</a>"""
    assert [x.href for x in one(spark, html.links(F.col("h")), h=hrefs)] == ["/x", "/y", "/z", 'it"s']
    assert one(spark, html.decoded(F.col("h")), h="&#65;&#x42;&#160;&eacute; &#xZZ; &#; &lt;&amp;lt;") == "AB é &#xZZ; &#; <&lt;"
    assert one(spark, html.walked_text(F.col("h")), h=page) == "Some\n text  the link  "
    refresh = '<meta http-equiv="refresh" content="0; url=next.html">'
    assert one(spark, html.refresh_target(F.col("h")), h=refresh) == "next.html"


def test_words(spark):
    assert one(spark, F.size(text.words(F.col("t"))), t="a b  c\n\nd \n") == 4
    assert one(spark, text.occurrences(F.col("t"), F.col("p")), t="aaaa", p="aa") == 2
    assert one(spark, text.occurrences(F.col("t"), F.col("p")), t="aaaa", p="") == 0
    assert one(spark, text.scope_hits(F.col("t"), F.lit("x"), "b"), t="<b>x</b> <b>y</b> <b>ax</b>") == 2
    assert one(spark, text.phrase_index(F.split("t", " "), F.split(F.lit("c d"), " ")), t="a b c d c d") == 2
    assert one(spark, text.phrase_index(F.split("t", " "), F.split(F.lit("d e"), " ")), t="a b c d") == -1
    assert one(spark, text.word_index(F.split("t", " "), F.lit("B")), t="a b") == 1
    assert one(spark, text.without_stop_words(F.split("t", " ")), t="the w!alrus of The") == ["walrus", "The"]


@pytest.mark.parametrize(
    ("href", "anchor", "page", "want"),
    [
        ("file.html", "WalrusAndCarpenter", '<a href="file1.html">WalrusAndCarpenter</a>', 100),
        ("walrus5.html", "Cute Poem", '<a href="walrus5.html">Cute Poem</a>', 40),
        ("dummy.html", "Cute Poem", 'walrus word walrus word3 word4 <a href="dummy.html">Cute Poem</a> w1 w2 w3 w4 w5 bread dude bread', 5),
    ],
)
def test_link_score(spark, href, anchor, page, want):
    pages = spark.createDataFrame([(1, page)], "page_id long, content string")
    each = spark.createDataFrame([(1, 0, href, anchor)], "page_id long, pos int, href string, anchor string")
    assert links.scored(pages, each, "walrus carpenter bread").first()["score"] == want


def test_links(spark):
    body = "".join(f'<a href="p{i}">x{i}</a>' for i in range(205)) + '<a href="p0">again</a>'
    pages = spark.createDataFrame([(1, "http://a.b/c", body), (1, "http://a.b/c", body), (2, None, body), (3, "http://a.b", None)], "page_id long, abs_url string, content string")
    found = links.extracted(pages)
    assert found.count() == 200 and {r.page_id for r in found.collect()} == {1}
    assert links.extracted(pages.limit(0)).count() == 0


def test_robots(spark):
    rows = [
        ("a.b", "User-agent: bot\nDisallow: /all\nUser-agent: *\nDisallow: /x\nDisallow: /y/\nUser-agent: z\nDisallow: /z"),
        ("none.b", None), ("empty.b", ""), ("low.b", "User-agent: *\ndisallow: /x"), (None, "Disallow: /"), ("nostar.b", "User-agent: q\nDisallow: /q"),
    ]
    sites = spark.createDataFrame(rows, "host string, robots_txt string")
    got = {r.host: (r.allowed_all, r.disallow) for r in robots.rules(sites).collect()}
    assert got == {"a.b": (False, ["/x", "/y/"]), "none.b": (True, []), "empty.b": (False, []), "low.b": (False, []), "nostar.b": (False, ["/q"])}
    asked = spark.createDataFrame([(1, "a.b", "/x1"), (2, "a.b", "/ok"), (3, "none.b", "/x"), (4, "empty.b", "/x"), (5, "unknown", "/")], "i int, host string, path string")
    assert {r.i for r in robots.safe(asked, sites).collect()} == {2, 3}


def test_crawl(spark):
    pages = [(1, "http://a.b/1", '<a href="2">walrus</a><a href="3">x</a><a href="9">y</a>'), (2, "http://a.b/2", '<a href="3">walrus</a><a href="1">walrus</a>'), (3, "http://a.b/3", ""), (4, "http://a.b/4", "")]
    snapshot = spark.createDataFrame(pages, "page_id long, abs_url string, content string")
    got = crawl.crawl("http://a.b/1", "walrus", snapshot).orderBy("round").collect()
    assert [r.page_id for r in got] == [1, 2, 3] and got[1].score == 50
    assert crawl.crawl("http://a.b/1", "walrus", snapshot, max_pages=2).count() == 2
    assert crawl.crawl("http://a.b/1", "walrus", snapshot, spark.createDataFrame([("a.b", "User-agent: *\nDisallow: /2")], "host string, robots_txt string")).count() == 2


def test_crawl_goes_on_past_missing_pages(spark):
    links_ = "".join(f'<a href="gone{i}">walrus</a>' for i in range(3))
    pages = [(1, "http://a.b/1", links_ + '<a href="2">x</a>'), (2, "http://a.b/2", '<a href="old">x</a>'), (3, "http://a.b/3", ""), (4, "http://a.b/old", '<meta http-equiv="refresh" content="0; url=3">')]
    snapshot = spark.createDataFrame(pages, "page_id long, abs_url string, content string")
    assert [r.page_id for r in crawl.crawl("http://a.b/1", "walrus", snapshot, max_pages=3).orderBy("round").collect()] == [1, 2, 3]


def docs(spark):
    rows = [(1, "the walrus ate bread", "bread"), (2, "walrus walrus and carpenter", None), (3, None, "walrus"), (4, "", ""), (5, "bread of the carpenter", "notes"), (6, "Café Καφές 2x", None)]
    return index.Index.of(spark.createDataFrame(rows, "index_id long, contents string, title string"), "contents", "title")


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("walrus", {1, 2}), ("walrus AND bread", {1}), ("+walrus -bread", {2}), ("walrus NOT carpenter", {1}), ('"walrus ate"', {1}), ('"the walrus"', {1, 2}), ('"bread carpenter"', set()), ('"bread of the carpenter"', {5}),
        ('"ate walrus"~1', set()), ('"ate walrus"~2', {1}), ('"bread ate walrus"~3', set()), ('"bread ate walrus"~4', {1}), ('"walrus bread"~1', {1}), ("title:walrus", {3}), ("walr*", {1, 2}), ("w?lrus", {1, 2}),
        ("walrsu~", {1, 2}), ("walrsu~1", set()), ("walru~1", {1, 2}), ("[bread TO carpenter]", {1, 2, 5, 6}), ("{bread TO carpenter}", {6}), ("{bread TO carpenter]", {2, 5, 6}), ("(walrus OR bread) AND carpenter", {2, 5}), ("walrus^3 bread", {1, 2, 5}),
        ("", set()), ("-walrus", set()), ("the", set()), ("walrus AND (NOT bread)", set()), ("title:(walrus OR notes)", {3, 5}), ("café", {6}), ("ΚΑΦΈΣ", {6}), ("καφές", {6}),
    ],
)
def test_query_language(spark, query, want):
    assert {r.doc_id for r in search.matches(docs(spark), query).collect()} == want


def test_search_scores(spark, tmp_path):
    got = {r.doc_id: r.score for r in search.matches(docs(spark), "walrus").collect()}
    idf = search.idf(6, 2)
    assert got[1] == pytest.approx(idf * idf / 3**0.5 / idf) and got[2] == pytest.approx(2**0.5 * idf * idf / 3**0.5 / idf)
    assert [r.doc_id for r in search.top(search.matches(docs(spark), "walrus"), 1).collect()] == [2]
    assert search.two_fields(docs(spark), "walrus", 3).count() == 3
    stored = docs(spark).store(str(tmp_path / "index"))
    assert {r.doc_id: r.score for r in search.matches(stored, "walrus").collect()} == got
    plan = stored.postings.where(search.parse('"walrus ate"').should[0].wants())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan
    nothing = spark.createDataFrame([], "index_id long, contents string, title string")
    assert search.matches(index.Index.of(nothing, "contents"), "walrus").count() == 0


def test_index_lifecycle(spark, tmp_path):
    target = str(tmp_path / "t")
    page = lambda title: spark.createDataFrame([("absUrl", "body", title)], "abs_url string, content string, title string")
    runs.update(page("title"), target)
    runs.VersionedTable(spark, f"{target}/pages").upsert(page("titleModified"))
    runs.refresh_index(spark, target)
    hits = search.matches(runs.open_index(spark, target), "body").collect()
    assert len(hits) == 1 and [r.title for r in runs.documents_of(spark, target).collect()] == ["titleModified"]


def test_versioned_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "DELTAS", 2)
    table = versions.VersionedTable(spark, str(tmp_path / "t"), "k")
    rows = lambda *xs: spark.createDataFrame(list(xs), "k string, v int")
    assert table.read() is None and table.read("k string, v int").count() == 0
    table.upsert(rows(("a", 1), ("b", 1)), "one")
    table.upsert(rows(("a", 9)), "one")  # taken in before
    table.upsert(rows(("b", 2), ("c", 2)))
    assert {tuple(r) for r in table.read().collect()} == {("a", 1), ("b", 2), ("c", 2)}
    other = versions.VersionedTable(spark, str(tmp_path / "t"), "k")
    with pytest.raises(RuntimeError):
        other._commit(table.manifest()[0], {"base": None, "deltas": [], "batches": []})
    table.upsert(rows(("c", 3)))
    assert table.manifest()[1]["deltas"] == [] and {tuple(r) for r in table.read().collect()} == {("a", 1), ("b", 2), ("c", 3)}
    table.vacuum()
    assert len([x for x in (tmp_path / "t").iterdir() if x.is_dir()]) == 1 and table.read().count() == 3
    assert {tuple(r) for r in versions.base_and_deltas(rows(("a", 1)), [rows(("a", 2), ("b", 1)), rows(("b", 5))], "k").collect()} == {("a", 2), ("b", 5)}


#: The eight-page graph: edges with their weights, and bases.
EDGES = {
    "Arctic": {"Atlantic": 1}, "Atlantic": {"Pacific": 1}, "Bear": {"Pinniped": 1, "PolarBear": 1}, "Pacific": {"Arctic": 1}, "Pinniped": {"Seal": 3, "Walrus": 1, "Bear": 1},
    "PolarBear": {"Bear": 2, "Arctic": 1, "Seal": 1}, "Seal": {"Pinniped": 2}, "Walrus": {"Arctic": 1, "Atlantic": 1, "Pacific": 1, "Pinniped": 1},
}
BASE = {"Arctic": 0.120963, "Atlantic": 0.114031, "Bear": 0.127621, "Pacific": 0.107201, "Pinniped": 0.129376, "PolarBear": 0.139938, "Seal": 0.122101, "Walrus": 0.138768}
RANK = {"Arctic": 0.171042, "Atlantic": 0.165027, "Pinniped": 0.163625, "Pacific": 0.159210, "Seal": 0.117815, "Bear": 0.086435, "PolarBear": 0.072371, "Walrus": 0.064475}


def test_pagerank(spark):
    weights = pagerank.normalized(spark.createDataFrame([(a, b, w) for a, x in EDGES.items() for b, w in x.items()], "src string, dst string, weight long"))
    base = spark.createDataFrame(list(BASE.items()), "node string, base double")
    got = {r.node: r.score for r in pagerank.ranks(base, weights, f=0.7).collect()}
    assert got == pytest.approx(RANK, abs=1e-4) and sum(got.values()) == pytest.approx(1, abs=1e-5)
    alone = {r.node: r.score for r in pagerank.ranks(base, weights.limit(0), f=0.7, iterations=2).collect()}
    assert sum(alone.values()) == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError):
        pagerank.ranks(base, weights, f=1)


def test_pagerank_that_does_not_converge_is_an_error(spark):
    weights = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    base = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "node string, base double")
    with pytest.raises(RuntimeError):
        pagerank.ranks(base, weights, f=0.99, tolerance=1e-9, limit=2)
    before = spark.catalog.listTables()
    pagerank.ranks(base, weights)
    assert spark.catalog.listTables() == before


def test_strengths(spark):
    pages = spark.createDataFrame([(1, '<b>Seal</b> <a href="b.html">Seal</a> b.html'), (2, "")], "node long, content string")
    each = spark.createDataFrame([(1, 2, 0, "b.html", "Seal"), (1, 3, 999, "gone.html", "x"), (2, 1, None, None, None)], "node long, dst long, pos int, href string, anchor string")
    assert {tuple(r) for r in pagerank.strengths(pages, each).collect()} == {(1, 2, 3), (1, 3, 0)}


def test_strict_join(spark):
    rows, targets = spark.createDataFrame([(1, "a"), (2, "b")], "i int, k string"), spark.createDataFrame([("a", 7)], "k string, t int")
    assert [tuple(r) for r in links.strictly_joined(rows.where("k = 'a'"), targets, "k").select("i", "t").collect()] == [(1, 7)]
    with pytest.raises(Exception, match="no target for k b"):
        links.strictly_joined(rows, targets, "k").collect()


def test_small_functions(spark):
    assert one(spark, text.scope_hits(F.col("h"), F.lit("x"), "b"), h="<b>x</b> <b>x</b>") == 2
    assert one(spark, text.scope_hits(F.col("h"), F.lit("x"), "b", greedy=True), h="<b>x</b> <b>x</b>") == 1
    h = 1125899906842597
    for c in "walrus and more words":
        h = (31 * h + ord(c)) % (1 << 64)
    h = (h + 3) % (1 << 64)
    assert one(spark, text.polynomial_hash(F.col("t"), F.lit(3)), t="walrus and more words") == (h - (1 << 64) if h >> 63 else h)
    assert one(spark, urls.local(F.lit("/d/"), F.lit("a.html"))) == one(spark, urls.local(F.lit("/d"), F.lit("a.html"))) == "/d/a.html"
    assert one(spark, urls.resolved(F.lit("../x"), F.lit("http://a.b/c/d/e"))) == "http://a.b/c/x"
    assert one(spark, text.word_index(F.array(F.lit("a"), F.lit("B")), F.lit("b"))) == 1
    assert one(spark, text.without_stop_words(F.array(F.lit("the"), F.lit("w!"), F.lit("?")))) == ["w"]


def test_snippets(spark):
    long = " ".join(f"w{i}" for i in range(100))
    cut = lambda q, t: one(spark, snippets.snippet(F.col("t"), q), t=t)
    assert cut("walrus", "the walrus ate") == "the <b>walrus</b> ate"
    assert cut("w50 w51", long) == "w45 w46 w47 w48 w49 <b>w50 w51</b> w52 w53 w54 w55 w56"
    assert cut("w3 w90", long).count(" ... ") == 1 and "<b>w3</b>" in cut("w3 w90", long)
    assert cut("nothing", long).split() == [f"w{i}" for i in range(40)]
    assert cut("of the", "short text") == "short text" and cut("", "short text") == "short text"
    assert one(spark, snippets.shortened(F.lit("a <b>b c d</b> e"), 2)) == "a <b>b c d</b>"
    rows = spark.createDataFrame([(1, 0, 5), (1, 10, 12), (1, 18, 20), (2, 1, 9), (2, 2, 3), (2, 12, 13)], "doc_id int, start int, end int")
    assert {tuple(r) for r in snippets.merged_rows(rows, 5).collect()} == {(1, 0, 12), (1, 18, 20), (2, 1, 13)}
    array = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 5), (10, 12), (18, 20))))
    assert [tuple(x) for x in one(spark, snippets.merged(array, 5))] == [(0, 12), (18, 20)]
    results = spark.createDataFrame([(2, None, "u2", None), (1, "T", "u1", "s")], "rank int, title string, abs_url string, snippet string")
    assert snippets.as_html(results).first()[0].startswith('<h3>Results:</h3><div><b>1: <a href="u1">T</a></b><br>s<br><a href="u1">u1</a></div><div><b>2: ')
    assert snippets.as_html(results.limit(0)).first()[0] == "<h3>No results were found</h3>"
    odd = spark.createDataFrame([(1, "<i>&", 'u"', "<b>x</b><script>")], "rank int, title string, abs_url string, snippet string")
    assert snippets.as_html(odd).first()[0] == '<h3>Results:</h3><div><b>1: <a href="u&quot;">&lt;i&gt;&amp;</a></b><br><b>x</b>&lt;script&gt;<br><a href="u&quot;">u&quot;</a></div>'
    assert snippets.as_text(results.limit(0)).first()[0] == "No results were found"


def test_similarity(spark):
    a, b = F.array(*map(F.lit, (1, 2, 3, 4, 5))), F.array(*map(F.lit, (3, 4, 5, 6, 7, 8)))
    assert one(spark, index.jaccard(a, b)) == 0.375
    assert one(spark, index.jaccard(a, F.array().cast("array<int>"))) == 0
    assert one(spark, index.shingles(F.col("t"), 2), t="a b\nc d") == ["a bc", "bc d"]
    assert one(spark, index.shingles(F.col("t"), 4), t="a b") == []
    assert sorted(one(spark, index.counted(index.shingles(F.col("t"), 1)), t="a b a")) == ["a#2", "b#1"]
    same = one(spark, index.minhash_estimate(index.minhash(index.shingles(F.col("t"), 2)), index.minhash(index.shingles(F.col("t"), 2))), t="a b c d")
    assert same == 1


def test_upsert(spark):
    long = " ".join(f"w{i}" for i in range(60))
    old = spark.createDataFrame([("u1", long), ("u2", long), ("u3", None)], "abs_url string, content string")
    new = spark.createDataFrame([("u1", long), ("u2", "other words altogether now"), ("u4", "x"), ("u3", None)], "abs_url string, content string")
    got = index.upsert_actions(new, old, "abs_url", "content")
    assert {r.abs_url: r.action for r in got.collect()} == {"u1": "skip", "u2": "update", "u4": "insert", "u3": "update"}
    after = index.upsert(old, got.where("action <> 'skip'").select("abs_url", "content"), "abs_url")
    assert {r.abs_url: r.content for r in after.collect()} == {"u1": long, "u2": "other words altogether now", "u3": None, "u4": "x"}


def test_streamed_upsert(spark, tmp_path):
    schema = "abs_url string, content string, fetched_at timestamp"
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("u1", "a b c d e", day), ("u1", "f g h i j", day + dt.timedelta(1)), (None, "x", day)], schema).coalesce(1).write.parquet(str(tmp_path / "landing"))
    for n in range(2):
        ingest.ingest(spark, str(tmp_path / "landing"), schema, str(tmp_path / "target"), str(tmp_path / f"state{n}")).awaitTermination()
        table = versions.VersionedTable(spark, str(tmp_path / "target"))
        assert [(r.abs_url, r.content) for r in table.read().collect()] == [("u1", "f g h i j")] and table.manifest()[0] == 1


def test_streamed_arrivals(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    schema = "abs_url string, arrived_at timestamp"
    spark.createDataFrame([("a", day), ("b", day), ("c", day + dt.timedelta(9))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.arrivals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.pages for r in spark.table("arrived").collect()) == [1, 2]


def test_records(spark):
    rows = spark.createDataFrame([("a", "1/5/2015"), ("a", "12/31/2014"), ("b", "13/45/2015"), ("b", "01/01/2015"), ("c", None)], "id string, day string")
    assert [(r.id, str(r.first), str(r.last)) for r in records.first_last(rows, "id", "day").collect()] == [("a", "2014-12-31", "2015-01-05")]
    listing = '<tr id="listing_7"><td><h5><a href="/x">1 Main St</a></h5></td><td class="area">Soho</td><td class="type">Condo</td><td class="rooms">studio</td><td class="rooms">1.5 baths</td><td class="size">1,550 ft&sup2;</td><td>$3,200&nbsp;</td></tr>'
    got = records.listing_rows(spark.createDataFrame([(f"<table>{listing}\n{listing}</table>",), ("none",), (None,)], "html string"))
    assert got.count() == 2 and tuple(got.first()) == (7, "/x", "1 Main St", "Soho", "Condo", 0.0, 1.5, 1550, 3200)
    line = 'dataLayer = [{"id":"1","p":2},{"id":"2","p":3},{"id":"3"},{"id":"4"}]'
    assert [tuple(r) for r in records.data_layer_rows(spark.createDataFrame([(line,), ("x",)], "value string"), "id string, p int").collect()] == [("1", 2), ("2", 3)]
    assert one(spark, records.amount(F.lit("from $1,234 on"))) == 1234 and one(spark, records.amount(F.lit("1"))) is None


def test_files(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.html").write_text("<title>T</title><p>x y</p>")
    (tmp_path / "d" / "sub" / "b.htm").write_text("<p>z</p>")
    (tmp_path / "d" / "c.txt").write_text("no")
    got = files.page_documents(files.html_folder(spark, str(tmp_path / "d"))).orderBy("filename").collect()
    assert [(r.title, r.contents) for r in got] == [("T", "x y"), (None, "z")]
    assert files.folder_links(spark, str(tmp_path / "d")).count() == 2
    (tmp_path / "m.json").write_text('{"pages": {"u": {"id": "1", "abs_url": "u", "title": "T", "out_links": [{"url": "x"}]}}}')
    assert files.page_map(spark, str(tmp_path / "m.json")).first().title == "T"
    assert files.page_map(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "i.csv").write_text(",".join(files.INSPECTION) + '\n1,"A, B",' + ",".join(["x"] * 15) + "\n")
    row = files.inspections(spark, str(tmp_path / "i.csv")).first()
    assert row["name"] == "A, B" and row.inspection_type == ""
    (tmp_path / "t.data").write_text("1 ? 3  \n\n4 5 6\n")
    assert [tuple(r) for r in files.data_table(spark, str(tmp_path / "t.data"), 3, " ").collect()] == [("1", None, "3"), ("4", "5", "6")]
    (tmp_path / "h.data").write_text("0\t1\t2\n0\t1\t7\n?\t1\t8\n")
    assert [tuple(r) for r in files.data_table(spark, str(tmp_path / "h.data"), 3, "\t", header=True).collect()] == [("0", "1", "7"), (None, "1", "8")]
    sinks.page_map(files.page_map(spark, str(tmp_path / "m.json")), str(tmp_path / "again"))
    assert files.page_map(spark, str(tmp_path / "again")).collect() == files.page_map(spark, str(tmp_path / "m.json")).collect()
    sinks.last_good(spark.createDataFrame([("http://a/b",)], "abs_url string"), str(tmp_path / "good"))
    assert files.last_good(spark, str(tmp_path / "good")) == "http://a/b" and files.last_good(spark, str(tmp_path / "none")) is None
    (tmp_path / "w.txt").write_text("and\nof\nand\n")
    assert files.word_list(spark, str(tmp_path / "w.txt")).count() == 2
    rows = records.first_last(spark.createDataFrame([("1", "1/5/2015")], "id string, day string"), "id", "day")
    sinks.first_last_csv(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1,01/05/2015,01/05/2015"
    sinks.raw_pages(spark.createDataFrame([("http://a/b", "text")], "abs_url string, content string"), str(tmp_path / "raw"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "raw")).collect()] == [("http__a_b", "text")]


def ts(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_orphans(spark):
    assert one(spark, orphans.address(F.lit("HTTPS://A.example:80/x/Y#z"))) == "a.example/x/Y"
    pages = spark.createDataFrame(
        [(1, "http://s/a", [10, 99, 99], ts(1), ts(1), ts(5)), (1, "http://s/a", [10, 99, 99], ts(1), ts(1), ts(5)), (2, "http://s/a", None, ts(5), ts(5), None), (3, None, [], None, ts(1), None)],
        "page_id long, abs_url string, out_links array<long>, fetched_at timestamp_ntz, stored_at timestamp_ntz, removed_at timestamp_ntz",
    )
    each = [(10, "http://s/a", ts(0)), (11, "HTTP://S/a#x", ts(3)), (12, "http://s/a", ts(9)), (13, "http://s/b", ts(3)), (14, "http://s/seed", ts(3)), (15, "http://else/b", ts(3)), (16, None, ts(3)), (17, "http://s/a", None)]
    each = spark.createDataFrame(each, "link_id long, abs_url string, seen_at timestamp_ntz")
    seeds, sites = spark.createDataFrame([("https://s/seed",)], "abs_url string"), spark.createDataFrame([("S",), (None,)], "host string")
    crawl_ = orphans.Crawl(pages, each, seeds, sites)
    got = {tuple(r) for r in orphans.dangling(crawl_).collect()}
    assert {r[:3] for r in got} == {("out_links", 1, "99"), ("abs_url", 10, "http://s/a"), ("abs_url", 13, "http://s/b"), ("abs_url", 17, "http://s/a")}
    counts = {(r.ref, r.period): r.orphans for r in orphans.dangling_counts(crawl_).collect()}
    assert counts == {k: len([1 for r in got if (r[0], r[3]) == k]) for k in {(r[0], r[3]) for r in got}} and counts["abs_url", None] == 1
    empty = orphans.Crawl(pages.limit(0), each.limit(0), seeds.limit(0), sites.limit(0))
    assert orphans.dangling(empty).count() == orphans.dangling_counts(empty).count() == 0


def test_verdicts_of_heavy_and_other_keys(spark, monkeypatch):
    """A third of the references on one key whose record lives on and off, against brute force."""
    rows = [(None if i % 11 == 0 else "hot" if i % 3 == 0 else f"k{i % 40}", None if i % 50 == 0 else ts((i * 7) % 90), i) for i in range(900)]
    refs = spark.createDataFrame(rows, "key string, at timestamp_ntz, id int").select("*", F.date_format("at", "yyyy-MM").alias("period"))
    lives = [("hot", ts(d), ts(d + 4)) for d in range(0, 90, 9)] + [(f"k{i}", ts(i), None if i % 4 else ts(i + 20)) for i in range(0, 40, 2)] + [("k1", None, None), (None, ts(1), None), ("k3", ts(5), ts(2))]
    records_ = spark.createDataFrame(lives, "key string, since timestamp_ntz, until timestamp_ntz")
    alive = lambda k, at: at is not None and any(x == k and since and since <= at and (until is None or until > at) for x, since, until in lives)
    want = {i for k, at, i in rows if k is not None and not alive(k, at)}
    for share, few in ((1 / 4, 100), (1e-9, 100), (1 / 4, 0), (1.0, 100)):
        monkeypatch.setattr(orphans, "FEW", few)
        assert {r.id for r in orphans.absent_then(refs, records_, share).collect()} == want
        got = {r.period: r.orphans for r in orphans.absent_counts(refs, records_, share).collect()}
        assert sum(got.values()) == len(want)
    counts = orphans.reference_counts(refs)
    there = spark.createDataFrame([("hot",), ("k1",), (None,), ("k1",)], "key string")
    for share in (1 / 4, 1e-9):
        assert {r.key for r in orphans.missing_counts(counts, there, share).collect()} == {r[0] for r in rows if r[0]} - {"hot", "k1"}
