import pytest
from pyspark.sql import functions as F

from lakekit.operators import search, weblinks

COLUMNS = (
    "seq bigint, repo_name string, repo_url string, description string, tags array<string>, data_types array<string>,"
    " data_files array<string>, api_docs_found boolean, quality_score double, structure_summary string, license string"
)
#: Records made for these tests; the expected scores below are worked out by hand from the rules.
RECORDS = [
    (1, "harbour/tide-tables", "u1", "Tide heights by hour, as CSV data.", ["Sea Level"], [".csv"], ["a", "b"], False, 10.0, "Language: R", "MIT"),
    (2, "bakery/bread_prices", "u2", "Feedback on bread in Städte", ["food"], [".json", ".db"], [], True, 0.0, "Language: Go", ""),
    (3, "csvkit/docs", "u3", None, [" csv "], [], ["c"], False, 0.0, None, None),
    (4, "observatory/stars", "u4", "Stars; an API for data", ["sky"], [".json"], ["d"], True, 50.0, "Language: C", "BSD"),
    (5, "empty/empty", "u5", "", [], [], [], False, 0.0, "", None),
]


@pytest.fixture(scope="module")
def repos(spark):
    return spark.createDataFrame(RECORDS, COLUMNS).repartition(3).cache()


def ranked(df):
    return [(r.seq, round(r.score, 6)) for r in df.orderBy(F.col("score").desc(), "seq").collect()]


def test_index(repos):
    found = {}
    for r in search.postings(repos).collect():
        found.setdefault(r.seq, set()).add(r.token)
    assert found == {
        1: {"harbour", "tide", "tables", "sea level", ".csv", "heights", "hour", "csv", "data", "language"},
        2: {"bakery", "bread", "prices", "food", ".json", ".db", "feedback", "städte", "language"},
        3: {"csvkit", "docs", "csv"},
        4: {"observatory", "stars", "sky", ".json", "api", "for", "data", "language"},
        5: {"empty"},
    }
    blocks = search.index_blocks(search.postings(repos), block=2).collect()
    assert {(b.token, tuple(b["keys"])) for b in blocks if b.token == "language"} == {("language", (1,)), ("language", (2,)), ("language", (4,))}


EXPECTED = {
    # 1: index 1 + description 0.5 + type .csv 2 + quality 0.2; 3: index 1 + name 1.5; 4: quality 1 only.
    "csv": [(1, 3.7), (3, 2.5), (4, 1.0)],
    # 2: "feedback" in index 1 and description 0.5, asks for .db by its letters 2; 1 and 4: quality.
    "Feedback": [(2, 3.5), (4, 1.0), (1, 0.2)],
    # 4: index 1 twice, description 0.5 twice, API 2, quality 1; 1: data 1 + 0.5 + 0.2; 2: API 2.
    "api data": [(4, 6.0), (2, 2.0), (1, 1.7)],
    # 1: "tide" in index, name and description 3 + 0.2; 4: quality.
    "TIDE, x": [(1, 3.2), (4, 1.0)],
    # 2: index 1 + description 0.5; quality of the others.
    "städte": [(2, 1.5), (4, 1.0), (1, 0.2)],
    "?!": [(4, 1.0), (1, 0.2)],
}


@pytest.mark.parametrize("query", sorted(EXPECTED))
def test_ranked_search(repos, query):
    assert ranked(search.search(repos, query, 10)) == EXPECTED[query]
    assert ranked(search.search(repos, query, 1)) == EXPECTED[query][:1]


def test_many_queries_take_one_scan(repos):
    names = sorted(EXPECTED)
    queries = {i: names[i % len(names)] for i in range(1000)}
    result = search.search_batch(repos, queries, 2, index=search.postings(repos))
    found = {}
    for r in result.collect():
        found.setdefault(r.query_id, []).append((r.seq, round(r.score, 6)))
    assert {i: sorted(f, key=lambda x: (-x[1], x[0])) for i, f in found.items()} == {i: EXPECTED[q][:2] for i, q in queries.items()}


def test_substring_and_statistics(repos):
    assert search.search_substring(repos, "  ").count() == 0
    assert [r.seq for r in search.search_substring(repos, "STÄDTE").collect()] == [2]
    assert search.search_sidebar(repos, "").count() == 5
    stats = search.lake_stats(repos).first()
    assert (stats.total_repos, stats.total_data_files, stats.licensed_count, stats.api_docs_count) == (5, 4, 2, 2)
    assert stats.data_types == [".csv", ".db", ".json"] and stats.avg_quality_score == 12.0
    assert search.lake_stats(repos.limit(0)).first().avg_quality_score == 0


HTML = """<html><a href="/a/b.CSV">x</a><!-- <a href="/no.csv"> --><A HREF='d.json?x=1'>y</A><a name=z>
<script>var t = '<a href="/s.csv">';</script><a href="//h.org/q&amp;r.gz"><a href=e.zip></html>"""


def test_links(spark):
    pages = spark.createDataFrame([(1, "https://x.org/dir/p", HTML), (2, "https://x.org", None), (3, "u", "<p>")], "id int, url string, html string")
    links = weblinks.page_links(pages, "id")
    found = [tuple(r) for r in links.orderBy("id", "position").collect()]
    assert found == [
        (1, 0, "/a/b.CSV", "https://x.org/a/b.CSV"),
        (1, 1, "d.json?x=1", "https://x.org/dir/d.json?x=1"),
        (1, 2, "//h.org/q&r.gz", "https://h.org/q&r.gz"),
        (1, 3, "e.zip", "https://x.org/dir/e.zip"),
    ]
    assert [r.position for r in weblinks.data_links(links).orderBy("position").collect()] == [0, 2, 3]


def test_addresses(spark):
    cases = {
        "x.csv": "https://h.org/a/b/x.csv", "../x": "https://h.org/a/x", "./x/../y": "https://h.org/a/b/y", "/z/./w": "https://h.org/z/w",
        "..": "https://h.org/a/", "../../../x": "https://h.org/x", "?k=1": "https://h.org/a/b/c?k=1", "#t": "https://h.org/a/b/c?q=2#t",
        "": "https://h.org/a/b/c?q=2", "//o.net/x": "https://o.net/x", "mailto:a@b": "mailto:a@b", "HTTP://x": "HTTP://x", "d?u=../v": "https://h.org/a/b/d?u=../v",
    }
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    found = {r.h: r.u for r in df.select("h", weblinks.absolute(F.lit("https://h.org/a/b/c?q=2#f"), F.col("h")).alias("u")).collect()}
    assert found == cases
    assert df.where("h = 'x.csv'").select(weblinks.absolute(F.lit(None), F.col("h"))).first()[0] == "x.csv"
    tags = '<a class="x" href = y >1</a><a href>2</a><abbr href=n><a data-href="n"><a\nhref="p q"><a href=&#39;r'
    assert spark.range(1).select(weblinks.anchors(F.lit(tags))).first()[0] == ["y", "", "p q"]


def _parsed(pages):
    """The addresses that the standard library's parser finds on each page."""
    from html.parser import HTMLParser

    class Anchors(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.found += [value or "" for name, value in attrs if name == "href"][:1]

    expected = []
    for page in pages:
        parser = Anchors()
        parser.found = []
        parser.feed(page)
        parser.close()
        expected.append(parser.found)
    return expected


def test_unclosed_parts_hold_no_links(spark):
    pages = [
        '<a href="/k">k</a><!-- <a href="/x">x</a> and no end',
        '<a href="/k">k</a><script> <a href="/x">x</a>',
        "<a href=/k>k</a><style> <a href=/x>x</a></styl",
        "<!-- a -- > <a href=/1> <script>a</script\n><a href=/2><script/><a href=/3></script>",
        "<scripted><a href=/4></scripted><!-- x --><a href=/5>",
    ]
    df = spark.createDataFrame([*enumerate(pages), (len(pages), None)], "i int, html string")
    got = [r.found for r in df.orderBy("i").select(weblinks.anchors(F.col("html")).alias("found")).collect()]
    assert got == [*_parsed(pages), None]
    # Many openers without an end are one pass over the page, not one for each.
    page = "<!--" * 300_000
    assert spark.createDataFrame([(page,)], "html string").select(weblinks.anchors(F.col("html"))).first()[0] == []


def test_anchors_against_the_standard_parser(spark):
    pages = [
        '<a title="x > y" href="/d.csv">a</a><a href=\'/e?q="1">2\'>',
        '<a title="see href=no" href=/yes>x</a><a data-href="/no">y</a>',
        '<a href="/a&#38;b&#x2F;c&eacute;&nbsp;d&#128512;&#x80;.csv">',
        '<a href="?a=1&amp;b=3&unknown;&#xD800;&lt&#0;&#1;">',
        "<a title=don't href='/it'>z</a><A HREF = \"/up\" >t</a><a href>",
        '<a href="/1" href="/2"><area href="/3"><abbr href="/4">',
    ]
    expected = _parsed(pages)
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = [r.found for r in df.orderBy("i").select(weblinks.anchors(F.col("html")).alias("found")).collect()]
    assert got == expected
    # As in browsers, a name without a semicolon is no reference before an equals sign or a letter.
    page = '<a href="?a=1&copy=2&notit;">'
    assert spark.range(1).select(weblinks.anchors(F.lit(page))).first()[0] == ["?a=1&copy=2&notit;"]


def test_project_links(spark):
    hrefs = ["/", "/search", "/o/n", "/o", "/login/x", "/o/n/tree", "/p/q?z", "x/y", "/seen/it", "plain", "/r/s"]
    links = spark.createDataFrame([(1, i, h) for i, h in enumerate(hrefs)], "id int, position int, href string")
    seen = spark.createDataFrame([("https://m/seen/it",)], "repo_url string")
    found = weblinks.project_links(links, "id", "https://m", seen, max_per_page=4)
    assert [r.repo_name for r in found.orderBy("position").collect()] == ["o/n", "o/n", "p/q?z", "x/y"]
