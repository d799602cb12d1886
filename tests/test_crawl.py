"""Links in every quoting, and crawls over the hosts of the seeds."""

from groundwork.sources import records

HTML = """<a href="/a">1</a><A class='x' HREF = '/b?q=1#top'>2</A><a href=c/d>3</a><a href=https://two.org/e target=_blank>4</a>
<a data-href="/no">5</a><a href="#only">6</a><a href='mailto:x@y.z'>7</a><a href=/pic.png>8</a><a href='//one.org/f'>9</a><a href="/a">again</a><area href="/g">"""


def test_hrefs_of_all_kinds(spark):
    pages = spark.createDataFrame([("https://one.org/dir/page", HTML), ("https://one.org/none", None), ("https://one.org/empty", "")], "url string, html string")
    same = {(r.src, r.dst) for r in records.link_edges(pages).collect()}
    src = "https://one.org/dir/page"
    assert same == {(src, f"https://one.org{x}") for x in ("/a", "/b?q=1", "/dir/c/d", "/f")}
    both = records.link_edges(pages, spark.createDataFrame([("one.org",), ("two.org",)], "host string"))
    assert {(r.src, r.dst) for r in both.collect()} == same | {(src, "https://two.org/e")}


def test_crawl_crosses_to_hosts_of_seeds_only(spark):
    pages = spark.createDataFrame([
        ("https://one.org/", "<a href='https://two.org/x'></a><a href=https://three.org/></a>"), ("https://two.org/x", "<a href=/y></a>"),
        ("https://two.org/y", ""), ("https://two.org/seed", ""), ("https://three.org/", ""),
    ], "url string, html string")
    seeds = spark.createDataFrame([("https://one.org/",), ("https://TWO.org/seed/",), ("https://one.org/missing",)], "url string")
    got = {(r.url, r.depth) for r in records.crawl(pages, seeds).collect()}
    assert got == {("https://one.org/", 0), ("https://two.org/seed", 0), ("https://two.org/x", 1), ("https://two.org/y", 2)}
