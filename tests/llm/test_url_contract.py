"""The query's verdicts against its contract's rules, written out here."""

from fragloom.llm import catalog


def test_verdicts_of_the_contract(spark, tmp_path):
    urls = {
        "http://a.com/en/1": ("com/en/", "block"), "http://b.example.com/en/7": ("example.com/en/7", "allow"), "http://c.net/de/1": ("net/de/", "allow"), "http://net/de/": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://d.example.net/de/8": ("example.net/de/8", "block"), "http://e.org/es/1": ("org/es/", "block"),
        "http://c.net/fr/1": (None, "allow"), "http://e.org/fr/1": (None, "block"),  # by the seeds of their hosts' other pages
    }
    pages = spark.createDataFrame([(i, u, "<a href='/own'>") for i, u in enumerate([*urls, "http://e.org/es/2"])], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in catalog.QUERIES["op10_url_filters"](spark, str(tmp_path)).collect()}
    assert {u: got[i] for i, u in enumerate(urls)} == urls
