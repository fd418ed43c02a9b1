from ratespark.llm import url_reputation as ur

PAGES = "page_id long, url string, html string, host string, rule string"
LABELS = "doc_id long, quality int, toxic int"


def run(spark, urls, labels=()):
    pages = spark.createDataFrame([(i, u, None, "h", "r") for i, u in urls], PAGES)
    return {r.page_id: r for r in ur.judged(pages, spark.createDataFrame(list(labels), LABELS)).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        (1, "https://A.Example.NET/en/1?x#y"), (2, "http://example.net/de"), (3, "http://x.example.com/de/7"), (4, "http://example.com#/de/"),
        (5, "ftp://q.org/fr/?a"), (6, "http://notexample.net"), (7, None), (8, "no scheme"), (9, "http://u.org?/fr/"), (10, "http://example.nets/en/"),
        (11, "a://b://c/d"), (12, "://"), (13, "http://ÄB.net/é"),
    ]
    got = run(spark, urls)
    want = {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/de", "net/", "block"),
        3: ("x.example.com", "/de/7", "example.com/de/", "block"), 4: ("example.com", "", None, "allow"), 5: ("q.org", "/fr/", "org/fr/", "allow"),
        6: ("notexample.net", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("u.org", "", None, "allow"),
        10: ("example.nets", "/en/", None, "allow"), 11: ("b:", "//c/d", None, "allow"), 12: ("", "", None, "allow"), 13: ("Äb.net", "/é", "net/", "block"),
    }
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()} == want


def test_bad_hosts_are_blocked_and_one_bad_page_is_not_enough(spark):
    urls = [(i, f"http://bad.spam{i % 4}.com/{i}") for i in range(200)] + [(1000 + i, f"http://www.good{i % 40}.com/{i}") for i in range(800)]
    urls += [(5000, "http://new.spam1.com/"), (5001, "http://new.com/"), (5002, "http://once.com/")]
    labels = [(i, 0, 0) for i in range(150)] + [(1000 + i, 1, 0) for i in range(600)] + [(5002, 0, 0), (5002, 0, 0), (None, 0, 1), (9999, 0, 1)]
    got = run(spark, urls, labels)
    assert all(got[i].verdict == "block" for i in range(200)) and all(got[1000 + i].verdict == "allow" for i in range(800))
    assert got[5000].verdict == "block" and got[5001].verdict == "allow" and got[5002].verdict == "allow"


def test_domains_and_suffixes(spark):
    hosts = ["a.b.example.co.uk", "example.com", "com", "", "10.0.0.1:80", "x.y.org"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = [tuple(r) for r in df.select(ur.registered_domain(df.h), ur.suffix(df.h)).collect()]
    assert got == [("example.co.uk", "co.uk"), ("example.com", "com"), ("com", "com"), ("", ""), ("10.0.0.1:80", ""), ("y.org", "org")]


def test_repeated_pages_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", None, "", ""), (1, "http://a.com/", None, "", ""), (None, None, None, "", "")], PAGES)
    assert ur.judged(pages, spark.createDataFrame([(1, 0, None)], LABELS)).count() == 3
    assert ur.judged(pages.limit(0), spark.createDataFrame([], LABELS)).collect() == []
