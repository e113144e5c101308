import random

from lexweave.llm import url_filter


def expected(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, action in rules:
        top, slash, rest = rule.partition("/")
        if (host == top or host.endswith("." + top)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, action))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("b.net", "block"), ("b.net/de/8", "block")]


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "rule string, action string")
    return {row["page_id"]: tuple(row)[2:] for row in url_filter.judge(pages, table, **more).collect()}


def test_urls_against_plain_matching(spark):
    rng = random.Random(5)
    hosts = ["a.example.com", "EXAMPLE.com", "b.net", "x.b.net", "net", "org", "notb.net", "", "a..com", "çom"]
    paths = ["", "/", "/en/", "/en/7", "/en/75?x#y", "/de/8", "/de/", "?q=/en/", "#/en/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(150)]
    urls += [None, "", "no scheme", "://b.net/de/8", "http://x", urls[0], "HTTP://A.B.NET/de/8"]
    want = {at: expected(url, RULES) for at, url in enumerate(urls)}
    assert judged(spark, urls, RULES) == want
    # A list cut into several blocks gives the same.
    assert judged(spark, urls, RULES, max_bits=20) == want


def test_cascade_is_exact_for_its_universe(spark):
    universe = spark.range(6000).selectExpr("concat('key', id) as key")
    listed = universe.where("key like '%7'")
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    found = universe.where(cascade.has(universe.key))
    assert found.exceptAll(listed).count() == 0 and found.count() == listed.count()


def test_no_rules_no_rows_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://b.net/", "old")], "page_id long, url string, rule string")
    empty = spark.createDataFrame([], "rule string, action string")
    row = url_filter.judge(pages, empty).first()
    assert (row["rule"], row["verdict"]) == (None, "allow")
    rules = spark.createDataFrame([("b.net", "allow"), ("b.net", "block"), (None, "block"), ("x", None)], "rule string, action string")
    assert url_filter.judge(pages, rules).first()["verdict"] == "block"
    assert url_filter.judge(pages.limit(0), rules).count() == 0
