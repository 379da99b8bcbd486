import random

import factlake.llm.url_filter as uf

SCHEMA = "page_id long, url string, host string, verdict string"
URLS = [
    None, "", "no scheme", "http://", "HTTP://Www.Casino-Win.Example.COM/x?q#f", "https://a.example.net/en/1", "https://a.example.net/fr/1", "https://example.com/de/?x", "https://example.com/den",
    "https://x.org/fr/", "https://xorg/fr/", "https://net/", "https://net", "https://net?x", "https://a.net?/en/", "a://b://c.net/x", "https://free-bets.example.com:80/", "https://notfree-bets.example.com/",
    "https://m.free-bets.example.com/en/", "https://ÄÖ.example.org/fr/é?", "https://host/pa\nth/#x", "https://" + "a." * 300 + "adult-x.example.org", "https://h/" + "p" * 50_000,
]


def brute(url, rules=uf.RULES, listed=uf.LISTED):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, after = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fits:
        h, p, says = max(fits, key=lambda r: len(r[0] + r[1]))
        return host, path, h + p, says
    return host, path, None, "block" if any(host == k or host.endswith("." + k) for k in listed) else "allow"


def test_against_comparison(spark):
    rows = [(i, u, "clash", None) for i, u in enumerate(URLS)] + [(4, URLS[4], None, None), (None, "https://b.org/", None, None)]
    got = sorted((-1 if r["page_id"] is None else r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.filter_urls(spark.createDataFrame(rows, SCHEMA)).collect())
    assert str(got) == str(sorted(((-1 if i is None else i), *brute(u)) for i, u, _, _ in rows))


def test_cascade_is_exact_for_its_universe(spark):
    rng = random.Random(9)
    keys = [f"k{rng.getrandbits(60)}" for _ in range(4000)]
    universe = spark.createDataFrame([(k, i % 3 == 0) for i, k in enumerate(keys)], "key string, listed boolean").cache()
    levels = uf.build_cascade(universe)
    assert len(levels) > 2  # there were mistakes to mend
    wrong = universe.where(uf.in_cascade(levels, uf.F.col("key")) != uf.F.col("listed")).count()
    assert wrong == 0


def test_list_too_long_for_the_plan(spark, monkeypatch):
    monkeypatch.setattr(uf, "MOST_BITS", 8)
    rows = [(i, u, None, None) for i, u in enumerate(URLS)]
    got = sorted((r["page_id"], r["verdict"]) for r in uf.filter_urls(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(i, brute(u)[3]) for i, u in enumerate(URLS)]


def test_empty_tables(spark):
    assert uf.filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0
    found = uf.filter_urls(spark.createDataFrame([(1, "https://b.org/", None, None)], SCHEMA), listed=spark.createDataFrame([(None,)], "key string"))
    assert found.first()["verdict"] == "allow"


def test_shards_are_exact_for_their_universe(spark, monkeypatch):
    monkeypatch.setattr(uf, "MOST_BITS", 1024)
    rng = random.Random(10)
    rows = [(f"k{rng.getrandbits(60)}", i % 3 == 0) for i in range(4000)]
    universe = spark.createDataFrame(rows, "key string, listed boolean")
    cascades, shards = uf.build_shards(universe)
    assert shards > 5 and max(r[0] for r in cascades.selectExpr("size(levels)").collect()) > 1
    assert {r["key"] for r in uf.in_shards(universe, cascades, shards).collect()} == {k for k, listed in rows if listed}
    assert uf.in_shards(universe, *uf.build_shards(universe.where("not listed"))).count() == 0


def test_listed_keys_beyond_ascii(spark):
    """Only A-Z are lower-cased, in hosts and in listed keys alike."""
    rows = [(1, "https://x.ÄB.test/", None, None), (2, "https://äb.test/", None, None)]
    listed = spark.createDataFrame([("ÄB.Test",), ("ÄB.Test",)], "key string")
    got = {r["page_id"]: r["verdict"] for r in uf.filter_urls(spark.createDataFrame(rows, SCHEMA), listed=listed).collect()}
    assert got == {1: "block", 2: "allow"}
