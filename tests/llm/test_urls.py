import random

from pairlab.llm import urls


def brute(rules, host, path):
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if not fit:
        return None, None
    best = max(fit, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block"))
    return best[1] + best[2], best[0]


def test_trie_matches_brute_force():
    rng = random.Random(4)
    hosts = [".".join(rng.choice(["a", "bb", "org", "com"]) for _ in range(rng.randrange(1, 4))) for _ in range(30)] + [""]
    paths = ["".join("/" + rng.choice(["", "x", "xy", "z"]) for _ in range(rng.randrange(3))) for _ in range(30)]
    for _ in range(60):
        rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(rng.randrange(12))]
        trie = urls.Trie(rules)
        for _ in range(60):
            host, path = rng.choice(hosts), rng.choice(paths)
            assert trie.find(host, path) == brute(rules, host, path)


def test_defined_cases(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/en/1")]
    rows = [(1, "http://A.Example.ORG/en/12?q", "h"), (2, "https://notexample.org/en/1", "h"), (3, None, "h"), (4, "mailto:x", "h"), (5, "http://x.org", "h"),
            (5, "http://x.org", "h"), (None, "http://example.org/EN/1", "h"), (6, "ftp://é.net/" + "p" * 20000 + "#f", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = urls.judge(df, rules)
    got = sorted(((r["page_id"], r["_host"], r["path"][:8], r["rule"], r["verdict"]) for r in out.collect()), key=str)
    assert got == sorted([
        (1, "a.example.org", "/en/12", "example.org/en/1", "block"), (2, "notexample.org", "/en/1", "org/", "allow"), (3, "", "", None, "allow"),
        (4, "", "", None, "allow"), (5, "x.org", "", None, "allow"), (5, "x.org", "", None, "allow"), (None, "example.org", "/EN/1", "org/", "allow"),
        (6, "é.net", "/ppppppp", None, "allow"),
    ], key=str)
    assert urls.judge(df.limit(0), rules).collect() == []
