"""URL rules against their definition, mined rules against an enumeration of token sets."""

import itertools

from pyspark.sql import functions as F

from polysafe.llm import urls

SCHEMA = "page_id long, url string, host int, verdict string"


def frame(spark, found):
    return spark.createDataFrame([(k, u, 1, "x") for k, u in enumerate(found)], SCHEMA)


def by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


URLS = [None, "", "nothing", "http://", "HTTP://A.Example.NET/en/x", "http://example.net", "http://example.net?/en/", "ftp://net/", "http://xnet/", "http://b.net/?x=1",
        "http://example.net/en", "http://example.net/en/#a?b", "https://m.example.com/de/1", "https://myexample.com/de/1", "http://ÄB.org/fr/9", "http://org/fr/",
        "a://b://c.net/d", "http://x\n.net/\ny", "http://" + "a." * 5000 + "net/" + "p/" * 5000, "http://example.com/de/", "http://example.com/de/"]


def test_parts_and_listed_rules(spark):
    got = urls.filter_urls(frame(spark, URLS)).orderBy("page_id").collect()
    assert [(r.host, r.path) for r in got] == [by_hand(u) for u in URLS]
    for r in got:
        fits = [x for x in urls.LISTED if (r.host == x[0] or r.host.endswith("." + x[0])) and r.path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert r.rule == (best and best[0] + best[1])
        assert r.verdict == (best[2] if best else r.mined or "allow")


def test_mined_rules_are_those_of_an_enumeration(spark):
    found = [f"http://{h}.site{k % 3}.test/{p}/{k}" for k, (h, p) in enumerate(itertools.product(["ads", "shop", "blog"], ["win", "news", "a"])) for _ in range(k + 1)]
    labelled = [(u, "block" if "ads" in u or ("shop" in u and "win" in u) else "allow") for u in found] + [(None, None), ("http://q.test/", None)]
    df = spark.createDataFrame(labelled, "url string, label string")
    tokens = {r.url: frozenset(r.t) for r in df.where("url is not null").select("url", urls.url_tokens(F.col("url")).alias("t")).collect()}
    rows = [(tokens[u], v) for u, v in labelled if v]
    support, confidence = 0.1, 0.9
    want = []
    for size in range(1, max(len(t) for t, _ in rows) + 1):
        for combo in {frozenset(c) for t, _ in rows for c in itertools.combinations(sorted(t), size)}:
            having = [v for t, v in rows if combo <= t]
            for v in set(having):
                if having.count(v) / len(rows) >= support and having.count(v) / len(having) >= confidence:
                    want.append((having.count(v) / len(having), having.count(v) / len(rows), combo, v))
    want.sort(key=lambda x: (-x[0], -x[1], len(x[2]), " ".join(sorted(x[2])), x[3]))
    kept = []
    for c, s, combo, v in want:
        if not any(k[1] == v and k[0] <= combo for k in kept):
            kept.append((combo, v))
    mined = urls.mine_rules(df, min_support=support, min_confidence=confidence)
    assert [(frozenset(r.tokens), r.verdict) for r in mined] == kept and kept

    judged = {r.url: r.v for r in df.where("url is not null").select("url", urls.mined_verdict(F.col("url"), mined).alias("v")).collect()}
    for u, t in tokens.items():
        assert judged[u] == next((v for combo, v in kept if combo <= t), None)


def test_empty_table_and_no_labels(spark):
    assert urls.filter_urls(frame(spark, [])).collect() == []
    got = urls.filter_urls(frame(spark, ["http://a.example/"])).collect()
    assert [(r.rule, r.verdict, r.mined) for r in got] == [(None, "allow", None)]
