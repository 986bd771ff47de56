"""Fixed rules against plain Python; mined rules against counting."""

import itertools

from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitchloom.llm import url_rules
from pitchloom.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "no scheme", "http://", "http://ORG", "https://a.Example.ORG/es/1?x=/de/", "http://example.org/es", "x://notorg/",
    "http://example.org/en/15#f", "http://example.org/en/25", "http://b.com/fr/", "http://b.com/de/://x.org/", "http://com/de/1",
    "http://b.com?de/", "http://ÉCOLE.org/", "http://b.com//de/", "a\nb://q.com/fr/z", "http://user@x.com:80/fr/",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:k], rest[k:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [
        r for r in URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith("/" + r.path)
    ]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_fixed_rules(spark):
    rows = [(k, u, "x") for k, u in enumerate(ODD)] + [(3, ODD[5], "x"), (None, ODD[6], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_rules.judge(df, URL_RULES, support=0.1).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert url_rules.judge(df.filter(F.lit(False)), URL_RULES).count() == 0
    unlabelled = url_rules.judge(df.filter("url is null"), URL_RULES).collect()
    assert [r.verdict for r in unlabelled] == ["allow"]


def test_mining_pruning_and_matching(spark):
    labelled = [(["a", "x"], "block")] * 4 + [(["a", "y"], "allow")] * 3 + [(["a", "x", "z"], "block")] * 2 + [(["b", "z"], "allow")] * 2
    rules = url_rules.prune(url_rules.mine(spark.createDataFrame(labelled, "tokens array<string>, verdict string"), 0.1, 0.8))
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in rules.collect()}
    want = {}
    for n in (1, 2, 3):
        for combo in itertools.combinations("abxyz", n):
            rows = [v for t, v in labelled if set(combo) <= set(t)]
            for v in set(rows):
                c, s = rows.count(v) / len(rows), rows.count(v) / len(labelled)
                if c >= 0.8 and s >= 0.1:
                    want[combo, v] = (c, s)
    for combo, v in list(want):
        parts = [(p, v) for k in range(1, len(combo)) for p in itertools.combinations(combo, k)]
        if any(p in want and want[p][0] >= want[combo, v][0] for p in parts):
            del want[combo, v]
    assert got == want
    urls = [(1, ["a", "x"]), (2, ["y"]), (3, ["q"]), (4, ["x", "y", "b"]), (5, [])]
    found = {r._row: r.mined for r in url_rules.match(spark.createDataFrame(urls, "_row long, tokens array<string>"), rules).collect()}
    for i, t in urls:
        fit = [(*want[k], list(k[0]), k[1]) for k in want if set(k[0]) <= set(t)]
        assert found.get(i) == (max(fit)[3] if fit else None)


def test_query(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = entry.queries()["op8_url_rules"](spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
