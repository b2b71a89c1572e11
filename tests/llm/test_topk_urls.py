import numpy as np
import pytest
from duck import duck_rows, rows_of
from pyspark.sql import functions as F

from freshet.llm import queries, topk, url_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == duck_rows(queries.ORACLE_SQL[name], SF)


def brute(rows, k, asks):
    import math

    own = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in sorted(own, key=lambda r: r[0]):
        if q % asks:
            continue
        best = {}
        for i, b in own:
            if i != q and len(a) == len(b):
                s = max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
                best[i] = max(best.get(i, s), s)
        for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]):
            out.add((q, r + 1, i, s))
    return out


def search(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, df.where(F.col("vec_id") % 100 == 0), **how)
    return {tuple(r) for r in got.collect()}


def test_ties_nulls_repeats_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=12))]) for i in range(230)]
    rows += [(i, rows[0][1]) for i in range(300, 340)]  # ties
    rows += [(None, rows[0][1]), (400, None), (401, [1.0, None] + [0.0] * 10), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (500, [1.0, 2.0]), (501, [3.0, 1.0]), (600, []), rows[5], (5, rows[7][1])]
    got = search(spark, [(*r, "x") for r in rows], block=2, width=4)
    assert got == brute(rows, 10, 100)


def test_queries_of_another_table(spark):
    """The queries score higher with each other than with any row."""
    rows = spark.createDataFrame([(i, [0.01 * i, 0.5]) for i in range(30)], "vec_id long, embedding array<double>")
    ask = spark.createDataFrame([(1000 + i, [9.0, 9.0 + i]) for i in range(20)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(rows, ask, k=3).collect()}
    assert got == {(1000 + i, j + 1, 29 - j) for i in range(20) for j in range(3)}


def test_many_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(i * 50, [float(x) for x in np.float32(rng.normal(size=5))]) for i in range(36)]
    assert search(spark, [(*r, "x") for r in rows], block=2) == brute(rows, 10, 100)


def test_huge_components_are_exact(spark):
    rows = [(i, [float(np.float32(3e30 * (i + 1))), -1.0, 0.5]) for i in range(5)]
    assert search(spark, [(*r, "x") for r in rows]) == brute(rows, 10, 100)


def test_empty_vectors(spark):
    assert search(spark, []) == set()


def test_blocks_prune():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(64, 3000)) * 1024 * np.linspace(3, 0.1, 64)[:, None])
    own = topk.BlockSearch(np.arange(4), x[:, :4], 10, np.full(4, -np.inf), 8)
    for at in range(0, 3000, 500):
        own.feed(np.arange(at, at + 500), x[:, at : at + 500])
    exact = x[:, :4].T @ x
    for q in range(4):
        exact[q, q] = -np.inf
        assert own.best[q][1].tolist() == np.lexsort((np.arange(3000), -exact[q]))[:10].tolist()
    assert own.touched < 0.8 * 4 * 3000 * 8  # block steps left out


URLS = ["http://A.Org/x", "https://m.example.org/es/1", "https://example.org/en/12?q=/es/", "http://example.org/EN/1", "http://xorg/", "http://a.com/de/x#y", "http://a.com/fr/", "http://ads.x.net/", "http://x.net/casino/", "x.net/setup.exe", "http://x.net/setup.exe", "http://x.net/login", "http://a.org", "http://u@h.org:80/de/", "", None, "://", "a://b://c/d", "http://é.org/ñ/" + "z" * 5000, "http://x.net/a\nb/ads/c"]


def test_index_finds_what_trying_all_rules_finds(spark):
    import re

    rules = [*(url_rules.site_rule(*r) for r in url_rules.SITE_RULES), *url_rules.PATTERN_RULES, url_rules.Rule("free", "block", "*etup*"), url_rules.Rule("sep", "block", "|x.net^login")]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    for most in (100, 0):
        got = {r["page_id"]: r for r in url_rules.judge(df, rules, max_local_rules=most).collect()}
        assert len(got) == len(URLS) * 2
        for i, u in enumerate(URLS * 2):
            r = got[i]
            fits = [x for x in rules if re.search(url_rules.to_regex(x.pattern), r["host"] + r["path"])]
            best = max(fits, key=lambda x: x.rank(), default=None)
            assert (r["rule"], r["verdict"]) == ((best.name, best.verdict) if best else (None, "allow")), (u, most)


def test_hosts_and_paths(spark):
    got = [tuple(r) for r in url_rules.with_subject(spark.createDataFrame([(u,) for u in URLS], "url string")).select("host", "path").collect()]
    for u, g in zip(URLS, got, strict=True):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        end = min([path.find(c) for c in "?#" if c in path], default=len(path))
        assert g == ("".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[:end])


def test_only_candidates_run():
    rules = [url_rules.Rule(f"r{i}", "block", f"||site{i}.com/") for i in range(500)]
    index, rest = url_rules.build_index(rules, {"com": 10**6})
    matcher = url_rules.Matcher(index, rest)
    assert matcher.best("a.site7.com/x")[0].name == "r7" and matcher.tried == 1 and not rest
    assert url_rules.usable_tokens("||example.org/en/1") == ["example", "org", "en"]
