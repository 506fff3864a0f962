import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from thoughtloom.llm import top_k, url_filter
from thoughtloom.llm.catalog import LISTED, QUERIES

URLS = [
    "http://a.org/x", "https://EXAMPLE.org/es/1?q=/en/", "http://www.example.org/en/12#/es/", "http://xexample.org/es/",
    "http://b.com/de/x", "http://b.com/fr/", "http://com/de/", "http://b.com", "http://b.net/?a=://c.org/x", "no scheme/org/",
    "", None, "http://", "://org/", "http://x.org", "http://x.org?/", "HTTP://B.COM/DE/", "a://b.com/de/\nx", "http://ä.org/É",
]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x.group().lower(), host)
    fits = [(n + p, a) for a, n, p in LISTED if (host == n or host.endswith("." + n)) and path.startswith(p)]
    rule, action = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, action


def test_listed_rules(spark, tmp_path):
    rows = [(k, u, None, "h", "v") for k, u in enumerate([*URLS, *URLS])] + [(None, URLS[0], None, "h", "v")]
    spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, None, 0), (2, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(map(tuple, QUERIES["op9_url_filter"](spark, str(tmp_path)).collect()))
    want = Counter()
    for i, url, *_ in rows:
        host, path, rule, action = plain(url)
        want[(i, host, path, rule, action or "allow")] += 1
    assert got == want


def test_mined_rules_block_their_combination(spark):
    """Spam hosts with a page key are bad; either part alone is not."""
    rows = []
    for k in range(400):
        spam, paged = k % 2 == 0, k % 4 < 2
        url = f"http://{'spam' if spam else 'site'}{'' if spam else k % 5}.example.net/en/{k}{'?page=2' if paged else ''}"
        rows.append((url, spam and paged))
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = url_filter.mine(labelled, least_rows=20)
    found = {tuple(r.tokens): (r.confidence, r.anchor) for r in rules.collect()}
    assert found == {("host:spam", "key:page"): (1.0, found["host:spam", "key:page"][1])}
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)] + [(999, None)], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(pages, [], rules).collect()}
    assert all((verdicts[k] == "block") == bad for k, (_, bad) in enumerate(rows)) and verdicts[999] == "allow"


def test_rules_need_support_and_confidence(spark):
    rows = [(f"http://rare.net/{k}", True) for k in range(5)] + [(f"http://half.net/{k}", k % 2 == 0) for k in range(100)]
    assert url_filter.mine(spark.createDataFrame(rows, "url string, blocked boolean"), least_rows=20).count() == 0


def best(rows, k=10):
    """(query, rank, id, score) by comparing all with all."""
    held = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    asked = {}
    for i, v in held:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, q in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in held if j != i)[:k]  # noqa: B905
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def check(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "node": F.lit(2), "id": F.lit(3)})
    got = top_k.top_k(frame, F.col("vec_id") % 100 == 0, **more)
    assert sorted(map(tuple, got.collect())) == best(rows)


def test_top_k_in_many_cells(spark):
    r = np.random.default_rng(3)
    centers = r.normal(size=(6, 8))
    rows = [(k, [float(x) for x in centers[k % 6] + r.normal(scale=0.2, size=8)]) for k in range(900)]
    check(spark, rows, cell_rows=100, cell_queries=3, sample_rows=64)


def test_top_k_awkward(spark):
    same = [(k, [0.5, -0.25]) for k in range(0, 150)]
    odd = [
        (200, None), (300, [None, 1.0]), (400, [float("nan"), 1.0]), (500, [float("inf"), 0.0]), (600, []), (700, [1.0]),
        (800, [3.0, 1.0, 2.0]), (None, [9.0, 9.0]), (100, [0.1, 0.2]), (900, [0.0, 0.0]), (901, [-5.0, -5.0]),
    ]
    check(spark, same + odd, cell_rows=20, cell_queries=2)


def test_top_k_of_few_rows(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (100, [0.0, 1.0])])
    check(spark, [(0, [1.0])])


def test_trees_cover_their_points():
    r = np.random.default_rng(4)
    queries, data = r.normal(size=(40, 5)), r.normal(size=(700, 5))
    waiting = [top_k.grow(queries, data, leaf=20)]
    while waiting:
        node = waiting.pop()
        for points, own, radius in ((queries, node.queries, node.query_radius), (data, node.data, node.data_radius)):
            assert len(own) == 0 or np.linalg.norm(points[own] - node.center, axis=1).max() <= radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.data for c in node.children])) == sorted(node.data)
        waiting += node.children


def test_nothing(spark, nothing):
    assert QUERIES["op9_url_filter"](spark, nothing).count() == 0
    assert QUERIES["op10_top_k"](spark, nothing).count() == 0


def test_a_url_on_a_third_of_the_labelled_rows_is_mined(spark):
    """Whatever its hash; supports are shares of all rows."""
    named = spark.range(200).select(F.concat(F.lit("http://spam"), "id", F.lit(".test/offer")).alias("url"), F.lit(True).alias("blocked"))
    hot = named.orderBy(F.xxhash64("url", "blocked").desc()).first().url
    rare = spark.range(60_000).select(F.concat(F.lit("http://h"), "id", F.lit(".example/")).alias("url"), F.lit(False).alias("blocked"))
    repeated = spark.range(30_000).select(F.lit(hot).alias("url"), F.lit(True).alias("blocked"))
    rules = url_filter.mine(rare.union(repeated))
    assert [r.url for r in url_filter.blocked_urls(repeated.union(rare), rules).collect()] == [hot]
