import random

import pytest
from pyspark.sql import functions as F

from podium.llm import url_filter

URLS = [
    None, "", "no scheme/path", "https://", "http:///x", "https://ORG/", "https://a.org/", "http://example.org/es/1", "https://m.example.org/en/12?x#y",
    "https://example.org/en/2", "https://notexample.org/es/", "https://x.com/fr/a", "https://x.com/de/", "https://com/fr/", "https://x.com", "https://x.com?q=/fr/",
    "https://blog.casino-win.example.net/en/1", "https://casino.net", "https://casinos.net/", "https://best-spam-farm.net#/x", "HTTP://É.Example.NET/ü?://b",
    "a://b://c.org/d", "https://x.org:80/fr/", "https://casino-x.org/en/\nline2",
]


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    labels = host.split(".")
    listed = any(set(label.split("-")) & set(url_filter.BLOCKED_TERMS) for label in labels[:-1])
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict or ("block" if listed else "allow")


@pytest.mark.parametrize("inline", [True, False])
def test_verdicts(spark, monkeypatch, inline):
    if not inline:
        monkeypatch.setattr(url_filter, "INLINE_BYTES", 0)
    rows = [(i, u, "x") for i, u in enumerate(URLS + URLS[6:8])] + [(None, "https://casino.net/", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got == {i: by_hand(u) for i, u, _ in rows}
    assert url_filter.judge_urls(pages.where("false")).count() == 0


@pytest.mark.parametrize(("n_listed", "n_other", "shard"), [(40, 4000, 1000), (900, 1100, 100), (500, 0, 1000), (0, 50, 10), (1, 1, 1)])
def test_the_cascade_is_exact_over_its_universe(spark, n_listed, n_other, shard):
    r = random.Random(n_listed)
    keys = [(f"k{r.randrange(10**9)}-{i}", i < n_listed) for i in range(n_listed + n_other)]
    universe = url_filter.stored(spark.createDataFrame(keys, "key string, listed boolean"), "t")
    cascade = url_filter.Cascade.build(universe, shard)
    if n_listed > 30 and n_other > 1000:
        assert len(cascade.levels) > 1
    wrong = universe.withColumn("got", cascade.listed(F.col("key"))).where("got <> listed")
    assert wrong.count() == 0
    assert {x.key for x in cascade.listed_keys(universe.select("key")).collect()} == {k for k, listed in keys if listed}
