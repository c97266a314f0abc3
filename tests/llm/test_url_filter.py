import re

import pytest
from pyspark.sql import functions as F

from tallyflow.llm import url_filter as u
from tallyflow.llm.common import ORACLES
from tallyflow.llm.queries import RULES, op8_url_filter

PAGES = "page_id long, url string, host string, verdict int, is_listed int, key string"


def judged(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c.group().lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else "block" if host in listed else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://Ä.EXAMPLE.ORG/ES/x", "http://example.org/es/?q", "http://m.example.org/en/1/2", "http://badexample.org/es/",
    "http://x.com/fr/a#b", "http://x.com/de/", "http://com/de/?", "http://com.net/de/", "x://a://b/c", "http://h?x/y", "http://h#/", "http://h/\n/ü", "http://listed.net/a",
    "http://listed.net/a", "http://" + "a." * 20_000 + "net/", "http://org/", "http://org", "ftp://user@listed.net:80/",
]


@pytest.mark.parametrize("max_bits", [u.MAX_FILTER_BITS, 64])
def test_rules_and_listed_hosts(spark, monkeypatch, max_bits):
    rows = [(None if i == 2 else i // 2, url, "h", 1, 1, "k") for i, url in enumerate(URLS)]
    rows += [(100 + i, f"http://host{i}.net/p", "h", 1, 1, "k") for i in range(300)]
    listed = {"listed.net", "", "absent.net", *(f"host{i}.net" for i in range(0, 300, 7))}
    pages = spark.createDataFrame(rows, PAGES)
    hosts = spark.createDataFrame([(h, 1) for h in [*listed, "listed.net", None]], "name string, key int")
    plain = u.with_listed
    monkeypatch.setattr(u, "with_listed", lambda *a: plain(*a, max_bits=max_bits))
    got = sorted((tuple(r) for r in u.judge_urls(pages, RULES, hosts).collect()), key=repr)
    assert got == sorted(((r[0], *judged(r[1], listed)) for r in rows), key=repr)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], PAGES)
    hosts = spark.createDataFrame([("a",)], "name string")
    assert u.judge_urls(pages, RULES, hosts).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/", "h", 1, 1, "k")], PAGES)
    assert [r.verdict for r in u.judge_urls(one, RULES, hosts.limit(0)).collect()] == ["allow"]


def test_every_page_agrees_with_duckdb(spark, sf):
    import check

    got = [tuple(r) for r in op8_url_filter(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()]
    want = check.oracle(sf).execute(f"select page_id, host, path, rule, verdict from ({ORACLES['op8_url_filter']})").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 0


def test_many_listed_keys(spark):
    # Three times as many asked as listed; a filter of 25,000 words, several chunks of them.
    n = 200_000
    name = F.concat(F.lit("h"), F.col("id").cast("string"))
    rows = spark.range(3 * n).select(name.alias("host"), "id")
    got = u.with_listed(rows, spark.range(0, 3 * n, 3).select(name.alias("k")), "host", "l")
    assert got.where(F.col("l") != (F.col("id") % 3 == 0)).count() == 0 and got.where("l").count() == n
