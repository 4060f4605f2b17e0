"""URL rules against a plain loop over all rules."""

import random
import re

import pytest

from staywise.llm import url_rules
from staywise.llm.queries import ORACLES, QUERIES, URL_RULES
from staywise.llm.url_rules import judge_urls
from tests.conftest import SMALL
from tools.check import connect, normalise

SCHEMA = "page_id long, url string, host string, row string, rule string"
RULES = [
    *URL_RULES, ("com", "/", "block"), ("a.example.net", "/en/", "block"), ("a.example.net", "/en/x", "allow"), ("example.net", "", "block"),
    ("Example.ORG", "/", "block"), ("example.org", "/", "allow"), ("dup.de", "/", "allow"), ("dup.de", "/", "block"), ("é.de", "/ü", "block"), ("none.de", "/", None),
]
HOSTS = ["net", "example.net", "a.example.net", "b.a.example.net", "notexample.net", "EXAMPLE.com", "x.example.com", "org", "w.org", "example.org", "dup.de", "é.de", "none.de", "net.", ".net", "net:80", ""]
PATHS = ["", "/", "/en", "/en/", "/en/x", "/en/xy", "/EN/", "/de/1", "/fr/", "/ü/ä", "/\U0010ffff", "/a\nb"]


def odd_urls():
    urls = [f"http://{h}{p}{t}" for h in HOSTS for p in PATHS for t in ("", "?q=/en/", "#x?y")]
    return [None, "", "no scheme", "http:/net/", "://net/en/", "a://b://net/", "mailto:x@net", "http://net/" + "y" * 100_000, *urls]


def frame(spark, urls):
    return spark.createDataFrame([(i if i % 7 else None, u, "h", "r", None) for i, u in enumerate(urls)], SCHEMA).repartition(5)


def parts(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def judge(url, rules, default):
    host, path = parts(url)
    best = (None, default, (-1, -1, ""))
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if v is not None and (h == "" or host == h or host.endswith("." + h)) and path.startswith(p) and (len(h), len(p), v) > best[2]:
            best = (h + p, v, (len(h), len(p), v))
    return host, path, *best[:2]


def check(spark, df, urls, rules, default="allow"):
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = judge_urls(df, listed, default=default)
    assert got.columns == ["row", "host", "path", "rule", "verdict"] and got.select("row.*").columns == df.columns
    rows = [(r.row.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()]
    want = [(u, *judge(u, rules, default)) for u in urls]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("rules", [RULES, [*RULES, ("", "/", "block"), (None, None, "allow")], []])
def test_every_url_gets_its_longest_rule(spark, rules):
    urls = odd_urls() * 2
    check(spark, frame(spark, urls), urls, rules, "block")


def test_a_hot_url_is_spread_and_cuts_change_nothing(spark, monkeypatch):
    rng = random.Random(1)
    urls = ["http://a.example.net/en/x"] * 3000 + [rng.choice(odd_urls()) for _ in range(1500)]
    df = frame(spark, urls).repartition(16).cache()
    rows = url_rules._rows(df, "url")
    cuts = url_rules._cut_points(rows, 8)
    assert len(cuts) == 7 and len({c[:2] for c in cuts}) < 7  # several cuts lie within the hot url
    monkeypatch.setattr(url_rules, "_cut_points", lambda *_: sorted((k, p, s) for k, p in [("ten.", ""), ("ten.elpmaxe.", "/en/"), ("ten.elpmaxe.a.", "/en/x")] for s in (-(1 << 62), 0, 1 << 62)))
    check(spark, df, urls, RULES)


def test_empty_tables(spark):
    df = frame(spark, odd_urls()).limit(0)
    check(spark, df, [], RULES)
    check(spark, frame(spark, [None]), [None], [])


def test_matches_sql(spark):
    got = QUERIES["op13_url_rules"](spark, SMALL).toPandas()
    want = connect(SMALL).execute(ORACLES["op13_url_rules"]).df()
    assert sorted(got.columns) == sorted(want.columns) and normalise(got) == normalise(want)
    assert set(got["verdict"]) == {"allow", "block"} and got["rule"].notna().any()
