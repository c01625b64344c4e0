"""URL rules against a plain search through all rules."""

import random
import re

from pyspark.sql import functions as F

from postsift.llm import url_rules as U


def parse(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def plain(url, rules, default="allow"):
    host, path = parse(url)
    fit = [
        (len(h), len(p), h + p, v) for h, p, v in rules
        if h and p is not None and v and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
    ]
    best = max(fit, default=None, key=lambda f: (f[0], f[1]))
    return (host, path, best[2].lower() if best else None, best[3] if best else default)


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("example.com", "/en/deep/er", "allow"), ("example.com", "/en/d", "block"), ("example.com", "", "allow"), ("a.b.c.d", "/\U0010ffff", "block"),
    ("xn.org", "/é", "block"), ("xn.org", "/", "allow"),
]


def urls():
    rnd = random.Random(4)
    hosts = ["example.com", "WWW.Example.com", "wexample.com", "net", "x.net", "a.b.c.d", "z.a.b.c.d", "b.c.d", "xn.org", "com", "", "com.", "É.org:8080"]
    paths = ["", "/", "/en", "/en/", "/en/deep/er/x", "/en/deep", "/en/d", "/es/1", "/é/x", "/\U0010ffff\U0010ffff", "/e", "/EN/", "/en/\U0010ffff"]
    out = [f"{rnd.choice(['http', 'https', ''])}://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/en/", "#/en/")]
    return [*out, None, "", "no scheme/en/", "http:/one/", "a://b://c/d", "http://line\nbreak.com/x\ny", *out[:20]]


def test_against_all_rules(spark):
    rows = [(k, u) for k, u in enumerate(urls())] + [(None, "http://example.com/en/x"), (1, "http://x.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({n: F.lit("clash") for n in ("host", "path", "rule", "key", "open", "at")})
    rules = [*RULES, ("", "/", "block"), (None, "/", "block"), ("com", None, "block"), ("net", "/", None), ("com", "/", "block")]
    frame = spark.createDataFrame(rules, "host string, path string, verdict string").withColumn("key", F.lit("clash"))
    for salts in (1, 3):
        got = U.judge_urls(pages, frame, default="unknown", salts=salts).collect()
        want = [(k, *plain(u, RULES, "unknown")) for k, u in rows]
        assert sorted(map(repr, [tuple(r) for r in got])) == sorted(map(repr, want))


def test_many_nested_rules(spark):
    rnd = random.Random(8)
    rules = sorted({("h.com", "/" + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6)))) for _ in range(60)})
    rules = [(h, p, f"v{k}") for k, (h, p) in enumerate(rules)]
    pages = [(k, "x://s.h.com/" + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9)))) for k in range(400)]
    got = U.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, *plain(u, rules)) for k, u in pages)


def test_empty_tables_and_plan(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert sorted(map(tuple, U.judge_urls(pages, none, default="block").collect())) == [(1, "a.com", "/x", None, "block"), (2, "", "", None, "block")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert U.judge_urls(pages.limit(0), rules).count() == 0
    plan = U.judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
